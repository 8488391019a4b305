"""Queries of the training-data operators over their whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.llm import backoff_lm, bpe, decontamination, language_mixture, line_crf, line_rules, ranked_search, simhash, suffix_dedup, toxic_segments, url_rules, warc, whitening
from quaestor.llm.common import remainder, table


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = suffix_dedup.without_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "repeats.n_bytes", "repeats.n_removed", "repeats.n_spans", "repeats.kept_sha256")


def _held_out(divisor: int, rest: int) -> Column:
    return F.coalesce(remainder(divisor) == rest, F.lit(False)).alias("held_out")


def op2_language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language_mixture.fitted(documents.where(remainder(4) != 2))
    found = language_mixture.with_languages(documents, model)
    return found.select("doc_id", _held_out(4, 2), "lang_pred", "score", F.to_json("languages").alias("languages"))


def op3_line_rules(spark: SparkSession, folder: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return line_rules.judged(table(spark, folder, "documents")).select(*columns)


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encoded(table(spark, folder, "documents"), public_vocabulary())


def op7_backoff_lm(spark: SparkSession, folder: str) -> DataFrame:
    return backoff_lm.with_scores(table(spark, folder, "documents"))


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_toxic_segments(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    lexicon = toxic_segments.fitted(documents, table(spark, folder, "labels").where(remainder(5) != 0))
    scored = toxic_segments.with_toxicity(documents, lexicon)
    return scored.select("doc_id", _held_out(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.to_json("passages").alias("passages"))


def op10_line_crf(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    chain = line_crf.fitted(documents, table(spark, folder, "labels").where(remainder(5) != 0))
    scored = line_crf.with_quality(documents, chain).select("row.doc_id", "score")
    return scored.select("doc_id", _held_out(5, 0), "score", (F.col("score") >= line_crf.REJECTED).cast("int").alias("predicted"))


def op11_best_positions(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.best_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judged(table(spark, folder, "pages"), url_rules.entries(spark))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_language_mixture": op2_language_mixture,
    "op3_line_rules": op3_line_rules,
    "op4_decontamination": op4_decontamination,
    "op5_simhash": op5_simhash,
    "op6_bpe": op6_bpe,
    "op7_backoff_lm": op7_backoff_lm,
    "op8_warc": op8_warc,
    "op9_toxic_segments": op9_toxic_segments,
    "op10_line_crf": op10_line_crf,
    "op11_best_positions": op11_best_positions,
    "op12_url_rules": op12_url_rules,
    "op13_whitening": op13_whitening,
}

SQL: dict[str, str] = {
    "op3_line_rules": line_rules.SQL,
    "op4_decontamination": decontamination.SQL,
    "op8_warc": warc.SQL,
    "op11_best_positions": ranked_search.SQL,
    "op12_url_rules": url_rules.SQL,
}
