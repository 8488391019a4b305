"""Rules on records, queries, answers: each row gets the list of rules it breaks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.fixed_values import (
    ANSWER_MODES,
    ANSWER_STATUSES,
    LARGEST_INTEGER,
    MAX_HISTORY,
    MAX_QUESTION_CHARS,
    MIN_QUESTION_CHARS,
    NATURES,
    RECORD_FIELDS,
    RECORD_LANGUAGE,
)
from quaestor.functions.records import official_url


def broken_rules(rules: dict[str, Column]) -> Column:
    """Names of the rules that do not hold; a rule whose value is null is broken."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    )


def record_rules(hosts: Iterable[str]) -> dict[str, Column]:
    return {
        "id": F.length("question_id") >= 1,
        "moncode": F.col("moncode").rlike(r"^\d+$"),
        "langue": F.col("langue") == RECORD_LANGUAGE,
        "titre": F.length("titre") >= 1,
        "question": F.length("question") >= 1,
        "date_reception": F.col("date_reception").isNotNull(),
        "url_source": official_url(F.col("url_source"), hosts).isNotNull(),
    }


def validated(records: DataFrame, hosts: Iterable[str]) -> DataFrame:
    """Adds ``violations``; a valid record has none."""
    return records.withColumn("violations", broken_rules(record_rules(hosts)))


def _field_holds(name: str, kind: str) -> Column:
    """Whether a field of the variant ``_fields`` is of its kind. A field that is missing has no type, a null has type VOID."""
    path, (base, _, other) = f"$.{name}", kind.partition(" or ")
    found = F.schema_of_variant(F.variant_get("_fields", path, "variant"))
    text = F.when(found == "STRING", F.try_variant_get("_fields", path, "string"))
    number = F.when(found.rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get("_fields", path, "double"))
    holds = {
        "text": text.isNotNull(),
        "non-empty text": text != "",
        "digits": text.rlike(r"^[0-9]+\z"),
        "language": text == RECORD_LANGUAGE,
        "integer": (number == F.floor(number)) & (F.abs(number) <= LARGEST_INTEGER),
        "date": text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(),
        "url": F.try_parse_url(text, F.lit("PROTOCOL")).isNotNull() & (~text.rlike("^(?i)https?:") | F.try_parse_url(text, F.lit("HOST")).isNotNull()),
    }[base]
    holds = F.coalesce(holds, F.lit(False))
    return holds | found.isNull() if other == "missing" else holds | F.coalesce(found == "VOID", F.lit(False)) if other == "null" else holds


def typed_fields(lines: DataFrame) -> DataFrame:
    """Adds ``violations`` to records as they were written (``line``: one JSON object): the fields of another type or content than they must have.

    A line that is no JSON object breaks all rules but those of fields that may be missing; a null line does too.
    """
    parsed = lines.withColumn("_fields", F.try_parse_json("line"))
    return parsed.withColumn("violations", broken_rules({name: _field_holds(name, kind) for name, kind in RECORD_FIELDS})).drop("_fields")


def repeated_keys(records: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return records.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def corpus_report(records: DataFrame, hosts: Iterable[str]) -> DataFrame:
    """(rule, violations) over a corpus: field rules, repeated ids and repeated natural keys."""
    rules = record_rules(hosts)
    counts = records.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    fields = counts.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules]))
    )
    ids = repeated_keys(records, "question_id").agg(F.lit("repeated id").alias("rule"), F.count("*").alias("violations"))
    natural = repeated_keys(records, "base", "moncode", "langue").agg(
        F.lit("repeated natural key").alias("rule"), F.count("*").alias("violations")
    )
    return fields.unionByName(ids).unionByName(natural)


def count_matches(envelope: DataFrame, records: DataFrame) -> DataFrame:
    """(declared, found, ok)."""
    found = records.agg(F.count("*").alias("n")).scalar()
    return envelope.select(
        F.col("nombre_elements").cast("bigint").alias("declared"), found.alias("found"), (F.col("nombre_elements") == found).alias("ok")
    )


def checked_queries(queries: DataFrame) -> DataFrame:
    """Trimmed queries with their violations; ``history`` holds earlier user questions."""
    cleaned = queries.withColumn("text", F.trim("text"))
    rules = {
        "length": F.length("text").between(MIN_QUESTION_CHARS, MAX_QUESTION_CHARS),
        "history": F.coalesce(F.size("history"), F.lit(0)) <= MAX_HISTORY,
        "history texts": F.forall(
            F.coalesce("history", F.array().cast("array<string>")),
            lambda h: F.length(F.trim(h)).between(1, MAX_QUESTION_CHARS),
        ),
    }
    return cleaned.withColumn("violations", broken_rules(rules))


def checked_responses(responses: DataFrame) -> DataFrame:
    """Adds ``violations`` of the response contract.

    ``responses``: mode, status, notice, request_id, paragraphs array<struct<text,
    sourceIds>>, sources array<struct<id, title, author, recipient, date, url, excerpts, nature>>.
    """

    def text(value: Column) -> Column:
        return value.isNotNull()

    rules = {
        "mode": F.col("mode").isin(*ANSWER_MODES),
        "status": F.col("status").isin(*ANSWER_STATUSES),
        "paragraphs": F.forall(
            "paragraphs", lambda p: text(p["text"]) & F.coalesce(F.forall(p["sourceIds"], text), F.lit(False))
        ),
        "source fields": F.forall(
            "sources", lambda s: text(s["id"]) & text(s["title"]) & text(s["author"]) & text(s["recipient"])
        ),
        "source url": F.forall("sources", lambda s: F.coalesce(F.startswith(s["url"], F.lit("https://")), F.lit(False))),
        "source excerpts": F.forall(
            "sources", lambda s: F.coalesce((F.size(s["excerpts"]) > 0) & F.forall(s["excerpts"], text), F.lit(False))
        ),
        "source nature": F.forall("sources", lambda s: F.coalesce(s["nature"].isin(*NATURES), F.lit(False))),
        "notice": F.col("notice").isNotNull(),
        "request id": F.col("request_id").isNotNull(),
    }
    return responses.withColumn("violations", broken_rules(rules))


def format_fingerprint(passages: DataFrame) -> DataFrame:
    """(passages, digest): one value that changes when any stored passage does, whatever the order of rows."""
    line = F.to_json(F.struct("passage_id", "section", "position", "content", "search_text"))
    digest = F.sha2(line, 256)
    part = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)")
    return passages.agg(F.count("*").alias("passages"), F.sum(part).cast("string").alias("digest"))
