"""Records to passages, and passages to weighted index words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.fixed_values import PASSAGE_CHARS
from quaestor.functions.records import search_text
from quaestor.functions.text import index_words, split_passages


def passages(records: DataFrame, *keep: str, max_chars: int = PASSAGE_CHARS) -> DataFrame:
    """One row per passage: question section first, 0-based position within the section.

    ``keep`` names record columns to carry along. Narrow: no shuffle.
    """
    sections = F.array(
        F.struct(F.lit("question").alias("section"), F.col("question").alias("body")),
        F.struct(F.lit("reponse").alias("section"), F.col("reponse").alias("body")),
    )
    by_section = records.select("*", F.inline(sections))
    # The outer form, then a filter on its output: an inner explode would split every text twice.
    parts = by_section.select(
        "*", F.posexplode_outer(split_passages(F.col("body"), max_chars)).alias("position", "content")
    ).where(F.col("content").isNotNull())
    return parts.select(
        F.concat_ws(":", "question_id", "section", F.col("position").cast("string")).alias("passage_id"),
        "question_id",
        "section",
        "position",
        "content",
        search_text(F.col("titre"), F.col("auteur"), F.col("destinataire"), F.col("section"), F.col("content")).alias(
            "search_text"
        ),
        *keep,
    )


def weighted_words(passage_table: DataFrame) -> DataFrame:
    """(passage_id, word, tf, in_title): words of the first line of the search text weigh as title."""
    first = F.substring_index("search_text", "\n", 1)
    prepared = passage_table.select(
        "passage_id", index_words(first).alias("_title"), index_words(F.col("search_text")).alias("_words")
    )
    return (
        prepared.select("passage_id", "_title", F.explode_outer("_words").alias("word"))
        .where(F.col("word").isNotNull())
        .select("passage_id", "word", F.array_contains("_title", F.col("word")).alias("in_title"))
        .groupBy("passage_id", "word")
        .agg(F.count("*").alias("tf"), F.max("in_title").alias("in_title"))
    )
