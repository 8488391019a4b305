"""Ranks, fusion and top-k selection per query.

A query's candidates are never gathered in one task: every selection is a
``row_number() <= constant`` that Spark applies in each partition before the
shuffle (WindowGroupLimit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaestor.fixed_values import (
    DEFAULT_RESULTS,
    LINEAR_LEXICAL_WEIGHT,
    MAX_RESULTS,
    OCCURRENCE_WEIGHT,
    PASSAGES_PER_RECORD,
    RRF_OFFSET,
    SCORE_TIE_DECIMALS,
    SIMILARITY_THRESHOLD,
)
from quaestor.operators.sizing import small_side
from quaestor.session import materialised


def per_query():
    return W.partitionBy("query_id")


# Deepest rank that can matter to the fusion: a record outside the first ranks
# of both lists scores less than 2 / (RRF_OFFSET + depth), while the last kept
# record scores at least 1 / (RRF_OFFSET + MAX_RESULTS).
FUSION_DEPTH = RRF_OFFSET + 2 * MAX_RESULTS


def clamp_limit(limit: Column) -> Column:
    return F.greatest(F.lit(1), F.least(limit, F.lit(MAX_RESULTS)))


def tied(score: Column) -> Column:
    """Scores that differ only by rounding noise compare equal."""
    return F.round(score, SCORE_TIE_DECIMALS)


def top_lexical(scores: DataFrame) -> DataFrame:
    """(query_id, question_id, lexical, score, leader): best records of each query without vectors.

    The kept rows are a prefix of the ranking, so the rank among them is the
    rank among all records.
    """
    ranked = scores.where(F.col("lexical") > 0).withColumn("lexical", tied(F.col("lexical")))
    prefix = ranked.withColumn(
        "_row", F.row_number().over(per_query().orderBy(F.desc("lexical"), "question_id"))
    ).where(F.col("_row") <= MAX_RESULTS)
    rank = F.rank().over(per_query().orderBy(F.desc("lexical")))
    return prefix.withColumn("lexical_rank", rank).select(
        "query_id",
        "question_id",
        "lexical",
        (1.0 / (RRF_OFFSET + F.col("lexical_rank"))).alias("score"),
        (F.col("lexical_rank") == 1).alias("leader"),
    )


def _prefix(both: DataFrame, first: str, second: str, depth: int) -> DataFrame:
    """The first ``depth`` rows of a ranking with their rank in it: those before a row are all kept."""
    order = per_query().orderBy(F.desc_nulls_last(first), F.desc_nulls_last(second), "question_id")
    kept = both.where(F.col(first).isNotNull()).withColumn("_row", F.row_number().over(order)).where(
        F.col("_row") <= depth
    )
    return kept.withColumn(f"{first}_rank", F.rank().over(per_query().orderBy(F.desc(first)))).drop("_row")


def _deep_ranks(scores: DataFrame, candidates: DataFrame, score: str, n_queries: int) -> DataFrame:
    """(query_id, score, rank) of the candidates below the prefix of a ranking, among *all* scores of their query.

    Their scores cut the ranking of a query into at most a few dozen intervals;
    scores are counted per interval (partial counts first) and the counts are
    summed from the top.
    """
    deep = candidates.where(F.col(score).isNotNull() & F.col(f"{score}_rank").isNull())
    cuts = deep.groupBy("query_id").agg(F.array_sort(F.collect_set(score)).alias("_cuts"))
    cuts = small_side(cuts, n_queries, 16 * 2 * (FUSION_DEPTH + MAX_RESULTS))
    counts = (
        scores.join(cuts, "query_id")
        .where(F.col(score) > F.get("_cuts", 0))
        .select("query_id", F.size(F.filter("_cuts", lambda c: c < F.col(score))).alias("_above"))
        .groupBy("query_id", "_above")
        .agg(F.count("*").alias("_n"))
    )
    # Rows above the cut at index j (0-based, ascending) are those with more than j cuts below them.
    positions = cuts.select("query_id", F.posexplode("_cuts").alias("_j", score))
    return (
        positions.join(counts, (positions.query_id == counts.query_id) & (counts["_above"] > positions["_j"]), "left")
        .groupBy(positions.query_id, score)
        .agg((1 + F.coalesce(F.sum("_n"), F.lit(0))).alias("_rank"))
    )


def fuse(lexical: DataFrame, semantic: DataFrame, n_queries: int) -> DataFrame:
    """(query_id, question_id, lexical, semantic, lexical_rank, semantic_rank, score, leader): fused best records.

    The two rankings meet on (query, record). Only records among the first
    ``FUSION_DEPTH`` ranks of either list can be kept; ties are ordered by the
    other score, then by id, so that a large tied group is cut exactly.
    """
    lex = lexical.where(F.col("lexical") > 0).select("query_id", "question_id", tied(F.col("lexical")).alias("lexical"))
    sem = semantic.where(F.col("semantic") >= SIMILARITY_THRESHOLD).select(
        "query_id", "question_id", tied(F.col("semantic")).alias("semantic")
    )
    both = lex.join(sem, ["query_id", "question_id"], "full")
    depth = FUSION_DEPTH + MAX_RESULTS
    columns = ("lexical", "semantic", "lexical_rank", "semantic_rank")
    ranked = materialised(
        _prefix(both, "lexical", "semantic", depth)
        .unionByName(_prefix(both, "semantic", "lexical", depth), allowMissingColumns=True)
        .groupBy("query_id", "question_id")
        .agg(*[F.max(c).alias(c) for c in columns])
    )
    for scores, score in ((lex, "lexical"), (sem, "semantic")):
        ranks = _deep_ranks(scores, ranked, score, n_queries)
        ranked = ranked.join(ranks, ["query_id", score], "left").withColumn(
            f"{score}_rank", F.coalesce(f"{score}_rank", "_rank")
        ).drop("_rank")

    def share(rank: str) -> Column:
        return F.coalesce(1.0 / (RRF_OFFSET + F.col(rank)), F.lit(0.0))

    scored = ranked.withColumns(
        {
            "score": share("lexical_rank") + share("semantic_rank"),
            "leader": F.coalesce(F.col("lexical_rank") == 1, F.lit(False))
            | F.coalesce(F.col("semantic_rank") == 1, F.lit(False)),
        }
    )
    order = per_query().orderBy(F.desc("leader"), F.desc(F.round("score", 12)), "question_id")
    return scored.withColumn("_row", F.row_number().over(order)).where(F.col("_row") <= MAX_RESULTS).drop("_row")


def select_documents(best: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, question_id, score, document_rank): leaders first within the limit, then by score."""
    order = per_query().orderBy(F.desc("leader"), F.desc(F.round("score", 12)), "question_id")
    limited = (
        best.join(queries.select("query_id", clamp_limit(F.col("limit")).alias("_limit")), "query_id")
        .withColumn("_row", F.row_number().over(order))
        .where(F.col("_row") <= F.col("_limit"))
    )
    by_score = per_query().orderBy(F.desc(F.round("score", 12)), "question_id")
    return limited.select(
        "query_id", "question_id", "score", F.row_number().over(by_score).alias("document_rank"), "_limit"
    )


def best_passages(candidates: DataFrame) -> DataFrame:
    """The two best passages of each selected record: similarity, then occurrences, then position."""
    order = W.partitionBy("query_id", "question_id").orderBy(
        F.desc(tied(F.col("similarity"))), F.desc_nulls_last("occurrences"), "position"
    )
    return candidates.withColumn("passage_rank", F.row_number().over(order)).where(
        F.col("passage_rank") <= PASSAGES_PER_RECORD
    )


def interleave(rows: DataFrame) -> DataFrame:
    """Adds ``hit_rank``: both passages of the first record, first passages of the others, then second ones."""
    order = per_query().orderBy(
        F.when(F.col("document_rank") == 1, 0).otherwise(F.col("passage_rank")), "document_rank", "passage_rank"
    )
    return rows.withColumn("hit_rank", F.row_number().over(order)).where(F.col("hit_rank") <= F.col("_limit"))


def linear_ranking(passage_scores: DataFrame, limit: int = DEFAULT_RESULTS) -> DataFrame:
    """The earlier ranker: weighted occurrences plus similarity, two passages per record, best ``limit``.

    ``passage_scores``: query_id, question_id, passage_id, occurrences, similarity.
    """
    lexical = F.coalesce(F.col("occurrences"), F.lit(0)) * OCCURRENCE_WEIGHT
    semantic = F.coalesce(F.col("similarity"), F.lit(0.0))
    relevance = tied(lexical * LINEAR_LEXICAL_WEIGHT + semantic)
    eligible = passage_scores.where((lexical > 0) | (semantic >= SIMILARITY_THRESHOLD)).withColumn("relevance", relevance)
    per_record = W.partitionBy("query_id", "question_id").orderBy(F.desc("relevance"), "passage_id")
    kept = eligible.withColumn("_rank", F.row_number().over(per_record)).where(F.col("_rank") <= PASSAGES_PER_RECORD)
    best = per_query().orderBy(F.desc("relevance"), "passage_id")
    return (
        kept.withColumn("hit_rank", F.row_number().over(best))
        .where(F.col("hit_rank") <= max(1, min(limit, MAX_RESULTS)))
        .select("query_id", "hit_rank", "question_id", "passage_id", "relevance")
    )
