"""Exact rank fusion of two score lists without a row for each query and record.

A list is a scorer: from a batch of records it makes their scores for a block of queries, which are sent to the tasks. The
scores live in the task only. What leaves it is bounded by the queries, not by the records:

1. of each list the first ``FUSION_DEPTH + MAX_RESULTS`` records of a query in each partition; a record outside these
   in both lists scores less than the last one kept;
2. where a list's cut falls into a large tie, those of the tied records that the other list ranks best;
3. the scores of these candidates in both lists;
4. for candidates deep in a list, how many records score more: counts per interval between the candidates' scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.fixed_values import MAX_RESULTS, RRF_OFFSET, SCORE_TIE_DECIMALS, SIMILARITY_THRESHOLD, TITLE_WEIGHT
from quaestor.operators.ranking import FUSION_DEPTH, per_query
from quaestor.operators.sizing import small_side
from quaestor.session import materialised

DEPTH = FUSION_DEPTH + MAX_RESULTS
#: Lowest rank of a tied group whose records can still win with a deep rank in the other list.
TIE_RANK = 1 + int(1 / (1 / (RRF_OFFSET + MAX_RESULTS) - 1 / (RRF_OFFSET + DEPTH))) - RRF_OFFSET
#: Queries scored at once, records of a batch scored at once.
QUERY_BLOCK, RECORD_BLOCK = 512, 1024

Scores = Iterator[tuple[pa.Array, np.ndarray]]


class ScoreList(NamedTuple):
    """Rows, and what turns their batches into (question_id, scores): a column for each query, zero for no member of the list."""

    rows: DataFrame
    scores: Callable[[Iterator[pa.RecordBatch]], Scores]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, len(batch), RECORD_BLOCK):
            yield batch.slice(low, RECORD_BLOCK)


def lexical_list(matched: DataFrame, weights: DataFrame, ids: np.ndarray) -> ScoreList:
    """Scores of (question_id, entries) by the weights (term, query_id, weight) of the queries ``ids``."""
    rows = weights.where(F.col("query_id").isin(ids.tolist())).toPandas()  # at most the terms of a block of queries
    names = sorted(set(rows["term"]))
    term = np.searchsorted(names, rows["term"]) if names else np.zeros(0, np.int64)
    order = np.argsort(term, kind="stable")
    asked = np.searchsorted(ids, rows["query_id"].to_numpy())[order]
    weight = rows["weight"].to_numpy(np.float64)[order]
    starts = np.searchsorted(term[order], np.arange(len(names) + 1))
    shared = matched.sparkSession.sparkContext.broadcast((pa.array(names, pa.string()), asked, weight, starts))
    width = len(ids)

    def scores(batches: Iterator[pa.RecordBatch]) -> Scores:
        names, asked, weight, starts = shared.value
        for batch in _blocks(batches):
            entries = batch.column("entries")
            flat = entries.flatten()
            record = np.repeat(np.arange(len(batch)), pc.list_value_length(entries).fill_null(0).to_numpy(zero_copy_only=False))
            at = pc.index_in(flat.field("term"), names).fill_null(-1).to_numpy(zero_copy_only=False)
            factor = np.where(flat.field("in_title").to_numpy(zero_copy_only=False), TITLE_WEIGHT, 1)
            known = at >= 0
            at, record, factor = at[known], record[known], factor[known]
            n = starts[at + 1] - starts[at]
            pair = np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            cell = np.repeat(record, n) * width + asked[pair]
            total = np.bincount(cell, weight[pair] * np.repeat(factor, n), len(batch) * width).reshape(len(batch), width)
            yield batch.column("question_id"), np.round(total, SCORE_TIE_DECIMALS)

    return ScoreList(matched, scores)


def _unit(vectors: list) -> np.ndarray:
    rows = np.array(vectors, dtype=np.float64)
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.full_like(rows, np.nan), where=length > 0)


def by_record(vectors: DataFrame, dimensions: int) -> DataFrame:
    """(question_id, embedding) of the usable vectors, those of a record one after the other in one task."""
    usable = vectors.where(F.size("embedding") == dimensions).select("question_id", "embedding")
    # By a hash of the id: a shuffle by the id itself would be taken for that of a join before it, which may become a broadcast.
    return materialised(usable.repartition(F.xxhash64("question_id")).sortWithinPartitions("question_id"))


def semantic_list(vectors: DataFrame, queries: DataFrame, ids: np.ndarray) -> ScoreList:
    """Best similarity of each record of ``by_record`` vectors, where it reaches the threshold."""
    local = queries.where(F.col("query_id").isin(ids.tolist())).toPandas()
    width = len(ids)
    matrix = np.full((width, len(local["qvec"].iloc[0]) if len(local) else 1), np.nan)
    if len(local):
        matrix[np.searchsorted(ids, local["query_id"].to_numpy())] = _unit([np.asarray(v) for v in local["qvec"]])
    shared = vectors.sparkSession.sparkContext.broadcast(matrix if len(local) else None)

    def scores(batches: Iterator[pa.RecordBatch]) -> Scores:
        if shared.value is None:
            return
        held: tuple[pa.Array, np.ndarray] | None = None  # the last record, which the next batch may go on with
        for batch in _blocks(batches):
            ids_here = batch.column("question_id")
            found = _unit([np.asarray(v) for v in batch.column("embedding").to_pylist()]) @ shared.value.T
            found = np.nan_to_num(found, nan=-1.0)
            if held is not None:
                ids_here, found = pa.concat_arrays([held[0], ids_here]), np.concatenate([held[1], found])
            names = ids_here.to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
            best = np.maximum.reduceat(found, first, axis=0)
            of_record = ids_here.take(pa.array(first))
            held = (of_record.slice(len(first) - 1), best[-1:])
            if len(first) > 1:
                yield of_record.slice(0, len(first) - 1), _members(best[:-1])
        if held is not None:
            yield held[0], _members(held[1])

    return ScoreList(vectors, scores)


def _members(similarity: np.ndarray) -> np.ndarray:
    return np.where(similarity >= SIMILARITY_THRESHOLD, np.round(similarity, SCORE_TIE_DECIMALS), 0.0)


# ---- passes over a list ----


def _told(query: np.ndarray, record: pa.Array, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), record.cast(pa.string()), pa.array(score, pa.float64())], names=["query_id", "question_id", "score"])


PAIRS = "query_id bigint, question_id string, score double"


def first_ranks(scored: ScoreList, ids: np.ndarray, depth: int) -> DataFrame:
    """(query_id, question_id, score, rank): the first ``depth`` records of each query by score, then id."""

    batch_scores = scored.scores  # the tasks get the function, not the rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.zeros(len(ids))
        query, record, score = np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0)

        def cut() -> None:
            nonlocal query, record, score
            names = record.to_numpy(zero_copy_only=False).astype(str)
            order = np.lexsort((names, -score, query))
            place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
            order = order[place < depth]
            query, record, score = query[order], record.take(pa.array(order)), score[order]
            full = np.flatnonzero(place[place < depth] == depth - 1)
            least[query[full]] = score[full]

        for found, scores in batch_scores(batches):
            row, column = np.nonzero((scores > 0) & (scores >= least))
            query, score = np.concatenate([query, column]), np.concatenate([score, scores[row, column]])
            record = pa.concat_arrays([record, found.cast(pa.string()).take(pa.array(row))])
            if len(query) > 4 * depth * len(ids):
                cut()
        cut()
        if len(query):
            yield _told(ids[query], record, score)

    order = per_query().orderBy(F.desc("score"), "question_id")
    ranked = scored.rows.mapInArrow(run, PAIRS).withColumn("_row", F.row_number().over(order)).where(F.col("_row") <= depth)
    return materialised(ranked.withColumn("rank", F.rank().over(per_query().orderBy(F.desc("score")))))


def scores_of(scored: ScoreList, ids: np.ndarray, pairs: DataFrame) -> DataFrame:
    """(query_id, question_id, score) of the given pairs that are in the list; their number is bounded by the queries."""
    wanted = pairs.select("query_id", "question_id").distinct().toPandas().sort_values("question_id")
    names, starts = np.unique(wanted["question_id"].to_numpy(str), return_index=True)
    column = np.searchsorted(ids, wanted["query_id"].to_numpy())
    shared = scored.rows.sparkSession.sparkContext.broadcast((pa.array(names, pa.string()), np.append(starts, len(column)), column))

    batch_scores = scored.scores  # the tasks get the function, not the rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, starts, column = shared.value
        for found, scores in batch_scores(batches):
            at = pc.index_in(found.cast(pa.string()), names).fill_null(-1).to_numpy(zero_copy_only=False)
            row = np.flatnonzero(at >= 0)
            n = starts[at[row] + 1] - starts[at[row]]
            asked = column[np.repeat(starts[at[row]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            row = np.repeat(row, n)
            kept = scores[row, asked] > 0
            if kept.any():
                yield _told(ids[asked[kept]], found.take(pa.array(row[kept])), scores[row[kept], asked[kept]])

    return scored.rows.mapInArrow(run, PAIRS)


def _tied(scored: ScoreList, ids: np.ndarray, first: DataFrame) -> DataFrame | None:
    """(query_id, question_id) of all records that tie with the last of a query's first ranks, where such a tie can matter."""
    rows = first.where((F.col("_row") == DEPTH) & (F.col("rank") <= TIE_RANK)).select("query_id", "score").collect()  # one a query at most
    if not rows:
        return None
    value = np.full(len(ids), -1.0)
    for r in rows:
        value[np.searchsorted(ids, r.query_id)] = r.score

    batch_scores = scored.scores  # the tasks get the function, not the rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, scores in batch_scores(batches):
            row, column = np.nonzero(scores == value)
            if len(row):
                yield _told(ids[column], found.take(pa.array(row)), scores[row, column])

    return scored.rows.mapInArrow(run, PAIRS).select("query_id", "question_id")


def _listed(scored: ScoreList, ids: np.ndarray, queries: DataFrame) -> DataFrame:
    """All pairs of a list for some of the queries."""
    chosen = np.isin(ids, [r.query_id for r in queries.select("query_id").distinct().collect()])

    batch_scores = scored.scores  # the tasks get the function, not the rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, scores in batch_scores(batches):
            row, column = np.nonzero((scores > 0) & chosen)
            if len(row):
                yield _told(ids[column], found.take(pa.array(row)), scores[row, column])

    return scored.rows.mapInArrow(run, PAIRS)


def _best_of_tie(tied: DataFrame | None, other: ScoreList, ids: np.ndarray, first: DataFrame) -> DataFrame:
    """Of tied records those that the other list ranks best."""
    if tied is None:
        return first.select("query_id", "question_id").limit(0)
    both = _listed(other, ids, first.where(F.col("_row") == DEPTH)).join(tied, ["query_id", "question_id"])
    place = F.row_number().over(per_query().orderBy(F.desc("score"), "question_id"))
    return both.withColumn("_place", place).where(F.col("_place") <= MAX_RESULTS).select("query_id", "question_id")


def deep_ranks(scored: ScoreList, ids: np.ndarray, deep: DataFrame) -> DataFrame:
    """(query_id, score, deep_rank) for scores of candidates: one more than the records of the whole list that score more."""
    rows = deep.groupBy("query_id").agg(F.array_sort(F.collect_set("score")).alias("cuts")).collect()  # a few dozen scores a query
    cuts = {int(np.searchsorted(ids, r.query_id)): np.array(r.cuts) for r in rows}

    batch_scores = scored.scores  # the tasks get the function, not the rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = {q: np.zeros(len(x), np.int64) for q, x in cuts.items()}
        for _, scores in batch_scores(batches):
            for q, limits in cuts.items():
                mine = scores[:, q]
                below = np.searchsorted(limits, mine[mine > limits[0]], "left")
                # A score with j cuts below it is above the first j cuts.
                above[q] += np.bincount(below, minlength=len(limits) + 1)[::-1].cumsum()[::-1][1:]
        for q, n in above.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[q]] * len(n), pa.int64()), pa.array(cuts[q]), pa.array(n)], names=["query_id", "score", "n"]
            )

    if not cuts:
        return deep.select("query_id", "score").limit(0).withColumn("deep_rank", F.lit(0).cast("long"))
    counts = scored.rows.mapInArrow(run, "query_id bigint, score double, n bigint")
    return counts.groupBy("query_id", "score").agg((1 + F.sum("n")).alias("deep_rank"))


def _ranked(scored: ScoreList, ids: np.ndarray, first: DataFrame, candidates: DataFrame, name: str) -> DataFrame:
    """(query_id, question_id, name, name_rank) of the candidates in a list."""
    found = materialised(scores_of(scored, ids, candidates))
    rank_of = first.select("query_id", "score", "rank").distinct()
    near = found.join(rank_of, ["query_id", "score"], "left")
    ranks = deep_ranks(scored, ids, near.where(F.col("rank").isNull()))
    both = near.join(ranks, ["query_id", "score"], "left")
    return both.select("query_id", "question_id", F.col("score").alias(name), F.coalesce("rank", "deep_rank").cast("long").alias(f"{name}_rank"))


def fused_block(lexical: ScoreList, semantic: ScoreList, ids: np.ndarray) -> DataFrame:
    """The fused best records of a block of queries, as ``fused`` has them."""
    firsts = [first_ranks(x, ids, DEPTH) for x in (lexical, semantic)]
    ties = [_best_of_tie(_tied(one, ids, first), other, ids, first) for one, other, first in ((lexical, semantic, firsts[0]), (semantic, lexical, firsts[1]))]
    pairs = [x.select("query_id", "question_id") for x in (*firsts, *ties)]
    candidates = materialised(pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).unionByName(pairs[3]).distinct())
    lex = _ranked(lexical, ids, firsts[0], candidates, "lexical")
    sem = _ranked(semantic, ids, firsts[1], candidates, "semantic")
    rows = candidates.join(lex, ["query_id", "question_id"], "left").join(sem, ["query_id", "question_id"], "left")

    def share(rank: str):
        return F.coalesce(1.0 / (RRF_OFFSET + F.col(rank)), F.lit(0.0))

    def leads(rank: str):
        return F.coalesce(F.col(rank) == 1, F.lit(False))

    scored = rows.withColumns({"score": share("lexical_rank") + share("semantic_rank"), "leader": leads("lexical_rank") | leads("semantic_rank")})
    order = per_query().orderBy(F.desc("leader"), F.desc(F.round("score", 12)), "question_id")
    return scored.withColumn("_row", F.row_number().over(order)).where(F.col("_row") <= MAX_RESULTS).drop("_row")


def fused(matched: DataFrame, weights: DataFrame, vectors: DataFrame, query_vectors: DataFrame, dimensions: int) -> DataFrame:
    """(query_id, question_id, lexical, semantic, lexical_rank, semantic_rank, score, leader): fused best records of each query.

    ``matched``: question_id, entries; ``weights``: term, query_id, weight; ``vectors``: question_id, passage_id, embedding;
    ``query_vectors``: query_id, qvec. Queries go in blocks.
    """
    asked = query_vectors.where(F.size("qvec") == dimensions).select(F.col("query_id").cast("bigint"), "qvec")
    known = weights.select(F.col("query_id").cast("bigint")).union(asked.select("query_id")).distinct()
    blocks = max(1, -(-known.count() // (QUERY_BLOCK // 2)))
    stored_vectors, out = by_record(vectors, dimensions), None
    for block in range(blocks):
        chosen = known.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()
        ids = np.array(sorted(r.query_id for r in chosen), np.int64)
        if len(ids):
            rows = fused_block(lexical_list(matched, weights, ids), semantic_list(stored_vectors, asked, ids), ids)
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        schema = "query_id bigint, question_id string, lexical double, semantic double, lexical_rank bigint, semantic_rank bigint, score double, leader boolean"
        return matched.sparkSession.createDataFrame([], schema)
    return out
