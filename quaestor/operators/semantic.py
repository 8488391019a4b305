"""Exact cosine search of many query vectors over many passage vectors.

``similar_passages`` finds all pairs from a threshold on. ``nearest_passages`` finds the best records of each query and leaves
out cells of vectors that cannot hold one: vectors are dealt to the nearest of some centroids, a cell knows the
widest angle of its vectors to the centroid, and by the triangle inequality of angles no vector of the cell is closer to
a query than the query's angle to the centroid less that width.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaestor.fixed_values import DEFAULT_RESULTS, SIMILARITY_THRESHOLD
from quaestor.operators.ranking import tied
from quaestor.operators.sizing import fits_broadcast
from quaestor.session import materialised

SIMILAR_SCHEMA = "query_id bigint, question_id string, passage_id string, similarity double"
# Rows of passage vectors multiplied at a time.
BLOCK_ROWS = 1024
# Size of the tiles the product is cut into when the queries cannot be broadcast: a task holds their pairs.
TILE_PASSAGES = 4_000
TILE_QUERIES = 1_000


def _matrix(vectors: pd.Series) -> np.ndarray:
    rows = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.full_like(rows, np.nan), where=length > 0)


def _pairs(passages: pd.DataFrame, ids: np.ndarray, queries: np.ndarray, threshold: float) -> Iterator[pd.DataFrame]:
    """Pairs of a block of passages and the queries at or above the threshold."""
    for start in range(0, len(passages), BLOCK_ROWS):
        block = passages.iloc[start : start + BLOCK_ROWS]
        similarity = _matrix(block["embedding"]) @ queries.T
        row, column = np.nonzero(similarity >= threshold)
        yield pd.DataFrame(
            {
                "query_id": ids[column],
                "question_id": block["question_id"].to_numpy()[row],
                "passage_id": block["passage_id"].to_numpy()[row],
                "similarity": similarity[row, column],
            }
        )


def _broadcast_product(vectors: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """Queries are sent to every task; passage vectors are read in place, without a shuffle."""
    local = queries.toPandas()
    shared = vectors.sparkSession.sparkContext.broadcast(
        (local["query_id"].to_numpy(), _matrix(local["qvec"])) if len(local) else None
    )

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if shared.value is None:
            return
        ids, matrix = shared.value
        for batch in batches:
            if len(batch):
                yield from _pairs(batch, ids, matrix, threshold)

    return vectors.mapInPandas(product, SIMILAR_SCHEMA)


def _tiled_product(
    vectors: DataFrame, queries: DataFrame, threshold: float, n_vectors: int, n_queries: int
) -> DataFrame:
    """Both sides are cut by hash into tiles of bounded size; each pair of tiles is one task's product."""
    rows = max(1, -(-n_vectors // TILE_PASSAGES))
    columns = max(1, -(-n_queries // TILE_QUERIES))

    def tile(column: str, count: int):
        return F.pmod(F.xxhash64(column), F.lit(count)).cast("int")

    left = vectors.withColumn("_row", tile("passage_id", rows)).withColumn(
        "_column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))
    )
    right = queries.withColumn("_column", tile("query_id", columns)).withColumn(
        "_row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))
    )

    def product(passages: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame(columns=["query_id", "question_id", "passage_id", "similarity"])
        if not len(passages) or not len(batch):
            return empty
        parts = list(_pairs(passages, batch["query_id"].to_numpy(), _matrix(batch["qvec"]), threshold))
        return pd.concat(parts) if parts else empty

    return left.groupBy("_row", "_column").cogroup(right.groupBy("_row", "_column")).applyInPandas(
        product, SIMILAR_SCHEMA
    )


def similar_passages(
    vectors: DataFrame,
    queries: DataFrame,
    n_queries: int,
    dimensions: int,
    threshold: float = SIMILARITY_THRESHOLD,
    budget: int | None = None,
) -> DataFrame:
    """(query_id, question_id, passage_id, similarity) at or above the threshold.

    ``vectors``: question_id, passage_id, embedding. ``queries``: query_id, qvec.
    Rows without a vector of the right size take no part. The queries are counted, whatever ``n_queries`` says,
    which decides how the product is spread: broadcast queries when they fit, tiles otherwise.
    """
    usable = vectors.where(F.size("embedding") == dimensions).select("question_id", "passage_id", "embedding")
    asked = queries.where(F.size("qvec") == dimensions).select(F.col("query_id").cast("bigint"), "qvec")
    n_queries = max(n_queries, asked.count())
    limit = {} if budget is None else {"budget": budget}
    if fits_broadcast(n_queries, 8 * dimensions + 16, **limit):
        return _broadcast_product(usable, asked, threshold)
    return _tiled_product(usable, asked, threshold, usable.count(), n_queries)


def semantic_scores(similar: DataFrame) -> DataFrame:
    """(query_id, question_id, semantic): best similarity per record."""
    return similar.groupBy("query_id", "question_id").agg(F.max("similarity").alias("semantic"))


def top_similar(similar: DataFrame, limit: int = DEFAULT_RESULTS) -> DataFrame:
    """(query_id, hit_rank, question_id, passage_id, similarity): best passage per record, best ``limit`` records."""
    best = similar.groupBy("query_id", "question_id").agg(
        F.max_by("passage_id", F.struct(tied(F.col("similarity")), F.col("passage_id"))).alias("passage_id"),
        tied(F.max("similarity")).alias("similarity"),
    )
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "question_id")
    return best.withColumn("hit_rank", F.row_number().over(order)).where(F.col("hit_rank") <= limit).select(
        "query_id", "hit_rank", "question_id", "passage_id", "similarity"
    )


# ---- the best records by cells ----

#: Centroids, vectors they are chosen from, rounds of moving them, cells of a query that are looked at before any is left out.
CELLS, SAMPLED_VECTORS, ROUNDS, FIRST_CELLS = 256, 1 << 14, 6, 2
#: Parts of a cell, so that a large one is no single task's.
CELL_PARTS = 16
#: What rounding can add to a similarity.
SLACK = 1e-9


def centroids(vectors: DataFrame, cells: int = CELLS) -> np.ndarray:
    """Unit centroids of a sample of at most ``SAMPLED_VECTORS`` vectors; the sample decides how well cells prune, not what is found."""
    n = vectors.count()
    share = min(1.0, SAMPLED_VECTORS / max(1, n))
    chosen = vectors.where(F.pmod(F.xxhash64(F.lit("cell"), "passage_id"), F.lit(1 << 20)) < int(share * (1 << 20))).select("embedding").toPandas()
    points = _matrix(chosen["embedding"]) if len(chosen) else np.zeros((0, 1))
    points = points[np.isfinite(points).all(axis=1)]
    if not len(points):
        return points
    rng = np.random.default_rng(3)
    centres = points[rng.choice(len(points), min(cells, max(1, int(np.sqrt(n)) * 2), len(points)), replace=False)]
    for _ in range(ROUNDS):
        nearest = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


def _angle(similarity: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(similarity, -1.0, 1.0))


def in_cells(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """All vectors with the cell of their nearest centroid and their angle to it; vectors of length zero are in none."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), BLOCK_ROWS):
                block = batch.iloc[start : start + BLOCK_ROWS]
                rows = _matrix(block["embedding"])
                fine = np.isfinite(rows).all(axis=1)
                found = rows[fine] @ shared.value.T
                cell = found.argmax(axis=1) if len(found) else np.zeros(0, int)
                yield block[fine].assign(cell=cell.astype(np.int32), angle=_angle(found[np.arange(len(cell)), cell]))

    kind = vectors.schema["embedding"].dataType.simpleString()
    schema = f"question_id string, passage_id string, embedding {kind}, cell int, angle double"
    return vectors.select("question_id", "passage_id", "embedding").mapInPandas(deal, schema)


def _product_in_cells(dealt: DataFrame, ids: np.ndarray, matrix: np.ndarray, least: np.ndarray) -> DataFrame:
    """Pairs of each cell and the queries that look at it, from ``least`` (queries x cells, infinite: not looked at) on."""
    shared = dealt.sparkSession.sparkContext.broadcast((ids, matrix, least))
    looked_at = [int(c) for c in np.flatnonzero(np.isfinite(least).any(axis=0))]

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix, least = shared.value
        for batch in batches:
            for cell, block in batch.groupby("cell"):
                asked = np.flatnonzero(np.isfinite(least[:, cell]))
                for start in range(0, len(block) if len(asked) else 0, BLOCK_ROWS):
                    part = block.iloc[start : start + BLOCK_ROWS]
                    similarity = _matrix(part["embedding"]) @ matrix[asked].T
                    row, column = np.nonzero(similarity >= least[asked, cell])
                    yield pd.DataFrame(
                        {
                            "query_id": ids[asked[column]],
                            "question_id": part["question_id"].to_numpy()[row],
                            "passage_id": part["passage_id"].to_numpy()[row],
                            "similarity": similarity[row, column],
                        }
                    )

    return dealt.where(F.col("cell").isin(looked_at)).drop("angle").mapInPandas(product, SIMILAR_SCHEMA)


def nearest_passages(
    vectors: DataFrame,
    queries: DataFrame,
    n_queries: int,
    dimensions: int,
    limit: int = DEFAULT_RESULTS,
    threshold: float = SIMILARITY_THRESHOLD,
    cells: int = CELLS,
) -> tuple[DataFrame, float]:
    """``top_similar`` of the similar passages, and the share of all pairs of a query and a vector that were compared.

    Each query looks at its ``FIRST_CELLS`` likeliest cells, then at those that can still hold a record as similar as its last
    one so far. Beyond the size queries may be sent at, all similar passages are found in tiles.
    """
    usable = vectors.where(F.size("embedding") == dimensions).select("question_id", "passage_id", "embedding")
    asked = queries.where(F.size("qvec") == dimensions).select(F.col("query_id").cast("bigint"), "qvec")
    if not fits_broadcast(max(n_queries, asked.count()), 8 * (dimensions + 2 * cells) + 16):
        return top_similar(similar_passages(vectors, queries, n_queries, dimensions, threshold), limit), 1.0
    local = asked.toPandas()
    centres = centroids(usable, cells)
    if not len(local) or not len(centres):
        return top_similar(usable.select(F.lit(0).cast("bigint").alias("query_id"), "question_id", "passage_id", F.lit(0.0).alias("similarity")).limit(0), limit), 0.0
    ids, matrix = local["query_id"].to_numpy(), _matrix(local["qvec"])
    dealt = materialised(in_cells(usable, centres).repartition("cell", F.pmod(F.xxhash64("passage_id"), F.lit(CELL_PARTS))))
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("width")).toPandas()  # a row a cell
    n, width = np.zeros(len(centres)), np.zeros(len(centres))
    n[sizes["cell"]], width[sizes["cell"]] = sizes["n"], sizes["width"]
    similarity = np.where(np.isfinite(matrix @ centres.T), matrix @ centres.T, -1.0)
    bound = np.where(n > 0, np.cos(np.maximum(0.0, _angle(similarity) - width)) + SLACK, -np.inf)
    first = np.argsort(-bound, axis=1)[:, :FIRST_CELLS]
    least = np.full(bound.shape, np.inf)
    np.put_along_axis(least, first, threshold, axis=1)
    least[bound < threshold] = np.inf
    found = materialised(top_similar(_product_in_cells(dealt, ids, matrix, least), limit))
    last = np.full(len(ids), threshold)
    for row in found.where(F.col("hit_rank") == limit).select("query_id", "similarity").collect():  # one a query
        last[ids == row.query_id] = max(threshold, row.similarity - SLACK)
    rest = np.where((bound >= last[:, None]) & ~np.isfinite(least), last[:, None], np.inf)
    more = _product_in_cells(dealt, ids, matrix, rest)
    best = top_similar(found.drop("hit_rank").unionByName(more), limit)
    compared = (np.isfinite(least) * n).sum() + (np.isfinite(rest) * n).sum()
    return best, float(compared / max(1.0, len(ids) * n.sum()))
