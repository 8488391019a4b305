"""Whitening of embedding vectors by principal components that FEAST contour integration finds.

Spark reduces the vectors to a covariance matrix of dimension x dimension, which is bounded by the vectors' length
(``LARGEST_DIMENSION``) and not by their number. Inertia counts (the signs of the pivots of a symmetric
factorisation) cut the spectrum into intervals of known numbers of eigenvalues; each interval is one row of a DataFrame and
one task's work: quadrature over a circle around the interval of solutions of complex shifted systems projects a block
of vectors onto the interval's components, Rayleigh-Ritz extracts them, and this repeats until the residuals vanish and
as many are found as the counts say. A block that doesn't converge is widened, in the end to the whole space.

Sums and deviations are exact integers. Sums over tasks meet in two steps, each of one dimension's row of numbers.

Rows: a vector that is null, or holds null or non-finite entries, or an entry beyond ``LARGEST_ENTRY`` (floor(64*c) is
no long then), is dropped. Vectors have the table's commonest length (of several the longest); others lack entries or have
no component and are dropped too. Repeated rows and rows without an id count each. Components whose eigenvalue is zero but for rounding
are no components: equal vectors, or a single one, have no rows. A deviation beyond 63 bits is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
LARGEST_DIMENSION = 4096
LARGEST_ENTRY = 2.0**55
#: Vectors that are multiplied or put out at once.
BLOCK_ROWS = 1024
#: Eigenvalues an interval may hold, and the largest ratio of its ends, unless equal eigenvalues stand in the way.
INTERVAL_EIGENVALUES, INTERVAL_RATIO = 8, 4.0
#: Quadrature points on the upper half circle, rounds before the block is widened, accepted residual in units of the largest eigenvalue.
NODES, ROUNDS, RESIDUAL = 8, 30, 1e-13
#: Groups of tasks whose sums meet before all do.
MERGE_GROUPS = 64


class Whitening(NamedTuple):
    """What a vector is whitened with: count, exact sums, components as columns, eigenvalues and the trace."""

    n: int
    sums: list[int]
    largest: int
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


# ---- vectors ----


def usable(batch: pa.RecordBatch, column: str, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows remain, and their vectors as integers."""
    vectors = batch.column(column)
    right = pc.fill_null(pc.equal(pc.list_value_length(vectors), dimension), False)
    rows = np.flatnonzero(right.to_numpy(zero_copy_only=False))
    entries = pc.cast(vectors.filter(right).flatten(), pa.float64()).fill_null(float("nan"))
    entries = entries.to_numpy(zero_copy_only=False).reshape(len(rows), dimension)
    fine = (np.abs(entries) < LARGEST_ENTRY).all(axis=1)
    return rows[fine], np.floor(SCALE * entries[fine]).astype(np.int64) + SHIFT


def _total(x: np.ndarray, largest: int) -> list[int]:
    return [int(v) for v in (x.sum(axis=0) if largest * max(1, len(x)) < 1 << 62 else x.astype(object).sum(axis=0) if len(x) else np.zeros(x.shape[1], int))]


def deviations(x: np.ndarray, n: int, sums: list[int], largest: int) -> np.ndarray:
    """n*x - S, exactly."""
    if n * largest < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squared(exact: np.ndarray) -> list[int | None]:
    """Sums of squares of the rows, exactly; null beyond 63 bits."""
    if exact.dtype == np.int64 and (not exact.size or int(np.abs(exact).max()) ** 2 * exact.shape[1] < 1 << 63):
        return (exact * exact).sum(axis=1).tolist()
    found = [sum(int(v) ** 2 for v in row) for row in exact]
    return [x if x < 1 << 63 else None for x in found]


# ---- sums over tasks ----


def _sums(batches: Iterator[pa.RecordBatch], column: str, dimension: int) -> Iterator[pa.RecordBatch]:
    n, totals, largest = 0, [0] * dimension, 0
    for batch in batches:
        for low in range(0, len(batch), BLOCK_ROWS):
            _, x = usable(batch.slice(low, BLOCK_ROWS), column, dimension)
            top = int(np.abs(x).max()) if x.size else 0
            n, largest = n + len(x), max(largest, top)
            totals = [a + b for a, b in zip(totals, _total(x, top), strict=True)]
    if n:
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dimension), pa.int32()), pa.array([n] * dimension), pa.array([Decimal(v) for v in totals], pa.decimal128(38, 0)), pa.array([largest] * dimension)],
            names=["dimension", "n", "total", "largest"],
        )


def _rows_of(matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i, row in enumerate(matrix):
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([row.tolist()], pa.list_(pa.float64()))], names=["row", "numbers"])


def _added(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        numbers = batch.column("numbers").flatten().to_numpy().reshape(len(batch), -1).sum(axis=0)
        total = numbers if total is None else total + numbers
    yield pa.RecordBatch.from_arrays([pa.array([keys[0].as_py()], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["row", "numbers"])


def summed(parts: DataFrame) -> np.ndarray:
    """The sum of the matrices that the tasks put out row by row (row, numbers)."""
    schema = "row int, numbers array<double>"
    for keys in (["row", "part"], ["row"]):
        if "part" in keys:
            parts = parts.withColumn("part", F.spark_partition_id() % MERGE_GROUPS)
        parts = parts.groupBy(*keys).applyInArrow(_added, schema)
    rows = parts.orderBy("row").collect()  # as many as the matrix has rows
    return np.array([r.numbers for r in rows])


def _products(batches: Iterator[pa.RecordBatch], vectors: Callable[[pa.RecordBatch], np.ndarray], width: int) -> Iterator[pa.RecordBatch]:
    """Sums of products of each two entries, and of the entries themselves in the last row."""
    total, seen = np.zeros((width + 1, width)), False
    for batch in batches:
        for low in range(0, len(batch), BLOCK_ROWS):
            z = vectors(batch.slice(low, BLOCK_ROWS))
            if len(z):
                total[:-1] += z.T @ z
                total[-1] += z.sum(axis=0)
                seen = True
    if seen:
        yield from _rows_of(total)


def _covariance(vectors: DataFrame, of_batch: Callable[[pa.RecordBatch], np.ndarray], width: int, n: int) -> np.ndarray:
    found = summed(vectors.mapInArrow(lambda batches: _products(batches, of_batch, width), "row int, numbers array<double>"))
    mean = found[-1] / n
    out = found[:-1] / n - np.outer(mean, mean)  # the vectors were centred, so the mean is rounding only
    return (out + out.T) / 2


# ---- components ----


def eigenvalues_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues exceed ``shift``, by the signs of the pivots of a symmetric factorisation (Bunch and Kaufman)."""
    a = matrix - shift * np.eye(len(matrix))
    bound, above = (1 + np.sqrt(17)) / 8, 0
    while len(a):
        below = np.abs(a[1:, 0])
        size, pair = 1, below.max() if len(below) else 0.0
        if pair > 0 and abs(a[0, 0]) < bound * pair:
            r = 1 + int(below.argmax())
            other = np.abs(np.delete(a[r], r)).max()
            if abs(a[0, 0]) * other < bound * pair * pair:
                swap = 0 if abs(a[r, r]) >= bound * other else 1
                size = 1 + swap
                a[[swap, r]] = a[[r, swap]]
                a[:, [swap, r]] = a[:, [r, swap]]
        if size == 1:
            above += bool(a[0, 0] > 0)
            a = a[1:, 1:] - (np.outer(a[1:, 0], a[0, 1:]) / a[0, 0] if a[0, 0] else 0)
        else:
            above += 1  # such a pair of pivots has one sign each
            a = a[2:, 2:] - a[2:, :2] @ np.linalg.solve(a[:2, :2], a[:2, 2:])
        a = (a + a.T) / 2
    return above


def intervals(matrix: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """(low, high, number of eigenvalues) that hold the ``wanted`` largest eigenvalues above zero, from the largest down."""
    top = float(np.abs(matrix).sum(axis=1).max()) * (1 + 1e-9)
    zero = top * len(matrix) * np.finfo(float).eps * 4
    out, found = [], 0
    stack = [(zero, top, eigenvalues_above(matrix, zero), 0)] if top > 0 else []
    while stack and found < wanted:
        low, high, above_low, above_high = stack.pop()
        count = above_low - above_high
        if count <= 0:
            continue
        if high > low * (1 + 1e-10) and (count > INTERVAL_EIGENVALUES or high > low * INTERVAL_RATIO):
            middle = float(np.sqrt(low * high))
            above = eigenvalues_above(matrix, middle)
            stack += [(low, middle, above_low, above), (middle, high, above, above_high)]
        else:
            out.append((low, high, count))
            found += count
    return out


def _orthonormal(block: np.ndarray) -> np.ndarray:
    return np.linalg.qr(block)[0]


def projected(matrix: np.ndarray, block: np.ndarray, low: float, high: float) -> np.ndarray:
    """The block's share in the components between ``low`` and ``high``, by Gauss quadrature over a circle."""
    centre, radius = (low + high) / 2, max((high - low) / 2, np.finfo(float).eps * high * 8)
    points, weights = np.polynomial.legendre.leggauss(NODES)
    out = np.zeros_like(block)
    for point, weight in zip(points, weights, strict=True):
        turn = np.exp(0.5j * np.pi * (1 - point))
        shifted = (centre + radius * turn) * np.eye(len(matrix)) - matrix
        out += 0.5 * weight * (radius * turn * np.linalg.solve(shifted, block.astype(complex))).real
    return out


def components_in(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues in the interval and their vectors as columns."""
    size, rng = len(matrix), np.random.default_rng(7)
    scale = float(np.abs(matrix).sum(axis=1).max())
    width = min(size, max(count + 4, count * 3 // 2))
    while True:
        block = _orthonormal(rng.standard_normal((size, width)))
        for _ in range(ROUNDS):
            if width < size:
                block = _orthonormal(projected(matrix, block, low, high))
            values, turned = np.linalg.eigh(block.T @ matrix @ block)
            block = block @ turned
            inside = np.argsort(np.abs(values - (low + high) / 2))[:count]
            rest = matrix @ block[:, inside] - block[:, inside] * values[inside]
            if width == size or np.abs(rest).max() <= RESIDUAL * scale:
                break
        within = (values[inside] > low - RESIDUAL * scale) & (values[inside] < high + RESIDUAL * scale)
        if width == size or (np.abs(rest).max() <= RESIDUAL * scale and within.all()):
            return values[inside], block[:, inside]
        width = min(size, 2 * width)


def _solved(batches: Iterator[pa.RecordBatch], matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            values, vectors = components_in(matrix, row["low"], row["high"], row["count"])
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(vectors.T.tolist(), pa.list_(pa.float64()))], names=["value", "vector"])


def principal(spark, matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues above zero, falling, and their unit vectors as columns; all if there are fewer."""
    parts = intervals(matrix, wanted)
    if not parts:
        return np.zeros(0), np.zeros((len(matrix), 0))
    shared = spark.sparkContext.broadcast(matrix)
    asked = spark.createDataFrame([(float(a), float(b), int(n)) for a, b, n in parts], "low double, high double, count long").repartition(len(parts))
    rows = asked.mapInArrow(lambda batches: _solved(batches, shared.value), "value double, vector array<double>").collect()
    expected = sum(n for _, _, n in parts)
    if len(rows) != expected:
        raise ArithmeticError(f"{len(rows)} components found, {expected} counted")
    block = _orthonormal(np.array([r.vector for r in rows]).T)  # neighbours in different intervals
    values, turned = np.linalg.eigh(block.T @ matrix @ block)
    values, block = values[::-1][:wanted], (block @ turned)[:, ::-1][:, :wanted]
    block *= np.sign(block[np.abs(block).argmax(axis=0), np.arange(block.shape[1])])
    return values, block


# ---- the operator ----


def fitted(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Sums, components and eigenvalues of all usable vectors."""
    chosen = vectors.select(F.col(column).alias("vector"))
    sizes = chosen.where("vector is not null").groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    dimension = sizes["size"] if sizes else 0
    none = Whitening(0, [0] * dimension, 0, np.zeros((dimension, 0)), np.zeros(0), 0.0)
    if dimension == 0:
        return none
    if dimension > LARGEST_DIMENSION:
        raise ValueError(f"vectors of {dimension} entries; at most {LARGEST_DIMENSION}")
    sums = chosen.mapInArrow(lambda batches: _sums(batches, "vector", dimension), "dimension int, n long, total decimal(38,0), largest long")
    rows = sums.groupBy("dimension").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("largest").alias("largest")).orderBy("dimension").collect()
    if not rows:
        return none
    n, totals, largest = rows[0].n, [int(r.total) for r in rows], max(r.largest for r in rows)

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        return deviations(usable(batch, "vector", dimension)[1], n, totals, largest).astype(np.float64) / n

    matrix = _covariance(chosen, centred, dimension, n)
    values, block = principal(vectors.sparkSession, matrix, min(components, dimension))
    return Whitening(n, totals, largest, block, values, float(np.trace(matrix)))


def _whitened(exact: np.ndarray, model: Whitening) -> np.ndarray:
    return (exact.astype(np.float64) / model.n) @ model.components / np.sqrt(model.eigenvalues)


def identity_error(vectors: DataFrame, model: Whitening, column: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    width = len(model.eigenvalues)
    if not width:
        return 0.0

    def of_batch(batch: pa.RecordBatch) -> np.ndarray:
        return _whitened(deviations(usable(batch, "vector", len(model.sums))[1], model.n, model.sums, model.largest), model)

    found = _covariance(vectors.select(F.col(column).alias("vector")), of_batch, width, model.n)
    return float(np.abs(found - np.eye(width)).max())


def with_components(vectors: DataFrame, model: Whitening, column: str = "embedding") -> DataFrame:
    """vec_id, whitened (array, a number for each component) and deviation of each usable vector."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(low, BLOCK_ROWS)
                rows, x = usable(part, "vector", len(model.sums))
                exact = deviations(x, model.n, model.sums, model.largest)
                numbers = pa.array(_whitened(exact, model).ravel())
                ends = pa.array(np.arange(len(rows) + 1) * len(model.eigenvalues), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(pa.array(rows)), pa.ListArray.from_arrays(ends, numbers), pa.array(squared(exact), pa.int64())],
                    names=["vec_id", "whitened", "deviation"],
                )

    chosen = vectors.select("vec_id", F.col(column).alias("vector"))
    return chosen.mapInArrow(run, f"vec_id {kind}, whitened array<double>, deviation long")


def whitened(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error, a row for each usable vector and component."""
    model = fitted(vectors, column, components)
    error = identity_error(vectors, model, column)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues]).cast("array<double>")
    rows = with_components(vectors, model, column).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
