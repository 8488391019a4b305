"""Running values over long sequences.

``running`` computes cumulative sums and maxima of one sequence in two levels,
so that a sequence holding most of the rows is still spread over many tasks.
``ordered_fold`` replays rules that are truly sequential (each decision depends
on the previous ones) over sorted partitions, one row at a time, keeping only a
small state per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running(
    df: DataFrame,
    keys: list[str],
    chunk: Column,
    order: list,
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
) -> DataFrame:
    """Adds cumulative ``sums`` and ``maxima`` per key in the given order, current row included.

    ``chunk`` must grow with the order: it cuts each sequence into slices. Slices
    are scanned in parallel; their totals, one row per slice, are then accumulated.
    """
    sums, maxima = sums or {}, maxima or {}
    sliced = df.withColumn("_chunk", chunk)
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    for name, value in sums.items():
        sliced = sliced.withColumn(f"_{name}", F.sum(value).over(inside))
    for name, value in maxima.items():
        sliced = sliced.withColumn(f"_{name}", F.max(value).over(inside))
    totals = sliced.groupBy(*keys, "_chunk").agg(
        F.count("*").alias("_rows"),
        *[F.sum(value).alias(f"_t_{name}") for name, value in sums.items()],
        *[F.max(value).alias(f"_t_{name}") for name, value in maxima.items()],
    )
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_chunk",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(before).alias(f"_o_{n}") for n in maxima],
    )
    # A null key or slice is one like any other.
    marks = [*keys, "_chunk"]
    offsets = offsets.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(marks)], *[c for c in offsets.columns if c not in marks])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(marks)]
    joined = sliced.join(offsets, reduce(and_, same))
    return joined.select(
        *df.columns,
        *[(F.col(f"_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums],
        *[F.greatest(f"_{n}", f"_o_{n}").alias(n) for n in maxima],
    )


def ordered_fold(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    start: Callable[[], object],
    step: Callable[[object, tuple], list[tuple]],
    schema: str,
) -> DataFrame:
    """Replays ``step(state, row)`` over the rows of each key in order and emits what it returns.

    Rows are read batch by batch from sorted partitions; a key is never held in
    memory as a whole, only its state is. Rows are dealt by a hash of the keys, not by
    the keys: where these are a join's, that shuffle would be taken for the join's own,
    and a join that turns into a broadcast at run time leaves its rows where they were.
    """
    columns = df.columns
    key_at = [columns.index(k) for k in keys]

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, names = None, None, [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False, name=None):
                current = tuple(row[i] for i in key_at)
                if current != key:
                    key, state = current, start()
                out.extend(step(state, row))
            yield pd.DataFrame(out, columns=names)

    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInPandas(replay, schema)
