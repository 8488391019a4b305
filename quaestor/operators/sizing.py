"""Joins whose small side is broadcast only when its size has been checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.session import materialised

# Upper size of a side sent to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024
# Slices a side is cut into when the other one is too large to broadcast.
SALTS = 32


def fits_broadcast(rows: int, row_bytes: int, budget: int = BROADCAST_BYTES) -> bool:
    return rows * row_bytes <= budget


def hot_join(
    large: DataFrame,
    small: DataFrame,
    on: list[str],
    spread_by: str,
    small_rows: int,
    row_bytes: int,
    budget: int = BROADCAST_BYTES,
    salts: int = SALTS,
) -> DataFrame:
    """Inner equi-join that survives hot keys in ``large``.

    ``small_rows`` is an upper bound on the rows of ``small``. Within the budget
    the small side is broadcast and ``large`` is never shuffled. Beyond it both
    sides are shuffled on the keys plus a salt: ``large`` takes its salt from
    ``spread_by`` (so one hot key is spread over ``salts`` tasks), ``small`` is
    repeated once per salt.
    """
    if fits_broadcast(small_rows, row_bytes, budget):
        return large.join(F.broadcast(small), on)
    salted = large.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"]).drop("_salt")


def small_side(df: DataFrame, rows: int, row_bytes: int, budget: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint when its proven bound fits, as it is otherwise."""
    return F.broadcast(df) if fits_broadcast(rows, row_bytes, budget) else df


def counted_side(df: DataFrame, row_bytes: int, budget: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` computed once and counted, with a broadcast hint when what was counted fits."""
    kept = materialised(df)
    return small_side(kept, kept.count(), row_bytes, budget)
