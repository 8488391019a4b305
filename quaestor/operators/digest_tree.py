"""Audits by a tree of digests: stores that are equal are compared at the root, others only where they differ.

Rows fall into buckets by the first hexadecimal digits of their keys' digest; a bucket's digest is a sum over its rows, which
needs no order and tells repeated rows apart. Buckets are summed upwards, one digit less a level. A tree is small
(``16 ** DIGITS`` rows at most on its lowest level, whatever the store holds) and is written next to the store it describes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of the smallest buckets.
DIGITS = 3
#: Sums are kept modulo 2 ** 32, so that none overflows.
HALF = 0xFFFFFFFF

_SUMS = ("rows", "low", "high")


def bucket_of(keys: list[str], digits: int = DIGITS) -> Column:
    """The bucket of a row; which it is changes no result, so a null may share that of an empty text."""
    named = F.col(keys[0]).cast("string") if len(keys) == 1 else F.to_json(F.struct(*keys))
    return F.left(F.md5(F.coalesce(named, F.lit(""))), F.lit(digits))


def digest_tree(store: DataFrame, keys: list[str], value: Column, digits: int = DIGITS) -> DataFrame:
    """(level, bucket, rows, low, high): sums of the two halves of each row's hash, from the root (level 0) to the smallest buckets."""
    row = F.xxhash64(*keys, value.isNull(), value)
    leaves = store.select(bucket_of(keys, digits).alias("bucket"), row.alias("digest")).groupBy("bucket").agg(
        F.count("*").alias("rows"),
        F.sum(F.col("digest").bitwiseAND(F.lit(HALF))).bitwiseAND(F.lit(HALF)).alias("low"),
        F.sum(F.shiftrightunsigned("digest", 32)).bitwiseAND(F.lit(HALF)).alias("high"),
    )
    # Each leaf counts on every level: the leaves are few, so one more pass over them is all the upper levels take.
    levels = leaves.select(F.explode(F.sequence(F.lit(0), F.lit(digits))).alias("level"), "bucket", *_SUMS)
    return levels.groupBy("level", F.expr("left(bucket, level)").alias("bucket")).agg(*[F.sum(x).alias(x) for x in _SUMS])


def unequal_buckets(before: DataFrame, after: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(level, bucket) of two trees' unequal buckets, from the root down: only the children of unequal buckets are compared."""

    def level(tree: DataFrame, number: int, parents: DataFrame | None) -> DataFrame:
        rows = tree.where(F.col("level") == number).drop("level")
        return rows if parents is None else rows.join(parents, F.expr(f"left(bucket, {number - 1}) = parent"), "left_semi")

    found, parents = [], None
    for number in range(digits + 1):
        old, new = (level(tree, number, parents).select("bucket", F.struct(*_SUMS).alias(name)) for tree, name in ((before, "old"), (after, "new")))
        unequal = old.join(new, "bucket", "full").where("not (old <=> new)").select(F.lit(number).alias("level"), "bucket")
        found.append(unequal)
        parents = unequal.select(F.col("bucket").alias("parent"))
    return reduce(DataFrame.unionByName, found)


def differences(before: DataFrame, after: DataFrame, keys: list[str], value: Column, unequal: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(keys, bucket, change) of rows in the unequal buckets: ``added``, ``removed`` or ``rewritten``; equal buckets are not joined.

    A key is rewritten if its contents, repeats included, are not the same on both sides. Nulls are keys as any other.
    """
    leaves = F.broadcast(unequal.where(F.col("level") == digits).select("bucket"))

    def side(store: DataFrame, sign: int) -> DataFrame:
        rows = store.select(*keys, bucket_of(keys, digits).alias("bucket"), F.xxhash64(value.isNull(), value).alias("digest"), F.lit(sign).alias("sign"))
        return rows.join(leaves, "bucket", "left_semi")

    contents = side(before, -1).unionByName(side(after, 1)).groupBy(*keys, "bucket", "digest").agg(
        F.sum("sign").alias("gain"), F.count_if(F.col("sign") < 0).alias("old"), F.count_if(F.col("sign") > 0).alias("new")
    )
    by_key = contents.groupBy(*keys, "bucket").agg(F.sum("old").alias("old"), F.sum("new").alias("new"), F.max(F.abs("gain")).alias("gain")).where("gain > 0")
    change = F.when(F.col("old") == 0, "added").when(F.col("new") == 0, "removed").otherwise("rewritten")
    return by_key.select(*keys, "bucket", change.alias("change"))
