"""Vector expressions on array<float> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaestor.functions.text import once


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, null when a vector is missing or of zero length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalised(a: Column) -> Column:
    """The vector by its length, both computed once."""
    measured = once(a, lambda v: F.struct(v.alias("v"), norm(v).alias("length")))
    return once(measured, lambda m: F.transform(m["v"], lambda x: F.try_divide(x.cast("double"), m["length"])))


def substitute_vector(text: Column, dimensions: int) -> Column:
    """A unit vector derived from md5 digests of the text: reproducible and without meaning."""
    raw = F.transform(
        F.sequence(F.lit(1), F.lit(dimensions)),
        lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", text, i.cast("string"))), 1, 8), 16, 10).cast("double"),
    )
    signed = F.transform(raw, lambda x: (x - F.when(x >= 2.0**31, 2.0**32).otherwise(0.0)) / 2.0**31)
    return normalised(signed)


def usable_vector(vector: Column, model: Column, expected_model: Column, dimensions: int) -> Column:
    """The vector has the expected size and was made by the expected model."""
    return F.coalesce((F.size(vector) == dimensions) & model.eqNullSafe(expected_model), F.lit(False))
