"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the angle between two vectors; null where one has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def normalise(a: Column) -> Column:
    """a at unit length. The norm is held in a struct, so that it is taken once and not for each element."""
    held = F.array(F.struct(a.alias("v"), norm(a).alias("n")))
    return F.transform(held, lambda s: F.transform(s["v"], lambda x: x.cast("double") / s["n"]))[0]


def dot_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b)


def rounded(c: Column, places: int = 6) -> Column:
    """Half-up by floor, which engines agree on where they differ in round()."""
    scale = float(10**places)
    return F.floor(c * scale + 0.5) / scale


def mean_pool(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, dim, value: the mean of each dimension. Partial sums are taken before the shuffle."""
    long = df.select(*keys, F.posexplode(vector).alias("dim", "x"))
    return long.groupBy(*keys, "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))
