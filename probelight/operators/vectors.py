"""Vectors as long tables of (key, dimension, value) and array columns: norms, directions, projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def unit(v: Column) -> Column:
    """The vector over its length, which is found once a row; a zero vector as it is."""
    over = lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0))
    return F.element_at(F.transform(F.array(norm(v)), over), 1)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def group_sum(df: DataFrame, by: list[str], vec: str, name: str) -> DataFrame:
    """Per group the sum of vectors, by dimension: partial sums before the shuffle, so a hot group is no burden."""
    each = df.select(*by, F.posexplode(vec).alias("_d", "_x")).groupBy(*by, "_d").agg(F.sum(F.col("_x").cast("double")).alias("_s"))
    whole = each.groupBy(*by) if by else each.groupBy()
    return whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_s"))), lambda p: p["_s"]).alias(name))
