"""Three ways to thin a log with repeated keys, and first-of-group operators. All are aggregations: rows combine
before the shuffle, so a hot key costs no more than another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _rest(df: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in df.columns if c not in keys]


def first_success(df: DataFrame, keys: list[str], order: str, failed: Column) -> DataFrame:
    """The first row that did not fail, else the first; first_ord is where the key was first seen, n_extra how many rows it had beyond one."""
    best = F.min_by(F.struct(*_rest(df, keys)), F.struct(failed, F.col(order))).alias("_row")
    return df.groupBy(*keys).agg(best, F.min(order).alias("first_ord"), (F.count(F.lit(1)) - 1).alias("n_extra")).select(*keys, "_row.*", "first_ord", "n_extra")


def first_row(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(F.struct(*_rest(df, keys)), order).alias("_row")).select(*keys, "_row.*")


def last_row(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(F.struct(*_rest(df, keys)), order).alias("_row")).select(*keys, "_row.*")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The table, or an error when a key occurs twice."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate key: {twice[0]}")
    return df


def change_points(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before, the first of each group included."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(order)) == 1
    return df.withColumn("_new", first | ~F.col(value).eqNullSafe(before)).where("_new").drop("_new")
