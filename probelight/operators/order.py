"""Running numbers over large groups: ranges are numbered side by side and shifted by what comes before them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Keys that a range's bounds are chosen from.
KEYS_OF_RANGE = 50


def with_range(df: DataFrame, order: str, name: str) -> DataFrame:
    """Adds the number of the row's range of a column: as many ranges of about equal size as shuffles have partitions.

    The bounds are taken from keys chosen by their hash, so they depend on the data alone and every plan that uses
    them has the same ranges. They are one row of fewer keys than there are ranges.
    """
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    every = max(1, df.count() // (KEYS_OF_RANGE * ranges))
    keys = df.where(F.pmod(F.xxhash64(F.col(order).cast("string"), F.lit(17)), F.lit(every)) == 0).agg(F.array_sort(F.collect_list(order)).alias("_keys"))
    at = lambda i: F.element_at("_keys", F.greatest(F.lit(1), F.floor(i * F.size("_keys") / ranges).cast("int")))
    bounds = F.when(F.size("_keys") > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(ranges)), at)))
    cut = keys.select(F.coalesce(bounds, F.col("_keys")).alias("_bounds"))
    return df.crossJoin(F.broadcast(cut)).withColumn(name, F.size(F.filter("_bounds", lambda b: b < F.col(order)))).drop("_bounds")


def numbered(df: DataFrame, group: str | None, order: str, name: str) -> DataFrame:
    """Adds the row's number in its group, from 1, by a column that is unique in the group.

    Rows are dealt by ranges of the order, so a group spreads over as many tasks as it needs. Each range counts its
    groups, the few counts are summed up range by range, and a row's number is its place in the range and that sum.
    """
    by = [group] if group else []
    dealt = with_range(df, order, "_part")
    here = F.row_number().over(Window.partitionBy("_part", *by).orderBy(order))
    counts = dealt.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.withColumn("_before", before).drop("_n")  # a row for each range and group
    return dealt.withColumn("_here", here).join(shifts, ["_part", *by]).withColumn(name, (F.col("_here") + F.col("_before")).cast("int")).drop("_part", "_here", "_before")


def same_keys(pairs: list[tuple[str, str]]) -> Column:
    """The condition that each column equals its partner, null to null."""
    return reduce(lambda a, b: a & b, [F.col(left).eqNullSafe(F.col(right)) for left, right in pairs])


def sum_before(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of value over the group's rows that come before this one; `order` is unique in the group.

    Ranges are summed side by side, as in `numbered`, so a group of any size spreads over the tasks. Nulls of the order
    come first, groups may be null, and a sum over no rows is 0.
    """
    dealt = with_range(df, order, "_part")
    inside = Window.partitionBy("_part", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_part", *by).agg(F.sum(value).alias("_sum"))  # a row for each range and group
    keys = [("_part", "_part_"), *((c, f"_by{i}") for i, c in enumerate(by))]
    shifts = sums.select(*[F.col(c).alias(k) for c, k in keys], F.coalesce(F.sum("_sum").over(ranges), F.lit(0)).alias("_before"))
    summed = dealt.withColumn("_here", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(shifts, same_keys(keys))
    return summed.withColumn(name, F.col("_here") + F.col("_before")).drop("_part", "_here", "_before", *[k for _, k in keys])
