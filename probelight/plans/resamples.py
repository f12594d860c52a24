"""Bootstraps at full size: exact multinomial counts found where the items lie. No SQL has these counts; tests hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import r6
from ..operators.multinomial import resampled_sums
from ..operators.vectors import norm
from .audit import point_table
from .contrast import complete
from .vectors import vector_pairs


def ends(value: str) -> list[Column]:
    """The ends of the middle 95 per cent, mean and deviation of a value over the draws."""
    at = lambda q: r6(F.percentile(value, F.lit(q)))
    return [at(0.025).alias("low"), at(0.975).alias("high"), r6(F.avg(value)).alias("mean"), r6(F.stddev_pop(value)).alias("sd")]


def boot_iid(spark: SparkSession, sf_dir: str, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """Per clause the mean length of differences over pairs drawn with replacement, as many as the clause has."""
    m = vector_pairs(spark, sf_dir).select(F.col("clause").cast("string").alias("clause"), "pair", norm(F.col("diff")).alias("x"), F.lit(1).alias("one"))
    sums = resampled_sums(m, "clause", "pair", ["x", "one"], draws, seed).withColumn("m", F.col("x") / F.col("one"))
    return sums.groupBy(F.col("clause").cast("int").alias("clause")).agg(*ends("m"), F.max("one").cast("long").alias("n"), F.count(F.lit(1)).alias("draws"))


def boot_ratio(spark: SparkSession, sf_dir: str, draws: int = 10_000, seed: int = 20260816) -> DataFrame:
    """The transfer coefficient over points drawn with replacement; the interval takes the 250th and 9750th of 10,000 ratios."""
    table = point_table(spark, sf_dir).where("m1_modal is not null and m2_modal is not null and m1_share > 0").select("pid", "m1_share", "m2_to_m1", F.lit("all").alias("g"))
    ratios = resampled_sums(table, "g", "pid", ["m1_share", "m2_to_m1"], draws, seed).select((F.col("m2_to_m1") / F.col("m1_share")).alias("ratio"))
    placed = ratios.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ratio")))  # a row for each draw
    one = lambda place: r6(F.max(F.when(F.col("place") == place, F.col("ratio"))))
    return placed.agg(one(draws * 25 // 1000).alias("low"), one(draws * 975 // 1000).alias("high"), r6(F.avg("ratio")).alias("mean"), F.count(F.lit(1)).alias("draws"))


def boot_stratified(spark: SparkSession, sf_dir: str, draws: int = 10_000, seed: int = 20260825) -> DataFrame:
    """Whole spans drawn within each (clause, class); the shift is averaged within clauses, then over them. The point has all data."""
    d = complete(spark, sf_dir).select("clause", F.when(F.col("item") % 2 == 0, "AGREE").otherwise("CONFLICT").alias("cls"), "span_key", "shift")
    spans = d.groupBy("clause", "cls", "span_key").agg(F.sum("shift").alias("s"), F.count(F.lit(1)).alias("n"))
    strata = spans.withColumn("stratum", F.concat_ws("|", "clause", "cls"))
    sums = resampled_sums(strata, "stratum", "span_key", ["s", "n"], draws, seed)
    per_clause = sums.groupBy("draw", F.substring_index("stratum", "|", 1).alias("clause")).agg((F.sum("s") / F.sum("n")).alias("m"))
    macro = per_clause.groupBy("draw").agg(F.avg("m").alias("macro"))
    point = d.groupBy("clause").agg(F.avg("shift").alias("m")).agg(r6(F.avg("m")).alias("point"))
    interval = macro.agg(*ends("macro"), r6(F.min("macro")).alias("least"), r6(F.max("macro")).alias("largest"), F.count(F.lit(1)).alias("draws"))
    verdict = F.when(F.col("low") > 0, "above zero").otherwise("not above zero")
    return interval.crossJoin(point).withColumn("verdict", verdict)  # one row each


QUERIES = {"boot_iid": boot_iid, "boot_ratio": boot_ratio, "boot_stratified": boot_stratified}
ORACLES: dict[str, str] = {}
