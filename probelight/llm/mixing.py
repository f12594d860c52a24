"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

Every document gets a count drawn from a Poisson distribution whose mean is its source's repetition rate,
by inverting the distribution at a number in [0, 1) that is a hash of the document's id; the document is then
repeated that many times, and all copies are dealt out by a second hash.

Cases: a null source is a source of its own; a null doc_id hashes as the empty string; repeated rows get the
same count each; empty and very long texts are copied like any other; columns of the input that have the name
of an added column are replaced, all others may have any names; an empty table gives an empty table. The inverted
distribution reaches 12 deviations and 30 beyond its mean, which no 52-bit number can pass.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

ADDED = ("n_copies", "copy_no", "shuffle_key")
# A Poisson mean above this is drawn as a sum of equal parts, each below it, so that exp(-mean) stays exact.
PART_MEAN = 64.0


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def repetition_rates(docs: DataFrame, targets: Mapping[str | None, float] | None, power: float, total: float | None) -> DataFrame:
    """Per source: its count of documents, mean repetition rate, and the cumulative Poisson distribution of a part.

    Without targets the weights are the counts to `power`. The counts are partial sums before the shuffle, so a
    source with most of the rows costs no more than another.
    """
    counts = materialize(docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs")), "source-counts")
    if targets is None:
        weighted = counts.withColumn("weight", F.pow(F.col("n_docs").cast("double"), F.lit(power)))
    else:
        named = [(k, float(v)) for k, v in targets.items()]
        given = counts.sparkSession.createDataFrame(named, "target_source string, weight double")
        weighted = counts.join(given, F.col("source").eqNullSafe(F.col("target_source")), "left").select("source", "n_docs", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sums = weighted.agg(F.sum("weight").alias("w"), F.sum("n_docs").alias("n")).first()
    wanted = float(total if total is not None else sums["n"] or 0)
    rate = F.col("weight") / F.lit(sums["w"] or 1.0) * F.lit(wanted) / F.col("n_docs")
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_MEAN).cast("int"))
    mean = F.col("rate") / F.col("parts")
    steps = F.sequence(F.lit(0), (F.ceil(mean + 12 * F.sqrt(mean)) + 30).cast("int"))
    grown = F.aggregate(
        steps,
        F.struct(F.exp(-F.col("mean")).alias("p"), F.array().cast("array<double>").alias("cdf"), F.lit(0.0).alias("c")),
        lambda a, k: F.struct((a["p"] * F.col("mean") / (k + 1)).alias("p"), F.concat(a["cdf"], F.array(a["c"] + a["p"])).alias("cdf"), (a["c"] + a["p"]).alias("c")),
        lambda a: a["cdf"],
    )
    return weighted.withColumn("rate", rate).withColumn("parts", parts).withColumn("mean", mean).select("source", "n_docs", "rate", "parts", grown.alias("cdf"))


def poisson_mix(docs: DataFrame, targets: Mapping[str | None, float] | None = None, *, power: float = 0.5, total: float | None = None, seed: str = "mix") -> DataFrame:
    """Documents repeated to the target weights, in hash order; adds n_copies, copy_no (from 1) and shuffle_key.

    The table of rates has a row for each source. It is written and read back, so Spark broadcasts it only when
    its true size is under spark.sql.autoBroadcastJoinThreshold, and otherwise splits a hot source's partition.
    """
    rates = materialize(repetition_rates(docs.select("source"), targets, power, total), "rates").select(F.col("source").alias("_rate_source"), "parts", "cdf")
    docs = docs.drop(*ADDED).select(F.struct("*").alias("_row"), F.col("source").alias("_source"), "doc_id")
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("parts")),
        F.lit(0),
        lambda a, j: a + F.size(F.filter("cdf", lambda c: c <= unit_hash(F.lit(seed), F.col("doc_id"), j))),
    )
    drawn = docs.join(rates, F.col("_source").eqNullSafe(F.col("_rate_source"))).select("_row", "doc_id", count.alias("n_copies"))
    copies = drawn.where("n_copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.col("doc_id").cast("string"), F.col("copy_no").cast("string")).cast("binary")))
    dealt = keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key", "doc_id", "copy_no")
    return dealt.select("_row.*", *ADDED)
