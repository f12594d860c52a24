"""The driver's tables and the logical tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run log: pid, arm, rep, ord (log order), label; label 'error' is a failed repetition."""
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("pid"),
        F.when(F.col("event_id") % 2 == 0, "M1").otherwise("M2").alias("arm"),
        F.expr("(event_id div 2) % 12").alias("rep"),
        F.col("event_id").alias("ord"),
        F.col("event_type").alias("label"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replay points: pid, kind, and hist, the label the log had first."""
    e = load(spark, sf_dir, "events")
    kind = F.element_at(F.array(F.lit("genesis"), F.lit("probe"), F.lit("optout")), (F.col("user_id") % 3 + 1).cast("int"))
    return e.groupBy(F.col("user_id")).agg(F.min_by("event_type", "event_id").alias("hist")).select(F.col("user_id").alias("pid"), kind.alias("kind"), "hist")


RUNS_SQL = """runs AS (
  SELECT user_id AS pid, CASE WHEN event_id % 2 = 0 THEN 'M1' ELSE 'M2' END AS arm, (event_id // 2) % 12 AS rep, event_id AS ord, event_type AS label FROM events
), points AS (
  SELECT user_id AS pid, CASE user_id % 3 WHEN 0 THEN 'genesis' WHEN 1 THEN 'probe' ELSE 'optout' END AS kind, arg_min(event_type, event_id) AS hist FROM events GROUP BY user_id
)"""


# Orders of the study that one task holds, with their lines.
ITEMS_OF_TASK = 250_000


def _dealt(line: DataFrame, order: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (item, cond, quantity) and items, both dealt by item to as many tasks as keep a task's share at ITEMS_OF_TASK.

    A given number of partitions is not put together again, so what a task holds stays the same at any size. An order
    that is listed twice is one item.
    """
    spark = line.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-order.count() // ITEMS_OF_TASK))
    cond = F.when(F.col("l_returnflag") == "A", "B").when(F.col("l_returnflag") == "R", "C").otherwise("none")
    lines = line.select(F.col("l_orderkey").alias("item"), cond.alias("cond"), F.col("l_quantity").alias("quantity"))
    return lines.repartition(parts, "item"), study_items(order).repartition(parts, "item").distinct()


def pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paired study, long: item (an order), cond (B, C, none) by its lines' flags, delta, clause, family, split, span_key."""
    lines, items = _dealt(load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders"))
    return lines.groupBy("item", "cond").agg((F.avg("quantity") - 25).alias("delta")).join(items, "item")


def study_items(order: DataFrame) -> DataFrame:
    """item, clause, family, split and span_key of every order."""
    tenth = F.col("o_orderkey") % 10
    clause = F.concat(F.substring("o_orderpriority", 1, 1), F.lit("#"), (F.col("o_custkey") % 5).cast("string"))
    return order.select(
        F.col("o_orderkey").alias("item"), clause.alias("clause"), F.concat_ws("-", "o_orderstatus", (F.col("o_custkey") % 3).cast("string")).alias("family"),
        F.when(tenth <= 5, "train").when(tenth <= 7, "dev").otherwise("test").alias("split"),
        F.concat_ws("|", clause, (F.col("o_custkey") % 6).cast("string")).alias("span_key"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paired study, wide: one row an item, delta_b, delta_c, delta_none; null where a condition is missing."""
    lines, items = _dealt(load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders"))
    delta = lambda c: (F.avg(F.when(F.col("cond") == c, F.col("quantity"))) - 25).alias(f"delta_{c.lower()}")
    return lines.groupBy("item").agg(delta("B"), delta("C"), delta("none")).join(items, "item").select("item", "clause", "family", "split", "span_key", "delta_b", "delta_c", "delta_none")


PAIRS_SQL = """rows_long AS (
  SELECT l_orderkey AS item, CASE l_returnflag WHEN 'A' THEN 'B' WHEN 'R' THEN 'C' ELSE 'none' END AS cond, avg(l_quantity) - 25 AS delta
  FROM lineitem GROUP BY 1, 2
), pairs AS (
  SELECT o_orderkey AS item, left(o_orderpriority, 1) || '#' || (o_custkey % 5) AS clause, o_orderstatus || '-' || (o_custkey % 3) AS family,
    CASE WHEN o_orderkey % 10 <= 5 THEN 'train' WHEN o_orderkey % 10 <= 7 THEN 'dev' ELSE 'test' END AS split,
    left(o_orderpriority, 1) || '#' || (o_custkey % 5) || '|' || (o_custkey % 6) AS span_key,
    max(delta) FILTER (cond = 'B') AS delta_b, max(delta) FILTER (cond = 'C') AS delta_c, max(delta) FILTER (cond = 'none') AS delta_none
  FROM rows_long JOIN orders ON o_orderkey = item GROUP BY 1, 2, 3, 4, 5
), complete AS (SELECT * FROM pairs WHERE delta_b IS NOT NULL AND delta_c IS NOT NULL)"""


def tagged_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses with protocol tags: documents with one of five beginnings."""
    starts = ["[OPT-OUT-HARD] ", "well [OPT-OUT-SOFT] and [OPT-OUT-ODD] ", "[OPT-OUT-BAD] ", "ACTION: reflected\n", ""]
    pick = F.element_at(F.array(*map(F.lit, starts)), (F.col("doc_id") % 5 + 1).cast("int"))
    return load(spark, sf_dir, "documents").select("doc_id", "source", F.concat(pick, "text").alias("text"))


TAGGED_SQL = """tagged AS (
  SELECT doc_id, source, CASE doc_id % 5 WHEN 0 THEN '[OPT-OUT-HARD] ' WHEN 1 THEN 'well [OPT-OUT-SOFT] and [OPT-OUT-ODD] ' WHEN 2 THEN '[OPT-OUT-BAD] ' WHEN 3 THEN 'ACTION: reflected' || chr(10) ELSE '' END || text AS text
  FROM documents
)"""
