"""Faults put into rows and into vectors apart, each run past the guards that a study has: which fires, and what moves if none does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import win_score
from ..functions.stats import r6
from ..operators.vectors import dot, group_sum
from ..sources.tables import PAIRS_SQL
from .contrast import complete
from .vectors import VPAIRS_SQL, vector_pairs

VICTIMS, KILL_SHIFT, RECORD_ERROR = 5, 0.02, 1e-6
ROW_FAULTS = ("clean", "c1 rows of B and C exchanged", "c3 delta edited, record kept", "c4 condition dropped", "c5 splits moved", "c6 spans edited")
VECTOR_FAULT = "c2 vectors of B and C exchanged"


def _victims(df: DataFrame, key: str) -> DataFrame:
    """The key, and whether it is among the five of least digest."""
    first = df.select(key).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(VICTIMS)
    return df.join(F.broadcast(first.select(F.col(key).alias("_v"))), F.col(key) == F.col("_v"), "left").withColumn("victim", F.col("_v").isNotNull()).drop("_v")


def faulty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every complete item under every fault of rows: fault, item, b, c, their records lb and lc, split, span."""
    d = _victims(complete(spark, sf_dir).select("item", "split", "span_key", F.col("delta_b").alias("b"), F.col("delta_c").alias("c")), "item")

    def row(fault: str, b="b", c="c", lb="b", lc="c", split="split", span="span_key"):
        pick = lambda new, old: F.when(F.col("victim"), F.expr(new)).otherwise(F.col(old))
        return F.struct(F.lit(fault).alias("fault"), pick(b, "b").alias("b"), pick(c, "c").alias("c"), pick(lb, "b").alias("lb"), pick(lc, "c").alias("lc"), pick(split, "split").alias("split"), pick(span, "span_key").alias("span"))

    clean, c1, c3, c4, c5, c6 = ROW_FAULTS
    faults = [
        row(clean), row(c1, b="c", c="b", lb="c", lc="b"), row(c3, c="c + 1"), row(c4, c="null", lc="null"),
        row(c5, split="CASE split WHEN 'train' THEN 'test' ELSE 'train' END"), row(c6, span="concat(span_key, 'x')"),
    ]
    return d.select("item", F.explode(F.array(*faults)).alias("x")).select("item", "x.*")


def guards_of_rows(rows: DataFrame) -> DataFrame:
    """Per fault: rows whose delta is not what was recorded, items without a condition, a digest of splits and spans, the headline."""
    wrong = (F.abs(F.col("b") - F.col("lb")) > RECORD_ERROR) | (F.abs(F.col("c") - F.col("lc")) > RECORD_ERROR)
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("item").cast("string"), "split", "span").cast("binary")), 1, 8), 16, 10).cast("long")
    return rows.groupBy("fault").agg(
        F.count_if(wrong).alias("wrong"), F.count_if(F.col("b").isNull() | F.col("c").isNull()).alias("open"), F.sum(digest).alias("digest"),
        F.avg((F.col("c") > F.col("b")).cast("int")).alias("headline"),
    )


def vector_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: dev accuracy of the contrastive direction, and after the exchange of the victims' vectors."""
    p = _victims(vector_pairs(spark, sf_dir).select("pair", (F.col("span") % 4 == 0).alias("dev"), "diff"), "pair")
    p = p.withColumn("turned", F.when(F.col("victim"), F.transform("diff", lambda x: -x)).otherwise(F.col("diff")))
    train = p.where("not dev")
    both = group_sum(train, [], "diff", "u").crossJoin(group_sum(train, [], "turned", "t"))  # one row each
    win = lambda v, w: F.avg(win_score(F.lit(0.0), dot(F.col(v), F.col(w))))
    return p.where("dev").crossJoin(F.broadcast(both)).agg(win("diff", "u").alias("clean"), win("turned", "t").alias("faulty"))


def fault_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fault, the guards it meets, which one fires first, and the move of the headline; a silent one that moves it by .02 kills."""
    g = guards_of_rows(faulty_rows(spark, sf_dir))
    clean = g.where(F.col("fault") == ROW_FAULTS[0]).select(F.col("digest").alias("was"), F.col("headline").alias("before"))
    rows = g.where(F.col("fault") != ROW_FAULTS[0]).crossJoin(F.broadcast(clean))  # one row
    record, open_, manifest = F.col("wrong") > 0, F.col("open") > 0, F.col("digest") != F.col("was")
    by = F.when(record, "record check").when(open_, "completeness").when(manifest, "manifest").otherwise("SILENT")
    flag = lambda c: c.cast("int")
    told = rows.select("fault", flag(record).alias("record_check"), flag(open_).alias("completeness"), flag(manifest).alias("manifest"), by.alias("detected_by"), (F.col("headline") - F.col("before")).alias("shift"))
    vectors = vector_headlines(spark, sf_dir).select(F.lit(VECTOR_FAULT).alias("fault"), *[F.lit(0).alias(c) for c in ("record_check", "completeness", "manifest")], F.lit("SILENT").alias("detected_by"), (F.col("faulty") - F.col("clean")).alias("shift"))
    kill = (F.col("detected_by") == "SILENT") & (F.abs("shift") > KILL_SHIFT)
    return told.unionByName(vectors).select("fault", "record_check", "completeness", "manifest", "detected_by", r6(F.col("shift")).alias("shift"), flag(kill).alias("kill"))


QUERIES = {"fault_detectors": fault_detectors}
ORACLES = {
    "fault_detectors": f"""WITH {PAIRS_SQL}, {VPAIRS_SQL}, victims AS (SELECT item FROM complete ORDER BY md5(item::VARCHAR), item LIMIT {VICTIMS}),
      base AS (SELECT item, split, span_key, delta_b, delta_c, item IN (SELECT item FROM victims) AS v FROM complete),
      x AS (SELECT fault, item,
          CASE WHEN v AND fault LIKE 'c1%' THEN delta_c ELSE delta_b END AS b, CASE WHEN v AND fault LIKE 'c1%' THEN delta_b WHEN v AND fault LIKE 'c3%' THEN delta_c + 1 WHEN v AND fault LIKE 'c4%' THEN NULL ELSE delta_c END AS c,
          CASE WHEN v AND fault LIKE 'c1%' THEN delta_c ELSE delta_b END AS lb, CASE WHEN v AND fault LIKE 'c1%' THEN delta_b ELSE delta_c END AS lc,
          CASE WHEN v AND fault LIKE 'c5%' THEN CASE split WHEN 'train' THEN 'test' ELSE 'train' END ELSE split END AS split, CASE WHEN v AND fault LIKE 'c6%' THEN span_key || 'x' ELSE span_key END AS span
        FROM base, (SELECT unnest({list(ROW_FAULTS)}) AS fault)),
      g AS (SELECT fault, count(*) FILTER (abs(b - lb) > {RECORD_ERROR} OR abs(c - lc) > {RECORD_ERROR}) AS wrong, count(*) FILTER (b IS NULL OR c IS NULL) AS open, sum(('0x' || substr(md5(item || '|' || split || '|' || span), 1, 8))::BIGINT) AS digest, avg((c > b)::INT) AS headline FROM x GROUP BY 1),
      told AS (SELECT g.fault, (g.wrong > 0)::INT AS record_check, (g.open > 0)::INT AS completeness, (g.digest <> k.digest)::INT AS manifest, g.headline - k.headline AS shift FROM g, g k WHERE k.fault = 'clean' AND g.fault <> 'clean'),
      hurt AS (SELECT pair FROM vp ORDER BY md5(pair::VARCHAR), pair LIMIT {VICTIMS}), s AS (SELECT pair, span % 4 = 0 AS dev, d, x, CASE WHEN pair IN (SELECT pair FROM hurt) THEN -x ELSE x END AS y FROM dims),
      u AS (SELECT d, sum(x) AS u, sum(y) AS t FROM s WHERE NOT dev GROUP BY 1), m AS (SELECT pair, sum(x * u) AS a, sum(y * t) AS b FROM s JOIN u USING (d) WHERE dev GROUP BY 1),
      w AS (SELECT avg(CASE WHEN b > 0 THEN 1.0 WHEN b = 0 THEN 0.5 ELSE 0.0 END::DOUBLE) - avg(CASE WHEN a > 0 THEN 1.0 WHEN a = 0 THEN 0.5 ELSE 0.0 END::DOUBLE) AS shift FROM m),
      every AS (SELECT *, CASE WHEN record_check = 1 THEN 'record check' WHEN completeness = 1 THEN 'completeness' WHEN manifest = 1 THEN 'manifest' ELSE 'SILENT' END AS detected_by FROM told UNION ALL SELECT '{VECTOR_FAULT}', 0, 0, 0, shift, 'SILENT' FROM w)
      SELECT fault, record_check, completeness, manifest, detected_by, round(shift, 6) AS shift, (detected_by = 'SILENT' AND abs(shift) > {KILL_SHIFT})::INT AS kill FROM every""",
}
