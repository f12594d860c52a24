"""Study queries: joins that must hold, probes, controls by class, bundles with their intervals, decision rules, generated documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.labels import action, first_line, first_tag, win_score
from ..functions.stats import binomial_p, hash_draw, r6
from ..operators.joins import required
from ..operators.multinomial import resampled_sums
from ..operators.order import numbered
from ..sources.tables import PAIRS_SQL, TAGGED_SQL, load, pair_rows, pairs, tagged_text
from . import audit, contrast
from .contrast import complete
from .vectors import _left_out, _left_out_sql, layer_accuracy, layer_sql, vector_pairs

ARGS_CHARS, LINE_CHARS = 2000, 120


def unit_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units both of whose members have a vector: a semi-join on each side."""
    e = load(spark, sf_dir, "embeddings")
    units = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("b_id"), (F.col("vec_id") + 1).alias("c_id"), F.col("label").alias("clause"))
    acts = e.where("vec_id % 7 <> 0").select("vec_id")
    both = units.join(acts.withColumnRenamed("vec_id", "b_id"), "b_id", "left_semi").join(acts.withColumnRenamed("vec_id", "c_id"), "c_id", "left_semi")
    return both.groupBy("clause").agg(F.count(F.lit(1)).alias("n"), F.min("b_id").alias("first"))


def prior_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the prior is one number within each clause, to 1e-12."""
    g = pairs(spark, sf_dir).where("delta_none is not null").groupBy("clause").agg(F.count(F.lit(1)).alias("n"), (F.max("delta_none") - F.min("delta_none")).alias("s"))
    return g.select("clause", "n", r6(F.col("s")).alias("spread"), F.when(F.col("s") <= 1e-12, "constant").otherwise("varies").alias("state"))


def collapsed_resamples(spark: SparkSession, sf_dir: str, draws: int = 20) -> DataFrame:
    """Items of the dev split drawn with replacement; of those of one span the last drawn stays."""
    d = numbered(complete(spark, sf_dir).where("split = 'dev'").select("item", "span_key"), None, "item", "i").withColumn("i", F.col("i") - 1)
    n = F.lit(d.count())
    picks = d.select(F.col("i").alias("slot")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("i", hash_draw(n, F.col("b"), F.col("slot")))
    last = picks.join(d, "i").groupBy("b", "span_key").agg(F.max_by("item", "slot").alias("item"), F.count(F.lit(1)).alias("drawn"))
    return last.groupBy("b").agg(F.count(F.lit(1)).alias("spans"), F.sum("drawn").alias("drawn"), F.sum("item").alias("items"))


def class_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out hits by class of record."""
    m = _left_out(vector_pairs(spark, sf_dir), "clause")
    cls = F.when(F.col("pair") % 4 == 0, "AGREE").otherwise("CONFLICT")
    return m.groupBy(cls.alias("cls")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.when(F.col("margin") > 0, 1.0).when(F.col("margin") == 0, 0.5).otherwise(0.0))).alias("accuracy"))


def layer_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layers' held-out accuracies in one line: how many reach .8, the largest, and the first layer that has it."""
    per = layer_accuracy(spark, sf_dir)
    return per.agg(F.count(F.lit(1)).cast("int").alias("layers"), F.count_if(F.col("accuracy") >= 0.8).alias("n_high"), r6(F.max("accuracy")).alias("best"), F.max_by("layer", F.struct("accuracy", -F.col("layer"))).alias("layer"))


def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of three tables held against each other both ways, and whether one is within the other."""
    keys = {"customers": load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "orders": load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "events": load(spark, sf_dir, "events").select(F.col("user_id").alias("k"))}
    out = None
    for a, b in (("customers", "orders"), ("orders", "events"), ("events", "customers")):
        sides = keys[a].distinct().withColumn("a", F.lit(1)).join(keys[b].distinct().withColumn("b", F.lit(1)), "k", "full_outer")
        row = sides.agg(F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))
        row = row.select(F.lit(a).alias("left"), F.lit(b).alias("right"), "*", (F.col("only_left") == 0).cast("int").alias("subset"))
        out = row if out is None else out.unionByName(row)
    return out


def effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main items with their baseline by clause and version; an item without one stops the query. The effect is signed by class."""
    p = pairs(spark, sf_dir)
    version = (F.col("item") % 2).alias("version")
    base = p.where("delta_none is not null").groupBy("clause", version).agg(F.avg("delta_none").alias("baseline"))
    main = p.where("delta_c is not null").select("item", "clause", version, F.col("delta_c").alias("y"), F.when(F.col("item") % 3 == 0, "CONFLICT").otherwise("AGREE").alias("cls"))
    e = required(main, base, ["clause", "version"], "baseline").withColumn("effect", F.when(F.col("cls") == "AGREE", 1).otherwise(-1) * (F.col("y") - F.col("baseline")))
    return e.groupBy("clause", "cls").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("effect")).alias("effect"))


def probe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probes' rows: an item's lines by order of phrasing (even and odd line numbers), with the original row and the clause's prior."""
    line = load(spark, sf_dir, "lineitem")
    cond = F.when(F.col("l_returnflag") == "A", "B").when(F.col("l_returnflag") == "R", "C").otherwise("none")
    probes = line.groupBy(F.col("l_orderkey").alias("item"), cond.alias("cond"), (F.col("l_linenumber") % 2).alias("variant")).agg((F.avg("l_quantity") - 25).alias("probe"))
    rows = pair_rows(spark, sf_dir)
    prior = rows.where("cond = 'none'").groupBy("clause").agg(F.max_by("delta", "item").alias("prior"))
    return probes.join(rows, ["item", "cond"], "left").join(prior, "clause", "left")


def probe_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause priors' sign flips under the probes against the rule of more than two, the shifts' agreement in direction, and the order effect against half the mean effect."""
    p = probe_rows(spark, sf_dir)
    clauses = p.where("cond = 'none'").groupBy("clause").agg(F.avg("probe").alias("m"), F.max("prior").alias("prior"))
    flips = clauses.agg(F.count_if(F.signum("m") != F.signum("prior")).alias("flips"))
    value = lambda c, v: F.max(F.when((F.col("cond") == c) & (F.col("variant") == v), F.col("probe")))
    whole = lambda c: F.max(F.when(F.col("cond") == c, F.col("delta")))
    wide = p.groupBy("item").agg(value("B", 0).alias("b0"), value("B", 1).alias("b1"), value("C", 0).alias("c0"), value("C", 1).alias("c1"), whole("B").alias("b"), whole("C").alias("c"))
    agree = F.avg((F.signum(F.col("c0") - F.col("b0")) == F.signum(F.col("c") - F.col("b"))).cast("int"))
    apart, effect = F.avg(F.abs(F.col("c0") - F.col("c1"))), F.abs(F.avg(F.col("c") - F.col("b"))) / 2
    shifts = wide.agg(r6(agree).alias("agreement"), r6(apart).alias("order_difference"), r6(effect).alias("half_effect"), F.when(apart > effect, "KILL").otherwise("PASS").alias("order_verdict"))
    return flips.select("flips", F.when(F.col("flips") > 2, "KILL").otherwise("PASS").alias("flip_verdict")).crossJoin(shifts)  # one row each


def self_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per clause and condition: the probes' mean and the share that is positive."""
    return probe_rows(spark, sf_dir).where("clause is not null").groupBy("clause", "cond").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("probe")).alias("mean"), r6(F.avg((F.col("probe") > 0).cast("int"))).alias("positive"))


def paired_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By split: accuracy, sign test without ties, AUROC, margin, Cohen's d, and the interval over whole clauses."""
    intervals = contrast.cluster_bootstrap(spark, sf_dir).select("split", "low", "high")
    return bundle(complete(spark, sf_dir), intervals, contrast.auroc_by_split(spark, sf_dir).select("split", "auroc"))


def bundle(d: DataFrame, by_cluster: DataFrame, auc: DataFrame, draws: int = 10_000) -> DataFrame:
    """The bundle of the pairs d; where clauses are one, or as many as pairs, the interval is that of pairs drawn singly."""
    win = win_score(F.col("delta_b"), F.col("delta_c"))
    g = d.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("clause").alias("k"), r6(F.avg(win)).alias("accuracy"), F.count_if(F.col("shift") > 0).alias("wins"), F.count_if(F.col("shift") != 0).alias("m"),
        r6(F.avg("shift")).alias("margin"), r6(F.try_divide(F.avg("shift"), F.stddev_samp("shift"))).alias("cohen_d"),
    )
    kind = F.when((F.col("k") > 1) & (F.col("k") < F.col("n")), "cluster").otherwise("iid")
    g = g.withColumn("interval", kind)
    single = d.join(g.where("interval = 'iid'").select("split"), "split", "left_semi").select("split", "item", win.alias("win"), F.lit(1).alias("one"))
    mean = resampled_sums(single, "split", "item", ["win", "one"], draws).withColumn("m", F.col("win") / F.col("one"))
    by_pair = mean.groupBy("split").agg(*[r6(F.percentile("m", F.lit(q))).alias(c) for c, q in (("one_low", 0.025), ("one_high", 0.975))])
    every = g.join(by_cluster, "split", "left").join(by_pair, "split", "left").join(auc, "split")
    bound = lambda c: F.when(F.col("interval") == "iid", F.col(f"one_{c}")).otherwise(F.col(c)).alias(c)
    return every.select("split", "n", "k", "accuracy", "margin", "cohen_d", "auroc", bound("low"), bound("high"), "interval", r6(binomial_p(F.col("wins"), F.col("m"))).alias("sign_p"))


def method_contrast(spark: SparkSession, sf_dir: str, draws: int = 2000) -> DataFrame:
    """Two methods on the same items: the accuracy difference with its interval over whole clauses, by split."""
    d = complete(spark, sf_dir).where("delta_none is not null")
    one, two = (F.col("shift") > 0).cast("int"), (F.col("delta_c") > F.col("delta_none")).cast("int")
    cells = d.groupBy("split", "clause").agg(F.sum(one - two).alias("s"), F.count(F.lit(1)).alias("n"))
    ordered = cells.withColumn("i", F.row_number().over(Window.partitionBy("split").orderBy("clause")) - 1).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("split")))
    picks = ordered.select("split", "k", F.col("i").alias("slot")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("i", hash_draw(F.col("k"), F.col("b"), F.col("slot")))
    drawn = picks.join(ordered.select("split", "i", "s", "n"), ["split", "i"]).groupBy("split", "b").agg((F.sum("s") / F.sum("n")).alias("d"))
    bounds = drawn.groupBy("split").agg(r6(F.percentile("d", F.lit(0.025))).alias("low"), r6(F.percentile("d", F.lit(0.975))).alias("high"), r6(F.min("d")).alias("least"), r6(F.max("d")).alias("most"), r6(F.avg("d")).alias("mean"), r6(F.stddev_pop("d")).alias("sd"))
    point = cells.groupBy("split").agg(F.sum("n").alias("n"), r6(F.sum("s") / F.sum("n")).alias("difference"))
    return point.join(bounds, "split").withColumn("note", F.when(F.col("n") < 10, "few common items").otherwise(""))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of decision by split: lower bound over one half, a substantial accuracy, and the four readings of both."""
    b = contrast.cluster_bootstrap(spark, sf_dir).select("split", "low", "mean")
    above, large = F.col("low") > 0.5, F.col("mean") >= 0.7
    reading = F.when(above & large, "substantial").when(above, "present").when(large, "undecided").otherwise("not shown")
    return b.select("split", F.when(above, "PASS").otherwise("KILL").alias("verdict"), F.when(large, "yes").otherwise("no").alias("substantial"), reading.alias("reading"))


def split_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of test items that train or dev items have too, and the items they touch."""
    split = F.when(F.col("doc_id") % 10 <= 5, "train").when(F.col("doc_id") % 10 <= 7, "dev").otherwise("test")
    t = load(spark, sf_dir, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.count_if(split == "test").alias("n_test"), F.count_if(split != "test").alias("n_other"))
    return t.agg(F.count(F.lit(1)).alias("texts"), F.count_if((F.col("n_test") > 0) & (F.col("n_other") > 0)).alias("shared"), F.sum(F.when(F.col("n_other") > 0, F.col("n_test")).otherwise(0)).alias("items"))


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the train and dev splits alone."""
    return complete(spark, sf_dir).where(F.col("split").isin("train", "dev")).groupBy("split", "clause").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("shift")).alias("shift"))


def widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without the text columns and with what every row of the run has."""
    rows = pairs(spark, sf_dir).drop("family", "span_key").withColumns({"layer": F.lit(20), "model": F.lit("m1"), "y": F.col("delta_c") - F.col("delta_b")})
    return rows.groupBy("model", "layer", "split").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("y")).alias("y"))


def planted_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a response holds its condition's key term, in any case: E is asked for B's; empty where no key applies."""
    b = load(spark, sf_dir, "benchmark")
    keys = b.select((F.col("item_id") % 100).alias("item"), F.substring_index("text", " ", 1).alias("w"), "item_id").groupBy("item").agg(F.min_by("w", "item_id").alias("key_b"), F.max_by("w", "item_id").alias("key_c"))
    cond = F.element_at(F.array(*map(F.lit, "ABCDE")), (F.col("doc_id") % 5 + 1).cast("int"))
    r = load(spark, sf_dir, "documents").select((F.col("doc_id") % 120).alias("item"), cond.alias("condition"), "text").join(keys, "item", "left")
    key = F.when(F.col("condition").isin("B", "E"), F.col("key_b")).when(F.col("condition") == "C", F.col("key_c"))
    present = F.when(key.isNull() | (key == ""), "").otherwise(F.contains(F.lower("text"), F.lower(key)).cast("int").cast("string"))
    return r.groupBy("condition", present.alias("present")).agg(F.count(F.lit(1)).alias("n"))


def first_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each response emits first: a tool and its arguments, cut, or the action, the tag and the first line, cut."""
    t = tagged_text(spark, sf_dir)
    call = F.col("doc_id") % 7 == 0
    tool = F.element_at(F.array(*map(F.lit, ("publish_page", "web_search", "other"))), (F.col("doc_id") % 3 + 1).cast("int"))
    text = lambda c: F.when(~call, c).otherwise("")
    return t.select("doc_id", F.when(call, tool).otherwise("").alias("tool"), F.when(call, F.md5(F.left("text", F.lit(ARGS_CHARS)).cast("binary"))).otherwise("").alias("args"), text(action(F.col("text"))).alias("action"), text(first_tag(F.col("text"))).alias("tag"), text(F.left(first_line(F.col("text")), F.lit(LINE_CHARS))).alias("first_line"))


def shard_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of each series put together in order of their start: where each begins in the whole; sizes and seeds must be the same."""
    e = load(spark, sf_dir, "events")
    shards = e.groupBy((F.col("user_id") % 5).alias("series"), F.expr("event_id div 250").alias("shard")).agg(F.min("event_id").alias("start"), F.count(F.lit(1)).alias("n"), F.min("user_id").alias("seed"))
    w = Window.partitionBy("series").orderBy("start")
    placed = shards.withColumn("at", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = lambda c: F.first(c).over(w)
    return placed.select("series", "shard", "at", "n", (F.col("n") == first("n")).cast("int").alias("same_size"), (F.col("seed") == first("seed")).cast("int").alias("same_seed"))


def feature_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The train and dev pools, and the B and C blocks of each; every item is read once and gives a row to both blocks."""
    d = complete(spark, sf_dir)
    block = lambda name, c: F.struct(F.lit(name).alias("block"), F.col(c).alias("x"))
    rows = d.where("split <> 'test'").select("split", F.explode(F.array(block("B", "delta_b"), block("C", "delta_c"))).alias("r")).select("split", "r.*")
    return rows.groupBy("split", "block").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("x")).alias("total"))


def distinct_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts over both members of the pairs."""
    c = load(spark, sf_dir, "conversations")
    both = c.where("turn % 2 = 0").select("text").union(c.where("turn % 2 = 1").select("text")).distinct()
    return both.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def mirror_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with one phrase turned into its mirror, which must occur just once; others are refused, with the reason."""
    phrase, mirror = " la ", " il "
    d = load(spark, sf_dir, "documents").withColumn("k", F.expr(f"(length(text) - length(replace(text, '{phrase}', ''))) div {len(phrase)}"))
    made = F.when(F.col("k") == 1, F.md5(F.replace("text", F.lit(phrase), F.lit(mirror)).cast("binary"))).otherwise("")
    return d.select("doc_id", F.when(F.col("k") == 1, "made").when(F.col("k") == 0, "phrase absent").otherwise("phrase repeated").alias("state"), made.alias("mirror"))


def decoded_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence from each channel's counts."""
    g = load(spark, sf_dir, "events").groupBy((F.col("user_id") % 16).alias("channel")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("kinds"))
    level = F.when(F.col("n") > 300, "bursting").when(F.col("n") > 50, "active").otherwise("quiet")
    return g.select("channel", F.format_string("channel %d is %s: %d spikes of %d kinds", "channel", level, "n", "kinds").alias("text"))


def ordered_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's place in the order of time, by the time as a string, then the id."""
    e = load(spark, sf_dir, "events").select("event_id", F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lpad(F.col("event_id").cast("string"), 20, "0")).alias("key"))
    return numbered(e, None, "key", "place").select("event_id", "place")


def transfer_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each view's summary with its transfer coefficient."""
    out = None
    for name, q in (("full", audit.transfer_coefficient), ("collapsed", audit.collapsed_view)):
        row = q(spark, sf_dir).select(F.lit(name).alias("view"), "*")
        out = row if out is None else out.unionByName(row)
    return out.join(audit.view_summary(spark, sf_dir).select("view", "n", "m1_self", "m2_self", "m1_hist", "m2_hist"), "view")


QUERIES = {
    "unit_semi": unit_semi, "prior_spread": prior_spread, "collapsed_resamples": collapsed_resamples, "class_hits": class_hits, "layer_curve": layer_curve, "key_sets": key_sets, "baseline_effects": effects,
    "probe_verdicts": probe_verdicts, "self_reports": self_reports, "paired_bundle": paired_bundle, "method_contrast": method_contrast, "decisions": decisions, "split_texts": split_texts, "split_rows": split_rows, "widened_rows": widened,
    "planted_terms": planted_terms, "first_emissions": first_emissions, "shard_concat": shard_concat, "feature_blocks": feature_blocks, "distinct_texts": distinct_texts, "mirror_documents": mirror_documents,
    "decoded_statistics": decoded_statistics, "ordered_log": ordered_log, "transfer_views": transfer_views,
}

_W = f"WITH {PAIRS_SQL} "
_PROBES = """, probes AS (SELECT l_orderkey AS item, CASE l_returnflag WHEN 'A' THEN 'B' WHEN 'R' THEN 'C' ELSE 'none' END AS cond, l_linenumber % 2 AS variant, avg(l_quantity) - 25 AS probe FROM lineitem GROUP BY 1, 2, 3),
  prior AS (SELECT clause, arg_max(delta_none, item) AS prior FROM pairs WHERE delta_none IS NOT NULL GROUP BY 1),
  p AS (SELECT r.*, q.clause, CASE r.cond WHEN 'B' THEN delta_b WHEN 'C' THEN delta_c ELSE delta_none END AS delta, prior FROM probes r LEFT JOIN pairs q ON q.item = r.item LEFT JOIN prior USING (clause))"""
_BINOMIAL = contrast._BINOMIAL
ORACLES = {
    "unit_semi": "SELECT label AS clause, count(*) AS n, min(vec_id) AS first FROM embeddings WHERE vec_id % 2 = 0 AND vec_id % 7 <> 0 AND (vec_id + 1) % 7 <> 0 AND vec_id + 1 IN (SELECT vec_id FROM embeddings) GROUP BY 1",
    "prior_spread": _W + "SELECT clause, count(*) AS n, round(max(delta_none) - min(delta_none), 6) AS spread, CASE WHEN max(delta_none) - min(delta_none) <= 1e-12 THEN 'constant' ELSE 'varies' END AS state FROM pairs WHERE delta_none IS NOT NULL GROUP BY 1",
    "collapsed_resamples": _W + ", d AS (SELECT item, span_key, row_number() OVER (ORDER BY item) - 1 AS i, count(*) OVER () AS n FROM complete WHERE split = 'dev'), k AS (SELECT b, i AS slot, ('0x' || substr(md5(b || ':' || i), 1, 8))::BIGINT % n AS i FROM d, (SELECT unnest(range(0, 20)) AS b)), l AS (SELECT b, span_key, arg_max(item, slot) AS item, count(*) AS drawn FROM k JOIN d USING (i) GROUP BY 1, 2) SELECT b::INTEGER AS b, count(*) AS spans, sum(drawn)::BIGINT AS drawn, sum(item)::BIGINT AS items FROM l GROUP BY 1",
    "class_hits": _left_out_sql("clause") + " SELECT CASE WHEN pair % 4 = 0 THEN 'AGREE' ELSE 'CONFLICT' END AS cls, count(*) AS n, round(avg(CASE WHEN margin > 0 THEN 1.0 WHEN margin = 0 THEN 0.5 ELSE 0.0 END), 6) AS accuracy FROM margins GROUP BY 1",
    "layer_curve": layer_sql() + " SELECT count(*)::INTEGER AS layers, count(*) FILTER (accuracy >= 0.8) AS n_high, round(max(accuracy), 6) AS best, (SELECT layer FROM per ORDER BY accuracy DESC, layer LIMIT 1) AS layer FROM per",
    "key_sets": "WITH c AS (SELECT DISTINCT c_custkey AS k FROM customer), o AS (SELECT DISTINCT o_custkey AS k FROM orders), e AS (SELECT DISTINCT user_id AS k FROM events), "
    + ", ".join(f"{n} AS (SELECT count(*) FILTER (b.k IS NULL) AS only_left, count(*) FILTER (a.k IS NULL) AS only_right, count(*) FILTER (a.k = b.k) AS both FROM {a} a FULL JOIN {b} b ON a.k = b.k)" for n, a, b in (("co", "c", "o"), ("oe", "o", "e"), ("ec", "e", "c")))
    + " "
    + " UNION ALL ".join(f"SELECT '{x}' AS left, '{y}' AS right, *, (only_left = 0)::INTEGER AS subset FROM {n}" for n, x, y in (("co", "customers", "orders"), ("oe", "orders", "events"), ("ec", "events", "customers"))),
    "baseline_effects": _W + ", b AS (SELECT clause, item % 2 AS version, avg(delta_none) AS baseline FROM pairs WHERE delta_none IS NOT NULL GROUP BY 1, 2) SELECT p.clause, CASE WHEN item % 3 = 0 THEN 'CONFLICT' ELSE 'AGREE' END AS cls, count(*) AS n, round(avg(CASE WHEN item % 3 = 0 THEN -1 ELSE 1 END * (delta_c - baseline)), 6) AS effect FROM pairs p JOIN b ON b.clause = p.clause AND b.version = item % 2 WHERE delta_c IS NOT NULL GROUP BY 1, 2",
    "probe_verdicts": _W + _PROBES + """, f AS (SELECT count(*) FILTER (sign(m) <> sign(prior)) AS flips FROM (SELECT clause, avg(probe) AS m, max(prior) AS prior FROM p WHERE cond = 'none' AND clause IS NOT NULL GROUP BY 1)),
      w AS (SELECT item, max(probe) FILTER (cond = 'B' AND variant = 0) AS b0, max(probe) FILTER (cond = 'C' AND variant = 0) AS c0, max(probe) FILTER (cond = 'C' AND variant = 1) AS c1, max(delta) FILTER (cond = 'B') AS b, max(delta) FILTER (cond = 'C') AS c FROM p GROUP BY 1),
      s AS (SELECT avg((sign(c0 - b0) = sign(c - b))::INT) AS agreement, avg(abs(c0 - c1)) AS apart, abs(avg(c - b)) / 2 AS half FROM w)
      SELECT flips, CASE WHEN flips > 2 THEN 'KILL' ELSE 'PASS' END AS flip_verdict, round(agreement, 6) AS agreement, round(apart, 6) AS order_difference, round(half, 6) AS half_effect, CASE WHEN apart > half THEN 'KILL' ELSE 'PASS' END AS order_verdict FROM f, s""",
    "self_reports": _W + _PROBES + " SELECT clause, cond, count(*) AS n, round(avg(probe), 6) AS mean, round(avg((probe > 0)::INT), 6) AS positive FROM p WHERE clause IS NOT NULL GROUP BY 1, 2",
    "method_contrast": _W + """, cells AS (SELECT split, clause, sum((delta_c > delta_b)::INT - (delta_c > delta_none)::INT)::BIGINT AS s, count(*) AS n FROM complete WHERE delta_none IS NOT NULL GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY clause) - 1 AS i, count(*) OVER (PARTITION BY split) AS k FROM cells),
      picks AS (SELECT split, b, ('0x' || substr(md5(b || ':' || i), 1, 8))::BIGINT % k AS i FROM o, (SELECT unnest(range(0, 2000)) AS b)), d AS (SELECT p.split, b, sum(s) / sum(n) AS d FROM picks p JOIN o ON o.split = p.split AND o.i = p.i GROUP BY 1, 2),
      g AS (SELECT split, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, round(min(d), 6) AS least, round(max(d), 6) AS most, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS sd FROM d GROUP BY 1)
      SELECT split, sum(n)::BIGINT AS n, round(sum(s) / sum(n), 6) AS difference, any_value(low) AS low, any_value(high) AS high, any_value(least) AS least, any_value(most) AS most, any_value(mean) AS mean, any_value(sd) AS sd, CASE WHEN sum(n) < 10 THEN 'few common items' ELSE '' END AS note FROM cells JOIN g USING (split) GROUP BY 1""",
    "decisions": f"SELECT split, CASE WHEN low > 0.5 THEN 'PASS' ELSE 'KILL' END AS verdict, CASE WHEN mean >= 0.7 THEN 'yes' ELSE 'no' END AS substantial, CASE WHEN low > 0.5 AND mean >= 0.7 THEN 'substantial' WHEN low > 0.5 THEN 'present' WHEN mean >= 0.7 THEN 'undecided' ELSE 'not shown' END AS reading FROM ({contrast.ORACLES['cluster_boot_hash']})",
    "split_texts": "WITH t AS (SELECT text, count(*) FILTER (doc_id % 10 > 7) AS n_test, count(*) FILTER (doc_id % 10 <= 7) AS n_other FROM documents GROUP BY 1) SELECT count(*) AS texts, count(*) FILTER (n_test > 0 AND n_other > 0) AS shared, sum(CASE WHEN n_other > 0 THEN n_test ELSE 0 END)::BIGINT AS items FROM t",
    "split_rows": _W + "SELECT split, clause, count(*) AS n, round(avg(delta_c - delta_b), 6) AS shift FROM complete WHERE split IN ('train', 'dev') GROUP BY 1, 2",
    "widened_rows": _W + "SELECT 'm1' AS model, 20 AS layer, split, count(*) AS n, round(sum(delta_c - delta_b), 6) AS y FROM pairs GROUP BY 3",
    "planted_terms": "WITH k AS (SELECT item_id % 100 AS item, arg_min(split_part(text, ' ', 1), item_id) AS key_b, arg_max(split_part(text, ' ', 1), item_id) AS key_c FROM benchmark GROUP BY 1), r AS (SELECT ['A', 'B', 'C', 'D', 'E'][doc_id % 5 + 1] AS condition, text, key_b, key_c FROM documents LEFT JOIN k ON k.item = doc_id % 120), x AS (SELECT condition, text, CASE WHEN condition IN ('B', 'E') THEN key_b WHEN condition = 'C' THEN key_c END AS key FROM r) SELECT condition, CASE WHEN key IS NULL OR key = '' THEN '' ELSE contains(lower(text), lower(key))::INTEGER::VARCHAR END AS present, count(*) AS n FROM x GROUP BY 1, 2",
    "first_emissions": f"WITH {TAGGED_SQL}, l AS (SELECT doc_id, text, {audit._FIRST_LINE} AS fl, {audit._TAG} AS tag FROM tagged), a AS (SELECT *, CASE WHEN fl LIKE '%action%' THEN coalesce({audit._KEYWORD}, 'action_line_unparsed') ELSE '' END AS action FROM l) SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN ['publish_page', 'web_search', 'other'][doc_id % 3 + 1] ELSE '' END AS tool, CASE WHEN doc_id % 7 = 0 THEN md5(left(text, 2000)) ELSE '' END AS args, CASE WHEN doc_id % 7 = 0 THEN '' ELSE action END AS action, CASE WHEN doc_id % 7 = 0 THEN '' ELSE tag END AS tag, CASE WHEN doc_id % 7 = 0 THEN '' ELSE left(fl, 120) END AS first_line FROM a",
    "shard_concat": "WITH s AS (SELECT user_id % 5 AS series, event_id // 250 AS shard, min(event_id) AS start, count(*) AS n, min(user_id) AS seed FROM events GROUP BY 1, 2) SELECT series, shard, coalesce(sum(n) OVER (PARTITION BY series ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at, n, (n = first(n) OVER (PARTITION BY series ORDER BY start))::INTEGER AS same_size, (seed = first(seed) OVER (PARTITION BY series ORDER BY start))::INTEGER AS same_seed FROM s",
    "feature_blocks": _W + "SELECT split, 'B' AS block, count(*) AS n, round(sum(delta_b), 6) AS total FROM complete WHERE split <> 'test' GROUP BY 1 UNION ALL SELECT split, 'C', count(*), round(sum(delta_c), 6) FROM complete WHERE split <> 'test' GROUP BY 1",
    "distinct_texts": "SELECT count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT DISTINCT text FROM conversations)",
    "mirror_documents": "SELECT doc_id, CASE k WHEN 1 THEN 'made' WHEN 0 THEN 'phrase absent' ELSE 'phrase repeated' END AS state, CASE WHEN k = 1 THEN md5(replace(text, ' la ', ' il ')) ELSE '' END AS mirror FROM (SELECT doc_id, text, (length(text) - length(replace(text, ' la ', ''))) // 4 AS k FROM documents)",
    "decoded_statistics": "SELECT user_id % 16 AS channel, printf('channel %d is %s: %d spikes of %d kinds', user_id % 16, CASE WHEN count(*) > 300 THEN 'bursting' WHEN count(*) > 50 THEN 'active' ELSE 'quiet' END, count(*), count(DISTINCT event_type)) AS text FROM events GROUP BY user_id % 16",
    "ordered_log": "SELECT event_id, row_number() OVER (ORDER BY ts, event_id)::INTEGER AS place FROM events",
    "transfer_views": f"SELECT t.*, s.n, s.m1_self, s.m2_self, s.m1_hist, s.m2_hist FROM (SELECT 'full' AS view, * FROM ({audit.ORACLES['transfer_coefficient']}) UNION ALL SELECT 'collapsed', * FROM ({audit.ORACLES['collapsed_view']})) t JOIN ({audit.ORACLES['view_summary']}) s USING (view)",
    "paired_bundle": _W + f""", g AS (SELECT split, count(*) AS n, count(DISTINCT clause) AS k, round(avg(CASE WHEN delta_c > delta_b THEN 1.0 WHEN delta_c = delta_b THEN 0.5 ELSE 0.0 END::DOUBLE), 6) AS accuracy, count(*) FILTER (delta_c > delta_b) AS wins, count(*) FILTER (delta_c <> delta_b) AS m, round(avg(delta_c - delta_b), 6) AS margin, round(avg(delta_c - delta_b) / stddev_samp(delta_c - delta_b), 6) AS cohen_d FROM complete GROUP BY 1)
      SELECT z.split, z.n, k, accuracy, margin, cohen_d, auroc, low, high, CASE WHEN k > 1 AND k < z.n THEN 'cluster' ELSE 'iid' END AS interval,
        round({_BINOMIAL.format(k='wins', n='m')}, 6) AS sign_p
      FROM g z JOIN ({contrast.ORACLES['cluster_boot_hash']}) b USING (split) JOIN ({contrast.ORACLES['auroc']}) a USING (split)""",
}
