"""Record-level queries: parity of pairs, decompositions, generated probes, containment, baselines by length, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.labels import norm_condition
from ..functions.stats import centred_corr, centred_ranks, hash_draw, r6, settled, wilson
from ..functions.tokens import failure_function, last_occurrence
from ..sources.tables import PAIRS_SQL, load, pair_rows, pairs
from .contrast import complete


def condition_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of conditions brought to B, C or none."""
    raw = F.element_at(F.array(*map(F.lit, ("b", " C ", "no_memory", "prior", "B"))), (F.col("l_orderkey") % 5 + 1).cast("int"))
    return load(spark, sf_dir, "lineitem").groupBy(norm_condition(raw).alias("cond")).agg(F.count(F.lit(1)).alias("n"))


def pair_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a span's pair of turns is not comparable: a member missing, another probe index, length class or record, or nothing.

    The probe index is the place of the last word, in words; the record is a turn's first line.
    """
    member = lambda k, x: F.max(F.when(F.col("turn") % 2 == k, x))
    values = {"i": F.size(F.split("text", " ")), "l": F.expr("length(text) div 100"), "r": F.substring_index("text", "\n", 1)}
    each = [member(k, v).alias(f"{n}{k}") for n, v in values.items() for k in (0, 1)]
    halves = load(spark, sf_dir, "conversations").groupBy("conv_id", F.expr("turn div 2").alias("half"))
    c = halves.agg(F.count_if(F.col("turn") % 2 == 0).alias("n0"), F.count_if(F.col("turn") % 2 == 1).alias("n1"), *each)
    differs = lambda n: ~F.col(f"{n}0").eqNullSafe(F.col(f"{n}1"))
    reason = F.when((F.col("n0") != 1) | (F.col("n1") != 1), "members").when(differs("l"), "length").when(differs("i"), "index").when(differs("r"), "record").otherwise("ok")
    return c.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"))


def prior_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half sum (the prior) and half difference (the swing) of two versions, odd and even items, by clause."""
    z = pairs(spark, sf_dir).where("delta_none is not null").groupBy("clause").agg(F.avg(F.when(F.col("item") % 2 == 0, F.col("delta_none"))).alias("p"), F.avg(F.when(F.col("item") % 2 == 1, F.col("delta_none"))).alias("q"))
    return z.select("clause", r6((F.col("p") + F.col("q")) / 2).alias("prior"), r6((F.col("p") - F.col("q")) / 2).alias("swing"))


def pushed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word an item pushes, by class and version parity; mean effect where the room is large."""
    d = pairs(spark, sf_dir).where("delta_c is not null and delta_none is not null and delta_none < -3")
    same = (F.col("item") % 2) == (F.expr("item div 2") % 2)
    return d.groupBy("clause", F.when(same, "own").otherwise("other").alias("word")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("delta_c") - F.col("delta_none"))).alias("effect"))


def signed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of one class with the other's negated, their mean doubled."""
    d = complete(spark, sf_dir)
    both = d.where("item % 2 = 1").select("split", "shift").unionByName(d.where("item % 2 = 0").select("split", (-F.col("shift")).alias("shift")))
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), r6(2 * F.avg("shift")).alias("contrast"))


def probe_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes: each clause's first two items by three phrasings and three conditions, and the carrier's two further legs."""
    number = F.row_number().over(Window.partitionBy("clause").orderBy("item"))
    first = complete(spark, sf_dir).select("clause", "item", number.alias("k")).where("k <= 2")
    t16 = first.withColumn("variant", F.explode(F.array(*[F.lit(i) for i in range(3)]))).withColumn("cond", F.explode(F.array(F.lit("B"), F.lit("C"), F.lit("none")))).withColumn("test", F.lit("T16"))
    legs = first.where("k = 1").withColumn("variant", F.lit(0)).withColumn("cond", F.explode(F.array(F.lit("B"), F.lit("C")))).withColumn("test", F.explode(F.array(F.lit("T17"), F.lit("T18"))))
    return t16.unionByName(legs.select(*t16.columns)).select("test", "clause", "item", "variant", "cond", F.concat_ws("-", "test", "item", "variant", "cond").alias("probe_id"))


def last_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a document's first two words occur for the last time after its start, by position of the word, and where that span ends; -1 for nowhere else."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.split("text", r"[ \n]").alias("w"))
    starts = F.expr("filter(sequence(2, greatest(size(w) - 1, 2)), i -> try_element_at(w, i) = w[0] AND try_element_at(w, i + 1) = w[1])")
    last = F.coalesce(F.array_max(F.when(F.size("w") >= 3, starts)), F.lit(-1))
    return d.select("doc_id", last.cast("int").alias("last"), F.when(last > 0, last + 2).otherwise(-1).cast("int").alias("end"))


def record_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of spans, one a document: its last one to four words, or for every fifth document its third word alone, twice."""
    w = F.filter(F.split(F.col("text"), r"[ \n]+"), lambda x: x != "")
    d = load(spark, sf_dir, "documents").select("doc_id", w.alias("w")).where(F.size("w") >= 8)
    n = (1 + F.col("doc_id") % 4).cast("int")
    twice = F.array(F.element_at("w", 3), F.element_at("w", 3))
    return d.select("doc_id", F.when(F.col("doc_id") % 5 == 0, twice).otherwise(F.slice("w", F.size("w") - 3, n)).alias("span"))


def span_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the span of a document's record occurs for the last time among its words, and the word after it; -1 for nowhere."""
    w = F.filter(F.split(F.col("text"), r"[ \n]+"), lambda x: x != "")
    tokens = load(spark, sf_dir, "documents").select("doc_id", w.alias("w"))
    spans = record_spans(spark, sf_dir).withColumn("failure", failure_function(F.col("span")))
    found = tokens.join(spans, "doc_id").withColumn("last", last_occurrence(F.col("w"), F.col("span"), F.col("failure")))
    return found.select("doc_id", F.size("span").alias("size"), "last", F.when(F.col("last") > 0, F.col("last") + F.size("span")).otherwise(-1).alias("end"))


def length_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired accuracy of text length alone; the sign is picked on one part of the conversations and judged on the other."""
    size = lambda k: F.max(F.when(F.col("turn") % 2 == k, F.length("text")))
    c = load(spark, sf_dir, "conversations").groupBy("conv_id", F.expr("turn div 2").alias("half")).agg(size(0).alias("b"), size(1).alias("c")).where("b is not null and c is not null")
    win = F.when(F.col("c") > F.col("b"), 1.0).when(F.col("c") == F.col("b"), 0.5).otherwise(0.0)
    g = c.agg(F.avg(F.when(F.col("conv_id") % 3 == 0, win)).alias("dev"), F.avg(F.when(F.col("conv_id") % 3 != 0, win)).alias("test"), F.count(F.lit(1)).alias("n"))
    longer = F.col("dev") >= 0.5
    return g.select("n", F.when(longer, "longer").otherwise("shorter").alias("sign"), r6(F.when(longer, F.col("test")).otherwise(1 - F.col("test"))).alias("accuracy"))


def length_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the study whose items' texts have nearly one length: how they do, and the rank correlation of shift and length difference, beside all pairs."""
    n = load(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    d = complete(spark, sf_dir).join(n.select(F.col("doc_id").alias("item"), F.col("n").alias("nb")), "item").join(n.select((F.col("doc_id") - 1).alias("item"), F.col("n").alias("nc")), "item")
    d = d.withColumn("apart", F.col("nc") - F.col("nb")).withColumn("near", F.abs("apart") * 2 <= F.col("nb"))
    both = d.withColumn("subset", F.explode(F.when(F.col("near"), F.array(F.lit("all"), F.lit("matched"))).otherwise(F.array(F.lit("all")))))
    cells = both.groupBy("subset", "shift", "apart").agg(F.count(F.lit(1)).alias("items")).persist()
    ranked = centred_ranks(cells, "subset", "items", {"shift": "rs", "apart": "ra"})
    win = F.when(F.col("shift") > 0, 1.0).when(F.col("shift") == 0, 0.5).otherwise(0.0)
    mean = lambda x: r6(F.sum(F.col("items") * x) / F.sum("items"))
    return settled(ranked.groupBy("subset").agg(F.sum("items").alias("n"), mean(win).alias("accuracy"), mean(F.col("shift")).alias("margin"), r6(centred_corr(F.col("rs"), F.col("ra"), F.col("items"))).alias("rho")), cells)  # two rows


def seed_stability(spark: SparkSession, sf_dir: str, draws: int = 2000) -> DataFrame:
    """The largest move of a cluster bootstrap's bounds over four seeds."""
    cells = complete(spark, sf_dir).groupBy("clause").agg(F.sum("shift").alias("s"), F.count(F.lit(1)).alias("n"))
    ordered = cells.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("clause")) - 1).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))  # a row for each clause
    picks = ordered.select("k", F.col("i").alias("slot")).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    means = picks.withColumn("i", hash_draw(F.col("k"), F.col("seed"), F.col("b"), F.col("slot"))).join(ordered.select("i", "s", "n"), "i").groupBy("seed", "b").agg((F.sum("s") / F.sum("n")).alias("m"))
    bounds = means.groupBy("seed").agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    base = lambda c: F.max(F.when(F.col("seed") == 0, F.col(c)))
    return bounds.agg(r6(F.greatest(F.max("low") - base("low"), base("low") - F.min("low"), F.max("high") - base("high"), base("high") - F.min("high"))).alias("largest_move"))


def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohen's kappa of consecutive events' types by user group, with Wilson's interval of the raw agreement (extensions)."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = load(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("grp"), F.col("event_type").alias("y"), F.lag("event_type").over(w).alias("x")).where("x is not null")
    cells = e.groupBy("grp", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    ends = cells.select("grp", "n", F.explode(F.array(F.struct(F.lit("x").alias("s"), F.col("x").alias("v")), F.struct(F.lit("y").alias("s"), F.col("y").alias("v")))).alias("m")).select("grp", "n", "m.*")
    sides = ends.groupBy("grp", "v").agg(F.sum(F.when(F.col("s") == "x", F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("s") == "y", F.col("n")).otherwise(0)).alias("b"))
    chance = sides.groupBy("grp").agg(F.sum(F.col("a").cast("double") * F.col("b")).alias("ab"))
    seen = cells.groupBy("grp").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    j = seen.join(chance, "grp").withColumn("pe", F.col("ab") / F.col("n") / F.col("n")).withColumn("po", F.col("same") / F.col("n"))
    low, high = wilson(F.col("same"), F.col("n"))
    return j.select("grp", "n", r6((F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"), r6(low).alias("low"), r6(high).alias("high"))


def orphan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys on one side only, of items with rows and items with an entry, and keys with more than one row."""
    rows = pair_rows(spark, sf_dir).groupBy("item", "cond").agg(F.count(F.lit(1)).alias("n"))
    items = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"))
    have = rows.groupBy("item").agg(F.count_if(F.col("n") > 1).alias("twice"))
    both = items.withColumn("listed", F.lit(True)).join(have.withColumn("seen", F.lit(True)), "item", "full_outer")
    return both.groupBy(F.when(F.col("listed").isNull(), "orphan").when(F.col("seen").isNull(), "no rows").otherwise("ok").alias("state")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("twice"), F.lit(0)).alias("twice"))


QUERIES = {
    "condition_names": condition_names, "pair_parity": pair_parity, "prior_decomposition": prior_decomposition, "pushed_words": pushed_words, "signed_union": signed_union, "probe_items": probe_items, "last_containment": last_containment, "span_containment": span_containment,
    "length_baseline": length_baseline, "length_matched": length_matched, "seed_stability": seed_stability, "kappa": kappa, "orphan_rows": orphan_rows,
}
_W = f"WITH {PAIRS_SQL} "
_TURNS = "turns AS (SELECT conv_id, turn // 2 AS half, max(length(text)) FILTER (turn % 2 = 0) AS la, max(length(text)) FILTER (turn % 2 = 1) AS lb FROM conversations GROUP BY 1, 2)"
ORACLES = {
    "condition_names": "SELECT CASE l_orderkey % 5 WHEN 0 THEN 'B' WHEN 4 THEN 'B' WHEN 1 THEN 'C' ELSE 'none' END AS cond, count(*) AS n FROM lineitem GROUP BY 1",
    "pair_parity": """WITH m AS (SELECT conv_id, turn // 2 AS half, turn % 2 AS turn, len(string_split(text, ' ')) AS i, length(text) // 100 AS l, split_part(text, chr(10), 1) AS r FROM conversations),
      p AS (SELECT conv_id, count(*) FILTER (turn = 0) AS n0, count(*) FILTER (turn = 1) AS n1, max(i) FILTER (turn = 0) AS i0, max(i) FILTER (turn = 1) AS i1, max(l) FILTER (turn = 0) AS l0, max(l) FILTER (turn = 1) AS l1, max(r) FILTER (turn = 0) AS r0, max(r) FILTER (turn = 1) AS r1 FROM m GROUP BY conv_id, half)
      SELECT CASE WHEN n0 <> 1 OR n1 <> 1 THEN 'members' WHEN l0 <> l1 THEN 'length' WHEN i0 <> i1 THEN 'index' WHEN r0 <> r1 THEN 'record' ELSE 'ok' END AS reason, count(*) AS n, min(conv_id) AS first FROM p GROUP BY 1""",
    "prior_decomposition": _W + ", z AS (SELECT clause, avg(delta_none) FILTER (item % 2 = 0) AS p, avg(delta_none) FILTER (item % 2 = 1) AS q FROM pairs WHERE delta_none IS NOT NULL GROUP BY 1) SELECT clause, round((p + q) / 2, 6) AS prior, round((p - q) / 2, 6) AS swing FROM z",
    "pushed_words": _W + "SELECT clause, CASE WHEN item % 2 = (item // 2) % 2 THEN 'own' ELSE 'other' END AS word, count(*) AS n, round(avg(delta_c - delta_none), 6) AS effect FROM pairs WHERE delta_c IS NOT NULL AND delta_none < -3 GROUP BY 1, 2",
    "signed_union": _W + "SELECT split, count(*) AS n, round(2 * avg(CASE WHEN item % 2 = 1 THEN delta_c - delta_b ELSE delta_b - delta_c END), 6) AS contrast FROM complete GROUP BY 1",
    "probe_items": _W + ", f AS (SELECT clause, item, row_number() OVER (PARTITION BY clause ORDER BY item) AS k FROM complete QUALIFY k <= 2), p AS (SELECT 'T16' AS test, clause, item, v.variant::INTEGER AS variant, c.cond FROM f, (SELECT unnest(range(0, 3)) AS variant) v, (SELECT unnest(['B', 'C', 'none']) AS cond) c UNION ALL SELECT t.test, clause, item, 0, c.cond FROM f, (SELECT unnest(['T17', 'T18']) AS test) t, (SELECT unnest(['B', 'C']) AS cond) c WHERE k = 1) SELECT *, test || '-' || item || '-' || variant || '-' || cond AS probe_id FROM p",
    "span_containment": """WITH w AS (SELECT doc_id, [x FOR x IN string_split_regex(text, '[ \\n]+') IF x <> ''] AS w FROM documents),
      s AS (SELECT doc_id, w, CASE WHEN doc_id % 5 = 0 THEN [w[3], w[3]] ELSE w[len(w) - 3 : len(w) - 3 + doc_id % 4] END AS span FROM w WHERE len(w) >= 8),
      l AS (SELECT doc_id, len(span)::INTEGER AS size, coalesce(list_max([i FOR i IN range(1, len(w) - len(span) + 2) IF w[i] = span[1] AND w[i : i + len(span) - 1] = span]), -1)::INTEGER AS last FROM s)
      SELECT doc_id, size, last, CASE WHEN last > 0 THEN last + size ELSE -1 END AS end FROM l""",
    "last_containment": "WITH w AS (SELECT doc_id, string_split_regex(text, '[ \\n]') AS w FROM documents), l AS (SELECT doc_id, coalesce(list_max([i FOR i IN range(2, len(w)) IF w[i] = w[1] AND w[i+1] = w[2]]), -1)::INTEGER AS last FROM w) SELECT doc_id, last, CASE WHEN last > 0 THEN last + 2 ELSE -1 END::INTEGER AS end FROM l",
    "length_baseline": f"WITH {_TURNS}, s AS (SELECT conv_id, CASE WHEN lb > la THEN 1.0 WHEN lb = la THEN 0.5 ELSE 0.0 END::DOUBLE AS win FROM turns WHERE la IS NOT NULL AND lb IS NOT NULL), g AS (SELECT count(*) AS n, avg(win) FILTER (conv_id % 3 = 0) AS dev, avg(win) FILTER (conv_id % 3 <> 0) AS test FROM s) SELECT n, CASE WHEN dev >= 0.5 THEN 'longer' ELSE 'shorter' END AS sign, round(CASE WHEN dev >= 0.5 THEN test ELSE 1 - test END, 6) AS accuracy FROM g",
    "length_matched": _W + """, d AS (SELECT delta_c - delta_b AS shift, length(c.text) - length(b.text) AS apart, abs(length(c.text) - length(b.text)) * 2 <= length(b.text) AS near FROM complete JOIN documents b ON b.doc_id = item JOIN documents c ON c.doc_id = item + 1),
      s AS (SELECT 'all' AS subset, shift, apart FROM d UNION ALL SELECT 'matched', shift, apart FROM d WHERE near),
      r AS (SELECT subset, shift, rank() OVER (PARTITION BY subset ORDER BY shift) + (count(*) OVER (PARTITION BY subset, shift) - 1) / 2 AS rs, rank() OVER (PARTITION BY subset ORDER BY apart) + (count(*) OVER (PARTITION BY subset, apart) - 1) / 2 AS ra FROM s)
      SELECT subset, count(*) AS n, round(avg(CASE WHEN shift > 0 THEN 1.0 WHEN shift = 0 THEN 0.5 ELSE 0.0 END::DOUBLE), 6) AS accuracy, round(avg(shift), 6) AS margin, CASE WHEN count(*) >= 3 THEN round(corr(rs, ra), 6) END AS rho FROM r GROUP BY 1""",
    "seed_stability": _W + ", cells AS (SELECT sum(delta_c - delta_b) AS s, count(*) AS n, row_number() OVER (ORDER BY clause) - 1 AS i, count(*) OVER () AS k FROM complete GROUP BY clause), picks AS (SELECT seed, b, ('0x' || substr(md5(seed || ':' || b || ':' || i), 1, 8))::BIGINT % k AS i FROM cells, (SELECT unnest(range(0, 4)) AS seed), (SELECT unnest(range(0, 2000)) AS b)), means AS (SELECT seed, b, sum(s) / sum(n) AS m FROM picks JOIN cells USING (i) GROUP BY 1, 2), bounds AS (SELECT seed, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM means GROUP BY 1), z AS (SELECT * FROM bounds WHERE seed = 0) SELECT round(max(greatest(abs(b.low - z.low), abs(b.high - z.high))), 6) AS largest_move FROM bounds b, z",
    "kappa": "WITH e AS (SELECT user_id % 3 AS grp, event_type AS y, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS x FROM events), f AS (SELECT * FROM e WHERE x IS NOT NULL), g AS (SELECT grp, count(*) AS n, count(*) FILTER (x = y) AS same FROM f GROUP BY 1), a AS (SELECT grp, x AS v, count(*) AS a FROM f GROUP BY 1, 2), b AS (SELECT grp, y AS v, count(*) AS b FROM f GROUP BY 1, 2), c AS (SELECT a.grp, sum(a * b) AS ab FROM a JOIN b ON a.grp = b.grp AND a.v = b.v GROUP BY 1), k AS (SELECT grp, n, same / n AS p, ab / n / n AS pe, 1.959963984540054::DOUBLE AS z FROM g JOIN c USING (grp)) SELECT grp, n, round((p - pe) / (1 - pe), 6) AS kappa, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS high FROM k",
    "orphan_rows": "WITH r AS (SELECT DISTINCT l_orderkey AS item FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) SELECT CASE WHEN o.o_orderkey IS NULL THEN 'orphan' WHEN r.item IS NULL THEN 'no rows' ELSE 'ok' END AS state, count(*) AS n, 0::BIGINT AS twice FROM orders o FULL JOIN r ON r.item = o.o_orderkey GROUP BY 1",
}
