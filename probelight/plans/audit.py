"""Queries on the run log: modal actions per point and arm, transfer, drift against history, labels of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels as L
from ..functions.stats import hash_draw, r6
from ..operators import dedup
from ..operators.order import numbered
from ..sources.tables import RUNS_SQL, TAGGED_SQL, load, points, runs, tagged_text


def kept_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with each repetition once and failures gone; first_ord orders ties."""
    log = runs(spark, sf_dir)
    return dedup.first_success(log, ["pid", "arm", "rep"], "ord", F.col("label") == "error").where("label <> 'error'")


def label_counts(kept: DataFrame, *by: str) -> DataFrame:
    return kept.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"), F.min("first_ord").alias("seen"))


def modes(counts: DataFrame, *by: str) -> DataFrame:
    """The commonest label of each group, the first seen of equals, and its share."""
    top = F.max_by("label", F.struct("n", -F.col("seen")))
    return counts.groupBy(*by).agg(top.alias("modal"), (F.max("n") / F.sum("n")).alias("share"))


def point_table(spark: SparkSession, sf_dir: str, view=lambda c: c) -> DataFrame:
    """One row a point: modal label and share of each arm, agreement of M2 with M1's mode, match with history."""
    kept = kept_runs(spark, sf_dir).withColumn("label", view(F.col("label")))
    about = points(spark, sf_dir).withColumn("hist", view(F.col("hist")))
    counts = label_counts(kept, "pid", "arm")
    top = modes(counts, "pid", "arm").groupBy("pid").pivot("arm", ["M1", "M2"]).agg(F.first("modal").alias("modal"), F.first("share").alias("share"))
    base = about.join(top, "pid", "left")
    rate = lambda arm, goal: F.coalesce(F.try_divide(F.sum(F.when((F.col("arm") == arm) & (F.col("label") == F.col(goal)), F.col("n"))), F.sum(F.when(F.col("arm") == arm, F.col("n")))), F.lit(0.0))
    keys = ["pid", "kind", "hist", "M1_modal", "M1_share", "M2_modal", "M2_share"]
    full = base.join(counts.select("pid", "arm", "label", "n"), "pid", "left").groupBy(*keys).agg(rate("M2", "M1_modal").alias("m2_to_m1"), rate("M1", "hist").alias("m1_vs_hist"), rate("M2", "hist").alias("m2_vs_hist"))
    return full.select(
        "pid", "kind", "hist", F.col("M1_modal").alias("m1_modal"), r6(F.coalesce("M1_share", F.lit(0.0))).alias("m1_share"), F.col("M2_modal").alias("m2_modal"), r6(F.coalesce("M2_share", F.lit(0.0))).alias("m2_share"),
        r6(F.col("m2_to_m1")).alias("m2_to_m1"), r6(F.col("m1_vs_hist")).alias("m1_vs_hist"), r6(F.col("m2_vs_hist")).alias("m2_vs_hist"),
    )


def audit_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return point_table(spark, sf_dir)


def point_sql(view: str = "{}") -> str:
    return f"""{RUNS_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY pid, arm, rep ORDER BY (label = 'error')::INT, ord) AS rn, min(ord) OVER (PARTITION BY pid, arm, rep) AS first_ord, count(*) OVER (PARTITION BY pid, arm, rep) - 1 AS n_extra FROM runs
), kept AS (SELECT pid, arm, rep, {view.format('label')} AS label, first_ord, n_extra FROM ranked WHERE rn = 1 AND label <> 'error'),
about AS (SELECT pid, kind, {view.format('hist')} AS hist FROM points),
cells AS (SELECT pid, arm, label, count(*) AS n, min(first_ord) AS seen FROM kept GROUP BY 1, 2, 3),
best AS (SELECT pid, arm, label AS modal, n / sum(n) OVER (PARTITION BY pid, arm) AS share, row_number() OVER (PARTITION BY pid, arm ORDER BY n DESC, seen) AS rn FROM cells),
m1 AS (SELECT * FROM best WHERE arm = 'M1' AND rn = 1), m2 AS (SELECT * FROM best WHERE arm = 'M2' AND rn = 1),
point_table AS (
  SELECT p.pid, p.kind, p.hist, m1.modal AS m1_modal, round(coalesce(m1.share, 0), 6) AS m1_share, m2.modal AS m2_modal, round(coalesce(m2.share, 0), 6) AS m2_share,
    round(coalesce((SELECT avg((k.label = m1.modal)::INT) FROM kept k WHERE k.pid = p.pid AND k.arm = 'M2' AND m1.modal IS NOT NULL), 0), 6) AS m2_to_m1,
    round(coalesce((SELECT avg((k.label = p.hist)::INT) FROM kept k WHERE k.pid = p.pid AND k.arm = 'M1'), 0), 6) AS m1_vs_hist,
    round(coalesce((SELECT avg((k.label = p.hist)::INT) FROM kept k WHERE k.pid = p.pid AND k.arm = 'M2'), 0), 6) AS m2_vs_hist
  FROM about p LEFT JOIN m1 ON m1.pid = p.pid LEFT JOIN m2 ON m2.pid = p.pid
)"""


COLLAPSE_SQL = "CASE WHEN {0} IN ('purchase', 'signup') THEN {0} ELSE 'no_tool' END"


def collapse_events(label: Column) -> Column:
    """The two-way view on this log's labels: two of its event types stand for tool classes."""
    return F.when(label.isin("purchase", "signup"), label).otherwise("no_tool")


def _coefficient(table: DataFrame, *by: str) -> DataFrame:
    """Ratio of means over points that have both arms and a share: agreement over M1's own."""
    both = F.col("m1_modal").isNotNull() & F.col("m2_modal").isNotNull() & (F.col("m1_share") > 0)
    agg = [F.count_if(both).alias("n_points"), r6(F.avg(F.when(both, F.col("m1_share")))).alias("m1_ceiling"), r6(F.avg(F.when(both, F.col("m2_to_m1")))).alias("agreement"), r6(F.try_divide(F.avg(F.when(both, F.col("m2_to_m1"))), F.avg(F.when(both, F.col("m1_share"))))).alias("transfer")]
    return table.groupBy(*by).agg(*agg) if by else table.agg(*agg)


COEFFICIENT_SQL = """count(*) FILTER (ok) AS n_points, round(avg(m1_share) FILTER (ok), 6) AS m1_ceiling, round(avg(m2_to_m1) FILTER (ok), 6) AS agreement, round((avg(m2_to_m1) FILTER (ok)) / (avg(m1_share) FILTER (ok)), 6) AS transfer
FROM (SELECT *, m1_modal IS NOT NULL AND m2_modal IS NOT NULL AND m1_share > 0 AS ok FROM point_table)"""


def transfer_coefficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefficient(point_table(spark, sf_dir))


def per_kind_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.createDataFrame([(k,) for k in ("genesis", "probe", "optout", "absent")], "kind string")
    found = _coefficient(point_table(spark, sf_dir), "kind")
    out = kinds.join(found, "kind", "left")
    return out.select("kind", F.coalesce("n_points", F.lit(0)).alias("n_points"), "m1_ceiling", "agreement", "transfer", F.when(F.coalesce("n_points", F.lit(0)) > 0, "complete").otherwise("incomplete").alias("state"))


def collapsed_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefficient(point_table(spark, sf_dir, collapse_events))


def view_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a view: coefficients and both history rates."""
    def row(name: str, view) -> DataFrame:
        table = point_table(spark, sf_dir, view)
        rates = table.where("m1_modal is not null and m2_modal is not null").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("m1_share")).alias("m1_self"), r6(F.avg("m2_share")).alias("m2_self"), r6(F.avg("m2_to_m1")).alias("agreement"), r6(F.avg("m1_vs_hist")).alias("m1_hist"), r6(F.avg("m2_vs_hist")).alias("m2_hist"))
        return rates.select(F.lit(name).alias("view"), "*")

    return row("full", lambda c: c).unionByName(row("collapsed", collapse_events))


def _summary_sql(name: str, view: str) -> str:
    return f"""(WITH {point_sql(view)} SELECT '{name}' AS view, count(*) AS n, round(avg(m1_share), 6) AS m1_self, round(avg(m2_share), 6) AS m2_self, round(avg(m2_to_m1), 6) AS agreement, round(avg(m1_vs_hist), 6) AS m1_hist, round(avg(m2_vs_hist), 6) AS m2_hist FROM point_table WHERE m1_modal IS NOT NULL AND m2_modal IS NOT NULL)"""


def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by arm, and of history, over genesis points."""
    about = points(spark, sf_dir).where("kind = 'genesis'")
    per_arm = kept_runs(spark, sf_dir).join(about.select("pid"), "pid").groupBy("arm", "label").agg(F.count(F.lit(1)).alias("n"))
    return per_arm.unionByName(about.groupBy(F.lit("history").alias("arm"), F.col("hist").alias("label")).agg(F.count(F.lit(1)).alias("n")))


def vs_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = kept_runs(spark, sf_dir).join(points(spark, sf_dir), "pid")
    return joined.groupBy("kind", "arm").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("label") == F.col("hist")).cast("int"))).alias("rate"))


def dedup_first_non_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_runs(spark, sf_dir).select("pid", "arm", "rep", "label", "first_ord", "n_extra")


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_row(runs(spark, sf_dir), ["pid", "arm", "rep"], "ord").where("label <> 'error'").select("pid", "arm", "rep", "label", "ord")


def dedup_last_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.last_row(runs(spark, sf_dir).where("label <> 'error'"), ["pid", "arm", "rep"], "ord").select("pid", "arm", "rep", "label", "ord")


def performative_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every response of each source that opens with a tag, as one list in order, with its tag."""
    uses = tagged_text(spark, sf_dir).where(L.leads_with_tag(F.col("text"))).select("source", "doc_id", L.first_tag(F.col("text")).alias("tag"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "tag"))), lambda u: F.concat_ws(":", u["doc_id"].cast("string"), u["tag"])), ",")
    return uses.groupBy("source", F.expr("doc_id div 1000").alias("slice")).agg(F.count(F.lit(1)).alias("n"), listed.alias("uses"))


def run_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls per day by the time stamp's prefix, with the range of ordinals."""
    e = load(spark, sf_dir, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.count_if(F.col("event_type") == "error").alias("n_error"))


def use_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tagged_text(spark, sf_dir)
    tag = F.when(L.first_tag(F.col("text")) == "", "none").otherwise(L.first_tag(F.col("text")))
    return t.groupBy("source", L.use_or_mention(F.col("text")).alias("how"), tag.alias("any_tag")).agg(F.count(F.lit(1)).alias("n"))


def tag_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged_text(spark, sf_dir).select("doc_id", L.tags(F.col("text"), True).alias("valid"), L.tags(F.col("text"), False).alias("invalid"))


def marker_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("text").rlike(r"(?iu)(il est|licensed under|è)").cast("int").alias("marked"))


def key_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an item's key term occurs, in any case: the first word of the document before it; empty where there is none."""
    d = load(spark, sf_dir, "documents")
    keys = d.select((F.col("doc_id") + 1).alias("doc_id"), F.substring_index("text", " ", 1).alias("key"))
    present = F.when(F.col("key").isNull() | (F.col("key") == ""), "").otherwise(F.contains(F.lower("text"), F.lower("key")).cast("int").cast("string"))
    return d.join(keys, "doc_id", "left").select("doc_id", present.alias("present"))


def text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both coarse labels, the parsed action and the first line of every response."""
    t = tagged_text(spark, sf_dir).withColumn("kind", F.when(F.col("doc_id") % 7 == 0, "tool_call").otherwise("text"))
    tool = F.element_at(F.array(*map(F.lit, ("publish_page", "web_search", "other"))), (F.col("doc_id") % 3 + 1).cast("int"))
    text = F.col("text")
    return t.select("doc_id", L.coarse_by_action(F.col("kind"), tool, text).alias("by_action"), L.coarse_by_keyword(F.col("kind"), tool, text).alias("by_keyword"), L.action(text).alias("action"), F.left(L.first_line(text), F.lit(120)).alias("first_line"))


def history_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tagged_text(spark, sf_dir)
    tool = F.when(F.col("doc_id") % 4 == 0, "read_page").otherwise("")
    flagged = F.col("text").contains("[OPT-OUT-HARD]")
    return t.select("doc_id", L.history_tool_first(tool, flagged, F.col("text")).alias("tool_first"), L.history_tag_first(tool, flagged, F.col("text")).alias("tag_first"))


def squeeze_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", L.squeezed(F.col("text"), 80).alias("line"))


def ratio_bootstrap(spark: SparkSession, sf_dir: str, draws: int = 1000) -> DataFrame:
    """Transfer coefficient over hashed resamples of points; the interval takes order statistics, without interpolation.

    Picks are as many as points by draws, made from the numbers of the points. They meet the points by a shuffled join
    that builds on the points, so neither side goes through the driver; what is shuffled after it is a partial sum per draw.
    """
    table = point_table(spark, sf_dir).where("m1_modal is not null and m2_modal is not null and m1_share > 0")
    placed = numbered(table.select("pid", "m1_share", "m2_to_m1"), None, "pid", "i").withColumn("i", F.col("i").cast("bigint") - 1)
    n = table.count()
    picks = spark.range(n).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b")).select("b", hash_draw(F.lit(n), F.col("b"), F.col("k")).alias("i"))
    ratios = picks.join(placed.hint("shuffle_hash"), "i").groupBy("b").agg((F.sum("m2_to_m1") / F.sum("m1_share")).alias("ratio"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ratio"))
    ordered = ratios.withColumn("place", place)
    low, high = draws * 25 // 1000, draws * 975 // 1000
    return ordered.agg(r6(F.max(F.when(F.col("place") == low, F.col("ratio")))).alias("low"), r6(F.max(F.when(F.col("place") == high, F.col("ratio")))).alias("high"), r6(F.avg("ratio")).alias("mean"))


_FIRST_LINE = "lower(split_part(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), 1))"
_LEADS = "starts_with(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '[OPT-OUT-')"
_TAG = "regexp_extract(text, '\\[OPT-OUT-(HARD|SOFT|CURIOUS)\\]', 1)"
_KEYWORD = "CASE WHEN fl LIKE '%declined%' THEN 'declined' WHEN fl LIKE '%revised_goals%' THEN 'revised_goals' WHEN fl LIKE '%publish_intent%' THEN 'publish_intent' WHEN fl LIKE '%reflected%' THEN 'reflected' END"
_KEYWORD_LABEL = "CASE WHEN fl LIKE '%declined%' THEN 'decline' WHEN fl LIKE '%revised_goals%' THEN 'goal_op' WHEN fl LIKE '%publish_intent%' THEN 'publish' WHEN fl LIKE '%reflected%' THEN 'reflect' ELSE 'text' END"
_LABELLED = f"""{TAGGED_SQL}, lined AS (SELECT doc_id, text, {_FIRST_LINE} AS fl, {_LEADS} AS leads, {_TAG} AS tag,
  CASE doc_id % 3 WHEN 0 THEN 'publish' WHEN 1 THEN 'search' ELSE 'tool_other' END AS tool FROM tagged),
acted AS (SELECT *, CASE WHEN fl LIKE '%action%' THEN coalesce({_KEYWORD}, 'action_line_unparsed') ELSE '' END AS action FROM lined)"""

QUERIES = {
    "audit_points": audit_points, "transfer_coefficient": transfer_coefficient, "per_kind_coefficients": per_kind_coefficients, "collapsed_view": collapsed_view, "view_summary": view_summary,
    "label_distribution": label_distribution, "vs_history": vs_history, "dedup_first_non_error": dedup_first_non_error, "dedup_first": dedup_first, "dedup_last_success": dedup_last_success,
    "performative_uses": performative_uses, "calls_per_day": run_label_counts, "use_mention": use_mention, "tag_partition": tag_partition, "marker_regex": marker_regex, "key_term": key_term,
    "text_labels": text_labels, "history_labels": history_labels, "squeeze_truncate": squeeze_truncate, "ratio_boot_orderstat": ratio_bootstrap,
}
_WITH = f"WITH {point_sql()} "
ORACLES = {
    "audit_points": _WITH + "SELECT * FROM point_table",
    "transfer_coefficient": _WITH + "SELECT " + COEFFICIENT_SQL,
    "per_kind_coefficients": _WITH + "SELECT k.kind, coalesce(n_points, 0) AS n_points, m1_ceiling, agreement, transfer, CASE WHEN coalesce(n_points, 0) > 0 THEN 'complete' ELSE 'incomplete' END AS state FROM (SELECT unnest(['genesis', 'probe', 'optout', 'absent']) AS kind) k LEFT JOIN (SELECT kind, " + COEFFICIENT_SQL + " GROUP BY kind) c USING (kind)",
    "collapsed_view": f"WITH {point_sql(COLLAPSE_SQL)} SELECT " + COEFFICIENT_SQL,
    "view_summary": f"SELECT * FROM {_summary_sql('full', '{}')} UNION ALL SELECT * FROM {_summary_sql('collapsed', COLLAPSE_SQL)}",
    "label_distribution": _WITH + "SELECT arm, label, count(*) AS n FROM kept JOIN points USING (pid) WHERE kind = 'genesis' GROUP BY 1, 2 UNION ALL SELECT 'history', hist, count(*) FROM points WHERE kind = 'genesis' GROUP BY 1, 2",
    "vs_history": _WITH + "SELECT kind, arm, count(*) AS n, round(avg((label = hist)::INT), 6) AS rate FROM kept JOIN points USING (pid) GROUP BY 1, 2",
    "dedup_first_non_error": _WITH + "SELECT pid, arm, rep, label, first_ord, n_extra FROM kept",
    "dedup_first": f"WITH {RUNS_SQL} SELECT pid, arm, rep, label, ord FROM runs QUALIFY row_number() OVER (PARTITION BY pid, arm, rep ORDER BY ord) = 1 AND label <> 'error'",
    "dedup_last_success": f"WITH {RUNS_SQL} SELECT pid, arm, rep, label, ord FROM runs WHERE label <> 'error' QUALIFY row_number() OVER (PARTITION BY pid, arm, rep ORDER BY ord DESC) = 1",
    "performative_uses": f"WITH {TAGGED_SQL} SELECT source, doc_id // 1000 AS slice, count(*) AS n, string_agg(doc_id || ':' || {_TAG}, ',' ORDER BY doc_id) AS uses FROM tagged WHERE {_LEADS} GROUP BY 1, 2",
    "calls_per_day": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, min(event_id) AS first, max(event_id) AS last, count(*) FILTER (event_type = 'error') AS n_error FROM events GROUP BY 1",
    "use_mention": f"WITH {TAGGED_SQL} SELECT source, CASE WHEN {_LEADS} THEN 'use' WHEN {_TAG} <> '' THEN 'mention' ELSE 'none' END AS how, CASE WHEN {_TAG} = '' THEN 'none' ELSE {_TAG} END AS any_tag, count(*) AS n FROM tagged GROUP BY 1, 2, 3",
    "tag_partition": f"WITH {TAGGED_SQL}, found AS (SELECT doc_id, regexp_extract_all(text, '\\[OPT-OUT-([A-Z]+)\\]', 1) AS t FROM tagged) SELECT doc_id, array_to_string([x FOR x IN t IF x IN ('HARD', 'SOFT', 'CURIOUS')], ';') AS valid, array_to_string([x FOR x IN t IF x NOT IN ('HARD', 'SOFT', 'CURIOUS')], ';') AS invalid FROM found",
    "marker_regex": "SELECT doc_id, regexp_matches(text, '(?i)(il est|licensed under|è)')::INTEGER AS marked FROM documents",
    "key_term": "SELECT d.doc_id, CASE WHEN k.doc_id IS NULL OR split_part(k.text, ' ', 1) = '' THEN '' ELSE contains(lower(d.text), lower(split_part(k.text, ' ', 1)))::INTEGER::VARCHAR END AS present FROM documents d LEFT JOIN documents k ON k.doc_id + 1 = d.doc_id",
    "text_labels": f"""WITH {_LABELLED} SELECT doc_id,
      CASE WHEN doc_id % 7 = 0 THEN tool WHEN tag <> '' AND leads THEN 'optout' WHEN action = 'publish_intent' THEN 'publish' WHEN action = 'revised_goals' THEN 'goal_op' WHEN action = 'reflected' THEN 'reflect' WHEN action = 'declined' THEN 'decline' ELSE 'text' END AS by_action,
      CASE WHEN tag <> '' AND leads THEN 'optout' WHEN doc_id % 7 = 0 THEN tool ELSE {_KEYWORD_LABEL} END AS by_keyword, action, left(fl, 120) AS first_line FROM acted""",
    "history_labels": f"""WITH {_LABELLED} SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'read' WHEN contains(text, '[OPT-OUT-HARD]') AND leads THEN 'optout' ELSE {_KEYWORD_LABEL} END AS tool_first,
      CASE WHEN contains(text, '[OPT-OUT-HARD]') AND leads THEN 'optout' WHEN doc_id % 4 = 0 THEN 'read' ELSE {_KEYWORD_LABEL} END AS tag_first FROM acted""",
    "squeeze_truncate": "SELECT doc_id, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 80) AS line FROM documents",
    "ratio_boot_orderstat": _WITH + """, numbered AS (SELECT m1_share, m2_to_m1, row_number() OVER (ORDER BY pid) - 1 AS i FROM point_table WHERE m1_modal IS NOT NULL AND m2_modal IS NOT NULL AND m1_share > 0),
      size AS (SELECT count(*) AS n FROM numbered),
      picks AS (SELECT b, ('0x' || substr(md5(b || ':' || k), 1, 8))::BIGINT % n AS i FROM size, (SELECT unnest(range(0, 1000)) AS b), (SELECT unnest(range(0, (SELECT n FROM size))) AS k)),
      ratios AS (SELECT b, sum(m2_to_m1) / sum(m1_share) AS ratio FROM picks JOIN numbered USING (i) GROUP BY b),
      placed AS (SELECT ratio, row_number() OVER (ORDER BY ratio) AS place FROM ratios)
      SELECT round(max(ratio) FILTER (place = 25), 6) AS low, round(max(ratio) FILTER (place = 975), 6) AS high, round(avg(ratio), 6) AS mean FROM placed""",
}
