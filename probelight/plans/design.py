"""Design, text, integrity and time queries: factorial items, eras, vocabularies, manifests, gates, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import r6
from ..operators.dedup import change_points
from ..operators.joins import as_of, contains_any, full_comparison, missing, prior_rows
from ..operators.order import numbered
from ..sources.tables import RUNS_SQL, load, points, runs

# Fixed small tables of the replay calendar: eras (from, specs) and goals (id, since, length, status).
ERAS = [("2024-01-05T00:00:00", "era1"), ("2024-01-12T00:00:00", "era2"), ("2024-01-20T00:00:00", "era2"), ("2024-01-25T00:00:00", "era3")]
GOALS = [(1, "2024-01-02T00:00:00", 40, "active"), (2, "2024-01-09T00:00:00", 25, "revised"), (3, "2024-01-16T00:00:00", 33, "active"), (4, "2024-01-23T00:00:00", 17, "abandoned")]
PROFILE, HEADER, JOINER = 100, 12, 2


def _text_time(df: DataFrame) -> DataFrame:
    return df.withColumn("at", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))


def era_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the era whose start is the last not after them, in string order; the built-in default before the first."""
    e = _text_time(load(spark, sf_dir, "events"))
    eras = spark.createDataFrame(ERAS, "since string, specs string")
    return as_of(e, eras, F.col("at"), "since", "specs", F.lit("default")).groupBy("specs", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


def era_changepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose type differs from the user's event before."""
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return change_points(e, ["user_id"], "event_id", "event_type").groupBy("user_id").agg(F.count(F.lit(1)).alias("changes"), F.max("event_id").alias("last"))


def range_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    goals = spark.createDataFrame(GOALS, "id int, since string, size int, status string")
    e = _text_time(load(spark, sf_dir, "events"))
    return prior_rows(e, goals, "at", "since", "id").select("event_id", F.array_join("prior", ",").alias("goals"))


def subset_length_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first subset of prior goals, larger ones first, whose assembled prompt has the wanted length; none wanted takes all."""
    goals = spark.createDataFrame(GOALS, "id int, since string, size int, status string")
    want = F.when(F.col("event_id") % 11 != 0, PROFILE + F.col("event_id") % 130)
    e = _text_time(load(spark, sf_dir, "events")).select("event_id", "at", want.alias("want"))
    return matched_subsets(e, goals, "at", "want").select("event_id", "want", F.array_join("chosen", ",").alias("goals"), "status")


def matched_subsets(facts: DataFrame, goals: DataFrame, at: str, want: str) -> DataFrame:
    """Adds chosen (ids of goals) and status to facts: see subset_length_match. goals: id, since, size, status.

    Lengths add up, so no text is built. Prior goals are a beginning of the goals in order of time, so facts have few
    different questions (how many goals, what length), and each is answered once. The goals of a question are cut in two
    halves; of the subsets of a half only the first of each size and length is kept, and the halves meet on the length
    that is missing: 2 ** (n / 2) subsets stand for 2 ** n. The first goal is the highest bit of a subset's mask, so that
    masks of one size in falling order are combinations in order.
    """
    folded = goals.agg(F.array_sort(F.collect_list(F.struct("since", "id", "size", "status"))).alias("_g"))
    counted = facts.crossJoin(F.broadcast(folded)).withColumn("_n", F.size(F.filter("_g", lambda g: g["since"] <= F.col(at)))).drop("_g")
    asked = counted.select("_n", F.col(want).alias("_want")).where("_want is not null").distinct()
    sizes = asked.select("_n").distinct().crossJoin(F.broadcast(folded))  # a row for each number of goals
    lower = F.expr("_n div 2")  # the later goals, the lower bits

    def half(first: Column, m: Column, shift: Column, name: str) -> DataFrame:
        own = F.transform(F.slice("_g", first, m), lambda g: g["size"] + 1)
        masks = sizes.select("_n", own.alias("own"), m.alias("m"), shift.alias("shift")).withColumn("mask", F.explode(F.expr("sequence(0L, shiftleft(1L, m) - 1)")))
        total = F.expr("aggregate(transform(own, (x, i) -> IF((mask & shiftleft(1L, m - 1 - i)) > 0, x, 0)), 0, (a, b) -> a + b)")
        each = masks.select("_n", F.bit_count("mask").alias("k"), total.alias("len"), F.expr("shiftleft(mask, shift)").alias("mask"))
        return each.groupBy("_n", "len", "k").agg(F.max("mask").alias("mask")).select("_n", *[F.col(c).alias(f"{name}_{c}") for c in ("len", "k", "mask")])

    upper = F.col("_n") - lower
    early, late = half(F.lit(1), upper, lower, "a"), half(upper + 1, lower, F.lit(0), "b")
    # The profile alone, or the profile, joiner, header and the goals joined.
    rest = F.when(F.col("_want") == PROFILE, 0).otherwise(F.col("_want") - PROFILE - JOINER - HEADER + 1)
    missing_length = asked.withColumn("rest", rest).join(early, "_n").withColumn("b_len", F.col("rest") - F.col("a_len"))
    met = missing_length.join(late, ["_n", "b_len"]).where((F.col("rest") > 0) | (F.col("_want") == PROFILE))
    top = F.max(F.struct((F.col("a_k") + F.col("b_k")).alias("k"), F.col("a_mask").bitwiseOR(F.col("b_mask")).alias("mask")))
    best = met.groupBy(F.col("_n").alias("_bn"), "_want").agg(top["mask"].alias("_mask"))
    out = counted.join(best, (F.col("_n") == F.col("_bn")) & (F.col(want) == F.col("_want")), "left").crossJoin(F.broadcast(folded))
    prior = F.slice("_g", 1, F.col("_n"))
    hit = F.expr("transform(filter(transform(slice(_g, 1, _n), (x, i) -> struct(x.id AS id, (_mask & shiftleft(1L, _n - 1 - i)) > 0 AS used)), y -> y.used), y -> y.id)")
    active = F.transform(F.filter(prior, lambda g: g["status"] == "active"), lambda g: g["id"])
    chosen = F.when(F.col(want).isNull(), F.transform(prior, lambda g: g["id"])).when(F.col("_mask").isNotNull(), hit).otherwise(active)
    told = F.when(F.col(want).isNull() | F.col("_mask").isNotNull(), "validated").otherwise("UNVALIDATED")
    return out.select(*[c for c in facts.columns], chosen.alias("chosen"), told.alias("status"))


_G = "(SELECT * FROM (VALUES " + ", ".join(f"({i}, '{s}', {n}, '{t}')" for i, s, n, t in GOALS) + ") v(id, since, size, status))"
_E = "(SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ERAS) + ") v(since, specs))"


def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running ids by kind, in order of the point; opt-out points share one id."""
    p = numbered(points(spark, sf_dir), "kind", "pid", "number")
    return p.select("pid", F.when(F.col("kind") == "genesis", F.format_string("G%02d", "number")).when(F.col("kind") == "probe", F.format_string("P%02d", "number")).otherwise("OPTOUT1").alias("point_id"))


def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned repetitions with no row in the log; a failed one counts as done."""
    plan = points(spark, sf_dir).select("pid").withColumn("arm", F.explode(F.array(F.lit("M1"), F.lit("M2")))).withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))))
    return missing(plan, runs(spark, sf_dir), ["pid", "arm", "rep"])


def exists_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a stretch of a benchmark item: its words in twenties, or all of a shorter item's."""
    w = F.split(F.trim("text"), r"\s+")
    items = load(spark, sf_dir, "benchmark").select(w.alias("w")).select("w", F.greatest(F.lit(1), F.expr("size(w) div 20")).alias("n"))
    stretches = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.array_join(F.slice("w", i * 20 + 1, F.lit(20)), " "))
    return contains_any(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", items.select(F.explode(stretches).alias("part")), "part")


def design_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factorial items: nations (clauses) by class by version, and an item without a record each: a few rows a nation."""
    clauses = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("clause"), F.col("n_name").alias("name"))
    full = clauses.withColumn("cls", F.explode(F.array(F.lit("AGREE"), F.lit("CONFLICT")))).withColumn("version", F.explode(F.array(F.lit("plain"), F.lit("mirror"))))
    none = clauses.withColumn("cls", F.lit("none")).withColumn("version", F.explode(F.array(F.lit("plain"), F.lit("mirror"))))
    return full.unionByName(none).select(F.concat_ws("-", "clause", "cls", "version").alias("item_id"), "name", F.left(F.sha2(F.concat_ws("|", "name", "cls", "version").cast("binary"), 256), F.lit(12)).alias("sha"))


def cyclic_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation and the next one, the last with the first. The table has a row for each clause of a study."""
    n = load(spark, sf_dir, "nation").select("n_regionkey", "n_name", (F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name")) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("n_regionkey")).alias("k"))
    after = n.select("n_regionkey", F.col("n_name").alias("partner"), F.pmod(F.col("i") - 1, F.col("k")).alias("i"))
    return n.join(after, ["n_regionkey", "i"]).select("n_name", "partner")


def per_group_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = load(spark, sf_dir, "part").groupBy("p_brand", "p_type", "p_name").agg(F.min("p_partkey").alias("first_part"))
    return spans.select("p_brand", "p_type", "p_name", "first_part", F.row_number().over(Window.partitionBy("p_brand", "p_type").orderBy("p_name")).alias("number"))


def first_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return load(spark, sf_dir, "part").select("p_brand", "p_partkey", number.alias("number")).where("number <= 2").withColumn("role", F.when(F.col("number") == 1, "carrier").otherwise("second"))


_TOKENS = "[a-zàèéìòù']+"


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the training documents that occur at least twice, with their counts and documents."""
    words = load(spark, sf_dir, "documents").where("doc_id % 10 < 6").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_TOKENS), F.lit(0))).alias("word"))
    per = words.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")).where("n >= 2")


def bow_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse word matrix of conversation turns: conversation, word, count."""
    c = load(spark, sf_dir, "conversations").select("conv_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_TOKENS), F.lit(0))).alias("word"))
    return c.groupBy("conv_id", "word").agg(F.count(F.lit(1)).alias("n"))


def final_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three words of each turn, and how many turns end so."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(_TOKENS), F.lit(0))
    last = load(spark, sf_dir, "conversations").select("role", F.array_join(F.slice(w, -F.least(F.size(w), F.lit(3)), F.lit(3)), " ").alias("ending"), F.size(w).alias("k")).where("k > 0")
    return last.groupBy("role", "ending").agg(F.count(F.lit(1)).alias("n"))


def disjoint_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least 21 characters that documents share with benchmark items; an empty side withholds the verdict."""
    lines = lambda name: load(spark, sf_dir, name).select(F.explode(F.split("text", "\n")).alias("s")).select(F.trim("s").alias("s")).where(F.length("s") >= 21).distinct()
    a, b = lines("documents"), lines("benchmark")
    counts = a.agg(F.count(F.lit(1)).alias("n_documents")).crossJoin(b.agg(F.count(F.lit(1)).alias("n_benchmark"))).crossJoin(a.intersect(b).agg(F.count(F.lit(1)).alias("shared")))  # one row each
    return counts.withColumn("status", F.when((F.col("n_documents") == 0) | (F.col("n_benchmark") == 0), "no verdict").when(F.col("shared") == 0, "disjoint").otherwise("overlap"))


def setdiff_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that documents share with benchmark items or conversations, without those shared with benchmark items alone."""
    lines = lambda name: load(spark, sf_dir, name).select(F.explode(F.split("text", "\n")).alias("s")).select(F.trim("s").alias("line")).where(F.col("line") != "").distinct()
    a, text = lines("documents"), lines("benchmark")
    every = text.union(lines("conversations")).distinct()
    return a.intersect(every).exceptAll(a.intersect(text))


def sha_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of pages against a later listing in which some changed, some went and some came."""
    p = load(spark, sf_dir, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha"))
    now = p.where("page_id % 11 <> 0").withColumn("sha", F.when(F.col("page_id") % 7 == 0, F.reverse("sha")).otherwise(F.col("sha")))
    now = now.unionByName(p.where("page_id % 13 = 0").select((F.col("page_id") + 10_000_000).alias("page_id"), "sha"))
    return full_comparison(p, now, "page_id", "sha").groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))


def json_schema_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the events' JSON with the sorted set of types seen."""
    e = load(spark, sf_dir, "events").select(F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    kind = F.when(F.col("value").rlike("^-?[0-9]+$"), "int").when(F.col("value").rlike(r"^-?[0-9]+\.[0-9]+$"), "float").when(F.col("value").isin("true", "false"), "bool").otherwise("str")
    return e.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("types"), F.count(F.lit(1)).alias("n"))


def shard_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event ranges of each day as shards of one sequence: gaps and overlaps against the shard before."""
    shards = load(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("series"), F.expr("event_id div 250").alias("shard")).agg(F.min("event_id").alias("start"), (F.max("event_id") + 1).alias("end"))
    before = F.lag("end").over(Window.partitionBy("series").orderBy("start"))
    return shards.select("series", "shard", F.when(before.isNull(), "first").when(F.col("start") > before, "gap").when(F.col("start") < before, "overlap").otherwise("ok").alias("state"))


def stimulation_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Salted item to pattern: three bytes of a digest choose channel, rate and length."""
    sha = F.sha2(F.concat(F.lit("salt|"), F.col("p_partkey").cast("string"), F.lit("|"), F.col("p_name")).cast("binary"), 256)
    byte = lambda k: F.conv(F.substring(sha, 2 * k + 1, 2), 16, 10).cast("int")
    return load(spark, sf_dir, "part").select("p_partkey", (byte(0) % 8).alias("channel"), (5 + byte(1) % 20).alias("rate"), (1 + byte(2) % 4).alias("seconds"))


def spike_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users as spikes on channels: rates, their mean, and channels above a threshold."""
    e = load(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 16).alias("channel")).agg((F.count(F.lit(1)) / 30.0).alias("rate"))
    return e.groupBy("event_type").agg(r6(F.avg("rate")).alias("mean_rate"), F.count_if(F.col("rate") > 0.5).alias("active"), r6(F.max("rate")).alias("fastest"))


def schema_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first violation of each event by an ordered list of rules, counted, with the first offender."""
    e = load(spark, sf_dir, "events")
    rules = F.coalesce(F.when(F.col("event_id") % 97 == 0, "event_id"), F.when(~F.col("event_type").isin("view", "signup", "click", "purchase"), "event_type"), F.when(F.col("value") < 1, "value"), F.when(F.length("props") < 3, "props"))
    return e.withColumn("violation", rules).where("violation is not null").groupBy("violation").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


def fault_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label agreement with history before and after each of six corruptions of hashed victims, and the shift's verdict."""
    joined = runs(spark, sf_dir).where("label <> 'error'").join(points(spark, sf_dir), "pid")
    victim = F.conv(F.substring(F.md5(F.col("ord").cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") % 20 == 0
    label, hist = F.col("label"), F.col("hist")
    other = F.when(label == "view", "click").otherwise("view")
    # Label exchanged, history exchanged, label blanked, row dropped, row doubled, label set to history's.
    kinds = [("exchange", other, hist, 1), ("history", label, F.when(hist == "view", "click").otherwise("view"), 1), ("blank", F.lit(""), hist, 1), ("drop", label, hist, 0), ("double", label, hist, 2), ("copy", hist, hist, 1)]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("fault"), F.when(victim, a).otherwise(label).alias("a"), F.when(victim, b).otherwise(hist).alias("b"), F.when(victim, w).otherwise(1).alias("w")) for n, a, b, w in kinds]))
    long = joined.select("kind", (label == hist).cast("int").alias("clean"), victim.alias("victim"), rows.alias("x")).select("kind", "clean", "victim", "x.*")
    faulty = F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0)) / F.sum("w")
    g = long.groupBy("kind", "fault").agg(F.avg("clean").alias("c"), faulty.alias("f"), F.count_if("victim").alias("victims"))
    return g.select("kind", "fault", "victims", r6(F.col("c")).alias("clean"), r6(F.col("f")).alias("faulty"), F.when(F.abs(F.col("f") - F.col("c")) > 0.02, "KILL").otherwise("PASS").alias("verdict"))


def test_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for each metric by its threshold, over the order table's shares of a status."""
    o = load(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("share"), F.count(F.lit(1)).alias("n"))
    return o.select("o_orderpriority", "n", r6(F.col("share")).alias("share"), F.when(F.col("n") < 10, "SKIP").when(F.col("share") >= 0.5, "PASS").when(F.col("share") >= 0.3, "SOFT-FLAG").otherwise("KILL").alias("verdict"))


QUERIES = {
    "era_asof": era_asof, "era_changepoints": era_changepoints, "range_goals": range_goals, "subset_length_match": subset_length_match, "point_ids": point_ids, "resume_anti": resume_anti, "exists_substring_semi": exists_substring,
    "design_cross": design_cross, "cyclic_partner": cyclic_partner, "per_group_numbering": per_group_numbering, "first_two": first_two, "vocab": vocabulary, "bow_matrix_long": bow_matrix, "final_k_words": final_words,
    "disjoint_strings": disjoint_strings, "setdiff_meta": setdiff_meta, "sha_manifest": sha_manifest, "json_schema_profile": json_schema_profile, "shard_coverage": shard_coverage, "stimulation_pattern": stimulation_pattern,
    "spike_rates": spike_rates, "schema_gate": schema_gate, "fault_injection": fault_injection, "test_verdicts": test_verdicts,
}

_AT = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"
_W = f"WITH {RUNS_SQL} "
ORACLES = {
    "era_asof": f"WITH e AS (SELECT event_id, event_type, coalesce((SELECT arg_max(specs, since) FROM {_E} r WHERE r.since <= {_AT}), 'default') AS specs FROM events) SELECT specs, event_type, count(*) AS n, min(event_id) AS first FROM e GROUP BY 1, 2",
    "era_changepoints": "SELECT user_id, count(*) AS changes, max(event_id) AS last FROM (SELECT user_id, event_id, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS new FROM events) WHERE new GROUP BY 1",
    "range_goals": f"SELECT event_id, coalesce((SELECT string_agg(id, ',' ORDER BY since) FROM {_G} g WHERE g.since <= {_AT}), '') AS goals FROM events",
    "subset_length_match": f"""WITH g AS (SELECT *, row_number() OVER (ORDER BY since) - 1 AS i FROM {_G}), e AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN {PROFILE} + event_id % 130 END AS want, (SELECT count(*) FROM g WHERE g.since <= {_AT}) AS n FROM events),
      subsets AS (SELECT n, m, bit_count(m) AS k, {PROFILE} + CASE WHEN m = 0 THEN 0 ELSE {JOINER} + {HEADER} + (SELECT sum(size + 1) FROM g WHERE i < n AND (m >> (n - 1 - i)) & 1 = 1) - 1 END AS len, coalesce((SELECT string_agg(id, ',' ORDER BY i) FROM g WHERE i < n AND (m >> (n - 1 - i)) & 1 = 1), '') AS goals FROM (SELECT unnest(range(0, 5)) AS n), (SELECT unnest(range(0, 16)) AS m) WHERE m < (1 << n)),
      best AS (SELECT n, len, arg_max(goals, k::INTEGER * 100 + m) AS goals FROM subsets GROUP BY 1, 2)
      SELECT event_id, want, coalesce(CASE WHEN want IS NULL THEN coalesce((SELECT string_agg(id, ',' ORDER BY i) FROM g WHERE i < e.n), '') END, b.goals, (SELECT string_agg(id, ',' ORDER BY i) FROM g WHERE i < e.n AND status = 'active'), '') AS goals, CASE WHEN b.n IS NOT NULL OR want IS NULL THEN 'validated' ELSE 'UNVALIDATED' END AS status FROM e LEFT JOIN best b ON b.n = e.n AND b.len = e.want""",
    "point_ids": _W + "SELECT pid, CASE kind WHEN 'genesis' THEN printf('G%02d', row_number() OVER (PARTITION BY kind ORDER BY pid)) WHEN 'probe' THEN printf('P%02d', row_number() OVER (PARTITION BY kind ORDER BY pid)) ELSE 'OPTOUT1' END AS point_id FROM points",
    "resume_anti": _W + "SELECT pid, arm, rep FROM points, (SELECT unnest(['M1', 'M2']) AS arm), (SELECT unnest(range(0, 12)) AS rep) WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.pid = points.pid AND r.arm = arm.arm AND r.rep = rep.rep)".replace("arm.arm", "a.arm").replace("rep.rep", "b.rep").replace("AS arm), ", "AS arm) a, ").replace("AS rep) WHERE", "AS rep) b WHERE"),
    "exists_substring_semi": "WITH w AS (SELECT string_split_regex(trim(text), '\\s+') AS w FROM benchmark), parts AS (SELECT DISTINCT array_to_string(w[20 * i + 1:20 * i + 20], ' ') AS part FROM (SELECT w, unnest(range(0, greatest(1, len(w) // 20))) AS i FROM w)) SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM parts WHERE contains(d.text, part))",
    "design_cross": "WITH c AS (SELECT n_nationkey AS clause, n_name AS name FROM nation), x AS (SELECT *, unnest(['AGREE', 'CONFLICT', 'none']) AS cls FROM c), i AS (SELECT *, unnest(['plain', 'mirror']) AS version FROM x) SELECT clause || '-' || cls || '-' || version AS item_id, name, left(sha256(name || '|' || cls || '|' || version), 12) AS sha FROM i",
    "cyclic_partner": "WITH n AS (SELECT n_regionkey AS r, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS i, count(*) OVER (PARTITION BY n_regionkey) AS k FROM nation) SELECT a.n_name, b.n_name AS partner FROM n a JOIN n b ON b.r = a.r AND b.i = (a.i + 1) % a.k",
    "per_group_numbering": "SELECT p_brand, p_type, p_name, min(p_partkey) AS first_part, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_name)::INTEGER AS number FROM part GROUP BY 1, 2, 3",
    "first_two": "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INTEGER AS number, CASE WHEN row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1 THEN 'carrier' ELSE 'second' END AS role FROM part QUALIFY number <= 2",
    "vocab": f"SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_TOKENS.replace(chr(39), chr(39) * 2)}')) AS word FROM documents WHERE doc_id % 10 < 6) GROUP BY 1 HAVING count(*) >= 2",
    "bow_matrix_long": f"SELECT conv_id, word, count(*) AS n FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '{_TOKENS.replace(chr(39), chr(39) * 2)}')) AS word FROM conversations) GROUP BY 1, 2",
    "final_k_words": f"SELECT role, array_to_string(w[-3:], ' ') AS ending, count(*) AS n FROM (SELECT role, regexp_extract_all(lower(text), '{_TOKENS.replace(chr(39), chr(39) * 2)}') AS w FROM conversations) WHERE len(w) > 0 GROUP BY 1, 2",
    "disjoint_strings": "WITH d AS (SELECT DISTINCT trim(s) AS s FROM (SELECT unnest(string_split(text, chr(10))) AS s FROM documents) WHERE length(trim(s)) >= 21), b AS (SELECT DISTINCT trim(s) AS s FROM (SELECT unnest(string_split(text, chr(10))) AS s FROM benchmark) WHERE length(trim(s)) >= 21), c AS (SELECT (SELECT count(*) FROM d) AS n_documents, (SELECT count(*) FROM b) AS n_benchmark, (SELECT count(*) FROM d JOIN b USING (s)) AS shared) SELECT *, CASE WHEN n_documents = 0 OR n_benchmark = 0 THEN 'no verdict' WHEN shared = 0 THEN 'disjoint' ELSE 'overlap' END AS status FROM c",
    "setdiff_meta": "WITH a AS (SELECT DISTINCT trim(unnest(string_split(text, chr(10)))) AS line FROM documents), t AS (SELECT DISTINCT trim(unnest(string_split(text, chr(10)))) AS line FROM benchmark), c AS (SELECT DISTINCT trim(unnest(string_split(text, chr(10)))) AS line FROM conversations) SELECT line FROM a WHERE line <> '' AND line IN (SELECT line FROM t UNION SELECT line FROM c) AND line NOT IN (SELECT line FROM t)",
    "sha_manifest": "WITH p AS (SELECT page_id, sha256(html) AS sha FROM pages), now AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN reverse(sha) ELSE sha END AS sha FROM p WHERE page_id % 11 <> 0 UNION ALL SELECT page_id + 10000000, sha FROM p WHERE page_id % 13 = 0) SELECT CASE WHEN n.page_id IS NULL THEN 'MISSING' WHEN p.page_id IS NULL THEN 'UNLISTED' WHEN p.sha = n.sha THEN 'ok' ELSE 'MISMATCH' END AS state, count(*) AS n, min(coalesce(p.page_id, n.page_id)) AS first FROM p FULL JOIN now n ON n.page_id = p.page_id GROUP BY 1",
    "json_schema_profile": "WITH k AS (SELECT props, unnest(json_keys(props)) AS key FROM events), v AS (SELECT key, json_extract_string(props, key) AS value FROM k) SELECT key, string_agg(DISTINCT CASE WHEN regexp_matches(value, '^-?[0-9]+$') THEN 'int' WHEN regexp_matches(value, '^-?[0-9]+\\.[0-9]+$') THEN 'float' WHEN value IN ('true', 'false') THEN 'bool' ELSE 'str' END, ',') AS types, count(*) AS n FROM v GROUP BY 1",
    "shard_coverage": "WITH s AS (SELECT user_id % 5 AS series, event_id // 250 AS shard, min(event_id) AS a, max(event_id) + 1 AS b FROM events GROUP BY 1, 2), l AS (SELECT *, lag(b) OVER (PARTITION BY series ORDER BY a) AS before FROM s) SELECT series, shard, CASE WHEN before IS NULL THEN 'first' WHEN a > before THEN 'gap' WHEN a < before THEN 'overlap' ELSE 'ok' END AS state FROM l",
    "stimulation_pattern": "WITH h AS (SELECT p_partkey, sha256('salt|' || p_partkey || '|' || p_name) AS s FROM part) SELECT p_partkey, (('0x' || s[1:2])::INTEGER % 8) AS channel, (5 + ('0x' || s[3:4])::INTEGER % 20) AS rate, (1 + ('0x' || s[5:6])::INTEGER % 4) AS seconds FROM h",
    "spike_rates": "WITH c AS (SELECT event_type, user_id % 16 AS channel, count(*) / 30.0::DOUBLE AS rate FROM events GROUP BY 1, 2) SELECT event_type, round(avg(rate), 6) AS mean_rate, count(*) FILTER (rate > 0.5) AS active, round(max(rate), 6) AS fastest FROM c GROUP BY 1",
    "schema_gate": "WITH v AS (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'event_id' WHEN event_type NOT IN ('view', 'signup', 'click', 'purchase') THEN 'event_type' WHEN value < 1 THEN 'value' WHEN length(props) < 3 THEN 'props' END AS violation FROM events) SELECT violation, count(*) AS n, min(event_id) AS first FROM v WHERE violation IS NOT NULL GROUP BY 1",
    "fault_injection": _W + """, j AS (SELECT kind, label, hist, ('0x' || substr(md5(ord::VARCHAR), 1, 8))::BIGINT % 20 = 0 AS victim FROM runs JOIN points USING (pid) WHERE label <> 'error'),
      x AS (SELECT kind, victim, label = hist AS clean, fault, CASE WHEN victim AND fault = 'exchange' THEN CASE WHEN label = 'view' THEN 'click' ELSE 'view' END WHEN victim AND fault = 'blank' THEN '' WHEN victim AND fault = 'copy' THEN hist ELSE label END AS a,
        CASE WHEN victim AND fault = 'history' THEN CASE WHEN hist = 'view' THEN 'click' ELSE 'view' END ELSE hist END AS b, CASE WHEN victim AND fault = 'drop' THEN 0 WHEN victim AND fault = 'double' THEN 2 ELSE 1 END AS w
        FROM j, (SELECT unnest(['exchange', 'history', 'blank', 'drop', 'double', 'copy']) AS fault)),
      g AS (SELECT kind, fault, count(*) FILTER (victim) AS victims, avg(clean::INT) AS c, sum(CASE WHEN a = b THEN w ELSE 0 END)::DOUBLE / sum(w) AS f FROM x GROUP BY 1, 2)
      SELECT kind, fault, victims, round(c, 6) AS clean, round(f, 6) AS faulty, CASE WHEN abs(f - c) > 0.02 THEN 'KILL' ELSE 'PASS' END AS verdict FROM g""",
    "test_verdicts": "SELECT o_orderpriority, count(*) AS n, round(avg((o_orderstatus = 'F')::INT), 6) AS share, CASE WHEN count(*) < 10 THEN 'SKIP' WHEN avg((o_orderstatus = 'F')::INT) >= 0.5 THEN 'PASS' WHEN avg((o_orderstatus = 'F')::INT) >= 0.3 THEN 'SOFT-FLAG' ELSE 'KILL' END AS verdict FROM orders GROUP BY 1",
}
