"""Log reconstruction: where each call logged its system message, what it replays, its models and status; guards of stages.

The log is derived from the conversations: a call each, with a JSON payload in one of the four styles of logging.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import first_tool, text_of
from ..functions.stats import r6
from ..operators.guards import open_splits, rows_digest, stage_state
from ..operators.joins import as_of, contains_any, top_similar
from ..operators.vectors import unit
from ..sources.tables import PAIRS_SQL, load
from .contrast import complete
from .design import _E, ERAS, _text_time

# Fixed values of the protocol: fields of a payload that never hold the system message, and the cuts of a task and a query.
NOT_SYSTEM = ("messages", "response", "tokens", "system_chars")
TASK_CHARS, QUERY_CHARS = 80, 200


def constitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions by the hash of their text; a seventh of the rows has a key that is not its text's hash."""
    n = load(spark, sf_dir, "nation")
    text = F.concat_ws(" ", "n_name", F.lit("keeps its record"))
    true = F.left(F.sha2(text.cast("binary"), 256), F.lit(12))
    return n.select(F.when(F.col("n_nationkey") % 7 == 0, F.reverse(true)).otherwise(true).alias("hash"), text.alias("text"), F.col("n_nationkey").alias("version"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source, hash, query, response and payload (JSON) of every call: an even turn and the turn after it."""
    said = lambda k: F.max(F.when(F.col("turn") % 2 == k, F.col("text")))
    c = load(spark, sf_dir, "conversations").groupBy(F.expr("conv_id * 4096 + turn div 2").alias("id")).agg(said(0).alias("query"), said(1).alias("response"))
    own = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("version"), F.concat_ws(" ", "n_name", F.lit("keeps its record")).alias("profile"))
    c = c.withColumn("version", (F.col("id") % 27).cast("int")).join(F.broadcast(own), "version", "left")  # the nations: a fixed table
    style = F.col("id") % 4
    system = F.concat(F.lit("Be brief. "), F.left("query", F.lit(40)))
    tail = F.concat(F.lit("Tail of "), F.col("id").cast("string"))
    apart = F.when(F.col("id") % 8 == 2, "\n\n").otherwise("")
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    plain = F.array(message("user", F.col("query")))
    rounds = F.when(F.col("id") % 6 == 4, '[{"name":"other","args":"abandon_goal"}]').when(F.col("id") % 3 == 1, '[{"name":"web_search","args":"set_goal"},{"name":"publish_page"}]').when(F.col("id") % 3 == 2, '[{"name":"read_page"}]')
    fields = F.struct(
        F.when(style == 0, F.array(message("system", system), message("user", F.col("query")))).otherwise(plain).alias("messages"),
        F.col("response"),
        F.when(style == 1, system).alias("note"),
        F.when(style == 2, tail).alias("system_extra"),
        F.when(style == 1, F.length(system)).when(style == 2, F.length(F.concat(F.coalesce("profile", F.lit("")), apart, tail))).alias("system_chars"),
    )
    body = F.to_json(fields)
    models = F.when(F.col("id") % 2 == 0, F.format_string('"m%s"', (F.col("id") % 3).cast("string"))).otherwise(F.format_string('["m%s","shared"]', (F.col("id") % 3).cast("string")))
    more = F.concat(F.lit(',"model":'), models, F.coalesce(F.concat(F.lit(',"tool_rounds":'), rounds), F.lit("")), F.lit("}"))
    source = F.element_at(F.array(*map(F.lit, ("telegram", "genesis", "probe", "telegram", "telegram"))), (F.col("id") % 5 + 1).cast("int"))
    true = F.left(F.sha2(F.col("profile").cast("binary"), 256), F.lit(12))
    return c.select("id", source.alias("source"), true.alias("hash"), "query", "response", F.concat(F.regexp_replace(body, r"\}$", ""), more).alias("payload"))


def system_message(payload: Column, profile: Column) -> Column:
    """struct(style, text) of the logged system message: an inline message, else a field of just the wanted length, else the profile and a tail."""
    fields = F.from_json(payload, "messages array<struct<role string, content string>>, system_chars int, system_extra string")
    want, first = fields["system_chars"], F.try_element_at(fields["messages"], F.lit(1))
    found = lambda style, ok, text: F.when(ok, F.struct(F.lit(style).alias("style"), text.alias("text")))
    # Values keep their JSON form here, so that numbers and objects are told from strings.
    raw = F.from_json(payload, T.MapType(T.StringType(), T.VariantType()))
    text = lambda v: F.try_variant_get(v, "$", "string")
    fits = F.filter(F.map_entries(raw), lambda e: ~e["key"].isin(*NOT_SYSTEM) & (F.schema_of_variant(e["value"]) == "STRING") & (F.length(text(e["value"])) == want))
    joined = [F.concat_ws("", F.coalesce(profile, F.lit("")), F.lit(sep), fields["system_extra"]) for sep in ("\n\n", "")]
    tail = F.coalesce(*[found("tail", fields["system_extra"].isNotNull() & (F.length(j) == want), j) for j in joined])
    field = F.try_element_at(fits, F.lit(1))
    return F.coalesce(found("inline", first["role"] == "system", first["content"]), found("field", F.size(fits) > 0, text(field["value"])), tail)


def _styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, known = calls(spark, sf_dir), constitutions(spark, sf_dir).select("hash", "text", "version")
    return log.join(known, "hash", "left").withColumn("system", system_message(F.col("payload"), F.col("text")))


def logging_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _styled(spark, sf_dir).groupBy("source", F.coalesce(F.col("system.style"), F.lit("none")).alias("style")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("system.text")).alias("chars"))


def call_constitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with their constitution by hash; those without one stay."""
    return calls(spark, sf_dir).join(constitutions(spark, sf_dir), "hash", "left").groupBy("version").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


def hash_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored texts whose hash is not their key: a warning each, no failure."""
    c = constitutions(spark, sf_dir).withColumn("found", F.left(F.sha2(F.col("text").cast("binary"), 256), F.lit(12)))
    return c.where("found <> hash").select("version", "hash", "found", F.lit("warning").alias("level"))


def status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls whose system message is stored, those that only have a known constitution, and the rest."""
    s = _styled(spark, sf_dir)
    stored, known = F.col("system").isNotNull(), F.col("version").isNotNull()
    return s.agg(F.count_if(stored).alias("stored"), F.count_if(~stored & known).alias("ok"), F.count_if(~stored & ~known).alias("bad"), F.count(F.lit(1)).alias("n"))


def model_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model ids of the payloads, a scalar or a list, with how often each occurs."""
    v = F.get_json_object("payload", "$.model")
    ids = F.when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(F.array(v))
    return calls(spark, sf_dir).select(F.explode(ids).alias("model")).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


def history_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The historical tool: the first of four names that occurs in the first tool round."""
    first = F.coalesce(F.get_json_object("payload", "$.tool_rounds[0]"), F.lit(""))
    return calls(spark, sf_dir).groupBy(first_tool(first).alias("tool")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


def opt_out_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of opt-outs: beginnings of queries, and short words."""
    c = load(spark, sf_dir, "conversations").where("turn = 0 and conv_id % 37 = 0")
    word = F.substring_index("text", " ", 1)
    return c.select(F.when(F.col("conv_id") % 2 == 0, F.col("text")).otherwise(word).alias("task")).where("task <> ''")


def replay_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls to replay: genesis and probe calls, and others whose query holds the task of an opt-out."""
    log = calls(spark, sf_dir).select("id", "source", F.left("query", F.lit(QUERY_CHARS)).alias("query"))
    direct = F.col("source").isin("genesis", "probe")
    parts = opt_out_tasks(spark, sf_dir).select(F.left("task", F.lit(TASK_CHARS)).alias("part"))
    held = contains_any(log.where(~direct), "id", "query", parts, "part").withColumn("kind", F.lit("optout"))
    return log.where(direct).select("id", F.col("source").alias("kind")).unionByName(held.select("id", "kind"))


def first_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points named in a list, and of those the first twenty in the log's order."""
    wanted = load(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"))
    return load(spark, sf_dir, "events").join(wanted, "user_id", "left_semi").select("event_id", "user_id").orderBy("event_id").limit(20)


def text_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text or an object that holds one, read under three orders of its keys."""
    raw = F.element_at(F.array(*map(F.lit, ('"%s"', '{"text":"%s","span":"s"}', '{"testo":"%s","span":"s"}', '{"content":"%s","testo":"t"}', '{"memory":"%s"}', '{"span":"%s"}', "{}"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    p = load(spark, sf_dir, "part").select("p_partkey", F.replace(raw, F.lit("%s"), F.col("p_brand")).alias("j"))
    keys = {"plain": ("text", "span", "content", "memory"), "memory": ("testo", "span"), "span": ("span", "testo")}
    return p.select("p_partkey", *[text_of(F.col("j"), k).alias(n) for n, k in keys.items()])


def era_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a row with the founding tag ran under the specification of the first era; other rows are valid."""
    e = as_of(_text_time(load(spark, sf_dir, "events")), spark.createDataFrame(ERAS, "since string, specs string"), F.col("at"), "since", "specs", F.lit("default"))
    founding = F.col("event_type") == "signup"
    return e.groupBy("event_type", (~founding | (F.col("specs") == ERAS[0][1])).cast("int").alias("valid")).agg(F.count(F.lit(1)).alias("n"))


def nested_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first number (a truth value is one too) under a key anywhere in a JSON object, depth first, what was pushed last first; null for none.

    Levels are unpacked one by one, all objects at once; a node's place in the search is the array of places on the way
    to it.
    """
    p = load(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.format_string('{"a":{"alpha":%d},"b":[{"alpha":%d},{"c":1}]}', "p_partkey", "p_size")).when(F.col("p_partkey") % 3 == 1, F.format_string('{"x":[[{"alpha":"text"}],{"y":{"alpha":%d}}],"z":{"w":0}}', "p_size")).otherwise('{"none":[1,2]}').alias("j"))
    return search_key(p, "p_partkey", "j", "alpha").select("p_partkey", "value")


# The deepest nesting that is searched; a deeper text stops the query.
DEEPEST = 1000


def search_key(df: DataFrame, key: str, json: str, name: str) -> DataFrame:
    """key and value of every row: see nested_key. One recursive query: each step unpacks the nodes of the one before.

    A node is searched before its children, in order; of the nodes still to come the last pushed is next, so the way to
    a node is the list of its places, each negated. The number of nodes has no limit of its own here, since the search
    ends with the nesting; that session setting is lifted.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    source = df.select(F.col(key).alias("k"), F.try_parse_json(F.col(json)).alias("v"))
    hits = spark.sql(
        f"""WITH RECURSIVE walk(k, way, pos, name, v) MAX RECURSION LEVEL {DEEPEST} AS (
          SELECT k, CAST(array() AS ARRAY<INT>), 0, CAST(NULL AS STRING), v FROM {{source}}
          UNION ALL
          SELECT w.k, CASE WHEN w.name IS NULL AND size(w.way) = 0 AND w.pos = 0 THEN array(1) ELSE concat(w.way, array(-w.pos)) END, e.pos, coalesce(e.key, ''), e.value
          FROM walk w, LATERAL variant_explode(w.v) AS e
          WHERE startswith(schema_of_variant(w.v), 'OBJECT') OR startswith(schema_of_variant(w.v), 'ARRAY')
        )
        SELECT k, way, pos, try_variant_get(v, '$', 'double') AS value FROM walk
        WHERE name = :name AND schema_of_variant(v) RLIKE '^(BIGINT|DOUBLE|DECIMAL|BOOLEAN)'""",
        args={"name": name}, source=source,
    )
    first = hits.groupBy("k").agg(F.min(F.struct("way", "pos", "value")).alias("h"))
    return df.select(F.col(key)).join(first, F.col(key) == F.col("k"), "left").select(key, F.col("h.value").alias("value"))


def open_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each stage may see: the test split is withheld while exploring."""
    d = complete(spark, sf_dir).select("split")
    rows = [open_splits(d, s).groupBy(F.lit(s).alias("stage"), "split").agg(F.count(F.lit(1)).alias("n")) for s in ("explore", "confirm")]
    return rows[0].unionByName(rows[1])


def confirm_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each clause may be confirmed: registered, with a saved selection, and its rows as they were when it was saved."""
    rows = complete(spark, sf_dir).select("clause", "item", F.round(F.col("shift") * 1000).cast("bigint").alias("value"))
    now = rows_digest(rows, ["clause"], ["item", "value"]).withColumnRenamed("digest", "now")
    saved = rows_digest(rows.where("item % 211 <> 5"), ["clause"], ["item", "value"]).withColumnRenamed("digest", "saved")
    about = now.join(saved, "clause", "left").withColumn("registered", F.substring("clause", -1, 1) != "3").withColumn("selected", F.substring("clause", -1, 1) != "4")
    return about.select("clause", stage_state(F.col("registered"), F.col("selected"), F.col("now") == F.col("saved")).alias("state"))


def memory_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five earlier memories of each vector with another text and a cosine of .55 at least; ties keep the store's order."""
    texts = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("text"))
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), unit(F.col("embedding")).alias("vec")).join(texts, "id", "left")
    queries = e.select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    found = top_similar(queries, e.select("id", "vec"), 5, 0.55, other=(e.select(F.col("id").alias("query_id"), F.col("text").alias("query_text")), e.select("id", "text")))
    return found.select("query_id", "id", "rank", r6(F.col("score")).alias("score"))


QUERIES = {
    "logging_styles": logging_styles, "call_constitution": call_constitution, "hash_check": hash_check, "status_totals": status_totals, "model_frequency": model_frequency, "history_tool": history_tool,
    "replay_set": replay_set, "first_in_order": first_in_order, "text_extraction": text_extraction, "era_validity": era_validity, "nested_key": nested_key, "open_by_stage": open_by_stage, "confirm_guard": confirm_guard, "memory_matches": memory_matches,
}

_CALLS = """q AS (SELECT conv_id * 4096 + turn // 2 AS id, max(text) FILTER (turn % 2 = 0) AS query, max(text) FILTER (turn % 2 = 1) AS response FROM conversations GROUP BY 1),
  calls AS (SELECT q.*, ['telegram', 'genesis', 'probe', 'telegram', 'telegram'][id % 5 + 1] AS source, (id % 27)::INTEGER AS version, n_name || ' keeps its record' AS profile FROM q LEFT JOIN nation ON n_nationkey = id % 27)"""
_SYSTEM = """styled AS (SELECT *, CASE id % 4 WHEN 0 THEN 'inline' WHEN 1 THEN 'field' WHEN 2 THEN CASE WHEN version % 7 <> 0 OR profile IS NULL THEN 'tail' END END AS style,
  CASE id % 4 WHEN 2 THEN length(coalesce(profile, '')) + CASE WHEN id % 8 = 2 THEN 2 ELSE 0 END + length('Tail of ' || id) ELSE length('Be brief. ' || left(query, 40)) END AS chars FROM calls)"""
ORACLES = {
    "logging_styles": f"WITH {_CALLS}, {_SYSTEM} SELECT source, coalesce(style, 'none') AS style, count(*) AS n, sum(CASE WHEN style IS NOT NULL THEN chars END)::BIGINT AS chars FROM styled GROUP BY 1, 2",
    "call_constitution": f"WITH {_CALLS} SELECT CASE WHEN profile IS NOT NULL AND version % 7 <> 0 THEN version END AS version, count(*) AS n, min(id) AS first FROM calls GROUP BY 1",
    "hash_check": "SELECT n_nationkey AS version, reverse(left(sha256(n_name || ' keeps its record'), 12)) AS hash, left(sha256(n_name || ' keeps its record'), 12) AS found, 'warning' AS level FROM nation WHERE n_nationkey % 7 = 0",
    "status_totals": f"WITH {_CALLS}, {_SYSTEM}, k AS (SELECT style IS NOT NULL AS stored, profile IS NOT NULL AND version % 7 <> 0 AS known FROM styled) SELECT count(*) FILTER (stored) AS stored, count(*) FILTER (NOT stored AND known) AS ok, count(*) FILTER (NOT stored AND NOT known) AS bad, count(*) AS n FROM k",
    "model_frequency": "WITH c AS (SELECT DISTINCT conv_id * 4096 + turn // 2 AS id FROM conversations) SELECT model, count(*) AS n FROM (SELECT 'm' || (id % 3) AS model FROM c UNION ALL SELECT 'shared' FROM c WHERE id % 2 = 1) GROUP BY 1",
    "history_tool": "WITH c AS (SELECT DISTINCT conv_id * 4096 + turn // 2 AS id FROM conversations) SELECT CASE WHEN id % 6 = 4 THEN 'abandon_goal' WHEN id % 3 = 1 THEN 'web_search' ELSE '' END AS tool, count(*) AS n, min(id) AS first FROM c GROUP BY 1",
    "replay_set": f"""WITH {_CALLS}, tasks AS (SELECT DISTINCT left(CASE WHEN conv_id % 2 = 0 THEN text ELSE split_part(text, ' ', 1) END, 80) AS part FROM conversations WHERE turn = 0 AND conv_id % 37 = 0),
      parts AS (SELECT part FROM tasks WHERE part <> '') SELECT id, source AS kind FROM calls WHERE source <> 'telegram' UNION ALL SELECT id, 'optout' FROM calls WHERE source = 'telegram' AND EXISTS (SELECT 1 FROM parts WHERE contains(left(query, 200), part))""",
    "first_in_order": "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) ORDER BY event_id LIMIT 20",
    "text_extraction": "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN p_brand WHEN 1 THEN p_brand WHEN 2 THEN 's' WHEN 3 THEN p_brand WHEN 4 THEN p_brand WHEN 5 THEN p_brand ELSE '' END AS plain, CASE p_partkey % 7 WHEN 0 THEN p_brand WHEN 1 THEN 's' WHEN 2 THEN p_brand WHEN 3 THEN 't' WHEN 5 THEN p_brand ELSE '' END AS memory, CASE p_partkey % 7 WHEN 0 THEN p_brand WHEN 1 THEN 's' WHEN 2 THEN 's' WHEN 3 THEN 't' WHEN 5 THEN p_brand ELSE '' END AS span FROM part",
    "era_validity": f"WITH e AS (SELECT event_type, coalesce((SELECT arg_max(specs, since) FROM {_E} r WHERE r.since <= strftime(ts, '%Y-%m-%dT%H:%M:%S')), 'default') AS specs FROM events) SELECT event_type, (event_type <> 'signup' OR specs = '{ERAS[0][1]}')::INTEGER AS valid, count(*) AS n FROM e GROUP BY 1, 2",
    "nested_key": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN p_size END::DOUBLE AS value FROM part",
    "open_by_stage": f"WITH {PAIRS_SQL} SELECT 'explore' AS stage, split, count(*) AS n FROM complete WHERE split <> 'test' GROUP BY 2 UNION ALL SELECT 'confirm', split, count(*) FROM complete GROUP BY 2",
    "confirm_guard": f"WITH {PAIRS_SQL} SELECT clause, CASE WHEN right(clause, 1) = '3' THEN 'no registration' WHEN right(clause, 1) = '4' THEN 'no saved selection' WHEN bool_or(item % 211 = 5) THEN 'rows changed' ELSE 'open' END AS state FROM complete GROUP BY 1",
    "memory_matches": "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, text FROM embeddings LEFT JOIN documents ON doc_id = vec_id) SELECT query_id, id, rank, round(score, 6) AS score FROM (SELECT q.id AS query_id, s.id, list_cosine_similarity(q.vec, s.vec) AS score, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.vec, s.vec) DESC, s.id)::INTEGER AS rank FROM v q JOIN v s ON s.id < q.id WHERE q.text IS DISTINCT FROM s.text AND list_cosine_similarity(q.vec, s.vec) >= 0.55) WHERE rank <= 5",
}
