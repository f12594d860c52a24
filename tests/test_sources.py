import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from probelight.functions import labels as L
from probelight.functions.stats import binomial_p, safe_corr
from probelight.operators import dedup, guards, joins, order
from probelight.operators.joins import as_of, full_comparison
from probelight.sources import archive_source, readers, sinks

SCHEMA = "pid string, rep long, kind string"


@pytest.fixture
def log(tmp_path):
    lines = ['{"pid": "a", "rep": 0, "kind": "error"}', "", '{"pid": "a", "rep": 0, "kind": "text"}', '{"pid": "b", "rep": 1, "ki', '{"pid": "a", "rep": 1, "kind": "text"}']
    (tmp_path / "runs.jsonl").write_text("\n".join(lines) + "\n")
    return str(tmp_path / "runs.jsonl")


def test_jsonl_policies(spark, log, tmp_path):
    assert [r.ord for r in readers.jsonl(spark, log, SCHEMA, "drop").orderBy("ord").collect()] == [1, 3, 5]
    assert readers.jsonl(spark, log, SCHEMA).where("pid is null").count() == 1
    for bad in ("fail", "strict"):
        with pytest.raises((PySparkException, ValueError)):
            readers.jsonl(spark, log, SCHEMA, bad).collect()
    (tmp_path / "ok.jsonl").write_text('{"pid": "a", "rep": 2, "kind": "text"}\n')
    assert readers.jsonl(spark, str(tmp_path / "ok.jsonl"), SCHEMA, "strict").count() == 1
    last = readers.last_by_key(readers.jsonl(spark, log, SCHEMA, "drop").select("pid", "rep", "file", "ord"), "pid").collect()
    assert [(r.pid, r.rep) for r in last] == [("a", 1)]


def test_documents_digests_timeline_alias(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_text("text\nmore")
    row = readers.documents(spark, str(tmp_path / "d")).first()
    assert row.text == "text\nmore"
    assert readers.find_by_digest(spark, str(tmp_path / "d"), row.sha[:8]).count() == 1
    (tmp_path / "t.json").write_text(json.dumps([{"from": "2024-02", "specs": '{"b":1,"a":2}'}, {"from": "2024-01", "specs": "{}"}]))
    eras = readers.timeline(spark, str(tmp_path / "t.json")).orderBy("since").collect()
    assert [(e.since, e.until, e.specs) for e in eras] == [("2024-01", "2024-02", "{}"), ("2024-02", None, '{"a":2,"b":1}')]
    df = spark.createDataFrame([(1,)], "item_id int")
    assert readers.resolve_alias(df, "id", ["pair_id", "item_id"]).columns == ["id"]
    with pytest.raises(ValueError):
        readers.resolve_alias(df, "x", ["y"])


def test_archives(spark, tmp_path):
    for name, keys in (("M12.npz", {"B_span_last": 2, "none_prompt_last": 1}), ("p-7_C.npz", {"prompt_last": 3})):
        buffer = io.BytesIO()
        np.savez(buffer, **{k: np.ones((n, 4), np.float16) * n for k, n in keys.items()})
        (tmp_path / name).write_bytes(buffer.getvalue())
    rows = readers.archives(spark, str(tmp_path)).where("item = 'M12'").collect()
    assert sorted((r.cond, r.pos, r.layer) for r in rows) == [("B", "span_last", 0), ("B", "span_last", 1), ("none", "prompt_last", 0)]
    assert all(len(r.vec) == 4 for r in rows)
    with pytest.raises(PySparkException):
        readers.archives(spark, str(tmp_path), r"(.+)_(B|C|none)").collect()


class Counted(io.BytesIO):
    """A file that counts the bytes read."""

    total = 0

    def read(self, n=-1):
        out = super().read(n)
        self.total += len(out)
        return out


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_one_layer_reads_one_layer(save):
    arrays = {"M1_B_span_last": np.arange(40 * 5000, dtype=np.float32).reshape(40, 5000), "M1_C": np.asfortranarray(np.arange(6.0).reshape(2, 3)), "none": np.arange(4, dtype=np.float16)}
    buffer = io.BytesIO()
    save(buffer, **arrays)
    for key, value in arrays.items():
        member = zipfile.ZipFile(buffer).getinfo(f"{key}.npy")
        rows = np.atleast_2d(value)
        assert all((v == rows[i]).all() for i, v in archive_source.layers(buffer, member, None))
        for wanted in ({0}, {1, 37}, {99}):
            got = dict(archive_source.layers(buffer, member, wanted))
            assert set(got) == {w for w in wanted if w < len(rows)} and all((v == rows[i]).all() for i, v in got.items())
    file = Counted(buffer.getvalue())
    member = zipfile.ZipFile(file).getinfo("M1_B_span_last.npy")
    file.total = 0
    assert len(list(archive_source.layers(file, member, {31}))) == 1
    if save is np.savez:
        assert file.total < 5000 * 4 + 400


def test_archive_filters_reach_the_reader(spark, tmp_path, monkeypatch):
    for k in range(30):
        np.savez(tmp_path / f"M{k}.npz", B_span_last=np.full((4, 3), k), C_prompt_last=np.full((4, 3), -k))
    monkeypatch.setattr(archive_source, "PARTITION_BYTES", 2000)
    df = readers.archives(spark, str(tmp_path))
    assert df.count() == 240
    one = df.where("item = 'M7' AND pos = 'span_last' AND layer IN (1, 3)")
    assert sorted((r.item, r.cond, r.layer, r.vec) for r in one.collect()) == [("M7", "B", k, [7.0] * 3) for k in (1, 3)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "M7" not in plan and "span_last" not in plan and " IN " not in plan  # Spark filters for nulls alone
    reader = archive_source.ArchiveReader({"path": str(tmp_path)})
    assert len(reader.partitions()) > 5 and sum(len(s.files) for s in reader.partitions()) == 30
    large = tmp_path / "large"
    large.mkdir()
    np.savez(large / "M1.npz", **{f"B_p_{c}": np.ones((2, 200)) for c in "abcdef"})
    assert len(archive_source.ArchiveReader({"path": str(large)}).partitions()) > 1
    assert readers.archives(spark, str(large)).count() == 12


def test_profile(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": "y"}',)], "j string")
    got = {r.key: (list(r.types), r.n) for r in readers.profile(df, "j").collect()}
    assert got["a"] == (["BIGINT", "STRING"], 2) and got["b"] == (["STRING"], 1)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, "text"), ("b", 1, "error")], SCHEMA)
    path = str(tmp_path / "log")
    assert sinks.append_missing(rows, path, ["pid", "rep"], SCHEMA) == 2
    assert sinks.append_missing(rows.union(spark.createDataFrame([("c", 0, "text")], SCHEMA)), path, ["pid", "rep"], SCHEMA) == 1
    sinks.split_write(rows, F.col("kind") == "text", str(tmp_path / "kept"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().pid == "b"
    manifest = spark.createDataFrame([("p", "s")], "path string, sha string")
    sinks.write_manifest(manifest, str(tmp_path / "m"))
    with pytest.raises(PySparkException):
        sinks.write_manifest(manifest, str(tmp_path / "m"))
    assert sinks.markdown_table(spark.createDataFrame([(1, 0.5)], "a int, b double")) == "| a | b |\n| --- | --- |\n| 1 | 0.500 |"
    sinks.write_csv(spark.createDataFrame([(True,)], "f boolean"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().f == "1"


def test_three_dedup_policies(spark):
    rows = [("a", 0, "error", 1), ("a", 0, "text", 2), ("a", 0, "late", 3), ("b", 0, "text", 4), ("b", 0, "error", 5), ("c", 0, "error", 6)]
    df = spark.createDataFrame(rows, "pid string, rep int, label string, ord int")
    first = dedup.first_success(df, ["pid", "rep"], "ord", F.col("label") == "error").orderBy("pid").collect()
    assert [(r.label, r.first_ord, r.n_extra) for r in first] == [("text", 1, 2), ("text", 4, 1), ("error", 6, 0)]
    assert [r.label for r in dedup.first_row(df, ["pid", "rep"], "ord").orderBy("pid").collect()] == ["error", "text", "error"]
    assert [r.label for r in dedup.last_row(df.where("label <> 'error'"), ["pid", "rep"], "ord").orderBy("pid").collect()] == ["late", "text"]
    with pytest.raises(ValueError):
        dedup.require_unique(df, ["pid", "rep"])


def test_labels_of_odd_texts(spark):
    texts = [None, "", "  \n", "[OPT-OUT-HARD] no", "see [OPT-OUT-SOFT]", "[OPT-OUT-BAD] x", "ACTION: publish_intent\nmore", "I reflected", "ACTION later", "declined and reflected ACTION"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    t = F.col("t")
    got = df.select("i", L.coarse_by_action(F.lit("text"), F.lit(""), t).alias("a"), L.coarse_by_keyword(F.lit("text"), F.lit(""), t).alias("k"), L.use_or_mention(t).alias("u"), L.action(t).alias("x")).orderBy("i").collect()
    assert [r.a for r in got] == ["text", "text", "text", "optout", "text", "text", "publish", "text", "text", "decline"]
    assert [r.k for r in got] == ["text", "text", "text", "optout", "text", "text", "publish", "reflect", "text", "decline"]
    assert [r.u for r in got] == ["none", "none", "none", "use", "mention", "use", "none", "none", "none", "none"]
    assert [r.x for r in got][6:] == ["publish_intent", "", "action_line_unparsed", "declined"]
    strict = df.where("i = 1").select(L.coarse_by_action(F.lit("text"), F.lit(""), t, F.lit("genesis")).alias("a")).first().a
    assert strict == "noncompliant"
    with pytest.raises(PySparkException):
        df.where("i = 7").select(L.norm_condition(t)).collect()


def test_as_of_and_manifest(spark):
    facts = spark.createDataFrame([("2024-01-01",), ("2024-02-01",), ("2024-03-05",)], "at string")
    eras = spark.createDataFrame([("2024-02-01", "x"), ("2024-03-01", "y")], "since string, specs string")
    assert [r.specs for r in as_of(facts, eras, F.col("at"), "since", "specs", F.lit("d")).orderBy("at").collect()] == ["d", "x", "y"]
    a = spark.createDataFrame([("p", "1"), ("q", "1"), ("r", "1")], "k string, v string")
    b = spark.createDataFrame([("p", "1"), ("q", "2"), ("s", "1")], "k string, v string")
    assert {r.k: r.state for r in full_comparison(a, b, "k", "v").collect()} == {"p": "ok", "q": "MISMATCH", "r": "MISSING", "s": "UNLISTED"}


def test_binomial_and_guarded_correlation(spark):
    from math import comb

    cases = [(k, n) for n in (0, 1, 2, 7, 30, 200) for k in {0, n // 3, n // 2, n}]
    rows = spark.createDataFrame(cases, "k long, n long").select("k", "n", binomial_p(F.col("k"), F.col("n")).alias("p")).collect()
    for k, n, p in rows:
        want = None if n == 0 else min(1.0, sum(comb(n, i) for i in range(n + 1) if comb(n, i) <= comb(n, k)) / 2**n)
        assert (p is None) if n == 0 else abs(p - want) < 1e-9
    df = spark.createDataFrame([("flat", 1.0, 1.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("ok", 1.0, 2.0), ("ok", 2.0, 4.0), ("ok", 3.0, 6.0), ("few", 1.0, 1.0)], "g string, x double, y double")
    got = {r.g: r.c for r in df.groupBy("g").agg(safe_corr(F.col("x"), F.col("y")).alias("c")).collect()}
    assert got["flat"] is None and got["few"] is None and abs(got["ok"] - 1) < 1e-12


def test_lines_are_numbered_across_splits(spark, tmp_path):
    """A file read in many splits has the numbers that its lines have in order, blank ones counted."""
    lines = [f"line {i} " + "x" * (i % 50) if i % 7 else "" for i in range(1, 3001)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("one\ntwo")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = readers.numbered_lines(spark, str(tmp_path / "*.txt"), lenient=False).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    found = {(r.file[-5], r.ord): r.value for r in rows}
    assert found == {("a", i + 1): v for i, v in enumerate(lines)} | {("b", 1): "one", ("b", 2): "two"}


def test_shards_results_and_reports(spark, tmp_path):
    for start in (200, 0, 100):
        (tmp_path / f"shard_{start}.json").write_text(f'{{"start": {start}, "end": {start + 100}, "seed": 7}}\n')
    shards = readers.ordered_shards(spark, str(tmp_path / "shard_*.json"), "start int, end int, seed int").collect()
    assert [r.start for r in shards] == [0, 100, 200]
    for name in ("T1", "T2"):
        sinks.append_result(spark.createDataFrame([(name, "PASS", 0.5)], "id string, status string, share double"), str(tmp_path / "results"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "results")).collect()) == [("T1", "PASS", '{"share":0.5}'), ("T2", "PASS", '{"share":0.5}')]
    df = spark.createDataFrame([(2, "b" * 200), (1, "a|a")], "k int, v string")
    assert sinks.inspection(df, "k").splitlines()[0] == "k=1 | v=a|a" and sinks.inspection(df, "k").endswith("...")
    report = sinks.markdown_report("Study", [("First", df.limit(1)), ("Second", df)])
    assert report.startswith("# Study\n\n## First") and "a\\|a" in report


def test_substrings_short_long_and_empty(spark):
    """Against a plain search, for parts of all lengths; an empty part is in every text."""
    texts = [(i, t) for i, t in enumerate(["the quick brown fox jumps over the lazy dog near the river bank today", "quick", "", "a b", "xa by", None, "the quick  brown fox jumps over the lazy dog near the river bank today"])]
    df = spark.createDataFrame(texts, "id long, t string")
    for parts in (["quick", "a b"], ["ick brown fox jumps over the lazy dog near the river ba"], ["zzz"], [""], [], ["b", "quick  brown"]):
        p = spark.createDataFrame([(x,) for x in parts], "p string")
        want = {i for i, t in texts if t is not None and any(x in t for x in parts)}
        assert {r.id for r in joins.contains_any(df, "id", "t", p, "p").collect()} == want
        assert {r.id for r in joins.contains_any(df, "id", "t", p, "p", most_chars=4).collect()} == want  # several automata


def test_many_parts_shuffle_less_than_the_input(spark, tmp_path):
    """200,000 parts: the plan shuffles parts to make them distinct and the keys found, never a text."""
    texts = spark.range(400).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(400)), lambda i: F.concat(F.lit("w"), (F.col("id") * 401 + i).cast("string")))).alias("t"))
    parts = spark.range(200_000).select(F.when(F.col("id") % 1000 == 0, F.concat_ws(" ", F.concat(F.lit("w"), F.col("id").cast("string")), F.concat(F.lit("w"), (F.col("id") + 1).cast("string")))).otherwise(F.concat(F.lit("none"), F.col("id").cast("string"))).alias("p"))
    found = joins.contains_any(texts, "id", "t", parts, "p")
    assert {r.id for r in found.collect()} == {i // 401 for i in range(0, 160_400, 1000) if i % 401 < 400}
    plan = found._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanged and not any("t#" in line for line in exchanged)


def test_blocks_that_cannot_reach_the_threshold_are_passed_over(spark):
    """Vectors in narrow bundles: most pairs of blocks are never made, and the results equal all pairs."""
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(12, 16))
    x = np.array([middle[i % 12] + rng.normal(size=16) * 0.1 for i in range(600)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    store = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(4)
    queries = store.select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    pivots = x[:12]
    for least in (0.25, 0.55, 0.9):
        score = x @ x.T
        want = set()
        for q in range(600):
            near = sorted((-score[q, s], s) for s in range(q) if score[q, s] >= least)[:5]
            want |= {(q, s, r + 1) for r, (_, s) in enumerate(near)}
        assert {(r.query_id, r.id, r.rank) for r in joins.top_similar(queries, store, 5, least, most=64).collect()} == want
        named, blocks = joins.blocked(joins.shaped(store, "id", "vec", pivots), "id", 64)
        made, every = joins.tiles(blocks, blocks, pivots, least).count(), blocks.count() ** 2
        assert made < every * {0.25: 0.75, 0.55: 0.4, 0.9: 0.12}[least], (least, made, every)


def test_guards(spark):
    df = spark.createDataFrame([("train", 1), ("test", 2)], "split string, k int")
    assert guards.open_splits(df, "explore").count() == 1 and guards.open_splits(df, "confirm").count() == 2
    digest = lambda d: guards.rows_digest(d, ["split"], ["k"]).collect()
    assert digest(df) == digest(df.orderBy("k")) and digest(df) != digest(df.withColumn("k", F.lit(1)))
    with pytest.raises(ValueError):
        guards.require_open(spark.createDataFrame([("a", "rows changed")], "c string, state string"), "state")
    rows, lookup = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 0.5)], "k int, base double")
    with pytest.raises(Exception, match="no base for 2"):
        joins.required(rows, lookup, ["k"], "base").collect()
    assert joins.required(rows.where("k = 1"), lookup, ["k"], "base").first().base == 0.5


def test_numbers_by_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), (F.col("id") % 2).alias("g")).repartition(5)
    assert {(r.k, r.n) for r in order.numbered(df, None, "k", "n").collect()} == {(i, i + 1) for i in range(1000)}
    one = sorted((r.k, r.n) for r in order.numbered(df, "g", "k", "n").where("g = 1").collect())
    assert [n for _, n in one] == list(range(1, 501))


def test_eras_by_ranges_as_by_folding(spark, monkeypatch):
    facts = spark.createDataFrame([(i, i * 37 % 500) for i in range(400)], "id int, t int").repartition(6)
    eras = spark.createDataFrame([(50 * k + 7, f"era{k}") for k in range(9)] + [(107, "era2a"), (107, "a"), (207, None)], "since int, specs string")
    folded = sorted(tuple(r) for r in as_of(facts, eras, F.col("t"), "since", "specs", F.lit("none")).collect())
    monkeypatch.setattr(joins, "FEW", 3)
    ranged = sorted(tuple(r) for r in as_of(facts, eras, F.col("t"), "since", "specs", F.lit("none")).collect())
    assert ranged == folded and {r[2] for r in ranged} >= {"none", "era0", "era2a", "era8"} and not {"a", "era2"} & {r[2] for r in ranged}
    with pytest.raises(ValueError):
        joins.prior_rows(facts, eras, "t", "since", "specs")


def test_pairs_of_blocks_give_few_rows_and_ties_keep_their_order(spark):
    """Copies of one vector, a zero vector, and texts that are equal or missing: at most k rows a query leave a pair of blocks."""
    import numpy as np

    v = np.random.default_rng(3).normal(size=(40, 7))
    x = np.repeat(v / np.linalg.norm(v, axis=1, keepdims=True), 5, axis=0)
    x[11] = 0
    text = [None if i % 9 == 0 else i % 4 for i in range(200)]
    want = set()
    for q in range(200):
        score = {i: float((x[q] * x[i]).sum()) for i in range(q) if text[i] != text[q]}
        best = sorted((i for i in score if score[i] >= 0.3), key=lambda i: (-score[i], i))[:2]
        want |= {(q, i, rank + 1) for rank, i in enumerate(best)}
    held = joins._best([np.arange(200), x, np.zeros(200), np.zeros(200)], [np.arange(200), x, np.zeros(200), np.zeros(200)], 2, 0.3, False)
    assert np.bincount(held.column(0).to_numpy()).max() == 2
    store = spark.createDataFrame([(i, x[i].tolist(), text[i]) for i in range(200)], "id long, vec array<double>, text long")
    queries = store.selectExpr("id AS query_id", "vec AS query_vec")
    texts = (store.selectExpr("id AS query_id", "text AS query_text"), store.select("id", "text"))
    for most in (32, 4096):
        assert {(r.query_id, r.id, r.rank) for r in joins.top_similar(queries, store.select("id", "vec"), 2, 0.3, other=texts, most=most).collect()} == want


def brute_top(x, k, least):
    """(query, earlier row, rank) by scores made one by one."""
    want = set()
    for q in range(1, len(x)):
        score = (x[q] * x[:q]).sum(axis=1)
        best = sorted(np.flatnonzero(score >= least), key=lambda i: (-score[i], i))[:k]
        want |= {(q, int(i), rank + 1) for rank, i in enumerate(best)}
    return want


def test_vectors_pass_by_shelves_of_bounded_size(spark, monkeypatch):
    """No row of the plan holds a block, and the rows sent are those of shelves, of which each has a bounded number."""
    monkeypatch.setattr(joins, "SHELF_BYTES", 150 * 8 * 8)
    x = np.random.default_rng(11).normal(size=(1200, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    store = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    found = joins.top_similar(store.selectExpr("id AS query_id", "vec AS query_vec"), store, 3, 0.4, most=60)
    assert {(r.query_id, r.id, r.rank) for r in found.collect()} == brute_top(x, 3, 0.4)
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()
    named, _ = joins.blocked(joins.shaped(store, "id", "vec", x[:20]), "id", 60)
    sizes = [r["count"] for r in named.join(joins.shelved(named, 150), "_block").groupBy("_shelf").count().collect()]
    assert sum(sizes) == 1200 and len(sizes) >= 8 and max(sizes) < 150 + 2 * 60


def test_scores_closer_than_single_precision_keep_their_order():
    """A crowd of vectors that only double precision tells apart, copies among them, and one that holds no number."""
    rng = np.random.default_rng(5)
    x = np.tile(rng.normal(size=16), (700, 1)) + rng.integers(0, 50, (700, 1)) * rng.normal(size=16) * 1e-8
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[300] = np.nan
    ids, none = np.arange(700), np.zeros(700, bool)
    with np.errstate(invalid="ignore"):
        got = joins._best([ids, x, -ids, none], [ids, x, -ids, none], 4, 0.25, True).to_pydict()
        want = brute_top(x, 4, 0.25)
    assert set(zip(got["query_id"], got["id"], strict=True)) == {(q, s) for q, s, _ in want}


def test_texts_are_told_apart_across_shelves(spark, monkeypatch):
    """Many copies of few vectors with equal, other and missing texts, and a null vector: shelves give what one block gives."""
    monkeypatch.setattr(joins, "SHELF_BYTES", 40 * 6 * 8)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(30, 6))[rng.integers(0, 30, 300)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    text = [None if i % 7 == 0 else int(t) for i, t in enumerate(rng.integers(0, 3, 300))]
    want = set()
    for q in range(300):
        score = {i: float((x[q] * x[i]).sum()) for i in range(q) if text[i] != text[q]}
        want |= {(q, i, rank + 1) for rank, i in enumerate(sorted((i for i in score if score[i] >= 0.55), key=lambda i: (-score[i], i))[:5])}
    rows = [(i, x[i].tolist(), text[i]) for i in range(300)] + [(300, None, 1)]
    store = spark.createDataFrame(rows, "id long, vec array<double>, text long")
    texts = (store.selectExpr("id AS query_id", "text AS query_text"), store.select("id", "text"))
    found = joins.top_similar(store.selectExpr("id AS query_id", "vec AS query_vec"), store.select("id", "vec"), 5, 0.55, other=texts, most=24)
    assert {(r.query_id, r.id, r.rank) for r in found.collect()} == want and len(want) > 300
