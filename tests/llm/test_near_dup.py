import random

import numpy as np
from pyspark.sql import functions as F

from probelight.llm import near_dup, queries
from tests.llm.helpers import DOCS, EDGE_TEXTS, components, documents


def check(got, texts, words, percent):
    root, sizes = components(texts, words, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (sizes[i], root[i], root[i] == i) for i in texts}


def test_matches_all_pairs(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check(queries.op4_minhash_near_dup(spark, sf_dir).collect(), texts, 3, 85)


def test_groups_of_copies_edges_and_clashes(spark):
    """Copies of a text with a growing number of edits: some link only through others, some to none."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    texts = list(EDGE_TEXTS)
    for i in range(60):
        own = base.copy()
        for _ in range(i % 7):
            own[rng.randrange(len(own))] = f"edit{rng.randrange(10**9)}"
        texts.append(" ".join(own))
    docs = documents(spark, texts).withColumn("component_id", F.lit("x")).withColumn("node", F.lit(0))
    check(near_dup.near_duplicates(docs, words=3, share=0.85).collect(), dict(enumerate(texts)), 3, 85)


def test_passages_in_common_and_parts_of_a_bucket(spark, monkeypatch):
    """Texts that share most of a passage but belong to several groups, with buckets dealt over many parts."""
    monkeypatch.setattr(near_dup, "PART_NODES", 2)
    rng = random.Random(8)
    passage = [f"p{rng.randrange(4000)}" for _ in range(100)]
    texts = []
    for _ in range(12):
        group = passage + [f"g{rng.randrange(10**9)}" for _ in range(rng.choice((8, 12, 20, 60)))]
        for _ in range(5):
            own = group.copy()
            for _ in range(rng.randrange(6)):
                own[rng.randrange(len(own))] = f"edit{rng.randrange(10**9)}"
            texts.append(" ".join(own))
    check(near_dup.near_duplicates(documents(spark, texts), words=3, share=0.85).collect(), dict(enumerate(texts)), 3, 85)


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c d e f", "en", "s", 1)] * 3 + [(None, "a b c d e f", "en", "s", 1), (2, "a b c d e f", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = near_dup.near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert sorted(r.doc_id or 0 for r in near_dup.drop_near_duplicates(docs).collect()) == [0, 1]


def test_one_id_with_different_texts(spark):
    """No text is lost that has no near copy, and no group keeps two rows."""
    a, b, c = "a b c d e f g h", "one two three four five six seven", "l m n o p q r s"
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 2), (1, b, "en", "s", 2), (2, a, "en", "s", 1), (3, c, "en", "s", 1), (3, None, "en", "s", 0), (3, "", "en", "s", 0), (0, c, "de", "s", 1)]
    names = ["component_id", "node", "kept", "set_md5", "_id", "_md5", "first_id", "n", "_row", "key"]
    docs = spark.createDataFrame(rows, DOCS)
    for name in names:
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    out = near_dup.drop_near_duplicates(docs)
    kept = out.collect()
    assert out.columns == docs.columns and all(r[n] == f"own {n}" for r in kept for n in names)
    assert sorted((r.doc_id, r.text or "") for r in kept) == [(0, c), (1, a), (1, b), (3, "")]


def test_components_of_a_hub_and_a_path(spark):
    edges = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(60)]
    found = {r.node: r.component for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 300)} | {1001 + i: 1000 for i in range(60)}


def test_empty_table(spark):
    assert near_dup.near_duplicates(documents(spark, [])).count() == 0
    assert near_dup.drop_near_duplicates(documents(spark, [])).count() == 0


def test_labels_grow_as_components_of_all_links(spark):
    """Links in three parts, with new nodes, repeats and a long chain, against union-find over all."""
    rng = np.random.default_rng(6)
    parts = [rng.integers(0, 120, (40, 2)).tolist(), rng.integers(60, 200, (50, 2)).tolist(), [], [[i, i + 1] for i in range(300, 340)]]
    frame = lambda e: spark.createDataFrame([tuple(x) for x in e], "a long, b long")
    scratch = near_dup.Scratch(spark, "test")
    labels = near_dup.components(frame(parts[0]))
    for more in parts[1:]:
        labels = near_dup.grown(labels, frame(more), scratch)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in (e for p in parts for e in p):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {n: find(n) for a, b in (e for p in parts for e in p) for n in (a, b) if n != find(n)}  # the smallest node itself has no row
    assert {r.node: r.component for r in labels.collect()} == want


def test_a_grid_of_parts_meets_every_pair(spark, monkeypatch):
    """Buckets cut into very small parts, and steps written or not, give the same classes."""
    base = [f"w{i}" for i in range(60)]
    rng = np.random.default_rng(8)
    texts = []
    for _ in range(60):
        own = list(base)
        for k in rng.choice(60, rng.integers(0, 4), replace=False):
            own[k] = f"x{rng.integers(1000)}"
        texts.append(" ".join(own))
    docs = documents(spark, texts)
    want, _ = components(dict(enumerate(texts)), 3, 85)
    for nodes, edges in ((3, 0), (4096, 200_000)):
        monkeypatch.setattr(near_dup, "PART_NODES", nodes)
        monkeypatch.setattr(near_dup, "PLAIN_EDGES", edges)
        got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, words=3, share=0.85).collect()}
        assert got == want
