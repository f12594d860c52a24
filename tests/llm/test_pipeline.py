import base64
import hashlib
import math
from collections import Counter

import public_tokenizers as P
import tiktoken

from pyspark.sql import functions as F

import corpus_pipeline
from probelight.llm import quality
from probelight.llm.common import materialize
from tests.llm.helpers import EDGE_TEXTS, base_spans, components, documents, poisson, unit

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    (_, good), (_, unique), (_, clean), (_, mix), (_, tokens) = corpus_pipeline.STAGES
    kept = materialize(good(spark, docs, sf_dir), "t")
    want = {r.doc_id for r in quality.scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1").collect()}
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert set(texts) == want and kept.columns == columns

    alone = materialize(unique(spark, kept, sf_dir), "t")
    root, _ = components(texts, 5, 80)
    assert {r.doc_id for r in alone.collect()} == {i for i, r in root.items() if r == i} and alone.columns == columns

    private = materialize(clean(spark, alone, sf_dir), "t")
    after = {r.doc_id: r for r in private.collect()}
    assert private.columns == columns and len(after) == alone.count()
    for i, row in after.items():
        assert not base_spans(row.text) and row.n_chars == len(row.text)
        if not base_spans(texts[i]) and "[" not in row.text:
            assert row.text == texts[i]

    copies = materialize(mix(spark, private, sf_dir), "t")
    n = Counter(r.source for r in after.values())
    weight = {s: math.sqrt(c) for s, c in n.items()}
    rate = {s: weight[s] / sum(weight.values()) * len(after) / n[s] for s in n}
    drawn = Counter({i: c for i, r in after.items() if (c := poisson(rate[r.source], unit("mix", i, 1)))})
    assert Counter(r.doc_id for r in copies.collect()) == drawn and copies.columns == columns

    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in tokens(spark, copies, sf_dir).collect())
    ids = {i: TIKTOKEN.encode_ordinary(r.text) for i, r in after.items()}
    assert got == Counter({(i, len(ids[i]), hashlib.sha256(" ".join(map(str, ids[i])).encode()).hexdigest()): c for i, c in drawn.items()})


def test_run_has_the_columns_of_its_last_stage(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_every_stage_with_odd_rows(spark, sf_dir):
    """Null, empty and long texts, repeated rows, a null id and source, and columns named as the operators' own."""
    texts = [*EDGE_TEXTS, "The same words of a text that says something plain. " * 3]
    docs = documents(spark, texts).unionByName(documents(spark, texts[-3:])).unionByName(documents(spark, ["No id here at all, and no source."]).selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "lang", "CAST(NULL AS STRING) AS source", "n_chars"))
    for name in ("digits", "upper", "spans", "parts", "cdf", "rate_source", "set_md5", "component", "_row", "ids", "label"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out, none = materialize(stage(spark, docs, sf_dir), "odd"), stage(spark, empty, sf_dir)
        assert none.columns == out.columns and none.count() == 0, name
        if name != "bpe":
            assert out.columns == docs.columns
            assert all(r[c] == f"own {c}" for r in out.collect() for c in docs.columns[5:]), name
        else:
            assert out.count() == docs.count()
    # Stages that add and drop nothing keep every row's text.
    assert corpus_pipeline.STAGES[2][1](spark, docs, sf_dir).count() == docs.count()
