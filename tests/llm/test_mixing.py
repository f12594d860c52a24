import math
from collections import Counter

from pyspark.sql import functions as F

from probelight.llm import mixing
from tests.llm.helpers import DOCS, documents, poisson, unit


def test_counts_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "source").collect()
    n = Counter(r.source for r in rows)
    weight = {s: math.sqrt(c) for s, c in n.items()}
    mean = {s: weight[s] / sum(weight.values()) * len(rows) / n[s] for s in n}
    want = {r.doc_id: poisson(mean[r.source], unit("mix", r.doc_id, 1)) for r in rows}
    got = Counter(r.doc_id for r in mixing.poisson_mix(docs).select("doc_id").collect())
    assert got == Counter({d: c for d, c in want.items() if c})


def test_targets_nulls_repeats_and_clashing_columns(spark):
    rows = [(i % 500, f"t{i}", "en", ("a", "b", None)[i % 3], 2) for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("copy_no", F.lit("old"))
    out = mixing.poisson_mix(docs, {"a": 3.0, "b": 1.0}, total=4000).groupBy("source").count().collect()
    share = {r.source: r["count"] for r in out}
    assert None not in share and abs(share["a"] / 3000 - 1) < 0.15 and abs(share["b"] / 1000 - 1) < 0.2


def test_large_means_are_sums_of_parts(spark):
    docs = spark.createDataFrame([(i, "t", "en", "a", 1) for i in range(50)], DOCS)
    assert abs(mixing.poisson_mix(docs, total=50 * 200).count() / 10_000 - 1) < 0.05


def test_empty_table(spark):
    assert mixing.poisson_mix(documents(spark, [])).count() == 0


def test_columns_of_any_name_come_back(spark):
    docs = documents(spark, [f"t{i}" for i in range(300)])
    names = ("parts", "cdf", "rate_source", "_rate_source", "_row", "_source", "mean", "rate")
    for name in names:
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    out = mixing.poisson_mix(docs)
    assert out.columns == [*docs.columns, *mixing.ADDED]
    assert out.count() and all(r[n] == f"own {n}" for r in out.collect() for n in names)
