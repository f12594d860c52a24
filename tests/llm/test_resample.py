import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from probelight.llm import resample
from tests.llm.helpers import EDGE_TEXTS, documents

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def features(text, longest):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(texts, target, longest=2, buckets=10_000, percent=25, least=20, seed=7):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in texts for f in features(t, longest))
    t = Counter(bucket(f) for x in target for f in features(x, longest))
    big_s, big_t = sum(s.values()), sum(t.values())
    rows, able = [], []
    for key, text in texts:
        found = features(text, longest)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in map(bucket, found)]
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gains) // len(gains) if gains else 0
        row = [key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        rows.append(row)
        if len(words(text)) >= least:
            able.append(row)
    able.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    for i, row in enumerate(able[: percent * len(able) // 100]):
        row[4] = i + 1
    return Counter(map(tuple, rows))


def result(docs, target, percent=25, least=20, **how):
    out = resample.ranked(resample.scores(docs, target, **how), percent=percent, least_words=least)
    return Counter(tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect())


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_matches_brute_force_on_odd_texts(spark, longest):
    texts = [*EDGE_TEXTS, "A\x00b\x7fC é_É ß", "zz " * 30, "zz " * 30, "plain words here " * 9, "1 2 3 4"]
    rows = list(enumerate(texts))
    docs = documents(spark, texts)
    target = ["same text here", None, "word word é"]
    want = brute(rows, target, longest, percent=60, least=2)
    bench = spark.createDataFrame([(str(i), t) for i, t in enumerate(target)], "item_id string, text string")
    assert result(docs, bench, 60, 2, longest=longest) == want


def test_nulls_repeats_ties_and_clashing_columns(spark):
    rows = [(None, "a b c"), (3, "a b c"), (3, "a b c"), (4, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("score", "rank", "weight", "_better", "n_words"):
        docs = docs.withColumn(name, F.lit("own"))
    bench = spark.createDataFrame([("x", "a b")], "item_id string, text string")
    assert result(docs, bench, 100, 0) == brute(rows, ["a b"], percent=100, least=0)
    assert resample.resampled(docs, bench, percent=100, least_words=3).columns == docs.columns


def test_one_score_for_many_keeps_the_order_of_ids(spark):
    scored = spark.createDataFrame([(i, 20, 39, 5, 77) for i in range(100)], "doc_id long, n_words long, n_features long, weight long, score long")
    drawn = resample.ranked(scored, percent=25).where("rank is not null").collect()
    assert sorted((r["rank"], r["doc_id"]) for r in drawn) == [(i + 1, i) for i in range(25)]


def test_empty_tables(spark):
    docs, none = documents(spark, ["a b", "c"]), documents(spark, [])
    assert result(none, none) == Counter()
    assert result(docs, none, 100, 0) == brute([(0, "a b"), (1, "c")], [], percent=100, least=0)


def test_resampled_documents_are_the_drawn_ones(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    drawn = {k[0] for k in result(docs, bench) if k[4] is not None}
    assert {r.doc_id for r in resample.resampled(docs, bench).collect()} == drawn and drawn
