import os

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from probelight.llm import common, quality, queries, textstats, toxicity
from tests.llm.helpers import EDGE_TEXTS, documents

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="needs labelled tables")


def held_out(spark, scored, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = scored(spark.read.parquet(f"{SF}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").select("predicted", label, "score").collect()
    assert all(0 <= r.score <= 1 for r in rows)
    return np.array([(r.predicted, r[label]) for r in rows])


def test_quality_on_held_out(spark):
    found = held_out(spark, quality.scored, "quality")
    assert (found[:, 0] == found[:, 1]).mean() > 0.95


def test_toxicity_on_held_out(spark):
    found = held_out(spark, toxicity.scored, "toxic")
    assert (found[:, 0] == found[:, 1]).mean() > 0.9
    assert found[found[:, 1] == 0, 0].mean() < 0.03  # clean documents are left alone


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_edges_without_labels(spark, module, label):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(spark, EDGE_TEXTS).withColumn("score", F.lit("x")).withColumn("upper", F.lit(1))
    rows = module.scored(docs, labels).collect()
    assert len(rows) == len(EDGE_TEXTS) and all(r.score in (0.0, 0.5) for r in rows)
    assert module.scored(documents(spark, []), labels).count() == 0


def test_statistics_do_not_depend_on_neighbours():
    raw, at = common.text_buffers(pa.array(EDGE_TEXTS))
    together = textstats.text_stats(raw, at)
    for i, t in enumerate(EDGE_TEXTS):
        assert np.allclose(together[i], textstats.text_stats(*common.text_buffers(pa.array([t], pa.string())))[0])


def test_rules_of_a_printed_tree():
    printed = "Tree\n  If (feature 0 <= 1.5)\n   Predict: 0.0\n  Else (feature 0 > 1.5)\n   If (feature 2 <= 0.5)\n    Predict: 1.0\n   Else (feature 2 > 0.5)\n    Predict: 0.0\n"
    names = textstats.STATS
    assert quality.tree_rules(printed) == {quality.Rule(((names[0], False, 1.5),)), quality.Rule(((names[0], True, 1.5),)), quality.Rule(tuple(sorted([(names[0], True, 1.5), (names[2], False, 0.5)]))), quality.Rule(tuple(sorted([(names[0], True, 1.5), (names[2], True, 0.5)])))}


def slow_stats(text):
    """Some of the statistics, word by word."""
    words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return {}
    lines = [x for x in text.split("\n") if x]
    solid = sum(len(w.encode()) for w in words)
    return {
        "log_words": np.log1p(len(words)), "distinct_words": len(set(words)) / len(words), "top_word": max(words.count(w) for w in set(words)) / len(words), "doubled_words": sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words),
        "distinct_lines": len(set(lines)) / len(lines), "digits": sum(c in "0123456789" for c in text) / solid, "pipes": text.count("|") / len(words), "bangs": text.count("!") / len(words), "word_length": solid / len(words),
    }


@pytest.mark.parametrize("name, label, folds, held, threshold", [("op2_rule_quality", "quality", 5, 0, 0.3), ("op6_gbt_toxicity", "toxic", 3, 1, 0.7)])
def test_query_over_the_whole_table(spark, name, label, folds, held, threshold):
    """A row a document, folds and decisions as stated, equal texts scored equally, and held-out labels met."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.QUERIES[name](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    by_text = {}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) and r.predicted == int(r.score >= threshold)
        assert 0 <= r.score <= 1 and by_text.setdefault(docs[r.doc_id], r.score) == r.score
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(judged) > 20 and np.mean([p == y for p, y in judged]) > 0.9


def test_statistics_against_slow_ones(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(200).collect()] + [t for t in EDGE_TEXTS if t]
    raw, at = common.text_buffers(pa.array(texts))
    found = textstats.text_stats(raw, at)
    for i, text in enumerate(texts):
        for name, value in slow_stats(text or "").items():
            assert np.isclose(found[i, textstats.STATS.index(name)], value), (i, name)


def test_rules_as_a_column_against_rows(spark):
    """The compiled score is the logistic of the weights of the rules that hold, for every document."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = textstats.with_stats(docs.limit(300)).withColumn("score", model.score()).collect()
    for r in rows:
        z = model.bias + sum(w for rule, w in model.weights.items() if all((r[s] > t) == greater for s, greater, t in rule.tests))
        assert np.isclose(r.score, 1 / (1 + np.exp(-z)))


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_fitted_model_on_odd_rows(spark, module, label):
    """Null, empty and long texts, a null id, repeated rows and labels, and columns named as the operators' own."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    odd = documents(spark, EDGE_TEXTS).selectExpr("IF(doc_id = 3, NULL, doc_id + 900000) AS doc_id", "text", "lang", "source", "n_chars")
    every = docs.unionByName(odd).unionByName(odd.where("doc_id = 900009"))
    for name in ("digits", "score", "label", "part", "chance", "features", "_text"):
        every = every.withColumn(name, F.lit("own"))
    rows = module.scored(every, labels.unionByName(labels.limit(50))).where("doc_id >= 900000 or doc_id is null").collect()
    assert len(rows) == len(EDGE_TEXTS) + 1 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    scores = {r.doc_id: r.score for r in rows}
    assert scores[900000] == scores[900001] and scores[900009] == scores[900010]
    assert [r.held_out for r in rows if r.doc_id is None] == [False]


def test_kept_rows_come_back_as_they_were(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    own = docs.withColumns({c: F.lit(777.0) for c in (*textstats.STATS, "_row", "_text")})
    kept = quality.keep_good(own, labels)
    assert kept.columns == own.columns and 0 < kept.count() < docs.count()
    assert kept.where("digits = 777 and upper = 777 and _text = 777").count() == kept.count()
