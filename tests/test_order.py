"""Ranks, rank sums and running sums by ranges, against plain versions."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from probelight.functions.stats import auroc, average_ranks, centred_corr, centred_ranks
from probelight.operators.order import sum_before


def rows_of(kind, n=3000):
    """Groups and values: a third of all rows in one group with one value, many ties, nulls in both, one empty table."""
    rng = random.Random(5)
    if kind == "empty":
        return []
    if kind == "equal":
        return [("a", 1.0, i % 2 == 0, i) for i in range(200)]
    rows = [("hot", 2.5, i % 3 == 0, i) for i in range(n // 3)]
    pick = lambda: rng.choice([None, -0.0, 0.0, float("inf"), round(rng.gauss(0, 2), 1), rng.random()])
    return rows + [(rng.choice(["hot", "b", None]), pick(), rng.random() < 0.4, i) for i in range(n // 3, n)]


def key(v):
    return (v is not None, v or 0.0)


@pytest.mark.parametrize("kind", ["mixed", "equal", "empty"])
def test_average_ranks(spark, kind):
    rows = rows_of(kind)
    df = spark.createDataFrame(rows, "g string, v double, pos boolean, id int")
    got = {r.id: r["rank"] for r in average_ranks(df, ["g"], "v", "rank").collect()}
    assert len(got) == len(rows)
    for group in {r[0] for r in rows}:
        values = [key(r[1]) for r in rows if r[0] == group]
        below = {v: sum(x < v for x in values) + (values.count(v) + 1) / 2 for v in set(values)}
        assert all(got[r[3]] == below[key(r[1])] for r in rows if r[0] == group)


@pytest.mark.parametrize("kind", ["mixed", "equal", "empty"])
def test_auroc(spark, kind):
    rows = [r for r in rows_of(kind, 900) if r[1] is not None]
    df = spark.createDataFrame(rows, "g string, v double, pos boolean, id int")
    got = {r.g: r for r in auroc(df, ["g"], "v", F.col("pos")).collect()}
    assert set(got) == {r[0] for r in rows}
    for group, found in got.items():
        yes, no = ([r[1] for r in rows if r[0] == group and r[2] is side] for side in (True, False))
        wins = sum((a > b) + (a == b) / 2 for a in yes for b in no)
        assert (found.n_pos, found.n_neg) == (len(yes), len(no)) and found.auroc == pytest.approx(wins / (len(yes) * len(no)))


def test_sums_before_without_groups(spark):
    rows = [(i * 7919 % 1000, i) for i in range(1000)]
    got = {r.at: r.s for r in sum_before(spark.createDataFrame(rows, "at int, n int"), [], "at", "n", "s").collect()}
    total = 0
    for at, n in sorted(rows):
        assert got[at] == total
        total += n


def test_many_ties_spread_over_tasks(spark):
    """The ranking never puts rows of one value or group on one task: only distinct values are ordered."""
    df = spark.range(200_000).select(F.lit("g").alias("g"), (F.col("id") % 1000).cast("double").alias("v"))
    out = average_ranks(df, ["g"], "v", "rank")
    found = out.groupBy("v").agg(F.min("rank").alias("low"), F.max("rank").alias("high")).orderBy("v").collect()
    assert [(r.low, r.high) for r in found] == [(200 * i + 100.5,) * 2 for i in range(1000)]


def test_picks_of_the_ratio_bootstrap_stay_off_the_driver(spark, sf_dir):
    """The picks look like a thousand rows to the planner; the join has to build on the points, by a shuffle."""
    from probelight.plans.audit import ratio_bootstrap

    plan = ratio_bootstrap(spark, sf_dir, draws=40)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Generate explode" in plan


@pytest.mark.parametrize("kind", ["mixed", "equal", "empty"])
def test_rank_correlation_of_counted_rows(spark, kind):
    """Rows that stand for several, ties, nulls in group and values: as from the ranks of all rows one by one; null without variance."""
    rng = random.Random(6)
    rows = [(g, v, v if rng.random() < 0.3 else rng.choice([None, 1.5, float(i % 7)]), rng.randint(1, 4)) for g, v, _, i in rows_of(kind, 600)] + [("few", 1.0, 2.0, 1), ("few", 2.0, 1.0, 1)]
    cells = spark.createDataFrame(rows, "g string, x double, y double, n long")
    ranked = centred_ranks(cells, "g", "n", {"x": "rx", "y": "ry"})
    got = {r.g: (r.n, r.rho) for r in ranked.groupBy("g").agg(F.sum("n").alias("n"), centred_corr(F.col("rx"), F.col("ry"), F.col("n")).alias("rho")).collect()}
    assert set(got) == {r[0] for r in rows}
    for group, (n, rho) in got.items():
        x, y = (np.array([1 + sum(w < v for w in values) + (values.count(v) - 1) / 2 for v in values]) for values in ([key(r[c]) for r in rows if r[0] == group for _ in range(r[3])] for c in (1, 2)))
        assert n == len(x)
        assert rho is None if n < 3 or x.std() * y.std() == 0 else rho == pytest.approx(np.corrcoef(x, y)[0, 1])


@pytest.mark.parametrize("name", ["spearman", "length_matched"])
def test_rank_correlations_read_the_study_once(spark, sf_dir, monkeypatch, tmp_path, name):
    """Each task that makes rows of the study leaves a file; there are as many as the study has partitions."""
    from probelight.plans import contrast, records

    study = contrast.complete(spark, sf_dir).localCheckpoint().repartition(3)

    def seen(batches):
        (tmp_path / uuid.uuid4().hex).touch()
        yield from batches

    module = contrast if name == "spearman" else records
    want = sorted(map(tuple, module.QUERIES[name](spark, sf_dir).collect()))
    monkeypatch.setattr(module, "complete", lambda spark, sf_dir: study.mapInArrow(seen, study.schema))
    assert sorted(map(tuple, module.QUERIES[name](spark, sf_dir).collect())) == want
    assert len(list(tmp_path.iterdir())) == 3
