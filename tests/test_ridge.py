"""Ridge lines in both forms, nested decoding over Spark by both, and decoding rerun inside resamples, against loops over rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from probelight.operators import ridge as R
from probelight.operators.models import PENALTIES
from probelight.plans import models as plans

SCHEMA = "pair long, clause int, cls string, span long, fold int, b array<double>, c array<double>"


def study(spark, pairs, dims, noise=2.0, seed=3):
    rng = np.random.default_rng(seed)
    shift = rng.normal(size=dims)
    rows = []
    for i in range(pairs):
        b = rng.normal(size=dims) * 2 + 1
        rows.append((i, i % 4, "xy"[i // 4 % 2], i // 3 % 17, i // 3 % 17 % 5, b.tolist(), (b + shift + rng.normal(size=dims) * noise).tolist()))
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain_line(x, y, penalty):
    """Normal equations on standardised columns, row by row; as a function of a plain vector."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-8
    z = (x - mean) / spread
    w = np.linalg.solve(z.T @ z + penalty * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return lambda v: (v - mean) / spread @ w + y.mean()


@pytest.mark.parametrize("shape", [(30, 8), (12, 40), (20, 20)])
def test_weighted_lines_equal_lines_of_repeated_rows(shape):
    rng = np.random.default_rng(1)
    x, y, w = rng.normal(size=shape) * 3 + 1, rng.normal(size=shape[0]), rng.integers(0, 4, shape[0])
    weights, free = R.weighted_lines(x, y, w, PENALTIES)
    for i, penalty in enumerate(PENALTIES):
        line = plain_line(np.repeat(x, w, axis=0), np.repeat(y, w), penalty)
        assert np.allclose(line(x), x @ weights[i] + free[i], atol=1e-7)


def test_kernel_form_equals_moments_on_64_components(spark):
    rows, df = study(spark, 120, 64)
    chosen, lines = R.leave_one_out(df, [0, 1, 2, 3], 64)
    kernel_chosen, kernel_lines = R.kernel_leave_one_out(df, [0, 1, 2, 3], 64)
    assert chosen == kernel_chosen
    for c in range(4):
        assert np.allclose(lines[c][0], kernel_lines[c][0], atol=1e-10) and np.isclose(lines[c][1], kernel_lines[c][1], atol=1e-9)


def test_kernel_form_is_chosen_and_equals_loops_when_rows_are_few(spark):
    rows, df = study(spark, 24, 700)
    chosen, lines = R.leave_one_out(df, [0, 1, 2, 3], 700)
    x, y = np.array([r[6] for r in rows] + [r[5] for r in rows]), np.repeat([1.0, -1.0], len(rows))
    own, fold = (np.tile([r[k] for r in rows], 2) for k in (1, 4))
    for g in range(4):
        scores = []
        for penalty in PENALTIES:
            each = [np.mean(np.sign(plain_line(x[t], y[t], penalty)(x[v])) == y[v]) for f in range(5) for t, v in [((own != g) & (fold != f), (own != g) & (fold == f))] if v.any()]
            scores.append(np.mean(each))
        assert chosen[g] == next(p for p, s in zip(PENALTIES, scores, strict=True) if s >= max(scores) - 1e-12)
        line = plain_line(x[own != g], y[own != g], chosen[g])
        assert np.allclose(line(x), x @ lines[g][0] + lines[g][1], atol=1e-7)


def test_a_study_of_300_rows_and_4096_components(spark):
    rows, df = study(spark, 150, 4096, noise=8.0)
    chosen, lines = R.leave_one_out(df, [0, 1, 2, 3], 4096)
    assert set(chosen) == {0, 1, 2, 3} and all(len(w) == 4096 for w, _ in lines.values())
    assert np.mean([(np.array(r[6]) - np.array(r[5])) @ lines[r[1]][0] > 0 for r in rows]) > 0.9


def refitted(rows, w, fold, folds=5):
    """The macro accuracy of a resample, from rows repeated and fitted one by one."""
    x, y = np.array([r[6] for r in rows] + [r[5] for r in rows]), np.repeat([1.0, -1.0], len(rows))
    own, part, times = np.tile([r[1] for r in rows], 2), np.tile(fold, 2), np.tile(w, 2).astype(int)
    accuracy = []
    for g in sorted({r[1] for r, n in zip(rows, w, strict=True) if n}):
        scores = []
        for penalty in PENALTIES:
            each = []
            for f in range(folds):
                t, v = (np.repeat(np.arange(len(x)), np.where((own != g) & keep, times, 0)) for keep in (part != f, part == f))
                if len(t) and len(v):
                    each.append(np.mean(np.sign(plain_line(x[t], y[t], penalty)(x[v])) == y[v]))
            scores.append(np.mean(each) if each else -1)
        penalty = next(p for p, s in zip(PENALTIES, scores, strict=True) if s >= max(scores) - 1e-12)
        t = np.repeat(np.arange(len(x)), np.where(own != g, times, 0))
        line = plain_line(x[t], y[t], penalty)
        mine = [(line(np.array(r[6])) > line(np.array(r[5])), n) for r, n in zip(rows, w, strict=True) if r[1] == g and n]
        accuracy.append(sum(h * n for h, n in mine) / sum(n for _, n in mine))
    return np.mean(accuracy)


@pytest.mark.parametrize("shape", [(60, 6), (20, 60)])
def test_resamples_equal_refits_row_by_row(spark, shape):
    rows, df = study(spark, *shape, noise=6.0)
    found = {r["draw"]: r["macro"] for r in R.nested_resamples(df, 20, seed=5).collect()}
    stratum = np.unique([f"{r[1]}|{r[2]}" for r in rows], return_inverse=True)[1]
    span = np.unique([str(r[3]) for r in rows], return_inverse=True)[1]
    for d in range(20):
        w = R.resample_weights(stratum, span, 6 + d)
        assert all(w[stratum == s].sum() > 0 for s in set(stratum))
        fold = R.shuffled_folds(span, w, 5, 6 + d)
        assert np.isclose(found[d], refitted(rows, w, fold))


def test_resamples_draw_as_many_spans_as_a_stratum_has():
    stratum, span = np.repeat([0, 1], 30), np.tile(np.arange(10), 6)
    for seed in range(50):
        w = R.resample_weights(stratum, span, seed)
        for s in (0, 1):
            per_span = [set(w[(stratum == s) & (span == i)]) for i in range(10)]
            assert all(len(p) == 1 for p in per_span) and sum(p.pop() for p in per_span) == 10


def test_folds_have_equally_many_spans(spark):
    _, df = study(spark, 200, 2)
    sizes = plans.with_folds(df.drop("fold")).groupBy("fold").agg(F.countDistinct("span").alias("n")).collect()
    assert sorted(r["n"] for r in sizes) == [3, 3, 3, 4, 4]


def test_a_study_too_large_for_a_task_stops_with_its_size(spark, monkeypatch):
    monkeypatch.setattr(R, "STUDY_BYTES", 1000)
    with pytest.raises(ValueError, match="MB"):
        R.nested_resamples(study(spark, 40, 4)[1], 3)


@pytest.mark.parametrize("stored", ["float", "double"])
def test_a_large_study_of_few_cells_streams_by(spark, monkeypatch, stored):
    """A study beyond what a task may hold, in many small rows of the stream and more tasks than cores; some pairs are equal."""
    rows, df = study(spark, 4000, 2, noise=6.0)
    double, df = "array<double>", df.withColumn("c", F.when(F.col("pair") % 9 == 0, F.col("b")).otherwise(F.col("c")))
    df = df.withColumns({x: F.col(x).cast(f"array<{stored}>") for x in ("b", "c")}).persist()
    monkeypatch.setattr(R, "STUDY_BYTES", 100_000)
    monkeypatch.setattr(R, "LINES_BYTES", 20_000)
    monkeypatch.setattr(R, "CELL_PAIRS", 7)
    found = {r["draw"]: r["macro"] for r in R.nested_resamples(df, 12, seed=5).collect()}
    rows = df.select("clause", F.concat_ws("|", "clause", "cls").alias("s"), F.col("span").cast("string").alias("span"), F.col("b").cast(double).alias("b"), F.col("c").cast(double).alias("c")).collect()
    clause, stratum, span = (np.unique([str(r[i]) for r in rows], return_inverse=True)[1] for i in range(3))
    b, c = (np.array([r[i] for r in rows]) for i in (3, 4))
    assert set(found) == set(range(12))
    for d in range(12):
        w = R.resample_weights(stratum, span, 6 + d)
        assert np.isclose(found[d], R.decoded_macro(b, c, clause, R.shuffled_folds(span, w, 5, 6 + d), w, 5), atol=1e-12)
