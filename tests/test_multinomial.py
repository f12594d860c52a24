"""Counts of draws with replacement, split over blocks: whole, alike wherever they are made, and rightly distributed; the statistics on them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from probelight.functions.stats import binomial_p
from probelight.operators.multinomial import BLOCK, Splits, resampled_sums
from probelight.plans import resamples, study


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 1000, 5 * BLOCK + 3])
def test_counts_sum_to_n(n):
    s = Splits(3, "g", n, 50)
    counts = np.concatenate([s.counts(b) for b in range(s.blocks)], axis=1)
    assert counts.shape == (50, n) and (counts.sum(axis=1) == n).all()
    alone = [Splits(3, "g", n, 50).counts(b) for b in reversed(range(s.blocks))]
    assert (np.concatenate(alone[::-1], axis=1) == counts).all()  # a task that meets one block alone has the same


def test_counts_have_the_moments_of_a_multinomial():
    n, draws = 3 * BLOCK, 4000
    s = Splits(1, "g", n, draws)
    counts = np.concatenate([s.counts(b) for b in range(s.blocks)], axis=1)
    assert abs(counts.var() - (1 - 1 / n)) < 0.01
    apart = [np.cov(counts[:, i], counts[:, j])[0, 1] for i, j in ((0, 1), (0, n - 1), (BLOCK - 1, BLOCK))]
    assert all(abs(c + 1 / n) < 0.06 for c in apart)
    shares = np.bincount(counts.reshape(-1), minlength=5)[:5] / counts.size
    assert np.allclose(shares, [math.exp(-1) / math.factorial(k) for k in range(5)], atol=0.002)


def test_sums_equal_counts_times_values(spark):
    rng = np.random.default_rng(0)
    rows = [(g, i, float(rng.normal()), None if i % 9 == 0 else 1.0) for g, n in (("a", 700), ("b", 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i long, x double, y double").repartition(5)
    found = {(r["g"], r["draw"]): (r["x"], r["y"]) for r in resampled_sums(df, "g", "i", ["x", "y"], 40, 9).collect()}
    for g, n in (("a", 700), ("b", 3)):
        s = Splits(9, g, n, 40)
        counts = np.concatenate([s.counts(b) for b in range(s.blocks)], axis=1)
        v = np.array([[x, y or 0.0] for k, i, x, y in sorted(r for r in rows if r[0] == g)])
        assert np.allclose([found[g, d] for d in range(40)], counts @ v)


def test_full_bootstraps_agree_with_plain_ones(spark, sf_dir):
    """Ends of 10,000 draws against NumPy draws of the same rows; the counts differ, the distributions do not."""
    row = resamples.boot_ratio(spark, sf_dir).first()
    table = resamples.point_table(spark, sf_dir).where("m1_modal is not null and m2_modal is not null and m1_share > 0").toPandas()
    picks = np.random.default_rng(0).integers(0, len(table), (10_000, len(table)))
    ratio = np.sort(table.m2_to_m1.to_numpy(float)[picks].sum(axis=1) / table.m1_share.to_numpy(float)[picks].sum(axis=1))
    width = ratio[9749] - ratio[249]
    assert row.draws == 10_000 and abs(row.low - ratio[249]) < 0.06 * width and abs(row.high - ratio[9749]) < 0.06 * width
    strat = resamples.boot_stratified(spark, sf_dir).first()
    assert strat.draws == 10_000 and strat.least <= strat.low <= strat.point <= strat.high <= strat.largest
    iid = resamples.boot_iid(spark, sf_dir, 2000).collect()
    assert all(r.low <= r.mean <= r.high and r.draws == 2000 for r in iid)


def test_exact_binomial_at_any_size(spark):
    cases = [(k, n) for n in (1, 2, 3, 10, 51) for k in range(n + 1)] + [(500, 1000), (470, 1000), (5100, 10_001), (499_000, 10**6), (500_100, 10**6), (49_990_000, 10**8), (0, 400), (0, 0)]
    df = spark.createDataFrame(cases, "k long, n long")
    got = {(r["k"], r["n"]): r["p"] for r in df.withColumn("p", binomial_p(F.col("k"), F.col("n"))).collect()}
    for (k, n), p in got.items():
        if n == 0:
            assert p is None
        elif n <= 1000:
            want = 1.0 if 2 * k == n else min(1.0, 2 * sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n)
            assert math.isclose(p, want, rel_tol=1e-9), (k, n)
        else:
            z = (abs(2 * k - n) - 1) / math.sqrt(n)
            assert math.isclose(p, math.erfc(z / math.sqrt(2)), rel_tol=2e-3), (k, n)


def test_bundle_has_an_interval_of_single_pairs_where_clauses_are_no_clusters(spark):
    rows = [(s, i, c, 0.0, float((i % 3) - (i % 2)), float((i % 3) - (i % 2))) for s, clause in (("one", lambda i: "c"), ("each", str), ("some", lambda i: str(i % 5))) for i in range(60) for c in [clause(i)]]
    d = spark.createDataFrame(rows, "split string, item long, clause string, delta_b double, delta_c double, shift double")
    bounds = spark.createDataFrame([(s, -1.0, -1.0) for s in ("one", "each", "some")], "split string, low double, high double")
    auc = spark.createDataFrame([(s, 0.5) for s in ("one", "each", "some")], "split string, auroc double")
    got = {r["split"]: r for r in study.bundle(d, bounds, auc).collect()}
    assert (got["some"]["interval"], got["some"]["low"]) == ("cluster", -1.0)
    wins = np.array([1.0 if r[5] > 0 else 0.5 if r[5] == 0 else 0.0 for r in rows if r[0] == "one"])
    plain = wins[np.random.default_rng(1).integers(0, 60, (10_000, 60))].mean(axis=1)
    for s in ("one", "each"):
        assert got[s]["interval"] == "iid"
        assert np.allclose([got[s]["low"], got[s]["high"]], np.percentile(plain, [2.5, 97.5]), atol=0.02)
