import hashlib
import itertools
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from probelight.operators import models as M
from probelight.operators import ridge as R
from probelight.plans import contrast, vectors
from probelight.plans import models as plans
from probelight.streaming import runlog


def test_lines_from_moments_are_ridge_lines():
    """Against the normal equations on standardised columns, for every penalty."""
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(40, 5)) * [1, 2, 3, 4, 5] + 1, rng.normal(size=40)
    weights, free = M.Moments(M.Moments.of(x, y), 5).lines(M.PENALTIES)
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-8)
    for i, penalty in enumerate(M.PENALTIES):
        want = np.linalg.solve(z.T @ z + penalty * np.eye(5), z.T @ (y - y.mean()))
        assert np.allclose(z @ want + y.mean(), x @ weights[i] + free[i])
    assert len(M.PENALTIES) == 13 and np.isclose(M.PENALTIES[0], 1e-3) and np.isclose(M.PENALTIES[-1], 1e3)


def units(spark, n=80, noise=0.1):
    rng = np.random.default_rng(1)
    shift = rng.normal(size=8) * 3
    rows = [(i, i % 4, (i // 4) % 5, (b := rng.normal(size=8)).tolist(), (b + shift * (noise < 1) + rng.normal(size=8) * noise).tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "pair long, clause int, fold int, b array<double>, c array<double>")


def test_nested_decoding_against_loops(spark):
    """Penalties, lines and accuracies against a plain version that refits on rows, fold by fold; all rows count."""
    rows, df = units(spark, 120, 3.0)
    chosen, lines = R.leave_one_out(df, [0, 1, 2, 3], 8)
    for clause in range(4):
        rest = [r for r in rows if r[1] != clause]

        def fit(part, penalty):
            x = np.array([r[4] for r in part] + [r[3] for r in part])
            y = np.repeat([1.0, -1.0], len(part))
            mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-8
            z = (x - mean) / spread
            w = np.linalg.solve(z.T @ z + penalty * np.eye(8), z.T @ (y - y.mean()))
            return lambda v: (np.array(v) - mean) / spread @ w + y.mean()

        scores = []
        for penalty in M.PENALTIES:
            by_fold = []
            for f in range(5):
                line, test = fit([r for r in rest if r[2] != f], penalty), [r for r in rest if r[2] == f]
                by_fold.append(np.mean([np.sign(line(r[4])) == 1 for r in test] + [np.sign(line(r[3])) == -1 for r in test]))
            scores.append(np.mean(by_fold))
        want = next(p for p, s in zip(M.PENALTIES, scores, strict=True) if s >= max(scores) - 1e-12)
        assert chosen[clause] == want
        line = fit(rest, want)
        w, c = lines[clause]
        assert all(np.isclose(line(r[3]), np.array(r[3]) @ w + c) for r in rows)


def test_nested_decoding_finds_a_planted_direction(spark):
    rows, df = units(spark)
    _, lines = R.leave_one_out(df, [0, 1, 2, 3], 8)
    assert all((np.array(r[4]) - np.array(r[3])) @ lines[r[1]][0] > 0 for r in rows)


def test_bag_of_words_tells_members_apart(spark):
    """A word that only one member has decides; a clause's own words do not make its vocabulary."""
    rows = [(i, i % 3, "train" if i % 10 < 6 else "dev" if i % 10 < 8 else "test", ["all", "old"], ["all", "new", f"x{i}"]) for i in range(60)]
    p = spark.createDataFrame(rows, "pair long, clause long, split string, b array<string>, c array<string>")
    bag, lines = plans._bag_lines(p.where("split = 'train'"), (1.0, 10.0), 2)
    assert bag.vocabulary == ["all", "new", "old"]
    weights = dict(zip(bag.vocabulary, lines[0].coefficients, strict=True))
    assert weights["new"] > 0.1 > weights["all"] > -0.1 > weights["old"]
    # The ridge line itself, from the normal equations: 72 rows, intercept free.
    x = np.array([[1.0, 0, 1]] * 36 + [[1.0, 1, 0]] * 36)
    y = np.repeat([-1.0, 1.0], 36)
    z = x - x.mean(axis=0)
    want = np.linalg.solve(z.T @ z + np.eye(3), z.T @ y)
    assert np.allclose(want, [weights[w] for w in bag.vocabulary], atol=1e-3)
    assert {r.w for r in plans._paired_scores(p.where("split = 'test'"), bag, lines[0], "w").collect()} == {1.0}


def test_stream_of_the_run_log(spark, tmp_path):
    source = spark.createDataFrame([(i % 7, f"2024-01-01 00:{i % 60:02d}:00", "view") for i in range(200)], "rep long, t string, label string").select("rep", F.col("t").cast("timestamp").alias("ts"), "label")
    source.repartition(4).write.parquet(str(tmp_path / "in"))
    log = runlog.read_log(spark, str(tmp_path / "in"), source.schema)
    once = runlog.first_sightings(log, ["rep", "ts"], "ts", "2 hours")
    query = runlog.write_counts(runlog.label_counts(once, "ts", "10 minutes", "label"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert query.exception() is None


def test_sign_flips_against_all_patterns(spark):
    """Every pattern enumerated, for one to nine clauses with ties; six clauses all above zero give one in sixty-four."""
    rng = np.random.default_rng(5)
    for means in ([1.0], [0.5, -0.5], [1.0, 1.0, 1.0], list(np.round(rng.normal(size=8), 2)), [0.25] * 9, [0.3, 0.1, 0.4, 0.1, 0.5, 0.9]):
        row = contrast.sign_flips(spark.createDataFrame([(f"c{i}", float(m)) for i, m in enumerate(means)], "clause string, m double")).first()
        signs = np.array(list(itertools.product((1, -1), repeat=len(means))))
        want = int((signs @ np.array(means) >= sum(means) - 1e-9).sum())
        assert (row.k, row.patterns, row.at_least, row.p) == (len(means), 2 ** len(means), want, round(want / 2 ** len(means), 6))
    assert row.p == 0.015625


def ridge_line(x, y, penalty):
    """Weights and intercept on plain columns, from standardised ones."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-8
    z = (x - mean) / spread
    w = np.linalg.solve(z.T @ z + penalty * np.eye(x.shape[1]), z.T @ (y - y.mean())) / spread
    return w, y.mean() - mean @ w


def fitted(pairs, penalty):
    x = np.concatenate([np.array([p.c for p in pairs]), np.array([p.b for p in pairs])]).astype(float)
    return ridge_line(x, np.repeat([1.0, -1.0], len(pairs)), penalty)


def wins(pairs, w):
    d = np.array([p.diff for p in pairs]) @ w
    return np.where(d > 0, 1.0, np.where(d == 0, 0.5, 0.0))


def hashed_folds(groups):
    order = sorted(set(groups), key=lambda g: hashlib.md5(str(g).encode()).hexdigest())
    return {g: (i + 1) % 5 for i, g in enumerate(order)}


def chosen_penalty(others, fold):
    means = []
    for a in M.PENALTIES:
        by_fold = []
        for f in range(5):
            test = [p for p in others if fold(p) == f]
            if test:
                w, c = fitted([p for p in others if fold(p) != f], a)
                by_fold.append(np.mean([np.sign(np.array(p.c) @ w + c) == 1 for p in test] + [np.sign(np.array(p.b) @ w + c) == -1 for p in test]))
        means.append(np.mean(by_fold))
    return next(a for a, m in zip(M.PENALTIES, means, strict=True) if m >= max(means) - 1e-12)


def test_nested_decoding_of_the_tables_against_refits(spark, sf_dir):
    """ridge_loco, more rows than components, refitted clause by clause over the whole table."""
    every = sorted(vectors.vector_pairs(spark, sf_dir).collect(), key=lambda p: p.pair)
    fold, want = hashed_folds(p.span for p in every), {}
    for clause in sorted({p.clause for p in every}):
        others, held = [p for p in every if p.clause != clause], [p for p in every if p.clause == clause]
        a = chosen_penalty(others, lambda p: fold[p.span])
        want[clause] = (len(held), round(float(wins(held, fitted(others, a)[0]).mean()), 6), a)
    assert {r.clause: (r.n, r.accuracy, r.alpha) for r in plans.ridge_loco(spark, sf_dir).collect()} == want


def test_hashed_words_are_decoded_by_the_kernel_form(spark, sf_dir):
    """text_ridge_loco, fewer rows than components here; its bags come from the plain ones of the same words."""
    p = plans.text_pairs(spark, sf_dir)
    n = p.count()
    assert 2 * n < plans.HASHED_WORDS
    got = plans.text_ridge_loco(spark, sf_dir).collect()
    assert sum(r.n for r in got) == n and {r.clause for r in got} == {r.clause for r in p.select("clause").distinct().collect()}
    assert all(0 <= r.accuracy <= 1 and r.alpha in M.PENALTIES for r in got)


def test_fitted_queries_against_refits(spark, sf_dir):
    """trained_probe and off_target over the whole table, against lines refitted on rows."""
    every = sorted(vectors.vector_pairs(spark, sf_dir).collect(), key=lambda p: p.pair)
    clauses = sorted({p.clause for p in every})
    dev, rest = [p for p in every if p.span % 4 == 0], [p for p in every if p.span % 4]
    scores = [wins(dev, fitted(rest, a)[0]).mean() for a in M.PENALTIES]
    best = int(np.argmax(scores))
    w, u = fitted(rest, M.PENALTIES[best])[0], np.sum([p.diff for p in rest], axis=0)
    got = plans.trained_probe(spark, sf_dir).first()
    assert np.isclose(got.alpha, M.PENALTIES[best]) and np.isclose(got.accuracy, scores[best], atol=1e-6)
    assert np.isclose(got.cosine, w @ u / np.linalg.norm(w) / np.linalg.norm(u), atol=1e-5)

    fold = hashed_folds(p.span for p in every)
    main, away = [p for p in every if p.pair % 8], [p for p in every if p.pair % 8 == 0]
    folded = {"consistent": [], "planted": []}
    for clause in clauses:
        others = [p for p in main if p.clause != clause]
        w, _ = fitted(others, chosen_penalty(others, lambda p: fold[p.span]))
        for p in away:
            if p.clause == clause:
                won = wins([p], w)[0]
                folded["consistent" if p.span % 16 < 8 else "planted"].append(won if p.span % 16 < 8 else 1 - won)
    got = {r.cls: (r.n, r.q) for r in plans.off_target(spark, sf_dir).collect()}
    assert got == {c: (len(v), round(float(np.mean(v)), 6)) for c, v in folded.items()}


def test_text_baselines_against_refits(spark, sf_dir):
    """bow_loco and final_word_ridge against ridge on dense counts, clause by clause."""
    every = plans.text_pairs(spark, sf_dir).collect()
    cut = {0: lambda w: w, 1: lambda w: w[-1:] or [""], 3: lambda w: w[-3:] or [""]}
    found = {(r.k, r.clause): (r.n, r.accuracy) for r in plans.final_word_ridge(spark, sf_dir).collect()} | {(0, r.clause): (r.n, r.accuracy) for r in plans.bow_loco(spark, sf_dir).collect()}
    for (k, clause), (n, accuracy) in found.items():
        train, held = [p for p in every if p.clause != clause], [p for p in every if p.clause == clause]
        members = [cut[k](p.b) for p in train] + [cut[k](p.c) for p in train]
        times = Counter(w for m in members for w in m)
        vocabulary = sorted(w for w, c in times.items() if c >= (2 if k == 0 else 1))
        count = lambda words: [words.count(w) for w in vocabulary]  # noqa: B023, E731
        x, y = np.array([count(m) for m in members], float), np.repeat([-1.0, 1.0], len(train))
        z = x - x.mean(axis=0)
        w = z.T @ np.linalg.solve(z @ z.T + 100.0 * np.eye(len(z)), y - y.mean())
        margin = np.array([(np.array(count(cut[k](p.c))) - np.array(count(cut[k](p.b)))) @ w for p in held])
        # The fitted lines stop at a tolerance: pairs too close to a tie may fall either way.
        sure = np.where(margin > 1e-4, 1.0, np.where(margin < -1e-4, 0.0, 0.5))
        assert n == len(held) and abs(accuracy - sure.mean()) <= np.mean(np.abs(margin) <= 1e-4) / 2 + 1e-6
