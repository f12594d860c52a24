"""Subsets met from halves, patterns of tokens, nested search, and faults: against plain versions."""

import itertools
import json
import random

from pyspark.sql import functions as F

from probelight.functions.tokens import failure_function, last_occurrence
from probelight.plans import design, faults, reconstruct

GOALS = "id int, since string, size int, status string"


def plain_subset(goals, want):
    """All subsets, larger ones first, in the order of combinations."""
    if want is None:
        return [g[0] for g in goals], "validated"
    for r in range(len(goals), -1, -1):
        for some in itertools.combinations(goals, r):
            length = design.PROFILE + (design.JOINER + design.HEADER + sum(g[2] + 1 for g in some) - 1 if some else 0)
            if length == want:
                return [g[0] for g in some], "validated"
    return [g[0] for g in goals if g[3] == "active"], "UNVALIDATED"


def test_halves_find_the_subset_that_enumeration_finds(spark):
    pick = random.Random(1)
    goals = [(i + 1, f"2024-01-{i + 1:02d}", pick.randint(3, 25), pick.choice(("active", "revised"))) for i in range(12)]
    facts = [(k, f"2024-01-{pick.randint(0, 13):02d}", pick.choice([None, design.PROFILE, pick.randint(90, 320)])) for k in range(300)]
    df = spark.createDataFrame(facts, "k int, at string, want int")
    out = design.matched_subsets(df, spark.createDataFrame(goals, GOALS), "at", "want").collect()
    want = {k: plain_subset([g for g in goals if g[1] <= at], w) for k, at, w in facts}
    assert {r["k"]: (r["chosen"], r["status"]) for r in out} == want and len(out) == 300
    assert {s for _, s in want.values()} == {"validated", "UNVALIDATED"}


def test_thirty_goals(spark):
    goals = [(i + 1, f"2024-01-{i + 1:02d}", 3 * i + 7, "active") for i in range(30)]
    df = spark.createDataFrame([(k, "2024-02-01", 200 + 37 * k) for k in range(20)], "k int, at string, want int")
    rows = design.matched_subsets(df, spark.createDataFrame(goals, GOALS), "at", "want").collect()
    size = {g[0]: g[2] for g in goals}
    hits = [r for r in rows if r["status"] == "validated"]
    assert len(rows) == 20 and len(hits) > 10
    for r in hits:
        assert design.PROFILE + design.JOINER + design.HEADER + sum(size[i] + 1 for i in r["chosen"]) - 1 == r["want"]


def test_last_occurrence_of_overlapping_patterns(spark):
    pick = random.Random(3)
    cases = [("ababa", "aba"), ("aaaa", "aa"), ("aabaabaab", "aabaab"), ("abc", "abcd"), ("", "a"), ("abab", "abab"), ("x", "")]
    cases += [("".join(pick.choice("ab") for _ in range(pick.randint(0, 30))), "".join(pick.choice("ab") for _ in range(pick.randint(1, 6)))) for _ in range(300)]
    df = spark.createDataFrame([(i, list(t), list(p)) for i, (t, p) in enumerate(cases)], "i int, t array<string>, p array<string>")
    out = df.withColumn("f", failure_function(F.col("p"))).withColumn("last", last_occurrence(F.col("t"), F.col("p"), F.col("f"))).collect()
    for r in out:
        text, pattern = cases[r["i"]]
        border = [max(k for k in range(n) if pattern[:k] == pattern[n - k : n]) for n in range(1, len(pattern) + 1)]
        assert r["f"] == border
        at = text.rfind(pattern)
        assert r["last"] == (None if not pattern else at + 1 if at >= 0 else -1), (text, pattern)


def plain_search(node, name):
    stack = [node]
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            for k, v in node.items():
                if k == name and isinstance(v, (int, float)):
                    return float(v)
                stack.append(v)
        elif isinstance(node, list):
            stack.extend(node)
    return None


def test_nested_search_of_any_depth(spark):
    pick = random.Random(7)

    def made(depth):
        if depth == 0 or pick.random() < 0.2:
            return pick.choice([1, 2.5, "t", None, True, pick.randint(3, 99)])
        if pick.random() < 0.5:
            return [made(depth - 1) for _ in range(pick.randint(0, 3))]
        return {pick.choice(("alpha", "b", "c", "d")): made(depth - 1) for _ in range(pick.randint(0, 3))}

    deep = {"alpha": 7}
    for i in range(60):
        deep = {"z": deep, "a": i} if i % 2 else [deep, i]
    nodes = [made(5) for _ in range(200)] + [deep, {}, [], 3]
    # Spark keeps the keys of an object in their order; the plain version has to walk them alike.
    rows = [(i, json.dumps(n, sort_keys=True)) for i, n in enumerate(nodes)] + [(900, None), (901, "not json")]
    df = spark.createDataFrame(rows, "i int, j string")
    got = {r["i"]: r["value"] for r in reconstruct.search_key(df, "i", "j", "alpha").collect()}
    assert got == {i: plain_search(json.loads(j), "alpha") if j and i != 901 else None for i, j in rows}
    assert got[200] == 7.0


def test_faults_meet_their_guards(spark, sf_dir):
    by = {r["fault"][:2]: r for r in faults.fault_detectors(spark, sf_dir).collect()}
    assert {k: r["detected_by"] for k, r in by.items()} == {"c1": "SILENT", "c2": "SILENT", "c3": "record check", "c4": "completeness", "c5": "manifest", "c6": "manifest"}
    assert all(r["kill"] == int(r["detected_by"] == "SILENT" and abs(r["shift"]) > 0.02) for r in by.values())
