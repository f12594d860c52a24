"""Quality by a sparse rule ensemble.

Shallow random-forest trees over text statistics are cut into paths; each path is a conjunctive rule. Lasso logistic
regression gives the rules weights, most of them zero, and the rest are compiled into one Spark column expression.

Labels come from at most about SAMPLE labelled rows outside the held-out fold, chosen by a hash of their ids.

Cases: a null or empty text has statistics of zero and is scored like any other; whole texts of any length count;
repeated rows get repeated scores; of repeated labels of a document one counts, any of them where they differ;
unlabelled documents are scored too; with too few labels of a class the score is the share of good ones (0.5 without
labels); other columns may have any names; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .textstats import STATS, labelled_sample, remainder, with_stats

SAMPLE = 12_000
FOLDS, HELD = 5, 0
TREES, DEPTH = 20, 3
LASSO = 0.001
LEAST_OF_CLASS = 5
THRESHOLD = 0.3

Test = tuple[str, bool, float]  # statistic, greater (else at most), threshold


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [F.col(s) > t if greater else F.col(s) <= t for s, greater, t in self.tests])


@dataclass(frozen=True)
class RuleModel:
    bias: float
    weights: dict[Rule, float]

    def score(self) -> Column:
        z = F.lit(self.bias)
        for rule, weight in self.weights.items():
            z = z + F.when(rule.column(), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def tree_rules(printed: str) -> set[Rule]:
    """The conjunctions on the way to every node below the root of a printed decision tree."""
    found, path = set(), []
    for line in printed.splitlines()[1:]:
        if m := re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            depth = len(m[1]) - 2
            path = [*path[:depth], (STATS[int(m[3])], m[4] == ">", float(m[5]))]
            tightest: dict[tuple[str, bool], float] = {}
            for name, greater, at in path:  # of two tests on one side the tighter stays
                old = tightest.get((name, greater))
                tightest[name, greater] = at if old is None else max(old, at) if greater else min(old, at)
            found.add(Rule(tuple(sorted((n, g, t) for (n, g), t in tightest.items()))))
    return found


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> RuleModel:
    """Learn from labelled documents whose crc32(doc_id) mod FOLDS is not HELD."""
    chosen = labelled_sample(labels, "quality", remainder(F.col("doc_id"), FOLDS) != HELD, most)
    # At most about `most` ids: their size does not grow with the corpus.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    data = materialize(with_stats(texts.dropDuplicates(["doc_id"])).join(F.broadcast(chosen), "doc_id"), "quality-training")
    classes = {r["label"]: r["count"] for r in data.groupBy("label").count().collect()}
    total = sum(classes.values())
    if len(classes) < 2 or min(classes.values()) < LEAST_OF_CLASS:
        share = min(0.99, max(0.01, classes.get(1.0, 0) / total)) if total else 0.5
        return RuleModel(math.log(share / (1 - share)), {})
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=5, featureSubsetStrategy="0.5", minInstancesPerNode=5)
    trees = forest.fit(VectorAssembler(inputCols=list(STATS), outputCol="features").transform(data)).trees
    rules = sorted(set().union(*(tree_rules(t.toDebugString) for t in trees)), key=lambda r: r.tests)
    if not rules:
        share = classes[1.0] / total
        return RuleModel(math.log(share / (1 - share)), {})
    held = data.select("label", array_to_vector(F.array(*[r.column().cast("double") for r in rules])).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=80).fit(held)
    return RuleModel(float(lasso.intercept), {r: float(w) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w})


def scored(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = fit(docs, labels, most)
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    out = with_stats(docs).select("doc_id", held.alias("held_out"), model.score().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """The documents predicted good, scored and kept where they stand, without a join; columns of any names come back as they were."""
    model = fit(docs, labels, most)
    rows = docs.select(F.struct("*").alias("_row"), "text")
    return with_stats(rows, "_row").where(model.score() >= THRESHOLD).select("_row.*")
