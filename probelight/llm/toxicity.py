"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of words and word beginnings is learned from labelled documents (terms far more common in toxic ones) and
joined with a short fixed list. Features of a whole text: lexicon densities, nearness to the second person, capitals,
punctuation, and rates of obfuscated spelling. Each half of the labelled rows is judged with the lexicon of the other
half; trees are fitted to a part of the rows so judged and calibrated on the rest, and all documents are scored with
the lexicon of both halves.

Labels come from at most about SAMPLE labelled rows outside the held-out fold, chosen by a hash of their ids; every
term of theirs is counted in both classes and only those that are telling are collected.

Cases: a null or empty text has features of zero and is scored like any other; whole texts of any length count;
repeated rows get repeated scores; unlabelled documents are scored too; with too few labels of a class the score is
the share of toxic ones (0 without labels); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialize, slice_hashes, small_batches, text_buffers
from .textstats import labelled_sample, remainder

SAMPLE = 16_000
FOLDS, HELD = 3, 1
PREFIXES = (4, 5, 6, 7, 8)  # bytes of UTF-8
LEAST_DOCS, LEAST_RATIO = 3, 12.0  # toxic documents with a term, at every size and for halves and whole
NEAR = 6  # words
TREES, DEPTH, STEP = 20, 3, 0.3
LEAST_OF_CLASS = 5
THRESHOLD = 0.7

FEATURES = ("log_words", "hits", "hit_rate", "hit_kinds", "strongest", "strength_rate", "you_rate", "near_you", "upper", "upper_hits", "bangs", "questions", "hidden_hits", "mixed_words", "spelled_out")

# Fixed word lists.
INSULTS = "idiot moron stupid dumb fool trash garbage scum loser pathetic worthless disgusting clown imbecile bastard filth vermin dumm trottel abschaum widerlich versager arschloch imbécile débile minable connard ordure raté imbécil estúpido basura asqueroso inútil escoria"
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch sie tu toi te ton ta vous votre tú ti te tu tus usted ustedes vosotros"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LEET = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"013457@$", b"oieastas", strict=True):
    _LEET[_a] = _b


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and the accented capitals of Latin-1 in UTF-8."""
    out = data + np.uint8(32) * ((data >= 65) & (data <= 90)).astype(np.uint8)
    after = np.append(False, data[:-1] == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    return out + np.uint8(32) * after.astype(np.uint8)


def runs(letter: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of letters, and each text's first run."""
    now, edge = np.append(letter, False), np.zeros(len(letter) + 1, bool)
    before = np.append(False, letter)
    edge[at] = True
    starts, ends = np.flatnonzero(now & (~before | edge)), np.flatnonzero(before & (~now | edge))
    return starts, ends, np.searchsorted(starts, at)


def terms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes of words and hashes of their terms: the words, then their beginnings of each length."""
    yield np.arange(len(starts)), slice_hashes(data, starts, ends)
    for n in PREFIXES:
        long = np.flatnonzero(ends - starts >= n)
        yield long, slice_hashes(data, starts[long], starts[long] + n) ^ np.uint64(n)


def word_hashes(words: str) -> np.ndarray:
    data = [folded(np.frombuffer(w.encode(), np.uint8)) for w in words.split()]
    return np.concatenate([slice_hashes(d, np.zeros(1, int), np.array([len(d)])) for d in data])


class Lexicon:
    """Term hashes and weights; looked up through a small bitmap, since most words are in no lexicon."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.weights = hashes[order], weights[order]
        self.bitmap = np.zeros(1 << 18, bool)
        self.bitmap[(hashes & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    def weigh(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each word's greatest weight, 0 for none."""
        out = np.zeros(len(starts))
        if not len(self.hashes):
            return out
        for at, h in terms(data, starts, ends):
            maybe = np.flatnonzero(self.bitmap[(h & np.uint64((1 << 18) - 1)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            hit = self.hashes[place] == h[maybe]
            np.maximum.at(out, at[maybe[hit]], self.weights[place[hit]])
        return out


_YOU = np.unique(word_hashes(SECOND_PERSON))


def features(raw: np.ndarray, at: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """len(at) - 1 rows of FEATURES."""
    n = len(at) - 1
    data = folded(raw)
    starts, ends, first = runs(_LETTER[raw], at)
    row = np.repeat(np.arange(n), np.diff(first))
    per = lambda values: np.bincount(row, values, minlength=n)[:n]
    count = lambda flags: np.diff(np.append(0, np.cumsum(flags))[at]).astype(float)
    words = np.maximum(np.diff(first), 1).astype(float)
    weight = lexicon.weigh(data, starts, ends)
    hit = weight > 0
    h = slice_hashes(data, starts, ends)
    you = np.isin(h, _YOU)
    # The nearest second person before and after each hit, in words of the same text.
    spots, own = np.flatnonzero(you), np.flatnonzero(hit)
    near = np.zeros(len(own), bool)
    if len(spots):
        for step in (-1, 0):
            k = np.searchsorted(spots, own) + step
            other = spots[np.clip(k, 0, len(spots) - 1)]
            near |= (np.abs(other - own) <= NEAR) & (row[other] == row[own])
    upper = (raw >= 65) & (raw <= 90)
    loud = np.append(0, np.cumsum(upper))
    shouted = hit & (loud[ends] - loud[starts] >= 2)
    out = np.zeros((n, len(FEATURES)))
    kinds = np.zeros(n)
    if len(own):
        pairs = np.unique(np.stack([row[own].astype(np.uint64), h[own]]), axis=1)
        kinds = np.bincount(pairs[0].astype(int), minlength=n)[:n]
    strongest = np.zeros(n)
    np.maximum.at(strongest, row, weight)
    # Letters hidden as figures or signs: words that are hits only once these are read as letters.
    plain = _LEET[data]
    leet_letter = _LETTER[plain]
    hidden = mixed = np.zeros(n)
    if np.any(plain != data):
        s, e, f = runs(leet_letter, at)
        changed = np.append(0, np.cumsum(plain != data))
        some = np.flatnonzero(changed[e] > changed[s])
        r = np.repeat(np.arange(n), np.diff(f))[some]
        inside = np.append(0, np.cumsum(_LETTER[data]))
        mixed = np.bincount(r[inside[e[some]] > inside[s[some]]], minlength=n)[:n].astype(float)
        hidden = np.bincount(r, lexicon.weigh(plain, s[some], e[some]) > 0, minlength=n)[:n]
    single = ends - starts == 1
    spelled = single & np.append(False, single[:-1]) & np.append([False, False], single[:-2])[: len(single)]
    columns = (
        np.log1p(np.diff(first)), np.log1p(per(hit)), per(hit) / words, np.log1p(kinds), strongest, per(weight) / words, per(you) / words,
        np.bincount(row[own], near, minlength=n)[:n], count(upper) / np.maximum(count(_LETTER[raw]), 1), per(shouted), count(raw == ord("!")) / words,
        count(raw == ord("?")) / words, hidden, mixed / words, per(spelled) / words,
    )
    for k, values in enumerate(columns):
        out[:, k] = values
    return out


def learned_lexicon(data: DataFrame) -> Lexicon:
    """Terms of the labelled texts (text, label) that are at least LEAST_RATIO times as common in toxic ones, and the fixed list."""
    small_batches(data.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_buffers(batch.column(0))
            label = batch.column(1).to_numpy(zero_copy_only=False)
            text = folded(raw)
            starts, ends, first = runs(_LETTER[raw], at)
            row = np.repeat(np.arange(len(at) - 1), np.diff(first)).astype(np.uint64)
            once = np.unique(np.concatenate([np.stack([row[index], h]) for index, h in terms(text, starts, ends)], axis=1), axis=1)
            found, place = np.unique(once[1], return_inverse=True)
            own = label[once[0].astype(np.int64)]
            n = [np.bincount(place[own == k], minlength=len(found)) for k in (1, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), *[pa.array(k.astype(np.int64)) for k in n]], ["term", "toxic", "clean"])

    sums = {r["label"]: r["count"] for r in data.groupBy("label").count().collect()}
    n_toxic, n_clean = sums.get(1.0, 0), sums.get(0.0, 0)
    counts = data.select("text", "label").mapInArrow(counted, "term long, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio = ((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1))
    telling = (F.col("toxic") >= LEAST_DOCS) & (ratio >= LEAST_RATIO)
    fixed = word_hashes(INSULTS).view(np.int64).tolist()
    weights: dict[int, float] = {}
    common: dict[int, int] = {}
    for r in counts.select("*", ratio.alias("ratio"), telling.alias("telling")).where(F.col("telling") | F.col("term").isin(fixed)).collect():
        common[r["term"]] = r["clean"]
        if r["telling"]:
            weights[r["term"]] = float(np.log(r["ratio"]) * r["toxic"] / (r["toxic"] + 3))
    for term in fixed:
        if common.get(term, 0) <= max(1, n_clean // 1000):
            weights[term] = max(weights.get(term, 0.0), 2.0)
    return Lexicon(np.array(list(weights), np.int64).view(np.uint64), np.array(list(weights.values())))


def with_features(docs: DataFrame, lexicon: Lexicon, *keep: str) -> DataFrame:
    """The kept columns and a double column for each of FEATURES. The lexicon has telling terms only, and the fixed list."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.hashes, lexicon.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_lexicon = Lexicon(*shared.value)
        for batch in batches:
            raw, at = text_buffers(batch.column(len(keep)))
            for lo, hi, data, own in chunks(raw, at):
                values = features(data, own, own_lexicon)
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(lo, hi - lo) for k in range(len(keep))], *[pa.array(values[:, k]) for k in range(len(FEATURES))]], [*keep, *FEATURES])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, f"{fields}, " + ", ".join(f"{f} double" for f in FEATURES))


def scored(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out")
    chosen = labelled_sample(labels, "toxic", remainder(F.col("doc_id"), FOLDS) != HELD, most)
    # At most about `most` ids and texts: their size does not grow with the corpus.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    part = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(10))
    data = materialize(texts.withColumn("part", part), "toxicity-training")
    rest = F.col("part").isin(3, 4, 8)
    sizes = {(r["label"], r["rest"]): r["n"] for r in data.groupBy("label", rest.alias("rest")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(sizes.get((label, k), 0) for label in (0.0, 1.0) for k in (False, True)) < LEAST_OF_CLASS:
        total = sum(sizes.values())
        share = sum(n for (label, _), n in sizes.items() if label == 1.0) / total if total else 0.0
        return docs.select("doc_id", held, F.lit(float(share)).alias("score"), F.lit(int(share >= THRESHOLD)).alias("predicted"))
    halves = [data.where("part < 5"), data.where("part >= 5")]
    lexicons = [learned_lexicon(h) for h in halves]
    lexicon = learned_lexicon(data)
    judged = materialize(reduce(DataFrame.unionByName, [with_features(h, x, "doc_id", "label", "part") for h, x in zip(halves, reversed(lexicons), strict=True)]), "toxicity-features")
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, minInstancesPerNode=5, seed=5).fit(assemble.transform(judged.where(~rest)).coalesce(1))

    def chance(df: DataFrame) -> DataFrame:
        return trees.transform(assemble.transform(df)).withColumn("chance", vector_to_array("probability")[1])

    isotonic = IsotonicRegression(featuresCol="chance", predictionCol="score").fit(chance(judged.where(rest)).select("chance", "label"))
    out = isotonic.transform(chance(with_features(docs, lexicon, "doc_id")).select("doc_id", "chance"))
    return out.select("doc_id", held, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
