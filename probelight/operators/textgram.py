"""Bags of words refitted on many sub-studies from one Gram matrix of all texts.

Counts of words go to tasks by slices of the words, each task multiplies its slice out, and the parts of the matrix
(texts by texts) are added up by part. A fit that leaves some pairs out uses its sub-matrix; words that occur once in
its texts are no part of its vocabulary, and their products, known from the counts, are taken off again. So each fit is
the ridge line on the bag of its own vocabulary, without making the bag. Fits are dealt over tasks; a task holds the
matrix and the counts, which must fit into it: a study that is larger stops with its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import numbered
from .ridge import PART_BYTES, PART_NAMES, PART_TYPES, STUDY_BYTES

# Counts of one slice of the words, and words multiplied out at once.
SLICE_COUNTS, BLOCK_WORDS = 400_000, 512


def indexed(pairs: DataFrame) -> DataFrame:
    """Pairs (pair, span, b, c as arrays of words) with u, their number from 0."""
    return numbered(pairs, None, "pair", "u").withColumn("u", F.col("u") - 1)


def word_counts(pairs: DataFrame) -> DataFrame:
    """(word, row, n): row 2u has the words of b, 2u + 1 those of c."""
    side = lambda c, k: F.struct((2 * F.col("u") + k).alias("row"), F.col(c).alias("words"))
    rows = pairs.select(F.explode(F.array(side("b", 0), side("c", 1))).alias("m")).select("m.row", F.explode("m.words").alias("word"))
    return rows.groupBy("word", "row").agg(F.count(F.lit(1)).alias("n"))


def gram_parts(counts: DataFrame, rows: int) -> DataFrame:
    """The Gram matrix of all texts in parts: at (the first row of the part) and its bytes."""
    slices = max(counts.sparkSession.sparkContext.defaultParallelism, -(-counts.count() // SLICE_COUNTS))
    sliced = counts.groupBy(F.pmod(F.xxhash64("word"), F.lit(slices)).alias("s")).agg(F.collect_list(F.struct("word", "row", "n")).alias("c"))
    each = max(1, PART_BYTES // (8 * max(rows, 1)))

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((rows, rows))
        for batch in batches:
            for r in range(len(batch)):
                c = batch.column(1)[r].values
                word = np.unique(np.array(c.field(0).to_pylist()), return_inverse=True)[1]
                row, n = (c.field(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                for lo in range(0, int(word.max()) + 1, BLOCK_WORDS):
                    at = (word >= lo) & (word < lo + BLOCK_WORDS)
                    block = np.zeros((rows, BLOCK_WORDS))
                    block[row[at], word[at] - lo] = n[at]
                    gram += block @ block.T
        for at in range(0, rows, each):
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((0, at, gram[at : at + each].tobytes()), PART_TYPES, strict=True)], PART_NAMES)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for r in range(len(batch)):
                at, part = batch.column(1)[r].as_py(), np.frombuffer(batch.column(2)[r].as_buffer(), float)
                if now is not None and at != now:
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((0, now, total.tobytes()), PART_TYPES, strict=True)], PART_NAMES)
                now, total = at, part if at != now else total + part
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((0, now, total.tobytes()), PART_TYPES, strict=True)], PART_NAMES)

    parts = sliced.mapInArrow(multiplied, "cell int, at int, part binary")
    return parts.repartition("at").sortWithinPartitions("at").mapInArrow(added, "cell int, at int, part binary").select("at", "part")


def held_out_accuracy(gram: np.ndarray, word: np.ndarray, row: np.ndarray, n: np.ndarray, held: np.ndarray, penalty: float) -> float:
    """Paired accuracy on the held pairs of the ridge line fitted on all others, by words that occur twice among those at least."""
    out = np.repeat(held, 2)
    fit, judge = np.flatnonzero(~out), np.flatnonzero(out)
    inner, cross = gram[np.ix_(fit, fit)].copy(), gram[np.ix_(judge, fit)].copy()
    trained = np.bincount(word, weights=np.where(out[row], 0, n))
    if not (trained >= 2).any():
        return float("nan")
    once = trained[word] == 1
    mine = once & ~out[row]
    owner = np.full(len(trained), -1)
    owner[word[mine]] = np.searchsorted(fit, row[mine])  # the only text that has the word
    np.subtract.at(inner, (owner[word[mine]], owner[word[mine]]), 1.0)
    others = once & out[row]
    np.subtract.at(cross, (np.searchsorted(judge, row[others]), owner[word[others]]), n[others].astype(float))
    y = np.where(fit % 2 == 0, -1.0, 1.0)
    middle = inner.mean(axis=0)
    centred = inner - middle - middle[:, None] + middle.mean()
    a = np.linalg.solve(centred + penalty * np.eye(len(fit)), y - y.mean())
    scores = cross @ a  # the coefficients add up to zero, so means fall out of differences
    margin = np.round(scores[1::2] - scores[::2], 9)
    return float(np.mean(np.where(margin > 0, 1.0, np.where(margin == 0, 0.5, 0.0))))


def refitted_accuracy(pairs: DataFrame, fits: list[tuple[int, int]], block_of: Callable[[int, int], int], penalty: float) -> DataFrame:
    """(draw, block, accuracy) for each fit: pairs whose span lies in the block of the draw are held out.

    pairs: pair, span, b, c (words). block_of(draw, span) deals spans to blocks.
    """
    spark = pairs.sparkSession
    placed = indexed(pairs)
    u = placed.count()
    if 32 * u * u > STUDY_BYTES:
        raise ValueError(f"a matrix of {32 * u * u >> 20} MB is more than the {STUDY_BYTES >> 20} MB that a task may hold")
    counts = word_counts(placed)
    tasks = max(1, min(len(fits), spark.sparkContext.defaultParallelism))
    packed = counts.groupBy(F.pmod(F.xxhash64("word"), F.lit(64)).alias("s")).agg(F.collect_list(F.xxhash64("word")).alias("w"), F.collect_list("row").alias("r"), F.collect_list("n").alias("n"))
    spans = placed.groupBy(F.floor(F.col("u") / 4096).alias("s")).agg(F.collect_list(F.col("u").cast("long")).alias("w"), F.collect_list(F.col("span").cast("long")).alias("r"))
    none = F.lit(None)
    longs = lambda c: c.cast("array<long>")
    every = (
        gram_parts(counts, 2 * u).select(F.lit(0).alias("kind"), "at", "part", longs(none).alias("w"), longs(none).alias("r"), longs(none).alias("n"))
        .unionByName(packed.select(F.lit(1).alias("kind"), F.lit(0).alias("at"), none.cast("binary").alias("part"), longs(F.col("w")).alias("w"), longs(F.col("r")).alias("r"), longs(F.col("n")).alias("n")))
        .unionByName(spans.select(F.lit(2).alias("kind"), F.lit(0).alias("at"), none.cast("binary").alias("part"), "w", "r", longs(none).alias("n")))
    )
    sent = every.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, sparse, span, mine = np.zeros((2 * u, 2 * u)), [], np.zeros(u, np.int64), set()
        sole = None
        for batch in batches:
            kind, at, part, w, r, n, task = (batch.column(i) for i in range(7))
            for i in range(len(batch)):
                mine.add(task[i].as_py())
                sole = task[i].as_py() if sole is None else sole
                if task[i].as_py() != sole:
                    continue  # a second copy of the study, for fits that came to the same task
                arrays = [x[i].values.to_numpy(zero_copy_only=False) if x[i].is_valid else None for x in (w, r, n)]
                if kind[i].as_py() == 0:
                    block = np.frombuffer(part[i].as_buffer(), float).reshape(-1, 2 * u)
                    gram[at[i].as_py() : at[i].as_py() + len(block)] = block
                elif kind[i].as_py() == 1:
                    sparse.append(arrays)
                else:
                    span[arrays[0]] = arrays[1]
        if not mine:
            return
        word, row, n = (np.concatenate([s[k] for s in sparse]) for k in range(3))
        word = np.unique(word, return_inverse=True)[1]
        out = []
        for d, k in [f for i, f in enumerate(fits) if i % tasks in mine]:
            blocks = {s: block_of(d, s) for s in np.unique(span).tolist()}
            held = np.array([blocks[s] == k for s in span.tolist()])
            out.append({"draw": d, "block": k, "accuracy": held_out_accuracy(gram, word, row, n, held, penalty)})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("draw", pa.int64()), ("block", pa.int64()), ("accuracy", pa.float64())]))

    return sent.repartition(tasks, "task").mapInArrow(run, "draw long, block long, accuracy double")
