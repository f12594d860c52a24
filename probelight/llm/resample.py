"""Importance resampling towards a target: hashed n-gram features, log-ratio weights, Gumbel noise, the best scores drawn.

Words come from the UTF-8 bytes of a text: one table of 256 bytes lower-cases A-Z and blanks all ASCII but letters and
digits, and `bytes.split` cuts at the blanks. An n-gram's CRC-32 goes on from the CRC-32 of its first n - 1 words, so
no n-gram is ever put together. Counters add up the buckets of a task before anything is shuffled.

Documents are read twice, once for the counts of the buckets and once for the weights: reading and splitting again is
cheaper than keeping a list of features. What goes through the driver is bounded: one number for each bucket, and the
number of documents of each score. Scores are whole thousandths of a logarithm, within 1000 * ln(features) and the
range of the noise (-3,100 to 22,900), so there are some ten thousand of them at any size of the corpus. The rank of a
document is the number of documents of a better score, and its place among those of its own score, of which no task
has more than a few ten-thousandths of the corpus.

Cases: a null or empty text has no features and weight 0; a null id draws as the empty text and comes first among
ties; repeated rows are scored each and, being equal, have neighbouring ranks; texts are worked on whole, one at a
time, whatever their length; an empty table of documents gives an empty table, an empty target only equal gains; other
columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, materialize

WORD_BYTES = [c for c in range(256) if re.match(rb"[0-9A-Za-z\x80-\xff]", bytes([c]))]
# Byte to byte: lower case for A-Z, itself for the other bytes of words, a blank for the rest.
BYTES = bytes(ord(chr(c).lower()) if c < 128 and c in WORD_BYTES else c if c in WORD_BYTES else 32 for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(BYTES).split()


def features_of(words: list[bytes], longest: int) -> Iterator[list[int]]:
    """CRC-32 of all runs of one word, of two, and so on; each run's hash goes on from the run without its last word."""
    run = list(map(crc32, words))
    yield run
    if longest > 1:
        after = [b" " + w for w in words]
        for n in range(1, longest):
            run = list(map(crc32, after[n:], run))
            yield run


def buckets_of(words: list[bytes], longest: int, buckets: int) -> np.ndarray:
    return np.concatenate([np.array(run, np.int64) for run in features_of(words, longest)]) % buckets


def _raw(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary() if column.type == pa.string() else pa.large_binary()).to_pylist()


def bucket_counts(texts: DataFrame, text: str, longest: int, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all texts; at most one row a task and bucket is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for batch in batches:
            for raw in _raw(batch.column(0)):
                if raw:
                    total.update(buckets_of(words_of(raw), longest, buckets).tolist())
        yield pa.RecordBatch.from_pydict({"bucket": list(total.keys()), "n": list(total.values())}, pa.schema([("bucket", pa.int64()), ("n", pa.int64())]))

    with arrow_rows(texts.sparkSession):
        found = texts.select(F.col(text)).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(buckets, np.int64)
    for r in found:
        counts[r["bucket"]] = r["n"]
    return counts


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's share in the target over its share in the source, one added to each count."""
    buckets, s, t = len(source), int(source.sum()), int(target.sum())
    ratio = lambda a, b: (b + 1) * (s + buckets) / ((a + 1) * (t + buckets))
    return np.array([math.floor(1000 * math.log(ratio(a, b))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def scores(
    docs: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", target_text: str = "text",
    longest: int = 2, buckets: int = 10_000, seed: int = 7,
) -> DataFrame:
    """Per document its key, n_words, n_features, weight and score, written to the shared folder."""
    gains = gains_of(bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weights = [], [], []
            for raw in _raw(batch.column(1)):
                words = words_of(raw or b"")
                found = buckets_of(words, longest, buckets) if words else ()
                n_words.append(len(words))
                n_features.append(len(found))
                weights.append(int(gains[found].sum()) // len(found) if words else 0)
            columns = [pa.array(x, pa.int64()) for x in (n_words, n_features, weights)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, "n_words", "n_features", "weight"])

    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    weighed = docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words long, n_features long, weight long")
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    with arrow_rows(spark):
        return materialize(weighed.withColumn("score", F.col("weight") + noise), "scores")


def ranked(scored: DataFrame, *, key: str = "doc_id", percent: int = 25, least_words: int = 20) -> DataFrame:
    """Adds rank, from 1, to the `percent` of best scores among documents of at least `least_words`; null for all others."""
    able = F.col("n_words") >= least_words
    per_score = sorted(((r["score"], r["n"]) for r in scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    wanted = percent * sum(n for _, n in per_score) // 100
    above, better = [], 0
    for score, n in per_score:
        if better >= wanted:
            break
        above.append((score, better))
        better += n
    least = above[-1][0] if above else None
    near = able & (F.col("score") >= least) if above else F.lit(False)
    table = scored.sparkSession.createDataFrame(above, "score long, _better long")
    place = F.row_number().over(Window.partitionBy("score").orderBy(key, "n_words", "n_features", "weight"))
    rank = (F.col("_better") + place).cast("long")
    drawn = scored.where(near).join(F.broadcast(table), "score").withColumn("rank", rank)  # a row for each score
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))).select(*scored.columns, "rank")
    return drawn.unionByName(scored.where(~near).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, *, key: str = "doc_id", percent: int = 25, least_words: int = 20, **how) -> DataFrame:
    """The drawn documents with all their columns; of a repeated id all rows stay if one is drawn."""
    drawn = ranked(scores(docs, target, key=key, **how), key=key, percent=percent, least_words=least_words).where("rank is not null")
    keys = drawn.select(F.col(key).alias("_drawn"))
    return docs.join(keys, docs[key].eqNullSafe(keys["_drawn"]), "left_semi")
