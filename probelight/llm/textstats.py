"""Dense statistics of whole texts, computed over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, chunks, mix64, slice_hashes, small_batches, text_buffers

STATS = (
    "log_words", "word_length", "distinct_words", "top_word", "doubled_words", "distinct_trigrams", "distinct_lines", "line_words",
    "upper", "digits", "punctuation", "symbols", "symbol_runs", "pipes", "bangs", "stops", "letters",
)


def _class_table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER = _class_table(bytes(range(65, 91)))
_DIGIT = _class_table(b"0123456789")
_LETTER = _class_table(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_SYMBOL = _class_table(b"#$%&*@^~=+<>|\\_`{}[]")
_PUNCT = _class_table(bytes(c for c in range(33, 127) if not chr(c).isalnum()))


def _counts(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[at]).astype(float)


def _lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each line that is not empty, and each text's first line."""
    text = np.append(data != 10, False)
    before = np.append(False, text[:-1])
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts, ends = np.flatnonzero(text & (~before | edge)), np.flatnonzero(before & (~text | edge))
    return slice_hashes(data, starts, ends), np.searchsorted(starts, at)


def text_stats(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """len(at) - 1 rows of STATS; all zeros for an empty text."""
    n = len(at) - 1
    out = np.zeros((n, len(STATS)))
    put = lambda name, values: out.__setitem__((slice(None), STATS.index(name)), values)
    starts, ends, first = ascii_words(data, at)
    words = np.diff(first).astype(float)
    some = np.maximum(words, 1)
    letters, lead = _counts(_LETTER[data], at), np.maximum(_counts(_LETTER[data], at), 1)
    solid = np.maximum(_counts(~((data == 32) | ((data >= 9) & (data <= 13))), at), 1)
    put("log_words", np.log1p(words))
    put("word_length", _counts(~((data == 32) | ((data >= 9) & (data <= 13))), at) / some)
    put("upper", _counts(_UPPER[data], at) / lead)
    put("digits", _counts(_DIGIT[data], at) / solid)
    put("punctuation", _counts(_PUNCT[data], at) / some)
    put("symbols", _counts(_SYMBOL[data], at) / some)
    runs = _PUNCT[data] & np.append(False, data[1:] == data[:-1])
    put("symbol_runs", _counts(runs, at) / some)
    put("pipes", _counts(data == ord("|"), at) / some)
    put("bangs", _counts(data == ord("!"), at) / some)
    put("stops", _counts(data == ord("."), at) / some)
    put("letters", letters / solid)
    h = slice_hashes(data, starts, ends)
    lines, line_at = _lines(data, at)
    each = out.T
    for i in range(n):
        own = h[first[i] : first[i + 1]]
        if not len(own):
            continue
        ordered = np.sort(own)
        change = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        each[2, i] = len(change) / len(own)
        each[3, i] = np.diff(np.append(change, len(own))).max() / len(own)
        each[4, i] = np.count_nonzero(own[1:] == own[:-1]) / len(own)
        if len(own) > 2:
            three = np.sort(mix64(own[:-2] + mix64(own[1:-1] + mix64(own[2:]))))
            each[5, i] = (1 + np.count_nonzero(three[1:] != three[:-1])) / len(three)
        else:
            each[5, i] = 1
        line = np.sort(lines[line_at[i] : line_at[i + 1]])
        each[6, i] = (1 + np.count_nonzero(line[1:] != line[:-1])) / max(1, len(line))
        each[7, i] = np.log1p(len(own) / max(1, len(line)))
    return out


def with_stats(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns (doc_id by default) and a double column for each of STATS; a kept column of such a name gives way."""
    small_batches(docs.sparkSession)
    keep = tuple(c for c in keep or ("doc_id",) if c not in STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_buffers(batch.column(len(keep)))
            for lo, hi, data, own in chunks(raw, at):
                values = text_stats(data, own)
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(lo, hi - lo) for k in range(len(keep))], *[pa.array(values[:, k]) for k in range(len(STATS))]], [*keep, *STATS])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, f"{fields}, " + ", ".join(f"{s} double" for s in STATS))


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the doc_id as text, modulo `of`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def labelled_sample(labels: DataFrame, label: str, allowed: Column, most: int) -> DataFrame:
    """doc_id and label of at most about `most` allowed rows, chosen by a hash; both classes in their proportion."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & allowed).select("doc_id", F.col(label).cast("double").alias("label"))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * most / n))
    return known.dropDuplicates(["doc_id"])
