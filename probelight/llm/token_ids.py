"""Token ids as binary shards with Elias-Fano boundaries.

A shard is a row of a Parquet table: the ids of consecutive documents as one little-endian array, the documents'
ends as an Elias-Fano sequence (high bits in unary, low bits packed) with sampled select positions, and their ids.
Spark's writers commit the shards, so a lost executor leaves no half shard. Documents are in ascending doc_id order
over (part, shard); a shard knows how many ids precede it in its part, and the parts' totals are as few as the
partitions of the write.

Cases: a null or empty text has the end id alone; null doc_ids come first; rows with equal doc_id keep together in
any order; a text of any length is one document; other columns are ignored; an empty table makes an empty table.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# A shard is closed when it holds this many ids; a longer document is a shard of its own.
SHARD_IDS = 1 << 17
# Every so many documents the position of the boundary's bit is kept.
SELECT_EVERY = 64
# Bytes of a worker's cache of words, about; a word costs its text, ids and entries.
CACHE_BYTES = 100_000_000
WORD_COST = 200
CACHE_LENGTH = 48
_MARKS = re.compile(r"(?<=[a-zß-öø-ÿ])([.,|!$%&*#]+)\Z")

SHARDS = "part int, shard int, part_at long, n_docs int, n_ids long, id_bytes int, low_bits int, ids binary, ends_high binary, ends_low binary, select_at binary, doc_ids array<long>"


class EliasFano:
    """A non-decreasing sequence of n integers up to `top` in about 2 + log2(top / n) bits each."""

    def __init__(self, n: int, low_bits: int, high: bytes, low: bytes, select_at: bytes) -> None:
        self.n, self.low_bits = n, low_bits
        self.high, self.low = np.frombuffer(high, np.uint8), np.frombuffer(low, np.uint8)
        self.select_at = np.frombuffer(select_at, np.uint32)

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, int(top // max(n, 1)).bit_length() - 1)
        places = (values >> low_bits) + np.arange(n)
        bits = np.zeros((int(places[-1]) if n else 0) + 1, np.uint8)
        bits[places] = 1
        low = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8).reshape(-1)
        pack = lambda b: np.packbits(b, bitorder="little").tobytes()
        return cls(n, low_bits, pack(bits), pack(low), places[::SELECT_EVERY].astype(np.uint32).tobytes())

    def __getitem__(self, i: int) -> int:
        return int(self.select(np.array([i]))[0])

    def select(self, index: np.ndarray) -> np.ndarray:
        """The values of these indexes: from the sampled position before each, bits are counted byte by byte."""
        place = self.select_at[index // SELECT_EVERY].astype(np.int64)
        need, byte = index % SELECT_EVERY, place >> 3
        bits = self.high[byte] >> (place & 7).astype(np.uint8) << (place & 7).astype(np.uint8)
        while len(short := np.flatnonzero(_ONES[bits] <= need)):
            need[short] -= _ONES[bits[short]]
            byte[short] += 1
            bits[short] = self.high[byte[short]]
        value = (byte * 8 + _NTH[bits, need] - index) << self.low_bits
        at = index[:, None] * self.low_bits + np.arange(self.low_bits)
        low = self.low[at >> 3] >> (at & 7).astype(np.uint8) & 1
        return value | (low.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)


# Ones in each byte, and the place of its n-th one.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_ONES = _BITS.sum(axis=1).astype(np.int64)
_NTH = np.argsort(1 - _BITS, axis=1, kind="stable").astype(np.int64)


class WordIds(dict):
    """Ids of each word as little-endian bytes; bounded, the older half goes when full.

    The tokenizer lower-cases and never looks across white space, nor from letters to the marks behind them. So A-Z
    is lower-cased first, unless a special token may be meant; a text's ids are its words' ids, and those of a word
    with marks behind its letters are the letters' and the marks' ids.
    """

    def __init__(self, tokenizer, kind: str) -> None:
        super().__init__()
        self.tokenizer, self.kind = tokenizer, kind
        suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
        # By id: whether a unit of the tokenizer ends with it; without a suffix that says so, words are sent one by one.
        self.ends_unit = np.zeros(tokenizer.get_vocab_size(), bool)
        if suffix:
            self.ends_unit[[i for token, i in tokenizer.get_vocab().items() if token.endswith(suffix)]] = True

    def look_up(self, texts: list[str | None]) -> list[bytes]:
        split = [_words_of(t) for t in texts]
        found = [list(map(self.get, words)) for words in split]
        new = {w for words, ids in zip(split, found, strict=True) for w, i in zip(words, ids, strict=True) if i is None}
        if not new:
            return [b"".join(ids) for ids in found]
        marked = {w: parts[:2] for w in new if not w.isalpha() and len(parts := _MARKS.split(w)) > 1}
        unseen = (new - marked.keys()) | {p for parts in marked.values() for p in parts}
        made = self._encoded([w for w in unseen if w not in self])
        made |= {w: b"".join([made[p] if p in made else self[p] for p in parts]) for w, parts in marked.items()}
        if (len(self) + len(made)) * WORD_COST > CACHE_BYTES:
            newer = list(islice(self.items(), len(self) // 2, None))
            self.clear()
            self.update(newer)
        self.update((w, i) for w, i in made.items() if len(w) <= CACHE_LENGTH)
        return [b"".join([made[w] if i is None else i for w, i in zip(words, ids, strict=True)]) for words, ids in zip(split, found, strict=True)]

    def _encoded(self, words: list[str]) -> dict[str, bytes]:
        """Words of letters alone are one unit each to the tokenizer: they are sent many at a time, and parted by units."""
        single = self.ends_unit.any()
        plain = [w for w in words if single and w.isalpha()]
        runs = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        other = [w for w in words if not (single and w.isalpha())]
        made, width = {}, np.dtype(self.kind).itemsize
        for run, e in zip(runs, self.tokenizer.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.kind)
            ends = ((np.flatnonzero(self.ends_unit[ids]) + 1) * width).tolist()
            if len(ends) != len(run):  # a letter whose lower case is more than a letter
                other += run
                continue
            data = ids.tobytes()
            made.update((w, data[a:b]) for w, a, b in zip(run, [0, *ends], ends, strict=False))
        encoded = self.tokenizer.encode_batch_fast(other, add_special_tokens=False)
        made.update((w, np.array(e.ids, self.kind).tobytes()) for w, e in zip(other, encoded, strict=True))
        return made


def _words_of(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
    if "<|" not in text:
        text = text.encode().lower().decode()
    return text.split(" ")


_words: dict[int, WordIds] = {}


def _word_ids(data: str) -> WordIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    key = hash(data)
    if key not in _words:
        tokenizer = Tokenizer.from_str(data)
        _words[key] = WordIds(tokenizer, "<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
    return _words[key]


def write_shards(docs: DataFrame, tokenizer_file: str, path: str, end_id: int = 1) -> None:
    """Encode the documents and write the shards to path, in ascending doc_id order."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_file) as f:
        vocabulary = spark.sparkContext.broadcast(f.read())  # the size of a vocabulary, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(vocabulary.value)
        width = np.dtype(words.kind).itemsize
        end = np.array([end_id], words.kind).tobytes()
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        names, data, size = [], [], 0

        def closed() -> pa.RecordBatch:
            ends = EliasFano.build(np.cumsum([len(d) // width for d in data]))
            row = {"part": part, "shard": shard, "part_at": before, "n_docs": len(data), "n_ids": size, "id_bytes": width, "low_bits": ends.low_bits, "ids": b"".join(data), "ends_high": ends.high.tobytes(), "ends_low": ends.low.tobytes(), "select_at": ends.select_at.tobytes(), "doc_ids": names}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), words.look_up(batch.column(1).to_pylist()), strict=True):
                names.append(name)
                data.append(ids + end)
                size += len(data[-1]) // width
                if size >= SHARD_IDS:
                    yield closed()
                    shard, before = shard + 1, before + size
                    names, data, size = [], [], 0
        if data:
            yield closed()

    binary = ["ids", "ends_high", "ends_low", "select_at"]
    ints = ["part", "shard", "n_docs", "id_bytes", "low_bits"]
    order = [x.split(" ")[0] for x in SHARDS.split(", ")]
    schema = pa.schema([(n, pa.binary() if n in binary else pa.int32() if n in ints else pa.list_(pa.int64()) if n == "doc_ids" else pa.int64()) for n in order])
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    placed.mapInArrow(run, SHARDS).write.parquet(path)


def read_documents(spark, path: str) -> DataFrame:
    """doc_id, start (ids before it over all documents), n_tokens, ids_crc32 of its ids as unsigned 32-bit integers."""
    small_batches(spark)
    shards = spark.read.schema(SHARDS).parquet(path)
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    base, at = {}, 0
    for part, n in totals:  # as many as the write had partitions
        base[part], at = at, at + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                get = lambda name: batch.column(batch.schema.get_field_index(name))[row]  # noqa: B023, E731
                ends = EliasFano(get("n_docs").as_py(), get("low_bits").as_py(), get("ends_high").as_py(), get("ends_low").as_py(), get("select_at").as_py())
                ends = ends.select(np.arange(ends.n))
                starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
                ids = np.frombuffer(get("ids").as_buffer(), "<u2" if get("id_bytes").as_py() == 2 else "<u4").astype("<u4")
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([get("doc_ids").values, pa.array(starts + base[get("part").as_py()] + get("part_at").as_py()), pa.array(ends - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "part_at", "n_docs", "id_bytes", "low_bits", "ids", "ends_high", "ends_low", "select_at", "doc_ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
