"""What the corpus operators share: tables, the shared scratch folder, Arrow batches, text kernels."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Rows of one Arrow batch that Spark sends to a Python worker. Texts are long, workers are small.
ARROW_ROWS = 128
# Bytes of text that a kernel works on at once; a longer text is a chunk of its own.
CHUNK_BYTES = (1 << 19) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a local one only where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-scratch-")  # one machine: driver and executors are the same process
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where}/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and later plans know the true size."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one run in the shared folder, by name; a table goes when no later step reads it."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.folder = spark, scratch_path(spark, label)
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """The table written and read back."""
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            at = jvm.org.apache.hadoop.fs.Path(table.scratch_path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Keep Arrow batches of whole texts small; never raises a lower setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS) -> Iterator[None]:
    """Small Arrow batches for the jobs run inside; the session has its own setting again afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    small_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n+1 row offsets of a string column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(raw: np.ndarray, at: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of at most `most` bytes (or one long row): first row, end row, bytes, offsets from 0."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_KEYS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        size = 1 << max(19, int(n - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
        if size > 1 << 19:  # a very long text: do not keep its tables
            big = (_powers[0], _powers[1])
            _powers[0], _powers[1] = np.ones(1, np.uint64), np.ones(1, np.uint64)
            return big
    return _powers[0], _powers[1]


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte slice, from one running sum over all bytes."""
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_KEYS[data] * up[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix64(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def ascii_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space, and the index of the first run of each row (n+1)."""
    word = np.zeros(len(data) + 1, bool)
    word[:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    before = np.zeros(len(data) + 1, bool)
    before[1:] = word[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(word & (~before | edge))
    ends = np.flatnonzero(before & (~word | edge))
    return starts, ends, np.searchsorted(starts, at)


def digests(values: list[bytes]) -> list[str]:
    """SHA-256 of each value, lowercase hex."""
    return [hashlib.sha256(v).hexdigest() for v in values]
