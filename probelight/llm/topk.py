"""Exact top-k inner-product search by multi-resolution segment statistics.

Vectors become integers. Rows are put in order of their strongest segment and packed into blocks of bounded size, so
that a block holds rows alike in coarse shape. A block knows the range of its rows' segment means and their largest
deviations, which bound every inner product between two blocks: pairs of blocks (tiles) whose bound is under the
floors of all queries are never made. In the tiles left, a pair's inner product is bounded from above (its distance
from below) by segment means and deviations: for each segment, length * mean * mean plus the product of the
deviations (Cauchy-Schwarz). Levels go from one segment to segments of two components; a pair whose bound is under the
query's floor is dropped, and only survivors get exact scores. Floors come from a pilot, each query block's most
promising row block, whose k-th best score no result can be under.

Cases: rows whose id or vector is null, or whose vector is empty or has null or non-finite components, take no part;
vectors meet those of their own length; ties go to the smaller id; with fewer than k candidates all are returned; a
repeated row is a candidate each time and one query; other columns are ignored; an empty table or query set gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.order import numbered
from .common import Scratch, small_batches

BLOCK_ROWS, BLOCK_QUERIES = 4096, 2048
LEVELS = (1, 4, 16, 32)
COARSE = 4  # segments of the blocks' statistics
# Above this share of surviving pairs a product of whole matrices is cheaper than a list of pairs.
DENSE = 0.05


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v: floor(scale * component) of the valid vectors."""
    x = lambda c: c.cast("double")
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(x(c)) | (F.abs(x(c)) == float("inf")))
    fine = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad)
    return fine.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: F.floor(F.lit(float(scale)) * x(c))).alias("v"))


def ordered(rows: DataFrame, of_block: int) -> DataFrame:
    """Adds dim and block: rows in order of length, strongest of COARSE segments and its mean, so many to a block."""
    n = F.size("v")
    edge = lambda i: F.floor(n * i / COARSE).cast("int")
    part = lambda i: F.slice("v", edge(i) + 1, edge(i + 1) - edge(i))
    mean = lambda i: F.aggregate(part(i), F.lit(0.0), lambda a, x: a + x) / F.greatest(edge(i + 1) - edge(i), F.lit(1))
    shape = rows.withColumn("_means", F.transform(F.sequence(F.lit(0), F.lit(COARSE - 1)), mean)).withColumn("dim", n)
    strongest = F.array_max(F.transform("_means", lambda m, i: F.struct(F.abs(m).alias("size"), i.alias("i"), m.alias("m"))))
    keyed = shape.select("vec_id", "v", "dim", F.struct("dim", strongest["i"].alias("i"), strongest["m"].alias("m"), "vec_id").alias("_key"))
    placed = numbered(keyed, None, "_key", "_n")
    return placed.select("vec_id", "v", "dim", F.expr(f"(_n - 1) div {of_block}").cast("int").alias("block"))


SHAPE = "block int, dim int, ids binary, data binary, low array<double>, high array<double>, spread array<double>"


def packed(rows: DataFrame) -> DataFrame:
    """SHAPE: the rows of one block and length, as bytes of integers, with the ranges of their coarse statistics."""

    def pack(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
        small = np.abs(v).max(initial=0) < 1 << 31
        ids = table.column("vec_id").to_numpy().astype(np.int64)
        coarse = _stats(v.astype(float), min(COARSE, dim))
        means, spread = np.split(coarse, 2, axis=1)
        held = {"block": table.column("block").slice(0, 1), "dim": table.column("dim").slice(0, 1), "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([v.astype(np.int32 if small else np.int64).tobytes()], pa.binary())}
        return pa.table(held | {n: pa.array([x.tolist()], pa.list_(pa.float64())) for n, x in (("low", means.min(axis=0)), ("high", means.max(axis=0)), ("spread", spread.max(axis=0)))})

    return rows.groupBy("block", "dim").applyInArrow(pack, SHAPE)


def tile_bound() -> Column:
    """No inner product between the rows of two blocks is above this: q_low.. of the one, low.. of the other."""
    ranges = F.arrays_zip("q_low", "q_high", "q_spread", "low", "high", "spread")
    most = lambda x: F.greatest(x["q_low"] * x["low"], x["q_low"] * x["high"], x["q_high"] * x["low"], x["q_high"] * x["high"]) + x["q_spread"] * x["spread"]
    return F.aggregate(F.transform(ranges, most), F.lit(0.0), lambda a, x: a + x)


def _stats(m: np.ndarray, segments: int) -> np.ndarray:
    """Per row the segments' means, times the root of the length, and deviations: their products bound inner products."""
    edges = np.linspace(0, m.shape[1], segments + 1).astype(int)
    starts, sizes = edges[:-1], np.diff(edges)
    mean = np.add.reduceat(m, starts, axis=1) / sizes
    spread = np.add.reduceat((m - np.repeat(mean, sizes, axis=1)) ** 2, starts, axis=1)
    return np.concatenate([mean * np.sqrt(sizes), np.sqrt(spread)], axis=1)


def best_of_tile(q_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, ids and scores of each query's k best rows in a tile whose score is not under the query's floor."""
    exact = q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) < 2**53
    kind = np.float64 if exact else object  # beyond that, Python's integers
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    slack = 1e-9 * (np.linalg.norm(qf, axis=1)[:, None] * np.linalg.norm(xf, axis=1).max(initial=0) + 1)
    alive = q_ids[:, None] != ids[None, :]
    columns = np.arange(len(ids))
    for segments in LEVELS:
        if segments > q.shape[1] or not len(columns):
            break
        bound = _stats(qf, segments) @ _stats(xf[columns], segments).T
        alive[:, columns] &= bound + slack >= floors[:, None]
        columns = np.flatnonzero(alive.any(axis=0))
    row, at = np.nonzero(alive[:, columns])
    if len(row) > DENSE * alive.size:
        score = (q.astype(kind) @ x[columns].astype(kind).T)[row, at]
    else:
        score = np.concatenate([np.zeros(0, kind), *((q[row[i : i + 100_000]].astype(kind) * x[columns[at[i : i + 100_000]]].astype(kind)).sum(axis=1) for i in range(0, len(row), 100_000))])
    score = score.astype(np.int64)
    own = ids[columns[at]]
    order = np.lexsort((own, -score, row))
    row, own, score = row[order], own[order], score[order]
    first = np.searchsorted(row, row)  # where each query's rows begin
    keep = np.arange(len(row)) - first < k
    return q_ids[row[keep]], own[keep], score[keep]


def _tiles(tiles: DataFrame, k: int) -> DataFrame:
    """The k best of every tile: dim, q_ids, q_data and floors of its queries, ids and data of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                raw = lambda n: batch.column(batch.schema.get_field_index(n))[r].as_buffer()  # noqa: B023, E731
                dim = batch.column(batch.schema.get_field_index("dim"))[r].as_py()
                ids, q_ids = np.frombuffer(raw("ids"), np.int64), np.frombuffer(raw("q_ids"), np.int64)
                rows = lambda n, own: np.frombuffer(raw(n), np.int32 if len(raw(n)) == 4 * len(own) * dim else np.int64).reshape(-1, dim).astype(np.int64)  # noqa: B023, E731
                found = best_of_tile(q_ids, rows("q_data", q_ids), np.frombuffer(raw("floors"), np.float64), ids, rows("data", ids), k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

    return tiles.select("dim", "q_ids", "q_data", "floors", "ids", "data").mapInArrow(run, "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of the k best other rows of each query."""
    spark = vectors.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "top-k")
    rows = scratch.keep(quantised(vectors))
    data = scratch.keep(packed(ordered(rows, BLOCK_ROWS)))
    chosen = scratch.keep(ordered(rows.where(is_query).dropDuplicates(["vec_id"]), BLOCK_QUERIES))
    q_data = scratch.keep(packed(chosen).select("dim", *[F.col(c).alias(f"q_{c}") for c in ("block", "ids", "data", "low", "high", "spread")]))
    # Tiles are chosen by the blocks' statistics alone; ids and data join those that are left.
    about = data.select("block", "dim", "low", "high", "spread")
    bounds = scratch.keep(q_data.select("q_block", "dim", "q_low", "q_high", "q_spread").join(about, "dim").select("q_block", "block", "dim", tile_bound().alias("bound")))

    def with_floors(key: tuple, table: pa.Table, floors: pa.Table) -> pa.Table:
        ids = np.frombuffer(table.column("q_ids")[0].as_buffer(), np.int64)
        level = dict(zip(floors.column("vec_id").to_pylist(), floors.column("floor").to_pylist(), strict=True))
        out = np.array([level.get(i, -np.inf) for i in ids.tolist()])
        return table.append_column("floors", pa.array([out.tobytes()], pa.binary())).append_column("least", pa.array([float(out.min())]))

    shape = "q_block int, dim int, q_ids binary, q_data binary"

    def floored(floors: DataFrame) -> DataFrame:
        left = q_data.select("q_block", "dim", "q_ids", "q_data").groupBy("q_block", "dim")
        return left.cogroup(floors.groupBy("q_block", "dim")).applyInArrow(with_floors, f"{shape}, floors binary, least double")

    none = spark.createDataFrame([], "q_block int, dim int, vec_id long, floor double")
    best = bounds.groupBy("q_block", "dim").agg(F.max_by("block", F.struct("bound", "block")).alias("block"))
    whole = lambda tiles, queries: tiles.join(queries, ["q_block", "dim"]).join(data.select("block", "dim", "ids", "data"), ["block", "dim"])
    pilot = _ranked(_tiles(whole(best, floored(none)), k), k).where(F.col("rank") == k)
    placed = chosen.select("vec_id", "dim", F.col("block").alias("q_block"))
    known = scratch.keep(pilot.select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor")).join(placed, "vec_id").select("q_block", "dim", "vec_id", "floor"))
    queries = scratch.keep(floored(known))
    near = bounds.join(queries.select("q_block", "dim", "least"), ["q_block", "dim"]).where(F.col("bound") * (1 + 1e-9) + 1 >= F.col("least"))
    found = scratch.keep(_ranked(_tiles(whole(near.select("q_block", "block", "dim"), queries), k), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    scratch.drop(rows, data, chosen, q_data, bounds, known, queries)
    return found
