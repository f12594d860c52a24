"""Joins that audits need and SQL has no word for: as-of, existence by substring, resume, full comparison, similarity."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .order import with_range


# Rows that a side may have to be sent to every task; larger ones are joined by other means.
FEW = 20_000


def few(df: DataFrame) -> DataFrame:
    """The side marked for broadcast if a count shows that it has few rows; otherwise as it is."""
    return F.broadcast(df) if df.count() <= FEW else df


def as_of(facts: DataFrame, eras: DataFrame, at: Column, start: str, value: str, default: Column) -> DataFrame:
    """The value of the last era whose start is not after `at`, else the default.

    Few eras (a versioned configuration) are folded into one sorted array, a single row, and each fact looks its era
    up in it: facts are neither shuffled nor multiplied. Many are sorted together with the facts, by ranges. Of eras
    with one start the greatest value counts, either way.
    """
    if eras.count() > FEW:
        return _as_of_by_ranges(facts, eras, at, start, value, default)
    timeline = eras.agg(F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), F.col(value).alias("v")))).alias("_eras"))
    found = F.element_at(F.filter("_eras", lambda e: e["s"] <= at), -1)["v"]
    return facts.crossJoin(F.broadcast(timeline)).withColumn(value, F.coalesce(F.when(F.size(F.filter("_eras", lambda e: e["s"] <= at)) > 0, found), default)).drop("_eras")


def _as_of_by_ranges(facts: DataFrame, eras: DataFrame, at: Column, start: str, value: str, default: Column) -> DataFrame:
    """Facts and eras in one order of time: each range looks back within itself, and what is open at its beginning is carried over."""
    own = facts.select(F.struct("*").alias("_row"), at.alias("_t"), F.lit(1).alias("_k"))
    both = own.unionByName(eras.select(F.col(start).alias("_t"), F.lit(0).alias("_k"), F.struct(F.col(value).alias("v")).alias("_era")), allowMissingColumns=True)
    dealt = with_range(both.withColumn("_order", F.struct("_t", "_k", F.col("_era")["v"].alias("_v"))), "_order", "_part")
    back = Window.partitionBy("_part").orderBy("_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = dealt.withColumn("_here", F.last("_era", ignorenulls=True).over(back))
    ends = dealt.groupBy("_part").agg(F.max_by("_era", F.when(F.col("_k") == 0, F.col("_order"))).alias("_end"))
    parts = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carried = ends.select("_part", F.last("_end", ignorenulls=True).over(parts).alias("_open"))
    era = F.coalesce("_here", "_open")
    found = seen.where("_k = 1").join(carried, "_part").withColumn("_v", F.when(era.isNotNull(), era["v"]).otherwise(F.lit(None)))
    return found.select("_row.*", F.coalesce("_v", default).alias(value))


def prior_rows(facts: DataFrame, dims: DataFrame, at: str, since: str, key: str) -> DataFrame:
    """Per fact the keys of all dimension rows not later than it. Dims are few, since every fact lists them; more stop the query."""
    if dims.count() > FEW:
        raise ValueError(f"a fact would list more than {FEW} rows")
    folded = dims.agg(F.array_sort(F.collect_list(F.struct(F.col(since).alias("s"), F.col(key).alias("k")))).alias("_dims"))
    return facts.crossJoin(F.broadcast(folded)).withColumn("prior", F.transform(F.filter("_dims", lambda d: d["s"] <= F.col(at)), lambda d: d["k"])).drop("_dims")


def missing(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in the log of what is done; failures count as done."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


# Characters of parts that one automaton is made of; more parts are split over several.
AUTOMATON_CHARS = 16 << 20


def contains_any(texts: DataFrame, key: str, text: str, parts: DataFrame, part: str, most_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """The keys of texts that contain one of the parts as a substring; an empty part is in every text.

    Parts become an automaton that reads each text once, whatever their number; texts stay where they are, and what is
    shuffled is the keys found. Parts go out as often as there are tasks, so their size is checked: those of more than
    `most_chars` characters are dealt by hash to as many automata as hold them, each made of a bounded number, and texts
    are read once for each. Null texts and parts match nothing.
    """
    spark = texts.sparkSession
    inner = parts.select(F.col(part).alias("_part")).where(F.col(part).isNotNull()).distinct()
    size = inner.agg(F.coalesce(F.sum(F.length("_part") + 1), F.lit(0)).alias("n"), F.coalesce(F.bool_or(F.col("_part") == ""), F.lit(False)).alias("all")).first()
    known = texts.where(F.col(text).isNotNull())
    if size["all"]:
        return known.select(key).distinct()
    count = -(-size["n"] // most_chars)
    kind = texts.schema[key].dataType.simpleString()
    out = known.select(key).limit(0)
    for k in range(count):
        some = [r[0] for r in inner.where(F.pmod(F.xxhash64("_part"), F.lit(count)) == k).collect()]  # at most about most_chars
        if some:
            out = out.unionByName(known.select(key, text).mapInArrow(_matching(spark.sparkContext.broadcast(some)), f"`{key}` {kind}"))
    return out.distinct()


def _matching(sent: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ahocorasick.Automaton()
        for p in sent.value:
            found.add_word(p, 1)
        found.make_automaton()
        for batch in batches:
            hit = [next(found.iter(t), None) is not None for t in batch.column(1).to_pylist()]
            keys = batch.column(0).filter(pa.array(hit, pa.bool_()))
            yield pa.RecordBatch.from_arrays([keys], [batch.schema.names[0]])

    return run


def required(rows: DataFrame, lookup: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with the value of their keys; a row without one stops the query."""
    joined = rows.join(lookup, keys, "left")
    told = F.raise_error(F.concat(F.lit(f"no {value} for "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])))
    return joined.withColumn(value, F.coalesce(F.col(value), told.cast("double")))


def full_comparison(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Every key of two manifests with its state: ok, MISMATCH, MISSING on the right, UNLISTED on the left."""
    a, b = left.select(key, F.col(value).alias("_l")), right.select(key, F.col(value).alias("_r"))
    state = F.when(F.col("_r").isNull(), "MISSING").when(F.col("_l").isNull(), "UNLISTED").when(F.col("_l") == F.col("_r"), "ok").otherwise("MISMATCH")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


BLOCK_ROWS, PIVOTS, RINGS = 4096, 256, 12
# Bytes of vectors of a shelf, which a task holds. Rows of queries and of a shelf that are scored at once, hits a query that
# are too many to look at one by one, and pairs whose scores are made anew together.
SHELF_BYTES, SCORED_ROWS, HELD_ROWS, CROWD, EXACT_PAIRS = 32 << 20, 512, 8192, 64, 1 << 15


def shaped(vectors: DataFrame, key: str, vec: str, pivots: np.ndarray) -> DataFrame:
    """Adds the cell of the nearest pivot, and the angle to it, of vectors of length one."""
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            score = x @ pivots.T if len(batch) else np.zeros((0, 1))
            cell = score.argmax(axis=1)
            angle = np.arccos(np.clip(score[np.arange(len(batch)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(angle)], [key, vec, "_cell", "_angle"])

    plain = vectors.select(key, F.transform(vec, lambda x: x.cast("double")).alias(vec))
    return plain.mapInArrow(run, f"`{key}` {kind}, `{vec}` array<double>, _cell int, _angle double")


def blocked(shapes: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Shaped vectors with the block they lie in, and the blocks: cell, nearest and farthest angle, least and greatest key.

    A block is a ring of a cell, or a part of one, of about `most` vectors.
    """
    ringed = shapes.withColumn("_ring", F.floor(F.col("_angle") * RINGS / np.pi).cast("int"))
    sizes = ringed.groupBy("_cell", "_ring").agg(F.ceil(F.count(F.lit(1)) / most).cast("long").alias("_parts"))
    placed = ringed.join(F.broadcast(sizes), ["_cell", "_ring"])  # at most PIVOTS * RINGS rows
    named = placed.withColumn("_block", F.concat_ws(":", "_cell", "_ring", F.pmod(F.xxhash64(key), F.col("_parts")))).drop("_parts", "_ring")
    about = named.groupBy("_block", "_cell").agg(F.min("_angle").alias("near"), F.max("_angle").alias("far"), F.min(key).alias("first"), F.max(key).alias("last"))
    return named, about


def tiles(asking: DataFrame, stored: DataFrame, pivots: np.ndarray, least: float) -> DataFrame:
    """Pairs of blocks (q_block, s_block) that may hold an earlier vector of cosine `least`; all others are passed over.

    Angles obey the triangle inequality: two vectors are at least as far apart as their pivots less their own angles, and
    as one's angle less the other's and the pivots' apart.
    """
    spark = asking.sparkSession
    apart = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    cells = spark.createDataFrame([(i, j, float(apart[i, j])) for i in range(len(pivots)) for j in range(len(pivots))], "q_cell int, s_cell int, apart double")
    name = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c.lstrip('_')}") for c in ("_block", "_cell", "near", "far", "first", "last")])
    gap = F.greatest(F.col("apart") - F.col("q_far") - F.col("s_far"), F.col("q_near") - F.col("apart") - F.col("s_far"), F.col("s_near") - F.col("apart") - F.col("q_far"), F.lit(0.0))
    both = name(asking, "q").join(F.broadcast(cells), "q_cell").join(name(stored, "s"), "s_cell")  # PIVOTS squared rows
    return both.where((F.cos(gap) >= least - 1e-6) & (F.col("s_first") < F.col("q_last"))).select("q_block", "s_block")


def shelved(named: DataFrame, rows: int) -> DataFrame:
    """Blocks (_block) put on shelves (_shelf) of about `rows` vectors, those of a cell together."""
    sizes = named.groupBy("_cell", "_block").agg(F.count(F.lit(1)).alias("n")).orderBy("_cell", "_block").collect()  # as many as blocks
    before = np.cumsum([0, *(r["n"] for r in sizes)])
    return named.sparkSession.createDataFrame([(r["_block"], int(lo // rows)) for r, lo in zip(sizes, before)], "_block string, _shelf int")


def top_similar(queries: DataFrame, store: DataFrame, k: int, least: float, other: tuple[DataFrame, DataFrame] | None = None, most: int = BLOCK_ROWS) -> DataFrame:
    """For each query vector the k most similar earlier stored vectors with similarity at least `least`.

    Both sides, unit vectors, are put in blocks by their shape: the nearest of a few stored vectors chosen by hash, and
    the ring of angles around it. Blocks lie on shelves of a bounded size, and pairs of shelves without a pair of blocks
    that can reach the threshold are never made. A task holds one shelf of the store and lets one of queries pass by, so
    a vector is sent as often as there are shelves, and a pair of shelves gives at most k rows a query. Ties keep the
    store's order. With `other` (query_id, query_text and id, text: numbers that stand for the texts) pairs of equal text
    are left out before they are ranked; no text equals no text.
    """
    queries, store = queries.where("query_vec is not null"), store.where("vec is not null")
    count = store.count()
    wanted = int(min(PIVOTS, max(1, count // most)))
    chosen = store.orderBy(F.xxhash64("id"), "id").limit(wanted).select("vec").collect()  # at most PIVOTS vectors
    spark = store.sparkSession
    empty = "query_id long, id long, score double, rank int"
    if not chosen:
        return spark.createDataFrame([], empty)
    pivots = np.array([r["vec"] for r in chosen], float)
    left, asking = blocked(shaped(queries, "query_id", "query_vec", pivots), "query_id", most)
    right, stored = blocked(shaped(store, "id", "vec", pivots), "id", most)
    # At least as many shelves as hold the store, and as give each core a few pairs of them.
    shelves = max(-(-count * pivots.shape[1] * 8 // SHELF_BYTES), min(-(-count // most), int(np.ceil((3 * spark.sparkContext.defaultParallelism) ** 0.5))))
    on = [shelved(side, -(-count // shelves)) for side in (left, right)]
    name = lambda df, p: df.select(F.col("_block").alias(f"{p}_block"), F.col("_shelf").alias(f"{p}_shelf"))
    made = tiles(asking, stored, pivots, least).join(F.broadcast(name(on[0], "q")), "q_block").join(F.broadcast(name(on[1], "s")), "s_block")
    pairs = [(r[0], r[1], t) for t, r in enumerate(made.select("q_shelf", "s_shelf").distinct().orderBy("q_shelf", "s_shelf").collect())]  # shelves squared
    if not pairs:
        return spark.createDataFrame([], empty)
    dealt = spark.createDataFrame(pairs, "q_shelf int, s_shelf int, tile int")
    apart = other is not None
    if apart:
        left, right = left.join(other[0], "query_id"), right.join(other[1], "id")

    def sent(df: DataFrame, where: DataFrame, shelf: str, side: int, i: str, v: str, t: str) -> DataFrame:
        text = F.col(t).cast("bigint") if apart else F.lit(0).cast("bigint")
        at = df.join(F.broadcast(where), "_block").join(F.broadcast(dealt.withColumnRenamed(shelf, "_shelf")), "_shelf")
        return at.select("tile", F.lit(side).alias("side"), F.col(i).cast("bigint").alias("id"), F.col(v).alias("vec"), F.coalesce(text, F.lit(0)).alias("text"), text.isNull().alias("none"))

    both = sent(right, on[1], "s_shelf", 0, "id", "vec", "text").unionByName(sent(left, on[0], "q_shelf", 1, "query_id", "query_vec", "query_text"))
    placed = both.repartitionById(len(pairs), "tile").sortWithinPartitions("tile", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, parts, held = None, [], None
        for batch in batches:
            keys, sides = (batch.column(c).to_numpy() for c in (0, 1))
            for lo, hi in pairwise([0, *(np.flatnonzero(np.diff(2 * keys + sides)) + 1), len(batch)]):
                if hi > lo and keys[lo] != tile:
                    tile, parts, held = keys[lo], [], None
                rows = _unpacked(batch.slice(lo, hi - lo))
                if hi > lo and not sides[lo]:
                    parts.append(rows)
                elif hi > lo and (parts or held):
                    held, parts = held or [np.concatenate(x) for x in zip(*parts, strict=True)], []
                    for at in range(0, hi - lo, SCORED_ROWS):
                        yield _best([x[at : at + SCORED_ROWS] for x in rows], held, k, least, apart)

    found = placed.mapInArrow(run, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.select("query_id", "id", "score", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def _best(asked: list[np.ndarray], held: list[np.ndarray], k: int, least: float, apart: bool) -> pa.RecordBatch:
    """The k best held rows of each asked one: chosen by products of matrices in single precision, less its error, then by scores made one by one."""
    (qi, qv, qt, qn), (si, sv, st, sn) = asked, held
    slack = (qv.shape[1] + 8) * 2.0**-23
    single, bound = qv.astype(np.float32), np.full(len(qi), least - slack, np.float32)
    a, b, exact = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for lo in range(0, len(si), HELD_ROWS):
        part = slice(lo, lo + HELD_ROWS)
        score = single @ sv[part].astype(np.float32).T
        hit = score >= bound[:, None]
        if np.count_nonzero(hit) > CROWD * len(qi) and score.shape[1] > k:  # the k-th best of these is a bound already
            out = (si[part] >= qi[:, None]) | np.isnan(score)
            if apart:
                out |= (qt[:, None] == st[part]) & (qn[:, None] == sn[part])
            score[out] = -np.inf
            bound = np.maximum(bound, np.partition(score, score.shape[1] - k, axis=1)[:, -k] - np.float32(2 * slack))
            hit = score >= bound[:, None]
        x, y = np.nonzero(hit)
        y += lo
        some = si[y] < qi[x]
        if apart:
            some &= (qt[x] != st[y]) | (qn[x] != sn[y])
        x, y = x[some], y[some]
        if not len(x):
            continue
        made = np.empty(len(x))
        for at in range(0, len(x), EXACT_PAIRS):  # equal vectors get equal scores, wherever they lie
            made[at : at + EXACT_PAIRS] = (qv[x[at : at + EXACT_PAIRS]] * sv[y[at : at + EXACT_PAIRS]]).sum(axis=1)
        some = made >= least
        a, b, exact = np.append(a, x[some]), np.append(b, y[some]), np.append(exact, made[some])
        order = np.lexsort((si[b], -exact, a))
        a, b, exact = a[order], b[order], exact[order]
        first = np.arange(len(a)) - np.searchsorted(a, a) < k
        a, b, exact = a[first], b[first], exact[first]
        full = np.flatnonzero(np.bincount(a, minlength=len(qi)) == k)
        bound[full] = exact[np.searchsorted(a, full, "right") - 1] - slack
    return pa.RecordBatch.from_arrays([pa.array(qi[a]), pa.array(si[b]), pa.array(exact)], ["query_id", "id", "score"])


def _unpacked(batch: pa.RecordBatch) -> list[np.ndarray]:
    """id, vec, text, none of rows (tile, side and these)."""
    ids, texts, none = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 4, 5))
    return [ids, batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1)), texts, none]
