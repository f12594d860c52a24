"""MinHash near-duplicates: b-bit signatures, a multi-index Hamming join, exact confirmation, components.

A signature has 32 values of 16 bits. Two sets with Jaccard similarity 0.85 differ in a value with probability
0.15, so in more than 15 of 32 values with probability 4e-6: 15 is the signature-distance threshold. The 32 values
are split into 8 chunks of 4. By pigeonhole two signatures within distance 15 have a chunk with at most one wrong
value, so indexing every chunk under each of its 4 ways to leave one value out finds all pairs under the threshold.

Pairs are confirmed on the full sets of shingles (64-bit hashes of all of them). No pairs within a group are
enumerated: texts with equal sets are one node; in an index bucket every node is first compared with the bucket's
smallest node, then with its most central one; in buckets whose nodes are not in one component yet, the nodes outside
the bucket's largest component are compared with the nodes of other components, unless the shingles that only one of
them has (in no other open set, or in a bitmap of each set) rule the similarity out. That leaves out only pairs already connected and pairs that cannot be near.

Cases: a null or empty text, or one of white space alone, has no shingles and is linked with nothing; a text with
fewer words than a shingle is one shingle; texts of any length count whole; repeated rows are one node and a row each
in the result; rows of one doc_id with different texts are linked each by its own text, and belong to the class of
the smallest doc_id linked with it; rows with a null doc_id are scored and kept, and linked with nothing; other
columns may have any names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_words, chunks, mix64, slice_hashes, small_batches, text_buffers

VALUES, CHUNKS, PER_CHUNK, BITS = 32, 8, 4, 16
DISTANCE = 15
BIT_WORDS = 32
# Nodes of a bucket that one part of it holds on either side: both sides are dealt, and a node is sent once for each part
# of the other side, as often as the bucket has multiples of this.
PART_NODES = 4096
# Up to this many edges a step is planned over its table as it is; beyond, its sums are written first, so that Spark
# knows their size and can split the edges of a hub. Both give the same rows.
PLAIN_EDGES = 200_000
_MULTIPLIERS = mix64(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)
_OFFSETS = mix64(np.arange(101, VALUES + 101, dtype=np.uint64))


def shingle_sets(raw: np.ndarray, at: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of so many words, A-Z lower-cased."""
    data = raw + np.uint8(32) * ((raw >= 65) & (raw <= 90)).astype(np.uint8)
    starts, ends, first = ascii_words(data, at)
    h = slice_hashes(data, starts, ends)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        own = h[a:b]
        size = min(words, len(own))
        if not size:
            yield own
            continue
        n = len(own) - size + 1
        x = mix64(own[:n] ^ np.uint64(size))
        for k in range(1, size):
            x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + own[k : k + n])
        x = np.sort(x)
        yield x[np.append(True, x[1:] != x[:-1])]


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """Signatures of non-empty sets: len(sets) x 32 values of 16 bits."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), VALUES), np.uint16)
    for k in range(VALUES):
        x = flat * _MULTIPLIERS[k] + _OFFSETS[k]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        out[:, k] = (mix64(np.minimum.reduceat(x, at)) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_md5 (null for no shingles), s0..s7: a chunk of four values each."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_buffers(batch.column(1))
            for lo, hi, data, own in chunks(raw, at):
                sets = list(shingle_sets(data, own, words))
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                signs = np.zeros((len(sets), CHUNKS), np.int64)
                full = np.flatnonzero(sizes)
                if len(full):
                    signs[full] = minhash([sets[i] for i in full]).view(np.int64)
                md5 = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes), pa.array(md5, pa.binary()), *[pa.array(signs[:, c]) for c in range(CHUNKS)]], names)

    names = ["doc_id", "n_shingles", "set_md5", *[f"s{c}" for c in range(CHUNKS)]]
    kinds = ", ".join(f"s{c} long" for c in range(CHUNKS))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, n_shingles long, set_md5 binary, {kinds}")


def full_sets(rows: DataFrame, words: int) -> DataFrame:
    """node, shingles (the sorted distinct hashes of its text) and bits: 2048 bits, set where a shingle falls.

    rows: node, set_md5, text. A text whose set is not the node's is another row of the same doc_id and left out.
    """
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_buffers(batch.column(2))
            for lo, hi, data, own in chunks(raw, at):
                wanted = batch.column(1).slice(lo, hi - lo).to_pylist()
                every = list(shingle_sets(data, own, words))
                mine = [i for i, s in enumerate(every) if hashlib.md5(s.tobytes()).digest() == wanted[i]]
                if not mine:
                    continue
                sets = [every[i] for i in mine]
                ends = np.cumsum([0, *map(len, sets)])
                bits = np.zeros((len(sets), 64 * BIT_WORDS), np.uint8)
                flat = np.concatenate(sets)
                bits[np.repeat(np.arange(len(sets)), np.diff(ends)), (flat >> np.uint64(64 - (64 * BIT_WORDS).bit_length() + 1)).astype(np.int64)] = 1
                packed = np.packbits(bits, axis=1, bitorder="little").view(np.int64).reshape(-1)
                steps = pa.array(np.arange(len(sets) + 1) * BIT_WORDS, pa.int32())
                node = batch.column(0).slice(lo, hi - lo).take(pa.array(mine))
                columns = [node, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64))), pa.ListArray.from_arrays(steps, pa.array(packed))]
                yield pa.RecordBatch.from_arrays(columns, ["node", "shingles", "bits"])

    return rows.select("node", "set_md5", "text").mapInArrow(run, "node long, shingles array<long>, bits array<long>")


def most_common(a: str, b: str) -> Column:
    """No fewer shingles than two sets share: a bit that only one set has stands for a shingle that the other lacks."""
    only = lambda p, q: F.aggregate(F.zip_with(f"{p}bits", f"{q}bits", lambda x, y: x.bitwiseAND(F.bitwise_not(y))), F.lit(0), lambda n, x: n + F.bit_count(x))
    return F.least(F.col(f"{a}n_shingles") - only(a, b), F.col(f"{b}n_shingles") - only(b, a))


def buckets(nodes: DataFrame) -> DataFrame:
    """Every node under 8 x 4 keys: a chunk in which the number of the way stands for the value left out."""
    keys = []
    for way in range(CHUNKS * PER_CHUNK):
        chunk, lane = divmod(way, PER_CHUNK)
        mask = ((1 << 64) - 1) ^ (0xFFFF << (BITS * lane))
        mark = way << (BITS * lane)
        signed = [F.lit(m - (1 << 64) if m >= 1 << 63 else m).cast("long") for m in (mask, mark)]
        keys.append(F.col(f"s{chunk}").bitwiseAND(signed[0]).bitwiseOR(signed[1]))
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "node")


def distance(a: str, b: str) -> Column:
    """Values that differ between two signatures, on the columns a_s0.. and b_s0..: lanes of 16 bits that are not equal."""

    def lanes(x: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF00FF00FF), (4, 0x000F000F000F000F), (2, 0x0003000300030003), (1, 0x0001000100010001)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return F.bit_count(x)

    side = lambda p: F.array(*[F.col(f"{p}s{c}") for c in range(CHUNKS)])
    return F.aggregate(F.zip_with(side(a), side(b), lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda n, x: n + lanes(x))


def _signed(pairs: DataFrame, nodes: DataFrame, most: int, share: float) -> DataFrame:
    """Pairs (a, b) whose signatures are near enough and whose sizes allow the similarity."""
    columns = [f"s{c}" for c in range(CHUNKS)]
    side = lambda p: nodes.select(F.col("node").alias(p), F.col("n_shingles").alias(f"{p}_n"), *[F.col(s).alias(f"{p}_{s}") for s in columns])
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    fits = F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * int(share * 100)
    return joined.where(fits & (distance("a_", "b_") <= most)).select("a", "b")


def sets_of(nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """full_sets of the nodes (node, first_id, set_md5). The documents are dealt by id once, at every size."""
    wanted = nodes.select(F.col("first_id").alias("doc_id"), "node", "set_md5")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.hint("merge"), "doc_id")
    return full_sets(texts.dropDuplicates(["doc_id", "node", "text"]), words)


def confirmed(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose full sets have 100 * intersection >= 100 * share * union."""
    side = lambda p: sets.select(F.col("node").alias(p), F.col("shingles").alias(f"s{p}"))
    both = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    near = common * 100 >= (F.size("sa") + F.size("sb") - common) * int(round(share * 100))
    return both.where(near).select("a", "b")


def own_shingles(sets: DataFrame) -> DataFrame:
    """node, own: how many of a set's shingles no other of these sets has, or fewer (32 bits of each are compared)."""
    each = sets.select("node", F.explode(F.transform("shingles", lambda s: (s.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")) - F.lit(1 << 31).cast("long")).cast("int"))).alias("s"))
    alone = each.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1")
    return alone.groupBy("node").agg(F.count(F.lit(1)).alias("own"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of every node with an edge (a, b).

    Alternating large-star and small-star steps: each keeps connectivity and hangs nodes on smaller ones until
    nothing changes, in about log(longest path) rounds. Edges go to the shared folder between rounds; so do the
    smallest neighbours, which are summed per task first, so that Spark can split the edges of a hub.
    """
    scratch = Scratch(edges.sparkSession, "components")

    def star(edges: DataFrame, large: bool, few: bool) -> DataFrame:
        turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        both = edges.select("a", "b").union(turned) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = least if few else scratch.keep(least)
        linked = both.join(least, "a")
        if large:
            out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.where("a <> m").select("a", F.col("m").alias("b")))
        next_edges = scratch.keep(out.distinct())
        if not few:
            scratch.drop(least)
        return next_edges

    # A round that leaves count and sums as they were has changed nothing: labels only ever fall.
    sums = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    found = sums(now)
    while found[0] and found != state:
        state, few = found, found[0] <= PLAIN_EDGES
        half = star(now, True, few)
        scratch.drop(now)
        now = star(half, False, few)
        scratch.drop(half)
        found = sums(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def grown(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels (node, component) after more links (a, b): components of components. Without new ones the labels stand."""
    named = lambda df, c: df.join(labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")), c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
    between = scratch.keep(named(named(links, "a"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    if between.isEmpty():
        return labels
    higher = components(between).select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    moved = labels.join(higher, F.col("component") == F.col("_n"), "left").select("node", F.coalesce("_c", "component").alias("component"))
    # Nodes without a link before are their own component, and come in here.
    own = higher.join(labels, F.col("_n") == F.col("node"), "left_anti").select(F.col("_n").alias("node"), F.col("_c").alias("component"))
    return scratch.keep(moved.union(own))


def _open_buckets(members: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Members (key, node) of buckets with several components, with their component, and the bucket's largest one and sizes."""
    named = scratch.keep(members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")))
    parts = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    top = F.max(F.struct("n", "component"))
    several = parts.groupBy("key").agg(top.alias("top"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("members")).where("parts > 1")
    # Written first: the join then has plain tables on both sides, and Spark can split a bucket with most of the rows.
    written = scratch.keep(several.select("key", F.col("top.component").alias("largest"), "members", (F.col("members") - F.col("top.n")).alias("minors")))
    out = scratch.keep(named.join(written, "key"))
    scratch.drop(named, written)
    return out


def linked_nodes(docs: DataFrame, signs: DataFrame, scratch: Scratch, words: int, share: float, most: int) -> DataFrame:
    """set_md5, node, first_id and component (a node) of every distinct set."""
    columns = [f"s{c}" for c in range(CHUNKS)]
    percent = int(round(share * 100))
    distinct = signs.where("set_md5 is not null and doc_id is not null").groupBy("set_md5").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), *[F.first(s).alias(s) for s in columns])
    nodes = scratch.keep(distinct.withColumn("node", F.monotonically_increasing_id()))

    # Each node and the smallest node of each of its buckets.
    index = buckets(nodes)
    heads = scratch.keep(index.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    shared = scratch.keep(index.join(heads, "key"))
    scratch.drop(heads)
    sets = scratch.keep(sets_of(nodes.select("node", "first_id", "set_md5").join(shared.select("node").distinct(), "node", "left_semi"), docs, words))
    stars = scratch.keep(_signed(shared.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct(), nodes, most, share))
    links = scratch.keep(confirmed(stars, sets, share))

    # What stars left open: buckets with several components. A set's own shingles are in no other open set, so they
    # bound its similarity to all of them; sets that can reach none are out.
    labels = components(links)
    opened = _open_buckets(shared.select("key", "node"), labels, scratch)
    scratch.drop(stars, shared)
    own = own_shingles(sets.join(opened.select("node").distinct().hint("merge"), "node", "left_semi"))
    detail = nodes.select("node", "n_shingles").join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    able = scratch.keep(opened.select("node").distinct().join(detail, "node").where((F.col("n_shingles") - F.col("own")) * 10000 >= percent * (percent * F.col("n_shingles") + 100 * F.col("own"))))

    # Again stars, around the set of each bucket with the fewest shingles of its own: copies gather about their source.
    members = scratch.keep(opened.select("key", "node").join(able, "node"))
    scratch.drop(opened)
    centres = scratch.keep(members.groupBy("key").agg(F.min(F.struct("own", "node")).alias("_m")).select("key", F.col("_m.node").alias("head")))
    second = members.join(centres, "key").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    labels = grown(labels, scratch.keep(confirmed(scratch.keep(_signed(second, nodes, most, share)), sets, share)), scratch)

    # The rest, pair by pair: nodes outside their bucket's largest component against nodes of other components. Sizes
    # of near sets are in the same or the next class, and a large bucket is dealt over a grid of parts.
    left = _open_buckets(members.select("key", "node"), labels, scratch)
    sized = left.join(able.join(sets.select("node", "bits"), "node"), "node").withColumn("size_class", F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(100.0 / percent) * (1 + 1e-9))).cast("int"))
    tall, wide = (F.ceil(F.col(c) / PART_NODES).cast("int") for c in ("minors", "members"))
    carried = ("node", "component", "largest", "n_shingles", "own", "bits")
    side = lambda p, df: df.select("key", "size_class", "row", "col", *[F.col(c).alias(f"{p}_{c}") for c in carried])
    dealt = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every_part = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    classes = F.explode(F.sequence(F.col("size_class") - 1, F.col("size_class") + 1))
    minor = side("a", sized.where("component <> largest").withColumn("row", dealt(tall)).withColumn("col", every_part(wide)).withColumn("size_class", classes))
    every = side("b", sized.withColumn("col", dealt(wide)).withColumn("row", every_part(tall)))
    once = (F.col("b_component") == F.col("b_largest")) | (F.col("a_node") < F.col("b_node"))
    apart = (F.col("a_component") != F.col("b_component")) & once
    common = F.least(F.col("a_n_shingles") - F.col("a_own"), F.col("b_n_shingles") - F.col("b_own"))
    whole = F.greatest(F.col("a_n_shingles") + F.col("b_own"), F.col("b_n_shingles") + F.col("a_own"), F.col("a_n_shingles") + F.col("b_n_shingles") - common)
    close = (common * 100 >= whole * percent) & (most_common("a_", "b_") * (100 + percent) >= (F.col("a_n_shingles") + F.col("b_n_shingles")) * percent)
    # The bounds are exact and closer than the signatures' distance here; a pair may come from several buckets.
    pairs = minor.hint("merge").join(every, ["key", "size_class", "row", "col"]).where(apart & close)
    rest = scratch.keep(pairs.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct())
    final = grown(labels, scratch.keep(confirmed(rest, sets, share)), scratch)
    scratch.drop(sets, left, members, able, centres)
    return nodes.select("set_md5", "node", "first_id").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _classes(docs: DataFrame, words: int, share: float, most: int) -> tuple[DataFrame, DataFrame]:
    """The documents' signatures (a row each) and, by set_md5, the smallest doc_id of the set and of its component."""
    scratch = Scratch(docs.sparkSession, "near-dup")
    signs = scratch.keep(signatures(docs, words))
    linked = scratch.keep(linked_nodes(docs, signs, scratch, words, share, most))
    least = linked.groupBy("component").agg(F.min("first_id").alias("component_id"), F.min(F.struct("first_id", "set_md5")).alias("_top"))
    named = linked.join(least, "component").select("set_md5", "first_id", "component_id", (F.col("_top.set_md5") == F.col("set_md5")).alias("chosen"))
    return signs, scratch.keep(named)


def near_duplicates(docs: DataFrame, *, words: int = 5, share: float = 0.8, most: int = DISTANCE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row."""
    signs, named = _classes(docs, words, share, most)
    out = signs.select("doc_id", "n_shingles", "set_md5").join(named.select("set_md5", "component_id"), "set_md5", "left")
    mine = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", mine.alias("component_id"), F.coalesce(F.col("doc_id") == mine, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, words: int = 5, share: float = 0.8, most: int = DISTANCE) -> DataFrame:
    """One row of each group stays: that of its smallest doc_id (of several sets there, the first by digest).

    Rows repeated with their doc_id and set count once; rows of one doc_id with different texts are judged each by
    its own text; rows without a doc_id or without words stay. Other columns may have any names.
    """
    signs, named = _classes(docs, words, share, most)
    rows = signs.where("doc_id is not null").select("doc_id", "set_md5").join(named, "set_md5", "left")
    stays = F.col("set_md5").isNull() | (F.col("chosen") & (F.col("doc_id") == F.col("first_id")))
    fates = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(stays).alias("stays"))
    scratch = Scratch(docs.sparkSession, "fates")
    # Most ids have one row and are decided by their id; the rows of repeated ids are looked at again by their sets.
    gone = scratch.keep(fates.where("n > 1 or not stays"))
    whole = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), "text")
    single = whole.join(gone.select(F.col("doc_id").alias("_id")), "_id", "left_anti").select("_row.*")
    again = whole.join(gone.where("n > 1").select(F.col("doc_id").alias("_id")), "_id", "left_semi")
    seen = _with_set(again, words)
    fate = named.where("chosen").select(F.col("set_md5").alias("_md5"), F.col("first_id").alias("_id"))
    kept = seen.where("_md5 is not null").join(fate, ["_md5", "_id"], "left_semi").unionByName(seen.where("_md5 is null"))
    return single.unionByName(kept.withColumn("_set", F.coalesce("_md5", F.lit(b""))).dropDuplicates(["_id", "_set"]).select("_row.*"))


def _with_set(rows: DataFrame, words: int) -> DataFrame:
    """_row, _id and _md5, the digest of the text's set (null for none)."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_buffers(batch.column(2))
            md5 = []
            for _, _, data, own in chunks(raw, at):
                md5 += [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in shingle_sets(data, own, words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(md5, pa.binary())], ["_row", "_id", "_md5"])

    return rows.select("_row", "_id", "text").mapInArrow(run, f"_row {rows.schema['_row'].dataType.simpleString()}, _id long, _md5 binary")
