"""Byte-level BPE: pre-tokenisation by scans over arrays, cached pair merging, and decoding.

Each code point becomes a symbol: its class (letter, number, white space, other) refined by what follows it. A symbol
is a function from the state before it to the state after it. Function composition is associative, so blocks of
symbols are composed side by side, the blocks' functions are scanned, and every block is then run from its true
entry state; no regular expression is involved. Pieces are slices between boundaries and look up a bounded cache.

Cases: a null text is empty and has no ids; any length of text or piece is encoded whole (long pieces merge with a
heap); repeated rows give repeated rows; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, digests, small_batches, text_buffers

# Bytes of a worker's cache of pieces, about; beyond, the older half goes. A piece costs its text, ids and entries.
CACHE_BYTES = 40_000_000
PIECE_COST = 230
BLOCK = 256
NONE = np.int32(2**31 - 1)

# Symbols. SPACE is a space that ends a run of white space before a visible character and so may lead its token;
# BREAK is another character there; BLANK is white space before more of it or before the end of the text.
LETTER, NUMBER, SPACE, BREAK, BLANK, OTHER, SHORT, LONG = range(8)
# States: what the last character was part of.
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, LEAD, IN_BLANKS, TWO_LEFT, ONE_LEFT = range(8)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and boundary flag by symbol * 8 + state; symbols from 8 on are the same at the start of a text."""
    after, cut = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)

    def rule(symbol: int, state: int, to: int, joins: bool) -> None:
        after[symbol, state], cut[symbol, state] = to, not joins

    for state in range(8):
        rule(LETTER, state, IN_LETTERS, state in (IN_LETTERS, LEAD))
        rule(NUMBER, state, IN_NUMBERS, state in (IN_NUMBERS, LEAD))
        rule(OTHER, state, IN_OTHERS, state in (IN_OTHERS, LEAD))
        rule(SPACE, state, LEAD, False)
        rule(BREAK, state, FREE, False)
        rule(BLANK, state, IN_BLANKS, state == IN_BLANKS)
        # An apostrophe opens a contraction unless it goes on a run of other characters or follows a leading space.
        joined = state in (IN_OTHERS, LEAD)
        rule(SHORT, state, IN_OTHERS if joined else ONE_LEFT, joined)
        rule(LONG, state, IN_OTHERS if joined else TWO_LEFT, joined)
    rule(LETTER, TWO_LEFT, ONE_LEFT, True)
    rule(LETTER, ONE_LEFT, FREE, True)
    after[8:] = after[:8, :1]
    return after.reshape(-1), cut.reshape(-1)


AFTER, CUT = _tables()


# The letters and numbers of Unicode 16 that tables of version 15.1 lack, as ranges of code points.
LATER_LETTERS = """1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E
  11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"""
LATER_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"


def ranges(text: str) -> Iterator[slice]:
    for part in text.split():
        first, _, last = part.partition("-")
        yield slice(int(first, 16), int(last or first, 16) + 1)


@functools.cache
def classes() -> np.ndarray:
    """0 letter, 1 number, 2 white space, 3 other, by code point, as of Unicode 16."""
    out = np.full(sys.maxunicode + 1, 3, np.uint8)
    for cp in range(0x40000):  # there are no letters or numbers beyond
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LN":
            out[cp] = "LN".index(kind)
    for kind, later in enumerate((LATER_LETTERS, LATER_NUMBERS)):
        for some in ranges(later):
            out[some] = kind
    # White space of Unicode.
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 2
    return out


def symbols(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The symbol of each code point; at: the texts' starts and the end of the last."""
    kind = classes()[points]
    first = np.zeros(len(points) + 1, bool)
    first[at] = True
    ends = first[1:]
    blank = kind == 2
    more = np.append(blank[1:], False) | ends  # white space or the end follows
    out = np.array([LETTER, NUMBER, BREAK, OTHER], np.uint8)[kind]
    out[blank & (points == 32)] = SPACE
    out[blank & more] = BLANK
    quote = np.flatnonzero((points == 39) & ~ends)
    if len(quote):
        wide = np.append(points, np.zeros(2, points.dtype))
        a, b = wide[quote + 1], wide[quote + 2]
        out[quote[np.isin(a, np.array([ord(c) for c in "stmd"], points.dtype))]] = SHORT
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        out[quote[two & ~first[np.minimum(quote + 2, len(points))]]] = LONG
    return out + 8 * first[:-1].astype(np.uint8)


def boundaries(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Start of each piece, in code points over all texts, and the end."""
    n = len(points)
    if not n:
        return np.zeros(1, np.int64)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint8)
    padded[:n] = symbols(points, at)
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T) * np.uint8(8)
    run = np.repeat(np.arange(8, dtype=np.uint8)[:, None], blocks, axis=1)
    for column in columns:  # each block's function, all blocks side by side
        run = AFTER[column + run]
    step = 1
    while step < blocks:  # inclusive scan of the blocks' functions by doubling
        run = np.concatenate([run[:, :step], np.take_along_axis(run[:, step:], run[:, :-step], axis=0)], axis=1)
        step *= 2
    state = np.concatenate([np.zeros(1, np.uint8), run[FREE, :-1]])
    cut = np.empty((BLOCK, blocks), bool)
    for j, column in enumerate(columns):
        place = column + state
        cut[j], state = CUT[place], AFTER[place]
    return np.append(np.flatnonzero(cut.T.reshape(-1)[:n]), n)


class PairTable:
    """Rank of the token that two tokens make, for arrays of pairs: open addressing, probed for all pairs at once."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        keys, values = [], []
        for token, rank in ranks.items():  # every way to put a token together from two
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.bits = max(8, (2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        key, value = np.array(keys, np.int64), np.array(values, np.int32)
        slot = self._slots(key)
        while len(key):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = key[free]  # of two for one slot, one stays
            placed = self.keys[slot] == key
            self.values[slot[placed]] = value[placed]
            key, value, slot = key[~placed], value[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks, NONE where two tokens make none; negative ids are padding."""
        out = np.full(left.shape, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key = left.reshape(-1)[todo].astype(np.int64) << 32 | right.reshape(-1)[todo]
        slot = self._slots(key)
        flat = out.reshape(-1)
        while len(todo):
            seen = self.keys[slot]
            hit = seen == key
            flat[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (seen != -1)
            todo, key, slot = todo[on], key[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out


class Pieces(dict):
    """Ids by piece, as bytes; new pieces are merged together, many at a time. Bounded in bytes: the older half goes when full."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks, self.pairs = ranks, PairTable(ranks)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def look_up(self, pieces: list[str]) -> list[bytes]:
        """The pieces' ids, as bytes of 32-bit integers."""
        found = list(map(self.get, pieces))
        missed = [i for i, ids in enumerate(found) if ids is None]
        if not missed:
            return found
        new = {pieces[i] for i in missed}
        made: dict[str, bytes] = {}
        long: dict[str, bytes] = {}  # not kept
        groups: dict[int, list[tuple[str, bytes]]] = {8: [], 16: [], 32: [], 64: []}
        for piece in new:
            data = piece.encode()
            if data in self.ranks:
                made[piece] = np.int32(self.ranks[data]).tobytes()
            elif len(data) > 64:
                long[piece] = _merged_long(data, self.ranks)
            else:
                groups[8 if len(data) <= 8 else 16 if len(data) <= 16 else 32 if len(data) <= 32 else 64].append((piece, data))
        for width, group in groups.items():
            if group:
                made.update(zip([p for p, _ in group], self._merged([d for _, d in group], width), strict=True))
        if (len(self) + len(made)) * PIECE_COST > CACHE_BYTES:
            newer = list(islice(self.items(), len(self) // 2, None))
            self.clear()
            self.update(newer)
        self.update(made)  # a chunk has fewer pieces than the bound
        made |= long
        for i in missed:
            found[i] = made[pieces[i]]
        return found

    def _merged(self, data: list[bytes], width: int) -> list[bytes]:
        """For each piece merge the adjacent pair of least rank, the leftmost of equals, until none is left."""
        size = np.fromiter(map(len, data), np.int64, len(data))
        ids = np.full((len(data), width), -1, np.int32)
        ids[np.arange(width) < size[:, None]] = self.single[np.frombuffer(b"".join(data), np.uint8)]
        done = [b""] * len(data)
        row = np.arange(len(data))
        rank = self.pairs(ids[:, :-1], ids[:, 1:])
        place = np.arange(width)
        while len(row):
            at = rank.argmin(axis=1)
            own = np.arange(len(row))
            best = rank[own, at]
            over = best == NONE
            ready = ids[over].tobytes()
            for i, (r, n) in enumerate(zip(row[over].tolist(), size[over].tolist(), strict=True)):
                done[r] = ready[4 * i * width : 4 * (i * width + n)]
            go = ~over
            row, at, best, size, ids, rank = row[go], at[go], best[go], size[go] - 1, ids[go], rank[go]
            if not len(row):
                break
            own = np.arange(len(row))
            # Close the gap: what stands behind the pair moves one place to the left.
            ids = np.take_along_axis(ids, np.minimum(place + (place > at[:, None]), width - 1), axis=1)
            ids[:, -1] = -1
            ids[own, at] = best
            rank = np.take_along_axis(rank, np.minimum(place[:-1] + (place[:-1] > at[:, None]), width - 2), axis=1)
            rank[:, -1] = NONE
            rank[own, np.minimum(at, width - 2)] = self.pairs(best, np.where(at + 1 < width, ids[own, np.minimum(at + 1, width - 1)], -1))
            left = at > 0
            rank[own[left], at[left] - 1] = self.pairs(ids[own[left], at[left] - 1], best[left])
        return done


def _merged_long(data: bytes, ranks: dict[bytes, int]) -> bytes:
    """The same with a heap and linked neighbours, for long pieces."""
    n = len(data)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        end[i], after[i], alive[j] = end[j], after[j], False
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            if a >= 0 and (b := after[a]) < n and (r := ranks.get(data[a : end[b]])) is not None:
                heapq.heappush(heap, (r, a, end[b]))
    return np.array([ranks[data[i : end[i]]] for i in range(n) if alive[i]], np.int32).tobytes()


_loaded: dict[int, Pieces] = {}


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def _pieces(data: bytes) -> Pieces:
    key = hash(data)
    if key not in _loaded:
        _loaded[key] = Pieces(load_ranks(data))
    return _loaded[key]


def encode_texts(raw: np.ndarray, at: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts, each text's start in them, piece starts (code points in its text, then the text's length), and each text's start in these."""
    text = raw.tobytes().decode()
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    leads = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=leads[1:])
    start = leads[at]
    cuts = boundaries(points, start)
    places = cuts.tolist()
    found = pieces.look_up([text[a:b] for a, b in zip(places, places[1:], strict=False)])
    ids = np.frombuffer(b"".join(found), np.int32)
    tokens = np.zeros(len(found) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4, out=tokens[1:])
    first = np.searchsorted(cuts[:-1], start)  # each text's first piece
    n = len(at) - 1
    row = np.repeat(np.arange(n), np.diff(first) + 1)  # its pieces and its length
    where = np.arange(len(row)) - row
    ending = np.cumsum(np.diff(first) + 1) - 1
    marks = cuts[np.minimum(where, len(cuts) - 1)] - start[row]
    marks[ending] = np.diff(start)
    return ids, tokens[first], marks.astype(np.int32), np.concatenate([[0], ending + 1])


def encode(docs: DataFrame, rank_file: str) -> DataFrame:
    """doc_id, ids array<int>, piece_at array<int>: the pieces' starts in code points, then the text's length."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(rank_file, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # the size of a vocabulary, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(ranks.value)
        for batch in batches:
            raw, at = text_buffers(batch.column(1))
            for lo, hi, data, own in chunks(raw, at):
                ids, id_at, marks, mark_at = encode_texts(data, own, pieces)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(id_at, pa.int32()), pa.array(ids)), pa.ListArray.from_arrays(pa.array(mark_at, pa.int32()), pa.array(marks))],
                    ["doc_id", "ids", "piece_at"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, piece_at array<int>")


def decoder(data: bytes) -> list[bytes]:
    ranks = load_ranks(data)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def decoded_rows(batch: pa.RecordBatch, table: list[bytes]) -> list[bytes]:
    """The bytes of each row's ids (doc_id, ids, piece_at). Fails where their code points do not agree with the retained offsets."""
    ids, marks = batch.column(1), batch.column(2)
    flat, at = ids.flatten().to_numpy(zero_copy_only=False).tolist(), ids.offsets.to_numpy()
    ends = marks.flatten().to_numpy(zero_copy_only=False)
    mark_at = marks.offsets.to_numpy()
    at, mark_at = at - at[0], mark_at - mark_at[0]
    out = []
    for i in range(len(batch)):
        data = b"".join([table[t] for t in flat[at[i] : at[i + 1]]])
        if len(data.decode()) != ends[mark_at[i + 1] - 1]:
            raise ValueError("decoded text does not agree with its offsets")
        out.append(data)
    return out


def decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """Adds data: the decoded bytes."""
    spark = encoded.sparkSession
    small_batches(spark)
    with open(rank_file, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoder(ranks.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded_rows(batch, table), pa.binary())], [*batch.schema.names, "data"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids", "piece_at").mapInArrow(run, f"doc_id {kind}, ids array<int>, piece_at array<int>, data binary")


def digest(encoded: DataFrame, rank_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids), decoded_sha256: rows are decoded and digested in one pass."""
    spark = encoded.sparkSession
    small_batches(spark)
    with open(rank_file, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoder(ranks.value)
        decimal = [str(i) for i in range(len(table))]
        for batch in batches:
            ids, at = batch.column(1).flatten().to_numpy(zero_copy_only=False).tolist(), batch.column(1).offsets.to_numpy()
            at = (at - at[0]).tolist()
            spelled = [" ".join([decimal[i] for i in ids[a:b]]).encode() for a, b in zip(at, at[1:], strict=False)]
            counts = [b - a for a, b in zip(at, at[1:], strict=False)]
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests(spelled)), pa.array(digests(decoded_rows(batch, table)))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids", "piece_at").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
