"""Conversation structure repair: the cheapest edits that make each conversation alternate, by run-length dynamic programming.

A row has a symbol: the kind of its role and whether it must go or is truncated. The role initials that may come out,
`(s?(ua)+)?`, are an automaton of four states, and a symbol is a 4 x 4 matrix of costs from state to state, inserts
before the row included. A run of equal symbols is a power of its matrix, made from cached squares; the cost still to
come is carried backwards over the runs, and then the least letter that keeps the least cost is taken step by step,
halving each run down to single rows, with halves that were met before taken from a cache.

No task holds a conversation. Equal rows are counted before the shuffle. All rows are then sorted by range over all
tasks (conversation, turn, role, digest of the text), with a mark before the first row of each role and text, and each
task cuts its stretch into fragments of a bounded size: texts, runs, the product of the runs' matrices, counts. Only
these matrices go in a second pass backwards along each conversation, to give each fragment the costs that come after
it; a third pass goes forwards over fragments, one at a time, and writes the audit and the digest of the repaired text
as a stream, so that a conversation of any length needs the memory of a fragment and of its own audit.

Cases: null keys are one conversation; null turns come first; a null role or text is one space (which makes the row
blank, or its role of no known kind); rows of equal turn go by role, then by the MD5 of the text; an empty role has no
initial and is of no known kind; repeated rows are duplicates; an empty table gives an empty table, a conversation
without rows after damage an empty repair; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_rows, materialize

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NEVER = 1 << 50
# States: nothing yet; after s; after u; after a. What a user or assistant turn does to each.
SPEAKS = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
STATES = range(4)
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
# A fragment ends at this many different rows, or at the row that reaches this many characters.
FRAGMENT_ROWS, FRAGMENT_CHARS = 4096, 1 << 20
# Halves of runs up to 2 ** this rows have their choices cached.
CACHED_POWER = 12

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


def symbol(role: str, fault: str) -> int:
    """0 for rows that must go; else by the kind of role (s, u, a, other) and whether the row is truncated."""
    if fault in ("blank", "duplicate"):
        return 0
    return 1 + 2 * "sua".find(role[:1] or "?") % 8 + (fault == "truncated")


def after(sym: int, state: int, letter: str) -> tuple[int, int] | None:
    """State and cost after one edit, or None where it is not allowed. An insert takes no row."""
    if letter == "D":
        return state, DELETE
    if letter == "I":
        return SPEAKS[state][0], INSERT
    if sym == 0:
        return None
    kind, extra = (sym - 1) // 2, TRUNCATED * ((sym - 1) % 2)
    to, who = SPEAKS[state]
    if letter == "R":
        return to, REROLE + extra
    if kind == 0:
        return (1, extra) if state == 0 else None
    return (to, extra) if kind < 3 and who[0] == "sua"[kind] else None


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(NEVER, *(x + y for x, y in zip(row, col, strict=True))) for col in zip(*b, strict=True)) for row in a)


def before(m: Matrix, h: Vector) -> Vector:
    return tuple(min(NEVER, *(x + y for x, y in zip(row, h, strict=True))) for row in m)


NOTHING: Matrix = tuple(tuple(0 if p == q else NEVER for q in STATES) for p in STATES)


def _inserts() -> Matrix:
    one = tuple(tuple(0 if p == q else INSERT if SPEAKS[p][0] == q else NEVER for q in STATES) for p in STATES)
    return times(one, one)


END: Vector = before(_inserts(), (0, NEVER, NEVER, 0))


@lru_cache(maxsize=None)  # nine symbols by the bits of a length
def power(sym: int, k: int) -> Matrix:
    """The matrix of 2 ** k rows of one symbol."""
    if k:
        return times(power(sym, k - 1), power(sym, k - 1))
    edits = [[after(sym, p, letter) for letter in "DKR"] for p in STATES]
    row = tuple(tuple(min([NEVER, *(e[1] for e in edits[p] if e and e[0] == q)]) for q in STATES) for p in STATES)
    return times(_inserts(), row)


def run_blocks(length: int) -> list[int]:
    return [k for k in range(length.bit_length()) if length >> k & 1]


def product(runs: list[tuple[int, int]]) -> Matrix:
    total = NOTHING
    for sym, length in runs:
        for k in run_blocks(length):
            total = times(total, power(sym, k))
    return total


def _step(sym: int, state: int, h: Vector) -> tuple[str, int]:
    """The edits of one row, inserts before it included, when h is the cost still to come after it."""
    now, letters = before(power(sym, 0), h), ""
    while True:
        for letter in "DIKR":
            edit = after(sym, state, letter)
            if edit and edit[1] + (now if letter == "I" else h)[edit[0]] == now[state]:
                letters, state = letters + letter, edit[0]
                break
        if letter != "I":
            return letters, state


def _choose(sym: int, k: int, state: int, h: Vector) -> tuple[str, int]:
    if k == 0:
        return _step(sym, state, h)
    left, middle = choices(sym, k - 1, state, before(power(sym, k - 1), h))
    right, last = choices(sym, k - 1, middle, h)
    return left + right, last


_cached = lru_cache(maxsize=1 << 12)(_choose)


def choices(sym: int, k: int, state: int, h: Vector) -> tuple[str, int]:
    """The edits of 2 ** k rows of one symbol from a state, and the state they end in. Only differences in h matter."""
    least = min(h)
    h = tuple(min(NEVER, x - least) for x in h)
    return _cached(sym, k, state, h) if k <= CACHED_POWER else _choose(sym, k, state, h)


def unrolled(runs: list[tuple[int, int]], state: int, tail: Vector) -> tuple[str, int]:
    """The edits of a fragment from a state, when tail is the cost still to come after it; the state they end in."""
    blocks = [(sym, k) for sym, length in runs for k in run_blocks(length)]
    tails = [tail]
    for sym, k in reversed(blocks):
        tails.append(before(power(sym, k), tails[-1]))
    letters = []
    for (sym, k), h in zip(blocks, tails[-2::-1], strict=True):
        some, state = choices(sym, k, state, h)
        letters.append(some)
    return "".join(letters), state


def closing(state: int) -> str:
    """The inserts that end a conversation."""
    letters = ""
    while END[state]:
        letters, state = letters + "I", SPEAKS[state][0]
    return letters


@dataclass
class Fragment:
    """Neighbouring rows of one conversation, as they are gathered."""

    key: object
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    copies: list[int] = field(default_factory=list)
    runs: list[list[int]] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0))
    low: int | None = None
    high: int | None = None
    chars: int = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, first: bool) -> None:
        if self.roles:
            self.counts["illegal"] += self.roles[-1][:1] + role[:1] not in ("su", "ua", "au")
        self.counts["illegal"] += copies - 1  # an initial after itself
        if turn is not None:
            self.counts["turns"] += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        end = text.strip(SPACE)[-1:]
        fault = "blank" if not end else "duplicate" if not first else "truncated" if end not in ".!?" else ""
        again = "blank" if fault == "blank" else "duplicate"
        for f, n in ((fault, 1), (again, copies - 1)):
            if f:
                self.counts[f] += n
            self._run(symbol(role, f), n)
        self.roles.append(role)
        self.texts.append(text)
        self.copies.append(copies)
        self.chars += len(text)

    def _run(self, sym: int, n: int) -> None:
        if self.runs and self.runs[-1][0] == sym:
            self.runs[-1][1] += n
        elif n:
            self.runs.append([sym, n])

    def row(self, seq: int) -> dict:
        matrix = [x for line in product([(s, n) for s, n in self.runs]) for x in line]
        return {
            "key": self.key, "seq": seq, "roles": self.roles, "texts": self.texts, "copies": self.copies, "runs": [x for r in self.runs for x in r],
            "matrix": matrix, "low": self.low, "high": self.high, **self.counts,
        }


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
_FIELDS = [
    ("seq", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("copies", pa.list_(pa.int64())), ("runs", pa.list_(pa.int64())),
    ("matrix", pa.list_(pa.int64())), ("low", pa.int64()), ("high", pa.int64()), *((c, pa.int64()) for c in _COUNTS),
]
_DDL = "seq long, roles array<string>, texts array<string>, copies array<long>, runs array<long>, matrix array<long>, low long, high long, " + ", ".join(f"{c} long" for c in _COUNTS)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)


def _batched(rows: Iterator[dict], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most about a million of what size(row) counts."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total > 1 << 20:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def fragments(
    rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    copies: Column | None = None, most_rows: int = FRAGMENT_ROWS, most_chars: int = FRAGMENT_CHARS,
) -> DataFrame:
    """All rows in order, cut into fragments, written to the shared folder. A row of no copies only tells its key."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = rows.select(F.col(key).alias("key"), F.col(turn).cast("long").alias("turn"), told(role).alias("role"), told(text).alias("text"), (F.lit(1) if copies is None else copies).cast("long").alias("n"))
    counted = plain.groupBy("key", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("digest", F.md5(F.col("text").cast("binary")))
    first = F.when(~F.bool_or(F.col("turn").isNull()), F.min("turn")).alias("turn")
    firsts = counted.where("n > 0").groupBy("key", "role", "digest").agg(first)
    both = counted.withColumn("mark", F.lit(1)).unionByName(firsts.withColumn("mark", F.lit(0)), allowMissingColumns=True)
    ordered = ["key", "turn", "role", "digest"]
    dealt = both.repartitionByRange(*ordered).sortWithinPartitions(*ordered, "mark").select("key", "turn", "role", "digest", "mark", "text", "n")
    kind = rows.schema[key].dataType
    schema = pa.schema([("key", to_arrow_type(kind)), *_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << 40

        def cut() -> Iterator[dict]:
            open_one, marked, k = None, None, 0
            for own, turn, role, digest, mark, text, n in _rows(batches):
                if open_one is None or open_one.key != own or len(open_one.roles) >= most_rows or open_one.chars >= most_chars:
                    if open_one is not None:
                        yield open_one.row(seq + k)
                        k += 1
                    open_one = Fragment(own)
                if mark == 0:
                    marked = (turn, role, digest)
                elif n:
                    open_one.add(turn, role, text, n, marked == (turn, role, digest))
                    marked = None
            if open_one is not None:
                yield open_one.row(seq + k)

        yield from _batched(cut(), schema, lambda r: 100 + 30 * len(r["roles"]) + sum(map(len, r["texts"])))

    with arrow_rows(rows.sparkSession, 1024):
        return materialize(dealt.mapInArrow(run, f"key {kind.simpleString()}, {_DDL}"), "fragments")


def tails(parts: DataFrame) -> DataFrame:
    """Per fragment the cost still to come after it from each state; a pass backwards along each conversation, over matrices alone."""
    kind = parts.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, h = object(), END
        for batch in batches:
            out = []
            for key, m in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                h = h if key == own else END
                out.append(list(h))
                own, h = key, before(tuple(tuple(m[4 * p : 4 * p + 4]) for p in STATES), h)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["key", "seq", "tail"])

    back = parts.select("key", "seq", "matrix").repartition("key").sortWithinPartitions("key", F.desc("seq"))
    return back.mapInArrow(run, f"key {kind}, seq long, tail array<long>")


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, str, int, bool, bool]]:
    """Each fragment with its edits and the state before them, and whether it is the first and the last of its conversation."""
    state, held, first, tail = 0, None, True, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["mark"] == 0:
                tail = tuple(row["tail"])
                continue
            if held is not None:
                last = held[0]["key"] != row["key"]
                yield (*held, first, last)
                first = last
                state = 0 if last else state
            runs = list(zip(row["runs"][::2], row["runs"][1::2], strict=True))
            letters, to = unrolled(runs, state, tail)
            row["cost"] = before(product(runs), tail)[0]
            held, state = (row, letters, state), to
    if held is not None:
        yield (*held, first, True)


def edited(row: dict, letters: str, state: int, last: bool) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each edit of a fragment in order; a deleted row has its old role and text."""
    copies = ((r, t) for r, t, n in zip(row["roles"], row["texts"], row["copies"], strict=True) for _ in range(n))
    for letter in letters:
        if letter == "I":
            state, role = SPEAKS[state]
            yield letter, role, ""
            continue
        role, text = next(copies)
        if letter == "R":
            state, role = SPEAKS[state]
        elif letter == "K":
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
        yield letter, role, text
    if last:
        for letter in closing(state):
            state, role = SPEAKS[state]
            yield letter, role, ""


def _forwards(parts: DataFrame) -> DataFrame:
    both = parts.drop("matrix").withColumn("mark", F.lit(1)).unionByName(tails(parts).withColumn("mark", F.lit(0)), allowMissingColumns=True)
    return both.repartition("key").sortWithinPartitions("key", "seq", "mark")


def audited(parts: DataFrame, key: str) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, and the digest of the repaired text."""
    kind = parts.schema["key"].dataType
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema([("key", to_arrow_type(kind)), *((n, pa.int64()) for n in names), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            out, audit, sha, low, high, turns, initial = {}, [], None, None, None, 0, None
            for row, letters, state, first, last in _walked(batches):
                if first:
                    out, audit, sha = {"key": row["key"], **dict.fromkeys(names, 0), "cost": row["cost"]}, [], None
                    low = high = initial = None
                    turns = 0
                for n in ("blank", "duplicate", "truncated", "illegal"):
                    out[n] += row[n]
                if row["roles"]:
                    out["illegal"] += initial is not None and initial + row["roles"][0][:1] not in ("su", "ua", "au")
                    initial = row["roles"][-1][:1]
                if row["low"] is not None:
                    turns += row["turns"] - (row["low"] == high)
                    low, high = row["low"] if low is None else low, row["high"]
                for letter, role, text in edited(row, letters, state, last):
                    audit.append(letter)
                    if letter != "D":
                        line = f"{role}:{text}".encode()
                        if sha is None:
                            sha = hashlib.sha256(line)
                        else:
                            sha.update(b"\n" + line)
                audit = ["".join(audit)]
                if last:
                    gaps = high - low + 1 - turns if low is not None else 0
                    yield out | {"gaps": gaps, "audit": audit[0], "repaired_sha256": (sha or hashlib.sha256()).hexdigest()}

        yield from _batched(found(), schema, lambda r: 200 + len(r["audit"]))

    ddl = f"key {kind.simpleString()}, " + ", ".join(f"{n} long" for n in names) + ", audit string, repaired_sha256 string"
    return _forwards(parts).mapInArrow(run, ddl).withColumnRenamed("key", key)


def repaired(parts: DataFrame, key: str) -> DataFrame:
    """The repaired turns: key, place (from 1), edit (K, R or I), role, text."""
    kind = parts.schema["key"].dataType
    schema = pa.schema([("key", to_arrow_type(kind)), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turns() -> Iterator[dict]:
            place = 0
            for row, letters, state, first, last in _walked(batches):
                place = 0 if first else place
                for letter, role, text in edited(row, letters, state, last):
                    if letter != "D":
                        place += 1
                        yield {"key": row["key"], "place": place, "edit": letter, "role": role, "text": text}

        yield from _batched(turns(), schema, lambda r: 50 + len(r["text"]))

    return _forwards(parts).mapInArrow(run, f"key {kind.simpleString()}, place long, edit string, role string, text string").withColumnRenamed("key", key)


def damaged(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with planted faults, by a hash of key and turn: key, turn, role, text and copies (0 for a dropped row)."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(told(key), F.lit(":"), told(turn)).cast("binary")) % 20
    hurt = rows.select(key, turn, told(role).alias(role), told(text).alias(text), fault.alias("_fault"))
    by = F.col("_fault")
    return hurt.select(
        key, turn, F.when(by == 0, "").when(by == 4, "user").otherwise(F.col(role)).alias(role),
        F.when(by.isin(0, 1), "").when(by == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(F.col(text)).alias(text),
        F.when(by == 0, 0).when(by == 3, 2).otherwise(1).alias("copies"),
    )
