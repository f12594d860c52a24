import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from probelight.llm import repair

ROWS = "conv_id long, turn long, role string, text string"
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def cheapest(rows):
    """All edits of a short conversation, tried one by one: the least (cost, audit) and its lines. rows: (role, text, fault)."""

    @lru_cache(maxsize=None)
    def best(i, shape, inserts):
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", shape):
            return 0, "", ()
        edits = [(3, "I", (r, ""), i) for r in ("user", "assistant")] if inserts < 2 else []  # three in a row never pay
        if i < len(rows):
            role, text, fault = rows[i]
            extra = 3 if fault == "truncated" else 0
            edits.append((4, "D", None, i + 1))
            if fault not in ("blank", "duplicate"):
                edits.append((extra, "K", (role, text), i + 1))
                edits += [(3 + extra, "R", (r, text), i + 1) for r in ("user", "assistant")]
        options = []
        for cost, letter, line, after in edits:
            longer = shape + ((line[0][:1] or "?") if line else "")
            if re.fullmatch("s?(ua)*u?", longer):  # may still become a legal string, and only its end matters from here on
                rest = best(after, re.sub("^s?(ua)+", "ua", longer), inserts + 1 if letter == "I" else 0)
                if rest:
                    options.append((cost + rest[0], letter + rest[1], ((line,) if line else ()) + rest[2]))
        return min(options, key=lambda o: o[:2]) if options else None

    return best(0, "", 0)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        told = lambda x: " " if x is None else x
        role, text = told(role), told(text)
        k = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        out += [(conv, turn, role, text)] * (2 if k == 3 else 1)
    return out


def brute(rows, keys):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    out = {}
    for key in keys:
        mine = sorted(convs[key], key=lambda r: (r[0], r[1], r[2], hashlib.md5(r[3].encode()).hexdigest()))
        seen, told, turns = set(), [], sorted({t for real, t, _, _ in mine if real})
        for _, _, role, text in mine:
            inner = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else ""
            seen.add((role, text))
            told.append((role, text, fault))
        count = lambda f: sum(x[2] == f for x in told)  # noqa: B023, E731
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        cost, audit, lines = cheapest(tuple(told))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
        out[key] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, sha)
    return out


def result(parts):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.audited(parts, "conv_id").collect()}


def made(seed, convs, most):
    pick = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "u", "Assistant"], ["a.", "b!", "c", " ", "", None, "d?", "e. \n", "é", "f.x"]
    return [(c, None if pick.random() < 0.05 else t * pick.choice((1, 1, 2)), pick.choice(roles), pick.choice(texts)) for c in range(convs) for t in range(pick.randint(1, most))]


@pytest.mark.parametrize("most_rows", [1, 2, 4096])
def test_cheapest_edits_against_all_edits(spark, most_rows):
    rows = made(most_rows, 150, 7)
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    assert result(repair.fragments(df, most_rows=most_rows)) == brute(rows, {r[0] for r in rows})


def test_damage(spark):
    rows = made(9, 200, 5)
    df = spark.createDataFrame(rows, ROWS)
    hurt = repair.damaged(df)
    assert sorted(((r[0], r[1], r[2], r[3]) for r in hurt.collect() for _ in range(r["copies"])), key=repr) == sorted(damage(rows), key=repr)
    assert result(repair.fragments(hurt, copies=F.col("copies"))) == brute(damage(rows), {r[0] for r in rows})


def test_long_conversation_in_parts_equals_one_part(spark):
    rows = [(1, i, ("user", "assistant", "system")[i % 7 % 3], f"text {i % 900}" + "." * (i % 5 > 1)) for i in range(6000)] + [(None, None, "user", "same.")] * 3000
    df = spark.createDataFrame(rows, ROWS)
    whole, cut = (repair.fragments(df, most_rows=n, most_chars=1 << 30) for n in (10_000, 7))
    assert result(whole) == result(cut)
    gaps, _, duplicates, *_, audit, _ = result(whole)[None]
    assert (gaps, duplicates) == (0, 2999) and audit.replace("D", "") == "KI" and len(audit) == 3001


def test_run_powers_equal_single_steps():
    runs = [(2, 5), (0, 3), (4, 9), (1, 1), (7, 6)]
    singles = [(s, 1) for s, n in runs for _ in range(n)]
    assert repair.product(runs) == repair.product(singles)
    assert repair.unrolled(runs, 0, repair.END) == repair.unrolled(singles, 0, repair.END)


def test_repaired_turns_give_the_digest(spark):
    rows = made(5, 40, 7)
    parts = repair.fragments(spark.createDataFrame(rows, ROWS), most_rows=2)
    lines = defaultdict(list)
    for r in repair.repaired(parts, "conv_id").orderBy("conv_id", "place").collect():
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert all(hashlib.sha256("\n".join(lines[k]).encode()).hexdigest() == v[7] for k, v in result(parts).items())


def test_empty_table_clashing_columns_and_dropped_rows(spark):
    none = spark.createDataFrame([], ROWS)
    assert result(repair.fragments(none)) == {}
    df = spark.createDataFrame([(1, 0, "user", "a."), (1, 1, "assistant", "b.")], ROWS)
    for name in ("key", "n", "mark", "seq", "digest", "copies"):
        df = df.withColumn(name, F.lit("own"))
    assert result(repair.fragments(df))[1][5:7] == (0, "KK")
    gone = result(repair.fragments(df, copies=F.lit(0)))
    assert gone == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
