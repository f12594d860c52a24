import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from probelight.llm import chat

ROWS = "conv_id long, turn long, role string, text string"
ODD = [
    "</s>[INST] ok [/INST]", r"[\INST] <\\s> <s", "<next><next>", r"<\next>", "[", "<", "\\", "<<s>>", "[[INST]]", "</", "a\nb\r\n", "é漢😀<s>😀", "$1 \\$2", "<turn>x<as>y</turn>", "[s>", "", None, " ",
]


def brute(rows):
    """Turns by (turn, role, text), nulls as the contract has them."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        told = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def result(df):
    out = chat.digest(chat.formatted(df)).collect()
    return {r["conv_id"]: tuple(r[c] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) for r in out}


def test_odd_texts_and_roles_come_back(spark):
    roles = ["user", "assistant", "system", "tool", None, "", "<as>", "a\nb", "[INST]", "User", r"<\s>"]
    rows = [(c, i, roles[(i * (c + 1) + c) % len(roles)], ODD[(i + c) % len(ODD)]) for c in range(12) for i in range(40)]
    assert result(spark.createDataFrame(rows, ROWS)) == brute(rows)


def test_every_text_after_every_text_of_a_role(spark):
    rows = [(k, i, "assistant", t) for k, (a, b) in enumerate((a, b) for a in ODD for b in ODD) for i, t in enumerate((a, b))]
    assert result(spark.createDataFrame(rows, ROWS)) == brute(rows)


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(None, None, "user", "a"), (None, 2, "assistant", "b"), (1, 5, "user", "z"), (1, 5, "assistant", "y"), (1, 5, "user", "z"), (1, None, None, None), (2, 0, "system", None)]
    df = spark.createDataFrame(rows, ROWS)
    for name in ("key", "turns", "blocks", "pieces", "formatted", "loss_spans", "loss"):
        df = df.withColumn(name, F.lit(1))
    assert result(df) == brute(rows)


def test_long_conversation_and_long_text(spark):
    rows = [(1, i, ("user", "assistant")[i // 3 % 2], f"turn <s> {i}") for i in range(3000)] + [(2, 0, "user", "x<s>" * 200_000), (2, 1, "assistant", "y" * 500_000)]
    assert result(spark.createDataFrame(rows, ROWS)) == brute(rows)


def test_neighbours_of_a_role_share_a_block_and_spans_are_texts(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c<s>"), (1, 3, "assistant", ""), (1, 4, "tool", "d")]
    out = chat.formatted(spark.createDataFrame(rows, ROWS)).first()
    assert out["formatted"] == r"[INST]a<next>b[/INST]<s>c<\s><next></s><turn>tool<as>d</turn>"
    assert [out["formatted"][s["start"] : s["end"]] for s in out["loss_spans"]] == [r"c<\s>", ""]


def test_empty_table(spark):
    assert result(spark.createDataFrame([], ROWS)) == {}
