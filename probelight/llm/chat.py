"""Chat formatting with Spark expressions only: sorted turns, adjacent turns of a role merged, one string a conversation.

The turns of a conversation are collected (by partial aggregation, so a hot conversation arrives as few rows), sorted by
turn, role and text, and merged: neighbours of one role become one block that holds their texts. A block is opened and
closed by control strings; texts within it are parted by another. Texts and unknown roles are escaped: whatever looks
like a control string, with any number of backslashes after its bracket, gets one backslash more. So an escaped text
holds no control string, a text can be had back exactly, and `parsed` gives all turns again from the string alone. The
loss mask is a list of spans of the string (code points, end exclusive), one for each text of a trained role.

A conversation is one row of the result, which Spark bounds at 2 GB; all work on it is linear in its length, but for
running sums and cuts, which go by blocks of about the root of its turns.

Cases: a null text or role is an empty one; null turns come first; a null key is a conversation of its own; turns of
equal number go by role, then text, and repeated rows are all kept; an empty table gives an empty table; other columns
of the input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pii import _let, _running


@dataclass(frozen=True)
class Template:
    """Control names: a block of a named role is <name>...</name> or [NAME]...[/NAME]; other roles are told within the block."""

    roles: tuple[tuple[str, str, str], ...] = (("system", "<SYS>", "</SYS>"), ("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>"))
    other: tuple[str, str, str] = ("<turn>", "<as>", "</turn>")
    between: str = "<next>"
    trained: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        return [c for _, *marks in self.roles for c in marks] + [*self.other, self.between]

    def _form(self, slashes: str) -> str:
        names = sorted({c.strip("[]<>/") for c in self.controls()})
        return rf"([\[<]){slashes}(/?(?:{'|'.join(names)})[\]>])"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._form(r"(\\*)"), r"$1\\$2$3")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._form(r"\\(\\*)"), "$1$2$3")

    def _by_role(self, role: Column, mark: int, other: Column) -> Column:
        chosen = F
        for name, *marks in self.roles:
            chosen = chosen.when(role == name, marks[mark])
        return chosen.otherwise(other)

    def opening(self, role: Column) -> Column:
        return self._by_role(role, 0, F.concat(F.lit(self.other[0]), self.escape(role), F.lit(self.other[1])))

    def closing(self, role: Column) -> Column:
        return self._by_role(role, 1, F.lit(self.other[2]))


DEFAULT = Template()
quoted = lambda marks: "|".join(m.replace("[", r"\[").replace("]", r"\]") for m in marks)


def merged(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """Per conversation its blocks in order: an array of (role, texts)."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), told(role).alias("role"), told(text).alias("text"))))
    sorted_turns = rows.groupBy(F.col(key).alias("key")).agg(turns.alias("turns"))

    def blocks(t: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: (i == 1) | (F.element_at(t, i)["role"] != F.element_at(t, F.greatest(i - 1, F.lit(1)))["role"]))
        texts = lambda b: lambda at, k: F.transform(F.slice(t, at, F.coalesce(F.get(b, k + 1), F.size(t) + 1) - at), lambda x: x["text"])
        block = lambda b: lambda at, k: F.struct(F.element_at(t, at)["role"].alias("role"), texts(b)(at, k).alias("texts"))
        return _let(begins, lambda b: F.transform(b, block(b)))

    return sorted_turns.select("key", _let(F.col("turns"), blocks).alias("blocks"))


def formatted(
    rows: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    template: Template = DEFAULT,
) -> DataFrame:
    """Per conversation: its key, `formatted`, and `loss_spans` (start, end) of the trained texts in it."""
    piece = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
    plain = lambda x: F.array(piece(x, F.lit(False)))

    def pieces(block: Column) -> Column:
        loss = block["role"].isin(*template.trained)
        texts = F.transform(block["texts"], lambda x, k: F.concat(F.when(k > 0, plain(F.lit(template.between))).otherwise(F.slice(plain(F.lit("")), 1, 0)), F.array(piece(template.escape(x), loss))))
        return F.concat(plain(template.opening(block["role"])), F.flatten(texts), plain(template.closing(block["role"])))

    cut = merged(rows, key, turn, role, text).select("key", F.flatten(F.transform("blocks", pieces)).alias("pieces"))
    starts = _running(F.transform("pieces", lambda p: F.length(p["text"])), lambda at, n: at, lambda at, n: at + n, "int")["out"]
    span = lambda p, at: F.struct(at.alias("start"), (at + F.length(p["text"])).alias("end"), p["loss"].alias("loss"))
    spans = F.transform(F.filter(F.zip_with("pieces", starts, span), lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    whole = F.array_join(F.transform("pieces", lambda p: p["text"]), "")
    return cut.select(F.col("key").alias(key), whole.alias("formatted"), spans.alias("loss_spans"))


def parsed(text: Column, template: Template = DEFAULT) -> Column:
    """The turns of a formatted conversation: an array of (role, text), one for each turn that went in."""
    opens = quoted([marks[1] for marks in template.roles] + [template.other[0]])
    closes = quoted([marks[2] for marks in template.roles] + [template.other[2]])
    head, tail = F.regexp_extract, lambda b: F.length(F.regexp_extract(b, f"(?:{closes})$", 0))
    named = lambda b: head(b, rf"(?s)^(?:{opens})(.*?){quoted([template.other[1]])}", 1)

    def turns(block: Column) -> Column:
        role, skip = template.unescape(named(block)), F.length(F.lit(template.other[0] + template.other[1])) + F.length(named(block))
        for name, begin, _ in template.roles:
            role = F.when(block.startswith(begin), name).otherwise(role)
            skip = F.when(block.startswith(begin), len(begin)).otherwise(skip)
        inner = F.substring(block, skip + 1, F.length(block) - skip - tail(block))
        return F.transform(F.split(inner, quoted([template.between]), -1), lambda x: F.struct(role.alias("role"), template.unescape(x).alias("text")))

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(rf"(?s)(?:{opens}).*?(?:{closes})"), 0), turns))


def under_loss(text: Column, spans: Column, template: Template = DEFAULT) -> Column:
    """The texts under the loss mask, in order, as an array. Cuts are made in two steps, so positions are not counted from the start each time."""

    def cut(v: Column) -> Column:
        many, block = v["spans"], v["block"]

        def group(k: Column) -> Column:
            some = F.slice(many, k * block + 1, block)
            first = F.element_at(some, 1)["start"]
            part = F.substring(v["text"], first + 1, F.element_at(some, -1)["end"] - first)
            whole = F.struct(part.alias("part"), some.alias("some"), first.alias("first"))
            return _let(whole, lambda w: F.transform(w["some"], lambda s: template.unescape(F.substring(w["part"], s["start"] - w["first"] + 1, s["end"] - s["start"]))))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.ceil(F.size(many) / block).cast("int") - 1), group))

    block = F.ceil(F.sqrt(F.size(spans))).cast("int")
    named = F.struct(text.alias("text"), spans.alias("spans"), block.alias("block"))
    return F.when(F.size(spans) > 0, _let(named, cut)).otherwise(F.array().cast("array<string>"))


def digest(out: DataFrame, key: str = "conv_id", template: Template = DEFAULT) -> DataFrame:
    """What `formatted` gave, read back: turns and their digest, the text under the mask and its digest, lengths."""
    read = out.select(key, "formatted", parsed(F.col("formatted"), template).alias("turns"), F.array_join(under_loss(F.col("formatted"), F.col("loss_spans"), template), "").alias("loss"))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        key, F.size("turns").cast("long").alias("n_turns"), sha(joined).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
