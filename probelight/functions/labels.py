"""Labels of responses as column expressions. The two coarse labels and the two history labels differ by design."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the protocol.
TAG_START = "[OPT-OUT-"
VALID_TAGS = ("HARD", "SOFT", "CURIOUS")
TOOL_LABELS = {"publish_page": "publish", "web_search": "search", "read_page": "read", "set_goal": "goal_op", "abandon_goal": "goal_op"}
ACTION_LABELS = {"declined": "decline", "revised_goals": "goal_op", "publish_intent": "publish", "reflected": "reflect"}  # in order of priority
TOOL_CLASSES = ("publish", "search", "read", "goal_op", "optout", "tool_other")
NO_RETRIEVAL = r"(?iu)(non sto recuperando|nessuna memoria|non recupero|retrieval (e'|è) vuoto|not retrieving|no memor(y|ies) (retrieved|available))"


def stripped(text: Column) -> Column:
    """Without white space at either end, any kind of it."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def first_line(text: Column) -> Column:
    """The first line of the stripped text, in lower case; empty for an empty text."""
    return F.lower(F.substring_index(stripped(text), "\n", 1))


def tool_label(tool: Column) -> Column:
    out = F.lit("tool_other")
    for name, label in TOOL_LABELS.items():
        out = F.when(tool == name, label).otherwise(out)
    return out


def keyword(line: Column) -> Column:
    """The first action keyword, by priority, that occurs in the line; null for none."""
    return F.coalesce(*[F.when(line.contains(k), F.lit(k)) for k in ACTION_LABELS])


def keyword_label(line: Column) -> Column:
    return F.coalesce(*[F.when(line.contains(k), F.lit(v)) for k, v in ACTION_LABELS.items()])


def first_tag(text: Column) -> Column:
    """The first valid tag anywhere, empty for none."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"\[OPT-OUT-(HARD|SOFT|CURIOUS)\]", 1)


def action(text: Column) -> Column:
    """The action of a first line that says 'action': a keyword, or action_line_unparsed; else empty."""
    line = first_line(text)
    return F.when(line.contains("action"), F.coalesce(keyword(line), F.lit("action_line_unparsed"))).otherwise("")


def leads_with_tag(text: Column) -> Column:
    return stripped(text).startswith(TAG_START)


def coarse_by_action(kind: Column, tool: Column, text: Column, point_kind: Column | None = None) -> Column:
    """Error, then tool, then a leading tag with a valid flag, then the parsed action, then text.

    With point_kind (the strict mode) an unlabelled genesis response is noncompliant; without it the run's own kind
    decides, as the published numbers have it, and the label does not occur.
    """
    act = action(text)
    rest = F.lit("text") if point_kind is None else F.when(point_kind == "genesis", "noncompliant").otherwise("text")
    return (
        F.when(kind == "error", "error").when(kind == "tool_call", tool_label(tool)).when((first_tag(text) != "") & leads_with_tag(text), "optout")
        .when(act == "publish_intent", "publish").when(act == "revised_goals", "goal_op").when(act == "reflected", "reflect").when(act == "declined", "decline").otherwise(rest)
    )


def coarse_by_keyword(kind: Column, tool: Column, text: Column) -> Column:
    """A leading tag with a valid flag, then tool, then any keyword in the first line, then text."""
    return F.when((first_tag(text) != "") & leads_with_tag(text), "optout").when(kind == "tool_call", tool_label(tool)).otherwise(F.coalesce(keyword_label(first_line(text)), F.lit("text")))


def history_tool_first(tool: Column, flagged: Column, response: Column) -> Column:
    has_tool = F.coalesce(tool, F.lit("")) != ""
    return F.when(has_tool, tool_label(tool)).when(flagged & leads_with_tag(response), "optout").otherwise(F.coalesce(keyword_label(first_line(response)), F.lit("text")))


def history_tag_first(tool: Column, flagged: Column, response: Column) -> Column:
    has_tool = F.coalesce(tool, F.lit("")) != ""
    return F.when(flagged & leads_with_tag(response), "optout").when(has_tool, tool_label(tool)).otherwise(F.coalesce(keyword_label(first_line(response)), F.lit("text")))


def collapsed(label: Column) -> Column:
    return F.when(label.isin(*TOOL_CLASSES), label).otherwise("no_tool")


def use_or_mention(text: Column) -> Column:
    return F.when(leads_with_tag(text), "use").when(first_tag(text) != "", "mention").otherwise("none")


def tags(text: Column, valid: bool) -> Column:
    """All tags that are valid, or all that are not, joined by ';' in order, repeats kept."""
    every = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[OPT-OUT-([A-Z]+)\]"), F.lit(1))
    known = F.array(*map(F.lit, VALID_TAGS))
    return F.array_join(F.filter(every, lambda t: F.array_contains(known, t) if valid else ~F.array_contains(known, t)), ";")


def squeezed(text: Column, most: int) -> Column:
    return F.left(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(most))


def norm_condition(value: Column) -> Column:
    """B, C or none from their spellings; anything else stops the query."""
    low = F.lower(F.trim(value))
    return F.when(low == "b", "B").when(low == "c", "C").when(low.isin("none", "no_memory", "nomem", "prior"), "none").otherwise(F.raise_error(F.concat(F.lit("unknown condition: "), F.coalesce(value, F.lit("null")))).cast("string"))


def first_tool(tool_round: Column) -> Column:
    """The first of four tool names, in this order, that occurs anywhere in a serialised round."""
    return F.coalesce(*[F.when(tool_round.contains(n), F.lit(n)) for n in ("publish_page", "web_search", "set_goal", "abandon_goal")], F.lit(""))


def win_score(lower: Column, upper: Column) -> Column:
    """1 if the upper member wins, 0.5 for a tie, 0 otherwise."""
    return F.when(upper > lower, 1.0).when(upper == lower, 0.5).otherwise(0.0)


def text_of(json: Column, keys: tuple[str, ...]) -> Column:
    """A JSON string itself, or the first of the keys that an object has; empty for neither."""
    parsed = F.try_parse_json(json)
    held = F.coalesce(*[F.get_json_object(json, f"$.{k}") for k in keys], F.lit(""))
    return F.when(F.schema_of_variant(parsed) == "STRING", F.try_variant_get(parsed, "$", "string")).otherwise(held)
