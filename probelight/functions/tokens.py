"""Patterns of tokens in arrays of tokens, by the failure function of the pattern."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _advanced(pattern: Column, failure: Column, matched: Column, token: Column) -> Column:
    """How many tokens of the pattern are matched after one token more; a whole match goes on from its longest border."""
    size = F.size(pattern)
    stuck = lambda k: (k > 0) & ((k == size) | (F.get(pattern, k) != token))
    held = F.aggregate(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), matched, lambda k, _: F.when(stuck(k), F.get(failure, k - 1)).otherwise(k))
    return held + F.when((held < size) & (F.get(pattern, held) == token), 1).otherwise(0)


def failure_function(pattern: Column) -> Column:
    """For each beginning of the pattern the length of its longest border."""
    first = F.struct(F.slice(F.array(F.lit(0)), 1, F.least(F.size(pattern), F.lit(1))).alias("f"), F.lit(0).alias("k"))

    def step(s: Column, token: Column) -> Column:
        k = _advanced(pattern, s["f"], s["k"], token)
        return F.struct(F.concat(s["f"], F.array(k)).alias("f"), k.alias("k"))

    return F.aggregate(F.slice(pattern, 2, F.greatest(F.size(pattern) - 1, F.lit(0))), first, step, lambda s: s["f"])


def last_occurrence(tokens: Column, pattern: Column, failure: Column) -> Column:
    """The place, from 1, of the last occurrence of the pattern in the tokens; -1 for none, null for an empty pattern.

    One pass over the tokens that never goes back. `failure` is failure_function(pattern), a column of its own.
    """
    first = F.struct(F.lit(0).alias("k"), F.lit(0).alias("i"), F.lit(-1).alias("last"))

    def step(s: Column, token: Column) -> Column:
        k, i = _advanced(pattern, failure, s["k"], token), s["i"] + 1
        return F.struct(k.alias("k"), i.alias("i"), F.when(k == F.size(pattern), i - F.size(pattern) + 1).otherwise(s["last"]).alias("last"))

    return F.when(F.size(pattern) > 0, F.aggregate(tokens, first, step, lambda s: s["last"]))
