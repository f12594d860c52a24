"""Guards before an analysis: which splits a stage may see, whether rows are as they were, whether a stage may run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def open_splits(df: DataFrame, stage: str) -> DataFrame:
    """The rows that a stage may see: exploring leaves the test split closed."""
    if stage not in ("explore", "confirm"):
        raise ValueError(f"unknown stage: {stage}")
    return df.where("split <> 'test'") if stage == "explore" else df


def rows_digest(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Per group a digest of its rows that does not depend on their order: their number and the sums of their hashes."""
    parts = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]).cast("binary"))
    half = lambda at: F.sum(F.conv(F.substring(parts, at, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.groupBy(*by).agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), half(1), half(13)).alias("digest"))


def stage_state(registered: Column, selected: Column, unchanged: Column) -> Column:
    """Why a confirming run may not start, or that it is open."""
    return F.when(~F.coalesce(registered, F.lit(False)), "no registration").when(~F.coalesce(selected, F.lit(False)), "no saved selection").when(~F.coalesce(unchanged, F.lit(False)), "rows changed").otherwise("open")


def require_open(states: DataFrame, state: str) -> None:
    """Stop at the first group that is not open."""
    shut = states.where(F.col(state) != "open").limit(1).collect()
    if shut:
        raise ValueError(f"stage is closed: {shut[0].asDict()}")
