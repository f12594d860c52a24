"""Writers: logs, tables, reports, manifests and shards. All go through Spark's committers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import missing


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_missing(rows: DataFrame, path: str, keys: list[str], schema: str) -> int:
    """Append the rows whose key the log does not have yet, failures included; how many those were."""
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    new = missing(rows, spark.read.schema(schema).json(path), keys) if known else rows
    new = new.persist()
    n = new.count()
    new.write.mode("append").json(path)
    new.unpersist()
    return n


def append_result(results: DataFrame, path: str) -> None:
    """The rows of a finished test, added at once, so that what ran before a fault is kept; its columns: id, status, numbers."""
    results.select("id", "status", F.to_json(F.struct(*[c for c in results.columns if c not in ("id", "status")])).alias("numbers")).write.mode("append").parquet(path)


def inspection(df: DataFrame, order: str, most: int = 20, chars: int = 80) -> str:
    """The first rows by a column as text for the console, values cut."""
    rows = df.orderBy(order).limit(most).collect()  # a look, not a result
    cut = lambda v: str(v) if len(str(v)) <= chars else str(v)[: chars - 3] + "..."
    return "\n".join(" | ".join(f"{c}={cut(r[c])}" for c in df.columns) for r in rows)


def write_csv(df: DataFrame, path: str) -> None:
    """Flags as 0 and 1, a header, one format on every machine."""
    flags = {c: F.col(c).cast("int") for c, kind in df.dtypes if kind == "boolean"}
    df.withColumns(flags).write.mode("overwrite").option("header", True).csv(path)


def metrics_json(df: DataFrame, name: str) -> DataFrame:
    """One nested JSON text for each row."""
    return df.select(F.to_json(F.struct("*")).alias(name))


def split_write(df: DataFrame, good: Column, kept: str, quarantined: str) -> None:
    """One input, one predicate, two outputs; null goes to quarantine."""
    flagged = df.withColumn("_good", F.coalesce(good, F.lit(False)))
    flagged.where("_good").drop("_good").write.mode("overwrite").json(kept)
    flagged.where("not _good").drop("_good").write.mode("overwrite").json(quarantined)


def write_manifest(digests: DataFrame, path: str) -> None:
    """path and sha lines; an existing manifest is never overwritten."""
    digests.select("path", "sha").write.mode("errorifexists").json(path)


def write_shards(df: DataFrame, shard: str, path: str) -> None:
    df.write.mode("overwrite").partitionBy(shard).parquet(path)


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A report's table of an aggregated DataFrame of at most `most` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("a report table is for aggregated results")
    show = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows])


def markdown_report(title: str, sections: list[tuple[str, DataFrame]]) -> str:
    """A report: a table under each heading."""
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{markdown_table(df)}" for name, df in sections)]) + "\n"
