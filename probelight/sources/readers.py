"""Scans of logs, documents and archives. Records carry their order; policies on bad lines differ by caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .archive_source import ArchiveSource


def numbered_lines(spark: SparkSession, path: str, lenient: bool = True) -> DataFrame:
    """file, ord (line number in its file, from 1) and value of every line.

    Files are read in splits, side by side. Rows of a split stand in order in their task, so a line's number is its
    place in the split and the number of lines in the splits before it, which are counted first: a row for each split.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    spans = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = spans.select("file", "block", (before - F.col("first") + 1).alias("shift"))
    lines = rows.join(shifts, ["file", "block"]).select("file", (F.col("at") + F.col("shift")).alias("ord"), "value")
    return lines.where(F.trim("value") != "") if lenient else lines


def jsonl(spark: SparkSession, path: str, schema: str, bad: str = "keep-null") -> DataFrame:
    """Records of JSON lines with file and ord.

    bad: 'keep-null' gives null fields, 'drop' leaves malformed lines out (to resume a log cut short), 'fail' stops at
    the first malformed line and on an empty input, 'strict' also at blank lines and values that are no object.
    """
    lines = numbered_lines(spark, path, lenient=bad != "strict")
    parsed = lines.withColumn("_v", F.try_parse_json("value"))
    kind = F.schema_of_variant("_v")
    good = F.col("_v").isNotNull() & kind.startswith("OBJECT")
    if bad == "drop":
        parsed = parsed.where(good)
    elif bad in ("fail", "strict"):
        if lines.limit(1).count() == 0:
            raise ValueError(f"no records in {path}")
        parsed = parsed.withColumn("value", F.when(good, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("bad record: "), "file", F.lit(":"), F.col("ord").cast("string"))).cast("string")))
    return parsed.withColumn("_r", F.from_json("value", schema)).select("file", "ord", "_r.*")


def ordered_shards(spark: SparkSession, pattern: str, schema: str, by: str = "start") -> DataFrame:
    """The records of all shard files that the pattern names, in the order of a column."""
    return spark.read.schema(schema).json(pattern).orderBy(by)


def last_by_key(df: DataFrame, key: str, order: tuple[str, ...] = ("file", "ord")) -> DataFrame:
    """The last record of each key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def document_json(spark: SparkSession, path: str, schema: str, items: str) -> DataFrame:
    """The elements of an array inside single-document JSON files, with their place."""
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode(items).alias("ord", "_r")).select("ord", "_r.*")


def timeline(spark: SparkSession, path: str) -> DataFrame:
    """A versioned configuration: since, until (of the next entry) and specs as canonical JSON, sorted keys."""
    rows = numbered = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<struct<`from`:string,specs:string>>")).alias("ord", "_r"))
    rows = numbered.select(F.col("_r.from").alias("since"), F.to_json(F.try_parse_json("_r.specs")).alias("specs"))
    return rows.withColumn("until", F.lead("since").over(Window.partitionBy(F.lit(0)).orderBy("since")))  # a few eras


def resolve_alias(df: DataFrame, logical: str, candidates: list[str], required: bool = True) -> DataFrame:
    """The first candidate column the table has, under its logical name."""
    found = next((c for c in candidates if c in df.columns), None)
    if found is None:
        if required:
            raise ValueError(f"no column for {logical} among {candidates}")
        return df.withColumn(logical, F.lit(None))
    return df.withColumnRenamed(found, logical)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole text files, with their digest."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.sha2(F.col("value").cast("binary"), 256).alias("sha"))


def digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and SHA-256 of files, found recursively."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha"))


def find_by_digest(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    return digests(spark, path).where(F.col("sha").startswith(prefix))


def archives(spark: SparkSession, path: str, strict_name: str | None = None) -> DataFrame:
    """item, cond, pos, layer, vec of NumPy archives: a row for each layer of each array. See archive_source.

    The item comes from the file's name; condition and position from the array's key. With strict_name (a pattern of
    two groups, item and condition) other file names stop the query. Filters on item, cond, pos and layer are pushed
    into the reader, for which the session's setting is turned on.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
    reader = spark.read.format("archives")
    return (reader.option("strictname", strict_name) if strict_name else reader).load(path)


def profile(df: DataFrame, column: str) -> DataFrame:
    """key, types, n of JSON objects: every key with the sorted set of its types."""
    each = df.select(F.try_parse_json(column).alias("_v")).lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_v").outer())) if hasattr(df, "lateralJoin") else None
    return each.groupBy("key").agg(F.array_sort(F.collect_set(F.schema_of_variant("value"))).alias("types"), F.count(F.lit(1)).alias("n"))


RECORD = T.StructType([T.StructField("pid", T.StringType()), T.StructField("arm", T.StringType()), T.StructField("rep", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])
