"""The run log as a stream (an extension): repetitions arrive, late and repeated ones included."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_log(spark: SparkSession, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_sightings(log: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each key once within the watermark; state is dropped when it passes."""
    return log.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def label_counts(log: DataFrame, time: str, window: str, *by: str) -> DataFrame:
    """Counts per window and group, final once the watermark passes the window."""
    return log.groupBy(F.window(time, window).alias("window"), *by).agg(F.count(F.lit(1)).alias("n"))


def write_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append final windows; the checkpoint makes a restart go on where the log stood."""
    return counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
