"""Streaming ingest of JSONL folders: validation, exact de-duplication within a watermark, counts per window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).json(path)


def read_table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A folder of Parquet files as a stream; the schema is the folder's."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def valid_once(stream: DataFrame, at: str, lateness: str = "10 minutes") -> DataFrame:
    """Valid pairs, the first of equal text within the watermark; state is dropped as the watermark passes."""
    rows = stream.where(~T.is_blank(F.col("question")) & ~T.is_blank(F.col("answer")))
    return rows.withColumn("hash", T.content_hash(F.col("question"), F.col("answer"))).withWatermark(at, lateness).dropDuplicatesWithinWatermark(["hash"])


def windowed_counts(stream: DataFrame, at: str, by: str, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(at, lateness).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"))


def run_once(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there and stops."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(sink).awaitTermination()
