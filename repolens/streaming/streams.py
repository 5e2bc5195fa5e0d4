"""Structured Streaming over folders of files and over event tables.

The line operators are stateless on a file's row, so they run on a stream as they are; counts keep state
under a watermark.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import checkpoint_folder
from ..operators.markers import markers
from ..operators.secrets import findings


def file_stream(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, content) of text files as they appear in a folder."""
    raw = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", glob).load(folder, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def marker_stream(files: DataFrame) -> DataFrame:
    return markers(files)


def finding_stream(files: DataFrame, allow: list[str] | None = None) -> DataFrame:
    return findings(files, allow)


def windowed_counts(events: DataFrame, at: str = "ts", by: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, key, n): events by tumbling window; state older than the watermark goes."""
    window = F.window(F.col(at), width)
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(window, by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def table_stream(spark: SparkSession, folder: str, file: str, schema: str) -> DataFrame:
    """Rows of one table of a folder of Parquet tables, as its files appear."""
    return spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)


def drained(stream: DataFrame, name: str, checkpoint: str | None = None, mode: str = "append") -> DataFrame:
    """Everything that is there now, as a batch DataFrame: one run with availableNow into a memory table.

    State goes to a folder of its own in the session's checkpoint folder unless another is given. The memory
    table is for results of a bounded size, such as counts; streams of rows go to a sink of their own.
    """
    if checkpoint is None:
        checkpoint = f"{checkpoint_folder(stream.sparkSession)}/stream-{uuid.uuid4()}"
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
