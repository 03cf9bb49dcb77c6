"""Structured Streaming forms of ingest and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.keys import content_hash
from tallyweave.operators.bronze import parsed
from tallyweave.operators.periods import SEQUENCE, resolve_dates


def document_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """New JSON documents of a folder, one a file, as parsed documents with the name and time of their file."""
    reader = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", max_files)
    rows = reader.load(path).select(F.col("value").alias("json"), F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_modification_time").alias("modified"))
    return keyed(rows)


def keyed(rows: DataFrame) -> DataFrame:
    """Rows of JSON texts parsed, with the hash of their content."""
    return parsed(rows).withColumn("content_hash", content_hash(F.col("json")))


def deduped(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """Drops documents whose content was seen within the delay; the final marking is the batch operator's."""
    return stream.withWatermark("modified", delay).dropDuplicatesWithinWatermark(["content_hash"])


def re_resolved(history: DataFrame, arrived: DataFrame) -> DataFrame:
    """Resolved dates of every whole sequence that new periods touch: for foreachBatch, which overwrites those sequences."""
    keys = arrived.select(*SEQUENCE).distinct()
    same = None
    for k in SEQUENCE:
        c = history[k].eqNullSafe(keys[k])
        same = c if same is None else same & c
    return resolve_dates(history.join(keys, same, "left_semi").unionByName(arrived.join(history.select("row_id"), "row_id", "left_anti")))


def monthly_totals(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Count and sum a month and event type, for update or complete mode."""
    return events.withWatermark("ts", delay).groupBy(F.trunc("ts", "MM").alias("month"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_once(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Runs a stream over what is there and ends; the sink is a folder that each run appends to."""
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
