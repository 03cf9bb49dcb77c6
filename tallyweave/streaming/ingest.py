"""Incremental ingest: documents as they arrive, and late periods that change what their neighbours were resolved to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.keys import content_hash
from tallyweave.functions.text import is_blank, trimmed
from tallyweave.operators.bronze import parsed
from tallyweave.operators.periods import SEQUENCE, resolve_dates

RESOLUTION = ("effective_start", "effective_end", "date_adjustment", "date_resolution", "resolution_reference", "date_provisional")
BUCKETS = 64


def ingest_documents(spark: SparkSession, path: str, out: str, glob: str = "*.json", max_files: int = 1000) -> None:
    """Reads the files under path that no run before has read, one document each, and ends.

    Under out: documents (json, content_hash, source_file, source_path, modified, length), corrupt (the same, of files that are blank or no
    JSON object), both by batch, and state, the stream's checkpoint. Files of no bytes are passed over, as by all of Spark's file sources. A batch that is run again after a failure overwrites its own folders, so
    no file is lost or stored twice.
    """
    reader = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files)
    seen = F.col("_metadata")
    files = reader.load(path).select(
        F.col("value").alias("json"), seen["file_name"].alias("source_file"), seen["file_path"].alias("source_path"), seen["file_modification_time"].alias("modified"), seen["file_size"].alias("length"),
    )

    def store(batch: DataFrame, n: int) -> None:
        rows = batch.withColumn("content_hash", content_hash(F.col("json"))).persist()
        good = is_document(F.col("json"))
        for name, part in (("documents", rows.where(good)), ("corrupt", rows.where(~good))):
            part.write.mode("overwrite").parquet(f"{out}/{name}/batch={n}")
        rows.unpersist()

    files.writeStream.foreachBatch(store).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()


def is_document(json: Column) -> Column:
    """Whether a text is a JSON object."""
    return F.coalesce(F.try_parse_json(json).isNotNull() & F.ltrim(json).startswith("{"), F.lit(False))


def ingested(spark: SparkSession, out: str, name: str = "documents") -> DataFrame:
    """What ingest_documents() has stored: documents come parsed."""
    rows = spark.read.parquet(f"{out}/{name}")
    return parsed(rows) if name == "documents" else rows


def _bucket(buckets: int) -> Column:
    """Where a period's whole sequence lies, however its key is spelt."""
    key = F.concat_ws("\u0001", *(F.lower(F.coalesce(trimmed(F.col(c)), F.lit(""))) for c in SEQUENCE))
    # periods without an account are sequences of their own and need no neighbours: they are dealt by row
    return F.pmod(F.when(is_blank(F.col("account_number")), F.xxhash64("row_id")).otherwise(F.xxhash64(key)), F.lit(buckets)).cast("int")


def begin_history(periods: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Writes resolved periods as a table in buckets of whole sequences, for arrive() to change."""
    resolve_dates(periods).withColumn("bucket", _bucket(buckets)).write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path)


def arrive(periods: DataFrame, batch: int, path: str, staged: str, buckets: int = BUCKETS) -> None:
    """Takes late periods into a written history: the buckets that hold their sequences are resolved anew and replaced, others are not read.

    A period that arrives again replaces its former self; its sequence may not change. The new buckets are staged first, and replaced one partition at a
    time, so a batch that is run again after a failure, even half way through, ends in the same history. What a batch stages takes the place of what the one before did,
    whose rows are all in the history.
    """
    spark = periods.sparkSession
    new = periods.withColumn("bucket", _bucket(buckets)).persist()
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # as many as there are buckets, at most
    if touched:
        held = spark.read.parquet(path).where(F.col("bucket").isin(touched)).drop(*RESOLUTION)
        # the keys that arrive again are written by themselves: mostly few or none, they then meet whole rows without a shuffle of those
        keys = ["row_id", "period_index"]
        held.select(*keys).join(new.select(*keys), keys, "left_semi").distinct().write.mode("overwrite").parquet(f"{staged}/again")
        again = spark.read.schema(new.select(*keys).schema).parquet(f"{staged}/again")
        rows = held.join(again, keys, "left_anti").unionByName(new.select(held.columns))
        resolve_dates(rows).write.mode("overwrite").option("compression", "zstd").parquet(f"{staged}/rows")
        spark.read.parquet(f"{staged}/rows").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket").parquet(path)
    new.unpersist()


def late_stream(stream: DataFrame, path: str, work: str, buckets: int = BUCKETS) -> None:
    """Runs a stream of late periods over what is there, batch by batch, and ends; work holds the checkpoint and staged buckets."""
    query = stream.writeStream.foreachBatch(lambda df, n: arrive(df, n, path, f"{work}/staged", buckets)).option("checkpointLocation", f"{work}/state")
    query.trigger(availableNow=True).start().awaitTermination()
