"""What the text operators share: table access, shared scratch tables, word splitting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch handed to Python; with whole texts, a smaller batch keeps a worker's memory bounded.
ARROW_ROWS = 1000


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it; where they have their own, nothing changes."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir.

    Only where the cluster names none (tests on one machine) a temporary folder is made, set for the session and removed at exit.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        base = f"file://{base}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def filesystem(path: str):
    """(file system, path there) of a path of the shared folder, for tasks that read or write files by themselves."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Sets the rows of an Arrow batch for the jobs within, and puts the session's own value back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_words(text: str | None) -> list[bytes]:
    """UTF-8 words between the white space \\x20 and \\x09-\\x0D; null has none."""
    return text.encode().split() if text else []


def by_id(rows: DataFrame, each, columns: str, id_col: str = "id") -> DataFrame:
    """rows.mapInPandas(each), where each gives id_col and columns: ids travel as text, since pandas makes whole numbers beside a null floats."""
    kind = rows.schema[id_col].dataType.simpleString()
    text = F.col(id_col).cast("string")
    return rows.withColumn(id_col, text).mapInPandas(each, f"{id_col} string, {columns}").withColumn(id_col, F.col(id_col).cast(kind))


def sampled(df: DataFrame, key: str, rows: int) -> DataFrame:
    """So many rows of df at most, one for each of the keys with the smallest hashes; only keys are gathered to choose them."""
    chosen = df.select(key).dropna().distinct().orderBy(F.xxhash64(key), key).limit(rows)
    return df.join(F.broadcast(chosen), key).dropDuplicates([key])
