"""Scratch tables of queries that write: in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset a local session gets a temporary folder; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        base = f"file://{base}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write_and_read(spark: SparkSession, write: Callable[[str], None]) -> DataFrame:
    path = scratch(spark, "layer")
    write(path)
    return spark.read.parquet(path)


def spill(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """A function that writes a table and reads it back, which cuts its lineage."""
    return lambda df: write_and_read(spark, lambda path: df.write.parquet(path))
