"""Layers: tables that are built from each other, kept with what they were built from, and built again only where that has changed.

Under its root each layer has a folder a build, and _log has a row a build: the fingerprint of what was written and of each input. A fingerprint is of
rows, not of files, so a table that is written again unchanged is no change, and what stands upon it stays.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "layer string, build int, path string, fingerprint string, inputs map<string,string>, rows long, built timestamp"


@dataclass(frozen=True)
class Layer:
    """A table to be built: build takes its inputs, sources or layers before it, in their order."""

    name: str
    inputs: tuple[str, ...]
    build: Callable[..., DataFrame]
    partition_by: tuple[str, ...] = ()


def _row_hash(df: DataFrame) -> Column:
    """A hash of a row by value; maps, which have no hash, go by their sorted entries."""
    columns = [F.array_sort(F.map_entries(c)) if kind.startswith("map<") else F.col(f"`{c}`") for c, kind in df.dtypes]
    return F.xxhash64(*(c for c in columns), F.lit(len(columns)))


def fingerprint(df: DataFrame) -> tuple[str, int]:
    """(fingerprint, rows) of a table's rows whatever their order: one pass with a partial sum a task. Repeated rows count."""
    h, again = _row_hash(df), F.xxhash64(_row_hash(df), F.lit("again"))
    seen = df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(again, 16)).alias("s")).first()
    names = ",".join(f"{c} {k}" for c, k in df.dtypes)
    return f"{seen['n']}-{seen['x'] or 0:x}-{seen['s'] or 0:x}-{hash_text(names)}", seen["n"]


def hash_text(text: str) -> str:
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()[:16]


def log(spark: SparkSession, root: str) -> DataFrame:
    """All builds; none where nothing was built."""
    try:
        return spark.read.schema(LOG).parquet(f"{root}/_log")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LOG)


def current(spark: SparkSession, root: str) -> dict[str, dict]:
    """The last build of each layer; as many rows as there are layers reach the driver."""
    last = log(spark, root).groupBy("layer").agg(F.max_by(F.struct("build", "path", "fingerprint", "inputs", "rows", "built"), "build").alias("x"))
    return {r["layer"]: r["x"].asDict() for r in last.collect()}


def stale(spark: SparkSession, root: str, layers: list[Layer], sources: dict[str, DataFrame]) -> list[tuple[str, str]]:
    """(layer, input) of every layer that was built from another state of an input than there is now, or never; nothing is built.

    A layer above a stale one is named with it, as it will have to be looked at.
    """
    held = current(spark, root)
    now = {name: fingerprint(df)[0] for name, df in sources.items()} | {name: x["fingerprint"] for name, x in held.items()}
    out, open_ = [], set()
    for layer in layers:
        was = held[layer.name]["inputs"] if layer.name in held else {}
        changed = [(layer.name, i) for i in layer.inputs if i in open_ or was.get(i) != now.get(i)]
        if changed:
            open_.add(layer.name)
        out += changed
    return out


def refresh(spark: SparkSession, root: str, layers: list[Layer], sources: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Builds the layers whose inputs have changed since their last build, in the order given, and returns all of them as tables.

    A build that gives the rows of the one before ends the change there. A build is written before it is logged, so one that fails is built anew, in the
    same folder.
    """
    held = current(spark, root)
    now = {name: fingerprint(df)[0] for name, df in sources.items()}
    tables = dict(sources)
    for layer in layers:
        inputs = {i: now[i] for i in layer.inputs}
        was = held.get(layer.name)
        if was is None or was["inputs"] != inputs:
            build = was["build"] + 1 if was else 1
            path = f"{root}/{layer.name}/build={build}"
            layer.build(*(tables[i] for i in layer.inputs)).write.mode("overwrite").partitionBy(*layer.partition_by).parquet(path)
            print_, rows = fingerprint(spark.read.parquet(path))
            row = spark.createDataFrame([(layer.name, build, path, print_, inputs, rows)], LOG.rpartition(",")[0]).withColumn("built", F.current_timestamp())
            row.coalesce(1).write.mode("append").parquet(f"{root}/_log")
            was = {"path": path, "fingerprint": print_}
        now[layer.name], tables[layer.name] = was["fingerprint"], spark.read.parquet(was["path"])
    return {layer.name: tables[layer.name] for layer in layers}
