"""Review decisions as an append-only log: updates and deletions are entries, the state is what the last entry of each issue says.

Under its path a log has entries/version=N, one folder an append, and states/version=N, compacted states. Nothing is overwritten, so every version that
was ever current can be read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .manual import override_id

UPSERT, DELETE = "UPSERT", "DELETE"
COLUMNS = ("issue_id", "invoice_id", "line_id", "field_name", "original_value", "corrected_value", "review_decision", "reviewed_at")
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS) + ", action string, seq long"


def decisions(issues: DataFrame, corrected, decision, at: str) -> DataFrame:
    """Entries that decide issues (issue_id, invoice_id, line_id, field_name, ocr_value): corrected and decision are columns, at is a time."""
    return issues.select(
        "issue_id", "invoice_id", "line_id", "field_name", F.col("ocr_value").alias("original_value"), corrected.cast("string").alias("corrected_value"), decision.alias("review_decision"),
        F.lit(at).alias("reviewed_at"), F.lit(UPSERT).alias("action"),
    )


def overrides(rows: DataFrame, field: str, value, at: str) -> DataFrame:
    """Entries for values that a reviewer changed though no issue asked for it: their issue is made up from the line and field."""
    issue = override_id(F.col("invoice_id"), F.col("line_id"), F.lit(field))
    return decisions(rows.select(issue.alias("issue_id"), "invoice_id", "line_id", F.lit(field).alias("field_name"), F.col(field).cast("string").alias("ocr_value"), value.alias("new")), F.col("new"), F.lit("CORRECTED"), at)


def deletions(issue_ids: DataFrame, at: str) -> DataFrame:
    """Entries that take back the decisions of issue_ids(issue_id)."""
    blank = [F.lit(None).cast("string").alias(c) for c in COLUMNS[1:-1]]
    return issue_ids.select("issue_id", *blank, F.lit(at).alias("reviewed_at"), F.lit(DELETE).alias("action"))


def append(spark: SparkSession, path: str, version: int, entries: DataFrame) -> None:
    """Adds entries as a version. A version that is written again replaces itself; within one, the place in seq (0 if absent) is the order."""
    rows = entries if "seq" in entries.columns else entries.withColumn("seq", F.lit(0).cast("long"))
    rows.select(*COLUMNS, "action", "seq").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/entries/version={version}")


def _read(spark: SparkSession, path: str) -> DataFrame:
    """Entries or states with their version; none where nothing was written."""
    try:
        return spark.read.schema(f"{SCHEMA}, version int").parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], f"{SCHEMA}, version int")


def _last(spark: SparkSession, path: str, version: int | None) -> DataFrame:
    """The last entry of each issue up to a version, deletions too: by time, version and seq. It is read from the newest compacted state and the entries
    after it; older entries are not read."""
    wanted = F.lit(True) if version is None else F.col("version") <= version
    states = _read(spark, f"{path}/states").where(wanted)
    base = states.agg(F.max("version").alias("v")).first()["v"]
    base = -1 if base is None else base
    rows = states.where(F.col("version") == base).unionByName(_read(spark, f"{path}/entries").where(wanted & (F.col("version") > base)))
    last = rows.groupBy("issue_id").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "issue_id")), F.struct("reviewed_at", "version", "seq")).alias("x"))
    return last.select("issue_id", "x.*")


def state(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The decisions that hold at a version, or now: of each issue what its last entry says, unless that deletes."""
    return _last(spark, path, version).where(F.col("action") != DELETE).select(*COLUMNS)


def compact(spark: SparkSession, path: str, version: int, files: int = 8) -> None:
    """Writes the state at a version, deletions kept as marks, so that later reads begin there. Entries stay, for reading older versions."""
    rows = _last(spark, path, version).select(*COLUMNS, "action", "seq")
    rows.repartition(files, "issue_id").sortWithinPartitions("issue_id").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/states/version={version}")
