"""Review state: field quality, summaries, issues, decisions and queues."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.text import is_blank, issue_id, line_key, own_columns

LINE = ["invoice_id", "line_id"]
APPROVED = ("APPROVED", "CORRECTED", "NOT_APPLICABLE")
ORDER = ("BLOCKED", "REVIEW", "WARNING", "AUTO_RESOLVED")


@dataclass(frozen=True)
class Thresholds:
    critical: float = 0.80
    optional: float = 0.60
    noncritical: float = 0.30
    blank_high: float = 0.90
    document: float = 0.80


def field_quality(rows: DataFrame, fields: dict[str, str], limits: Thresholds = Thresholds()) -> DataFrame:
    """One row for each line and field: value, confidence, threshold, status and reason. fields: name to criticality."""
    parts = [F.struct(F.lit(i).alias("pos"), F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), F.col(f"{f}_confidence").alias("confidence"), F.lit(k).alias("criticality"), F.lit(getattr(limits, k)).alias("threshold")) for i, (f, k) in enumerate(fields.items())]
    out = rows.select(*LINE, F.explode(F.array(*parts)).alias("q")).select(*LINE, "q.*")
    blank, critical = is_blank(F.col("value")), F.col("criticality") == "critical"
    low = F.col("confidence") < F.col("threshold")
    status = (
        F.when(blank & (F.col("confidence") > limits.blank_high), "AUTO_RESOLVED").when(blank & critical, "BLOCKED").when(blank, "WARNING").when(low & critical, "REVIEW").when(low, "WARNING").otherwise("PASS")
    )
    reason = (
        F.when(blank & (F.col("confidence") > limits.blank_high), "BLANK_HIGH_CONFIDENCE").when(blank & critical, "MISSING_REQUIRED").when(blank, "MISSING_OPTIONAL").when(low, "LOW_CONFIDENCE").otherwise("PASS")
    )
    return out.withColumn("field_status", status).withColumn("reason_code", reason)


def _listed(keep: Column, value: str) -> Column:
    """Distinct values of the rows kept, by status and then field order, joined by semicolons."""
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("field_status"))
    items = F.array_sort(F.collect_list(F.when(keep, F.struct(rank.alias("r"), "pos", F.col(value).alias("v")))))
    return F.array_join(F.array_distinct(F.transform(items, lambda x: x["v"])), ";")


def review_summary(quality: DataFrame) -> DataFrame:
    """One row a line: status of its worst field, severity, reasons, field lists, counts, least critical confidence."""
    s, critical = F.col("field_status"), F.col("criticality") == "critical"
    bad = s.isin("BLOCKED", "REVIEW")
    worst = F.min(F.when(s != "PASS", F.array_position(F.array(*map(F.lit, ORDER)), s)))
    out = quality.groupBy(*LINE).agg(
        worst.alias("worst"),
        F.count_if(bad).alias("review_issue_count"),
        F.count_if(bad & critical).alias("critical_issue_count"),
        F.min(F.when(critical, F.col("confidence"))).alias("min_critical_confidence"),
        _listed(s != "PASS", "reason_code").alias("review_reason_codes"),
        _listed(bad, "field").alias("failed_fields"),
        _listed(F.col("reason_code") == "LOW_CONFIDENCE", "field").alias("low_confidence_fields"),
        _listed(F.col("reason_code") == "MISSING_REQUIRED", "field").alias("missing_required_fields"),
        _listed(s == "AUTO_RESOLVED", "field").alias("auto_resolved_fields"),
    )
    w = F.col("worst")
    status = F.when(w == 1, "BLOCKED").when(w == 2, "REVIEW_REQUIRED").when(w == 3, "OPTIONAL_FIELD_WARNING").when(w == 4, "AUTO_RESOLVED_WITH_WARNING").otherwise("AUTO_APPROVED")
    severity = F.when(w == 1, "HIGH").when(w == 2, F.when(F.col("critical_issue_count") > 0, "HIGH").otherwise("MEDIUM")).when(w.isin(3, 4), "LOW").otherwise("NONE")
    return out.withColumns({"review_status": status, "review_severity": severity, "review_required": F.coalesce(w <= 2, F.lit(False))}).drop("worst")


def review_issues(quality: DataFrame) -> DataFrame:
    """Blocked and review fields as issues with ids."""
    rows = quality.where(F.col("field_status").isin("BLOCKED", "REVIEW"))
    severity = F.when((F.col("field_status") == "BLOCKED") | (F.col("criticality") == "critical"), "HIGH").otherwise("MEDIUM")
    return rows.select(
        issue_id(F.col("invoice_id"), F.col("line_id"), F.col("field"), F.col("reason_code")).alias("issue_id"), *LINE, F.col("field").alias("field_name"), F.col("reason_code").alias("issue_type"),
        severity.alias("severity"), F.col("value").alias("ocr_value"), "confidence", "threshold", "criticality",
    )


def latest(decisions: DataFrame, key: list[str]) -> DataFrame:
    """The last decision of each key, by reviewed_at and then seq."""
    order = Window.partitionBy(*key).orderBy(F.desc("reviewed_at"), F.desc("seq"))
    own_columns(decisions)
    return decisions.withColumn("_tw_n", F.row_number().over(order)).where("_tw_n = 1").drop("_tw_n")


def approve(bronze: DataFrame, summary: DataFrame, decisions: DataFrame, fields: list[str]) -> DataFrame:
    """Approved lines with corrections laid over their fields; lines that need review and have no approval are left out.

    Decisions apply in log order (seq), the last of a field wins: CORRECTED writes its value, blank included.
    """
    good = decisions.where(F.upper(F.trim("review_decision")).isin(*APPROVED)).withColumn("line_id", line_key(F.col("line_id")))
    last = good.groupBy(*LINE, "field_name").agg(F.max_by(F.struct(F.upper(F.trim("review_decision")).alias("d"), "corrected_value"), "seq").alias("x"), F.count("*").alias("n"))
    corrected = F.when((F.col("x.d") == "CORRECTED") | ~is_blank(F.col("x.corrected_value")), F.struct(F.coalesce("x.corrected_value", F.lit("")).alias("v")))
    by_line = last.groupBy(*LINE).agg(F.map_from_entries(F.collect_list(F.struct("field_name", corrected.alias("c")))).alias("fixes"), F.sum("n").alias("manual_review_decision_count"))
    rows = bronze.join(summary.select(*LINE, "review_required"), LINE).join(by_line, LINE, "left")
    rows = rows.where(~F.col("review_required") | F.col("fixes").isNotNull())
    fixed = {f: F.coalesce(F.try_element_at("fixes", F.lit(f))["v"], F.col(f).cast("string")) for f in fields}
    status = F.when(F.col("fixes").isNotNull(), "MANUALLY_APPROVED").otherwise("AUTO_APPROVED")
    return rows.withColumns(fixed | {"approval_status": status, "manual_review_decision_count": F.coalesce("manual_review_decision_count", F.lit(0))}).drop("fixes", "review_required")


def carry_decisions(issues: DataFrame, old: DataFrame) -> DataFrame:
    """Decision rows for issues: by issue id, else by (invoice, field, original value), else new; overrides without an issue stay."""
    by_id = old.select("issue_id", F.struct("review_decision", "corrected_value").alias("by_id")).groupBy("issue_id").agg(F.max("by_id").alias("by_id"))
    stable = old.groupBy("invoice_id", "field_name", F.coalesce("original_value", F.lit("")).alias("value")).agg(F.max_by(F.struct("review_decision", "corrected_value"), "issue_id").alias("by_value"))
    rows = issues.withColumn("value", F.coalesce("ocr_value", F.lit(""))).join(by_id, "issue_id", "left").join(stable, ["invoice_id", "field_name", "value"], "left")
    got = F.coalesce("by_id", "by_value")
    kept = rows.select("issue_id", *LINE, "field_name", F.coalesce(got["review_decision"], F.lit("PENDING")).alias("review_decision"), got["corrected_value"].alias("corrected_value"))
    extra = old.where(F.col("issue_id").startswith("override_")).join(issues, "issue_id", "left_anti").select(*kept.columns)
    return kept.unionByName(extra)


def open_queue(summary: DataFrame, issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """Summaries of the lines that still have an issue without an approved decision."""
    done = decisions.where(F.upper(F.trim("review_decision")).isin(*APPROVED)).select("issue_id")
    return summary.join(issues.join(done, "issue_id", "left_anti").select(*LINE), LINE, "left_semi")


def merged_queue(queue: DataFrame, decisions: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """All keys of both; where a decision exists its values count, blanks included."""
    q, d = queue.alias("q"), decisions.withColumn("_tw_has", F.lit(True)).alias("d")
    value = lambda c: F.when(F.col("d._tw_has"), F.col(f"d.{c}")).otherwise(F.col(f"q.{c}")).alias(c)
    return q.join(d, F.col(f"q.{key}") == F.col(f"d.{key}"), "full_outer").select(F.coalesce(f"q.{key}", f"d.{key}").alias(key), *map(value, columns))


def split_by_confidence(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(kept, low): low have a document confidence that parses and lies below the threshold; 0 or less lets all pass."""
    low = F.coalesce(F.col("document_confidence").cast("string").try_cast("double") < threshold, F.lit(False)) if threshold > 0 else F.lit(False)
    return rows.where(~low), rows.where(low)


def manual_queue(low: DataFrame, threshold: float) -> DataFrame:
    """Low-confidence lines as rows to be keyed in by hand."""
    return low.select(*LINE, "document_confidence", F.lit(threshold).alias("document_confidence_threshold"), F.lit("PENDING").alias("manual_entry_status"))


def suffixed_ids(uploads: DataFrame, base: str, order: str) -> DataFrame:
    """Unique ids for uploads of one name: the first keeps it, the next get _2, _3."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return uploads.withColumn("upload_id", F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("_"), n.cast("string"))))


def queue(summary: DataFrame, statuses: list[str], include_approved: bool = False) -> DataFrame:
    """Summaries of these statuses; approved ones only if asked for. For a report sort by review_severity (as text), invoice and line."""
    rows = summary.where(F.col("review_status").isin(*statuses))
    return rows if include_approved else rows.where(F.col("review_status") != "AUTO_APPROVED")


def field_view(rows: DataFrame, summary: DataFrame, fields: list[str]) -> DataFrame:
    """One row a line and field: its value, and what the line's summary says of it."""
    parts = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
    named = lambda c: F.array_contains(F.split(c, ";"), F.col("x.field"))
    status = F.when(named("missing_required_fields"), "Missing").when(named("low_confidence_fields"), "Low confidence").when(named("failed_fields"), "Failed").otherwise("OK")
    out = rows.select(*LINE, F.explode(parts).alias("x")).join(summary.select(*LINE, "missing_required_fields", "low_confidence_fields", "failed_fields"), LINE)
    return out.select(*LINE, "x.field", "x.value", status.alias("status"))


@dataclass(frozen=True)
class Review:
    """What a review of bronze lines gives: a summary a line, issues, their decisions, the approved lines, and the lines that wait for a reviewer."""

    summary: DataFrame
    issues: DataFrame
    decisions: DataFrame
    approved: DataFrame
    waiting: DataFrame


def reviewed(bronze: DataFrame, criticality: dict[str, str], thresholds: Thresholds, old: DataFrame) -> Review:
    """A review of bronze lines that keeps what reviewers decided in the review before (old, as carry_decisions() takes it).

    Lines may come from a bronze table that was saved: nothing but its columns is read. A field with several issues takes the decision of the
    last issue by id. Duplicates must be out.
    """
    quality = field_quality(bronze, criticality, thresholds)
    summary, issues = review_summary(quality), review_issues(quality)
    decisions = carry_decisions(issues, old)
    approved = approve(bronze, summary, decisions.withColumn("seq", F.col("issue_id")), list(criticality))
    return Review(summary, issues, decisions, approved, open_queue(summary, issues, decisions))
