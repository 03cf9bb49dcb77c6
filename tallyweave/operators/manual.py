"""Manual entries and decisions as tables: queues, uploads, reopened decisions, overrides and deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import is_blank, lookup_text
from tallyweave.functions.units import factor

from .review import APPROVED, suffixed_ids

KEY = ["invoice_id", "line_id"]
# Marks of decisions and of issues that a reviewer made.
OPEN, OVERRIDE, COMPLETED, UPLOAD = "PENDING", "override_", "COMPLETED", "UPLOAD"


def completed_decisions(decisions: DataFrame, queue: DataFrame | None = None) -> DataFrame:
    """Completed manual entries whose key is still queued; without a queue all of them."""
    done = decisions.where(F.upper(F.trim("manual_entry_status")) == COMPLETED)
    return done if queue is None else done.join(queue.select(*KEY).distinct(), KEY, "left_semi")


def pruned_decisions(decisions: DataFrame, queue: DataFrame) -> DataFrame:
    """Decisions of any status whose key is queued."""
    return decisions.join(queue.select(*KEY).distinct(), KEY, "left_semi")


def open_entries(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Queued rows without a completed decision."""
    return queue.join(completed_decisions(decisions).select(*KEY).distinct(), KEY, "left_anti")


def rebuilt_queue(low: DataFrame, old: DataFrame) -> DataFrame:
    """A new queue and the uploads of the old one, which no document brings back; an upload that is queued anew counts once."""
    uploads = old.where(F.col("entry_source") == UPLOAD).join(low.select(*KEY), KEY, "left_anti")
    return low.unionByName(uploads, allowMissingColumns=True)


def appended_uploads(queue: DataFrame, uploads: DataFrame) -> DataFrame:
    """queue with uploads(base, at, ...) behind it, each with an id of its own: base, base_2, base_3, counted on from what is queued."""
    taken = F.regexp_extract("invoice_id", r"^(.*?)(?:_(\d+))?$", 1).alias("base")
    number = F.coalesce(F.regexp_extract("invoice_id", r"^(.*?)(?:_(\d+))?$", 2).try_cast("int"), F.lit(1))
    last = queue.select(taken, number.alias("n")).groupBy("base").agg(F.max("n").alias("last"))
    rows = suffixed_ids(uploads, "base", "at")
    own = F.coalesce(F.regexp_extract(F.expr("substring(upload_id, length(base) + 1)"), r"^_(\d+)$", 1).try_cast("int"), F.lit(1))
    rows = rows.withColumn("n", own).join(last, "base", "left")
    n = F.col("n") + F.coalesce("last", F.lit(0))
    rows = rows.withColumn("invoice_id", F.when(n == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), n.cast("string"))))
    return queue.unionByName(rows.withColumns({"line_id": F.lit("1"), "entry_source": F.lit(UPLOAD)}).drop("n", "last", "upload_id", "base", "at"), allowMissingColumns=True)


def missing_fields(required: list[str]) -> Column:
    """The required fields that are blank, joined by commas."""
    return F.array_join(F.array_compact(F.array(*(F.when(is_blank(F.col(c).cast("string")), c) for c in required))), ", ")


def entry_fault(required: list[str]) -> Column:
    """Codes and columns of all that keeps an entry from being saved, joined by "; "; empty if nothing does."""
    wanted = {
        "blank": {c: is_blank(F.col(c).cast("string")) for c in required},
        "unlinked": {c: is_blank(F.col(c)) for c in ("activity_group", "account_number")},
        "unknown": {"energy_unit": factor(F.col("energy_unit")).isNull()},
        "unresolved": {"mapping_status": F.coalesce(F.col("mapping_status") != "MAPPED", F.lit(True))},
    }
    found = []
    for code, columns in wanted.items():
        names = F.array_compact(F.array(*(F.when(bad, F.lit(c)) for c, bad in columns.items())))
        found.append(F.when(F.size(names) > 0, F.concat(F.lit(f"{code} "), F.array_join(names, ","))))
    return F.array_join(F.array_compact(F.array(*found)), "; ")


def reopened(decisions: DataFrame, issues: DataFrame) -> DataFrame:
    """decisions, those of these issues (issue_id) cleared and PENDING again."""
    cleared = ("corrected_value", "review_decision", "reviewed_by", "reviewed_at", "review_comment")
    rows = decisions.join(issues.select("issue_id", F.lit(True).alias("_tw_open")).distinct(), "issue_id", "left")
    open_ = F.coalesce("_tw_open", F.lit(False))
    out = {c: F.when(open_, F.lit("")).otherwise(F.col(c)) for c in cleared if c in decisions.columns}
    return rows.withColumns(out | {"review_tag": F.when(open_, OPEN).otherwise(F.col("review_tag"))}).select(decisions.columns)


def new_decisions(issues: DataFrame) -> DataFrame:
    """An open decision for each issue."""
    blank = F.lit("")
    return issues.select(
        F.concat(F.lit("decision_"), "issue_id").alias("decision_id"), "issue_id", *KEY, "field_name", F.coalesce("ocr_value", blank).alias("original_value"), blank.alias("corrected_value"),
        blank.alias("review_decision"), F.lit(OPEN).alias("review_tag"), blank.alias("reviewed_by"), blank.alias("reviewed_at"), blank.alias("review_comment"),
    )


def override_id(invoice: Column, line: Column, field: Column) -> Column:
    """The issue id of a reviewer's own correction; a line without a name is 1."""
    safe = lambda c: F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_]+", "_"), "^_+|_+$", "")
    line = F.when(safe(line) == "", "1").otherwise(safe(line))
    return F.concat(F.lit(OVERRIDE), safe(invoice), F.lit("_"), line, F.lit("_"), safe(field))


def without(df: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """df without the rows whose key is in gone."""
    return df.join(gone.select(*key).distinct(), key, "left_anti")


def unit_mapping(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """rows (row_id) with mapping_status and mapped_id by unit alone, narrowed by account where one is given.

    Mapping rows are counted by unit and by unit and account before a row meets them.
    """
    m = mapping.select("map_id", lookup_text(F.col("unit_name")).alias("unit"), F.coalesce(lookup_text(F.col("account_number")), F.lit("")).alias("account"))
    by_unit = m.groupBy("unit").agg(F.count("*").alias("n"), F.min("map_id").alias("one")).withColumn("account", F.lit(""))
    counted = by_unit.unionByName(m.where("account <> ''").groupBy("unit", "account").agg(F.count("*").alias("n"), F.min("map_id").alias("one")))
    asked = rows.select("row_id", lookup_text(F.col("unit_name")).alias("unit"), F.coalesce(lookup_text(F.col("account_number")), F.lit("")).alias("account"))
    out = asked.join(counted, ["unit", "account"], "left")
    status = F.when(F.col("n").isNull(), "UNMAPPED").when(F.col("n") > 1, "AMBIGUOUS").otherwise("MAPPED")
    return out.select("row_id", status.alias("mapping_status"), F.when(F.col("n") == 1, F.col("one")).alias("mapped_id"))


def line_view(line: DataFrame, bronze: DataFrame, issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """The bronze rows of some lines (invoice_id, line_id) with how many issues and approved decisions each has."""
    mine = lambda df: df.join(line.select(*KEY).distinct(), KEY, "left_semi")
    n = lambda df, name: mine(df).groupBy(*KEY).agg(F.count("*").alias(name))
    good = decisions.where(F.upper(F.trim("review_decision")).isin(*APPROVED))
    out = mine(bronze).join(n(issues, "issues"), KEY, "left").join(n(good, "approved"), KEY, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("issues", "approved")})
