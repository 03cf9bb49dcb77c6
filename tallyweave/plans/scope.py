"""Report scope and evidence: audit records, what of them a reader asked for, the cases and the periods behind them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.dates import month_label
from tallyweave.functions.text import first_present, is_blank, source_label, trimmed
from tallyweave.functions.units import factor
from tallyweave.operators.silver import ACTIVITY_GROUPS

from .audit import CALCULATION, FACILITY, OVERLAPPING, UNCOVERED

#: Issues of one month; others belong to their periods.
MONTHLY = (UNCOVERED, OVERLAPPING, CALCULATION)
LINKS = 4
#: What the evidence of a case shows of its periods.
EVIDENCE = ("facility", "kpi_component", "account", "source_file", "source_link")


def kpi_component(activity: Column) -> Column:
    out = F.lit("Unclassified")
    for g in ACTIVITY_GROUPS:
        out = F.when(F.lower(trimmed(activity)) == g.lower(), f"Purchased {g.lower()}").otherwise(out)
    return out


def audit_periods(df: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Audit records of billed periods: identity, facility label, KPI, mapped or not, printed and effective dates, factor and billed kWh.

    df has invoice_id, line_id, source_file, flow, the facility, account_number, activity_group, mapping_status, start, end, effective_start,
    effective_end, quantity, energy_unit and period_index. A blank invoice goes by its file, a blank line is 1. Columns to carry go along, as those of a month.
    """
    levels = [F.coalesce(trimmed(F.col(c)), F.lit("")) for c in FACILITY]
    labels = [F.when(v == "", "Unmapped").otherwise(v) for v in levels]
    filled = reduce(lambda a, b: a & b, (v != "" for v in levels))
    f = factor(F.col("energy_unit"))
    invoice, line = first_present(F.col("invoice_id"), F.col("source_file")), F.coalesce(first_present(F.col("line_id")), F.lit("1"))
    return df.select(
        F.substring(F.sha2(F.concat_ws("|", "flow", invoice, line, "period_index"), 256), 1, 16).alias("period_id"), invoice.alias("invoice_id"), line.alias("line_id"), F.col("flow").alias("source"),
        F.concat_ws(" / ", *labels).alias("facility"), *(v.alias(c) for v, c in zip(levels, FACILITY, strict=True)), kpi_component(F.col("activity_group")).alias("kpi_component"),
        (filled & (is_blank(F.col("mapping_status")) | (F.col("mapping_status") == "MAPPED"))).alias("mapped"), F.coalesce("account_number", F.lit("")).alias("account"),
        F.col("start").alias("printed_start"), F.col("end").alias("printed_end"), F.coalesce("effective_start", "start").alias("start"), F.coalesce("effective_end", "end").alias("end"),
        F.col("quantity").alias("billed_original"), F.col("energy_unit").alias("original_unit"), f.alias("factor"), (F.col("quantity") * f).alias("billed_kwh"), "source_file", "source_link", "period_index", *carry,
    )


def allocation_records(periods: DataFrame, splits: DataFrame) -> DataFrame:
    """Each split (period_id, month, split_start, split_end, split_days, split_quantity) beside its period, with its amount in kWh."""
    return allocated(splits.join(periods, "period_id"))


def allocated(rows: DataFrame) -> DataFrame:
    """Splits with the factor of their period: with what falls to them, and that in kWh."""
    return rows.withColumns({"allocated_original": F.col("split_quantity"), "allocated_kwh": F.col("split_quantity") * F.col("factor")})


def scoped(df: DataFrame, **wanted: str | None) -> DataFrame:
    """The rows that equal every value asked for; None asks for nothing."""
    return reduce(lambda rows, kv: rows.where(F.col(kv[0]) == kv[1]), ((k, v) for k, v in wanted.items() if v is not None), df)


def unique_ids(df: DataFrame, key: str = "period_id") -> DataFrame:
    """The ids that stand for several rows, and how many; a report must not be made while there are any."""
    return df.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1")


def evidenced(cases: DataFrame, periods: DataFrame) -> DataFrame:
    """cases (issue, month, period_id: a row for each period concerned) as one row a case with its periods, files and links in order.

    A case is an issue of a month: of one period, or, where cases carry a case_key, of all periods with that key. Cases that carry the columns EVIDENCE
    of their periods are not joined to them.
    """
    key = F.col("case_key") if "case_key" in cases.columns else F.col("period_id")
    rows = cases.withColumn("case_key", key)
    if not set(EVIDENCE) <= set(cases.columns):
        rows = rows.join(periods.select("period_id", *EVIDENCE), "period_id")
    listed = lambda c: F.array_sort(F.collect_set(F.when(~is_blank(F.col(c)), F.col(c))))
    out = rows.groupBy("issue", "month", "case_key").agg(listed("period_id").alias("period_ids"), listed("source_file").alias("source_files"), listed("source_link").alias("source_links"), F.min(F.struct("facility", "kpi_component", "account")).alias("x"))
    case_id = F.concat(F.lit("A-"), F.substring(F.sha2(F.concat_ws("|", "issue", F.array_join("period_ids", ","), "month"), 256), 1, 10))
    return out.select(case_id.alias("case_id"), "issue", "month", "x.*", "period_ids", "source_files", "source_links")


def scoped_cases(cases: DataFrame, periods: DataFrame, months: list[str]) -> DataFrame:
    """Cases of the months (yyyy-MM) if their issue is monthly, others if one of their periods is in periods.

    A case is told by what it is made of: its case_id is a hash of 40 bits, which two of some million cases share.
    """
    monthly = F.col("issue").isin(*MONTHLY)
    others = cases.where(~monthly)
    own = ("case_id", "issue", "month", "period_ids")
    relevant = others.select(*own, F.explode("period_ids").alias("period_id")).join(periods.select("period_id"), "period_id", "left_semi").select(*(F.col(c).alias(f"_tw_{c}") for c in own)).distinct()
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_tw_{c}")) for c in own))
    return cases.where(monthly & F.col("month").isin(*months)).unionByName(others.join(relevant, same, "left_semi"))


def case_evidence(cases: DataFrame, rows: DataFrame) -> DataFrame:
    """The periods or allocations that any of the cases names, whatever their month."""
    return rows.join(cases.select(F.explode("period_ids").alias("period_id")).distinct(), "period_id", "left_semi")


def split_faults(splits: DataFrame, periods: DataFrame) -> DataFrame:
    """(row_id, month, fault) of splits that do not fit their period: none there, another file, stale account or activity, stale dates."""
    p = periods.select("row_id", "period_index", F.struct("source_file", "account_number", "activity_group", "effective_start", "effective_end").alias("p"))
    rows = splits.join(p, ["row_id", "period_index"], "left")
    differs = lambda *cs: reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(F.col(f"p.{c}")) for c in cs))
    fault = (
        F.when(F.col("p").isNull(), "no such period")
        .when(differs("source_file"), "another file")
        .when(differs("account_number", "activity_group"), "another account or activity")
        .when(differs("effective_start", "effective_end"), "other dates")
    )
    return rows.withColumn("fault", fault).where("fault is not null").select("row_id", "month", "fault")


def split_rules(splits: DataFrame, periods: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """splits beside their periods, and the rules that let them into a report: for constraints.enforced or quarantined."""
    p = periods.select("row_id", "period_index", F.struct("source_file", "effective_start", "effective_end").alias("p"))
    inside = F.coalesce((F.col("split_start") >= F.col("p.effective_start")) & (F.col("split_end") <= F.col("p.effective_end")), F.col("p").isNull())
    rules = {
        "no such period": F.col("p").isNotNull(),
        "another file": F.col("p").isNull() | F.col("source_file").eqNullSafe(F.col("p.source_file")),
        "no amount": F.col("split_quantity").isNotNull(),
        "outside its period": inside,
    }
    return splits.join(p, ["row_id", "period_index"], "left"), rules


def details(allocations: DataFrame) -> DataFrame:
    """The audit-details projection, with what the amounts recalculate to."""
    return allocations.select(
        "facility", "kpi_component", "account", F.concat(F.date_format("start", "yyyy-MM-dd"), F.lit(" to "), F.date_format("end", "yyyy-MM-dd")).alias("invoice_period"), month_label(F.col("month")).alias("month"),
        "allocated_original", "original_unit", "allocated_kwh", (F.col("allocated_original") * F.col("factor")).alias("recalculated_kwh"), source_label(F.col("source_link")).alias("link"),
    )


def original_quantities(allocations: DataFrame) -> DataFrame:
    """One row a period of the allocations: where its invoice is, and what was billed in its own unit before any conversion."""
    columns = ("period_id", "source_link", "billed_original", "original_unit", "factor", "source", "supplier_name")
    return allocations.select(*columns).dropDuplicates(["period_id"]).withColumn("source_link", source_label(F.col("source_link")))


def case_table(cases: DataFrame) -> DataFrame:
    """Cases as a report shows them: lists joined, the first links as columns."""
    links = {f"source_{i + 1}": F.get("source_links", F.lit(i)) for i in range(LINKS)}
    return cases.withColumns(links | {"periods": F.size("period_ids"), "source_files": F.array_join("source_files", "; ")}).drop("period_ids", "source_links")


def totals(allocations: DataFrame, levels: list[str]) -> DataFrame:
    """kWh by the levels and by each prefix of them, down to none; null where no amount is known. level counts the levels that a row is by."""
    rows = allocations.rollup(*levels).agg(F.sum("allocated_kwh").alias("kwh"), F.countDistinct("period_id").alias("periods"), F.count_if(F.col("allocated_kwh").isNull()).alias("unavailable"), F.grouping_id().alias("_tw_g"))
    return rows.withColumn("level", F.lit(len(levels)) - F.bit_count("_tw_g")).drop("_tw_g")


def options(df: DataFrame, level: str, **chosen: str | None) -> DataFrame:
    """The distinct values of a level under what is chosen above it."""
    return scoped(df, **chosen).where(~is_blank(F.col(level))).select(level).distinct()


def browsed(cases: DataFrame, issue: str | None = None, account: str | None = None, term: str = "") -> DataFrame:
    """Cases of an issue and account that hold a text in their account or a link."""
    found = F.lower("account").contains(term.lower()) | F.exists("source_links", lambda x: F.lower(x).contains(term.lower()))
    return scoped(cases, issue=issue, account=account).where(found if term else F.lit(True))
