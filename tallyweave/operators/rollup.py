"""Monthly rollup of splits, energy-source allocation and the KPI rows of the reporting template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import is_blank, lookup_text, nullif_blank, own_columns, trimmed
from tallyweave.functions.units import factor

MONTHLY_KEY = ["division", "legal_entity", "unit_name", "supplier_name", "account_number", "activity_group", "energy_unit", "month"]
SHARES = ("fossil_fuel_%", "renewable_energy_%", "nuclear_%")
# The KPI each share or amount becomes; the last two serve electricity only and stay out of totals.
SHARE_KPIS = dict(zip(SHARES, ("Fossil Fuels", "Renewable sources", "Nuclear sources"), strict=True))
VALUE_KPIS = {"solar_total_generation": "Renewable energy production", "total_solar_consumed": "Consumption of self-generated non-fuel renewable energy"}
# What is wrong with the shares of a row.
MISSING_SHARES = "missing allocation percentages"
OUTSIDE_SHARES = "allocation percentages must be fractions between 0 and 1"
UNEQUAL_SHARES = "allocation percentages must total 1 (100%)"
MISSING_UNIT = "no supported extracted or mapped unit"


def in_first_order(items: Column, key=lambda x: x) -> Column:
    """The distinct values of an array in the order they first appear, told apart by key(value)."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def joined_distinct(value: Column, order: Column, separator: str = "; ") -> Column:
    """Distinct values of a group in the order they first appear, joined; case counts."""
    return F.concat_ws(separator, F.array_distinct(_ordered(value, order)))


def joined_parts(value: Column, order: Column, separator: str = "; ") -> Column:
    """Distinct parts of a group's texts, which may hold several between semicolons, joined in order; the first spelling of a part stays."""
    return parts_of(_ordered(value, order), separator)


def parts_of(texts: Column, separator: str = "; ") -> Column:
    """joined_parts() of an array of texts in their order."""
    parts = F.flatten(F.transform(texts, lambda v: F.transform(F.split(v, ";"), trimmed)))
    return F.concat_ws(separator, in_first_order(F.filter(parts, lambda x: x != ""), F.lower))


def first_in_order(value: Column, order: Column) -> Column:
    """The first value of a group that is not blank."""
    return F.min_by(value, F.when(~is_blank(value.cast("string")), order))


def _ordered(value: Column, order: Column) -> Column:
    pairs = F.collect_list(F.when(~is_blank(value.cast("string")), F.struct(order.alias("o"), value.alias("v"))))
    return F.transform(F.array_sort(pairs), lambda x: x["v"])


def passes_mapping_gate() -> Column:
    """Whether a row may be billed: its mapping_status is blank or MAPPED."""
    return is_blank(F.col("mapping_status")) | (F.col("mapping_status") == "MAPPED")


def monthly_rollup(splits: DataFrame, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Sums and coverage of the billable splits of an account and month (and extra keys), with a digest of the splits and their files.

    Rows that are not mapped are left out: splits keep them, amounts must not. Covered days count each day once: splits lie within
    one month, so at most 31 day numbers are kept for a group. The digest does not depend on order; operators.lineage has the splits themselves.
    """
    days = F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.dayofmonth("split_start"), F.dayofmonth("split_end"))))))
    files = F.array_sort(F.collect_set(nullif_blank(F.col("invoice_id"))))
    out = splits.where(passes_mapping_gate()).groupBy(*MONTHLY_KEY, *extra_keys).agg(
        F.sum("split_quantity").alias("monthly_consumption"),
        F.count("*").alias("proration_component_count"),
        files.alias("source_files"),
        F.bit_xor(F.xxhash64("row_id", "split_start", "split_end")).alias("split_digest"),
        F.min("row_id").alias("first_row_id"),
        days.alias("covered_days_in_month"),
    )
    out = out.withColumns({"source_file_count": F.size("source_files").cast("long"), "calendar_days_in_month": F.dayofmonth(F.last_day("month"))})
    return out.withColumn("complete_month_data_captured", F.col("covered_days_in_month") >= F.col("calendar_days_in_month"))


def allocation_issue() -> Column:
    """What is wrong with the three shares of a row; empty if nothing."""
    shares = [F.col(f"`{s}`") for s in SHARES]
    missing = shares[0].isNull() | shares[1].isNull() | shares[2].isNull()
    outside = F.greatest(*shares) > 1
    for s in shares:
        outside |= (s < 0) | F.isnan(s)
    total = F.abs(shares[0] + shares[1] + shares[2] - 1) > 1e-6
    return (
        F.when(missing, MISSING_SHARES)
        .when(outside, OUTSIDE_SHARES)
        .when(total, UNEQUAL_SHARES)
        .otherwise("")
    )


def business_rows(monthly: DataFrame) -> DataFrame:
    """Template columns and all issues that keep a row from being reported: its unit, its shares, its contract.

    monthly has shares, lookup_issue and solar amounts, and contract_issue where contracts were looked up. Of an unclear lookup and wrong
    shares the lookup is named.
    """
    own_columns(monthly)
    electric = lookup_text(F.col("activity_group")) == "electricity"
    solar = F.col("solar_total_generation") - F.coalesce("solar_export", F.lit(0.0))
    shares = F.when(F.col("lookup_issue") != "", F.col("lookup_issue")).otherwise(allocation_issue())
    found = {"Energy unit": F.when(factor(F.col("energy_unit")).isNull(), MISSING_UNIT), "Energy source allocation": F.when(shares != "", shares)}
    if "contract_issue" in monthly.columns:
        found["Contract"] = nullif_blank(F.col("contract_issue"))
    issue = F.concat_ws("; ", *(F.concat(F.lit(f"{what}: "), c) for what, c in found.items()))
    # bound by inline, one row for one: the filters on issues that follow do not make them again
    rows = monthly.select(*(F.col(f"`{c}`") for c in monthly.columns if c != "business_mapping_issue"), F.inline(F.array(F.struct(issue.alias("business_mapping_issue"), electric.alias("_tw_electric")))))
    electric = F.col("_tw_electric")
    return rows.withColumns({
        "KPI Component": F.concat(F.lit("Purchased "), F.lower("activity_group")),
        "total_solar_consumed": F.when(electric, solar),
        "solar_total_generation": F.when(electric, F.col("solar_total_generation")),
    })


def kpi_template(business: DataFrame) -> DataFrame:
    """One row a KPI: shares of the amount, and for electricity the solar amounts; flagged rows once, without KPI and amount."""
    total = F.col("monthly_consumption")
    shares = [F.struct(F.lit(k).alias("kpi"), (total * F.col(f"`{c}`")).alias("amount")) for c, k in SHARE_KPIS.items()]
    values = [F.struct(F.lit(k).alias("kpi"), F.col(c).cast("double").alias("amount")) for c, k in VALUE_KPIS.items()]
    none = F.array(F.struct(F.lit(None).cast("string").alias("kpi"), F.lit(None).cast("double").alias("amount")))
    all_rows = F.when(F.col("business_mapping_issue") != "", none).when(F.col("_tw_electric"), F.array(*shares, *values)).otherwise(F.array(*shares))
    rows = business.withColumn("_tw_k", F.explode(all_rows))
    return rows.withColumns({"Energy KPI": F.col("_tw_k.kpi"), "Amount of energy consumed": F.col("_tw_k.amount"), "Total amount of energy consumed": total}).drop("_tw_k", "_tw_electric", "monthly_consumption")


def template_output(template: DataFrame) -> DataFrame:
    """Rows with a number other than zero and no issue."""
    return template.where((F.col("Amount of energy consumed") != 0) & (F.col("business_mapping_issue") == ""))
