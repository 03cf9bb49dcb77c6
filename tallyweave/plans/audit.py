"""Allocation audit: every billed period against its monthly allocations, as cases with evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.dates import inclusive_days
from tallyweave.functions.text import is_blank
from tallyweave.functions.units import factor
from tallyweave.operators.periods import day_coverage

TOLERANCE_KWH, RELATIVE = 0.01, 1e-10
FACILITY = ["division", "legal_entity", "unit_name"]


def different(a: Column, b: Column, unit_factor: Column) -> Column:
    """Whether two quantities differ by more than 0.01 kWh, or a 1e-10 part; a null differs from all."""
    limit = F.greatest(TOLERANCE_KWH / F.coalesce(unit_factor, F.lit(1.0)), RELATIVE * F.greatest(F.abs(a), F.abs(b)))
    return F.coalesce(F.abs(a - b) > limit, F.lit(True))


# What a case is called.
MAPPING, INPUTS, UNIT = "Missing mapping", "Invalid invoice inputs", "Unsupported energy unit"
RECONCILIATION, REPEATED, CALCULATION, MONTH = "Invoice reconciliation", "Missing or repeated allocation", "Allocation calculation", "Invalid allocation month"
UNCOVERED, OVERLAPPING = "Missing coverage", "Overlapping billing periods"

PERIOD = ["period_id", *FACILITY, "account_number", "activity_group", "mapping_status", "start", "end", "quantity", "energy_unit"]
ALLOCATION = ["month", "split_start", "split_end", "split_days", "split_quantity"]


def allocation_cases(periods: DataFrame, allocations: DataFrame) -> DataFrame:
    """(issue, month, period_id) of every fault. Facility filters may come before; month filters only after.

    periods has the columns PERIOD, allocations has period_id and ALLOCATION; an allocation of no period is left to split_faults().
    """
    return joined_cases(periods.select(*PERIOD).join(allocations.select("period_id", *ALLOCATION), "period_id", "left"))


def joined_cases(rows: DataFrame, keep: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """allocation_cases() of periods that already stand beside their allocations, one row each; a period without any has nulls in ALLOCATION.

    Rows of a period meet once, in one aggregate, that gives the list of its issues. keep names columns of PERIOD that cases show, carry others that
    a period has one value of, so that periods need not be joined back.
    """
    start, end, month, f = F.col("start"), F.col("end"), F.col("month"), factor(F.col("energy_unit"))
    dated = F.coalesce(end >= start, F.lit(False))
    low, high = F.greatest(start, month), F.least(end, F.last_day(month))
    days = inclusive_days(low, high)
    share = F.col("quantity") / inclusive_days(start, end) * days
    outside = (month != F.trunc(month, "MM")) | (month < F.trunc(start, "MM")) | (month > end)
    wrong = (F.col("split_start") != low) | (F.col("split_end") != high) | (F.col("split_days") != days) | different(F.col("split_quantity"), share, f)
    listed = F.when(month.isNotNull(), F.struct(month.alias("month"), F.coalesce(outside, F.lit(True)).alias("outside"), F.coalesce(wrong, F.lit(True)).alias("wrong")))
    p = rows.groupBy(*PERIOD).agg(F.sum("split_quantity").alias("allocated"), F.count("month").alias("n"), F.sort_array(F.collect_set(listed)).alias("lines"), *(F.min(c).alias(c) for c in carry))
    blank = is_blank(F.col("account_number"))
    for c in FACILITY:
        blank |= is_blank(F.col(c))
    sound = dated & F.col("quantity").isNotNull()
    label = F.coalesce(F.date_format(start, "yyyy-MM"), F.lit("Unknown period"))
    want = F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month"))
    got = F.array_sort(F.array_distinct(F.transform("lines", lambda x: x["month"])))
    found = {
        MAPPING: blank | F.coalesce(F.col("mapping_status") != "MAPPED", F.lit(True)),
        INPUTS: ~sound,
        UNIT: f.isNull(),
        RECONCILIATION: sound & ((F.col("n") == 0) | different(F.col("allocated"), F.col("quantity"), f)),
        REPEATED: F.when(sound, F.coalesce((F.col("n") != F.size(want)) | (got != want), F.lit(True))).otherwise(F.lit(False)),
    }
    own = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(issue).alias("issue"), label.alias("month"))) for issue, test in found.items())))
    named = lambda issue: lambda x: F.struct(F.lit(issue).alias("issue"), F.date_format(x["month"], "yyyy-MM").alias("month"))
    strange = F.transform(F.filter("lines", lambda x: x["outside"]), named(MONTH))
    bad = F.transform(F.filter("lines", lambda x: ~x["outside"] & x["wrong"]), named(CALCULATION))
    lines = F.when(sound, F.concat(strange, bad)).otherwise(F.array().cast("array<struct<issue: string, month: string>>"))
    kept = ("period_id", *keep, *carry)
    return p.select(*kept, F.explode(F.concat(own, lines)).alias("x")).select("x.issue", "x.month", *kept)


def coverage_cases(periods: DataFrame, first: str, last: str) -> DataFrame:
    """(facility, account, activity, month, issue, days) of months with uncovered days or days in several periods.

    first and last are first days of months. Covered months are listed by key before months are counted out, so a join meets a row a key, not a row a key and month.
    """
    key = [*FACILITY, "account_number", "activity_group"]
    valid = periods.where(F.col("end") >= F.col("start"))
    span = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))
    keys = valid.select(*key).distinct()
    cut = valid.where((F.col("start") <= F.last_day(F.lit(last).cast("date"))) & (F.col("end") >= F.lit(first).cast("date")))
    cut = cut.withColumn("start", F.greatest("start", F.lit(first).cast("date"))).withColumn("end", F.least("end", F.last_day(F.lit(last).cast("date"))))
    line = F.struct("month", F.col("covered_days").alias("covered"), F.col("overlapping_days").alias("over"))
    got = day_coverage(cut, key).groupBy(*key).agg(F.collect_list(line).alias("lines"))
    same = F.lit(True)
    for k in key:
        same &= keys[k].eqNullSafe(got[k])
    rows = keys.join(got, same, "left").select(*(keys[c] for c in key), F.coalesce("lines", F.array().cast(got.schema["lines"].dataType)).alias("lines"))
    none = lambda m: F.struct(m.alias("month"), F.lit(0).cast("long").alias("covered"), F.lit(0).cast("long").alias("over"))
    empty = F.transform(F.array_except(span, F.transform("lines", lambda x: x["month"])), none)
    rows = rows.select(*key, F.explode(F.concat("lines", empty)).alias("x")).select(*key, "x.*")
    missing = F.dayofmonth(F.last_day("month")) - F.col("covered")
    kinds = F.array(F.struct(F.lit(UNCOVERED).alias("issue"), missing.cast("long").alias("days")), F.struct(F.lit(OVERLAPPING).alias("issue"), F.col("over").cast("long").alias("days")))
    return rows.withColumn("k", F.explode(F.filter(kinds, lambda k: k["days"] > 0))).select(*key, "month", "k.*")


def case_table(cases: DataFrame) -> DataFrame:
    """Cases with an id, one row for each issue, month and period."""
    return cases.dropDuplicates().withColumn("case_id", F.concat(F.lit("A-"), F.substring(F.sha2(F.concat_ws("|", "issue", "month", "period_id"), 256), 1, 10)))


def audit_summary(periods: DataFrame, by: list[str]) -> DataFrame:
    """Accounts, kWh, periods and periods without a kWh value; kWh is null where none has one."""
    rows = periods.withColumn("kwh", F.col("quantity") * factor(F.col("energy_unit")))
    return rows.groupBy(*by).agg(F.countDistinct("account_number").alias("accounts"), F.sum("kwh").alias("kwh"), F.countDistinct("row_id").alias("periods"), F.count_if(F.col("kwh").isNull()).alias("unavailable"))
