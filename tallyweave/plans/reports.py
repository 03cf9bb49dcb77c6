"""Year over year, high variance, completeness, and checks of what enters them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.dates import inclusive_days, to_date
from tallyweave.functions.numbers import completeness_class, difference_class, exported_difference, percent_difference
from tallyweave.functions.text import facility_key, is_blank, lookup_text, own_columns, trimmed
from tallyweave.functions.units import factor
from tallyweave.operators.periods import islands

FACILITY = ["division", "legal_entity", "unit_name"]


def months_of(ends) -> list[tuple[str, str]]:
    """The first days of all months from ends.first to ends.last, each with that of the year before; none if either is null."""
    if ends["first"] is None or ends["last"] is None:
        return []
    number = lambda d: d.year * 12 + d.month - 1
    return [tuple(f"{n // 12 - back:04d}-{n % 12 + 1:02d}-01" for back in (0, 1)) for n in range(number(ends["first"]), number(ends["last"]) + 1)]


def reporting_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows in kWh, rejected rows with reason) of a history table: facility, kpi, unit, amount, date, issue."""
    bad = (
        F.when(is_blank(F.col("kpi")), "missing KPI component")
        .when(factor(F.col("energy_unit")).isNull(), "unsupported energy unit")
        .when(F.col("amount").isNull() | F.isnan("amount") | (F.abs("amount") == float("inf")), "amount is not a finite number")
        .when(F.col("date").isNull(), "missing or invalid date")
        .when(is_blank(F.col("division")) | is_blank(F.col("legal_entity")) | is_blank(F.col("unit_name")), "missing facility")
        .when(~is_blank(F.col("issue")), "business mapping issue")
    )
    rows = df.withColumn("reject_reason", bad)
    good = rows.where(F.col("reject_reason").isNull()).drop("reject_reason").withColumn("kwh", F.col("amount") * factor(F.col("energy_unit")))
    return good, rows.where(F.col("reject_reason").isNotNull())


def monthly_values(df: DataFrame, value: str = "kwh") -> DataFrame:
    """Sums by normalised facility, KPI and month; rows with a blank part of the key are left out."""
    keys = {f"{c}_key": facility_key(F.col(c)) for c in FACILITY}
    rows = df.withColumns(keys)
    ok = ~is_blank(F.col("kpi"))
    for k in keys:
        ok &= ~is_blank(F.col(k))
    return rows.where(ok).groupBy(*keys, "kpi", F.trunc("date", "MM").alias("month")).agg(F.sum(value).alias(value))


def year_over_year(facilities: DataFrame, current: DataFrame, previous: DataFrame, months: list[tuple[str, str]]) -> DataFrame:
    """One row for each facility, KPI and month: current and previous kWh, difference, class and status.

    months: pairs of first days, (current, previous), a list that the caller chooses, so the grid grows with facilities alone. Values of a
    month are summed once and then stand in two places, as its own and as the month's before; where both tables are
    the same one it is read once.
    """
    pairs = F.array(*(F.struct(F.lit(a).cast("date").alias("month"), F.lit(b).cast("date").alias("before")) for a, b in months))
    keys = [f"{c}_key" for c in FACILITY] + ["kpi"]
    none = F.lit(None).cast("double")

    def placed(df: DataFrame, now: bool, then: bool) -> DataFrame:
        spots = F.flatten(F.transform(pairs, lambda p: F.filter(F.array(F.struct(p["month"].alias("at"), F.lit(True).alias("now"), p["month"].alias("from")), F.struct(p["month"].alias("at"), F.lit(False).alias("now"), p["before"].alias("from"))), lambda x: (x["from"] == F.col("month")) & (x["now"] & F.lit(now) | ~x["now"] & F.lit(then)))))
        rows = monthly_values(df).withColumn("x", F.explode(spots))
        return rows.select(*keys, F.col("x.at").alias("month"), F.when(F.col("x.now"), F.col("kwh")).otherwise(none).alias("current"), F.when(~F.col("x.now"), F.col("kwh")).otherwise(none).alias("previous"))

    values = placed(current, True, True) if previous is current else placed(current, True, False).union(placed(previous, False, True))
    values = values.groupBy(*keys, "month").agg(F.max("current").alias("current"), F.max("previous").alias("previous"))
    grid = facilities.select(*FACILITY, "kpi").distinct().withColumns({f"{c}_key": facility_key(F.col(c)) for c in FACILITY})
    rows = grid.withColumn("month", F.explode(F.transform(pairs, lambda p: p["month"]))).join(values, [*keys, "month"], "left")
    p = percent_difference(F.col("current"), F.col("previous"))
    status = F.when(F.col("current").isNull() & F.col("previous").isNull(), "no data").when(F.col("current").isNull(), "missing current").when(F.col("previous").isNull(), "missing previous").otherwise("compared")
    return rows.select(*FACILITY, "kpi", "month", "current", "previous", p.alias("difference"), difference_class(p).alias("class"), status.alias("status"))


def high_variance(cells: DataFrame, over: float = 0.10) -> DataFrame:
    """Cells whose difference exceeds a share, with its sort size."""
    return cells.where(F.abs("difference") > over).withColumn("size", F.abs("difference"))


def completeness(accounts: DataFrame, periods: DataFrame, months: list[str]) -> DataFrame:
    """Covered and expected account-days of each facility, KPI and month.

    accounts: facility, kpi, account_number, effective_start, effective_end (null: open). Accounts alike in facility, KPI and dates are counted before they
    meet the months, and periods are joined into islands before they are cut to months, so no table of accounts and months is made and no day
    table grows with long periods. An account that stands several times counts as often.
    """
    cell = [*FACILITY, "kpi", "month"]
    alike = accounts.groupBy(*FACILITY, "kpi", "effective_start", "effective_end").agg(F.count("*").alias("n"))
    due = alike.withColumn("month", F.explode(F.array(*(F.lit(m).cast("date") for m in months))))
    low, high = F.greatest(F.coalesce("effective_start", "month"), F.col("month")), F.least(F.coalesce("effective_end", F.last_day("month")), F.last_day("month"))
    due = due.groupBy(*cell).agg(F.sum(F.col("n") * F.greatest(inclusive_days(low, high), F.lit(0))).alias("expected_days"))
    key = [*FACILITY, "kpi", "account_number"]
    held = accounts.groupBy(*key).agg(F.count("*").alias("n"), F.collect_set(F.struct("effective_start", "effective_end")).alias("spans"))
    rows = periods.where(F.col("end") >= F.col("start")).select(*key, "start", "end").join(held, key).withColumn("span", F.explode("spans"))
    rows = rows.select(*key, "n", F.greatest("start", "span.effective_start").alias("start"), F.least("end", "span.effective_end").alias("end"))
    cut = islands(rows, [*key, "n"]).withColumn("month", F.explode(F.sequence(F.trunc("_tw_s", "MM"), "_tw_e", F.expr("interval 1 month"))))
    cut = cut.where(F.col("month").isin(*(F.lit(m).cast("date") for m in months)))
    days = inclusive_days(F.greatest("_tw_s", "month"), F.least("_tw_e", F.last_day("month")))
    got = cut.groupBy(*cell).agg(F.sum(F.col("n") * days).alias("covered_days"))
    out = due.join(got, cell, "left").select(*cell, F.coalesce("covered_days", F.lit(0)).alias("covered_days"), "expected_days")
    ratio = F.try_divide(F.col("covered_days").cast("double"), F.when(F.col("expected_days") > 0, F.col("expected_days")))
    return out.withColumn("ratio", ratio).withColumn("class", completeness_class(ratio))


# What is wrong with an expected account; of several the last counts.
ACCOUNT_FAULTS = (
    "Missing expected account number",
    "Invalid effective_start_date in the shared account mapping",
    "Invalid effective_end_date in the shared account mapping",
    "Account effective end date precedes its start date",
    "Duplicate facility/KPI/account rows in the shared mapping",
)


def expected_accounts(accounts: DataFrame) -> DataFrame:
    """accounts with issue, and effective_start and effective_end as dates: missing account, invalid or reversed dates, duplicates.

    Facilities and KPIs are compared without case, marks and spacing, accounts without case and spacing; blank accounts can be duplicates too.
    """
    own_columns(accounts)
    rows = accounts.withColumns({f"_tw_{c}": facility_key(F.coalesce(F.col(c), F.lit(""))) for c in [*FACILITY, "kpi"]} | {"_tw_account": F.coalesce(lookup_text(F.col("account_number")), F.lit(""))})
    keys = [c for c in rows.columns if c.startswith("_tw_")]
    repeated = rows.groupBy(*keys).agg(F.count("*").alias("_tw_n")).where("_tw_n > 1")
    rows = rows.join(repeated, keys, "left")
    dates = {c: to_date(F.col(c)) for c in ("effective_start", "effective_end")}
    bad = [~is_blank(F.col(c).cast("string")) & d.isNull() for c, d in dates.items()]
    tests = [F.col("_tw_account") == "", *bad, dates["effective_end"] < dates["effective_start"], F.col("_tw_n") > 1]
    issue = F.lit("")
    for test, text in zip(tests, ACCOUNT_FAULTS, strict=True):
        issue = F.when(test, text).otherwise(issue)
    rows = rows.withColumn("issue", issue)
    return rows.withColumns(dates).select(*accounts.columns, "issue")


def by_month(cells: DataFrame, value: Column, labels: list[str], form: str = "MMM yyyy", by: tuple[str, ...] = ()) -> DataFrame:
    """Export form: a column a month of a fixed list of labels, written in a form; further columns tell rows apart, such as a year."""
    own_columns(cells)
    return cells.withColumn("_tw_label", F.date_format("month", form)).groupBy(*FACILITY, "kpi", *by).pivot("_tw_label", labels).agg(F.first(value))


def completeness_tiles(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Over the cells of completeness(): facilities, those with any covered day, complete and partial months.

    Facilities are told apart without case, marks and spacing. Months without expected days count as neither. Of no cells and no columns to
    group by there is one row of zeros. Facilities are made distinct before they are counted.
    """
    own_columns(cells)
    names = F.struct(*(F.coalesce(facility_key(F.col(c)), F.lit("")) for c in FACILITY))
    ratio = F.col("ratio")
    each = cells.groupBy(*by, names.alias("_tw_f")).agg(F.max(F.col("covered_days") > 0).alias("_tw_any"), F.count_if(ratio >= 1).alias("_tw_c"), F.count_if((ratio > 0) & (ratio < 1)).alias("_tw_p"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return each.groupBy(*by).agg(F.count("*").alias("facilities"), F.count_if("_tw_any").alias("facilities_with_data"), total("_tw_c").alias("complete_months"), total("_tw_p").alias("partial_months"))


def approval_counts(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Approved rows, and how many of them a rule and how many a reviewer approved."""
    s = F.col("approval_status")
    return rows.groupBy(*by).agg(F.count("*").alias("approved"), F.count_if(s == "AUTO_APPROVED").alias("auto_approved"), F.count_if(s == "MANUALLY_APPROVED").alias("manually_approved"))


def category_dashboard(summary: DataFrame, by: list[str]) -> DataFrame:
    """Counts and a status ladder for each category."""
    s = F.col("review_status")
    out = summary.groupBy(*by).agg(F.count("*").alias("lines"), F.count_if(s == "BLOCKED").alias("blocked"), F.count_if(s == "REVIEW_REQUIRED").alias("to_review"), F.count_if(s == "AUTO_APPROVED").alias("approved"))
    status = F.when(F.col("lines") == 0, "No data").when(F.col("blocked") > 0, "Needs attention").when(F.col("to_review") > 0, "In progress").otherwise("Ready")
    return out.withColumn("status", status)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of a sorted report."""
    return df.orderBy(*order).offset(number * size).limit(size)


def active_accounts(accounts: DataFrame, active: DataFrame) -> DataFrame:
    """Expected accounts of active facilities; names are compared without case, marks and spacing."""
    key = lambda df: df.select("*", *(facility_key(F.col(c)).alias(f"_tw_{c}") for c in FACILITY))
    own_columns(accounts)
    return key(accounts).join(key(active.select(*FACILITY)).select(*(f"_tw_{c}" for c in FACILITY)).distinct(), [f"_tw_{c}" for c in FACILITY], "left_semi").select(accounts.columns)


def all_facilities(expected: DataFrame, seen: DataFrame) -> DataFrame:
    """Every facility that is expected or seen, once."""
    return expected.select(*FACILITY).union(seen.select(*FACILITY)).dropDuplicates()


def monthly_sources(rows: DataFrame) -> DataFrame:
    """The distinct files (told apart without case, parts of texts counted singly) and links of each facility, KPI and month, in order.

    rows: facility, kpi, date, source_files (text with semicolons), source_link. Parts are made distinct before they are gathered.
    """
    keys = {f"{c}_key": facility_key(F.col(c)) for c in FACILITY}
    rows = rows.withColumns(keys | {"month": F.trunc("date", "MM")}).where(F.col("unit_name_key").isNotNull() & (F.col("unit_name_key") != ""))
    key = [*keys, "kpi", "month"]
    parts = rows.select(*key, "source_link", F.explode_outer(F.transform(F.split("source_files", ";"), lambda x: F.lower(trimmed(x)))).alias("file"))
    distinct = parts.groupBy(*key, F.when(F.col("file") != "", F.col("file")).alias("file"), "source_link").agg(F.lit(1).alias("n"))
    return distinct.groupBy(*key).agg(F.array_sort(F.collect_set("file")).alias("sources"), F.array_sort(F.collect_set("source_link")).alias("links"))


def variance_report(cells: DataFrame, current: DataFrame, previous: DataFrame, over: float = 0.10) -> DataFrame:
    """high_variance() cells beside the files of their month and of the same month a year before, and the links of their month.

    current and previous are monthly_sources(), which may be one table. Files are joined by line ends, and a cell without any has empty text and
    no links. For a report sort by size, largest first, then facility, KPI and month.
    """
    own_columns(cells)
    keys = {f"{c}_key": facility_key(F.col(c)) for c in FACILITY}
    key = [*keys, "kpi", "month"]
    now = current.select(*key, F.col("sources").alias("_tw_now"), "links")
    then = previous.withColumn("month", F.add_months("month", 12)).select(*key, F.col("sources").alias("_tw_then"))
    rows = high_variance(cells, over).withColumns(keys).join(now, key, "left").join(then, key, "left")
    files = {"current_files": "_tw_now", "previous_files": "_tw_then"}
    shown = F.coalesce("links", F.array().cast("array<string>"))
    return rows.select(*FACILITY, "kpi", "month", "previous", "current", exported_difference(F.col("difference")).alias("difference"), "size", *(F.coalesce(F.array_join(c, "\n"), F.lit("")).alias(n) for n, c in files.items()), shown.alias("links"))


def matching_facilities(cells: DataFrame, term: str) -> DataFrame:
    """Cells whose facility holds a text, without case, marks and spacing."""
    return cells.where(facility_key(F.concat_ws(" ", *FACILITY)).contains(term.lower()))


def tiles(cells: DataFrame) -> DataFrame:
    """Counts of a dashboard's cells by KPI: all, compared, without a previous value, and over 10 %."""
    status = F.col("status")
    return cells.groupBy("kpi").agg(F.count("*").alias("cells"), F.count_if(status == "compared").alias("compared"), F.count_if(status == "missing previous").alias("missing_previous"), F.count_if(F.abs("difference") > 0.10).alias("over_10"))


def column_slice(df: DataFrame, first: str, last: str, more: list[str]) -> DataFrame:
    """The columns from first to last in df's order, then some others."""
    at, to = df.columns.index(first), df.columns.index(last)
    return df.select(*df.columns[at : to + 1], *more)


def decision_type(df: DataFrame, column: str = "issue_id") -> DataFrame:
    """df with decision_type: whether a row's decision is a reviewer's own or answers an issue."""
    return df.withColumn("decision_type", F.when(F.col(column).startswith("override_"), "Manual override").otherwise("Review decision"))
