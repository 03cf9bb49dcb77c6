"""The allocation audit as one report: details, summary, cases and what it rests on, from one pass over the billed periods."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallyweave.operators import numbering, periods

from . import audit, scope

SPLIT = ("month", "split_start", "split_end", "split_days", "split_quantity")
RAW = ("account_number", "activity_group", "mapping_status", "quantity", "energy_unit")
ORDER = [*audit.FACILITY, "kpi_component", "account", "month", "start", "period_id"]
LEVELS = ("division", "legal_entity", "unit_name", "kpi_component", "account", "source")


@dataclass(frozen=True)
class Wanted:
    """What a report is about: months from first to last (their first days), and the values that rows must have; None asks for nothing."""

    first: str
    last: str
    division: str | None = None
    legal_entity: str | None = None
    unit_name: str | None = None
    kpi_component: str | None = None
    account: str | None = None
    source: str | None = None

    def levels(self) -> dict[str, str | None]:
        return {k: getattr(self, k) for k in LEVELS}

    def text(self) -> str:
        chosen = [f"{k} {v or 'blank'}" for k, v in self.levels().items() if v is not None]
        return f"{'; '.join(chosen) or 'all rows'}; {self.first[:7]} to {self.last[:7]}"


@dataclass
class Report:
    """rows: the wanted periods beside their months, written once; the other tables are read from it."""

    wanted: Wanted
    rows: DataFrame
    seen: dict[str, object]
    spill: Callable[[DataFrame], DataFrame]

    def details(self) -> DataFrame:
        """The allocations of the months, numbered from 1 in the report's order."""
        inside = self.rows.where(F.col("month").between(F.lit(self.wanted.first).cast("date"), F.lit(self.wanted.last).cast("date")))
        return numbering.numbered(inside, ORDER, self.spill)

    def summary(self) -> DataFrame:
        """A row a facility and KPI: accounts, kWh (null where none is known), periods, and allocations without an amount in kWh."""
        inside = self.rows.where(F.col("month").between(F.lit(self.wanted.first).cast("date"), F.lit(self.wanted.last).cast("date")))
        return inside.groupBy(*audit.FACILITY, "kpi_component").agg(
            F.countDistinct("account").alias("accounts"), F.sum("allocated_kwh").alias("kwh"), F.countDistinct("period_id").alias("periods"), F.count_if(F.col("allocated_kwh").isNull()).alias("unavailable"),
        )

    def cases(self, carry: tuple[str, ...] = ()) -> DataFrame:
        """(issue, month, division, legal_entity, unit_name, account_number, activity_group, period_id, days) of all faults, and of the columns to carry the period's value.

        Whole periods are checked, also where they reach beyond the months; faults of a month count if it is one of them. Months that are not covered,
        or covered twice, belong to an account, not to a period, and have days.
        """
        listed = [*audit.FACILITY, "account_number", "activity_group"]
        first, last = self.wanted.first, self.wanted.last
        found = audit.joined_cases(self.rows, tuple(listed), carry)
        in_months = F.col("month").between(first[:7], last[:7])
        own = found.where(~F.col("issue").isin(*scope.MONTHLY) | in_months).withColumn("days", F.lit(None).cast("long"))
        whole = self.rows.select("period_id", *listed, "start", "end").distinct()
        none = {c: F.lit(None).cast(self.rows.schema[c].dataType) for c in carry}
        gaps = audit.coverage_cases(whole, first, last).withColumns({"month": F.date_format("month", "yyyy-MM"), "period_id": F.lit(None).cast("string")} | none)
        names = ["period_id", "issue", "month", *listed, "days", *carry]
        return own.select(*names).unionByName(gaps.select(*names))

    def information(self, warnings: tuple[str, ...] = (), files: DataFrame | None = None) -> DataFrame:
        """(place, item, value): scope, counts, kWh by KPI, warnings and the files (path, modificationTime, sha256) behind the rows, in order."""
        spark = self.rows.sparkSession
        fixed = [("scope", self.wanted.text()), ("periods and months read", str(self.seen["rows"])), ("without an amount in kWh", str(self.seen["unavailable"])), *(("warning", w) for w in warnings)]
        out = spark.createDataFrame([(1, *x) for x in fixed], "place int, item string, value string")
        text = lambda c: F.format_number(c, 2)
        out = out.union(self.cases().groupBy("issue").count().select(F.lit(2), F.concat(F.lit("cases: "), "issue"), F.col("count").cast("string")))
        out = out.union(self.summary().groupBy("kpi_component").agg(F.sum("kwh").alias("kwh")).select(F.lit(3), F.concat(F.lit("kWh: "), "kpi_component"), text(F.col("kwh") + 1e-7)))
        if files is not None:
            out = out.union(files.select(F.lit(4), F.col("path"), F.concat_ws(" ", F.date_format("modificationTime", "yyyy-MM-dd HH:mm:ss"), "sha256")))
        return out


def build(records: DataFrame, wanted: Wanted, spill: Callable[[DataFrame], DataFrame]) -> Report:
    """A report on resolved periods (row_id, the columns of scope.audit_periods). They are read once: what they add up to is observed as they are written."""
    rows = scope.audit_periods(periods.month_split(records, keep_unsplit=True), (*SPLIT, *RAW))
    rows = scope.scoped(scope.allocated(rows), **wanted.levels())
    seen = Observation()
    observed = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("allocated_kwh").isNull()).alias("unavailable"))
    return Report(wanted, spill(observed), seen.get, spill)
