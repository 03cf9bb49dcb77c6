"""Everything that keeps an amount from being reported, as one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import is_blank
from tallyweave.functions.units import factor
from tallyweave.operators.rollup import MISSING_UNIT

UNIT_MESSAGE = f"Energy unit: {MISSING_UNIT}"
COLUMNS = ["category", "mapping_status", "mapping_message", "division", "legal_entity", "unit_name", "account_number", "activity_group", "source_file"]


def unmapped_rows(rows: DataFrame, mapped: list[str]) -> DataFrame:
    """Rows whose mapped columns are all blank, whose status is neither blank nor MAPPED, or whose unit is not supported."""
    blank = reduce(lambda a, b: a & b, (is_blank(F.col(c).cast("string")) for c in mapped))
    status = ~is_blank(F.col("mapping_status")) & (F.col("mapping_status") != "MAPPED")
    unit = factor(F.col("energy_unit")).isNull()
    return rows.where(blank | status | unit).withColumn("mapping_message", F.when(unit, UNIT_MESSAGE).otherwise(F.col("mapping_message")))


def missing_mappings(category: str, invoices: DataFrame, business: DataFrame, accounts: DataFrame, history: DataFrame) -> DataFrame:
    """The union of invoice rows without a mapping, business rows with an issue, faulty expected accounts and rejected history.

    business has business_mapping_issue, accounts has issue, history has reject_reason. Columns that a part lacks are null.
    """
    none = F.lit(None).cast("string")

    def part(df: DataFrame, **named) -> DataFrame:
        rows = df.withColumns(named | {"category": F.lit(category)})
        return rows.select(*((F.col(c) if c in rows.columns else none).alias(c) for c in COLUMNS))

    parts = [
        part(invoices),
        part(business.where(~is_blank(F.col("business_mapping_issue"))), mapping_status=F.lit("BUSINESS_MAPPING"), mapping_message=F.col("business_mapping_issue")),
        part(accounts.where(~is_blank(F.col("issue"))), mapping_status=F.lit("REPORTING_MAPPING"), mapping_message=F.col("issue"), activity_group=F.col("kpi")),
        part(history, mapping_status=F.lit("REPORTING_DATA"), mapping_message=F.concat(F.lit("previous_data: "), "reject_reason"), activity_group=F.col("kpi")),
    ]
    return reduce(DataFrame.unionByName, parts)
