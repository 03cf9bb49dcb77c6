"""Silver layers: fields by configuration, curated columns, cleaned texts, effective units, and manual entries in the same shape."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import energy_unit, is_blank, nullif_blank

# What data quality is called where nothing is said, the groups of scope 2, and what a reviewer is told of others.
ACTUAL = "Actual"
ACTIVITY_GROUPS = ("Electricity", "Steam", "Heat", "Cool")
ACTIVITY_MESSAGE = "Scope 2 activity group must be Electricity, Steam, Heat, or Cool."
# Other names of curated columns.
CURATED_ALIASES = {"createdDateTme": ("createdDateTme", "createdDateTime"), "lastUpdateDateTime": ("lastUpdateDateTime", "lastUpdatedDateTime"), "modelID": ("modelID", "modelId")}
# The columns of the curated layer, in its order.
CURATED_COLUMNS = (
    "invoice_id", "line_id", "data_quality", "division", "legal_entity", "unit_name", "account_number", "supplier_name",
    "consumption_start_date_1_normalized", "consumption_end_date_1_normalized", "consumption_start_date_2_normalized", "consumption_end_date_2_normalized",
    "quantity_1", "quantity_2", "quantity_3", "quantity_4", "quantity_5", "quantity_6", "quantity_unit_1", "consumption_unit", "consumption_quantity_unit", "quantity_unit_2",
    "total_amount", "solar_export", "solar_banking_charge", "solar_total_generation", "division_shorthand", "facility_type", "scope", "facility_identifier", "activity_group", "invoice_count",
    "source_file", "sharepoint_link", "status", "createdDateTme", "lastUpdateDateTime", "apiVersion", "modelID", "missing_fields", "low_confidence_fields", "approval_status", "manual_review_tag",
    "mapping_status", "mapping_method", "mapping_message", "extracted_account_number",
)
# Columns of a manual entry and what they are called in the silver layers.
MANUAL_COLUMNS = {
    "data_quality": "data_quality",
    "division": "division",
    "legal_entity_name": "legal_entity",
    "unit": "unit_name",
    "account_number": "account_number",
    "activity_group": "activity_group",
    "supplier_name": "supplier_name",
    "consumption_start_date": "consumption_start_date_1_normalized",
    "consumption_end_date": "consumption_end_date_1_normalized",
    "amount_of_energy_consumed": "aggregated_quantity_1",
    "energy_unit": "quantity_unit_1",
    "source_file": "source_file",
    "sharepoint_link": "sharepoint_link",
    "manual_entry_status": "status",
    "transaction_date": "createdDateTme",
    "reviewed_at": "lastUpdateDateTime",
    "invoice_id": "manual_entry_invoice_id",
    "line_id": "manual_entry_line_id",
    "reviewed_by": "manual_entry_reviewer",
    "review_comment": "manual_entry_comment",
}
MANUAL_TAG = "MANUAL_DATA_ENTRY"


@dataclass(frozen=True)
class FieldConfig:
    """A category's fields: source names by standard name, those of table lines, criticality for review, and cleaners."""

    fields: dict[str, list[str]]
    table: str | None = None
    table_fields: dict[str, list[str]] = field(default_factory=dict)
    criticality: dict[str, str] = field(default_factory=dict)
    cleaners: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    header: tuple[str, ...] = ("source_file", "line_id")
    tail: tuple[str, ...] = ()

    def bronze_columns(self) -> list[str]:
        """The order of bronze columns: header, each field with its confidence, table fields, tail."""
        pairs = [c for f in self.fields for c in (f, f"{f}_confidence")]
        return [*self.header, *pairs, *(f for f in self.table_fields if f not in self.fields), *self.tail]


def projected(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with exactly these columns, in this order; those it lacks are null."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))


def curated(df: DataFrame, columns: list[str], aliases: dict[str, tuple[str, ...]] = CURATED_ALIASES) -> DataFrame:
    """A fixed list of columns, each the first of its names that df has; a missing data_quality is ACTUAL, others are null."""

    def one(c: str) -> Column:
        found = next((a for a in aliases.get(c, (c,)) if a in df.columns), None)
        if found:
            return F.col(found).alias(c)
        return F.lit(ACTUAL if c == "data_quality" else None).cast("string").alias(c)

    return df.select(*map(one, columns))


def placed_after(df: DataFrame, columns: list[str], after: str) -> DataFrame:
    """df with some columns moved behind another; at the end if there is no such column."""
    rest = [c for c in df.columns if c not in columns]
    at = rest.index(after) + 1 if after in rest else len(rest)
    return df.select(*rest[:at], *columns, *rest[at:])


def with_data_quality(df: DataFrame) -> DataFrame:
    """df with data_quality, ACTUAL where blank, behind document_confidence."""
    value = F.coalesce(nullif_blank(F.col("data_quality")), F.lit(ACTUAL)) if "data_quality" in df.columns else F.lit(ACTUAL)
    return placed_after(df.withColumn("data_quality", value), ["data_quality"], "document_confidence")


def effective_unit(own: Column, mapped: Column) -> Column:
    """The unit that the invoice's text names, else the one its mapping names, else empty."""
    named = lambda c: F.coalesce(energy_unit(c), F.lit(""))
    return F.when(named(own) != "", named(own)).otherwise(named(mapped))


def with_quantity_unit(df: DataFrame) -> DataFrame:
    """df with consumption_quantity_unit behind consumption_unit, and that of a second period, which falls back to the first's."""
    first = df.withColumn("consumption_quantity_unit", effective_unit(F.col("quantity_unit_1"), F.col("consumption_unit")))
    fallback = F.coalesce(nullif_blank(F.col("consumption_unit")), F.col("consumption_quantity_unit"))
    both = first.withColumn("consumption_quantity_unit_2", effective_unit(F.col("quantity_unit_2"), fallback))
    return placed_after(both, ["consumption_quantity_unit", "consumption_quantity_unit_2"], "consumption_unit")


def cleaned(df: DataFrame, cleaners: dict[str, Callable[[Column], Column]], from_mapping: dict[str, Column] | None = None) -> DataFrame:
    """df with each column cleaned by its own function, except where its value came from the mapping; null stays null."""
    flags = from_mapping or {}
    return df.withColumns({c: F.when(flags.get(c, F.lit(False)), F.col(c)).otherwise(clean(F.col(c))) for c, clean in cleaners.items() if c in df.columns})


def validated_activity(df: DataFrame) -> DataFrame:
    """Mapped rows whose activity group is none of scope 2's become INCOMPLETE, with a message."""
    bad = (F.col("mapping_status") == "MAPPED") & ~F.coalesce(F.col("activity_group").isin(*ACTIVITY_GROUPS), F.lit(False))
    return df.withColumns({"mapping_message": F.when(bad, ACTIVITY_MESSAGE).otherwise(F.col("mapping_message")), "mapping_status": F.when(bad, "INCOMPLETE").otherwise(F.col("mapping_status"))})


def manual_rows(entries: DataFrame) -> DataFrame:
    """Manual entries in the shape of the silver layers; their own ids stay in manual_entry_* columns. Absent columns are null."""
    rows = projected(entries, list(MANUAL_COLUMNS)).withColumnsRenamed(MANUAL_COLUMNS)
    none = F.lit(None).cast("string")
    return rows.withColumns({
        "approval_status": F.col("status"), "manual_review_tag": F.lit(MANUAL_TAG), "consumption_unit": F.col("quantity_unit_1"), "quantity_unit_2": none,
        "consumption_quantity_unit": effective_unit(F.col("quantity_unit_1"), none), "manual_entry_data_quality": F.col("data_quality"), "manual_data_entry_portion": F.lit("Yes"),
    })


def confidence_summary(rows: DataFrame, fields: list[str], threshold: float) -> DataFrame:
    """rows with missing_fields, low_confidence_fields and needs_review; only a value that is there can be low."""
    missing = F.array_compact(F.array(*(F.when(is_blank(F.col(f).cast("string")), f) for f in fields)))
    low = F.array_compact(F.array(*(F.when(~is_blank(F.col(f).cast("string")) & (F.col(f"{f}_confidence") < threshold), f) for f in fields)))
    return rows.withColumns({"missing_fields": F.array_join(missing, ";"), "low_confidence_fields": F.array_join(low, ";"), "needs_review": (F.size(missing) > 0) | (F.size(low) > 0)})
