"""Energy units to kWh."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# kWh in one of each unit.
FACTORS = {"KWH": 1.0, "MWH": 1000.0, "TON": 720.0, "RTH": 0.62}


def factor(unit: Column, factors: dict[str, float] | None = None) -> Column:
    """kWh in one of a unit; null for a unit without a factor."""
    table = F.create_map(*(F.lit(x) for kv in (factors or FACTORS).items() for x in kv))
    return F.try_element_at(table, F.upper(F.trim(unit)))


def to_kwh(amount: Column, unit: Column, factors: dict[str, float] | None = None, strict: bool = False) -> Column:
    """amount in kWh; a unit without a factor gives null, or fails the job if strict."""
    f = factor(unit, factors)
    bad = F.raise_error(F.concat(F.lit("Unsupported energy unit: "), unit)).cast("double") if strict else F.lit(None).cast("double")
    return F.when(amount.isNull(), None).when(f.isNotNull(), amount * f).otherwise(bad)
