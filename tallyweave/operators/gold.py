"""Gold: amounts in kWh, and their aggregate by facility, month and component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import own_columns
from tallyweave.functions.units import factor, to_kwh

from .rollup import SHARE_KPIS, VALUE_KPIS

GOLD_KEY = ["division", "legal_entity", "unit_name", "month", "KPI Component"]
AMOUNTS = ("Amount of energy consumed", "Total amount of energy consumed", "solar_total_generation", "total_solar_consumed")
#: What tells two sources of a gold row apart: manual entries, other splits and other files are sources of their own.
SOURCE = ["account_number", "supplier_name", "Original Energy Unit", "flow", "split_digest", "source_files"]


def gold_template(template: DataFrame) -> DataFrame:
    """Template rows without issues, amounts in kWh; the unit before stays in Original Energy Unit. Applying it again changes nothing."""
    rows = template.where((F.col("business_mapping_issue") == "") & factor(F.col("energy_unit")).isNotNull())
    if "Original Energy Unit" not in rows.columns:
        rows = rows.withColumn("Original Energy Unit", F.col("energy_unit"))
    return rows.withColumns({c: to_kwh(F.col(c), F.col("energy_unit")) for c in AMOUNTS}).withColumn("energy_unit", F.lit("kWh"))


def gold_aggregated(gold: DataFrame) -> DataFrame:
    """One row a facility, month and component. Solar KPIs stay out of the total; shares are weighted anew by amounts.

    Solar amounts and component counts repeat on every KPI row of a source, so rows are first summed by source, and sources then by
    key: one pass, without a join. source_file_count counts distinct files, told apart without case, over all sources.
    """
    own_columns(gold)
    kwh = gold.where(F.lower(F.trim("energy_unit")) == "kwh")
    amount, kpi = F.col("Amount of energy consumed"), F.col("Energy KPI")
    kpis = [*SHARE_KPIS.values(), *VALUE_KPIS.values()]
    by_source = kwh.groupBy(*GOLD_KEY, *SOURCE).agg(
        *(F.sum(F.when(kpi == k, amount)).alias(f"_tw_{i}") for i, k in enumerate(kpis)),
        *(F.max(kpi == k).alias(f"_tw_has_{i}") for i, k in enumerate(kpis)),
        *(F.max(c).alias(c) for c in ("solar_total_generation", "total_solar_consumed", "proration_component_count")),
    )
    # a source's numbers stand on the row of its first file only
    files = by_source.select("*", F.posexplode_outer("source_files").alias("_tw_at", "_tw_file"))
    once = lambda c: F.sum(F.when(F.coalesce("_tw_at", F.lit(0)) == 0, F.col(c)))
    shares = list(enumerate(SHARE_KPIS))
    sums = files.groupBy(*GOLD_KEY).agg(
        *(once(f"_tw_{i}").alias(f"_tw_{i}") for i, _ in shares),
        *(F.max(f"_tw_has_{i}").alias(f"_tw_has_{i}") for i in range(len(kpis))),
        *(once(c).alias(c) for c in ("solar_total_generation", "total_solar_consumed", "proration_component_count")),
        F.countDistinct(F.lower("_tw_file")).alias("source_file_count"),
    )
    present = F.when(F.greatest(*(F.col(f"_tw_{i}").isNotNull() for i, _ in shares)), sum((F.coalesce(f"_tw_{i}", F.lit(0.0)) for i, _ in shares), F.lit(0.0)))
    named = F.array_sort(F.array_compact(F.array(*(F.when(F.col(f"_tw_has_{i}"), k) for i, k in enumerate(kpis)))))
    sums = sums.withColumn("Total amount of energy consumed", present)
    total = F.col("Total amount of energy consumed")
    return sums.select(
        *GOLD_KEY, total.alias("Amount of energy consumed"), total, *(F.try_divide(F.coalesce(f"_tw_{i}", F.lit(0.0)), total).alias(c) for i, c in shares),
        F.array_join(named, "; ").alias("Energy KPI"), "solar_total_generation", "total_solar_consumed", "proration_component_count", "source_file_count",
    )
