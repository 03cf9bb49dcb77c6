"""Registered queries of state that is kept and changed: arrivals, layers, the decision log, rows set aside; with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import text
from tallyweave.operators import constraints, decision_log, enrich, gold, lineage, periods, review, rollup
from tallyweave.sources import layers, lens, sinks
from tallyweave.streaming import ingest

from . import scope
from .oracle_parts import ALLOCATED, BRONZE_SQL, MONTHLY, PERIODS_SQL, QUALITY, RESOLVED, SPLITS, TEMPLATE, with_parts
from .shared import scratch, spill

FIELDS = {"account_number": "critical", "supplier_name": "optional", "energy_unit": "noncritical", "quantity": "critical"}


def late_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all periods arrives late, as a stream that is stopped and started again between two waves; the history ends as if all had been there."""
    rows, path = lens.periods(spark, sf_dir), scratch(spark, "history")
    late = F.col("part_key") % 10 == 3
    ingest.begin_history(rows.where(~late), f"{path}/table")
    for wave in (0, 1):
        rows.where(late & (F.floor(F.col("part_key") / 10) % 2 == wave)).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        ingest.late_stream(stream, f"{path}/table", path)
    return spark.read.parquet(f"{path}/table").select("row_id", *ingest.RESOLUTION)


def document_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each supplier, added in two waves with a run after each and one more without any; every eleventh file is cut off, every thirteenth empty."""
    s, path = lens.table(spark, sf_dir, "supplier"), scratch(spark, "ingest")
    whole = F.concat(F.lit('{"status":"ok","fields":{"Account":{"valueString":"'), "s_name", F.lit('","confidence":0.5}}}'))
    k = F.col("s_suppkey")
    json = F.when(k % 13 == 0, "").when(k % 11 == 0, F.substring(whole, 1, 40)).otherwise(whole)
    docs = s.select(F.concat(json, F.lit("\n")).alias("json"), F.concat(F.lit("name=doc-"), k, F.lit(".txt")).alias("name"), (k % 3 == 0).cast("int").alias("wave"))
    docs = docs.repartition(4 * spark.sparkContext.defaultParallelism, "name")
    for wave in (0, 1, 2):
        if wave < 2:
            sinks.write_texts(docs.where(F.col("wave") == wave), f"{path}/in/wave={wave}", "name", "json")
        ingest.ingest_documents(spark, f"{path}/in", f"{path}/out", "*.txt")
    name = F.regexp_extract("source_path", "name=([^/]+)[.]txt$", 1).alias("document")
    good = ingest.ingested(spark, f"{path}/out").select(name, F.lit("document").alias("kind"), F.col("fields")["Account"]["valueString"].alias("account"))
    bad = ingest.ingested(spark, f"{path}/out", "corrupt").select(name, F.lit("corrupt").alias("kind"), F.lit(None).cast("string").alias("account"))
    return good.union(bad).groupBy("document", "kind", "account").agg(F.count("*").alias("times"))


def decision_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of four versions: decisions on all issues, changes of some, a compaction, deletions and overrides; its state now and after the first version."""
    rows, path = lens.bronze_rows(spark, sf_dir), scratch(spark, "log")
    issues = review.review_issues(review.field_quality(rows, FIELDS)).join(rows.select("invoice_id", "line_id", "part_key"), ["invoice_id", "line_id"])
    issues = spill(spark)(issues.select("issue_id", "invoice_id", "line_id", "field_name", "ocr_value", "part_key"))  # three versions read it
    k, null = F.col("part_key"), F.lit(None)
    decision_log.append(spark, path, 1, decision_log.decisions(issues, null, F.when(k % 2 == 0, "APPROVED").otherwise("REJECTED"), "2024-01-01"))
    decision_log.append(spark, path, 2, decision_log.decisions(issues.where("part_key % 5 = 0"), F.concat(F.lit("FIX-"), k), F.lit("CORRECTED"), "2024-01-02"))
    decision_log.compact(spark, path, 2)
    decision_log.append(spark, path, 3, decision_log.deletions(issues.where("part_key % 15 = 0"), "2024-01-03"))
    decision_log.append(spark, path, 4, decision_log.overrides(rows.where("part_key % 4 = 1"), "quantity", F.lit("0"), "2024-01-04"))
    now = decision_log.state(spark, path).withColumn("version", F.lit(4))
    return now.unionByName(decision_log.state(spark, path, 1).withColumn("version", F.lit(1))).select("version", "issue_id", "original_value", "corrected_value", "review_decision", "reviewed_at")


def _crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All periods as those of one account: four sequences hold every mapped row."""
    one = {c: F.lit("one") for c in ("division", "legal_entity", "unit_name", "supplier_name")}
    return lens.periods(spark, sf_dir).withColumns(one | {"account_number": F.when(F.col("account_number").isNotNull(), "one")})


def crowded_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of sequences that no task holds: chunks of them, with what they hand each other."""
    return periods.resolve_dates(_crowded(spark, sf_dir), spill(spark)).select("row_id", *ingest.RESOLUTION)


def _layers() -> list[layers.Layer]:
    """The silver layers 01 to 10 and both gold tables."""
    monthly_key = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in [*rollup.MONTHLY_KEY, "flow"]))
    shares = ["fossil", "renewable", "nuclear", "generation"]
    names = {"fossil": "fossil_fuel_%", "renewable": "renewable_energy_%", "nuclear": "nuclear_%", "generation": "solar_total_generation"}

    def allocated(monthly: DataFrame, allocation: DataFrame) -> DataFrame:
        key = text.lookup_key(F.col("unit_name"), F.col("supplier_name"), F.col("month"))
        out = enrich.specific_lookup(monthly.withColumn("key", key), allocation, shares)
        return out.withColumnsRenamed(names).withColumn("solar_export", F.lit(None).cast("double"))

    return [
        layers.Layer("01_periods", ("periods",), lambda p: p),
        layers.Layer("02_conflicts", ("01_periods",), lambda p: periods.overlap_flags(p).select("row_id", "period_index", "conflict")),
        layers.Layer("03_resolved", ("01_periods",), periods.resolve_dates),
        layers.Layer("04_split", ("03_resolved",), periods.month_split),
        layers.Layer("05_monthly", ("04_split",), lambda s: rollup.monthly_rollup(s, ("flow",)).withColumn("row_id", monthly_key)),
        layers.Layer("06_allocated", ("05_monthly", "allocation"), allocated),
        layers.Layer("07_business", ("06_allocated",), rollup.business_rows),
        layers.Layer("08_template", ("07_business",), rollup.kpi_template),
        layers.Layer("09_output", ("08_template",), rollup.template_output),
        layers.Layer("10_lineage", ("04_split",), lambda s: lineage.monthly_lineage(s.withColumn("link", F.lit(None).cast("string")))),
        layers.Layer("gold_template", ("09_output",), gold.gold_template),
        layers.Layer("gold_aggregated", ("gold_template",), gold.gold_aggregated),
    ]


def layer_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All layers built, refreshed once with allocations written again in another order, and once with fossil and
    renewable shares exchanged: how often each layer was built, and its rows."""
    root, allocation = scratch(spark, "layers"), lens.allocation(spark, sf_dir)
    sources = {"periods": lens.periods(spark, sf_dir), "allocation": allocation}
    changed = allocation.withColumns({"fossil": F.col("renewable"), "renewable": F.col("fossil")})
    for now in (allocation, allocation.orderBy(F.desc("lookup_id")), changed):
        layers.refresh(spark, root, _layers(), sources | {"allocation": now})
    return layers.log(spark, root).groupBy("layer").agg(F.count("*").alias("builds"), F.max_by("rows", "build").alias("rows"))


def split_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits that may not enter a report: without their period or with other dates than it, without an amount, or outside their period; each with all its faults."""
    records = periods.resolve_dates(lens.periods(spark, sf_dir)).withColumn("source_file", F.col("invoice_id"))
    k = F.col("part_key") % 50
    splits = periods.month_split(records).withColumns({
        "row_id": F.when(k == 1, F.concat("row_id", F.lit("x"))).otherwise(F.col("row_id")), "split_quantity": F.when(k % 25 == 2, F.lit(None)).otherwise(F.col("split_quantity")),
        "split_end": F.when(k == 27, F.date_add("effective_end", 3)).otherwise(F.col("split_end")),
    })
    return constraints.quarantined(*scope.split_rules(splits, records))[1].select("row_id", "month", F.array_join("faults", "; ").alias("faults"))


QUERIES = {f.__name__: f for f in (late_arrivals, crowded_sequences, document_ingest, decision_versions, layer_refresh, split_quarantine)}

_TPL = (PERIODS_SQL, RESOLVED, SPLITS, MONTHLY, ALLOCATED, TEMPLATE)
ORACLE_SQL = {
    "late_arrivals": with_parts(PERIODS_SQL, RESOLVED) + "SELECT row_id, effective_start, effective_end, date_adjustment, date_resolution, resolution_reference, date_provisional FROM resolved",
    "crowded_sequences": with_parts(PERIODS_SQL.replace("periods AS (", "plain AS ("), """periods AS (SELECT * REPLACE ('one' AS division, 'one' AS legal_entity, 'one' AS unit_name, 'one' AS supplier_name, CASE WHEN account_number IS NOT NULL THEN 'one' END AS account_number) FROM plain)
""", RESOLVED) + "SELECT row_id, effective_start, effective_end, date_adjustment, date_resolution, resolution_reference, date_provisional FROM resolved",
    "document_ingest": """SELECT 'doc-' || s_suppkey AS document, CASE WHEN s_suppkey % 13 = 0 OR s_suppkey % 11 = 0 THEN 'corrupt' ELSE 'document' END AS kind,
  CASE WHEN s_suppkey % 13 = 0 OR s_suppkey % 11 = 0 THEN NULL ELSE s_name END AS account, 1 AS times FROM supplier""",
    "decision_versions": with_parts(PERIODS_SQL, BRONZE_SQL, QUALITY) + """, i AS (SELECT issue_id, ocr_value, part_key FROM issues JOIN bronze USING (line_id)),
first AS (SELECT issue_id, ocr_value AS original_value, CASE WHEN part_key % 2 = 0 THEN 'APPROVED' ELSE 'REJECTED' END AS review_decision, part_key FROM i)
SELECT 1 AS version, issue_id, original_value, NULL AS corrected_value, review_decision, '2024-01-01' AS reviewed_at FROM first
UNION ALL SELECT 4, issue_id, original_value, CASE WHEN part_key % 5 = 0 THEN 'FIX-' || part_key END, CASE WHEN part_key % 5 = 0 THEN 'CORRECTED' ELSE review_decision END, CASE WHEN part_key % 5 = 0 THEN '2024-01-02' ELSE '2024-01-01' END FROM first WHERE part_key % 15 <> 0
UNION ALL SELECT 4, 'override_' || replace(invoice_id, '-', '_') || '_' || replace(line_id, '-', '_') || '_quantity', quantity, '0', 'CORRECTED', '2024-01-04' FROM bronze WHERE part_key % 4 = 1""",
    "layer_refresh": with_parts(*_TPL) + """, n(layer, builds, rows) AS (
  SELECT '01_periods', 1, count(*) FROM periods UNION ALL SELECT '02_conflicts', 1, count(*) FROM periods UNION ALL SELECT '03_resolved', 1, count(*) FROM resolved UNION ALL SELECT '04_split', 1, count(*) FROM splits
  UNION ALL SELECT '05_monthly', 1, count(*) FROM monthly UNION ALL SELECT '06_allocated', 2, count(*) FROM allocated UNION ALL SELECT '07_business', 2, count(*) FROM allocated UNION ALL SELECT '08_template', 2, count(*) FROM template
  UNION ALL SELECT '09_output', 2, count(*) FROM gold UNION ALL SELECT '10_lineage', 1, count(*) FROM (SELECT DISTINCT division, legal_entity, unit_name, supplier_name, account_number, activity_group, energy_unit, "month" FROM splits WHERE mapping_status = 'MAPPED') UNION ALL SELECT 'gold_template', 2, count(*) FROM gold
  UNION ALL SELECT 'gold_aggregated', 2, count(*) FROM (SELECT DISTINCT division, legal_entity, unit_name, "month", activity_group FROM gold))
SELECT layer, CAST(builds AS BIGINT) AS builds, CAST(rows AS BIGINT) AS rows FROM n""",
    "split_quarantine": with_parts(PERIODS_SQL, RESOLVED, SPLITS) + """SELECT row_id || CASE WHEN part_key % 50 = 1 THEN 'x' ELSE '' END AS row_id, "month",
  CASE part_key % 50 WHEN 1 THEN 'no such period' WHEN 2 THEN 'no amount' ELSE 'no amount; outside its period' END AS faults FROM splits WHERE part_key % 50 IN (1, 2, 27)""",
}
