"""Registered queries of the silver layers, lineage and the waste flow, with their DuckDB SQL."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import dates, numbers, text
from tallyweave.operators import bronze, lineage, periods, review, rollup, silver
from tallyweave.sources import config, lens

from .oracle_parts import MONTHLY, PERIODS_SQL, RESOLVED, SPLITS, with_parts
from .shared import scratch


def _normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.periods(spark, sf_dir).selectExpr(
        "row_id", "invoice_id", "line_id", "legal_entity", "concat(' ', lower(unit_name), '__') unit_name", "concat(supplier_name, ' gmbh.') supplier", "case when part_key % 11 = 2 then 'Gas' else activity_group end activity_group",
        "mapping_status", "'' mapping_message", "0.5 document_confidence", "case part_key % 4 when 0 then null when 1 then concat('total ', energy_unit, ' used') when 2 then concat(energy_unit, ' / m3') else energy_unit end quantity_unit_1",
        "case part_key % 3 when 0 then 'RTH' when 1 then 'kWh and MWh' end consumption_unit", "case part_key % 5 when 0 then 'tons' end quantity_unit_2", "case part_key % 6 when 0 then ' ' when 1 then 'Estimated' end data_quality", "cast(start as string) createdDateTime", "part_key % 2 = 0 from_mapping",
    )


CURATED = ["row_id", "invoice_id", "data_quality", "unit_name", "supplier", "activity_group", "mapping_status", "mapping_message", "consumption_quantity_unit", "consumption_quantity_unit_2", "createdDateTme", "modelID"]


def silver_curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data quality, cleaned texts, effective units, checked activity groups, and the fixed columns under any of their names."""
    rows = silver.with_quantity_unit(silver.with_data_quality(_normalised(spark, sf_dir)))
    rows = silver.cleaned(rows, {"unit_name": text.upper_clean, "supplier": text.proper_case}, {"supplier": F.col("from_mapping")})
    return silver.curated(silver.validated_activity(rows), CURATED)


def manual_to_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = lens.periods(spark, sf_dir).where("flow = 'Manual entry'").selectExpr("row_id invoice_id", "line_id", "division", "legal_entity legal_entity_name", "unit_name unit", "account_number", "activity_group", "cast(start as string) consumption_start_date", "quantity amount_of_energy_consumed", "energy_unit", "'COMPLETED' manual_entry_status", "'ann' reviewed_by")
    out = silver.manual_rows(entries)
    return out.select("manual_entry_invoice_id", "legal_entity", "unit_name", "consumption_start_date_1_normalized", "aggregated_quantity_1", "consumption_quantity_unit", "approval_status", "manual_review_tag", "manual_entry_reviewer", "supplier_name", "manual_data_entry_portion")


def confidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = silver.confidence_summary(lens.bronze_rows(spark, sf_dir), ["account_number", "supplier_name", "energy_unit", "quantity"], 0.7)
    return out.select("line_id", "missing_fields", "low_confidence_fields", "needs_review")


def _noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periods.month_split(periods.resolve_dates(lens.periods(spark, sf_dir)))
    note = F.when(F.col("part_key") % 2 == 0, "Late; read").when(F.col("part_key") % 3 == 0, " ").otherwise("READ ;meter")
    return rows.withColumns({"link": F.when(F.col("part_key") % 6 != 0, F.concat(F.lit("https://bills.example/"), "invoice_id")), "note": note})


def monthly_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lineage.monthly_lineage(_noted(spark, sf_dir), joined=("date_resolution",), parts=("note",), first=("link",))
    return lineage.widened(out)


def lineage_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The splits read back from the report form of their lineage."""
    rows = lineage.split_ranges(lineage.monthly_lineage(_noted(spark, sf_dir)))
    return rows.groupBy("month", "split_start", "split_end").agg(F.count("*").alias("n"))


def waste_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze lines of the waste flow, with the columns, their order and cleaners from the category's document, read from shared storage."""
    path = scratch(spark, "waste")
    content = (Path(__file__).parent / "waste.yaml").read_text(encoding="utf-8")
    spark.createDataFrame([(content,)], "value string").coalesce(1).write.text(path)
    return config.read_category(spark, path).bronze(lens.documents_json(spark, sf_dir))


def waste_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review of the waste flow: duplicates out, field quality, summary."""
    waste = config.own_category("waste")
    rows = waste.bronze(lens.documents_json(spark, sf_dir)).withColumn("invoice_id", F.col("source_file")).withColumn("waste_confidence", F.col("total_confidence"))
    unique, _ = bronze.split_duplicates(waste.marked(rows))
    return review.review_summary(review.field_quality(unique, waste.fields.criticality, waste.thresholds)).select("invoice_id", "line_id", "review_status", "review_severity", "failed_fields")


def typed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates from text forms, month labels, fiscal months, and the differences that reports show."""
    o = lens.table(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    form = F.get(F.array(F.date_format("d", "yyyy-MM-dd"), F.concat(F.date_format("d", "yyyy-MM-dd"), F.lit("T10:00:00")), F.date_format("d", "yyyy/MM/dd"), F.date_format("d", "d MMM yyyy"), F.lit("soon"), F.lit(" ")), (F.col("o_orderkey") % 6).cast("int"))
    p = F.when(F.col("o_orderkey") % 7 == 0, None).when(F.col("o_orderkey") % 7 == 1, float("inf")).otherwise((F.col("o_orderkey") % 101 - 50) / 97)
    return o.select("o_orderkey", dates.to_date(form).alias("date"), dates.month_label(F.col("d")).alias("label"), F.element_at(dates.fiscal_months(dates.fiscal_year(F.col("d"))), 1).alias("fiscal_start"), numbers.shown_difference(p).alias("shown"), numbers.exported_difference(p).alias("exported"), text.source_label(F.when(F.col("o_orderkey") % 3 == 0, "HTTPS://x/y").when(F.col("o_orderkey") % 3 == 1, "ftp://z")).alias("source"))


QUERIES = {f.__name__: f for f in (silver_curated, manual_to_silver, confidence_summary, monthly_lineage, lineage_ranges, waste_bronze, waste_review, typed_dates)}

_UNIT = "CASE {0} WHEN 'kWh' THEN 'KWH' WHEN 'MWh' THEN 'MWH' WHEN 'ton' THEN 'TON' WHEN 'tons' THEN 'TON' WHEN 'RTH' THEN 'RTH' ELSE '' END"
_NOTED = """
noted AS (SELECT *, CASE WHEN part_key % 6 <> 0 THEN 'https://bills.example/' || invoice_id END AS link, CASE WHEN part_key % 2 = 0 THEN 'Late; read' WHEN part_key % 3 = 0 THEN ' ' ELSE 'READ ;meter' END AS note FROM billable),
grouped AS (
  SELECT division, legal_entity, unit_name, supplier_name, account_number, activity_group, energy_unit, "month", string_agg(DISTINCT row_id, '; ' ORDER BY row_id) AS source_row_ids,
    string_agg(concat_ws('|', row_id, strftime("month", '%Y-%m'), split_start, split_end), '; ' ORDER BY row_id, split_start, split_end) AS split_keys, string_agg(DISTINCT invoice_id, '; ' ORDER BY invoice_id) AS source_files,
    arg_min(link, row_id) FILTER (link IS NOT NULL) AS link
  FROM noted GROUP BY ALL
),
scattered AS (SELECT hash(division, legal_entity, unit_name, supplier_name, account_number, activity_group, energy_unit, "month") AS g, * FROM noted),
links AS (SELECT g, list(link ORDER BY r) AS ls FROM (SELECT g, link, min(row_id) AS r FROM scattered WHERE link IS NOT NULL GROUP BY ALL) GROUP BY g),
kinds AS (SELECT g, string_agg(date_resolution, '; ' ORDER BY r) AS date_resolution FROM (SELECT g, date_resolution, min(row_id) AS r FROM scattered GROUP BY ALL) GROUP BY g),
bits AS (SELECT g, row_id, unnest(string_split(note, ';')) AS bit, generate_subscripts(string_split(note, ';'), 1) AS i FROM scattered),
notes AS (SELECT g, string_agg(bit, '; ' ORDER BY ord) AS note FROM (SELECT g, lower(trim(bit)) AS k, min_by(trim(bit), row_id || i) AS bit, min(row_id || i) AS ord FROM bits WHERE trim(bit) <> '' GROUP BY ALL) GROUP BY g)
"""

ORACLE_SQL = {
    "silver_curated": with_parts(PERIODS_SQL) + f""", u AS (SELECT *, CASE part_key % 4 WHEN 1 THEN {_UNIT.format('energy_unit')} WHEN 3 THEN {_UNIT.format('energy_unit')} ELSE '' END AS own, CASE part_key % 3 WHEN 0 THEN 'RTH' ELSE '' END AS mapped,
  CASE WHEN part_key % 11 = 2 THEN 'Gas' ELSE activity_group END AS act FROM periods), w AS (SELECT *, CASE WHEN own <> '' THEN own ELSE mapped END AS unit FROM u)
SELECT row_id, invoice_id, CASE WHEN part_key % 6 = 1 THEN 'Estimated' ELSE 'Actual' END AS data_quality, replace(unit_name, '-', ' ') AS unit_name,
  CASE WHEN part_key % 2 = 0 THEN supplier_name || ' gmbh.' ELSE replace(supplier_name, '#', '#') || ' GMBH' END AS supplier, act AS activity_group, CASE WHEN mapping_status = 'MAPPED' AND act = 'Gas' THEN 'INCOMPLETE' ELSE mapping_status END AS mapping_status,
  CASE WHEN mapping_status = 'MAPPED' AND act = 'Gas' THEN 'Scope 2 activity group must be Electricity, Steam, Heat, or Cool.' ELSE '' END AS mapping_message, unit AS consumption_quantity_unit,
  CASE WHEN part_key % 5 = 0 THEN 'TON' WHEN part_key % 3 = 0 THEN 'RTH' WHEN part_key % 3 = 1 THEN '' ELSE unit END AS consumption_quantity_unit_2, CAST("start" AS VARCHAR) AS "createdDateTme", CAST(NULL AS VARCHAR) AS "modelID" FROM w""",
    "manual_to_silver": with_parts(PERIODS_SQL) + f"""SELECT row_id AS manual_entry_invoice_id, legal_entity, unit_name, CAST("start" AS VARCHAR) AS consumption_start_date_1_normalized, quantity AS aggregated_quantity_1, {_UNIT.format('energy_unit')} AS consumption_quantity_unit,
  'COMPLETED' AS approval_status, 'MANUAL_DATA_ENTRY' AS manual_review_tag, 'ann' AS manual_entry_reviewer, CAST(NULL AS VARCHAR) AS supplier_name, 'Yes' AS manual_data_entry_portion FROM periods WHERE flow = 'Manual entry'""",
    "confidence_summary": with_parts(PERIODS_SQL, lens.BRONZE_SQL) + """, f AS (SELECT line_id, 0 AS i, 'account_number' AS f, account_number AS v, account_number_confidence AS c FROM bronze UNION ALL SELECT line_id, 1, 'supplier_name', supplier_name, supplier_name_confidence FROM bronze
  UNION ALL SELECT line_id, 2, 'energy_unit', energy_unit, energy_unit_confidence FROM bronze UNION ALL SELECT line_id, 3, 'quantity', quantity, quantity_confidence FROM bronze), g AS (SELECT *, coalesce(trim(v), '') = '' AS blank FROM f)
SELECT line_id, coalesce(string_agg(f, ';' ORDER BY i) FILTER (blank), '') AS missing_fields, coalesce(string_agg(f, ';' ORDER BY i) FILTER (NOT blank AND c < 0.7), '') AS low_confidence_fields, bool_or(blank OR c < 0.7) AS needs_review FROM g GROUP BY line_id""",
    "monthly_lineage": with_parts(PERIODS_SQL, RESOLVED, SPLITS, MONTHLY, _NOTED) + """SELECT m.*, date_resolution, note, ls[1] AS sharepoint_link_1, ls[2] AS sharepoint_link_2, ls[3] AS sharepoint_link_3, ls[4] AS sharepoint_link_4
FROM (SELECT hash(division, legal_entity, unit_name, supplier_name, account_number, activity_group, energy_unit, "month") AS g, * FROM grouped) m LEFT JOIN links USING (g) LEFT JOIN kinds USING (g) LEFT JOIN notes USING (g)""".replace("SELECT m.*,", "SELECT m.* EXCLUDE (g) REPLACE (coalesce(link, NULL) AS link),").replace(" note, ls", " coalesce(note, '') AS note, ls"),
    "lineage_ranges": with_parts(PERIODS_SQL, RESOLVED, SPLITS, MONTHLY) + """SELECT "month", split_start, split_end, count(*) AS n FROM billable GROUP BY ALL""",
    "waste_bronze": """SELECT 'doc-' || o_orderkey AS source_file, CAST(i + 1 AS VARCHAR) AS line_id, CAST(o_custkey AS VARCHAR) AS account, (o_orderkey % 10) / 10 AS account_confidence, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_totalprice AS VARCHAR) END AS total, (o_orderkey % 10) / 10 AS total_confidence,
  CASE WHEN i < o_orderkey % 4 THEN CAST(o_orderkey % 7 + i AS VARCHAR) END AS qty, CASE WHEN i < o_orderkey % 4 THEN 'Kind ' || (o_orderkey % 3 + i) END AS waste FROM orders, range(3) t(i) WHERE i < greatest(o_orderkey % 4, 1)""",
    "waste_review": """WITH b AS (SELECT 'doc-' || o_orderkey AS invoice_id, CAST(i + 1 AS VARCHAR) AS line_id, CAST(o_custkey AS VARCHAR) AS account, (o_orderkey % 10) / 10 AS c, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_totalprice AS VARCHAR) END AS total,
  CASE WHEN i < o_orderkey % 4 THEN CAST(o_orderkey % 7 + i AS VARCHAR) END AS qty, CASE WHEN i < o_orderkey % 4 THEN 'Kind ' || (o_orderkey % 3 + i) END AS waste FROM orders, range(3) t(i) WHERE i < greatest(o_orderkey % 4, 1)),
u AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY concat_ws('|', account, total, qty, waste) ORDER BY invoice_id, line_id) = 1),
f AS (SELECT invoice_id, line_id, 0 AS pos, 'account' AS f, account AS v, c, 'critical' AS k, 0.8 AS t FROM u UNION ALL SELECT invoice_id, line_id, 1, 'total', total, c, 'optional', 0.6 FROM u UNION ALL SELECT invoice_id, line_id, 2, 'waste', waste, c, 'critical', 0.8 FROM u),
s AS (SELECT *, CASE WHEN v IS NULL AND c > 0.9 THEN 4 WHEN v IS NULL AND k = 'critical' THEN 1 WHEN v IS NULL THEN 3 WHEN c < t AND k = 'critical' THEN 2 WHEN c < t THEN 3 END AS r FROM f),
g AS (SELECT invoice_id, line_id, min(r) AS r, count(*) FILTER (r <= 2 AND k = 'critical') AS crit, coalesce(string_agg(f, ';' ORDER BY r, pos) FILTER (r <= 2), '') AS failed_fields FROM s GROUP BY ALL)
SELECT invoice_id, line_id, CASE r WHEN 1 THEN 'BLOCKED' WHEN 2 THEN 'REVIEW_REQUIRED' WHEN 3 THEN 'OPTIONAL_FIELD_WARNING' WHEN 4 THEN 'AUTO_RESOLVED_WITH_WARNING' ELSE 'AUTO_APPROVED' END AS review_status,
  CASE WHEN r = 1 OR r = 2 AND crit > 0 THEN 'HIGH' WHEN r = 2 THEN 'MEDIUM' WHEN r IN (3, 4) THEN 'LOW' ELSE 'NONE' END AS review_severity, failed_fields FROM g""",
    "typed_dates": """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 7 AS k, (o_orderkey % 101 - 50) / 97 AS p FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 4 THEN d END AS date, strftime(d, '%b %Y') AS label, make_date(year(d) + CASE WHEN month(d) = 12 THEN 0 ELSE -1 END, 12, 1) AS fiscal_start, CASE WHEN k = 0 THEN 'missing' WHEN k = 1 THEN '>999%' ELSE format('{:+.1f}%', p * 100) END AS shown,
  CASE WHEN k > 1 THEN round(p, 4) END AS exported, CASE WHEN o_orderkey % 3 = 0 THEN 'HTTPS://x/y' ELSE 'SharePoint link unavailable' END AS source FROM o""",
}
