"""Registered queries of report scope, evidence, dashboards and the archived SQL views, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.functions import text
from tallyweave.operators import bronze, lineage, numbering, periods, rollup
from tallyweave.sources import lens

from . import archive_v1, audit, audit_report, missing, reports, scope
from .oracle_parts import ALLOCATION_SQL, AUDITED, HISTORY, MAPPING_SQL, MONTHLY, PERIODS_SQL, RESOLVED, SPLITS, with_parts
from .shared import spill

#: What a split adds to its period.
SPLIT = ("month", "split_start", "split_end", "split_days", "split_quantity")
FACILITY = ["division", "legal_entity", "unit_name"]
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved periods as audit records' input: some without an invoice or a unit, with a link for most."""
    rows = periods.resolve_dates(lens.periods(spark, sf_dir))
    return rows.withColumns({
        "source_file": F.concat("row_id", F.lit(".json")), "source_link": F.when(F.col("part_key") % 6 != 0, F.concat(F.lit("https://bills.example/"), "invoice_id")),
        "invoice_id": F.when(F.col("part_key") % 10 == 4, " ").otherwise(F.col("row_id")), "line_id": F.when(F.col("part_key") % 4 != 1, F.col("line_id")),
        "unit_name": F.when(F.col("part_key") % 13 != 5, F.col("unit_name")), "activity_group": F.when(F.col("part_key") % 17 == 3, "Gas").otherwise(F.col("activity_group")),
    })


def audit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scope.audit_periods(_records(spark, sf_dir))
    return out.select("invoice_id", "line_id", "source", "facility", "kpi_component", "mapped", "printed_start", "end", "factor", F.round("billed_kwh", 4).alias("billed_kwh"))


def _allocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit records beside their months: the splits carry their period's columns, so nothing is joined back."""
    return scope.allocated(scope.audit_periods(periods.month_split(_records(spark, sf_dir)), SPLIT))


def allocation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits that were written without their periods, joined to them by period and index, as a report reads them from storage."""
    records = _records(spark, sf_dir)
    splits = scope.audit_periods(periods.month_split(records), SPLIT).select("period_id", *SPLIT)
    out = scope.allocation_records(scope.audit_periods(records), splits)
    return out.select("source_file", "month", "split_start", "split_end", "split_days", "facility", "kpi_component", *(F.round(F.col(c) + 1e-7, 4).alias(c) for c in ("allocated_original", "allocated_kwh")))


def audit_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The details of one division's electricity, as the report shows them."""
    rows = scope.scoped(_allocations(spark, sf_dir), division="ASIA", kpi_component="Purchased electricity", account=None)
    return scope.details(rows).withColumns({c: F.round(F.col(c) + 1e-7, 4) for c in ("allocated_original", "allocated_kwh", "recalculated_kwh")})


def original_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was billed in its own unit by the periods that have allocations, each counted once."""
    rows = scope.audit_periods(periods.month_split(_records(spark, sf_dir)), (*SPLIT, "supplier_name"))
    out = scope.original_quantities(scope.allocated(rows))
    return out.groupBy("source_link", "original_unit", "factor", "source", "supplier_name").agg(F.count("*").alias("periods"), F.round(F.sum("billed_original"), 2).alias("billed_original"))


def _report(spark: SparkSession, sf_dir: str) -> audit_report.Report:
    """The fiscal year 1998 of all facilities."""
    return audit_report.build(_records(spark, sf_dir), audit_report.Wanted("1997-12-01", "1998-11-01"), spill(spark))


def audit_report_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _report(spark, sf_dir).details()
    return out.select("index", "source_file", "facility", "kpi_component", "account", "month", *(F.round(F.col(c) + 1e-7, 4).alias(c) for c in ("allocated_original", "allocated_kwh")))


def audit_report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).summary().withColumn("kwh", F.round(F.col("kwh") + 1e-7, 2))


def audit_report_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).cases(("source_file",)).drop("period_id")


def audit_report_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).information(("as planted",))


def facility_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scope.totals(_allocations(spark, sf_dir), ["kpi_component", "division", "legal_entity"])
    return out.withColumn("kwh", F.round(F.col("kwh") + 1e-7, 2)).withColumn("level", F.col("level").cast("int"))


def report_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every audit record's place in the report of its KPI."""
    rows = scope.audit_periods(_records(spark, sf_dir)).select("kpi_component", "facility", "start", "invoice_id", "source_file")
    return numbering.numbered(rows, ["facility", "start", "invoice_id", "source_file"], spill(spark), by=["kpi_component"]).select("kpi_component", "source_file", "index")


def report_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal entities and units to choose from under each division."""
    rows = scope.audit_periods(_records(spark, sf_dir))
    return scope.options(rows, "legal_entity", division="EUROPE").select(F.lit("legal_entity").alias("level"), F.col("legal_entity").alias("option")).union(scope.options(rows, "unit_name", division="EUROPE", legal_entity="FRANCE").select(F.lit("unit_name"), "unit_name"))


def _cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cases with evidence: invalid inputs and missing mappings by period, months with several periods of an account by account.

    Periods are resolved and written once; cases carry what their evidence needs of them, so they are not joined back."""
    records = _records(spark, sf_dir).withColumn("invoice_id", F.col("row_id"))
    p = scope.audit_periods(records).select("period_id", "division", "facility", "kpi_component", "mapped", "account", "start", "end", "factor", "source", "source_file", "source_link")
    p = spill(spark)(p)
    label = F.coalesce(F.date_format("start", "yyyy-MM"), F.lit("Unknown period"))
    kinds = F.array_compact(F.array(F.when(~F.col("mapped"), audit.MAPPING), F.when(F.col("factor").isNull(), audit.UNIT)))
    single = p.select(F.explode(kinds).alias("issue"), label.alias("month"), "period_id", F.col("period_id").alias("case_key"), *scope.EVIDENCE)
    months = p.where("end >= start").withColumn("m", F.explode(F.sequence(F.trunc("start", "MM"), "end", F.expr("interval 1 month"))))
    # periods without an account are not those of one account
    own = F.when(F.col("account") == "", F.col("period_id")).otherwise(F.concat_ws("|", "facility", "account", "kpi_component"))
    shared = months.select(F.lit(audit.OVERLAPPING).alias("issue"), F.date_format("m", "yyyy-MM").alias("month"), "period_id", own.alias("case_key"), *scope.EVIDENCE)
    several = shared.withColumn("n", F.count("*").over(Window.partitionBy("month", "case_key"))).where("n > 1").drop("n")
    return single.unionByName(several), p


def case_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases in a report's shape: how many periods, files and links each has."""
    cases, p = _cases(spark, sf_dir)
    out = scope.case_table(scope.browsed(scope.evidenced(cases, p), term="bills"))
    return out.select("issue", "month", "facility", "kpi_component", "account", "periods", F.length("source_files").alias("files_length"), "source_1", "source_2")


def case_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases of one division and of the year 1998, and the periods behind them whatever their month."""
    cases, p = _cases(spark, sf_dir)
    chosen = scope.scoped(p, division="ASIA", source="Reviewed OCR")
    found = scope.scoped_cases(spill(spark)(scope.evidenced(cases, p).select("case_id", "issue", "month", "period_ids")), chosen, [f"1998-{m:02d}" for m in range(1, 13)])
    return scope.case_evidence(found, p).select("source_file", "facility")


def split_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits with planted faults: none there, another file, another account, other dates."""
    rows = periods.resolve_dates(lens.periods(spark, sf_dir)).withColumn("source_file", F.col("invoice_id"))
    k = F.col("part_key") % 40
    splits = periods.month_split(rows).withColumns({
        "period_index": F.when(k == 1, 2).otherwise(F.col("period_index")), "source_file": F.when(k == 2, "x").otherwise(F.col("source_file")),
        "account_number": F.when(k == 3, "x").otherwise(F.col("account_number")), "effective_end": F.when(k == 4, F.date_add("effective_end", 1)).otherwise(F.col("effective_end")),
    })
    return scope.split_faults(splits, rows)


def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.unique_ids(lens.periods(spark, sf_dir), "invoice_id")


def missing_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.periods(spark, sf_dir).withColumns({"mapping_message": F.lit(""), "source_file": F.col("row_id")})
    business = rows.withColumn("business_mapping_issue", F.when(F.col("part_key") % 31 == 4, "no shares").otherwise(" "))
    accounts = reports.expected_accounts(lens.mapping(spark, sf_dir).selectExpr("*", "trim(activity_group) kpi", "'2024-01-01' effective_start", "'' effective_end"))
    history = reports.reporting_rows(rows.selectExpr("division", "legal_entity", "case when part_key % 50 = 49 then ' ' else unit_name end unit_name", "account_number", "activity_group kpi", "energy_unit", "quantity amount", "start date", "'' issue", "row_id source_file"))[1]
    unmapped = missing.unmapped_rows(rows, ["division", "account_number", "activity_group"])
    out = missing.missing_mappings("scope2", unmapped, business, accounts, history)
    return out.groupBy("category", "mapping_status", "mapping_message", "division").agg(F.count("*").alias("rows"), F.countDistinct("account_number").alias("accounts"), F.countDistinct("source_file").alias("files"))


def reporting_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected accounts of active facilities, and all facilities expected or seen."""
    m = lens.mapping(spark, sf_dir).withColumn("kpi", text.lookup_text(F.col("activity_group")))
    active = lens.mapping(spark, sf_dir).where("map_id % 3 = 0 and map_id % 7 <> 0").selectExpr("division", "replace(legal_entity, ' ', '_') legal_entity", "lower(unit_name) unit_name")
    seen = lens.periods(spark, sf_dir).where("part_key % 5 = 0").select(*FACILITY)
    kept = reports.active_accounts(m, active)
    return reports.all_facilities(kept, seen).join(kept.groupBy(*FACILITY).agg(F.count("*").alias("expected")), FACILITY, "left").withColumn("expected", F.coalesce("expected", F.lit(0)))


def month_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files and links behind each facility's month."""
    rows = _records(spark, sf_dir).withColumns({"kpi": F.col("activity_group"), "date": F.col("start"), "source_files": F.concat_ws(";", "invoice_id", F.upper("row_id"), F.lower("row_id"))})
    out = reports.monthly_sources(rows)
    return lineage.widened(out.withColumn("files", F.size("sources")).drop("sources"), "links", "link_", 2)


def dashboard_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over the year-over-year cells of each KPI, of facilities whose name holds a text, and the years to choose from."""
    facts = reports.reporting_rows(lens.periods(spark, sf_dir).selectExpr("*", "activity_group kpi", "quantity amount", "start date", "'' issue"))[0]
    ends = lens.periods(spark, sf_dir).agg(F.min(F.trunc("start", "MM")).alias("first"), F.max(F.trunc("start", "MM")).alias("last")).first()
    cells = reports.year_over_year(facts, facts, facts, reports.months_of(ends))
    return reports.tiles(reports.matching_facilities(cells, "u 1")).withColumns({"first_year": F.lit(ends["first"] and ends["first"].year), "last_year": F.lit(ends["last"] and ends["last"].year)})


def month_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export form of all mapped amounts: a row a facility, KPI and year, a column a month."""
    rows = lens.periods(spark, sf_dir).where("mapping_status = 'MAPPED'").selectExpr(*FACILITY, "activity_group kpi", "trunc(start, 'MM') month", "quantity v")
    cells = rows.groupBy(*FACILITY, "kpi", "month").agg(F.sum("v").alias("v")).withColumn("year", F.year("month"))
    return reports.by_month(cells, F.col("v"), list(MONTHS), "MMM", ("year",))


def duplicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged rows and groups of each category, and of the whole workspace."""
    rows = lens.periods(spark, sf_dir).withColumns({"business_key": F.concat_ws("|", "account_number", "activity_group", "quantity"), "content_hash": F.col("row_id"), "category": F.col("division")})
    marked = bronze.mark_duplicates(rows, ["row_id"])
    return marked.rollup("category").agg(F.count("*").alias("rows"), F.count_if(F.col("duplicate_status") == "DUPLICATE").alias("duplicates"), F.countDistinct("duplicate_of").alias("groups"))


def template_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns between two of a template, its files and links, tagged with the kind of decision behind each row."""
    rows = lens.periods(spark, sf_dir).selectExpr("row_id", "'Actual' data_quality", "division", "unit_name", "quantity", "energy_unit contractual_instruments", "tax", "invoice_id source_files", "flow", "concat(case when part_key % 2 = 0 then 'override_' else 'issue_' end, row_id) issue_id")
    tagged = reports.decision_type(reports.column_slice(rows, "data_quality", "contractual_instruments", ["row_id", "source_files", "issue_id"]))
    return tagged.drop("issue_id")


def _ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.periods(spark, sf_dir).selectExpr(
        "row_id ocr_record_id", "concat(invoice_id, '.json') source_file", "legal_entity", "unit_name", "supplier_name supplier", "account_number", "cast(quantity as string) quantity_1", "case when part_key % 3 = 0 then cast(quantity * 2 as string) else ' ' end quantity_2",
        "cast(null as string) quantity_3", "'' quantity_4", "case when part_key % 7 = 0 then '7' end quantity_5", "cast(supplier_key as string) quantity_6", "energy_unit quantity_unit_1", "'kWh' quantity_unit_2", "part_key", "supplier_key",
    )


def quantities_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_v1.quantities(_ocr(spark, sf_dir)).select("ocr_record_id", "quantity_column", "quantity_value", "quantity_unit")


def selected_quantity_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ocr(spark, sf_dir)
    chosen = rows.where("part_key % 4 = 0").selectExpr("ocr_record_id", "case when part_key % 8 = 0 then 'quantity_6' end selected_quantity_column", "'quantity_unit_2' selected_quantity_unit_column", "'by hand' reason")
    return archive_v1.selected_quantity(rows, chosen)


def _v1_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """The whole mapping, an account for each of its rows; divisions that serve by unit or by facility id; contracts, a third of which name a unit that is not there."""
    m = lens.mapping(spark, sf_dir).selectExpr("map_id mapping_id", "division", "case when map_id % 2 = 1 then concat(account_number, '-B') else account_number end account_number", "lower(trim(activity_group)) activity_group", "unit_name", "legal_entity", "supplier_name", "concat('F', map_id div 1000) facility_identifier", "'Scope 2' scope", "'Yes' active")
    division = m.groupBy("legal_entity", "unit_name").agg(F.max("division").alias("d")).selectExpr("upper(legal_entity) legal_entity", "case when length(legal_entity) % 2 = 0 then unit_name else 'none' end unit_name", "concat('f', length(legal_entity)) facility_identifier", "concat('D-', d) division").distinct()
    contracts = m.groupBy("legal_entity", "unit_name", "supplier_name").agg(F.min("mapping_id").alias("contract_id")).withColumn("unit_name", F.expr("case when contract_id div 100 % 3 = 0 then 'elsewhere' else unit_name end"))
    return m, division, contracts


def enriched_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, division, contracts = _v1_tables(spark, sf_dir)
    return archive_v1.enriched(_ocr(spark, sf_dir), m, division, contracts)


def upload_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourteen columns of an upload, of the rows that need no reviewer."""
    ocr = _ocr(spark, sf_dir)
    amounts = archive_v1.selected_quantity(ocr, ocr.where("part_key % 4 = 0").selectExpr("ocr_record_id", "'quantity_6' selected_quantity_column", "'quantity_unit_2' selected_quantity_unit_column", "'by hand' reason"))
    shares = ocr.selectExpr("ocr_record_id", "case when part_key % 5 = 0 then 0.25D end fossil", "case when part_key % 5 = 0 then 0.75D end renewable", "cast(null as double) nuclear", "case when part_key % 6 = 0 then 'Green tariff' end contractual_instruments", "case part_key % 9 when 1 then 1 when 2 then 0 end ocr_needs_review")
    dates = lens.periods(spark, sf_dir).selectExpr("row_id", "start consumption_start", "end consumption_end", "cast(null as date) transaction_date")
    rows = enriched_v1(spark, sf_dir).withColumn("energy_type", F.coalesce("activity_group", F.lit("Electricity"))).join(amounts, "ocr_record_id").join(shares, "ocr_record_id").withColumnRenamed("ocr_record_id", "row_id").join(dates, "row_id")
    return archive_v1.upload(archive_v1.gold_v1(rows, ("division", "legal_entity", "unit_name", "consumption_start", "consumption_end", "transaction_date", "energy_type", "energy_unit", "mapping_needs_review", "ocr_needs_review")))


def dq_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for review: no mapping, electricity without a contract; and those that may be uploaded."""
    rows = enriched_v1(spark, sf_dir)
    return archive_v1.unmatched(rows).selectExpr("ocr_record_id", "'unmatched' check").union(archive_v1.contracts_missing(rows).selectExpr("ocr_record_id", "'contract missing'")).union(archive_v1.uploadable(rows).selectExpr("ocr_record_id", "'upload'"))


def constraints_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_v1.broken_constraints(lens.allocation(spark, sf_dir).selectExpr("lookup_id", "fossil + case when lookup_id % 40 = 0 then 1 else 0 end fossil", "renewable", "nuclear", "coalesce(account_number, '') account_number"), ["account_number"], "lookup_id")


QUERIES = {
    f.__name__: f
    for f in (
        audit_records, audit_report_details, audit_report_summary, audit_report_cases, audit_report_information, allocation_join, audit_details, facility_totals, report_index, report_options, case_evidence, case_scope, split_integrity, repeated_ids, missing_mapping, reporting_accounts, month_sources, dashboard_tiles, month_columns,
        duplicate_counts, template_slice, quantities_v1, selected_quantity_v1, enriched_v1, upload_v1, dq_v1, constraints_v1, original_quantities,
    )
}

_RECORDS = """
rec AS (
  SELECT *, row_id || '.json' AS source_file, CASE WHEN part_key % 6 <> 0 THEN 'https://bills.example/' || invoice_id END AS source_link, CASE WHEN part_key % 13 <> 5 THEN unit_name END AS u, CASE WHEN part_key % 17 = 3 THEN 'Gas' ELSE activity_group END AS act,
    CASE energy_unit WHEN 'kWh' THEN 1.0::DOUBLE WHEN 'MWh' THEN 1000.0::DOUBLE WHEN 'ton' THEN 720.0::DOUBLE WHEN 'RTH' THEN 0.62::DOUBLE END AS fac FROM resolved
),
ap AS (
  SELECT row_id, CASE WHEN part_key % 10 = 4 THEN source_file ELSE row_id END AS invoice_id, CASE WHEN part_key % 4 <> 1 THEN line_id ELSE '1' END AS line_id, flow AS source, division, legal_entity, coalesce(u, '') AS unit_name,
    division || ' / ' || legal_entity || ' / ' || coalesce(u, 'Unmapped') AS facility, CASE WHEN act = 'Gas' THEN 'Unclassified' ELSE 'Purchased ' || lower(act) END AS kpi_component, u IS NOT NULL AND mapping_status = 'MAPPED' AS mapped,
    coalesce(account_number, '') AS account, "start" AS printed_start, effective_start AS s, effective_end AS e, fac AS factor, quantity, quantity * fac AS billed_kwh, source_file, source_link, energy_unit, part_key
  FROM rec
),
al AS (
  SELECT ap.*, q."month", q.split_quantity AS alloc, q.split_quantity * factor AS alloc_kwh FROM ap JOIN splits q USING (row_id)
)
"""
_R = (PERIODS_SQL, RESOLVED, SPLITS, _RECORDS)
_CASES = """
evidence AS (
  SELECT 'Missing mapping' AS issue, strftime(s, '%Y-%m') AS "month", row_id AS k, row_id FROM ap WHERE NOT mapped
  UNION ALL SELECT 'Unsupported energy unit', strftime(s, '%Y-%m'), row_id, row_id FROM ap WHERE factor IS NULL
  UNION ALL SELECT 'Overlapping billing periods', strftime(m, '%Y-%m'), k, row_id FROM (SELECT row_id, CASE WHEN account = '' THEN row_id ELSE facility || '|' || account || '|' || kpi_component END AS k, unnest(generate_series(date_trunc('month', s), e, INTERVAL 1 MONTH)) AS m FROM ap WHERE e >= s) QUALIFY count(*) OVER (PARTITION BY k, m) > 1
),
full_cases AS (
  SELECT issue, "month", k, count(*) AS periods, min((facility, kpi_component, account)) AS x, string_agg(DISTINCT source_file, '; ') AS files, list_sort(list_distinct(list(source_link) FILTER (source_link IS NOT NULL))) AS links, list(row_id) AS ids
  FROM evidence JOIN ap USING (row_id) GROUP BY ALL
)
"""
_SUMMARY = """, summary AS (SELECT division, legal_entity, unit_name, kpi_component, count(DISTINCT account) AS accounts, sum(alloc_kwh) AS kwh, count(DISTINCT row_id) AS periods, count(*) FILTER (alloc_kwh IS NULL) AS unavailable
  FROM al WHERE "month" BETWEEN DATE '1997-12-01' AND DATE '1998-11-01' GROUP BY ALL)
"""
_REPORT_CASES = """, named AS (SELECT row_id, source_file, division, legal_entity, coalesce(u, '') AS unit_name, account_number, act AS activity_group, mapping_status, effective_start AS s, effective_end AS e, energy_unit FROM rec),
v AS (SELECT *, coalesce(account_number, '?') AS a FROM named WHERE e >= s),
days AS (SELECT division, legal_entity, unit_name, a, activity_group, CAST(unnest(generate_series(greatest(s, DATE '1997-12-01'), least(e, DATE '1998-11-30'), INTERVAL 1 DAY)) AS DATE) AS d FROM v),
per_day AS (SELECT *, count(*) AS n FROM days GROUP BY ALL),
per_month AS (SELECT division, legal_entity, unit_name, a, activity_group, CAST(date_trunc('month', d) AS DATE) AS "month", count(*) AS covered, count(*) FILTER (n > 1) AS over FROM per_day GROUP BY ALL),
grid AS (SELECT division, legal_entity, unit_name, a, activity_group, CAST(unnest(generate_series(DATE '1997-12-01', DATE '1998-11-01', INTERVAL 1 MONTH)) AS DATE) AS "month" FROM (SELECT DISTINCT division, legal_entity, unit_name, a, activity_group FROM v)),
gaps AS (SELECT g.*, day(last_day("month")) - coalesce(covered, 0) AS missing, coalesce(over, 0) AS over FROM grid g LEFT JOIN per_month USING (division, legal_entity, unit_name, a, activity_group, "month")),
report_cases AS (
  SELECT 'Missing mapping' AS issue, strftime(s, '%Y-%m') AS "month", division, legal_entity, unit_name, account_number, activity_group, NULL::BIGINT AS days, source_file FROM named WHERE account_number IS NULL OR unit_name = '' OR mapping_status <> 'MAPPED'
  UNION ALL SELECT 'Invalid invoice inputs', strftime(s, '%Y-%m'), division, legal_entity, unit_name, account_number, activity_group, NULL, source_file FROM named WHERE NOT coalesce(e >= s, false)
  UNION ALL SELECT 'Unsupported energy unit', strftime(s, '%Y-%m'), division, legal_entity, unit_name, account_number, activity_group, NULL, source_file FROM named WHERE energy_unit = 'mmBTU'
  UNION ALL SELECT 'Missing coverage', strftime("month", '%Y-%m'), division, legal_entity, unit_name, nullif(a, '?'), activity_group, missing, NULL FROM gaps WHERE missing > 0
  UNION ALL SELECT 'Overlapping billing periods', strftime("month", '%Y-%m'), division, legal_entity, unit_name, nullif(a, '?'), activity_group, over, NULL FROM gaps WHERE over > 0
)
"""
_OCR = """
ocr AS (
  SELECT row_id AS ocr_record_id, legal_entity, unit_name, supplier_name AS supplier, account_number, CAST(quantity AS VARCHAR) AS q1, CASE WHEN part_key % 3 = 0 THEN CAST(quantity * 2 AS VARCHAR) END AS q2, CASE WHEN part_key % 7 = 0 THEN '7' END AS q5, CAST(supplier_key AS VARCHAR) AS q6, energy_unit AS u1, 'kWh' AS u2, part_key
  FROM periods
)
"""
_V1 = """
m AS (SELECT map_id AS mapping_id, division, CASE WHEN map_id % 2 = 1 THEN account_number || '-B' ELSE account_number END AS account_number, lower(trim(activity_group)) AS activity_group, unit_name, legal_entity, supplier_name, 'F' || (map_id // 1000) AS facility_identifier FROM mapping),
da AS (SELECT DISTINCT upper(legal_entity) AS legal_entity, CASE WHEN length(legal_entity) % 2 = 0 THEN unit_name ELSE 'none' END AS unit_name, 'f' || length(legal_entity) AS facility_identifier, 'D-' || d AS division FROM (SELECT legal_entity, unit_name, max(division) AS d FROM m GROUP BY ALL)),
con AS (SELECT * REPLACE (CASE WHEN contract_id // 100 % 3 = 0 THEN 'elsewhere' ELSE unit_name END AS unit_name) FROM (SELECT legal_entity, unit_name, supplier_name, min(mapping_id) AS contract_id FROM m GROUP BY ALL)),
keys AS (SELECT 1 AS p, nullif(lower(trim(account_number)), '') AS k, mapping_id FROM m UNION ALL SELECT 2, lower(unit_name), mapping_id FROM m UNION ALL SELECT 3, lower(legal_entity), mapping_id FROM m),
cnt AS (SELECT p, k, min(mapping_id) AS mapping_id, count(*) AS n FROM keys WHERE k IS NOT NULL GROUP BY ALL),
best AS (SELECT ocr_record_id, p, c.mapping_id, n FROM ocr, LATERAL (VALUES (1, lower(account_number)), (2, lower(unit_name)), (3, lower(legal_entity))) AS v(p, k) JOIN cnt c USING (p, k) QUALIFY row_number() OVER (PARTITION BY ocr_record_id ORDER BY p) = 1),
enr AS (
  SELECT o.ocr_record_id, b.mapping_id, CASE WHEN b.mapping_id IS NULL OR n > 1 THEN 1 ELSE 0 END AS mapping_needs_review, coalesce(m.account_number, o.account_number) AS account_number, coalesce(da.division, m.division) AS division, m.activity_group, con.contract_id, coalesce(da.legal_entity, m.legal_entity, o.legal_entity) AS legal_entity, coalesce(da.unit_name, m.unit_name, o.unit_name) AS unit_name
  FROM ocr o LEFT JOIN best b USING (ocr_record_id) LEFT JOIN m USING (mapping_id)
  LEFT JOIN da ON lower(da.legal_entity) = lower(coalesce(m.legal_entity, o.legal_entity)) AND (lower(da.unit_name) = lower(coalesce(m.unit_name, o.unit_name)) OR lower(da.facility_identifier) = lower(m.facility_identifier))
  LEFT JOIN con ON lower(con.legal_entity) = lower(coalesce(da.legal_entity, m.legal_entity, o.legal_entity)) AND lower(con.unit_name) = lower(coalesce(da.unit_name, m.unit_name, o.unit_name)) AND lower(con.supplier_name) = lower(coalesce(m.supplier_name, o.supplier))
)
"""

ORACLE_SQL = {
    "audit_records": with_parts(*_R) + "SELECT invoice_id, line_id, source, facility, kpi_component, mapped, printed_start, e AS \"end\", factor, round(billed_kwh, 4) AS billed_kwh FROM ap",
    "audit_details": with_parts(*_R) + """SELECT facility, kpi_component, account, strftime(s, '%Y-%m-%d') || ' to ' || strftime(e, '%Y-%m-%d') AS invoice_period, strftime("month", '%b %Y') AS "month", round(alloc + 1e-7, 4) AS allocated_original, energy_unit AS original_unit,
  round(alloc_kwh + 1e-7, 4) AS allocated_kwh, round(alloc_kwh + 1e-7, 4) AS recalculated_kwh, coalesce(source_link, 'SharePoint link unavailable') AS link FROM al WHERE division = 'ASIA' AND kpi_component = 'Purchased electricity'""",
    "allocation_join": with_parts(*_R) + """SELECT ap.source_file, q."month", q.split_start, q.split_end, CAST(q.split_days AS INT) AS split_days, facility, kpi_component, round(q.split_quantity + 1e-7, 4) AS allocated_original,
  round(q.split_quantity * factor + 1e-7, 4) AS allocated_kwh FROM ap JOIN splits q USING (row_id)""",
    "audit_report_details": with_parts(*_R) + """SELECT row_number() OVER (ORDER BY division, legal_entity, unit_name, kpi_component, account, "month", s, substr(sha256(concat_ws('|', source, invoice_id, line_id, 1)), 1, 16)) AS index, source_file, facility, kpi_component, account, "month",
  round(alloc + 1e-7, 4) AS allocated_original, round(alloc_kwh + 1e-7, 4) AS allocated_kwh FROM al WHERE "month" BETWEEN DATE '1997-12-01' AND DATE '1998-11-01'""",
    "audit_report_summary": with_parts(*_R) + _SUMMARY + "SELECT * REPLACE (round(kwh + 1e-7, 2) AS kwh) FROM summary",
    "audit_report_cases": with_parts(*_R) + _REPORT_CASES + "SELECT * FROM report_cases",
    "audit_report_information": with_parts(*_R) + _SUMMARY + _REPORT_CASES + """, everything AS (SELECT ap.*, q."month" FROM ap LEFT JOIN splits q USING (row_id))
SELECT 1 AS place, 'scope' AS item, 'all rows; 1997-12 to 1998-11' AS value UNION ALL SELECT 1, 'periods and months read', count(*)::VARCHAR FROM everything
UNION ALL SELECT 1, 'without an amount in kWh', count(*)::VARCHAR FROM everything WHERE factor IS NULL OR "month" IS NULL UNION ALL SELECT 1, 'warning', 'as planted'
UNION ALL SELECT 2, 'cases: ' || issue, count(*)::VARCHAR FROM report_cases GROUP BY issue UNION ALL SELECT 3, 'kWh: ' || kpi_component, format('{:,.2f}', sum(kwh) + 1e-7) FROM summary GROUP BY kpi_component""",
    "facility_totals": with_parts(*_R) + """SELECT kpi_component, division, legal_entity, round(sum(alloc_kwh) + 1e-7, 2) AS kwh, count(DISTINCT row_id) AS periods, count(*) FILTER (alloc_kwh IS NULL) AS unavailable,
  CAST((kpi_component IS NOT NULL)::INT + (division IS NOT NULL)::INT + (legal_entity IS NOT NULL)::INT AS INT) AS level FROM al GROUP BY ROLLUP (kpi_component, division, legal_entity)""",
    "report_index": with_parts(*_R) + "SELECT kpi_component, source_file, row_number() OVER (PARTITION BY kpi_component ORDER BY facility, s NULLS FIRST, invoice_id, source_file) AS index FROM ap",
    "report_options": with_parts(*_R) + "SELECT DISTINCT 'legal_entity' AS level, legal_entity AS option FROM ap WHERE division = 'EUROPE' UNION SELECT DISTINCT 'unit_name', unit_name FROM ap WHERE division = 'EUROPE' AND legal_entity = 'FRANCE' AND unit_name <> ''",
    "case_evidence": with_parts(*_R, _CASES) + """SELECT issue, "month", x[1] AS facility, x[2] AS kpi_component, x[3] AS account, CAST(periods AS INT) AS periods, CAST(length(files) AS INT) AS files_length, links[1] AS source_1, links[2] AS source_2 FROM full_cases WHERE len(links) > 0""",
    "case_scope": with_parts(*_R, _CASES) + """, chosen AS (SELECT row_id FROM ap WHERE division = 'ASIA' AND source = 'Reviewed OCR'), hit AS (SELECT DISTINCT issue, "month", k FROM evidence WHERE issue <> 'Overlapping billing periods' AND row_id IN (SELECT row_id FROM chosen)
  UNION SELECT issue, "month", k FROM evidence WHERE issue = 'Overlapping billing periods' AND "month" LIKE '1998-%')
SELECT source_file, facility FROM ap WHERE row_id IN (SELECT row_id FROM evidence JOIN hit USING (issue, "month", k))""",
    "split_integrity": with_parts(PERIODS_SQL, RESOLVED, SPLITS) + """SELECT row_id, "month", CASE part_key % 40 WHEN 1 THEN 'no such period' WHEN 2 THEN 'another file' WHEN 3 THEN 'another account or activity' ELSE 'other dates' END AS fault FROM splits WHERE part_key % 40 BETWEEN 1 AND 4""",
    "repeated_ids": with_parts(PERIODS_SQL) + "SELECT invoice_id, count(*) AS rows FROM periods GROUP BY 1 HAVING count(*) > 1",
    "missing_mapping": with_parts(PERIODS_SQL, MAPPING_SQL) + """, k AS (SELECT division, account_number, count(*) OVER (PARTITION BY division, legal_entity, unit_name, lower(trim(activity_group)), trim(account_number)) AS n FROM mapping),
a AS (
  SELECT CASE WHEN mapping_status <> 'MAPPED' THEN mapping_status ELSE 'MAPPED' END AS st, CASE WHEN energy_unit = 'mmBTU' THEN 'Energy unit: no supported extracted or mapped unit' ELSE '' END AS msg, division, account_number, row_id FROM periods WHERE mapping_status <> 'MAPPED' OR energy_unit = 'mmBTU'
  UNION ALL SELECT 'BUSINESS_MAPPING', 'no shares', division, account_number, row_id FROM periods WHERE part_key % 31 = 4
  UNION ALL SELECT 'REPORTING_MAPPING', CASE WHEN n > 1 THEN 'Duplicate facility/KPI/account rows in the shared mapping' ELSE 'Missing expected account number' END, division, account_number, NULL FROM k WHERE n > 1 OR trim(account_number) = ''
  UNION ALL SELECT 'REPORTING_DATA', 'previous_data: ' || CASE WHEN energy_unit = 'mmBTU' THEN 'unsupported energy unit' ELSE 'missing facility' END, division, account_number, row_id FROM periods WHERE energy_unit = 'mmBTU' OR part_key % 50 = 49
)
SELECT 'scope2' AS category, st AS mapping_status, msg AS mapping_message, division, count(*) AS rows, count(DISTINCT account_number) AS accounts, count(DISTINCT row_id) AS files FROM a GROUP BY st, msg, division""",
    "reporting_accounts": with_parts(PERIODS_SQL, MAPPING_SQL) + """, kept AS (SELECT division, legal_entity, unit_name, count(*) AS expected FROM mapping WHERE (division, legal_entity, unit_name) IN (SELECT (division, legal_entity, unit_name) FROM mapping WHERE map_id % 3 = 0 AND map_id % 7 <> 0) GROUP BY ALL),
f AS (SELECT division, legal_entity, unit_name FROM kept UNION SELECT division, legal_entity, unit_name FROM periods WHERE part_key % 5 = 0) SELECT f.*, coalesce(expected, 0) AS expected FROM f LEFT JOIN kept USING (division, legal_entity, unit_name)""",
    "month_sources": with_parts(*_R) + """, b AS (SELECT *, CASE WHEN part_key % 10 = 4 THEN ' ' ELSE row_id END AS i FROM rec WHERE u IS NOT NULL),
f AS (SELECT lower(division) AS division_key, replace(lower(legal_entity), '_', ' ') AS legal_entity_key, replace(lower(u), '-', ' ') AS unit_name_key, act AS kpi, CAST(date_trunc('month', "start") AS DATE) AS "month", row_id, source_link FROM b)
SELECT division_key, legal_entity_key, unit_name_key, kpi, "month", CAST(count(DISTINCT row_id) AS INT) AS files, l[1] AS link_1, l[2] AS link_2 FROM (SELECT *, list_sort(list_distinct(list(source_link) FILTER (source_link IS NOT NULL) OVER (PARTITION BY division_key, legal_entity_key, unit_name_key, kpi, "month"))) AS l FROM f) GROUP BY ALL""",
    "dashboard_tiles": with_parts(PERIODS_SQL) + """, fx AS (SELECT *, quantity * CASE energy_unit WHEN 'kWh' THEN 1.0::DOUBLE WHEN 'MWh' THEN 1000.0::DOUBLE WHEN 'ton' THEN 720.0::DOUBLE WHEN 'RTH' THEN 0.62::DOUBLE END AS kwh, CAST(date_trunc('month', "start") AS DATE) AS m FROM periods WHERE energy_unit <> 'mmBTU'),
s AS (SELECT division, legal_entity, unit_name, activity_group AS kpi, m, sum(kwh) AS kwh FROM fx GROUP BY ALL), ends AS (SELECT date_trunc('month', min("start")) AS lo, date_trunc('month', max("start")) AS hi FROM periods),
g AS (SELECT division, legal_entity, unit_name, kpi, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS m FROM (SELECT DISTINCT division, legal_entity, unit_name, kpi FROM s WHERE replace(lower(unit_name), '-', ' ') LIKE '%u 1%'), ends),
c AS (SELECT g.*, a.kwh AS cur, b.kwh AS prev FROM g LEFT JOIN s a USING (division, legal_entity, unit_name, kpi, m) LEFT JOIN s b ON b.division = g.division AND b.legal_entity = g.legal_entity AND b.unit_name = g.unit_name AND b.kpi = g.kpi AND b.m = g.m - INTERVAL 1 YEAR)
SELECT kpi, count(*) AS cells, count(*) FILTER (cur IS NOT NULL AND prev IS NOT NULL) AS compared, count(*) FILTER (cur IS NOT NULL AND prev IS NULL) AS missing_previous, count(*) FILTER (abs(cur - prev) / abs(prev) > 0.1) AS over_10,
  (SELECT CAST(year(lo) AS INT) FROM ends) AS first_year, (SELECT CAST(year(hi) AS INT) FROM ends) AS last_year FROM c GROUP BY kpi""",
    "month_columns": with_parts(PERIODS_SQL) + "SELECT division, legal_entity, unit_name, activity_group AS kpi, CAST(year(\"start\") AS INTEGER) AS year, " + ", ".join(f'sum(quantity) FILTER (month("start") = {i + 1}) AS "{m}"' for i, m in enumerate(MONTHS)) + " FROM periods WHERE mapping_status = 'MAPPED' GROUP BY ALL",
    "duplicate_counts": with_parts(PERIODS_SQL) + """, d AS (SELECT division AS category, row_number() OVER w AS n, first_value(row_id) OVER w AS f FROM periods WINDOW w AS (PARTITION BY concat_ws('|', account_number, activity_group, quantity) ORDER BY row_id))
SELECT category, count(*) AS rows, count(*) FILTER (n > 1) AS duplicates, count(DISTINCT CASE WHEN n > 1 THEN f END) AS groups FROM d GROUP BY ROLLUP (category)""",
    "template_slice": with_parts(PERIODS_SQL) + """SELECT 'Actual' AS data_quality, division, unit_name, quantity, energy_unit AS contractual_instruments, row_id, invoice_id AS source_files, CASE WHEN part_key % 2 = 0 THEN 'Manual override' ELSE 'Review decision' END AS decision_type FROM periods""",
    "quantities_v1": with_parts(PERIODS_SQL, _OCR) + """SELECT * FROM (SELECT ocr_record_id, 'quantity_1' AS quantity_column, q1 AS quantity_value, u1 AS quantity_unit FROM ocr UNION ALL SELECT ocr_record_id, 'quantity_2', q2, u1 FROM ocr UNION ALL SELECT ocr_record_id, 'quantity_5', q5, u1 FROM ocr UNION ALL SELECT ocr_record_id, 'quantity_6', q6, u2 FROM ocr) WHERE quantity_value IS NOT NULL""",
    "selected_quantity_v1": with_parts(PERIODS_SQL, _OCR) + """SELECT ocr_record_id, CASE WHEN part_key % 8 = 0 THEN 'quantity_6' ELSE 'quantity_1' END AS selected_quantity_column, CASE WHEN part_key % 8 = 0 THEN q6 ELSE q1 END AS amount, CASE WHEN part_key % 4 = 0 THEN u2 ELSE u1 END AS energy_unit, CASE WHEN part_key % 4 = 0 THEN 'by hand' END AS reason FROM ocr""",
    "enriched_v1": with_parts(PERIODS_SQL, MAPPING_SQL, _OCR, _V1) + "SELECT * FROM enr",
    "upload_v1": with_parts(PERIODS_SQL, MAPPING_SQL, _OCR, _V1) + """, x AS (SELECT e.*, o.part_key AS k, p."start" AS s, p."end" AS t, CASE WHEN o.part_key % 4 = 0 THEN q6 ELSE q1 END AS amount, CASE WHEN o.part_key % 4 = 0 THEN u2 ELSE u1 END AS unit FROM enr e JOIN ocr o USING (ocr_record_id) JOIN periods p ON p.row_id = e.ocr_record_id WHERE mapping_needs_review = 0 AND o.part_key % 9 <> 1),
y AS (SELECT *, 'Fossil Fuels' AS kpi FROM x UNION ALL SELECT *, 'Renewable sources' FROM x WHERE k % 5 = 0)
SELECT 'Actual' AS "Data quality", CASE activity_group WHEN 'electricity' THEN 'Purchased electricity' WHEN 'steam' THEN 'Purchased steam' ELSE activity_group END AS "KPI Component", division AS "Division", legal_entity AS "Legal Entity Name", unit_name AS "Unit", s AS "Consumption start date", t AS "Consumption end date",
  CAST(NULL AS DATE) AS "Transaction Date", kpi AS "Energy KPI", activity_group AS "Energy Type", 'Purchased' AS "Purchased or acquired", amount AS "Amount of energy consumed", unit AS "Energy Unit", CASE WHEN k % 6 = 0 THEN 'Green tariff' ELSE 'No contractual instrument - emission factors unknown' END AS "Contractual instrument used" FROM y""",
    "original_quantities": with_parts(PERIODS_SQL, RESOLVED, SPLITS) + """SELECT CASE WHEN part_key % 6 <> 0 THEN 'https://bills.example/' || invoice_id ELSE 'SharePoint link unavailable' END AS source_link, energy_unit AS original_unit, f AS factor, flow AS source, supplier_name, count(*) AS periods, round(sum(quantity), 2) AS billed_original FROM resolved LEFT JOIN factors ON unit = energy_unit WHERE row_id IN (SELECT row_id FROM splits) GROUP BY ALL""",
    "dq_v1": with_parts(PERIODS_SQL, MAPPING_SQL, _OCR, _V1) + """SELECT ocr_record_id, 'unmatched' AS check FROM enr WHERE mapping_id IS NULL OR mapping_needs_review = 1 UNION ALL SELECT ocr_record_id, 'contract missing' FROM enr WHERE activity_group = 'electricity' AND contract_id IS NULL UNION ALL SELECT ocr_record_id, 'upload' FROM enr WHERE mapping_needs_review = 0""".replace(" AS check", ' AS "check"'),
    "constraints_v1": with_parts(ALLOCATION_SQL) + """, a AS (SELECT lookup_id, fossil + CASE WHEN lookup_id % 40 = 0 THEN 1 ELSE 0 END AS fossil, renewable, nuclear FROM allocation)
SELECT CAST(lookup_id AS VARCHAR) AS id, 'fossil between 0 and 1' AS "constraint" FROM a WHERE fossil NOT BETWEEN 0 AND 1 UNION ALL SELECT CAST(lookup_id AS VARCHAR), 'shares total 1' FROM a WHERE fossil + renewable + nuclear NOT BETWEEN 0.99 AND 1.01
UNION ALL SELECT coalesce(nullif(l_account, ''), ''), 'unique account_number' FROM (SELECT l_account, count(*) AS n FROM allocation GROUP BY 1) WHERE n > 1""",
}
