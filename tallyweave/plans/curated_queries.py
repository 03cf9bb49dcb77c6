"""Registered queries of the curated layer, mapping files, contracts, segments, tiles and reviews from saved tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import text, units
from tallyweave.operators import bronze, enrich, lineage, periods, review, rollup, silver
from tallyweave.sources import config, lens, readers, sinks

from . import reports
from .oracle_parts import ALLOCATED, BRONZE_SQL, DECISIONS_SQL, MAPPING_SQL, MONTHLY, PERIODS_SQL, QUALITY, RESOLVED, SPLITS, with_parts
from .shared import scratch, write_and_read

FACILITY = ["division", "legal_entity", "unit_name"]
FIELDS = {"account_number": "critical", "supplier_name": "optional", "energy_unit": "noncritical", "quantity": "critical"}


def curated_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of the curated layer, of extracted lines and of manual entries in the same shape."""
    lines = lens.periods(spark, sf_dir).where("flow <> 'Manual entry'").selectExpr(
        "row_id invoice_id", "line_id", *FACILITY, "account_number", "case when tax > 0.075 then ' ' else supplier_name end supplier_name", "1 - 5 * discount account_number_confidence", "1 - 10 * tax supplier_name_confidence",
        "cast(start as string) consumption_start_date_1_normalized", "cast(end as string) consumption_end_date_1_normalized", "cast(cast(quantity as int) as string) quantity_1", "case when part_key % 3 = 0 then cast(supplier_key as string) end quantity_2",
        "case when part_key % 4 <> 0 then energy_unit end quantity_unit_1", "case part_key % 3 when 0 then 'RTH' when 1 then 'kWh and MWh' end consumption_unit", "case part_key % 5 when 0 then 'tons' end quantity_unit_2",
        "substr(division, 1, 2) division_shorthand", "'Scope 2' scope", "case when part_key % 11 = 2 then 'Gas' else activity_group end activity_group", "concat(row_id, '.json') source_file", "'succeeded' status", "cast(start as string) createdDateTime",
        "cast(end as string) lastUpdateDateTime", "'2024-11-30' apiVersion", "'prebuilt' modelId", "mapping_status", "'ACCOUNT' mapping_method", "'' mapping_message", "account_number extracted_account_number", "0.5 document_confidence", "case part_key % 6 when 0 then ' ' when 1 then 'Estimated' end data_quality",
    )
    lines = silver.confidence_summary(silver.with_quantity_unit(silver.with_data_quality(lines)), ["account_number", "supplier_name"], 0.7)
    entries = lens.periods(spark, sf_dir).where("flow = 'Manual entry'").selectExpr("row_id invoice_id", "line_id", "division", "legal_entity legal_entity_name", "unit_name unit", "account_number", "activity_group", "cast(start as string) consumption_start_date", "cast(end as string) consumption_end_date", "energy_unit", "'COMPLETED' manual_entry_status", "case when part_key % 2 = 0 then 'Estimated' end data_quality")
    columns = list(silver.CURATED_COLUMNS)
    return silver.curated(silver.validated_activity(lines), columns).unionByName(silver.curated(silver.manual_rows(entries), columns))


def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document says of itself, and the link to it; some say less than others."""
    k = F.substring("source_file", 5, 20).cast("long")
    link = F.concat(F.lit('{"sharepoint_link":"https://bills.example/'), "source_file", F.lit('","modelId":"m'), (k % 3).cast("string"), F.lit('",'))
    docs = lens.documents_json(spark, sf_dir).withColumn("json", F.when(k % 4 == 0, F.concat(link, F.substring("json", 2, 1 << 30))).otherwise(F.col("json")))
    return bronze.with_metadata(bronze.parsed(docs)).select("source_file", *bronze.METADATA)


def mapping_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The account mapping written as a CSV file with names of its own and read back under the canonical ones."""
    own = lens.mapping(spark, sf_dir).selectExpr(
        "map_id `Id`", "account_number `Account #`", "case when map_id % 3 = 0 then 'ACC?' end `account_number`", "division `Division`", "legal_entity `Legal Entity Name`", "unit_name `UNIT`", "supplier_name `Supplier`", "'D' `division-shorthand`", "'Plant' `Facility Type`", "'Scope 2' `Scope`", "concat('F', map_id div 1000) `Facility Identifier`",
        "upper(activity_group) `Energy Type`", "'12' `Invoice Count`", "'monthly' `Invoice frequency`", "case when map_id % 2 = 0 then 'kWh' else ' ' end `Energy Unit`", "'.' `Decimal separator`", "'EUR' `Currency`",
    )
    path = f"{scratch(spark, 'mapping')}/csv"
    own.write.option("header", True).csv(path)
    out = readers.account_mapping(readers.named_table(spark, path))
    return out.select(F.col("Id").cast("long").alias("map_id"), *readers.MAPPING_COLUMNS)


def _contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts of the mapping's units and suppliers by month: one for any account, for some accounts two that cannot be told apart."""
    sites = lens.mapping(spark, sf_dir).groupBy("unit_name", "supplier_name").agg(F.min("map_id").alias("id"))
    months = F.explode(F.sequence(F.lit("1996-01-01").cast("date"), F.lit("1997-12-01").cast("date"), F.expr("interval 1 month")))
    rows = sites.withColumn("month", months).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(2)))).where("v <> 2 or id div 100 % 5 = 0")
    return rows.select(F.concat_ws("-", "id", "month", "v").alias("lookup_id"), F.array(text.lookup_key(F.col("unit_name"), F.col("supplier_name"), F.col("month"))).alias("keys"), F.expr("case when v > 0 then concat('ACC-', id div 100, '-4') end account_number"), F.expr("cast(null as string) activity_group"), F.expr("concat('Contract ', id) contractual_instruments"))


def contract_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All issues of monthly rows: unit, shares, contract; and the contract where it is clear."""
    rows = rollup.monthly_rollup(periods.month_split(periods.resolve_dates(lens.periods(spark, sf_dir))), ("flow",))
    rows = rows.withColumn("row_id", F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in [*rollup.MONTHLY_KEY, "flow"]))).withColumn("key", text.lookup_key(F.col("unit_name"), F.col("supplier_name"), F.col("month")))
    shares = {"fossil": "fossil_fuel_%", "renewable": "renewable_energy_%", "nuclear": "nuclear_%", "generation": "solar_total_generation"}
    rows = enrich.specific_lookup(rows, lens.allocation(spark, sf_dir), list(shares)).withColumnsRenamed(shares).withColumn("solar_export", F.lit(None).cast("double"))
    contracts = enrich.specific_lookup(rows.select("row_id", "key", "account_number", "activity_group"), _contracts(spark, sf_dir), ["contractual_instruments"])
    rows = rows.join(contracts.select("row_id", "contractual_instruments", F.col("lookup_issue").alias("contract_issue")), "row_id")
    return rollup.business_rows(rows).select("row_id", "contractual_instruments", F.col("business_mapping_issue").alias("issue"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits of lines that name two periods, which an extraction repeats at times: each segment once."""
    rows = periods.resolve_dates(lens.periods(spark, sf_dir))
    splits = periods.month_split(rows).select("row_id", "period_index", "month", "split_start", "split_end", "split_quantity", "part_key")
    again = splits.where("part_key % 4 = 0")
    second = again.withColumn("period_index", F.lit(2))
    out = periods.distinct_segments(splits.union(again).union(second).union(second))
    return out.groupBy("period_index", "month").agg(F.count("*").alias("segments"), F.countDistinct("row_id").alias("rows"), F.round(F.sum("split_quantity"), 2).alias("quantity"))


def completeness_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of the completeness page, a row a KPI."""
    rows = lens.periods(spark, sf_dir).withColumn("kpi", F.col("activity_group"))
    accounts = rows.where("account_number is not null and mapping_status = 'MAPPED'").select(*FACILITY, "kpi", "account_number").distinct().withColumns({"effective_start": F.lit(None).cast("date"), "effective_end": F.when(F.length("account_number") % 2 == 0, F.lit("1996-06-10").cast("date"))})
    ends = rows.agg(F.min(F.trunc("start", "MM")).alias("first"), F.max(F.trunc("start", "MM")).alias("last")).first()
    cells = reports.completeness(accounts, rows, [a for a, _ in reports.months_of(ends)])
    return reports.completeness_tiles(cells, ("kpi",))


def approval_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved lines of each category, by who approved them."""
    rows = lens.bronze_rows(spark, sf_dir)
    summary = review.review_summary(review.field_quality(rows, FIELDS))
    return reports.approval_counts(review.approve(rows, summary, lens.decisions(spark, sf_dir), list(FIELDS)), ("category",))


def waste_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The waste review run again from its saved bronze: what reviewers decided the first time still counts, by issue or by value."""
    waste = config.own_category("waste")
    saved = write_and_read(spark, lambda p: waste.bronze(lens.documents_json(spark, sf_dir)).withColumns({"invoice_id": F.col("source_file"), "waste_confidence": F.col("total_confidence")}).write.parquet(p))
    none = spark.createDataFrame([], "issue_id string, invoice_id string, line_id string, field_name string, original_value string, review_decision string, corrected_value string")
    first = waste.reviewed(saved, none).issues.where("field_name <> 'account' or ocr_value not like '%7'")
    decided = first.select(
        F.when(F.col("line_id") == "1", F.col("issue_id")).otherwise(F.concat(F.lit("old_"), "issue_id")).alias("issue_id"), "invoice_id", "line_id", "field_name", F.col("ocr_value").alias("original_value"),
        F.when(F.col("field_name") == "account", "CORRECTED").otherwise("APPROVED").alias("review_decision"), F.when(F.col("field_name") == "account", F.concat(F.lit("A-"), "ocr_value")).alias("corrected_value"),
    )
    again = waste.reviewed(saved, write_and_read(spark, lambda p: decided.write.parquet(p)))
    approved = again.approved.select(*review.LINE, "approval_status", "account", "total", "waste", "manual_review_decision_count")
    waiting = again.waiting.select(*review.LINE, F.lit(True).alias("waiting"))
    out = again.summary.select(*review.LINE, "review_status").join(approved, review.LINE, "left").join(waiting, review.LINE, "left")
    return out.withColumns({"waiting": F.coalesce("waiting", F.lit(False)), "decisions": F.coalesce("manual_review_decision_count", F.lit(0)).cast("long")}).drop("manual_review_decision_count")


def variance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells over 10 % beside the files of both years and the links of their own."""
    rows = lens.periods(spark, sf_dir)
    facts = reports.reporting_rows(rows.selectExpr("*", "activity_group kpi", "quantity amount", "start date", "'' issue", "row_id source_files", "case when part_key % 6 <> 0 then concat('https://bills.example/', invoice_id) end source_link"))[0]
    ends = rows.agg(F.min(F.trunc("start", "MM")).alias("first"), F.max(F.trunc("start", "MM")).alias("last")).first()
    sources = reports.monthly_sources(facts)
    out = reports.variance_report(reports.year_over_year(facts, facts, facts, reports.months_of(ends)), sources, sources)
    out = lineage.widened(out, "links", "link_", 2).withColumns({c: F.round(F.col(c) + 1e-7, 4) for c in ("previous", "current", "size")})
    return out.withColumns({c: F.length(c) for c in ("current_files", "previous_files")} | {"digest": F.md5(F.concat_ws("|", "current_files", "previous_files"))})


def filtered_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose columns contain what was typed above each."""
    found = text.holds_all({"supplier_name": " ER#00000000 ", "activity_group": "EA", "account_number": "-1", "unit_name": "  ", "part_key": "7"})
    return lens.periods(spark, sf_dir).where(found).select("row_id", "supplier_name", "activity_group", "account_number")


def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kWh by the usual factors, and by a reader's own, which know another unit and lack one."""
    rows = lens.periods(spark, sf_dir)
    amount, unit = F.col("quantity"), F.col("energy_unit")
    usual, own = units.to_kwh(amount, unit), units.to_kwh(amount, F.concat(F.lit(" "), F.lower(unit)), {"KWH": 1.0, "MWH": 1000.0, "MMBTU": 293.0, "TON": 700.0})
    return rows.groupBy("legal_entity", "energy_unit").agg(F.round(F.sum(usual), 2).alias("usual"), F.round(F.sum(own), 2).alias("own"))


def typed_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of an export as dates, numbers and links, written and read back."""
    rows = lens.periods(spark, sf_dir).selectExpr(
        "row_id", "case part_key % 4 when 0 then date_format(start, 'dd/MM/yyyy') when 1 then '' else cast(start as string) end start", "case part_key % 5 when 0 then 'n/a' when 1 then concat(' 1,', lpad(cast(part_key % 1000 as string), 3, '0'), '.5 ') else cast(quantity as string) end amount",
        "case when part_key % 3 = 0 then ' ' else concat(' https://bills.example/', invoice_id, ' ') end link", "case when part_key % 2 = 0 then '01.02.2024' end raw_date",
    )
    return write_and_read(spark, lambda p: sinks.typed(rows, ["start", "absent"], ["amount"], ["link"]).write.parquet(p))


QUERIES = {f.__name__: f for f in (curated_layer, document_metadata, mapping_file, contract_issues, segments, completeness_tiles, approval_tiles, waste_rerun, variance_report, filtered_columns, unit_conversion, typed_export)}

_NONE = ("consumption_start_date_2_normalized", "consumption_end_date_2_normalized", "quantity_3", "quantity_4", "quantity_5", "quantity_6", "total_amount", "solar_export", "solar_banking_charge", "solar_total_generation", "facility_type", "facility_identifier", "invoice_count", "sharepoint_link")
_LINES = {
    "invoice_id": "row_id", "line_id": "line_id", "data_quality": "CASE WHEN part_key % 6 = 1 THEN 'Estimated' ELSE 'Actual' END", "division": "division", "legal_entity": "legal_entity", "unit_name": "unit_name", "account_number": "account_number", "supplier_name": "supplier",
    "consumption_start_date_1_normalized": "CAST(\"start\" AS VARCHAR)", "consumption_end_date_1_normalized": "CAST(\"end\" AS VARCHAR)", "quantity_1": "CAST(CAST(quantity AS INT) AS VARCHAR)", "quantity_2": "CASE WHEN part_key % 3 = 0 THEN CAST(supplier_key AS VARCHAR) END",
    "quantity_unit_1": "CASE WHEN part_key % 4 <> 0 THEN energy_unit END", "consumption_unit": "CASE part_key % 3 WHEN 0 THEN 'RTH' WHEN 1 THEN 'kWh and MWh' END",
    "consumption_quantity_unit": "CASE WHEN part_key % 4 <> 0 AND energy_unit <> 'mmBTU' THEN upper(energy_unit) WHEN part_key % 3 = 0 THEN 'RTH' ELSE '' END", "quantity_unit_2": "CASE part_key % 5 WHEN 0 THEN 'tons' END", "division_shorthand": "division[1:2]", "scope": "'Scope 2'",
    "activity_group": "act", "source_file": "row_id || '.json'", "status": "'succeeded'", "createdDateTme": "CAST(\"start\" AS VARCHAR)", "lastUpdateDateTime": "CAST(\"end\" AS VARCHAR)", "apiVersion": "'2024-11-30'", "modelID": "'prebuilt'",
    "missing_fields": "concat_ws(';', CASE WHEN account_number IS NULL THEN 'account_number' END, CASE WHEN supplier = ' ' THEN 'supplier_name' END)",
    "low_confidence_fields": "concat_ws(';', CASE WHEN account_number IS NOT NULL AND 1 - 5 * discount < 0.7 THEN 'account_number' END, CASE WHEN supplier <> ' ' AND 1 - 10 * tax < 0.7 THEN 'supplier_name' END)",
    "mapping_status": "CASE WHEN mapping_status = 'MAPPED' AND act = 'Gas' THEN 'INCOMPLETE' ELSE mapping_status END", "mapping_method": "'ACCOUNT'",
    "mapping_message": "CASE WHEN mapping_status = 'MAPPED' AND act = 'Gas' THEN 'Scope 2 activity group must be Electricity, Steam, Heat, or Cool.' ELSE '' END", "extracted_account_number": "account_number",
}
_ENTRIES = {
    "data_quality": "CASE WHEN part_key % 2 = 0 THEN 'Estimated' END", "division": "division", "legal_entity": "legal_entity", "unit_name": "unit_name", "account_number": "account_number", "activity_group": "activity_group", "consumption_start_date_1_normalized": "CAST(\"start\" AS VARCHAR)",
    "consumption_end_date_1_normalized": "CAST(\"end\" AS VARCHAR)", "quantity_unit_1": "energy_unit", "consumption_unit": "energy_unit", "consumption_quantity_unit": "CASE WHEN energy_unit <> 'mmBTU' THEN upper(energy_unit) ELSE '' END", "status": "'COMPLETED'", "approval_status": "'COMPLETED'", "manual_review_tag": "'MANUAL_DATA_ENTRY'",
}


def _listed(values: dict[str, str]) -> str:
    return ", ".join(f'{values.get(c, "CAST(NULL AS VARCHAR)")} AS "{c}"' for c in silver.CURATED_COLUMNS)


ORACLE_SQL = {
    "curated_layer": with_parts(PERIODS_SQL) + f""", u AS (SELECT *, CASE WHEN tax > 0.075 THEN ' ' ELSE supplier_name END AS supplier, CASE WHEN part_key % 11 = 2 THEN 'Gas' ELSE activity_group END AS act FROM periods)
SELECT {_listed(_LINES)} FROM u WHERE flow <> 'Manual entry' UNION ALL SELECT {_listed(_ENTRIES)} FROM periods WHERE flow = 'Manual entry'""",
    "document_metadata": """SELECT 'doc-' || o_orderkey AS source_file, CASE WHEN o_orderkey % 4 = 0 THEN 'https://bills.example/doc-' || o_orderkey END AS sharepoint_link, (o_orderkey % 10) / 10 AS document_confidence, o_orderstatus AS status, CAST(NULL AS VARCHAR) AS "createdDateTime", CAST(NULL AS VARCHAR) AS "lastUpdatedDateTime",
  CAST(NULL AS VARCHAR) AS "apiVersion", CASE WHEN o_orderkey % 4 = 0 THEN 'm' || (o_orderkey % 3) END AS "modelId" FROM orders""",
    "mapping_file": with_parts(MAPPING_SQL) + """SELECT map_id, CASE WHEN map_id % 3 = 0 THEN 'ACC?' WHEN trim(account_number) <> '' THEN account_number END AS account_number, division, legal_entity, unit_name, supplier_name, 'D' AS division_shorthand, 'Plant' AS facility_type, 'Scope 2' AS scope, 'F' || (map_id // 1000) AS facility_identifier,
  CASE trim(activity_group) WHEN 'cool' THEN 'Cool' ELSE activity_group END AS activity_group, '12' AS invoice_count, 'monthly' AS invoice_frequency, CASE WHEN map_id % 2 = 0 THEN 'kWh' END AS consumption_unit, '.' AS decimal_separator, 'EUR' AS currency FROM mapping""",
    "contract_issues": with_parts(PERIODS_SQL, RESOLVED, SPLITS, MONTHLY, ALLOCATED, MAPPING_SQL) + """, sites AS (SELECT unit_name, supplier_name, min(map_id) AS id FROM mapping GROUP BY ALL),
con AS (SELECT unit_name, supplier_name, CAST(unnest(generate_series(DATE '1996-01-01', DATE '1997-12-01', INTERVAL 1 MONTH)) AS DATE) AS "month", id FROM sites),
fit AS (SELECT row_id, id, account_number = 'ACC-' || (id // 100) || '-4' AS own, id // 100 % 5 = 0 AS twice, allocated.activity_group = 'Electricity' AS electric FROM allocated JOIN con USING (unit_name, supplier_name, "month")),
named AS (SELECT row_id, id, coalesce(own AND twice, false) AS tied FROM fit WHERE own OR electric),
a AS (SELECT a.*, CASE WHEN NOT tied THEN 'Contract ' || id END AS contractual_instruments, coalesce(tied, false) AS tied FROM allocated a LEFT JOIN named USING (row_id))
SELECT row_id, contractual_instruments, concat_ws('; ', CASE WHEN energy_unit NOT IN (SELECT unit FROM factors) THEN 'Energy unit: no supported extracted or mapped unit' END, 'Energy source allocation: ' || CASE WHEN lookup_issue <> '' THEN lookup_issue
  WHEN fossil IS NULL OR renewable IS NULL OR nuclear IS NULL THEN 'missing allocation percentages' WHEN abs(fossil + renewable + nuclear - 1) > 1e-6 THEN 'allocation percentages must total 1 (100%)' END,
  CASE WHEN tied THEN 'Contract: ambiguous mapping; specify account_number and activity_group' END) AS issue FROM a""",
    "segments": with_parts(PERIODS_SQL, RESOLVED, SPLITS) + """, s AS (SELECT row_id, 1 AS period_index, "month", split_start, split_end, split_quantity FROM splits UNION SELECT row_id, 2, "month", split_start, split_end, split_quantity FROM splits WHERE part_key % 4 = 0)
SELECT period_index, "month", count(*) AS segments, count(DISTINCT row_id) AS rows, round(sum(split_quantity), 2) AS quantity FROM s GROUP BY ALL""",
    # by days: every day that is due, and whether a period of its account covers it
    "completeness_tiles": with_parts(PERIODS_SQL) + """, ends AS (SELECT CAST(date_trunc('month', min("start")) AS DATE) AS lo, last_day(max("start")) AS hi FROM periods),
a AS (SELECT DISTINCT division, legal_entity, unit_name, activity_group AS kpi, account_number, CASE WHEN length(account_number) % 2 = 0 THEN DATE '1996-06-10' END AS ee FROM periods WHERE account_number IS NOT NULL AND mapping_status = 'MAPPED'),
due AS (SELECT division, legal_entity, unit_name, kpi, account_number, CAST(unnest(generate_series(lo, least(hi, coalesce(ee, hi)), INTERVAL 1 DAY)) AS DATE) AS d FROM a, ends),
days AS (SELECT DISTINCT division, legal_entity, unit_name, activity_group AS kpi, account_number, CAST(unnest(generate_series("start", "end", INTERVAL 1 DAY)) AS DATE) AS d FROM periods WHERE "end" >= "start"),
cells AS (SELECT division, legal_entity, unit_name, kpi, date_trunc('month', due.d) AS m, count(*) AS expected, count(days.d) AS covered FROM due LEFT JOIN days USING (division, legal_entity, unit_name, kpi, account_number, d) GROUP BY ALL)
SELECT kpi, (SELECT count(*) FROM (SELECT DISTINCT division, legal_entity, unit_name FROM a WHERE a.kpi = cells.kpi)) AS facilities, count(DISTINCT (division, legal_entity, unit_name)) FILTER (covered > 0) AS facilities_with_data, count(*) FILTER (covered = expected) AS complete_months, count(*) FILTER (covered > 0 AND covered < expected) AS partial_months FROM cells GROUP BY kpi""",
    "approval_tiles": with_parts(PERIODS_SQL, BRONZE_SQL, QUALITY, DECISIONS_SQL) + """, good AS (SELECT DISTINCT line_id FROM decisions WHERE review_decision IN ('APPROVED', 'CORRECTED', 'NOT_APPLICABLE'))
SELECT category, count(*) AS approved, count(*) FILTER (g.line_id IS NULL) AS auto_approved, count(g.line_id) AS manually_approved FROM summaries s JOIN bronze b USING (line_id) LEFT JOIN good g USING (line_id) WHERE NOT s.review_required OR g.line_id IS NOT NULL GROUP BY category""",
    "variance_report": with_parts(PERIODS_SQL) + """, fx AS (SELECT *, quantity * CASE energy_unit WHEN 'kWh' THEN 1.0::DOUBLE WHEN 'MWh' THEN 1000.0::DOUBLE WHEN 'ton' THEN 720.0::DOUBLE WHEN 'RTH' THEN 0.62::DOUBLE END AS kwh, CAST(date_trunc('month', "start") AS DATE) AS m, CASE WHEN part_key % 6 <> 0 THEN 'https://bills.example/' || invoice_id END AS link FROM periods WHERE energy_unit <> 'mmBTU'),
s AS (SELECT division, legal_entity, unit_name, activity_group, m, sum(kwh) AS kwh, string_agg(DISTINCT lower(row_id), chr(10) ORDER BY lower(row_id)) AS files, list_sort(list_distinct(list(link) FILTER (link IS NOT NULL))) AS links FROM fx GROUP BY ALL),
v AS (SELECT a.*, b.kwh AS before, b.files AS old, (a.kwh - b.kwh) / abs(b.kwh) AS p FROM s a JOIN s b ON b.division = a.division AND b.legal_entity = a.legal_entity AND b.unit_name = a.unit_name AND b.activity_group = a.activity_group AND b.m = a.m - INTERVAL 1 YEAR)
SELECT division, legal_entity, unit_name, activity_group AS kpi, m AS "month", round(before + 1e-7, 4) AS previous, round(kwh + 1e-7, 4) AS current, round(p + sign(p) * 1e-10, 4) AS difference, round(abs(p) + 1e-7, 4) AS size, length(files) AS current_files, length(old) AS previous_files, md5(files || '|' || old) AS digest, links[1] AS link_1, links[2] AS link_2 FROM v WHERE abs(p) > 0.1""",
    "filtered_columns": with_parts(PERIODS_SQL) + """SELECT row_id, supplier_name, activity_group, account_number FROM periods WHERE supplier_name ILIKE '%er#00000000%' AND activity_group ILIKE '%ea%' AND account_number LIKE '%-1%' AND CAST(part_key AS VARCHAR) LIKE '%7%'""",
    "unit_conversion": with_parts(PERIODS_SQL) + """SELECT legal_entity, energy_unit, round(sum(quantity * CASE energy_unit WHEN 'kWh' THEN 1.0 WHEN 'MWh' THEN 1000.0 WHEN 'ton' THEN 720.0 WHEN 'RTH' THEN 0.62 END), 2) AS usual, round(sum(quantity * CASE energy_unit WHEN 'kWh' THEN 1 WHEN 'MWh' THEN 1000 WHEN 'mmBTU' THEN 293 WHEN 'ton' THEN 700 END), 2) AS own FROM periods GROUP BY ALL""",
    "typed_export": with_parts(PERIODS_SQL) + """SELECT row_id, CASE WHEN part_key % 4 > 1 THEN "start" END AS "start", CASE part_key % 5 WHEN 0 THEN NULL WHEN 1 THEN 1000 + part_key % 1000 + 0.5 ELSE quantity END AS amount, CASE WHEN part_key % 3 <> 0 THEN 'https://bills.example/' || invoice_id END AS link, CASE WHEN part_key % 2 = 0 THEN '01.02.2024' END AS raw_date FROM periods""",
    "waste_rerun": """WITH b AS (SELECT 'doc-' || o_orderkey AS invoice_id, CAST(i + 1 AS VARCHAR) AS line_id, CAST(o_custkey AS VARCHAR) AS account, (o_orderkey % 10) / 10 AS c, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_totalprice AS VARCHAR) END AS total,
  CASE WHEN i < o_orderkey % 4 THEN CAST(o_orderkey % 7 + i AS VARCHAR) END AS qty, CASE WHEN i < o_orderkey % 4 THEN 'Kind ' || (o_orderkey % 3 + i) END AS waste FROM orders, range(3) t(i) WHERE i < greatest(o_orderkey % 4, 1)),
u AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY concat_ws('|', account, total, qty, waste) ORDER BY invoice_id, line_id) = 1),
f AS (SELECT *, c < 0.8 AS account_issue, waste IS NULL OR c < 0.8 AS waste_issue, CASE WHEN waste IS NULL THEN 'BLOCKED' WHEN c < 0.8 THEN 'REVIEW_REQUIRED' WHEN total IS NULL THEN 'OPTIONAL_FIELD_WARNING' ELSE 'AUTO_APPROVED' END AS review_status FROM u),
d AS (SELECT *, account_issue AND account NOT LIKE '%7' AS corrected, CASE WHEN account_issue AND account NOT LIKE '%7' THEN 1 ELSE 0 END + CASE WHEN waste_issue THEN 1 ELSE 0 END AS n FROM f),
g AS (SELECT *, n > 0 OR review_status NOT IN ('BLOCKED', 'REVIEW_REQUIRED') AS good FROM d)
SELECT invoice_id, line_id, review_status, CASE WHEN n > 0 THEN 'MANUALLY_APPROVED' WHEN good THEN 'AUTO_APPROVED' END AS approval_status, CASE WHEN good THEN CASE WHEN corrected THEN 'A-' || account ELSE account END END AS account, CASE WHEN good THEN total END AS total,
  CASE WHEN good THEN waste END AS waste, account_issue AND NOT corrected AS waiting, CAST(n AS BIGINT) AS decisions FROM g""",
}
