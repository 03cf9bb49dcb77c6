"""The engine's registered queries: each applies operators to whole tables through the lens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import dates, keys, numbers, text, units
from tallyweave.operators import bronze, enrich, gold, periods, review, rollup
from tallyweave.plans import archive_v1, audit, curated_queries, report_queries, reports, review_queries, silver_queries, state_queries
from tallyweave.plans.shared import scratch
from tallyweave.sources import lens
from tallyweave.streaming import stream

def _round(c: str, digits: int):
    """Rounded with ties that floating sums leave undecided moved off the edge."""
    return F.round(F.col(c) + 1e-7, digits)


FACILITY = ["division", "legal_entity", "unit_name"]
FIELDS = {"account_number": "critical", "supplier_name": "optional", "energy_unit": "noncritical", "quantity": "critical"}
DOCUMENT_FIELDS = {"account": ["Account No", "Customer Account"], "total": ["Total", "Amount"]}


def _months(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    """Every month in which a period starts, from the first to the last, with the same month a year before."""
    ends = lens.periods(spark, sf_dir).agg(F.min(F.trunc("start", "MM")).alias("first"), F.max(F.trunc("start", "MM")).alias("last"))
    return reports.months_of(ends.first())


def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.month_split(periods.resolve_dates(lens.periods(spark, sf_dir)))


def monthly_kwh(spark: SparkSession, sf_dir: str) -> DataFrame:
    kwh = units.to_kwh(F.col("split_quantity"), F.col("energy_unit"))
    out = _splits(spark, sf_dir).where(rollup.passes_mapping_gate()).groupBy(*FACILITY, "activity_group", "month").agg(F.sum(kwh).alias("kwh"), F.count("*").alias("splits"))
    return out.withColumn("kwh", _round("kwh", 4))


def billing_date_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periods.resolve_dates(lens.periods(spark, sf_dir))
    return out.select("row_id", "effective_start", "effective_end", "date_adjustment", "date_resolution", "resolution_reference", "date_provisional")


def billing_overlap_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.overlap_flags(lens.periods(spark, sf_dir)).select("row_id", "conflict")


def interval_union_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.covered_days(lens.periods(spark, sf_dir), [*FACILITY, "activity_group"])


def day_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.day_coverage(lens.periods(spark, sf_dir), ["legal_entity", "unit_name", "supplier_name"])


def month_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _splits(spark, sf_dir).select("row_id", "month", "split_start", "split_end", "split_days", "total_days", F.round("split_quantity", 6).alias("split_quantity"))
    return out


def period_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.periods(spark, sf_dir).selectExpr("row_id", "start s1", "end e1", "quantity q1", "case when part_key % 4 = 0 then date_add(end, 1) end s2", "case when part_key % 4 = 0 then date_add(end, 30) end e2", "case when part_key % 8 < 5 then quantity / 2 end q2")
    first, second = periods.horizontal_quantity([F.col("q1"), F.col("q2")], F.col("s2").isNotNull())
    rows = rows.withColumns({"t1": first, "t2": second})
    return periods.stacked(rows, [{"start": "s1", "end": "e1", "quantity": "t1"}, {"start": "s2", "end": "e2", "quantity": "t2"}], ["row_id"])


def duplicate_marking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.periods(spark, sf_dir).withColumn("source_file", F.col("row_id"))
    key = keys.typed_key([F.col("start")], [F.col("quantity")], [F.col("account_number"), F.col("activity_group")])
    content = keys.hash128(*(F.col(c) for c in ("account_number", "activity_group", "start", "quantity", "energy_unit", "end")))
    # without an account too little is left to tell two bills apart
    rows = rows.withColumn("business_key", F.when(F.col("account_number").isNotNull(), key)).withColumn("content_hash", F.when(F.col("account_number").isNotNull(), content))
    return bronze.mark_duplicates(rows, ["source_file"]).select("source_file", "duplicate_status", "duplicate_of", "match_type")


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.field_quality(lens.bronze_rows(spark, sf_dir), FIELDS)


def field_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir).select("line_id", "field", "criticality", "threshold", "field_status", "reason_code")


def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_summary(_quality(spark, sf_dir)).withColumn("min_critical_confidence", F.round("min_critical_confidence", 6))


def review_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_issues(_quality(spark, sf_dir)).select("issue_id", "line_id", "field_name", "issue_type", "severity", "ocr_value")


def approval_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = review.review_summary(_quality(spark, sf_dir))
    out = review.approve(lens.bronze_rows(spark, sf_dir), summary, lens.decisions(spark, sf_dir), list(FIELDS))
    return out.select("line_id", *FIELDS, "approval_status", "manual_review_decision_count")


def _old_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of a run before: some under the same issue, some under another line of the invoice, some overrides."""
    issues = review.review_issues(_quality(spark, sf_dir))
    n = F.length("issue_id") % 3
    ids = F.when(n == 0, F.col("issue_id")).when(n == 1, F.concat(F.lit("old_"), "issue_id")).otherwise(F.concat(F.lit("override_"), "issue_id"))
    return issues.select(ids.alias("issue_id"), "invoice_id", "line_id", "field_name", F.col("ocr_value").alias("original_value"), F.when(F.col("severity") == "HIGH", "APPROVED").otherwise("REJECTED").alias("review_decision"), F.col("issue_type").alias("corrected_value"))


def decision_carryover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.carry_decisions(review.review_issues(_quality(spark, sf_dir)), _old_decisions(spark, sf_dir)).select("issue_id", "line_id", "field_name", "review_decision", "corrected_value")


def open_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = _quality(spark, sf_dir)
    return review.open_queue(review.review_summary(quality), review.review_issues(quality), _old_decisions(spark, sf_dir)).select("line_id", "review_status", "review_severity")


def latest_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = lens.decisions(spark, sf_dir).withColumn("reviewed_at", F.lit("2024-01-01"))
    return review.latest(log, ["line_id", "field_name"]).select("line_id", "field_name", "seq", F.upper(F.trim("review_decision")).alias("review_decision"))


def queue_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.bronze_rows(spark, sf_dir)
    queue = review.manual_queue(review.split_by_confidence(rows, 0.8)[1], 0.8).join(rows.select("line_id", "account_number"), "line_id").select("line_id", "account_number", "manual_entry_status")
    done = lens.decisions(spark, sf_dir).where("seq = 1").selectExpr("line_id", "corrected_value account_number", "'COMPLETED' manual_entry_status")
    return review.merged_queue(queue, done, "line_id", ["account_number", "manual_entry_status"])


def category_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.bronze_rows(spark, sf_dir).select("line_id", "category")
    return reports.category_dashboard(review.review_summary(_quality(spark, sf_dir)).join(rows, "line_id"), ["category"])


def _invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.periods(spark, sf_dir)
    return rows.withColumn("account_number", F.when(F.col("supplier_key") % 11 == 7, "ACC-none").otherwise(F.col("account_number"))).withColumn("activity_group", F.when(F.col("part_key") % 5 != 0, F.col("activity_group")))


def mapping_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = enrich.mapping_cascade(_invoices(spark, sf_dir), lens.mapping(spark, sf_dir))
    return out.select("row_id", "mapping_status", "mapping_method", "mapped_id", "mapped_division")


def manual_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["unit_name", "supplier_name", "account_number", "activity_group"]
    rows = _invoices(spark, sf_dir).withColumn("supplier_name", F.when(F.col("part_key") % 2 == 0, F.col("supplier_name"))).withColumn("unit_name", F.when(F.col("part_key") % 7 != 0, F.upper("unit_name")))
    return enrich.manual_mapping(rows, lens.mapping(spark, sf_dir), cols)


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rollup.monthly_rollup(_splits(spark, sf_dir), ("flow",))
    return rows.withColumn("row_id", F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in [*rollup.MONTHLY_KEY, "flow"])))


def monthly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _monthly(spark, sf_dir).drop("row_id", "split_digest").withColumn("source_files", F.array_join("source_files", "; ")).withColumn("monthly_consumption", _round("monthly_consumption", 4))


def _allocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _monthly(spark, sf_dir).withColumn("key", text.lookup_key(F.col("unit_name"), F.col("supplier_name"), F.col("month")))
    out = enrich.specific_lookup(rows, lens.allocation(spark, sf_dir), ["fossil", "renewable", "nuclear", "generation"])
    return out.withColumnsRenamed({"fossil": "fossil_fuel_%", "renewable": "renewable_energy_%", "nuclear": "nuclear_%", "generation": "solar_total_generation"}).withColumn("solar_export", F.lit(None).cast("double"))


def specificity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _allocated(spark, sf_dir).select("row_id", "lookup_id", "lookup_issue")


def _template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.kpi_template(rollup.business_rows(_allocated(spark, sf_dir)))


def kpi_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _template(spark, sf_dir).select("row_id", F.col("Energy KPI").alias("energy_kpi"), _round("Amount of energy consumed", 4).alias("amount"), F.col("business_mapping_issue").alias("issue"))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.gold_template(rollup.template_output(_template(spark, sf_dir)))


def gold_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gold(spark, sf_dir).select("row_id", F.col("Energy KPI").alias("energy_kpi"), _round("Amount of energy consumed", 4).alias("kwh"), F.col("Original Energy Unit").alias("original_unit"))


def gold_aggregated(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gold.gold_aggregated(_gold(spark, sf_dir))
    return g.select(
        *FACILITY, "month", F.col("KPI Component").alias("component"), _round("Total amount of energy consumed", 3).alias("total_kwh"), _round("`fossil_fuel_%`", 4).alias("fossil"),
        _round("total_solar_consumed", 3).alias("solar"), "proration_component_count", "source_file_count", F.col("Energy KPI").alias("kpis"),
    )


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.periods(spark, sf_dir)
    return rows.selectExpr(
        "row_id", "division", "upper(legal_entity) legal_entity", "case when part_key % 50 = 49 then ' ' else replace(unit_name, '-', '_') end unit_name", "case when part_key % 50 = 48 then null else activity_group end kpi", "energy_unit",
        "case when part_key % 50 = 47 then cast('NaN' as double) else quantity end amount", "start date", "case when part_key % 50 = 46 then 'x' else '' end issue",
    )


def reporting_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.reporting_rows(_history(spark, sf_dir))[1].select("row_id", "reject_reason")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.reporting_rows(_history(spark, sf_dir))[0]
    facilities = lens.periods(spark, sf_dir).withColumn("kpi", F.col("activity_group"))
    return reports.year_over_year(facilities, rows, rows, _months(spark, sf_dir))


def year_over_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).withColumns({c: _round(c, 4) for c in ("current", "previous", "difference")})


def high_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.high_variance(_cells(spark, sf_dir))
    return out.select(*FACILITY, "kpi", "month", _round("size", 4).alias("size"), "class")


def top_variance_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.high_variance(_cells(spark, sf_dir)).withColumn("size", _round("size", 4)).where("size <> double('infinity')")
    return reports.page(out, [F.desc("size"), *map(F.asc, [*FACILITY, "kpi", "month"])], 1, 25).select(*FACILITY, "kpi", "month", "size")


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.periods(spark, sf_dir).select(*FACILITY, F.col("activity_group").alias("kpi"), "account_number").distinct()
    n = F.length(F.concat("unit_name", F.coalesce("account_number", F.lit("")))) % 3
    return rows.withColumns({"effective_start": F.when(n == 0, F.lit("1998-03-15").cast("date")), "effective_end": F.when(n == 1, F.lit("1998-09-10").cast("date"))})


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.periods(spark, sf_dir).withColumn("kpi", F.col("activity_group"))
    out = reports.completeness(_accounts(spark, sf_dir).where("account_number is not null"), rows, [a for a, _ in _months(spark, sf_dir)])
    return out.withColumn("ratio", F.round("ratio", 6))


def expected_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.mapping(spark, sf_dir).selectExpr("map_id", "division", "legal_entity", "unit_name", "trim(activity_group) kpi", "account_number", "case when map_id % 17 = 3 then 'soon' else '2024-01-01' end effective_start", "case when map_id % 7 = 0 then '2023-12-01' when map_id % 19 = 4 then '31.31.2024' else '' end effective_end")
    return reports.expected_accounts(rows).select("map_id", "issue")


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods with resolved dates beside their allocations with planted faults: one lost month, one doubled, one wrong share, one strange month."""
    rows = periods.month_split(periods.resolve_dates(lens.periods(spark, sf_dir)), keep_unsplit=True)
    lost = F.coalesce((F.col("part_key") % 97 == 3) & (F.col("month") == F.trunc("effective_start", "MM")), F.lit(False))
    moved = F.when(F.col("part_key") % 101 == 6, F.add_months("month", 40)).otherwise(F.col("month"))
    rows = rows.withColumn("month", moved).withColumns({c: F.when(~lost, F.col(c)) for c in audit.ALLOCATION})
    again = F.when(F.col("part_key") % 89 == 5, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = rows.withColumn("copy", F.explode(again)).withColumn("split_quantity", F.when(F.col("part_key") % 83 == 7, F.col("split_quantity") + 1).otherwise(F.col("split_quantity")))
    return rows.withColumn("period_id", F.col("row_id")).drop("start", "end").withColumnsRenamed({"effective_start": "start", "effective_end": "end"})


def audit_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.case_table(audit.joined_cases(_audited(spark, sf_dir)))


def audit_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periods.resolve_dates(lens.periods(spark, sf_dir)).drop("start", "end").withColumnsRenamed({"effective_start": "start", "effective_end": "end"})
    months = _months(spark, sf_dir)
    return audit.coverage_cases(rows, months[0][0], months[-1][0])


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_summary(lens.periods(spark, sf_dir), ["division", "activity_group"]).withColumn("kwh", F.round("kwh", 2))


def best_mapping_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lens.mapping(spark, sf_dir).withColumn("mapping_id", F.col("map_id")).withColumn("active", F.when(F.col("map_id") % 5 == 0, "No"))
    return archive_v1.best_mapping(_invoices(spark, sf_dir), m)


def gold_sql_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _allocated(spark, sf_dir).selectExpr("row_id", "activity_group", "`fossil_fuel_%` fossil", "`renewable_energy_%` renewable", "`nuclear_%` nuclear", "round(monthly_consumption + 1e-7, 4) amount", "cast(null as string) contractual_instruments")
    return archive_v1.gold_v1(rows)


def dq_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_v1.invalid_allocations(lens.allocation(spark, sf_dir)).select("lookup_id", F.round("total_pct", 6).alias("total_pct"))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" ("), "p_name", F.lit("__b.v.-"), "p_brand", F.lit("\t gmbh. UK ) "))
    return lens.table(spark, sf_dir, "part").select("p_partkey", text.proper_case(raw).alias("proper"), text.upper_clean(raw).alias("upper"))


def energy_unit_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ["total kWh used", "Kilowatt-Hours", "kw h", "MWH/m3", "tons of steam", "kWh and MWh", "price per kWh", "kwh per day", "RTH", "rthx", "mmBTU", "ton"]))
    raw = F.concat("p_name", F.lit(" "), F.get(kinds, (F.col("p_partkey") % 12).cast("int")))
    return lens.table(spark, sf_dir, "part").select("p_partkey", text.energy_unit(raw).alias("unit"))


def quantity_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = lens.table(spark, sf_dir, "orders")
    cents, whole = F.lpad(((F.col("o_orderkey") % 100).cast("string")), 2, "0"), (F.col("o_orderkey") % 1000).cast("string")
    eu = F.concat(F.lit("EUR 1."), F.lpad(whole, 3, "0"), F.lit(","), cents, F.lit(" €"))
    us = F.concat(F.lit("$1,"), F.lpad(whole, 3, "0"), F.lit("."), cents)
    comma = F.col("o_orderkey") % 2 == 0
    amount, sep = F.when(comma, eu).otherwise(us), F.when(comma, ",").otherwise(".")
    quantity = F.concat(F.lit("- used "), F.when(comma, F.concat(F.lit("1 2"), whole, F.lit(","), cents)).otherwise(F.concat(F.lit("3,"), F.lpad(whole, 3, "0"), F.lit("."), cents)), F.lit(" units"))
    return o.select("o_orderkey", numbers.clean_amount(amount, sep).alias("amount"), numbers.clean_quantity(quantity, sep).alias("quantity"), numbers.to_number(numbers.clean_amount(amount, sep)).alias("number"))


def facility_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("Zürich's "), "c_name", F.lit("_Côté & "), "c_mktsegment", F.lit(" (no. 1) "))
    return lens.table(spark, sf_dir, "customer").select("c_custkey", text.facility_key(raw).alias("key"))


def _date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = lens.table(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    names = F.array(*(F.lit(n) for n in "janvier février März abril mayo junho juli août settembre oktober noviembre dezember".split()))
    month = F.get(names, F.month("d") - 1)
    forms = F.array(
        F.date_format("d", "yyyy-MM-dd"), F.date_format("d", "dd/MM/yyyy"), F.date_format("d", "M/d/yy"), F.concat(F.dayofmonth("d").cast("string"), F.lit(" de "), month, F.lit(" "), F.year("d").cast("string")),
        F.concat(month, F.lit(" "), F.year("d").cast("string")), F.concat((F.year("d") + 20 - 1911).cast("string"), F.date_format("d", "/M/d")), F.date_format("d", "dd.MM.yyyy 23:59"), F.lit("no date"), F.lit("31/02/2020"), F.lit("  "),
    )
    return o.select("o_orderkey", "d", F.get(forms, (F.col("o_orderkey") % 10).cast("int")).alias("raw"))


def date_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dates.with_dates(_date_texts(spark, sf_dir), "raw", "date")
    return out.select("o_orderkey", "date", F.col("date_status").alias("status"), F.size("date_candidates").alias("candidates"), dates.excel_serial(F.col("date")).alias("serial"), dates.fiscal_year(F.col("d")).alias("fiscal_year"))


def date_range_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = lens.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    rows = o.select("o_orderkey", F.date_format("d", "MM/dd/yyyy").alias("a"), F.date_format(F.expr("date_add(d, cast(o_orderkey % 60 as int))"), "MM/dd/yyyy").alias("b"))
    rows = dates.with_dates(dates.with_dates(rows, "a", "start"), "b", "end")
    return dates.with_chosen_range(rows, "start_candidates", "end_candidates", "pick").select("o_orderkey", "pick.s", "pick.e")


def mojibake_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts damaged by reading UTF-8 as windows-1252, put right, beside what they were."""
    damaged = F.translate(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"), text.CP1252_BYTES, text.CP1252)
    docs = lens.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(text.mojibake_repaired(damaged), 256).alias("repaired"), F.sha2("text", 256).alias("original"))


def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bronze.extracted(bronze.parsed(lens.documents_json(spark, sf_dir)), DOCUMENT_FIELDS)
    return out.select("source_file", "account", "account_confidence", "total", F.col("doc.status").alias("status"), F.col("doc.document_confidence").alias("document_confidence"))


def table_rows_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bronze.parsed(lens.documents_json(spark, sf_dir))
    return bronze.table_lines(rows, "Items", {"qty": ["Qty"], "waste": ["Waste", "Kind"]}).select("source_file", "line_id", "qty", "waste")


def search_any_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lens.table(spark, sf_dir, "customer")
    return c.where(text.contains_any("MER#0000000", F.col("c_name"), F.col("c_mktsegment")) | text.contains_any("house", F.col("c_mktsegment"))).select("c_custkey", "c_name")


def stream_monthly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of the events table read as a stream until its end."""
    files = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(files).schema
    source = spark.readStream.schema(schema).parquet(sf_dir, pathGlobFilter="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    where = scratch(spark, "events")

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{where}/out")

    query = stream.monthly_totals(source).writeStream.outputMode("complete").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.parquet(f"{where}/out").withColumn("total", F.round("total", 2))


QUERIES = {
    f.__name__: f
    for f in (
        monthly_kwh, billing_date_resolution, billing_overlap_flags, interval_union_coverage, day_coverage, month_split, period_stack, duplicate_marking, field_quality, review_summary, review_issues,
        approval_overlay, decision_carryover, open_queue, latest_decisions, queue_merge, category_dashboard, mapping_cascade, manual_mapping, monthly_rollup, specificity_lookup, kpi_template,
        gold_template, gold_aggregated, reporting_rejects, year_over_year, high_variance, top_variance_page, completeness, expected_accounts, audit_cases, audit_coverage, audit_summary,
        best_mapping_sql, gold_sql_v1, dq_sql, clean_text, energy_unit_extract, quantity_clean, facility_key, date_normalise, date_range_pick, mojibake_repair, json_extract, table_rows_explode,
        search_any_column, stream_monthly_events,
    )
}
QUERIES |= silver_queries.QUERIES | curated_queries.QUERIES | review_queries.QUERIES | report_queries.QUERIES | state_queries.QUERIES
