import datetime as dt

from pyspark.sql import functions as F

from tallyweave.functions import dates, text
from tallyweave.operators import lineage, manual, periods, rollup, silver
from tallyweave.plans import audit, missing, reports, scope

D = dt.date


def test_curated_columns_and_units(spark):
    rows = spark.createDataFrame([("a", " ", "total kWh", None, "per tons", 0.5), ("b", "Estimated", "kWh / m3", "MWh", None, 0.9)], "id string, data_quality string, quantity_unit_1 string, consumption_unit string, quantity_unit_2 string, document_confidence double")
    out = silver.with_quantity_unit(silver.with_data_quality(rows))
    assert out.columns.index("data_quality") == out.columns.index("document_confidence") + 1
    got = {x.id: (x.data_quality, x.consumption_quantity_unit, x.consumption_quantity_unit_2) for x in out.collect()}
    assert got == {"a": ("Actual", "KWH", "TON"), "b": ("Estimated", "MWH", "MWH")}
    assert silver.curated(rows, ["id", "data_quality", "modelID"]).columns == ["id", "data_quality", "modelID"]
    kept = silver.cleaned(rows, {"id": text.upper_clean}, {"id": F.col("id") == "a"}).select("id").collect()
    assert [x.id for x in kept] == ["a", "B"]
    config = silver.FieldConfig({"account": ["A"]}, table_fields={"qty": ["Q"]})
    assert config.bronze_columns() == ["source_file", "line_id", "account", "account_confidence", "qty"]


def test_parts_of_texts_join_once_and_keep_their_first_spelling(spark):
    rows = spark.createDataFrame([(1, "b; A"), (2, "a;c"), (3, " "), (4, None), (5, "C")], "n int, t string")
    got = rows.agg(rollup.joined_parts(F.col("t"), F.col("n")).alias("p"), rollup.joined_distinct(F.col("t"), F.col("n")).alias("d"), rollup.first_in_order(F.col("t"), -F.col("n")).alias("f")).first()
    assert (got.p, got.d, got.f) == ("b; A; c", "b; A; a;c; C", "C")


def test_lineage_reads_back(spark):
    schema = "row_id string, division string, legal_entity string, unit_name string, supplier_name string, account_number string, activity_group string, energy_unit string, mapping_status string, invoice_id string, start date, end date, quantity double, link string"
    rows = spark.createDataFrame([(r, "d", "l", "u", "s", "a", "Heat", "kWh", m, f"i{r}", D(2024, 1, 5), D(2024, 2, 3), 10.0, f"https://x/{r}") for r, m in (("r1", "MAPPED"), ("r2", ""), ("r3", "CONFLICT"))], schema)
    out = lineage.monthly_lineage(periods.month_split(rows, "start", "end"))
    x = {str(x.month): (x.source_row_ids, x.split_keys, x.source_files, x.links) for x in out.collect()}
    assert x["2024-01-01"] == ("r1; r2", "r1|2024-01|2024-01-05|2024-01-31; r2|2024-01|2024-01-05|2024-01-31", "ir1; ir2", ["https://x/r1", "https://x/r2"])
    back = {(x.month, x.split_start, x.split_end) for x in lineage.split_ranges(out).collect()}
    assert back == {(D(2024, 1, 1), D(2024, 1, 5), D(2024, 1, 31)), (D(2024, 2, 1), D(2024, 2, 1), D(2024, 2, 3))}
    wide = lineage.widened(out).first()
    assert (wide["sharepoint_link_2"], wide["sharepoint_link_3"]) == ("https://x/r2", None)


def test_manual_entries(spark):
    queue = spark.createDataFrame([("a", "1"), ("b", "1")], "invoice_id string, line_id string").withColumn("entry_source", F.lit(None).cast("string"))
    done = spark.createDataFrame([("a", "1", " completed"), ("c", "1", "COMPLETED"), ("b", "1", "PENDING")], "invoice_id string, line_id string, manual_entry_status string")
    assert [x.invoice_id for x in manual.completed_decisions(done, queue).collect()] == ["a"]
    assert [x.invoice_id for x in manual.open_entries(queue, done).collect()] == ["b"]
    assert sorted(x.invoice_id for x in manual.pruned_decisions(done, queue).collect()) == ["a", "b"]
    ups = spark.createDataFrame([("a", 1), ("a", 2), ("z", 1)], "base string, at int")
    assert sorted(x.invoice_id for x in manual.appended_uploads(queue, ups).collect()) == ["a", "a_2", "a_3", "b", "z"]
    ids = spark.createDataFrame([("IN-1", " ", "unit name")], "i string, l string, f string").select(manual.override_id(F.col("i"), F.col("l"), F.col("f")).alias("x")).first()
    assert ids.x == "override_IN_1_1_unit_name"


def test_reopened_decisions_are_blank_again(spark):
    rows = spark.createDataFrame([("x", "v", "APPROVED", "DONE"), ("y", "w", "APPROVED", "DONE")], "issue_id string, corrected_value string, review_decision string, review_tag string")
    got = {x.issue_id: tuple(x)[1:] for x in manual.reopened(rows, rows.where("issue_id = 'x'")).collect()}
    assert got == {"x": ("", "", "PENDING"), "y": ("w", "APPROVED", "DONE")}


def test_cases_are_scoped_by_month_or_by_period(spark):
    cases = spark.createDataFrame([("1", "Missing coverage", "2024-01", ["p"]), ("2", "Missing coverage", "2023-01", ["p"]), ("3", "Invoice reconciliation", "2023-01", ["p", "q"]), ("4", "Invoice reconciliation", "2024-01", ["r"])], "case_id string, issue string, month string, period_ids array<string>")
    chosen = spark.createDataFrame([("q",)], "period_id string")
    found = scope.scoped_cases(cases, chosen, ["2024-01"])
    assert sorted(x.case_id for x in found.collect()) == ["1", "3"]
    rows = spark.createDataFrame([("p",), ("q",), ("r",)], "period_id string")
    assert sorted(x.period_id for x in scope.case_evidence(found, rows).collect()) == ["p", "q"]
    assert scope.scoped(cases, issue=None, month="2023-01").count() == 2


def test_cases_that_share_an_id_are_scoped_apart(spark):
    cases = spark.createDataFrame([(audit.MAPPING, "2024-01", p) for p in ("p553003", "p1108055")], "issue string, month string, period_id string")
    rows = spark.createDataFrame([(p, "f", "k", "a", p, None) for p in ("p553003", "p1108055")], "period_id string, facility string, kpi_component string, account string, source_file string, source_link string")
    cases = scope.evidenced(cases, rows)
    assert {x.case_id for x in cases.collect()} == {"A-facbdfb06c"}
    found = scope.scoped_cases(cases, rows.where("period_id = 'p553003'"), [])
    assert [x.period_id for x in scope.case_evidence(found, rows).collect()] == ["p553003"]


def test_totals_of_every_level(spark):
    rows = spark.createDataFrame([("k", "a", "p1", 1.0), ("k", "b", "p2", None), ("m", "a", "p3", 2.0)], "kpi string, unit string, period_id string, allocated_kwh double")
    got = {(x.kpi, x.unit, x.level): x.kwh for x in scope.totals(rows, ["kpi", "unit"]).collect()}
    assert got == {("k", "a", 2): 1.0, ("k", "b", 2): None, ("m", "a", 2): 2.0, ("k", None, 1): 1.0, ("m", None, 1): 2.0, (None, None, 0): 3.0}


def test_missing_mappings_and_months(spark):
    rows = spark.createDataFrame([("a", None, "MAPPED", "kWh", ""), ("b", "x", "MAPPED", "kWh", ""), ("c", "x", " ", "?", ""), ("d", "x", "UNMAPPED", "kWh", "m")], "row_id string, m string, mapping_status string, energy_unit string, mapping_message string")
    assert {x.row_id: x.mapping_message for x in missing.unmapped_rows(rows, ["m"]).collect()} == {"a": "", "c": missing.UNIT_MESSAGE, "d": "m"}
    months = reports.months_of({"first": D(2023, 12, 1), "last": D(2024, 2, 1)})
    assert months == [("2023-12-01", "2022-12-01"), ("2024-01-01", "2023-01-01"), ("2024-02-01", "2023-02-01")]
    assert reports.months_of({"first": None, "last": None}) == []
    got = spark.range(1).select(dates.fiscal_months(F.lit(2024)).alias("x"), dates.to_date(F.lit("2024-01-02T03:04")).alias("d")).first()
    assert (got.x[0], got.x[-1], got.d) == (D(2023, 12, 1), D(2024, 11, 1), D(2024, 1, 2))
