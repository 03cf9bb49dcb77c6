import pytest
from pyspark.sql import functions as F

from tallyweave.operators import bronze, periods, review, rollup, silver
from tallyweave.plans import archive_v1, reports
from tallyweave.functions import text, units
from tallyweave.sources import config, readers, sinks


def test_text_tables_without_marks_rows_or_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Account #,Unit\n 1 ,\n\"x\ny\",Ü\n".encode())
    got = readers.text_table(spark, str(tmp_path / "a.csv"), ["account", "unit"])
    assert got.dtypes == [("account", "string"), ("unit", "string")] and got.where("account = ' 1 ' and unit is null").count() == 1
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header.csv").write_text("a,b\n")
    for name in ("empty.csv", "header.csv", "missing.csv", "no*.csv"):
        rows = readers.text_table(spark, str(tmp_path / name), ["a", "b"])
        assert rows.columns == ["a", "b"] and rows.count() == 0
    named = readers.named_table(spark, str(tmp_path / "a.csv"))
    assert named.columns == ["Account #", "Unit"]
    assert {tuple(r) for r in named.collect()} == {(" 1 ", None), ("x\ny", "Ü")}


def test_mapping_tables_under_any_of_their_names(spark):
    rows = spark.createDataFrame([("1", None, "E", " u ", "s", " STEAM"), (" ", "2", "E", "v", "s", "Gas")], "`Account No` string, `ACCOUNT #` string, `Legal-Entity Name` string, Unit string, supplier string, `energy type` string")
    out = readers.account_mapping(rows, ("account_number", "legal_entity"))
    assert {(r.account_number, r.legal_entity, r.unit_name, r.supplier_name, r.activity_group) for r in out.collect()} == {("1", "E", " u ", "s", "Steam"), ("2", "E", "v", "s", "Gas")}
    with pytest.raises(ValueError, match="lacks division, division_shorthand.*currency"):
        readers.account_mapping(rows)
    assert readers.plain_name("  Account #2 (old)") == "account 2 old"


def test_a_document_says_what_it_is(spark):
    docs = spark.createDataFrame([('{"sharepoint_link":"l","document_confidence":0.5,"modelId":"m","fields":{}}',), ('{"A":{"valueString":"x"}}',), ("no json",), (None,)], "json string")
    got = bronze.with_metadata(bronze.parsed(docs)).select("json", *bronze.METADATA).collect()
    assert [(r.sharepoint_link, r.document_confidence, r.modelId, r.status) for r in got] == [("l", 0.5, "m", None)] + [(None,) * 4] * 3


def test_curated_columns_are_complete_and_in_order(spark):
    assert len(set(silver.CURATED_COLUMNS)) == len(silver.CURATED_COLUMNS) == 47
    rows = spark.createDataFrame([("i", "t", "m")], "invoice_id string, createdDateTime string, modelId string")
    out = silver.curated(rows, list(silver.CURATED_COLUMNS))
    assert tuple(out.columns) == silver.CURATED_COLUMNS
    x = out.first()
    assert (x.invoice_id, x.createdDateTme, x.modelID, x.data_quality, x.mapping_status) == ("i", "t", "m", "Actual", None)


def test_segments_are_kept_once(spark):
    schema = "row_id string, period_index int, month string, split_start string, split_end string, split_quantity double, note string"
    a = ("r", 1, "m", "s", "e", 1.0, "n")
    rows = spark.createDataFrame([a, a, ("r", 2, *a[2:]), ("r", 1, "m", "s", "e", 2.0, "n"), ("r", 1, None, None, None, None, "n"), ("r", 1, None, None, None, None, "n")], schema)
    assert periods.distinct_segments(rows).count() == 4


def test_every_issue_of_a_business_row_is_named(spark):
    schema = "activity_group string, energy_unit string, lookup_issue string, contract_issue string, `fossil_fuel_%` double, `renewable_energy_%` double, `nuclear_%` double, solar_total_generation double, solar_export double"
    tail = (None, None)
    rows = spark.createDataFrame([("Heat", "kWh", "", "", 1.0, 0.0, 0.0, *tail), ("Heat", "mmBTU", "", "tied", 2.0, 0.0, 0.0, *tail), ("Heat", "kWh", "tied", " ", None, None, None, *tail), ("Heat", "kWh", "", None, 0.5, 0.2, 0.2, *tail)], schema)
    got = [x.business_mapping_issue for x in rollup.business_rows(rows).collect()]
    assert got == ["", f"Energy unit: {rollup.MISSING_UNIT}; Energy source allocation: {rollup.OUTSIDE_SHARES}; Contract: tied", "Energy source allocation: tied", f"Energy source allocation: {rollup.UNEQUAL_SHARES}"]
    assert rollup.business_rows(rows.drop("contract_issue")).count() == 4


def test_tiles(spark):
    cells = spark.createDataFrame([("d", "l", "U-1", 1.0, 5), ("d", "l", "u 1", 0.5, 2), ("d", "l", "v", 0.0, 0), ("d", "l", "v", None, 0)], "division string, legal_entity string, unit_name string, ratio double, covered_days long")
    assert tuple(reports.completeness_tiles(cells).first()) == (2, 1, 1, 1)
    assert tuple(reports.completeness_tiles(cells.limit(0)).first()) == (0, 0, 0, 0)
    rows = spark.createDataFrame([("AUTO_APPROVED",), ("MANUALLY_APPROVED",), (None,)], "approval_status string")
    assert tuple(reports.approval_counts(rows).first()) == (3, 1, 1)
    by_year = spark.createDataFrame([("d", "l", "u", "k", "2024-02-01", 2024, 3.0), ("d", "l", "u", "k", "2025-01-01", 2025, 4.0)], "division string, legal_entity string, unit_name string, kpi string, month string, year int, v double").withColumn("month", F.to_date("month"))
    assert {(r.year, r.Jan, r.Feb) for r in reports.by_month(by_year, F.col("v"), ["Jan", "Feb"], "MMM", ("year",)).collect()} == {(2024, None, 3.0), (2025, 4.0, None)}


def test_divisions_serve_by_unit_or_facility_and_count_once(spark):
    ocr = spark.createDataFrame([("a", "E", "U", "S", "1"), ("b", "E", "none", "S", "2"), ("c", "X", "U", "S", "3"), ("d", "Q", "none", "S", "9")], "ocr_record_id string, legal_entity string, unit_name string, supplier string, account_number string")
    mapping = spark.createDataFrame([(1, "1", "U", "E", "F1"), (2, "2", "W", "E", "F1"), (3, "3", "U", "X", "F1")], "mapping_id int, account_number string, unit_name string, legal_entity string, facility_identifier string").withColumns({"supplier_name": F.lit("S"), "division": F.lit("own"), "activity_group": F.lit("steam"), "active": F.lit("Yes")})
    division = spark.createDataFrame([("both", " e ", "u", "f1"), ("unit", "E", "U", None), ("facility", "E", "Z", "F1"), ("none", "E", " ", " ")], "division string, legal_entity string, unit_name string, facility_identifier string")
    contracts = spark.createDataFrame([("c1", "E", "Z", "s")], "contract_id string, legal_entity string, unit_name string, supplier_name string")
    got = sorted((r.ocr_record_id, r.division or "", r.contract_id or "") for r in archive_v1.enriched(ocr, mapping, division, contracts).collect())
    assert got == [("a", "both", ""), ("a", "facility", "c1"), ("a", "unit", ""), ("b", "both", ""), ("b", "facility", "c1"), ("c", "own", ""), ("d", "", "")]


def test_uploads_hold_fourteen_columns_of_clear_rows(spark):
    gold = spark.createDataFrame([(0, None), (1, 0), (None, 1), (None, 0)], "mapping_needs_review int, ocr_needs_review int")
    gold = gold.withColumns({c: F.lit("x") for c in archive_v1.UPLOAD.values() if not c.startswith("'")})
    out = archive_v1.upload(gold)
    assert out.columns == list(archive_v1.UPLOAD) and len(out.columns) == 14 and out.count() == 2


def test_a_review_runs_again_from_saved_lines(spark, tmp_path):
    waste = config.category({"fields": {"account": {"sources": ["A"], "criticality": "critical"}}, "header": ["invoice_id", "line_id"]})
    lines = spark.createDataFrame([("i", "1", "x", 0.5), ("i", "2", "y", 0.5), ("j", "1", "z", 0.95), ("k", "1", "z", 0.99)], "invoice_id string, line_id string, account string, account_confidence double")
    lines.write.parquet(str(tmp_path / "bronze"))
    saved = spark.read.parquet(str(tmp_path / "bronze"))
    none = spark.createDataFrame([], "issue_id string, invoice_id string, line_id string, field_name string, original_value string, review_decision string, corrected_value string")
    first = waste.reviewed(saved, none)
    assert [(r.invoice_id, r.account) for r in first.approved.collect()] == [("j", "z")] and first.waiting.count() == 2  # k repeats j
    old = first.issues.where("line_id = '1'").selectExpr("'gone' issue_id", "invoice_id", "line_id", "field_name", "ocr_value original_value", "'CORRECTED' review_decision", "'fixed' corrected_value")
    again = waste.reviewed(saved, old)
    assert {(r.invoice_id, r.line_id, r.account, r.approval_status) for r in again.approved.collect()} == {("i", "1", "fixed", "MANUALLY_APPROVED"), ("j", "1", "z", "AUTO_APPROVED")}
    assert [(r.invoice_id, r.line_id) for r in again.waiting.collect()] == [("i", "2")]
    assert isinstance(again, review.Review)


def test_exports_are_typed_by_their_texts(spark):
    rows = spark.createDataFrame([("2024-02-29", " 1,234.5 ", " https://x "), ("2024-02-30", "1.2.3", " "), ("29/02/2024", "", None), ("2024-2-9", "-7", "y")], "d string, n string, l string")
    got = [tuple(r) for r in sinks.typed(rows, ["d", "absent"], ["n"], ["l"]).collect()]
    assert [(d and d.isoformat(), n, link) for d, n, link in got] == [("2024-02-29", 1234.5, "https://x"), (None, None, None), (None, None, None), (None, -7.0, "y")]


def test_filters_by_column_and_units(spark):
    rows = spark.createDataFrame([("Alpha", 17), ("beta", 7), (None, 7)], "a string, n int")
    count = lambda **asked: rows.where(text.holds_all(asked)).count()
    assert (count(), count(a=" "), count(a=" PH "), count(n="7"), count(a="a", n="17")) == (3, 3, 1, 3, 1)
    kwh = lambda **how: [r[0] for r in rows.select(units.to_kwh(F.col("n").cast("double"), F.lit(" mmbtu "), **how)).collect()]
    assert kwh() == [None] * 3 and kwh(factors={"MMBTU": 2.0}, strict=True) == [34.0, 14.0, 14.0]
    with pytest.raises(Exception, match="Unsupported energy unit"):
        kwh(strict=True)


def test_variances_name_the_files_of_both_years(spark):
    cells = spark.createDataFrame([("D", "L", "U-1", "k", "2024-03-01", 3.0, 1.0, 2.0), ("D", "L", "U-2", "k", "2024-03-01", 2.0, 1.0, -0.5), ("D", "L", "U-3", "k", "2024-03-01", 1.0, 1.0, 0.1)], "division string, legal_entity string, unit_name string, kpi string, month string, current double, previous double, difference double").withColumn("month", F.to_date("month"))
    rows = spark.createDataFrame([("D", "l", "u 1", "k", "2024-03-09", "B.pdf; a.pdf", "https://b"), ("D", "l", "u 1", "k", "2024-03-10", "b.pdf", "https://a"), ("D", "l", "u 1", "k", "2023-03-01", "old.pdf", None)], "division string, legal_entity string, unit_name string, kpi string, date string, source_files string, source_link string").withColumn("date", F.to_date("date"))
    sources = reports.monthly_sources(rows)
    got = {r.unit_name: (r.current_files, r.previous_files, r.links, r.size) for r in reports.variance_report(cells, sources, sources).collect()}
    assert got == {"U-1": ("a.pdf\nb.pdf", "old.pdf", ["https://a", "https://b"], 2.0), "U-2": ("", "", [], 0.5)}
