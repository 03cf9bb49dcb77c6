import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import bronze, enrich, gold, marking, periods, review, rollup
from tallyweave.plans import audit, reports
from tallyweave.sources import readers, sinks
from tallyweave.streaming import stream

D = dt.date
SCHEMA = "row_id string, division string, legal_entity string, unit_name string, supplier_name string, account_number string, activity_group string, mapping_status string, period_index int, start date, end date, quantity double, energy_unit string, invoice_id string"


def billed(spark, spans, account="A", status="MAPPED"):
    rows = [(f"r{i:03d}", "d", "l", "u", "s", account, "Electricity", status, 1, a, b, 10.0, "kWh", f"i{i}") for i, (a, b) in enumerate(spans)]
    return spark.createDataFrame(rows, SCHEMA)


RULES = [
    ((D(2023, 12, 31), D(2024, 1, 31)), 31, periods.START_MORE, "Month-end dates"),
    ((D(2023, 1, 31), D(2023, 2, 28)), 28, periods.START_MORE, "Month-end dates"),
    ((D(2024, 1, 31), D(2024, 2, 29)), 29, periods.START_MORE, "Month-end dates"),
    ((D(2023, 1, 1), D(2023, 4, 1)), 90, periods.END_LESS, "Month-start dates"),
    ((D(2023, 1, 31), D(2023, 3, 1)), 30, "None", "Insufficient history"),
    ((D(2023, 1, 5), D(2023, 1, 5)), 1, "None", "Single day"),
]


@pytest.mark.parametrize(("span", "days", "adjustment", "label"), RULES)
def test_single_periods(spark, span, days, adjustment, label):
    x = periods.resolve_dates(billed(spark, [span])).first()
    assert (x.date_adjustment, x.date_resolution) == (adjustment, label)
    assert (x.effective_end - x.effective_start).days + 1 == days


def test_chains_gaps_overlaps_and_order(spark):
    spans = [(D(2023, 1, 5), D(2023, 2, 5)), (D(2023, 2, 5), D(2023, 3, 5)), (D(2023, 3, 5), D(2023, 4, 4)), (D(2023, 4, 5), D(2023, 5, 5)), (D(2023, 7, 1), D(2023, 7, 20)), (D(2023, 7, 10), D(2023, 8, 2)), (D(2023, 9, 9), D(2023, 9, 2))]
    want = ["Shared date", "Shared date", "Consecutive dates", "Overlap", "Overlap", "Overlap", "Invalid dates"]
    df = billed(spark, spans)
    for rows in (df, df.orderBy(F.desc("row_id")).repartition(3)):
        got = {x.row_id: x.date_resolution for x in periods.resolve_dates(rows).collect()}
        assert [got[f"r{i:03d}"] for i in range(len(spans))] == want
    blank = {x.date_resolution for x in periods.resolve_dates(billed(spark, spans[:2], account=" ")).collect()}
    assert blank == {"Insufficient history"}


def test_overlap_flags_match_the_sweep(spark):
    r = random.Random(1)
    spans = [(a := D(2023, 1, 1) + dt.timedelta(r.randrange(60)), a + dt.timedelta(r.choice([0, 0, 3, 9, 20]))) for _ in range(60)]
    found = {x.row_id: x.conflict for x in periods.overlap_flags(billed(spark, spans)).collect()}
    order = sorted(range(60), key=lambda i: (*spans[i], i))
    bad = set()
    for n, j in enumerate(order):
        for i in order[:n]:
            if spans[i][1] >= spans[j][0] and (spans[i][1] > spans[j][0] or spans[i][0] == spans[j][0] or spans[j][0] == spans[j][1]):
                bad |= {i, j}
    assert {k for k, v in found.items() if v} == {f"r{i:03d}" for i in bad}


def test_splits_conserve_days_and_quantities(spark):
    df = billed(spark, [(D(2023, 1, 10), D(2023, 4, 20)), (D(2023, 5, 5), D(2023, 5, 5))])
    got = periods.month_split(periods.resolve_dates(df)).groupBy("row_id").agg(F.sum("split_quantity").alias("q"), F.sum("split_days").alias("d"), F.first("total_days").alias("t")).collect()
    assert all(abs(x.q - 10) < 1e-9 and x.d == x.t for x in got)
    cover = periods.covered_days(billed(spark, [(D(2023, 1, 1), D(2023, 1, 10)), (D(2023, 1, 11), D(2023, 1, 12)), (D(2023, 1, 5), D(2023, 1, 6)), (D(2023, 2, 1), D(2023, 2, 1))]), ["unit_name"]).first()
    assert (cover.covered_days, cover.islands) == (13, 2)


def test_duplicate_marking_agrees_with_the_greedy_rule(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, f"h{r.randrange(25)}", f"k{r.randrange(25)}") for i in range(80)]
    hashes, named, want = set(), set(), {}
    for i, h, k in rows:
        dup = h in hashes or k in named
        want[i] = "DUPLICATE" if dup else "PRIMARY"
        if not dup:
            hashes.add(h)
            named.add(k)
    n = iter(range(1000))

    def spill(df):
        path = f"{tmp_path}/{next(n)}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    df = spark.createDataFrame(rows, "seq int, content_hash string, business_key string")
    assert {x.seq: x.duplicate_status for x in marking.mark_duplicates_any(df, spill).collect()} == want
    chain = [(i, f"h{(i + 1) // 2}", f"k{i // 2}") for i in range(1000)]  # each shares its key with the one before and its hash with the next
    odd = [(5000, None, "x"), (5001, "y", " "), (5002, None, "x"), (5003, None, None), (5004, "y", "x"), (5005, "y", "z"), (5006, None, "z")]
    hot = [(2000 + i, "hot", f"c{i}") for i in range(500)]
    shuffled = chain + odd + hot
    r.shuffle(shuffled)
    out = {x.seq: (x.duplicate_of, x.match_type) for x in marking.mark_duplicates_any(spark.createDataFrame(shuffled, "seq int, content_hash string, business_key string"), spill).collect()}
    hashes, named = {}, {}
    for i, h, k in sorted(shuffled):
        k = None if k == " " else k
        if h in hashes or k in named:
            assert out[i] == ((hashes[h], "CONTENT_HASH") if h in hashes else (named[k], "BUSINESS_KEY"))
        else:
            assert out[i] == (None, None)
            hashes |= {h: i} if h else {}
            named |= {k: i} if k else {}
    assert marking.mark_duplicates_any(df.limit(0), spill).collect() == []
    simple = spark.createDataFrame([("a", "h1", "k1"), ("b", "h1", "k1"), ("c", "h2", "k1"), ("d", None, None), ("e", None, "")], "source_file string, content_hash string, business_key string")
    got = {x.source_file: (x.duplicate_status, x.duplicate_of, x.match_type) for x in bronze.mark_duplicates(simple, ["source_file"]).collect()}
    assert got == {"a": ("PRIMARY", None, None), "b": ("DUPLICATE", "a", "CONTENT_HASH"), "c": ("DUPLICATE", "a", "BUSINESS_KEY"), "d": ("PRIMARY", None, None), "e": ("PRIMARY", None, None)}


def test_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('\ufeff{"status":\n"ok","fields":{"Acc":{"valueString":" ","confidence":0.5},"Account":{"valueString":"7"},"T":{"valueArray":[{"valueObject":{"q":{"valueNumber":3}}},{},{"valueObject":{"q":{"content":"4"}}}]}}}')
    (tmp_path / "b.json").write_text('{"Account":{"content":"cafÃ©"}}')
    docs = bronze.parsed(readers.json_documents(spark, str(tmp_path)))
    got = {x.source_file: (x.account, x.account_confidence) for x in bronze.extracted(docs, {"account": ["Acc", "Account"]}).collect()}
    assert got == {"a.json": (None, 0.5), "b.json": ("café", None)}
    lines = sorted((x.source_file, x.line_id, x.q) for x in bronze.table_lines(docs, "T", {"q": ["q"]}).collect())
    assert lines == [("a.json", "1", "3"), ("a.json", "2", "4"), ("b.json", "1", None)]
    assert readers.provenance(spark, str(tmp_path)).count() == 2
    stream.run_once(stream.document_stream(spark, str(tmp_path)).select("source_file", "content_hash"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_review_flow(spark):
    rows = spark.createDataFrame([("i", "1", "x", 0.9, None, 0.95), ("i", "2", None, 0.5, "y", 0.1), ("j", "1", "z", 0.7, "w", 0.9)], "invoice_id string, line_id string, a string, a_confidence double, b string, b_confidence double")
    quality = review.field_quality(rows, {"a": "critical", "b": "noncritical"})
    summary = {(x.invoice_id, x.line_id): (x.review_status, x.review_reason_codes) for x in review.review_summary(quality).collect()}
    assert summary == {("i", "1"): ("AUTO_RESOLVED_WITH_WARNING", "BLANK_HIGH_CONFIDENCE"), ("i", "2"): ("BLOCKED", "MISSING_REQUIRED;LOW_CONFIDENCE"), ("j", "1"): ("REVIEW_REQUIRED", "LOW_CONFIDENCE")}
    log = spark.createDataFrame([("i", "2.0", 1, "a", "APPROVED", None), ("i", "2", 2, "a", "corrected ", "new"), ("j", "1", 3, "a", "REJECTED", "q")], "invoice_id string, line_id string, seq int, field_name string, review_decision string, corrected_value string")
    got = {(x.invoice_id, x.line_id): (x.a, x.approval_status, x.manual_review_decision_count) for x in review.approve(rows, review.review_summary(quality), log, ["a", "b"]).collect()}
    assert got == {("i", "1"): ("x", "AUTO_APPROVED", 0), ("i", "2"): ("new", "MANUALLY_APPROVED", 2)}
    ups = review.suffixed_ids(spark.createDataFrame([("f", 2), ("f", 1), ("g", 3)], "base string, at int"), "base", "at")
    assert {(x.at, x.upload_id) for x in ups.collect()} == {(1, "f"), (2, "f_2"), (3, "g")}


def test_mapping_statuses(spark):
    rows = spark.createDataFrame([("1", "a1", None, None, None), ("2", "zz", "Unit X", None, "steam"), ("3", "a1", None, None, "Heat"), ("4", "zz", "none", "Ent", None), ("5", "q", None, None, None)], "row_id string, account_number string, unit_name string, legal_entity string, activity_group string")
    table = spark.createDataFrame([(1, "A1", "Steam", "d", None, None), (2, "a2", "Steam", "d", "unit x|UNIT  X", None), (3, "a3", "Heat", "d", "unit x", None), (4, "a4", " ", "d", None, "ent;e2")], "map_id int, account_number string, activity_group string, division string, ocr_unit_name_list string, ocr_legal_entity_name_list string")
    got = {x.row_id: (x.mapping_status, x.mapping_method, x.mapped_id) for x in enrich.mapping_cascade(rows, table).collect()}
    assert got == {"1": ("MAPPED", "ACCOUNT", 1), "2": ("MAPPED", "UNIT_ALIAS", 2), "3": ("CONFLICT", "ACCOUNT", None), "4": ("INCOMPLETE", "LEGAL_ENTITY_ALIAS", None), "5": ("UNMAPPED", "", None)}


def test_gold_is_idempotent_and_does_not_count_twice(spark):
    monthly = spark.createDataFrame([("d", "l", "u", "s", "a", "Electricity", "MWh", D(2024, 1, 1), 2.0, 3, 1, "Reviewed OCR", 7, ["f"], "", 0.35, 0.65, 0.0, 0.5, 0.1)], "division string, legal_entity string, unit_name string, supplier_name string, account_number string, activity_group string, energy_unit string, month date, monthly_consumption double, proration_component_count long, source_file_count long, flow string, split_digest long, source_files array<string>, lookup_issue string, `fossil_fuel_%` double, `renewable_energy_%` double, `nuclear_%` double, solar_total_generation double, solar_export double")
    template = rollup.template_output(rollup.kpi_template(rollup.business_rows(monthly)))
    once = gold.gold_template(template)
    twice = gold.gold_template(once)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    x = gold.gold_aggregated(once).first()
    assert (x["Total amount of energy consumed"], x["fossil_fuel_%"], x["total_solar_consumed"], x["proration_component_count"]) == (2000.0, 0.35, 400.0, 3)


def test_two_sources_of_one_account_both_count(spark):
    """Sources that differ only in files and splits keep their solar amounts; a file that two accounts share counts once."""
    rows = [("a", 7, ["f1; x"[:2]], 0.5), ("a", 8, ["f2"], 0.5), ("b", 9, ["F2", "f3"], 1.0)]
    cols = "division string, legal_entity string, unit_name string, month date, `KPI Component` string, account_number string, supplier_name string, `Original Energy Unit` string, flow string, split_digest long, source_files array<string>, energy_unit string, `Energy KPI` string, `Amount of energy consumed` double, solar_total_generation double, total_solar_consumed double, proration_component_count long"
    table = [("d", "l", "u", D(2024, 1, 1), "c", acc, "s", "kWh", "Reviewed OCR", digest, files, "kWh", kpi, amount, solar, solar, 2) for acc, digest, files, solar in rows for kpi, amount in (("Fossil Fuels", 3.0), ("Renewable energy production", 9.0))]
    x = gold.gold_aggregated(spark.createDataFrame(table, cols)).first()
    assert (x["Total amount of energy consumed"], x["solar_total_generation"], x["proration_component_count"], x["source_file_count"]) == (9.0, 2.0, 6, 3)


def test_unmapped_splits_are_not_billed(spark):
    df = billed(spark, [(D(2023, 1, 5), D(2023, 1, 20))]).unionByName(billed(spark, [(D(2023, 1, 5), D(2023, 1, 20))], status="UNMAPPED").withColumn("row_id", F.lit("x"))).unionByName(billed(spark, [(D(2023, 1, 5), D(2023, 1, 20))], account="B", status=" ").withColumn("row_id", F.lit("y")))
    splits = periods.month_split(df, "start", "end")
    assert splits.count() == 3
    assert sorted((x.account_number, x.monthly_consumption, x.proration_component_count) for x in rollup.monthly_rollup(splits).collect()) == [("A", 10.0, 1), ("B", 10.0, 1)]


def test_columns_that_clash_with_helpers(spark):
    from tallyweave.functions import dates

    rows = spark.createDataFrame([("mine", "2024-01-02", "x", "y")], "_text string, raw string, _n string, _hash string")
    out = dates.with_dates(rows, "raw", "d").first()
    assert (out["_text"], out["_n"], str(out["d"])) == ("mine", "x", "2024-01-02")
    with pytest.raises(ValueError, match="reserved"):
        dates.with_dates(rows.withColumnRenamed("_n", "_tw_text"), "raw", "d")


def test_faults_raise_their_case(spark):
    df = billed(spark, [(D(2023, 1, 10), D(2023, 2, 20)), (D(2023, 4, 1), D(2023, 4, 20))])
    p = df.withColumn("period_id", F.col("row_id"))
    cut = periods.month_split(p, "start", "end").select("period_id", "month", "split_start", "split_end", "split_days", "split_quantity")
    assert audit.allocation_cases(p, cut).count() == 0
    lost = cut.where("not (period_id = 'r000' and month = date'2023-02-01')")
    assert {x.issue for x in audit.allocation_cases(p, lost).collect()} == {"Invoice reconciliation", "Missing or repeated allocation"}
    assert {x.issue for x in audit.allocation_cases(p.withColumn("energy_unit", F.lit("?")), cut).collect()} == {"Unsupported energy unit"}
    cover = {(x.month, x.issue): x.days for x in audit.coverage_cases(df, "2023-01-01", "2023-03-01").collect()}
    assert cover == {(D(2023, 1, 1), "Missing coverage"): 9, (D(2023, 2, 1), "Missing coverage"): 8, (D(2023, 3, 1), "Missing coverage"): 31}


def test_reports_and_tables(spark, tmp_path):
    cells = spark.createDataFrame([("d", "l", "u", "k", D(2024, 1, 1), 2.0), ("d", "l", "u", "k", D(2024, 2, 1), 3.0)], "division string, legal_entity string, unit_name string, kpi string, month date, v double")
    wide = reports.by_month(cells, F.col("v"), ["Jan 2024", "Feb 2024", "Mar 2024"]).first()
    assert (wide["Jan 2024"], wide["Feb 2024"], wide["Mar 2024"]) == (2.0, 3.0, None)
    sinks.report_by_kpi(cells, f"{tmp_path}/r", "kpi")
    assert spark.read.parquet(f"{tmp_path}/r").where("kpi = 'k'").count() == 2
    lookup = spark.createDataFrame([("Yes", "A ", "B"), ("no", "C", "D"), (None, None, None)], "active string, x string, y string")
    assert [x.lookup_key for x in readers.lookup_table(lookup, ["x", "y"]).collect()] == ["a_b"]
    with pytest.raises(ValueError, match="lacks z"):
        readers.lookup_table(lookup, ["z"])
    typed = sinks.typed(spark.createDataFrame([("2024-01-02", "x")], "d string, n string"), ["d"], ["n"]).first()
    assert tuple(typed) == (D(2024, 1, 2), None)


def test_late_arrivals_resolve_as_the_batch_does(spark):
    spans = [(D(2023, 1, 5), D(2023, 2, 5)), (D(2023, 3, 5), D(2023, 4, 4)), (D(2023, 2, 5), D(2023, 3, 5))]
    df = billed(spark, spans)
    other = billed(spark, [(D(2023, 1, 5), D(2023, 2, 5))], account="B").withColumn("row_id", F.lit("b"))
    history, late = df.where("row_id <> 'r002'").unionByName(other), df.where("row_id = 'r002'")
    key = lambda rows: sorted((x.row_id, x.date_resolution, x.effective_end) for x in rows.collect())
    assert key(stream.re_resolved(history, late)) == key(periods.resolve_dates(df))


def test_queries_name_their_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "monthly_kwh" in entry.queries()
