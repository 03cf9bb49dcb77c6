"""Work that grows no faster than its input: rows shuffled, and tasks that share it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.operators import enrich
from tallyweave.plans import archive_v1, audit, reports
from tallyweave.plans.queries import QUERIES
from tallyweave.sources import sinks

SMALL = "/root/testdata/sf0.001"


def stages(spark):
    """(id, tasks, shuffled rows, rows written) of every stage so far."""
    sc = spark.sparkContext
    listed = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    done = sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(listed)
    return [(s.stageId(), s.numTasks(), s.shuffleWriteRecords(), s.outputRecords()) for s in done]


def run(spark, build):
    """The stages that building and running a table adds."""
    before = {s[0] for s in stages(spark)}
    build().write.format("noop").mode("overwrite").save()
    return [s for s in stages(spark) if s[0] not in before]


def test_lookup_rows_of_one_key_meet_no_row_one_by_one(spark):
    n = 300
    rows = spark.range(n).selectExpr("concat('r', id) row_id", "'K' key", "concat('a', id) account_number", "'Steam' activity_group")
    lookup = spark.range(n).selectExpr("id lookup_id", "array('k') keys", "concat('A', id) account_number", "cast(null as string) activity_group", "id * 2 v")
    again = lookup.where("id = 5").selectExpr("1000L", "keys", "account_number", "activity_group", "7L")
    steam = lookup.selectExpr("lookup_id + 2000", "keys", "' '", "'Purchased Steam'", "v")
    out = enrich.specific_lookup(rows, lookup.where("id > 0").union(again).union(steam), ["v"])
    got = {r["row_id"]: (r["lookup_id"], r["v"], r["lookup_issue"] != "") for r in out.collect()}
    want = {f"r{i}": (i, 2 * i, False) for i in range(n)} | {"r0": (None, None, True), "r5": (None, None, True)}
    assert got == want
    assert sum(s[2] for s in run(spark, lambda: out)) < 20 * n


def test_cases_resolve_their_periods_once(spark):
    found = run(spark, lambda: QUERIES["case_scope"](spark, SMALL))
    # resolved, written, and only then told apart by case
    assert sum(s[2] for s in found) < 25_000
    assert sum(s[3] for s in found) > 6_000


def test_texts_are_written_as_files_of_one_folder(spark, tmp_path):
    rows = spark.range(40).selectExpr("concat('n', id, '.txt') name", "concat('ü', id, char(10)) text").repartition(4)
    assert sinks.write_texts(rows, f"file://{tmp_path}/in", "name", "text") == 40
    assert {p.name: p.read_text() for p in (tmp_path / "in").iterdir()} == {f"n{i}.txt": f"ü{i}\n" for i in range(40)}
    assert sinks.write_texts(rows.where("false"), f"file://{tmp_path}/none", "name", "text") == 0


def test_months_without_cover_are_not_joined(spark):
    rows = spark.range(50).selectExpr("'d' division", "'e' legal_entity", "'u' unit_name", "case when id > 0 then concat('a', id) end account_number", "'Heat' activity_group", "date'2000-01-31' start", "date'2000-02-02' end")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = run(spark, lambda: audit.coverage_cases(rows, "2000-01-01", "2019-12-01"))
        got = audit.coverage_cases(rows, "2000-01-01", "2019-12-01").groupBy("account_number").agg(F.sum("days"), F.count("month")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, got), key=str) == sorted(((f"a{i}" if i else None, 7305 - 3, 240) for i in range(50)), key=str)
    assert sum(s[2] for s in found) < 2_000


def test_completeness_makes_no_table_of_accounts_and_months(spark):
    months = [f"{y}-{m:02d}-01" for y in (2000, 2001, 2002) for m in range(1, 13)]
    place = ["'d' division", "'l' legal_entity", "'u' unit_name", "'Heat' kpi", "concat('a', id % 100) account_number"]
    accounts = spark.range(101).selectExpr(*place, "if(id = 1, date'2000-02-10', null) effective_start", "cast(null as date) effective_end")
    rows = spark.range(100).selectExpr(*place, "date'2000-01-31' start", "date'2000-02-10' end")
    out = reports.completeness(accounts, rows, months)
    got = {str(r["month"])[:7]: (r["covered_days"], r["expected_days"]) for r in out.collect()}
    # account 0 stands twice, account 1 begins on the tenth of February
    assert len(got) == 36 and got["2000-01"] == (100, 100 * 31) and got["2000-02"] == (100 * 10 + 1, 100 * 29 + 20) and got["2000-03"] == (0, 101 * 31)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for accounts too many to send to every task
    try:
        assert sum(s[2] for s in run(spark, lambda: reports.completeness(accounts, rows, months))) < 1500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_with_the_same_keys_are_looked_up_once(spark):
    n = 3000
    rows = spark.range(n).selectExpr("concat('r', id) row_id", "concat('A', id % 5) account_number", "'U' unit_name", "'E' legal_entity", "'Heat' activity_group", "'x' mapping_status")
    table = spark.range(4).selectExpr("id map_id", "concat('a', id) account_number", "if(id = 3, 'Cool', 'heat') activity_group", "'d' division", "cast(null as string) ocr_unit_name_list", "if(id = 0, 'e', '') ocr_legal_entity_name_list")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = enrich.mapping_cascade(rows, table)
        found = run(spark, lambda: out)
        got = {(x.account_number, x.mapping_status, x.mapping_method, x.mapped_id, x.n) for x in out.groupBy("account_number", "mapping_status", "mapping_method", "mapped_id").agg(F.count("*").alias("n")).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    each = n // 5
    assert got == {*((f"A{i}", "MAPPED", "ACCOUNT", i, each) for i in range(3)), ("A3", "CONFLICT", "ACCOUNT", None, each), ("A4", "MAPPED", "LEGAL_ENTITY_ALIAS", 0, each)}
    assert sum(s[2] for s in found) < 1.2 * n


def test_first_version_looks_rows_with_the_same_keys_up_once(spark):
    n = 3000
    rows = spark.range(n).selectExpr("concat('r', id) row_id", "if(id % 5 = 4, null, concat('A', id % 5)) account_number", "'U' unit_name", "if(id % 10 = 9, null, ' E') legal_entity")
    table = spark.range(3).selectExpr("id mapping_id", "concat('a', id) account_number", "'' unit_name", "'e' legal_entity", "'Yes' active")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = archive_v1.best_mapping(rows, table)
        found = run(spark, lambda: out)
        got = {tuple(x) for x in out.groupBy("match_priority", "mapping_id", "same_priority_candidate_count", "mapping_needs_review").agg(F.count("*")).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {*((1, i, 1, 0, 600) for i in range(3)), (3, 0, 3, 1, 900), (None, None, 0, 1, 300)}
    assert sum(s[2] for s in found) < 1.2 * n


def test_issues_of_a_decision_log_are_made_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = run(spark, lambda: QUERIES["decision_versions"](spark, SMALL))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(s[2] for s in found) < 95_000


def test_exploded_lookup_rows_are_not_broadcast(spark):
    # a supplier is some 500 lookup rows, but no more than itself by the size of its file
    for name in ("specificity_lookup", "contract_issues"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join" in line and "_tw_key" in line]
        assert joins and all("strategy=merge" in line for line in joins)
    rows = spark.range(9).selectExpr("concat('r', id) row_id", "concat('k', id) key", "concat('a', id) account_number", "'Steam' activity_group")
    lookup = spark.range(9).selectExpr("id lookup_id", "array(concat('K', id)) keys", "if(id % 2 = 0, concat('a', id), '') account_number", "'' activity_group", "id * 2 v")
    out = enrich.specific_lookup(rows, lookup.where("account_number <> ''"), ["v"])
    assert {r["row_id"]: r["v"] for r in out.collect()} == {f"r{i}": 2 * i if i % 2 == 0 else None for i in range(9)}
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_lineage_gathers_its_splits_once(spark):
    plan = QUERIES["monthly_lineage"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1 and "collect_set(" not in plan


def test_report_cases_carry_what_they_show(spark):
    # one aggregate by period, and one distinct of them for the months; nothing is joined back by period
    plan = QUERIES["audit_report_cases"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "period_id" in line]
