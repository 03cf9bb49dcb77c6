import datetime as dt
import random
from itertools import count

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import constraints, decision_log, graph, numbering, periods
from tallyweave.sources import layers
from tallyweave.streaming import ingest

D = dt.date
PERIOD = "row_id string, division string, legal_entity string, unit_name string, supplier_name string, account_number string, activity_group string, mapping_status string, start date, end date, period_index int"


@pytest.fixture
def spill(spark, tmp_path):
    n = count()

    def write(df):
        path = f"{tmp_path}/spill-{next(n)}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    return write


def period(row, start, end, account="a"):
    return (row, "d", "l", "u", "s", account, "Heat", "MAPPED", start, end, 1)


def resolved(df):
    return {x.row_id: (str(x.effective_end), x.date_resolution, x.resolution_reference) for x in df.collect()}


def test_late_periods_change_what_their_neighbours_were_resolved_to(spark, tmp_path):
    first, middle, last = period("first", D(2026, 1, 20), D(2026, 2, 19)), period("middle", D(2026, 2, 19), D(2026, 3, 20)), period("last", D(2026, 3, 20), D(2026, 4, 19))
    others = [period(f"o{i}", D(2026, 1, 1), D(2026, 1, 31), f"b{i}") for i in range(30)] + [period("blank", D(2026, 1, 5), D(2026, 1, 9), None)]
    frame = lambda rows: spark.createDataFrame(rows, PERIOD)
    path = f"{tmp_path}/history"
    ingest.begin_history(frame([first, last, *others]), path, 8)
    before = resolved(spark.read.parquet(path))
    assert before["first"][:2] == ("2026-02-19", "Gap") and before["last"][:2] == ("2026-04-19", "Gap")
    for _ in range(2):  # a batch that is run again changes nothing
        ingest.arrive(frame([middle]), 0, path, f"{tmp_path}/staged", 8)
    after = resolved(spark.read.parquet(path))
    assert after == resolved(periods.resolve_dates(frame([last, first, middle, *others])))
    assert [after[k][0] for k in ("first", "middle", "last")] == ["2026-02-18", "2026-03-19", "2026-04-18"]
    ingest.arrive(frame([period("middle", D(2026, 2, 25), D(2026, 3, 19))]), 1, path, f"{tmp_path}/staged", 8)  # corrected
    assert resolved(spark.read.parquet(path))["first"][:2] == ("2026-02-19", "Gap")
    ingest.arrive(frame([]), 2, path, f"{tmp_path}/staged", 8)
    assert spark.read.parquet(path).count() == 34


def test_late_batches_stage_one_batch_only(spark, tmp_path):
    rows = [period(f"r{i}", D(2026, i, 1), D(2026, i, 20)) for i in range(1, 7)]
    frame = lambda rows: spark.createDataFrame(rows, PERIOD)
    path, staged = f"{tmp_path}/history", tmp_path / "staged"
    ingest.begin_history(frame(rows[:2]), path, 8)
    for n in (0, 1, 2):
        ingest.arrive(frame(rows[n + 1 : n + 3]), n, path, str(staged), 8)  # the first of them has arrived before
    assert {p.name for p in staged.iterdir()} == {"again", "rows"}
    assert resolved(spark.read.parquet(path)) == resolved(periods.resolve_dates(frame(rows[:5])))


def test_files_are_read_once_and_corrupt_ones_are_set_aside(spark, tmp_path):
    source, out = tmp_path / "in", f"{tmp_path}/out"
    source.mkdir()
    for name, content in (("a", '{"fields":{"Acc":{"valueString":"1"}}}'), ("b", '{"fields":'), ("c", " \n"), ("d", "[1]")):
        (source / f"{name}.json").write_text(content)
    (source / "notes.txt").write_text("{}")
    ingest.ingest_documents(spark, str(source), out)
    (source / "e.json").write_text('{"Acc":{"valueString":"2"}}')
    for _ in range(2):
        ingest.ingest_documents(spark, str(source), out)
    good = sorted((x.source_file, x.account, x.batch) for x in ingest.ingested(spark, out).select("source_file", "batch", F.col("fields")["Acc"]["valueString"].alias("account")).collect())
    assert good == [("a.json", "1", 0), ("e.json", "2", 1)]
    assert sorted((x.source_file, x.length) for x in ingest.ingested(spark, out, "corrupt").collect()) == [("b.json", 10), ("c.json", 2), ("d.json", 3)]


def test_a_decision_log_keeps_its_versions(spark, tmp_path):
    path = str(tmp_path)
    assert decision_log.state(spark, path).count() == 0
    issues = spark.createDataFrame([(f"i{k}", f"inv{k}", "1", "quantity", str(k)) for k in range(6)], "issue_id string, invoice_id string, line_id string, field_name string, ocr_value string")
    decide = lambda rows, value, at: decision_log.decisions(rows, F.lit(value), F.lit("CORRECTED"), at)
    entries = {1: decide(issues, "a", "2024-01-02"), 2: decide(issues.where("issue_id < 'i3'"), "b", "2024-01-02"), 3: decision_log.deletions(issues.where("issue_id = 'i1'"), "2024-01-03"), 4: decide(issues.where("issue_id in ('i1', 'i2')"), "late", "2024-01-01")}
    states = []
    for version, part in entries.items():
        decision_log.append(spark, path, version, part)
        if version in (2, 3):
            decision_log.compact(spark, path, version)
        states.append({x.issue_id: x.corrected_value for x in decision_log.state(spark, path).collect()})
    assert states[1] == {"i0": "b", "i1": "b", "i2": "b", "i3": "a", "i4": "a", "i5": "a"}
    assert states[3] == {k: v for k, v in states[1].items() if k != "i1"}  # an entry older than the last does not count
    for n, want in enumerate(states, 1):
        assert {x.issue_id: x.corrected_value for x in decision_log.state(spark, path, n).collect()} == want
    own = decision_log.overrides(spark.createDataFrame([("IN-1", " ", "7")], "invoice_id string, line_id string, quantity string"), "quantity", F.lit("8"), "2024-02-01")
    decision_log.append(spark, path, 5, own)
    assert {x.issue_id for x in decision_log.state(spark, path).collect()} == {*states[3], "override_IN_1_1_quantity"}


def test_rows_that_break_a_rule_are_named(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", None), ("c", -1.0), ("c", 2.0)], "k string, q double")
    rules = {"no amount": F.col("q").isNotNull(), "negative": F.col("q") >= 0}
    good, bad = constraints.quarantined(rows, rules)
    assert sorted(x.k for x in good.collect()) == ["a", "c"]
    assert {x.k: x.faults for x in bad.collect()} == {"b": ["no amount", "negative"], "c": ["negative"]}
    with pytest.raises(Exception, match="row [bc]: "):
        constraints.enforced(rows, rules, "k").collect()
    assert constraints.enforced(good, rules, "k").count() == 2
    with pytest.raises(ValueError, match="negative: 2 rows, first b, c; no amount: 1 rows, first b"):
        constraints.refused(rows, rules, "k")
    constraints.refused(good, rules, "k")
    assert {(x.k, x.q, x.is_unique) for x in constraints.unique(rows, ["k"]).collect()} == {("a", 1.0, True), ("b", None, True), ("c", -1.0, False), ("c", 2.0, False)}


def test_layers_are_built_again_only_where_their_inputs_changed(spark, tmp_path):
    root, n = str(tmp_path), spark.range(20).withColumn("m", F.create_map(F.lit("k"), F.col("id")))
    plan = [
        layers.Layer("even", ("n",), lambda x: x.where("id % 2 = 0")), layers.Layer("sums", ("even", "w"), lambda x, w: x.join(w).groupBy("w").agg(F.sum("id").alias("s"))), layers.Layer("last", ("sums",), lambda x: x), layers.Layer("other", ("w",), lambda w: w.withColumn("category", F.lit("c")), partition_by=("category",)),
    ]
    w = lambda v: spark.createDataFrame([(v,)], "w int")
    builds = lambda: {k: x["build"] for k, x in layers.current(spark, root).items()}
    assert layers.stale(spark, root, plan, {"n": n, "w": w(1)})[:2] == [("even", "n"), ("sums", "even")]
    layers.refresh(spark, root, plan, {"n": n, "w": w(1)})
    layers.refresh(spark, root, plan, {"n": n.orderBy(F.desc("id")), "w": w(1)})
    assert (tmp_path / "other" / "build=1" / "category=c").is_dir()
    assert set(builds().values()) == {1} and layers.stale(spark, root, plan, {"n": n, "w": w(1)}) == []
    odd = n.union(spark.range(21, 22).withColumn("m", F.create_map(F.lit("k"), F.col("id"))))
    assert layers.stale(spark, root, plan, {"n": odd, "w": w(1)}) == [("even", "n"), ("sums", "even"), ("last", "sums")]
    layers.refresh(spark, root, plan, {"n": odd, "w": w(1)})
    assert builds() == {"even": 2, "sums": 1, "last": 1, "other": 1}  # the same even rows: the change ends there
    out = layers.refresh(spark, root, plan, {"n": odd, "w": w(2)})
    assert builds() == {"even": 2, "sums": 2, "last": 2, "other": 2} and out["last"].first().s == 90
    twice, once = spark.createDataFrame([(1,), (1,)], "x int"), spark.createDataFrame([(1,)], "x int")
    assert layers.fingerprint(twice) != layers.fingerprint(once) != layers.fingerprint(once.limit(0))


def test_dense_numbers_and_components(spark, spill):
    r = random.Random(3)
    rows = [(r.choice("ab") if i % 9 else None, r.randrange(40) if i % 7 else None, i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, x int, id int").repartition(5)
    key = lambda v: (v is not None, v if v is not None else 0)
    order = sorted(rows, key=lambda t: (key(t[1]), t[2]))
    assert {(x.id, x["index"]) for x in numbering.numbered(df, ["x", "id"], spill).collect()} == {(t[2], n + 1) for n, t in enumerate(order)}
    want = {t[2]: 1 + sum(u[0] == t[0] for u in order[:n]) for n, t in enumerate(order)}
    got = numbering.numbered(df, ["x", "id"], spill, by=["g"], name="n")
    assert got.columns == ["g", "x", "id", "n"] and {x.id: x.n for x in got.collect()} == want
    assert numbering.numbered(df.limit(0), ["x"], spill).count() == 0
    edges = [(i, i + 1) for i in range(300)] + [(1000, x) for x in range(1001, 1400)] + [(2000, 2000), (3001, 3000), (None, 5)]
    out = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "a int, b int"), spill).collect()}
    assert out == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1400)} | {3000: 3000, 3001: 3000}


def test_a_decision_log_is_kept_small(spark, tmp_path):
    issues = spark.createDataFrame([(f"i{i}", "a", "1", "f", "v") for i in range(3)], "issue_id string, invoice_id string, line_id string, field_name string, ocr_value string")
    path = f"{tmp_path}/log"
    decision_log.append(spark, path, 1, decision_log.decisions(issues, F.lit(None), F.lit("APPROVED"), "2024-01-01"))
    decision_log.compact(spark, path, 1)
    files = list(tmp_path.rglob("part-*"))
    assert files and all(".zstd." in p.name for p in files)
    assert decision_log.state(spark, path).count() == 3
