"""Registered queries of review state, manual entries, readers and sinks, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import text
from tallyweave.operators import bronze, enrich, manual, marking, review
from tallyweave.sources import lens, readers, sinks
from tallyweave.streaming import stream

from .oracle_parts import BRONZE_SQL, MAPPING_SQL, PERIODS_SQL, QUALITY, with_parts
from .shared import scratch, spill, write_and_read

FIELDS = {"account_number": "critical", "supplier_name": "optional", "energy_unit": "noncritical", "quantity": "critical"}


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = review.split_by_confidence(lens.bronze_rows(spark, sf_dir), 0.8)[1]
    return review.manual_queue(low, 0.8)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.bronze_rows(spark, sf_dir)
    status = F.when(F.col("part_key") % 3 == 0, "completed ").when(F.col("part_key") % 3 == 1, "PENDING")
    return rows.where("part_key % 4 <> 1").select("invoice_id", "line_id", "part_key", status.alias("manual_entry_status"))


def completed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manual.completed_decisions(_entries(spark, sf_dir), _queue(spark, sf_dir)).select("invoice_id", "line_id")


def pruned_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manual.pruned_decisions(_entries(spark, sf_dir), _queue(spark, sf_dir)).select("invoice_id", "line_id", "manual_entry_status")


def open_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manual.open_entries(_queue(spark, sf_dir), _entries(spark, sf_dir)).select("invoice_id", "line_id", "manual_entry_status")


def upload_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rebuilt queue keeps old uploads; new uploads of one name get numbered ids, counted on from what is queued."""
    low = _queue(spark, sf_dir).select("invoice_id", "line_id", "manual_entry_status")
    rows = lens.bronze_rows(spark, sf_dir)
    old = rows.where("part_key % 5 = 0").select(F.concat(F.lit("up"), F.col("supplier_key") % 50).alias("invoice_id"), F.lit("1").alias("line_id")).distinct()
    old = old.withColumns({"manual_entry_status": F.lit("PENDING"), "entry_source": F.lit(manual.UPLOAD)}).unionByName(low.limit(0).withColumn("entry_source", F.lit("x")), allowMissingColumns=True)
    new = rows.where("part_key % 7 = 0").select(F.concat(F.lit("up"), F.col("supplier_key") % 60).alias("base"), F.col("line_id").alias("at"), F.lit("NEW").alias("manual_entry_status"))
    return manual.appended_uploads(manual.rebuilt_queue(low.withColumn("entry_source", F.lit(None).cast("string")), old), new).select("invoice_id", "line_id", "manual_entry_status", "entry_source")


def entry_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.periods(spark, sf_dir).withColumn("supplier_name", F.when(F.col("part_key") % 9 != 0, F.col("supplier_name")))
    return rows.select("row_id", manual.entry_fault(["supplier_name", "unit_name", "start"]).alias("fault"))


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_issues(review.field_quality(lens.bronze_rows(spark, sf_dir), FIELDS))


def reopened_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New decisions for all issues, decided, then those of one field opened again, and those of another deleted."""
    rows = manual.new_decisions(_issues(spark, sf_dir)).withColumns({"review_decision": F.lit("APPROVED"), "review_tag": F.lit("DONE"), "corrected_value": F.col("original_value")})
    again = manual.reopened(rows, rows.where("field_name = 'account_number'"))
    left = manual.without(again, rows.where("field_name = 'quantity'"), ["issue_id"])
    return left.select("decision_id", "line_id", "field_name", "original_value", "corrected_value", "review_decision", "review_tag")


def override_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.bronze_rows(spark, sf_dir)
    ids = manual.override_id(F.col("invoice_id"), F.when(F.col("part_key") % 3 == 0, "--").otherwise(F.col("line_id")), F.lit("supplier name"))
    out = rows.select("line_id", ids.alias("issue_id"))
    return manual.without(out, out.where("issue_id like '%1_supplier_name'"), ["issue_id"])


def unit_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.periods(spark, sf_dir).withColumn("account_number", F.when(F.col("part_key") % 2 == 0, F.col("account_number")))
    return manual.unit_mapping(rows, lens.mapping(spark, sf_dir))


def line_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.bronze_rows(spark, sf_dir)
    log = lens.decisions(spark, sf_dir)
    return manual.line_view(rows.where("part_key % 5 = 2"), rows, _issues(spark, sf_dir), log).select("line_id", "account_number", "issues", "approved")


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of some statuses, approved ones left out; severity sorts as text in the report form."""
    summary = review.review_summary(review.field_quality(lens.bronze_rows(spark, sf_dir), FIELDS))
    return review.queue(summary, ["BLOCKED", "REVIEW_REQUIRED", "AUTO_APPROVED"], include_approved=False).select("invoice_id", "line_id", "review_status", "review_severity")


def invoice_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of a line beside whether its summary names it as failed, low or missing."""
    quality = review.field_quality(lens.bronze_rows(spark, sf_dir), FIELDS)
    return review.field_view(lens.bronze_rows(spark, sf_dir), review.review_summary(quality), list(FIELDS)).select("line_id", "field", "value", "status")


def first_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first mapping row of each unit in file order."""
    rows = lens.periods(spark, sf_dir).select("row_id", text.lookup_text(F.col("unit_name")).alias("lookup_key"))
    table = readers.lookup_table(lens.mapping(spark, sf_dir), ["unit_name"]).withColumn("seq", F.col("map_id"))
    return enrich.first_match(rows, table, ["map_id", "activity_group"], "seq").select("row_id", "map_id", "activity_group")


def greedy_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-wins marking of all periods, where a row may share its hash with one row and its key with another; some have no hash."""
    content = F.when(F.col("account_number").isNotNull(), F.concat_ws("|", "account_number", "start"))
    rows = lens.periods(spark, sf_dir).select(F.col("row_id").alias("seq"), content.alias("content_hash"), F.concat_ws("|", "invoice_id", "quantity").alias("business_key"))
    return marking.mark_duplicates_any(rows, spill(spark)).select("seq", "duplicate_status", "duplicate_of", "match_type")


def files_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON files and read back; their text tables written as CSV and read back; every file's provenance."""
    docs = lens.documents_json(spark, sf_dir)
    path = scratch(spark, "documents")
    docs.select("json").write.option("compression", "none").text(f"{path}/text")
    lines = spark.read.text(f"{path}/text").select(F.col("value").alias("json"))
    fields = bronze.extracted(bronze.parsed(lines), {"account": ["Account No", "Customer Account"]}).select("account", F.col("doc.status").alias("status"))
    fields.distinct().write.option("header", True).csv(f"{path}/csv")
    table = readers.text_table(spark, f"{path}/csv", ["account", "status"])
    seen = readers.provenance(spark, f"{path}/csv").where("length > 0").agg(F.count("*").alias("files"), F.countDistinct("sha256").alias("hashes")).select((F.col("files") >= F.col("hashes")).alias("hashed"))
    return table.crossJoin(F.broadcast(seen))  # seen is one row


def mapping_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The account mapping under its canonical columns."""
    raw = lens.mapping(spark, sf_dir).withColumnsRenamed({"legal_entity": "legal_entity_name", "supplier_name": "supplier"}).withColumn("active", F.when(F.col("map_id") % 4 == 0, " NO "))
    out = readers.account_mapping(readers.lookup_table(raw, ["account_number", "activity_group"]), ("account_number", "legal_entity", "supplier_name", "activity_group"))
    return out.select("map_id", "legal_entity", "supplier_name", "activity_group", "lookup_key")


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = lens.mapping(spark, sf_dir).select("division", F.col("legal_entity").alias("legal_entity_name"), F.when(F.col("map_id") % 7 != 0, F.col("unit_name")).otherwise(" ").alias("unit"), F.when(F.col("map_id") % 3 == 0, "No").when(F.col("map_id") % 3 == 1, " yes").alias("active"))
    return readers.entity_hierarchy(raw)


def sink_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze without repeated rows, a report by KPI and a typed export, each written and read back and counted."""
    rows = lens.periods(spark, sf_dir).selectExpr("invoice_id", "activity_group kpi_component", "cast(start as string) start", "cast(quantity as string) quantity", "quantity billed", "1000D factor")
    both = write_and_read(spark, lambda p: sinks.bronze_table(rows.union(rows), p))
    report = write_and_read(spark, lambda p: sinks.report_by_kpi(sinks.verified(sinks.typed(both, ["start"], ["quantity"]), "billed", "factor", "quantity"), p))
    return report.groupBy("kpi_component").agg(F.count("*").alias("n"), F.min("start").alias("first"), F.round(F.sum("Recalculated kWh"), 2).alias("again"), F.round(F.sum("Difference kWh"), 2).alias("difference"))


def stream_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, each twice, read as a stream of files and deduplicated by content."""
    docs = lens.documents_json(spark, sf_dir)
    path = scratch(spark, "stream")
    docs.union(docs).select("json").write.text(f"{path}/in")
    lines = spark.readStream.format("text").load(f"{path}/in").select(F.col("value").alias("json"), F.lit("2024-01-01").cast("timestamp").alias("modified"))
    unique = stream.deduped(stream.keyed(lines))
    stream.run_once(unique.select(F.col("doc.status").alias("status"), F.col("doc.document_confidence").alias("document_confidence")), f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out").groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("document_confidence"), 2).alias("confidence"))


QUERIES = {f.__name__: f for f in (completed_entries, pruned_entries, open_entries, upload_queue, entry_checks, reopened_decisions, override_ids, unit_mapping, line_view, review_queue, invoice_fields, first_lookup, greedy_duplicates, files_round_trip, mapping_table, hierarchy, sink_layers, stream_documents)}

_Q = (PERIODS_SQL, BRONZE_SQL, QUALITY)
_ENTRIES = with_parts(PERIODS_SQL, BRONZE_SQL) + """, entries AS (SELECT invoice_id, line_id, CASE part_key % 3 WHEN 0 THEN 'completed ' WHEN 1 THEN 'PENDING' END AS manual_entry_status, part_key FROM bronze WHERE part_key % 4 <> 1), queue AS (SELECT * FROM bronze WHERE document_confidence < 0.8)
"""

ORACLE_SQL = {
    "completed_entries": _ENTRIES + "SELECT invoice_id, line_id FROM entries WHERE part_key % 3 = 0 AND line_id IN (SELECT line_id FROM queue)",
    "pruned_entries": _ENTRIES + "SELECT invoice_id, line_id, manual_entry_status FROM entries WHERE line_id IN (SELECT line_id FROM queue)",
    "open_entries": _ENTRIES + "SELECT invoice_id, line_id, 'PENDING' AS manual_entry_status FROM queue WHERE line_id NOT IN (SELECT line_id FROM entries WHERE part_key % 3 = 0)",
    "upload_queue": _ENTRIES + """, old AS (SELECT DISTINCT 'up' || (supplier_key % 50) AS invoice_id FROM bronze WHERE part_key % 5 = 0), new AS (SELECT 'up' || (supplier_key % 60) AS base, row_number() OVER (PARTITION BY supplier_key % 60 ORDER BY line_id) AS n FROM bronze WHERE part_key % 7 = 0)
SELECT invoice_id, line_id, 'PENDING' AS manual_entry_status, NULL AS entry_source FROM queue UNION ALL SELECT invoice_id, '1', 'PENDING', 'UPLOAD' FROM old
UNION ALL SELECT CASE WHEN n + (base IN (SELECT invoice_id FROM old))::INT = 1 THEN base ELSE base || '_' || (n + (base IN (SELECT invoice_id FROM old))::INT) END, '1', 'NEW', 'UPLOAD' FROM new""",
    "entry_checks": with_parts(PERIODS_SQL) + """SELECT row_id, concat_ws('; ', CASE WHEN part_key % 9 = 0 THEN 'blank supplier_name' END, CASE WHEN account_number IS NULL THEN 'unlinked account_number' END,
  CASE WHEN energy_unit = 'mmBTU' THEN 'unknown energy_unit' END, CASE WHEN mapping_status <> 'MAPPED' THEN 'unresolved mapping_status' END) AS fault FROM periods""",
    "reopened_decisions": with_parts(*_Q) + """SELECT 'decision_' || issue_id AS decision_id, line_id, field_name, coalesce(ocr_value, '') AS original_value, CASE WHEN field_name = 'account_number' THEN '' ELSE coalesce(ocr_value, '') END AS corrected_value,
  CASE WHEN field_name = 'account_number' THEN '' ELSE 'APPROVED' END AS review_decision, CASE WHEN field_name = 'account_number' THEN 'PENDING' ELSE 'DONE' END AS review_tag FROM issues WHERE field_name <> 'quantity'""",
    "override_ids": with_parts(PERIODS_SQL) + """, o AS (SELECT row_id AS line_id, 'override_' || replace(invoice_id, '-', '_') || '_' || CASE WHEN part_key % 3 = 0 THEN '1' ELSE replace(row_id, '-', '_') END || '_supplier_name' AS issue_id FROM periods)
SELECT * FROM o WHERE NOT ends_with(issue_id, '1_supplier_name')""",
    "unit_mapping": with_parts(PERIODS_SQL, MAPPING_SQL) + """, m AS (SELECT map_id, lower(unit_name) AS u, lower(trim(account_number)) AS a FROM mapping),
c AS (SELECT u, '' AS a, count(*) AS n, min(map_id) AS one FROM m GROUP BY u UNION ALL SELECT u, a, count(*), min(map_id) FROM m WHERE a <> '' GROUP BY u, a),
r AS (SELECT row_id, lower(unit_name) AS u, CASE WHEN part_key % 2 = 0 THEN coalesce(lower(account_number), '') ELSE '' END AS a FROM periods)
SELECT row_id, CASE WHEN n IS NULL THEN 'UNMAPPED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'MAPPED' END AS mapping_status, CASE WHEN n = 1 THEN one END AS mapped_id FROM r LEFT JOIN c USING (u, a)""",
    "line_view": with_parts(*_Q) + """, good AS (SELECT CASE supplier_key % 4 WHEN 0 THEN 3 WHEN 2 THEN 1 ELSE 0 END AS n, line_id FROM bronze)
SELECT b.line_id, b.account_number, (SELECT count(*) FROM issues i WHERE i.line_id = b.line_id) AS issues, CAST(good.n AS BIGINT) AS approved FROM bronze b JOIN good USING (line_id) WHERE part_key % 5 = 2""",
    "review_queue": with_parts(*_Q) + "SELECT invoice_id, line_id, review_status, review_severity FROM summaries WHERE review_status IN ('BLOCKED', 'REVIEW_REQUIRED')",
    "invoice_fields": with_parts(*_Q) + """SELECT q.line_id, field, value, CASE WHEN list_contains(string_split(missing_required_fields, ';'), field) THEN 'Missing' WHEN list_contains(string_split(low_confidence_fields, ';'), field) THEN 'Low confidence' WHEN list_contains(string_split(failed_fields, ';'), field) THEN 'Failed' ELSE 'OK' END AS status
FROM quality q JOIN summaries USING (line_id)""",
    "first_lookup": with_parts(PERIODS_SQL, MAPPING_SQL) + """, f AS (SELECT lower(unit_name) AS u, min(map_id) AS map_id, arg_min(activity_group, map_id) AS activity_group FROM mapping GROUP BY 1) SELECT row_id, f.map_id, f.activity_group FROM periods LEFT JOIN f ON u = lower(unit_name)""",
    "greedy_duplicates": with_parts(PERIODS_SQL).replace("WITH", "WITH RECURSIVE", 1) + """, base AS (SELECT row_id AS seq, account_number || '|' || "start" AS h, invoice_id || '|' || quantity AS k FROM periods),
state AS (SELECT 0 AS turn, h, k, min(seq) AS seq, NULL::VARCHAR AS st FROM base GROUP BY h, k
  UNION ALL SELECT turn + 1, h, k, seq, CASE WHEN st IS NOT NULL THEN st WHEN won THEN 'P' WHEN (h IS NOT NULL AND h_won) OR (k IS NOT NULL AND k_won) THEN 'D' END
  FROM (SELECT *, bool_or(won) OVER (PARTITION BY h) AS h_won, bool_or(won) OVER (PARTITION BY k) AS k_won
    FROM (SELECT *, st IS NULL AND (h IS NULL OR seq = min(CASE WHEN st IS NULL THEN seq END) OVER (PARTITION BY h)) AND (k IS NULL OR seq = min(CASE WHEN st IS NULL THEN seq END) OVER (PARTITION BY k)) AS won,
      count(CASE WHEN st IS NULL THEN 1 END) OVER () AS todo FROM state) WHERE todo > 0)),
p AS (SELECT h, k, seq FROM state WHERE st = 'P' AND turn = (SELECT max(turn) FROM state)),
r AS (SELECT b.seq, CASE WHEN x.seq < b.seq THEN x.seq END AS by_hash, CASE WHEN y.seq < b.seq THEN y.seq END AS by_key FROM base b LEFT JOIN p x ON x.h = b.h LEFT JOIN p y ON y.k = b.k)
SELECT seq, CASE WHEN by_hash IS NULL AND by_key IS NULL THEN 'PRIMARY' ELSE 'DUPLICATE' END AS duplicate_status, coalesce(by_hash, by_key) AS duplicate_of,
  CASE WHEN by_hash IS NOT NULL THEN 'CONTENT_HASH' WHEN by_key IS NOT NULL THEN 'BUSINESS_KEY' END AS match_type FROM r""",
    "files_round_trip": """SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS account, o_orderstatus AS status, true AS hashed FROM orders""",
    "mapping_table": with_parts(MAPPING_SQL) + """SELECT map_id, legal_entity, supplier_name, CASE WHEN activity_group = ' cool ' THEN 'Cool' ELSE activity_group END AS activity_group, lower(trim(account_number)) || '_' || lower(trim(activity_group)) AS lookup_key FROM mapping WHERE map_id % 4 <> 0""",
    "hierarchy": with_parts(MAPPING_SQL) + "SELECT DISTINCT division, legal_entity AS legal_entity_name, unit_name AS unit FROM mapping WHERE map_id % 3 <> 0 AND map_id % 7 <> 0",
    "sink_layers": with_parts(PERIODS_SQL) + """, d AS (SELECT DISTINCT invoice_id, activity_group AS kpi_component, "start", quantity FROM periods)
SELECT kpi_component, count(*) AS n, min("start") AS first, round(sum(quantity * 1000), 2) AS again, round(sum(quantity * 1000 - quantity), 2) AS difference FROM d GROUP BY 1""",
    "stream_documents": """SELECT o_orderstatus AS status, count(*) AS n, round(sum((o_orderkey % 10) / 10), 2) AS confidence FROM (SELECT DISTINCT o_orderstatus, o_orderkey % 10 AS o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 7 END AS a, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 3 END AS b, o_orderkey % 4 AS c, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS t FROM orders) GROUP BY 1""",
}
