"""The star-schema tables seen as billing lines: each line item is one billed period of an account.

Deterministic rules of keys and dates give every case that the operators have: months from first to first and from last to last,
shared and overlapping dates, single days, reversed dates, blank accounts, unmapped lines and unsupported units.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with nation and region."""
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)


def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One billed period a line item. Dimensions are joined to the lines one by one: a join of dimensions among themselves has no size that Spark
    knows, and then it would broadcast the lines."""
    lines, supplier, nation, region = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation", "region"))
    rows = lines.join(supplier, lines.l_suppkey == supplier.s_suppkey).join(nation, supplier.s_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    rows = rows.withColumn("d", F.col("l_shipdate").cast("date"))
    rows = rows.selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, d) row_id",
        "concat('INV-', l_orderkey) invoice_id",
        "cast(l_linenumber as string) line_id",
        "r_name division",
        "n_name legal_entity",
        "concat('U-', l_suppkey % 20) unit_name",
        "s_name supplier_name",
        "case when l_suppkey % 23 = 0 and l_partkey % 10 = 3 then null else concat('ACC-', l_suppkey, '-', l_partkey % 10) end account_number",
        "case l_linenumber % 4 when 0 then 'Electricity' when 1 then 'Steam' when 2 then 'Heat' else 'Cool' end activity_group",
        "case l_linenumber % 5 when 0 then 'kWh' when 1 then 'MWh' when 2 then 'ton' when 3 then 'RTH' else 'mmBTU' end energy_unit",
        "case when l_suppkey % 17 = 5 then 'UNMAPPED' else 'MAPPED' end mapping_status",
        "case l_partkey % 3 when 0 then trunc(d, 'MM') when 1 then last_day(d) else d end start",
        "case l_partkey % 3 when 0 then add_months(trunc(d, 'MM'), 1) when 1 then last_day(add_months(trunc(d, 'MM'), 1)) else date_add(d, cast(l_quantity as int)) end plain_end",
        "l_quantity quantity",
        "l_discount discount",
        "l_tax tax",
        "l_linenumber",
        "l_partkey part_key",
        "l_suppkey supplier_key",
        "case when l_returnflag = 'R' then 'Manual entry' else 'Reviewed OCR' end flow",
    )
    end = F.expr("case when l_linenumber = 7 and discount > 0.095 then date_sub(start, 5) when quantity = 1 then start else plain_end end")
    return rows.withColumn("end", end).withColumn("period_index", F.lit(1)).drop("plain_end", "l_linenumber")


#: The same rows for DuckDB, as common table expressions.
PERIODS_SQL = """
lens AS (
  SELECT *, CAST(l_shipdate AS DATE) AS d FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
begun AS (
  SELECT *, CASE l_partkey % 3 WHEN 0 THEN CAST(date_trunc('month', d) AS DATE) WHEN 1 THEN last_day(d) ELSE d END AS "start",
    CAST(date_trunc('month', d) + INTERVAL 1 MONTH AS DATE) AS next_month FROM lens
),
periods AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, d) AS row_id, 'INV-' || l_orderkey AS invoice_id,
    CAST(l_linenumber AS VARCHAR) AS line_id, r_name AS division, n_name AS legal_entity, 'U-' || (l_suppkey % 20) AS unit_name,
    s_name AS supplier_name,
    CASE WHEN l_suppkey % 23 = 0 AND l_partkey % 10 = 3 THEN NULL ELSE 'ACC-' || l_suppkey || '-' || (l_partkey % 10) END AS account_number,
    CASE l_linenumber % 4 WHEN 0 THEN 'Electricity' WHEN 1 THEN 'Steam' WHEN 2 THEN 'Heat' ELSE 'Cool' END AS activity_group,
    CASE l_linenumber % 5 WHEN 0 THEN 'kWh' WHEN 1 THEN 'MWh' WHEN 2 THEN 'ton' WHEN 3 THEN 'RTH' ELSE 'mmBTU' END AS energy_unit,
    CASE WHEN l_suppkey % 17 = 5 THEN 'UNMAPPED' ELSE 'MAPPED' END AS mapping_status,
    "start",
    CASE WHEN l_linenumber = 7 AND l_discount > 0.095 THEN "start" - 5 WHEN l_quantity = 1 THEN "start"
      WHEN l_partkey % 3 = 0 THEN next_month WHEN l_partkey % 3 = 1 THEN last_day(next_month) ELSE d + CAST(l_quantity AS INT) END AS "end",
    l_partkey AS part_key, l_suppkey AS supplier_key, l_quantity AS quantity, l_discount AS discount, l_tax AS tax,
    CASE WHEN l_returnflag = 'R' THEN 'Manual entry' ELSE 'Reviewed OCR' END AS flow, 1 AS period_index
  FROM begun
)
"""


def documents_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested JSON documents: two ways to name the account, a blank amount at times, and up to three table lines."""
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey"))
    field = lambda kind, value: F.struct(value.cast("string").alias(kind), (F.col("k") % 10 / 10).alias("confidence"))
    line = lambda i: F.create_map(F.lit("valueObject"), F.create_map(F.lit("Qty"), F.create_map(F.lit("valueNumber"), (F.col("k") % 7 + i).cast("string")), F.lit("Waste"), F.create_map(F.lit("content"), F.concat(F.lit("kind "), (F.col("k") % 3 + i).cast("string")))))
    lines = F.slice(F.array(line(0), line(1), line(2)), F.lit(1), (F.col("k") % 4).cast("int"))
    name = F.when(F.col("k") % 2 == 0, "Account No").otherwise("Customer Account")
    fields = F.concat(
        F.lit('{"'), name, F.lit('":'), F.to_json(field("valueString", F.col("o_custkey"))),
        F.lit(',"Total":'), F.to_json(field("valueNumber", F.when(F.col("k") % 5 == 0, F.lit("")).otherwise(F.col("o_totalprice").cast("string")))),
        F.lit(',"Items":{"valueArray":'), F.to_json(lines), F.lit("}}"),
    )
    status = F.concat(F.lit('{"status":"'), "o_orderstatus", F.lit('","document_confidence":'), (F.col("k") % 10 / 10).cast("string"), F.lit(',"fields":'), fields, F.lit("}"))
    return o.select(F.concat(F.lit("doc-"), "k").alias("source_file"), status.alias("json"))


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account mapping: each supplier's ten accounts for two activities; the first twenty suppliers carry aliases."""
    s = sites(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("j", F.explode(F.array(F.lit(0), F.lit(1))))
    return s.selectExpr(
        "s_suppkey * 100 + k * 10 + j map_id",
        "r_name division",
        "case when k = 8 then ' ' else concat('ACC-', s_suppkey, '-', k) end account_number",
        "case (s_suppkey + k + j) % 4 when 0 then 'Electricity' when 1 then 'Steam' when 2 then 'Heat' else ' cool ' end activity_group",
        "case when s_suppkey < 20 and k = 0 then concat('u-', s_suppkey % 20, '; Unit ', s_suppkey) end ocr_unit_name_list",
        "case when s_suppkey < 30 and k = 1 and j = 0 then concat(n_name, '|', lower(n_name)) end ocr_legal_entity_name_list",
        "concat('U-', s_suppkey % 20) unit_name",
        "n_name legal_entity",
        "s_name supplier_name",
    )


MAPPING_SQL = """
mapping AS (
  SELECT s_suppkey * 100 + k * 10 + j AS map_id, r_name AS division,
    CASE WHEN k = 8 THEN ' ' ELSE 'ACC-' || s_suppkey || '-' || k END AS account_number,
    CASE (s_suppkey + k + j) % 4 WHEN 0 THEN 'Electricity' WHEN 1 THEN 'Steam' WHEN 2 THEN 'Heat' ELSE ' cool ' END AS activity_group,
    CASE WHEN s_suppkey < 20 AND k = 0 THEN 'u-' || (s_suppkey % 20) || '; Unit ' || s_suppkey END AS ocr_unit_name_list,
    CASE WHEN s_suppkey < 30 AND k = 1 AND j = 0 THEN n_name || '|' || lower(n_name) END AS ocr_legal_entity_name_list,
    'U-' || (s_suppkey % 20) AS unit_name, n_name AS legal_entity, s_name AS supplier_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, range(10) a(k), range(2) b(j)
)
"""


def allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy shares by unit, supplier and month: unqualified, for steam, for one account; some missing, tied or not summing to 1."""
    months = F.explode(F.sequence(F.lit("1995-01-01").cast("date"), F.lit("2001-12-01").cast("date"), F.expr("interval 1 month")))
    s = table(spark, sf_dir, "supplier").withColumn("month", months).withColumn("m", F.expr("year(month) * 12 + month(month)"))
    s = s.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(3)))).where("(s_suppkey + m) % 13 <> 0 and (v <> 3 or s_suppkey % 7 = 0)")
    return s.selectExpr(
        "s_suppkey * 1000000 + m * 10 + v lookup_id",
        "array(concat_ws('_', concat('U-', s_suppkey % 20), s_name, month), concat_ws('_', concat('u-', s_suppkey % 20), s_name, datediff(month, date'1899-12-30'))) keys",
        "case when v = 2 then concat('ACC-', s_suppkey, '-3') end account_number",
        "case when v in (1, 3) then 'Purchased Steam' when v = 2 then '' end activity_group",
        "case when s_suppkey % 9 = 4 then 0.6D else 0.5D end fossil",
        "case when s_suppkey % 11 = 4 then null else 0.25D end renewable",
        "0.25D nuclear",
        "cast(s_suppkey % 5 * 10 as double) generation",
    )


ALLOCATION_SQL = """
months AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS DATE) AS "month"),
allocation AS (
  SELECT s_suppkey * 1000000 + m * 10 + v AS lookup_id,
    [lower('U-' || (s_suppkey % 20) || '_' || s_name || '_' || "month"), lower('u-' || (s_suppkey % 20) || '_' || s_name || '_' || ("month" - DATE '1899-12-30'))] AS keys,
    CASE WHEN v = 2 THEN lower('ACC-' || s_suppkey || '-3') ELSE '' END AS l_account, CASE WHEN v IN (1, 3) THEN 'steam' ELSE '' END AS l_activity,
    CASE WHEN s_suppkey % 9 = 4 THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END AS fossil, CASE WHEN s_suppkey % 11 = 4 THEN NULL ELSE 0.25::DOUBLE END AS renewable,
    0.25::DOUBLE AS nuclear, CAST(s_suppkey % 5 * 10 AS DOUBLE) AS generation
  FROM (SELECT *, year("month") * 12 + month("month") AS m FROM supplier, months), range(4) t(v)
  WHERE (s_suppkey + m) % 13 <> 0 AND (v <> 3 OR s_suppkey % 7 = 0)
)
"""


def bronze_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted lines with a confidence for each field; some values blank."""
    return periods(spark, sf_dir).selectExpr(
        "invoice_id",
        "row_id line_id",
        "account_number",
        "1 - 5 * discount account_number_confidence",
        "case when tax > 0.075 then '  ' else supplier_name end supplier_name",
        "1 - 10 * tax supplier_name_confidence",
        "case when discount > 0.085 then null else energy_unit end energy_unit",
        "1 - 9 * discount energy_unit_confidence",
        "cast(cast(quantity as int) as string) quantity",
        "1 - 3 * tax quantity_confidence",
        "1 - 10 * tax document_confidence",
        "supplier_key",
        "part_key",
        "division category",
    )


BRONZE_SQL = """
bronze AS (
  SELECT invoice_id, row_id AS line_id, account_number, 1 - 5 * discount AS account_number_confidence,
    CASE WHEN tax > 0.075 THEN '  ' ELSE supplier_name END AS supplier_name, 1 - 10 * tax AS supplier_name_confidence,
    CASE WHEN discount > 0.085 THEN NULL ELSE energy_unit END AS energy_unit, 1 - 9 * discount AS energy_unit_confidence,
    CAST(CAST(quantity AS INT) AS VARCHAR) AS quantity, 1 - 3 * tax AS quantity_confidence, 1 - 10 * tax AS document_confidence,
    supplier_key, part_key, division AS category
  FROM periods
)
"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision log over bronze lines: approvals, corrections (some blank) and rejections, two entries for some fields."""
    entry = lambda seq, field, kind, value: F.struct(F.lit(seq).alias("seq"), F.lit(field).alias("field_name"), F.lit(kind).alias("review_decision"), value.alias("corrected_value"))
    null, fix = F.lit(None).cast("string"), F.concat(F.lit("FIX-"), "part_key")
    log = (
        F.when(F.col("supplier_key") % 4 == 0, F.array(entry(1, "account_number", "APPROVED", null), entry(2, "account_number", "CORRECTED", fix), entry(3, "quantity", "approved", null)))
        .when(F.col("supplier_key") % 4 == 1, F.array(entry(1, "account_number", "REJECTED", null)))
        .when(F.col("supplier_key") % 4 == 2, F.array(entry(1, "supplier_name", " Corrected ", F.lit(""))))
    )
    return bronze_rows(spark, sf_dir).select("invoice_id", "line_id", F.explode(log).alias("x")).select("invoice_id", "line_id", "x.*")


DECISIONS_SQL = """
decisions AS (
  SELECT invoice_id, line_id, seq, field_name, upper(trim(review_decision)) AS review_decision,
    CASE WHEN value = 'fix' THEN 'FIX-' || part_key ELSE value END AS corrected_value
  FROM bronze JOIN (VALUES (0, 1, 'account_number', 'APPROVED', NULL), (0, 2, 'account_number', 'CORRECTED', 'fix'), (0, 3, 'quantity', 'approved', NULL),
    (1, 1, 'account_number', 'REJECTED', NULL), (2, 1, 'supplier_name', ' Corrected ', '')) AS v(r, seq, field_name, review_decision, value)
    ON supplier_key % 4 = r
)
"""
