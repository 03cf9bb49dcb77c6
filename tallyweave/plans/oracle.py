"""DuckDB SQL for the engine's queries, written apart from the Spark forms: they must give the same rows."""

from __future__ import annotations

from tallyweave.plans import curated_queries, report_queries, review_queries, silver_queries, state_queries
from tallyweave.plans.oracle_parts import ALLOCATED, ALLOCATION_SQL, AUDITED, BRONZE_SQL, DECISIONS_SQL, HISTORY, INVOICES, MAPPING_SQL, MONTHLY, PERIODS_SQL, QUALITY, RESOLVED, SPLITS, TEMPLATE
from tallyweave.plans.oracle_parts import with_parts as _with

_RES = (PERIODS_SQL, RESOLVED)
_SPL = (*_RES, SPLITS)
_ALL = (*_SPL, MONTHLY, ALLOCATED)
_TPL = (*_ALL, TEMPLATE)
_QUA = (PERIODS_SQL, BRONZE_SQL, QUALITY)
_HIS = (PERIODS_SQL, HISTORY)

ORACLE_SQL = {
    "monthly_kwh": _with(*_SPL) + """SELECT division, legal_entity, unit_name, activity_group, "month", round(sum(split_quantity * f) + 1e-7, 4) AS kwh, count(*) AS splits FROM splits LEFT JOIN factors ON unit = energy_unit WHERE mapping_status = 'MAPPED' GROUP BY ALL""",
    "billing_date_resolution": _with(*_RES) + "SELECT row_id, effective_start, effective_end, date_adjustment, date_resolution, resolution_reference, date_provisional FROM resolved",
    # by brute force: every pair of a sequence
    "billing_overlap_flags": _with(PERIODS_SQL) + """, linked AS (SELECT *, concat_ws('|', account_number, activity_group, unit_name, legal_entity) AS seq FROM periods WHERE "end" >= "start" AND account_number IS NOT NULL AND mapping_status = 'MAPPED'),
bad AS (SELECT DISTINCT a.row_id FROM linked a JOIN linked b ON a.seq = b.seq AND a.row_id <> b.row_id AND a."start" <= b."end" AND b."start" <= a."end"
  WHERE NOT ((a."end" = b."start" AND a."start" < b."start" AND b."start" < b."end") OR (b."end" = a."start" AND b."start" < a."start" AND a."start" < a."end")))
SELECT row_id, row_id IN (SELECT row_id FROM bad) AS conflict FROM periods""",
    "interval_union_coverage": _with(PERIODS_SQL) + """, days AS (SELECT DISTINCT division, legal_entity, unit_name, activity_group, CAST(unnest(generate_series("start", "end", INTERVAL 1 DAY)) AS DATE) AS d FROM periods WHERE "end" >= "start")
SELECT division, legal_entity, unit_name, activity_group, count(*) AS covered_days, count(DISTINCT g) AS islands FROM (SELECT *, d - CAST(row_number() OVER (PARTITION BY division, legal_entity, unit_name, activity_group ORDER BY d) AS INT) AS g FROM days) GROUP BY ALL""",
    "day_coverage": _with(PERIODS_SQL) + """, days AS (SELECT legal_entity, unit_name, supplier_name, CAST(unnest(generate_series("start", "end", INTERVAL 1 DAY)) AS DATE) AS d FROM periods WHERE "end" >= "start"), n AS (SELECT *, count(*) AS n FROM days GROUP BY ALL)
SELECT legal_entity, unit_name, supplier_name, CAST(date_trunc('month', d) AS DATE) AS "month", count(*) AS covered_days, count(*) FILTER (n > 1) AS overlapping_days FROM n GROUP BY ALL""",
    "month_split": _with(*_SPL) + """SELECT row_id, "month", split_start, split_end, split_days, total_days, round(split_quantity, 6) AS split_quantity FROM splits""",
    "period_stack": _with(PERIODS_SQL) + """SELECT row_id, 1 AS period_index, "start", "end", CASE WHEN part_key % 4 = 0 THEN quantity ELSE quantity + CASE WHEN part_key % 8 < 5 THEN quantity / 2 ELSE 0 END END AS quantity FROM periods
UNION ALL SELECT row_id, 2, "end" + 1, "end" + 30, CASE WHEN part_key % 8 < 5 THEN quantity / 2 END FROM periods WHERE part_key % 4 = 0""",
    "duplicate_marking": _with(PERIODS_SQL) + """, g AS (SELECT *, CASE WHEN account_number IS NOT NULL THEN concat_ws('|', account_number, activity_group, "start", quantity) END AS k FROM periods),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY row_id) AS n, first_value(row_id) OVER (PARTITION BY k ORDER BY row_id) AS f, first_value(energy_unit || "end") OVER (PARTITION BY k ORDER BY row_id) AS h FROM g WHERE k IS NOT NULL)
SELECT row_id AS source_file, CASE WHEN n > 1 THEN 'DUPLICATE' ELSE 'PRIMARY' END AS duplicate_status, CASE WHEN n > 1 THEN f END AS duplicate_of, CASE WHEN n > 1 THEN CASE WHEN h = energy_unit || "end" THEN 'CONTENT_HASH' ELSE 'BUSINESS_KEY' END END AS match_type
FROM g LEFT JOIN n USING (row_id)""".replace("h = energy_unit || \"end\"", "n.h = g.energy_unit || g.\"end\""),
    "field_quality": _with(*_QUA) + "SELECT line_id, field, criticality, threshold, field_status, reason_code FROM quality",
    "review_summary": _with(*_QUA) + "SELECT * REPLACE (round(min_critical_confidence, 6) AS min_critical_confidence) FROM summaries",
    "review_issues": _with(*_QUA) + "SELECT issue_id, line_id, field_name, issue_type, severity, ocr_value FROM issues",
    "approval_overlay": _with(*_QUA, DECISIONS_SQL) + """, good AS (SELECT *, row_number() OVER (PARTITION BY line_id, field_name ORDER BY seq DESC) AS n FROM decisions WHERE review_decision IN ('APPROVED', 'CORRECTED', 'NOT_APPLICABLE')),
last AS (SELECT line_id, field_name, true AS has, CASE WHEN review_decision = 'CORRECTED' OR coalesce(corrected_value, '') <> '' THEN coalesce(corrected_value, '') END AS v FROM good WHERE n = 1),
counts AS (SELECT line_id, count(*) AS n FROM good GROUP BY line_id)
SELECT b.line_id, coalesce(a.v, b.account_number) AS account_number, coalesce(s.v, b.supplier_name) AS supplier_name, b.energy_unit, coalesce(q.v, b.quantity) AS quantity,
  CASE WHEN c.n IS NULL THEN 'AUTO_APPROVED' ELSE 'MANUALLY_APPROVED' END AS approval_status, coalesce(c.n, 0) AS manual_review_decision_count
FROM bronze b JOIN summaries USING (line_id) LEFT JOIN counts c USING (line_id) LEFT JOIN last a ON a.line_id = b.line_id AND a.field_name = 'account_number'
LEFT JOIN last s ON s.line_id = b.line_id AND s.field_name = 'supplier_name' LEFT JOIN last q ON q.line_id = b.line_id AND q.field_name = 'quantity' WHERE NOT review_required OR c.n IS NOT NULL""",
    "decision_carryover": _with(*_QUA) + """, stable AS (SELECT invoice_id, field_name, coalesce(original_value, '') AS value, max_by(review_decision, issue_id) AS review_decision, max_by(corrected_value, issue_id) AS corrected_value FROM old GROUP BY ALL)
SELECT i.issue_id, i.line_id, i.field_name, coalesce(o.review_decision, s.review_decision, 'PENDING') AS review_decision, CASE WHEN o.issue_id IS NOT NULL THEN o.corrected_value ELSE s.corrected_value END AS corrected_value
FROM issues i LEFT JOIN old o USING (issue_id) LEFT JOIN stable s ON s.invoice_id = i.invoice_id AND s.field_name = i.field_name AND s.value = coalesce(i.ocr_value, '')
UNION ALL SELECT issue_id, line_id, field_name, review_decision, corrected_value FROM old WHERE issue_id LIKE 'override_%' AND issue_id NOT IN (SELECT issue_id FROM issues)""",
    "open_queue": _with(*_QUA) + """SELECT line_id, review_status, review_severity FROM summaries WHERE line_id IN (SELECT line_id FROM issues WHERE issue_id NOT IN (SELECT issue_id FROM old WHERE review_decision = 'APPROVED'))""",
    "latest_decisions": _with(PERIODS_SQL, BRONZE_SQL, DECISIONS_SQL) + "SELECT line_id, field_name, max(seq) AS seq, max_by(review_decision, seq) AS review_decision FROM decisions GROUP BY ALL",
    "queue_merge": _with(PERIODS_SQL, BRONZE_SQL, DECISIONS_SQL) + """, q AS (SELECT line_id, account_number FROM bronze WHERE document_confidence < 0.8), d AS (SELECT * FROM decisions WHERE seq = 1)
SELECT coalesce(q.line_id, d.line_id) AS line_id, CASE WHEN d.line_id IS NOT NULL THEN d.corrected_value ELSE q.account_number END AS account_number, CASE WHEN d.line_id IS NOT NULL THEN 'COMPLETED' ELSE 'PENDING' END AS manual_entry_status FROM q FULL JOIN d ON q.line_id = d.line_id""",
    "category_dashboard": _with(*_QUA) + """, c AS (SELECT category, count(*) AS lines, count(*) FILTER (review_status = 'BLOCKED') AS blocked, count(*) FILTER (review_status = 'REVIEW_REQUIRED') AS to_review, count(*) FILTER (review_status = 'AUTO_APPROVED') AS approved FROM summaries JOIN bronze USING (line_id) GROUP BY category)
SELECT *, CASE WHEN blocked > 0 THEN 'Needs attention' WHEN to_review > 0 THEN 'In progress' ELSE 'Ready' END AS status FROM c""",
    "mapping_cascade": _with(PERIODS_SQL, MAPPING_SQL, INVOICES) + """, keys AS (SELECT DISTINCT map_id, p, trim(k) AS k FROM (SELECT map_id, 1 AS p, lower(account_number) AS k FROM mapping
  UNION ALL SELECT map_id, 2, unnest(string_split(lower(ocr_unit_name_list), ';')) FROM mapping UNION ALL SELECT map_id, 3, unnest(string_split(lower(ocr_legal_entity_name_list), '|')) FROM mapping) WHERE trim(k) <> ''),
hits AS (SELECT row_id, activity_group AS act, p, map_id FROM invoices, LATERAL (VALUES (1, lower(account_number)), (2, lower(unit_name)), (3, lower(legal_entity))) AS v(p, k) JOIN keys USING (p, k)),
best AS (SELECT h.*, m.division AS m_division, m.account_number AS m_account, act IS NULL OR lower(trim(m.activity_group)) = lower(act) AS agrees FROM hits h JOIN mapping m USING (map_id) QUALIFY p = min(p) OVER (PARTITION BY row_id)),
done AS (SELECT row_id, min(p) AS p, count(*) FILTER (agrees) AS n, min(map_id) FILTER (agrees) AS map_id, min(m_division) FILTER (agrees) AS m_division, min(m_account) FILTER (agrees) AS m_account FROM best GROUP BY row_id),
st AS (SELECT *, CASE WHEN n = 0 THEN 'CONFLICT' WHEN n > 1 THEN 'AMBIGUOUS' WHEN trim(m_account) = '' THEN 'INCOMPLETE' ELSE 'MAPPED' END AS s FROM done)
SELECT i.row_id, coalesce(s, 'UNMAPPED') AS mapping_status, CASE p WHEN 1 THEN 'ACCOUNT' WHEN 2 THEN 'UNIT_ALIAS' WHEN 3 THEN 'LEGAL_ENTITY_ALIAS' ELSE '' END AS mapping_method, CASE WHEN s = 'MAPPED' THEN map_id END AS mapped_id, CASE WHEN s = 'MAPPED' THEN m_division END AS mapped_division FROM invoices i LEFT JOIN st USING (row_id)""",
    "manual_mapping": _with(PERIODS_SQL, MAPPING_SQL, INVOICES) + """, r AS (SELECT row_id, CASE WHEN part_key % 7 <> 0 THEN lower(unit_name) END AS u, CASE WHEN part_key % 2 = 0 THEN lower(supplier_name) END AS s, lower(account_number) AS a, lower(activity_group) AS g FROM invoices),
m AS (SELECT map_id, lower(unit_name) AS u, lower(supplier_name) AS s, lower(trim(account_number)) AS a, lower(trim(activity_group)) AS g FROM mapping),
combos AS (SELECT DISTINCT u, s, a, g FROM r),
c AS (SELECT x.u, x.s, x.a, x.g, count(m.map_id) AS n, min(m.map_id) AS one FROM combos x LEFT JOIN m ON (x.u IS NULL OR x.u = m.u) AND (x.s IS NULL OR x.s = m.s) AND (x.a IS NULL OR x.a = m.a) AND (x.g IS NULL OR x.g = m.g) AND NOT (x.u IS NULL AND x.s IS NULL AND x.a IS NULL AND x.g IS NULL) GROUP BY ALL)
SELECT r.row_id, CASE WHEN n = 0 THEN 'UNMAPPED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'MAPPED' END AS mapping_status, CASE WHEN n = 1 THEN one END AS mapped_id
FROM r JOIN c ON r.u IS NOT DISTINCT FROM c.u AND r.s IS NOT DISTINCT FROM c.s AND r.a IS NOT DISTINCT FROM c.a AND r.g IS NOT DISTINCT FROM c.g""",
    "monthly_rollup": _with(*_SPL, MONTHLY) + """SELECT m.* REPLACE (round(monthly_consumption + 1e-7, 4) AS monthly_consumption), CAST(covered AS INT) AS covered_days_in_month, CAST(day(last_day(m."month")) AS INT) AS calendar_days_in_month, covered >= day(last_day(m."month")) AS complete_month_data_captured
FROM monthly m JOIN month_days d ON m.division = d.division AND m.legal_entity = d.legal_entity AND m.unit_name = d.unit_name AND m.supplier_name = d.supplier_name AND m.account_number IS NOT DISTINCT FROM d.account_number AND m.activity_group = d.activity_group AND m.energy_unit = d.energy_unit AND m."month" = d."month" AND m.flow = d.flow""",
    "specificity_lookup": _with(*_ALL) + "SELECT row_id, lookup_id, lookup_issue FROM allocated",
    "kpi_template": _with(*_TPL) + "SELECT row_id, energy_kpi, round(amount + 1e-7, 4) AS amount, issue FROM template",
    "gold_template": _with(*_TPL) + "SELECT row_id, energy_kpi, round(kwh + 1e-7, 4) AS kwh, energy_unit AS original_unit FROM gold",
    "gold_aggregated": _with(*_TPL) + """, main AS (SELECT division, legal_entity, unit_name, "month", 'Purchased ' || lower(activity_group) AS component, sum(kwh) FILTER (energy_kpi IN ('Fossil Fuels', 'Renewable sources', 'Nuclear sources')) AS total,
  sum(kwh) FILTER (energy_kpi = 'Fossil Fuels') AS fossil_kwh, string_agg(DISTINCT energy_kpi, '; ' ORDER BY energy_kpi) AS kpis FROM gold GROUP BY ALL),
once AS (SELECT DISTINCT division, legal_entity, unit_name, "month", 'Purchased ' || lower(activity_group) AS component, row_id, solar, proration_component_count AS n, source_files AS c FROM gold),
extra AS (SELECT division, legal_entity, unit_name, "month", component, sum(solar) AS solar, CAST(sum(n) AS BIGINT) AS n FROM once GROUP BY ALL),
files AS (SELECT division, legal_entity, unit_name, "month", component, count(DISTINCT f) AS c FROM (SELECT *, unnest(string_split(c, '; ')) AS f FROM once) GROUP BY ALL)
SELECT division, legal_entity, unit_name, "month", component, round(total + 1e-7, 3) AS total_kwh, round(CASE WHEN total <> 0 THEN fossil_kwh / total END + 1e-7, 4) AS fossil, round(solar + 1e-7, 3) AS solar, n AS proration_component_count, c AS source_file_count, kpis
FROM main JOIN extra USING (division, legal_entity, unit_name, "month", component) JOIN files USING (division, legal_entity, unit_name, "month", component)""",
    "reporting_rejects": _with(*_HIS) + "SELECT row_id, reject_reason FROM checked WHERE reject_reason IS NOT NULL",
    "year_over_year": _with(*_HIS) + """SELECT division, legal_entity, unit_name, kpi, "month", round(current + 1e-7, 4) AS current, round(previous + 1e-7, 4) AS previous, round(difference + 1e-7, 4) + 0.0 AS difference, class,
CASE WHEN current IS NULL AND previous IS NULL THEN 'no data' WHEN current IS NULL THEN 'missing current' WHEN previous IS NULL THEN 'missing previous' ELSE 'compared' END AS status FROM classed""",
    "high_variance": _with(*_HIS) + """SELECT division, legal_entity, unit_name, kpi, "month", round(abs(difference) + 1e-7, 4) AS size, class FROM classed WHERE abs(difference) > 0.1""",
    "top_variance_page": _with(*_HIS) + """SELECT division, legal_entity, unit_name, kpi, "month", round(abs(difference) + 1e-7, 4) AS size FROM classed WHERE abs(difference) > 0.1 AND NOT isinf(difference) ORDER BY size DESC, division, legal_entity, unit_name, kpi, "month" LIMIT 25 OFFSET 25""",
    "completeness": _with(PERIODS_SQL) + """, ends AS (SELECT CAST(date_trunc('month', min("start")) AS DATE) AS lo, CAST(date_trunc('month', max("start")) AS DATE) AS hi FROM periods), a AS (SELECT DISTINCT division, legal_entity, unit_name, activity_group AS kpi, account_number, CASE length(unit_name || account_number) % 3 WHEN 0 THEN DATE '1998-03-15' END AS es, CASE length(unit_name || account_number) % 3 WHEN 1 THEN DATE '1998-09-10' END AS ee FROM periods WHERE account_number IS NOT NULL),
due AS (SELECT *, CAST(unnest(generate_series(greatest(coalesce(es, lo), lo), least(coalesce(ee, last_day(hi)), last_day(hi)), INTERVAL 1 DAY)) AS DATE) AS d FROM a, ends),
got AS (SELECT DISTINCT division, legal_entity, unit_name, activity_group AS kpi, account_number, CAST(unnest(generate_series("start", "end", INTERVAL 1 DAY)) AS DATE) AS d FROM periods WHERE "end" >= "start"),
both_ AS (SELECT division, legal_entity, unit_name, kpi, CAST(date_trunc('month', d) AS DATE) AS "month", count(*) AS expected_days, count(g.account_number) AS covered_days FROM due LEFT JOIN (SELECT *, true AS has FROM got) g USING (division, legal_entity, unit_name, kpi, account_number, d) GROUP BY ALL),
hits AS (SELECT division, legal_entity, unit_name, kpi, CAST(date_trunc('month', d) AS DATE) AS "month", count(*) AS covered_days FROM due JOIN got USING (division, legal_entity, unit_name, kpi, account_number, d) GROUP BY ALL),
grid AS (SELECT DISTINCT division, legal_entity, unit_name, kpi, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS "month" FROM a, ends),
r AS (SELECT g.*, coalesce(h.covered_days, 0) AS covered_days, coalesce(b.expected_days, 0) AS expected_days FROM grid g LEFT JOIN both_ b USING (division, legal_entity, unit_name, kpi, "month") LEFT JOIN hits h USING (division, legal_entity, unit_name, kpi, "month")),
q AS (SELECT *, CASE WHEN expected_days > 0 THEN covered_days / expected_days END AS x FROM r)
SELECT * EXCLUDE (x), round(x, 6) AS ratio, CASE WHEN x IS NULL THEN 'missing' WHEN x >= 1 THEN 'complete' WHEN x >= 0.5 THEN 'over_half' WHEN x >= 0.25 THEN 'over_quarter' ELSE 'low' END AS class FROM q""",
    "expected_accounts": _with(MAPPING_SQL) + """, k AS (SELECT *, lower(trim(activity_group)) AS act, trim(account_number) AS account FROM mapping)
SELECT map_id, CASE WHEN count(*) OVER (PARTITION BY division, legal_entity, unit_name, act, account) > 1 THEN 'Duplicate facility/KPI/account rows in the shared mapping'
  WHEN map_id % 7 = 0 AND map_id % 17 <> 3 THEN 'Account effective end date precedes its start date' WHEN map_id % 7 <> 0 AND map_id % 19 = 4 THEN 'Invalid effective_end_date in the shared account mapping'
  WHEN map_id % 17 = 3 THEN 'Invalid effective_start_date in the shared account mapping' WHEN account = '' THEN 'Missing expected account number' ELSE '' END AS issue FROM k""",
    "audit_cases": _with(*_SPL, AUDITED) + """SELECT issue, "month", period_id, 'A-' || substr(sha256(concat_ws('|', issue, "month", period_id)), 1, 10) AS case_id FROM cases""",
    "audit_coverage": _with(*_RES) + """, ends AS (SELECT CAST(date_trunc('month', min("start")) AS DATE) AS lo, CAST(date_trunc('month', max("start")) AS DATE) AS hi FROM periods), v AS (SELECT division, legal_entity, unit_name, coalesce(account_number, '?') AS account, activity_group, effective_start AS s, effective_end AS e FROM resolved WHERE effective_end >= effective_start),
days AS (SELECT division, legal_entity, unit_name, account, activity_group, CAST(unnest(generate_series(greatest(s, lo), least(e, last_day(hi)), INTERVAL 1 DAY)) AS DATE) AS d FROM v, ends),
n AS (SELECT *, count(*) AS n FROM days GROUP BY ALL),
c AS (SELECT division, legal_entity, unit_name, account, activity_group, CAST(date_trunc('month', d) AS DATE) AS "month", count(*) AS covered, count(*) FILTER (n > 1) AS over FROM n GROUP BY ALL),
g AS (SELECT division, legal_entity, unit_name, account, activity_group, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS "month" FROM (SELECT DISTINCT division, legal_entity, unit_name, account, activity_group FROM v), ends),
f AS (SELECT g.*, day(last_day("month")) - coalesce(covered, 0) AS missing, coalesce(over, 0) AS over FROM g LEFT JOIN c USING (division, legal_entity, unit_name, account, activity_group, "month"))
SELECT division, legal_entity, unit_name, nullif(account, '?') AS account_number, activity_group, "month", 'Missing coverage' AS issue, missing AS days FROM f WHERE missing > 0
UNION ALL SELECT division, legal_entity, unit_name, nullif(account, '?'), activity_group, "month", 'Overlapping billing periods', over FROM f WHERE over > 0""",
    "audit_summary": _with(PERIODS_SQL) + """SELECT division, activity_group, count(DISTINCT account_number) AS accounts, round(sum(quantity * CASE energy_unit WHEN 'kWh' THEN 1.0::DOUBLE WHEN 'MWh' THEN 1000.0::DOUBLE WHEN 'ton' THEN 720.0::DOUBLE WHEN 'RTH' THEN 0.62::DOUBLE END), 2) AS kwh,
count(DISTINCT row_id) AS periods, count(*) FILTER (energy_unit = 'mmBTU') AS unavailable FROM periods GROUP BY ALL""",
    "best_mapping_sql": _with(PERIODS_SQL, MAPPING_SQL, INVOICES) + """, m AS (SELECT map_id, nullif(lower(trim(account_number)), '') AS a, nullif(lower(trim(unit_name)), '') AS u, nullif(lower(trim(legal_entity)), '') AS l FROM mapping WHERE map_id % 5 <> 0),
k AS (SELECT 1 AS p, a AS k, map_id FROM m UNION ALL SELECT 2, u, map_id FROM m UNION ALL SELECT 3, l, map_id FROM m),
g AS (SELECT p, k, min(map_id) AS one, count(*) AS n FROM k WHERE k IS NOT NULL GROUP BY ALL),
c AS (SELECT row_id, p, one, n FROM invoices, LATERAL (VALUES (1, lower(account_number)), (2, lower(unit_name)), (3, lower(legal_entity))) AS v(p, k) JOIN g USING (p, k) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY p) = 1)
SELECT i.row_id, one AS mapping_id, CASE p WHEN 1 THEN 'account_number' WHEN 2 THEN 'unit_name' WHEN 3 THEN 'legal_entity' END AS match_method, p AS match_priority, coalesce(n, 0) AS same_priority_candidate_count, CASE WHEN one IS NULL OR n > 1 THEN 1 ELSE 0 END AS mapping_needs_review FROM invoices i LEFT JOIN c USING (row_id)""",
    "gold_sql_v1": _with(*_ALL) + """, x AS (SELECT row_id, activity_group, round(monthly_consumption + 1e-7, 4) AS amount, energy_kpi, allocation_pct FROM (SELECT *, unnest(['Fossil Fuels', 'Renewable sources', 'Nuclear sources']) AS energy_kpi, unnest([coalesce(fossil, 1.0), coalesce(renewable, 0.0), coalesce(nuclear, 0.0)]) AS allocation_pct FROM allocated))
SELECT row_id, 'Actual' AS data_quality, CASE activity_group WHEN 'Electricity' THEN 'Purchased electricity' WHEN 'Steam' THEN 'Purchased steam' ELSE activity_group END AS kpi_component, energy_kpi, allocation_pct, amount, 'No contractual instrument - emission factors unknown' AS instrument FROM x WHERE allocation_pct > 0""",
    "dq_sql": _with(ALLOCATION_SQL) + "SELECT lookup_id, round(fossil + renewable + nuclear, 6) AS total_pct FROM allocation WHERE fossil + renewable + nuclear NOT BETWEEN 0.99 AND 1.01",
    "clean_text": """SELECT p_partkey, array_to_string(list_transform(string_split(p_name || ' b.v. ' || p_brand || ' gmbh. UK', ' '), lambda w: CASE WHEN w LIKE '%.%' OR upper(w) = 'UK' THEN upper(w) ELSE upper(w[1]) || lower(w[2:]) END), ' ') AS proper, upper(p_name || ' b.v. ' || p_brand || ' gmbh. UK') AS upper FROM part""",
    "energy_unit_extract": """SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN 'KWH' WHEN 1 THEN 'KWH' WHEN 2 THEN 'KWH' WHEN 3 THEN '' WHEN 4 THEN 'TON' WHEN 5 THEN '' WHEN 6 THEN 'KWH' WHEN 7 THEN '' WHEN 8 THEN 'RTH' WHEN 11 THEN 'TON' ELSE '' END AS unit FROM part""",
    "quantity_clean": """SELECT o_orderkey, '1' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '.' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS amount,
CASE WHEN o_orderkey % 2 = 0 THEN '12' || (o_orderkey % 1000) ELSE '3' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') END || '.' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS quantity,
CAST('1' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '.' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS DOUBLE) AS number FROM orders""",
    "facility_key": """SELECT c_custkey, 'zürichs ' || replace(lower(c_name), '#', ' ') || ' côté ' || lower(c_mktsegment) || ' no 1' AS key FROM customer""",
    "date_normalise": """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 10 AS k FROM orders),
x AS (SELECT *, CASE WHEN k IN (0, 3) THEN d WHEN k = 2 THEN make_date(2000 + year(d) % 100, month(d), day(d)) WHEN k = 5 THEN make_date(year(d) + 20, month(d), day(d)) WHEN k = 1 AND day(d) > 12 THEN d WHEN k = 1 THEN make_date(year(d), day(d), month(d)) WHEN k = 4 THEN CAST(date_trunc('month', d) AS DATE)
  WHEN k = 6 AND day(d) > 12 THEN d + 1 WHEN k = 6 THEN make_date(year(d), day(d), month(d)) + 1 END AS date FROM o)
SELECT o_orderkey, date, CASE WHEN k < 7 THEN 'OK' WHEN k = 7 THEN 'NOT_DATE' WHEN k = 8 THEN 'REVIEW_DATE' ELSE 'BLANK' END AS status,
CASE WHEN k >= 7 THEN 0 WHEN k IN (1, 2, 6) AND day(d) <= 12 AND day(d) <> month(d) THEN 2 ELSE 1 END AS candidates, date - DATE '1899-12-30' AS serial, year(d) + CASE WHEN month(d) = 12 THEN 1 ELSE 0 END AS fiscal_year FROM x""",
    "date_range_pick": """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INT) AS b FROM orders),
s AS (SELECT DISTINCT o_orderkey, unnest([a, CASE WHEN day(a) <= 12 THEN make_date(year(a), day(a), month(a)) ELSE a END]) AS s FROM o), e AS (SELECT DISTINCT o_orderkey, unnest([b, CASE WHEN day(b) <= 12 THEN make_date(year(b), day(b), month(b)) ELSE b END]) AS e FROM o),
p AS (SELECT o_orderkey, s, e, e - s AS n FROM s JOIN e USING (o_orderkey) WHERE s <= e),
t AS (SELECT o_orderkey, count(*) FILTER (n BETWEEN 20 AND 45) AS usual, min({'s': s, 'e': e}) FILTER (n BETWEEN 20 AND 45) AS u, count(DISTINCT s) FILTER (date_trunc('month', s) = date_trunc('month', e)) AS same, min(s) FILTER (date_trunc('month', s) = date_trunc('month', e)) AS ss,
  min({'n': n, 's': s, 'e': e}) AS short, min(n) AS n FROM p GROUP BY o_orderkey),
early AS (SELECT o_orderkey, min(e) AS e FROM p JOIN t USING (o_orderkey) WHERE s = ss GROUP BY o_orderkey), ties AS (SELECT o_orderkey, count(*) AS ties FROM p JOIN t USING (o_orderkey) WHERE p.n = t.n GROUP BY o_orderkey)
SELECT o_orderkey, CASE WHEN usual = 1 THEN u.s WHEN same = 1 THEN ss WHEN ties = 1 THEN short.s END AS s, CASE WHEN usual = 1 THEN u.e WHEN same = 1 THEN early.e WHEN ties = 1 THEN short.e END AS e
FROM o LEFT JOIN t USING (o_orderkey) LEFT JOIN early USING (o_orderkey) LEFT JOIN ties USING (o_orderkey)""",
    "json_extract": """SELECT 'doc-' || o_orderkey AS source_file, CAST(o_custkey AS VARCHAR) AS account, (o_orderkey % 10) / 10 AS account_confidence, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_totalprice AS VARCHAR) END AS total, o_orderstatus AS status, (o_orderkey % 10) / 10 AS document_confidence FROM orders""",
    "table_rows_explode": """SELECT 'doc-' || o_orderkey AS source_file, CAST(i + 1 AS VARCHAR) AS line_id, CASE WHEN i < o_orderkey % 4 THEN CAST(o_orderkey % 7 + i AS VARCHAR) END AS qty, CASE WHEN i < o_orderkey % 4 THEN 'kind ' || (o_orderkey % 3 + i) END AS waste FROM orders, range(3) t(i) WHERE i < greatest(o_orderkey % 4, 1)""",
    "search_any_column": """SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%mer#0000000%' OR lower(c_mktsegment) LIKE '%house%'""",
    "stream_monthly_events": """SELECT CAST(date_trunc('month', ts) AS DATE) AS "month", event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL""",
}
ORACLE_SQL |= silver_queries.ORACLE_SQL | curated_queries.ORACLE_SQL | review_queries.ORACLE_SQL | report_queries.ORACLE_SQL | state_queries.ORACLE_SQL
