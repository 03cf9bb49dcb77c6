"""Common table expressions that the DuckDB SQL of several queries shares."""

from __future__ import annotations

from tallyweave.sources.lens import ALLOCATION_SQL, BRONZE_SQL, DECISIONS_SQL, MAPPING_SQL, PERIODS_SQL

__all__ = ["ALLOCATED", "ALLOCATION_SQL", "AUDITED", "BRONZE_SQL", "DECISIONS_SQL", "HISTORY", "INVOICES", "MAPPING_SQL", "MONTHLY", "PERIODS_SQL", "QUALITY", "RESOLVED", "SPLITS", "TEMPLATE", "with_parts"]

RESOLVED = r"""
keyed AS (
  SELECT *, coalesce("end" >= "start", false) AS valid,
    CASE WHEN coalesce("end" >= "start", false) AND coalesce(trim(account_number), '') <> '' AND mapping_status = 'MAPPED'
      THEN lower(concat_ws('|', division, legal_entity, unit_name, supplier_name, account_number, activity_group)) ELSE 'alone|' || row_id END AS seq
  FROM periods
),
spread AS (
  SELECT *, max("end") OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, lag("start") OVER w AS before_start, lead("start") OVER w AS after_start,
    min(CASE WHEN "start" = "end" THEN "start" END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS single
  FROM keyed WINDOW w AS (PARTITION BY seq ORDER BY "start", "end", row_id)
),
flagged AS (
  SELECT *, valid AND (coalesce(reach > "start", false) OR coalesce(before_start = "start", false) OR coalesce("start" = "end" AND reach >= "start", false)
    OR coalesce(after_start < "end", false) OR coalesce(after_start = "start", false) OR coalesce(single <= "end", false)) AS conflict FROM spread
),
neighbours AS (
  SELECT *, lead("start") OVER w AS n_start, lead(conflict) OVER w AS n_conflict, lead(row_id) OVER w AS n_row, lag("end") OVER w AS p_end, lag(conflict) OVER w AS p_conflict, lag(row_id) OVER w AS p_row
  FROM flagged WINDOW w AS (PARTITION BY seq ORDER BY "start", "end", row_id)
),
labelled AS (
  SELECT *, CASE WHEN NOT valid THEN 'Invalid dates' WHEN conflict THEN 'Overlap' WHEN "start" = "end" THEN 'Single day'
    WHEN day("start") = 1 AND day("end") = 1 THEN 'Month-start dates' WHEN "start" = last_day("start") AND "end" = last_day("end") THEN 'Month-end dates'
    WHEN n_row IS NOT NULL THEN CASE WHEN n_conflict THEN 'Overlap' WHEN n_start = "end" THEN 'Shared date' WHEN n_start = "end" + 1 THEN 'Consecutive dates' ELSE 'Gap' END
    WHEN p_row IS NOT NULL THEN CASE WHEN p_conflict THEN 'Overlap' WHEN "start" = p_end OR "start" = p_end + 1 THEN 'Previous invoice pattern' ELSE 'Gap' END
    ELSE 'Insufficient history' END AS date_resolution
  FROM neighbours
),
adjusted AS (
  SELECT *, CASE WHEN date_resolution IN ('Month-start dates', 'Shared date') OR date_resolution = 'Previous invoice pattern' AND "start" = p_end THEN 'End −1 day'
    WHEN date_resolution = 'Month-end dates' THEN 'Start +1 day' ELSE 'None' END AS date_adjustment FROM labelled
),
resolved AS (
  SELECT *, CASE WHEN date_adjustment = 'Start +1 day' THEN "start" + 1 ELSE "start" END AS effective_start, CASE WHEN date_adjustment = 'End −1 day' THEN "end" - 1 ELSE "end" END AS effective_end,
    date_resolution NOT IN ('Single day', 'Month-start dates', 'Month-end dates', 'Shared date', 'Consecutive dates') AS date_provisional,
    CASE WHEN valid AND NOT conflict AND date_resolution NOT IN ('Single day', 'Month-start dates', 'Month-end dates') THEN coalesce(n_row, p_row) || ' (period 1)' END AS resolution_reference
  FROM adjusted
)
"""

SPLITS = """
split_months AS (
  SELECT *, CAST(unnest(generate_series(date_trunc('month', effective_start), effective_end, INTERVAL 1 MONTH)) AS DATE) AS "month"
  FROM resolved WHERE effective_end >= effective_start
),
splits AS (
  SELECT *, greatest(effective_start, "month") AS split_start, least(effective_end, last_day("month")) AS split_end,
    least(effective_end, last_day("month")) - greatest(effective_start, "month") + 1 AS split_days, effective_end - effective_start + 1 AS total_days,
    quantity / (effective_end - effective_start + 1) * (least(effective_end, last_day("month")) - greatest(effective_start, "month") + 1) AS split_quantity
  FROM split_months
),
factors(unit, f) AS (VALUES ('kWh', 1.0::DOUBLE), ('MWh', 1000.0::DOUBLE), ('ton', 720.0::DOUBLE), ('RTH', 0.62::DOUBLE))
"""

MONTHLY = """
billable AS (SELECT * FROM splits WHERE mapping_status IS NULL OR trim(mapping_status) IN ('', 'MAPPED')),
monthly AS (
  SELECT division, legal_entity, unit_name, supplier_name, account_number, activity_group, energy_unit, "month", flow, sum(split_quantity) AS monthly_consumption,
    count(*) AS proration_component_count, count(DISTINCT invoice_id) AS source_file_count, string_agg(DISTINCT invoice_id, '; ' ORDER BY invoice_id) AS source_files, min(row_id) AS first_row_id
  FROM billable GROUP BY ALL
),
month_days AS (
  SELECT division, legal_entity, unit_name, supplier_name, account_number, activity_group, energy_unit, "month", flow, count(DISTINCT day) AS covered
  FROM (SELECT *, unnest(range(day(split_start), day(split_end) + 1)) AS day FROM billable) GROUP BY ALL
),
rolled AS (
  SELECT m.*, concat_ws('|', m.division, m.legal_entity, m.unit_name, m.supplier_name, coalesce(m.account_number, ''), m.activity_group, m.energy_unit, m."month", m.flow) AS row_id
  FROM monthly m
)
"""

ALLOCATED = (
    ALLOCATION_SQL
    + """,
lookup AS (SELECT * EXCLUDE (keys), unnest(list_distinct(keys)) AS k FROM allocation),
fits AS (
  SELECT DISTINCT r.row_id, l.lookup_id, l.fossil, l.renewable, l.nuclear, l.generation, CASE WHEN l_account <> '' THEN 2 ELSE 0 END + CASE WHEN l_activity <> '' THEN 1 ELSE 0 END AS score
  FROM rolled r JOIN lookup l ON lower(r.unit_name || '_' || r.supplier_name || '_' || r."month") = l.k
  WHERE (l_account = '' OR l_account = lower(coalesce(r.account_number, ''))) AND (l_activity = '' OR l_activity = lower(r.activity_group))
    AND (l_account <> '' OR l_activity <> '' OR r.activity_group = 'Electricity')
),
tops AS (SELECT * FROM fits QUALIFY score = max(score) OVER (PARTITION BY row_id)),
chosen AS (
  SELECT row_id, count(*) AS n, min(lookup_id) AS lookup_id, min(fossil) AS fossil, min(renewable) AS renewable, min(nuclear) AS nuclear, min(generation) AS generation FROM tops GROUP BY row_id
),
allocated AS (
  SELECT r.*, CASE WHEN n = 1 THEN c.lookup_id END AS lookup_id, CASE WHEN n = 1 THEN fossil END AS fossil, CASE WHEN n = 1 THEN renewable END AS renewable,
    CASE WHEN n = 1 THEN nuclear END AS nuclear, CASE WHEN n = 1 THEN generation END AS generation,
    CASE WHEN n > 1 THEN 'ambiguous mapping; specify account_number and activity_group' ELSE '' END AS lookup_issue
  FROM rolled r LEFT JOIN chosen c USING (row_id)
)
"""
)

TEMPLATE = """
business AS (
  SELECT *, concat_ws('; ', CASE WHEN energy_unit NOT IN (SELECT unit FROM factors) THEN 'Energy unit: no supported extracted or mapped unit' END,
    'Energy source allocation: ' || CASE WHEN lookup_issue <> '' THEN lookup_issue WHEN fossil IS NULL OR renewable IS NULL OR nuclear IS NULL THEN 'missing allocation percentages'
      WHEN abs(fossil + renewable + nuclear - 1) > 1e-6 THEN 'allocation percentages must total 1 (100%)' END) AS issue
  FROM allocated
),
template AS (
  SELECT b.*, kpi AS energy_kpi, CASE kpi WHEN 'Fossil Fuels' THEN monthly_consumption * fossil WHEN 'Renewable sources' THEN monthly_consumption * renewable
    WHEN 'Nuclear sources' THEN monthly_consumption * nuclear ELSE generation END AS amount
  FROM business b JOIN (VALUES ('Fossil Fuels', false), ('Renewable sources', false), ('Nuclear sources', false), ('Renewable energy production', true),
    ('Consumption of self-generated non-fuel renewable energy', true)) AS k(kpi, electric) ON b.issue = '' AND (NOT electric OR activity_group = 'Electricity')
  UNION ALL SELECT b.*, NULL, NULL FROM business b WHERE issue <> ''
),
gold AS (SELECT t.*, amount * f AS kwh, CASE WHEN activity_group = 'Electricity' THEN generation * f END AS solar FROM template t JOIN factors ON unit = energy_unit WHERE issue = '' AND amount <> 0)
"""

QUALITY = """
unpivoted AS (
  SELECT invoice_id, line_id, 0 AS pos, 'account_number' AS field, account_number AS value, account_number_confidence AS confidence, 'critical' AS criticality, 0.8::DOUBLE AS threshold FROM bronze
  UNION ALL SELECT invoice_id, line_id, 1, 'supplier_name', supplier_name, supplier_name_confidence, 'optional', 0.6::DOUBLE FROM bronze
  UNION ALL SELECT invoice_id, line_id, 2, 'energy_unit', energy_unit, energy_unit_confidence, 'noncritical', 0.3::DOUBLE FROM bronze
  UNION ALL SELECT invoice_id, line_id, 3, 'quantity', quantity, quantity_confidence, 'critical', 0.8::DOUBLE FROM bronze
),
quality AS (
  SELECT *, CASE WHEN blank AND confidence > 0.9 THEN 'AUTO_RESOLVED' WHEN blank AND criticality = 'critical' THEN 'BLOCKED' WHEN blank THEN 'WARNING'
      WHEN confidence < threshold AND criticality = 'critical' THEN 'REVIEW' WHEN confidence < threshold THEN 'WARNING' ELSE 'PASS' END AS field_status,
    CASE WHEN blank AND confidence > 0.9 THEN 'BLANK_HIGH_CONFIDENCE' WHEN blank AND criticality = 'critical' THEN 'MISSING_REQUIRED' WHEN blank THEN 'MISSING_OPTIONAL'
      WHEN confidence < threshold THEN 'LOW_CONFIDENCE' ELSE 'PASS' END AS reason_code
  FROM (SELECT *, coalesce(trim(value), '') = '' AS blank FROM unpivoted)
),
ranked AS (SELECT *, list_position(['BLOCKED', 'REVIEW', 'WARNING', 'AUTO_RESOLVED'], field_status) AS r FROM quality),
reasons AS (SELECT line_id, string_agg(reason_code, ';' ORDER BY r, pos) AS codes FROM (SELECT line_id, reason_code, min(r) AS r, min_by(pos, r * 10 + pos) AS pos FROM ranked WHERE field_status <> 'PASS' GROUP BY ALL) GROUP BY line_id),
summary AS (
  SELECT invoice_id, q.line_id, min(CASE WHEN field_status <> 'PASS' THEN r END) AS worst, count(*) FILTER (field_status IN ('BLOCKED', 'REVIEW')) AS review_issue_count,
    count(*) FILTER (field_status IN ('BLOCKED', 'REVIEW') AND criticality = 'critical') AS critical_issue_count, min(confidence) FILTER (criticality = 'critical') AS min_critical_confidence,
    coalesce(any_value(codes), '') AS review_reason_codes,
    coalesce(string_agg(field, ';' ORDER BY r, pos) FILTER (field_status IN ('BLOCKED', 'REVIEW')), '') AS failed_fields,
    coalesce(string_agg(field, ';' ORDER BY r, pos) FILTER (reason_code = 'LOW_CONFIDENCE'), '') AS low_confidence_fields,
    coalesce(string_agg(field, ';' ORDER BY r, pos) FILTER (reason_code = 'MISSING_REQUIRED'), '') AS missing_required_fields,
    coalesce(string_agg(field, ';' ORDER BY r, pos) FILTER (field_status = 'AUTO_RESOLVED'), '') AS auto_resolved_fields
  FROM ranked q LEFT JOIN reasons USING (line_id) GROUP BY ALL
),
summaries AS (
  SELECT * EXCLUDE (worst), CASE worst WHEN 1 THEN 'BLOCKED' WHEN 2 THEN 'REVIEW_REQUIRED' WHEN 3 THEN 'OPTIONAL_FIELD_WARNING' WHEN 4 THEN 'AUTO_RESOLVED_WITH_WARNING' ELSE 'AUTO_APPROVED' END AS review_status,
    CASE WHEN worst = 1 THEN 'HIGH' WHEN worst = 2 AND critical_issue_count > 0 THEN 'HIGH' WHEN worst = 2 THEN 'MEDIUM' WHEN worst IN (3, 4) THEN 'LOW' ELSE 'NONE' END AS review_severity,
    coalesce(worst <= 2, false) AS review_required
  FROM summary
),
issues AS (
  SELECT trim(regexp_replace(concat_ws('_', invoice_id, line_id, field, reason_code), '[^A-Za-z0-9]', '_', 'g'), '_') AS issue_id, invoice_id, line_id, field AS field_name, reason_code AS issue_type,
    CASE WHEN field_status = 'BLOCKED' OR criticality = 'critical' THEN 'HIGH' ELSE 'MEDIUM' END AS severity, value AS ocr_value
  FROM quality WHERE field_status IN ('BLOCKED', 'REVIEW')
),
old AS (
  SELECT CASE length(issue_id) % 3 WHEN 0 THEN issue_id WHEN 1 THEN 'old_' || issue_id ELSE 'override_' || issue_id END AS issue_id, invoice_id, line_id, field_name, ocr_value AS original_value,
    CASE WHEN severity = 'HIGH' THEN 'APPROVED' ELSE 'REJECTED' END AS review_decision, issue_type AS corrected_value FROM issues
)
"""

INVOICES = """
invoices AS (
  SELECT * EXCLUDE (account_number, activity_group), CASE WHEN supplier_key % 11 = 7 THEN 'ACC-none' ELSE account_number END AS account_number,
    CASE WHEN part_key % 5 <> 0 THEN activity_group END AS activity_group FROM periods
)
"""

HISTORY = """
history AS (
  SELECT row_id, division, upper(legal_entity) AS legal_entity, CASE WHEN part_key % 50 = 49 THEN ' ' ELSE replace(unit_name, '-', '_') END AS unit_name,
    CASE WHEN part_key % 50 = 48 THEN NULL ELSE activity_group END AS kpi, energy_unit, CASE WHEN part_key % 50 = 47 THEN 'NaN'::DOUBLE ELSE quantity END AS amount,
    "start" AS date, CASE WHEN part_key % 50 = 46 THEN 'x' ELSE '' END AS issue FROM periods
),
checked AS (
  SELECT *, CASE WHEN kpi IS NULL THEN 'missing KPI component' WHEN energy_unit = 'mmBTU' THEN 'unsupported energy unit' WHEN isnan(amount) THEN 'amount is not a finite number'
    WHEN trim(unit_name) = '' THEN 'missing facility' WHEN issue <> '' THEN 'business mapping issue' END AS reject_reason FROM history
),
facts AS (
  SELECT lower(division) AS d, lower(legal_entity) AS l, replace(lower(unit_name), '_', ' ') AS u, kpi, CAST(date_trunc('month', date) AS DATE) AS m,
    sum(amount * CASE energy_unit WHEN 'kWh' THEN 1.0::DOUBLE WHEN 'MWh' THEN 1000.0::DOUBLE WHEN 'ton' THEN 720.0::DOUBLE ELSE 0.62::DOUBLE END) AS kwh
  FROM checked WHERE reject_reason IS NULL GROUP BY ALL
),
facts_key AS (SELECT replace(d, '_', ' ') AS d, replace(l, '_', ' ') AS l, u, kpi, m, kwh FROM facts),
ends AS (SELECT date_trunc('month', min("start")) AS lo, date_trunc('month', max("start")) AS hi FROM periods),
grid AS (
  SELECT division, legal_entity, unit_name, kpi, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS "month" FROM (SELECT DISTINCT division, legal_entity, unit_name, activity_group AS kpi FROM periods), ends
),
pairs AS (
  SELECT g.*, a.kwh AS current, b.kwh AS previous
  FROM grid g LEFT JOIN facts_key a ON a.d = lower(division) AND a.l = replace(lower(legal_entity), '_', ' ') AND a.u = replace(lower(unit_name), '-', ' ') AND a.kpi = g.kpi AND a.m = g."month"
  LEFT JOIN facts_key b ON b.d = lower(division) AND b.l = replace(lower(legal_entity), '_', ' ') AND b.u = replace(lower(unit_name), '-', ' ') AND b.kpi = g.kpi AND b.m = g."month" - INTERVAL 1 YEAR
),
cells AS (
  SELECT *, CASE WHEN current IS NULL OR previous IS NULL THEN NULL WHEN previous = 0 AND current = 0 THEN 0 WHEN previous = 0 THEN 'Infinity'::DOUBLE ELSE (current - previous) / abs(previous) END AS difference FROM pairs
),
classed AS (
  SELECT *, CASE WHEN difference IS NULL THEN 'missing' WHEN abs(difference) <= 0.1 THEN 'within_10' WHEN abs(difference) <= 0.3 THEN 'within_30' WHEN abs(difference) <= 0.5 THEN 'within_50' ELSE 'over_50' END AS class FROM cells
)
"""

AUDITED = """
planted AS (
  SELECT *, unnest(CASE WHEN part_key % 89 = 5 THEN [1, 2] ELSE [1] END) AS i FROM splits WHERE NOT (part_key % 97 = 3 AND CASE WHEN part_key % 101 = 6 THEN "month" + INTERVAL 40 MONTH ELSE "month" END = date_trunc('month', effective_start))
),
lines AS (SELECT row_id AS period_id, CASE WHEN part_key % 101 = 6 THEN CAST("month" + INTERVAL 40 MONTH AS DATE) ELSE "month" END AS "month", split_start, split_end, split_days, CASE WHEN part_key % 83 = 7 THEN split_quantity + 1 ELSE split_quantity END AS q FROM planted),
p AS (
  SELECT row_id AS period_id, division, legal_entity, unit_name, account_number, activity_group, mapping_status, effective_start AS s, effective_end AS e, quantity, f, coalesce(effective_end >= effective_start, false) AS ok
  FROM resolved LEFT JOIN factors ON unit = energy_unit
),
sums AS (SELECT period_id, sum(q) AS allocated, count(*) AS n, count(DISTINCT "month") AS months, min("month") AS first, max("month") AS last FROM lines GROUP BY period_id),
cases AS (
  SELECT 'Missing mapping' AS issue, strftime(s, '%Y-%m') AS "month", period_id FROM p WHERE account_number IS NULL OR mapping_status <> 'MAPPED'
  UNION SELECT 'Invalid invoice inputs', strftime(s, '%Y-%m'), period_id FROM p WHERE NOT ok
  UNION SELECT 'Unsupported energy unit', strftime(s, '%Y-%m'), period_id FROM p WHERE f IS NULL
  UNION SELECT 'Invoice reconciliation', strftime(s, '%Y-%m'), period_id FROM p LEFT JOIN sums USING (period_id)
    WHERE ok AND (n IS NULL OR abs(allocated - quantity) > greatest(0.01 / coalesce(f, 1), 1e-10 * greatest(abs(allocated), abs(quantity))))
  UNION SELECT 'Missing or repeated allocation', strftime(s, '%Y-%m'), period_id FROM p LEFT JOIN sums USING (period_id)
    WHERE ok AND (n IS NULL OR n <> datediff('month', s, e) + 1 OR months <> datediff('month', s, e) + 1 OR first <> date_trunc('month', s) OR last <> date_trunc('month', e))
  UNION SELECT 'Invalid allocation month', strftime("month", '%Y-%m'), period_id FROM p JOIN lines USING (period_id) WHERE ok AND "month" > e
  UNION SELECT 'Allocation calculation', strftime("month", '%Y-%m'), period_id FROM p JOIN lines USING (period_id)
    WHERE ok AND "month" <= e AND abs(q - quantity / (e - s + 1) * split_days) > greatest(0.01 / coalesce(f, 1), 1e-10 * greatest(abs(q), abs(quantity / (e - s + 1) * split_days)))
)
"""


def with_parts(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"
