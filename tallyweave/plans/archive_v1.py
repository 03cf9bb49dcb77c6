"""The warehouse's first version of mapping and allocation, as Spark SQL. Its rules differ from today's: see gold_v1."""

from __future__ import annotations

from pyspark.sql import DataFrame


def best_mapping(records: DataFrame, mapping: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The first mapping by priority (account, unit, legal entity) and id, and whether several tie at that priority, with the columns to keep. Rows with the same three
    are looked up once."""
    more = "".join(f", r.`{c}`" for c in keep)
    return records.sparkSession.sql(
        f"""
        WITH m AS (SELECT *, nullif(lower(trim(account_number)), '') a, nullif(lower(trim(unit_name)), '') u, nullif(lower(trim(legal_entity)), '') l
                   FROM {{mapping}} WHERE coalesce(active, 'Yes') IN ('Yes', 'Y', '1')),
        counts AS (
          SELECT 1 p, a k, min(mapping_id) mapping_id, count(*) n FROM m WHERE a IS NOT NULL GROUP BY a UNION ALL
          SELECT 2 p, u k, min(mapping_id) mapping_id, count(*) n FROM m WHERE u IS NOT NULL GROUP BY u UNION ALL
          SELECT 3 p, l k, min(mapping_id) mapping_id, count(*) n FROM m WHERE l IS NOT NULL GROUP BY l
        ),
        asked AS (SELECT DISTINCT lower(trim(account_number)) a, lower(trim(unit_name)) u, lower(trim(legal_entity)) l FROM {{records}}),
        keys AS (SELECT * FROM asked LATERAL VIEW stack(3, 1, a, 2, u, 3, l) x AS p, k),
        best AS (SELECT a, u, l, min(struct(p, mapping_id, n)) b FROM keys JOIN counts USING (p, k) GROUP BY a, u, l)
        SELECT r.row_id, b.mapping_id, element_at(array('account_number', 'unit_name', 'legal_entity'), b.p) match_method, b.p match_priority,
          coalesce(b.n, 0) same_priority_candidate_count, CASE WHEN b.mapping_id IS NULL OR b.n > 1 THEN 1 ELSE 0 END mapping_needs_review{more}
        FROM {{records}} r LEFT JOIN best ON best.a <=> lower(trim(r.account_number)) AND best.u <=> lower(trim(r.unit_name)) AND best.l <=> lower(trim(r.legal_entity))
        """,
        records=records,
        mapping=mapping,
    )


# Fixed values, in the SQL below: what activities and shares are called, and the text for a missing contract.
def gold_v1(enriched: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a positive share, with the columns to keep. A missing allocation counts as all fossil, and amounts are not multiplied by shares."""
    more = "".join(f", `{c}`" for c in keep)
    return enriched.sparkSession.sql(
        f"""
        SELECT row_id, 'Actual' data_quality,
          CASE lower(coalesce(activity_group, '')) WHEN 'electricity' THEN 'Purchased electricity' WHEN 'steam' THEN 'Purchased steam'
            WHEN 'cooling' THEN 'Purchased cool' WHEN 'heating' THEN 'Purchased heat' ELSE coalesce(activity_group, 'Purchased electricity') END kpi_component,
          energy_kpi, allocation_pct, amount, coalesce(contractual_instruments, 'No contractual instrument - emission factors unknown') instrument{more}
        FROM {{e}} LATERAL VIEW stack(3, 'Fossil Fuels', coalesce(fossil, 1.0D), 'Renewable sources', coalesce(renewable, 0.0D),
          'Nuclear sources', coalesce(nuclear, 0.0D)) s AS energy_kpi, allocation_pct
        WHERE allocation_pct > 0
        """,
        e=enriched,
    )


def invalid_allocations(allocation: DataFrame) -> DataFrame:
    return allocation.selectExpr("*", "fossil + renewable + nuclear as total_pct").where("total_pct not between 0.99 and 1.01")


def quantities(ocr: DataFrame) -> DataFrame:
    """One row a quantity that is not blank; the sixth is in the second unit."""
    return ocr.sparkSession.sql(
        """
        SELECT * FROM {o} LATERAL VIEW stack(6, 'quantity_1', quantity_1, quantity_unit_1, 'quantity_2', quantity_2, quantity_unit_1, 'quantity_3', quantity_3, quantity_unit_1,
          'quantity_4', quantity_4, quantity_unit_1, 'quantity_5', quantity_5, quantity_unit_1, 'quantity_6', quantity_6, quantity_unit_2) s AS quantity_column, quantity_value, quantity_unit
        WHERE trim(quantity_value) <> ''
        """,
        o=ocr,
    )


def selected_quantity(ocr: DataFrame, selection: DataFrame) -> DataFrame:
    """The quantity and unit of each row: the first ones, unless a selection names others."""
    names = ", ".join(f"'quantity_{i}', o.quantity_{i}" for i in range(1, 7))
    return ocr.sparkSession.sql(
        f"""
        SELECT o.ocr_record_id, coalesce(q.selected_quantity_column, 'quantity_1') selected_quantity_column, element_at(map({names}), coalesce(q.selected_quantity_column, 'quantity_1')) amount,
          element_at(map('quantity_unit_1', o.quantity_unit_1, 'quantity_unit_2', o.quantity_unit_2), coalesce(q.selected_quantity_unit_column, 'quantity_unit_1')) energy_unit, q.reason
        FROM {{o}} o LEFT JOIN {{q}} q ON q.ocr_record_id = o.ocr_record_id
        """,
        o=ocr,
        q=selection,
    )


def enriched(ocr: DataFrame, mapping: DataFrame, division: DataFrame, contracts: DataFrame) -> DataFrame:
    """Rows with their best mapping, division and contract. A division serves an entity by unit or by facility id, so rows can multiply.

    A row asks by both ways in one equi join, so it is never met by all divisions of its entity, and nothing before it is made twice. A row that no
    unit serves stays without a division only if no facility id serves it either; a division that serves a row both ways counts once.
    """
    best = best_mapping(ocr.withColumnRenamed("ocr_record_id", "row_id"), mapping, ("legal_entity", "unit_name", "supplier", "account_number"))
    return ocr.sparkSession.sql(
        """
        WITH m AS (
          SELECT b.row_id ocr_record_id, b.mapping_id, b.mapping_needs_review, coalesce(m.legal_entity, b.legal_entity) legal_entity, coalesce(m.unit_name, b.unit_name) unit_name, coalesce(m.supplier_name, b.supplier) supplier_name,
            coalesce(m.account_number, b.account_number) account_number, m.division, m.activity_group, m.facility_identifier
          FROM {b} b LEFT JOIN {m} m ON m.mapping_id = b.mapping_id
        ),
        keyed AS (SELECT *, lower(trim(legal_entity)) e, lower(trim(unit_name)) u, lower(trim(facility_identifier)) f FROM m),
        da AS (
          SELECT division own_division, legal_entity own_entity, unit_name own_unit, lower(trim(legal_entity)) e, nullif(lower(trim(unit_name)), '') u, nullif(lower(trim(facility_identifier)), '') f FROM {da}
        ),
        served AS (SELECT DISTINCT e, f FROM da WHERE e IS NOT NULL AND f IS NOT NULL),
        ways AS (SELECT *, 'unit' way, u own_key FROM da WHERE u IS NOT NULL UNION ALL SELECT *, 'facility' way, f own_key FROM da WHERE f IS NOT NULL),
        asked AS (SELECT * FROM keyed LATERAL VIEW stack(2, 'unit', u, 'facility', f) x AS way, own_key),
        d AS (
          SELECT a.*, w.own_division, w.own_entity, w.own_unit FROM asked a LEFT JOIN ways w ON w.e = a.e AND w.way = a.way AND w.own_key = a.own_key LEFT JOIN served s ON s.e = a.e AND s.f = a.f
          WHERE CASE WHEN w.e IS NULL THEN a.way = 'unit' AND s.e IS NULL ELSE a.way = 'unit' OR NOT coalesce(w.u = a.u, false) END
        ),
        named AS (SELECT *, coalesce(own_entity, legal_entity) d_entity, coalesce(own_unit, unit_name) d_unit FROM d)
        SELECT d.ocr_record_id, d.mapping_id, d.mapping_needs_review, d.account_number, coalesce(d.own_division, d.division) division, d.activity_group, c.contract_id, d.d_entity legal_entity, d.d_unit unit_name
        FROM named d LEFT JOIN {c} c ON lower(trim(c.legal_entity)) = lower(trim(d.d_entity)) AND lower(trim(c.unit_name)) = lower(trim(d.d_unit)) AND lower(trim(c.supplier_name)) = lower(trim(d.supplier_name))
        """,
        b=best,
        m=mapping,
        da=division,
        c=contracts,
    )


def unmatched(rows: DataFrame) -> DataFrame:
    return rows.where("mapping_id is null or mapping_needs_review = 1")


def contracts_missing(rows: DataFrame) -> DataFrame:
    """Electricity without a contract."""
    return rows.where("lower(coalesce(activity_group, '')) = 'electricity' and contract_id is null")


def uploadable(rows: DataFrame) -> DataFrame:
    return rows.where("coalesce(mapping_needs_review, 0) = 0")


# The columns of an upload, in its order, and what each is of a row of gold_v1(); all that is uploaded was purchased.
UPLOAD = {
    "Data quality": "data_quality",
    "KPI Component": "kpi_component",
    "Division": "division",
    "Legal Entity Name": "legal_entity",
    "Unit": "unit_name",
    "Consumption start date": "consumption_start",
    "Consumption end date": "consumption_end",
    "Transaction Date": "transaction_date",
    "Energy KPI": "energy_kpi",
    "Energy Type": "energy_type",
    "Purchased or acquired": "'Purchased'",
    "Amount of energy consumed": "amount",
    "Energy Unit": "energy_unit",
    "Contractual instrument used": "instrument",
}


def upload(gold: DataFrame) -> DataFrame:
    """The columns of an upload, of the rows that neither their mapping nor their extraction sends to a reviewer; a blank flag sends none."""
    return uploadable(gold).where("coalesce(ocr_needs_review, 0) = 0").selectExpr(*(f"{c} AS `{name}`" for name, c in UPLOAD.items()))


def broken_constraints(allocation: DataFrame, unique: list[str], key: str) -> DataFrame:
    """(id, constraint) of shares outside 0 to 1, of totals outside 0.99 to 1.01, and of keys that repeat."""
    rows = [allocation.where(f"{c} not between 0 and 1").selectExpr(f"cast({key} as string) id", f"'{c} between 0 and 1' constraint") for c in ("fossil", "renewable", "nuclear")]
    rows.append(invalid_allocations(allocation).selectExpr(f"cast({key} as string) id", "'shares total 1' constraint"))
    names = ", ".join(unique)
    rows.append(allocation.groupBy(*unique).count().where("count > 1").selectExpr(f"lower(concat_ws('|', {names})) id", f"'unique {names}' constraint"))
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out
