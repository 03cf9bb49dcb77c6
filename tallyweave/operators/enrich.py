"""Enrichment by lookup tables: a cascade of keys with arbitration, and the most specific match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import is_blank, lookup_text, own_columns

METHODS = ("ACCOUNT", "UNIT_ALIAS", "LEGAL_ENTITY_ALIAS")
SPLIT = r"[;,\n\r|]+"
# What a reviewer is told.
MESSAGES = {
    "MAPPED": "",
    "UNMAPPED": "No matching account mapping. Update the mapping workbook or correct the invoice details.",
    "AMBIGUOUS": "Multiple mapping rows match. Resolve the account or duplicate mapping rows.",
    "CONFLICT": "The account or alias conflicts with the selected energy type.",
    "INCOMPLETE": "The mapping row needs an account number and activity group.",
}


def mapping_cascade(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """rows with mapped_* columns, mapping_status, mapping_method and mapping_message.

    rows have row_id, account_number, unit_name, legal_entity, activity_group; mapping has map_id, account_number,
    activity_group, division, ocr_unit_name_list, ocr_legal_entity_name_list. Keys are tried as account, unit alias, legal-entity
    alias; the first with any candidate decides. There the row's activity must agree and one candidate must remain.
    Keys are shuffled, not broadcast, unless Spark finds the mapping small; candidates are counted before they meet a row, and looked up once
    for all rows with the same keys and activity.
    """
    key = lambda c: lookup_text(F.col(c))
    aliases = lambda c: F.transform(F.split(F.coalesce(c, F.lit("")), SPLIT), lookup_text)
    keyed = F.array(
        F.struct(F.lit(1).alias("priority"), F.array(key("account_number")).alias("keys")),
        F.struct(F.lit(2).alias("priority"), aliases(F.col("ocr_unit_name_list")).alias("keys")),
        F.struct(F.lit(3).alias("priority"), aliases(F.col("ocr_legal_entity_name_list")).alias("keys")),
    )
    table = mapping.select("map_id", F.col("account_number").alias("m_account"), F.col("activity_group").alias("m_activity"), F.col("division").alias("m_division"), F.explode(keyed).alias("k"))
    table = table.select("*", "k.priority", F.explode(F.array_distinct("k.keys")).alias("key")).where(~is_blank(F.col("key"))).drop("k")
    # per key: how many rows, and for each activity how many and the only one
    act = F.coalesce(lookup_text(F.col("m_activity")), F.lit(""))
    one = F.struct("map_id", "m_account", "m_activity", "m_division")
    groups = table.groupBy("priority", "key", act.alias("act")).agg(F.count("*").alias("n"), F.min(one).alias("one"))
    groups = groups.groupBy("priority", "key").agg(F.sum("n").alias("n"), F.min("one").alias("one"), F.map_from_entries(F.collect_list(F.struct("act", F.struct("n", "one")))).alias("by_act"))
    names = ("account_number", "unit_name", "legal_entity")
    asked = {"_tw_act": key("activity_group")} | {f"_tw_key_{i}": key(c) for i, c in enumerate(names)}
    rows = rows.select(*(c for c in own_columns(rows) if c != "mapping_status"), *(F.coalesce(c, F.lit("")).alias(name) for name, c in asked.items()))
    # rows that ask alike are answered once: a row then moves once, to its answer
    wanted = rows.select(*asked).distinct()
    wanted = wanted.select(*asked, F.explode(F.array(*(F.struct(F.lit(i + 1).alias("priority"), F.col(f"_tw_key_{i}").alias("key")) for i in range(len(names))))).alias("k"))
    hits = wanted.select(*asked, "k.*").where(~is_blank(F.col("key"))).join(groups, ["priority", "key"])
    plain, own = is_blank(F.col("_tw_act")), F.try_element_at("by_act", F.col("_tw_act"))
    answer = F.struct("priority", F.when(plain, F.col("n")).otherwise(F.coalesce(own["n"], F.lit(0))).alias("n"), F.when(plain, F.col("one")).otherwise(own["one"]).alias("got"))
    best = hits.groupBy(*asked).agg(F.min(answer).alias("b"))
    n, got = F.col("b.n"), F.col("b.got")
    status = F.when(~plain & (n == 0), "CONFLICT").when(n > 1, "AMBIGUOUS").when(is_blank(got["m_account"]) | is_blank(got["m_activity"]), "INCOMPLETE").otherwise("MAPPED")
    best = best.select(*asked, status.alias("mapping_status"), F.element_at(F.array(*map(F.lit, METHODS)), F.col("b.priority")).alias("mapping_method"), got.alias("got"))
    out = rows.join(best, list(asked), "left").drop(*asked).withColumn("mapping_status", F.coalesce("mapping_status", F.lit("UNMAPPED")))
    hit = F.col("mapping_status") == "MAPPED"
    messages = F.create_map(*(F.lit(x) for kv in MESSAGES.items() for x in kv))
    mapped = {f"mapped_{k}": F.when(hit, F.col(f"got.{c}")) for k, c in (("id", "map_id"), ("account_number", "m_account"), ("activity_group", "m_activity"), ("division", "m_division"))}
    return out.withColumns(mapped | {"mapping_method": F.coalesce("mapping_method", F.lit("")), "mapping_message": F.element_at(messages, F.col("mapping_status"))}).drop("got")


def manual_mapping(rows: DataFrame, mapping: DataFrame, columns: list[str]) -> DataFrame:
    """rows (row_id) with mapping_status and mapped_id: all non-blank columns must agree with exactly one mapping row.

    Mapping rows are counted once for each combination of columns that rows leave blank, so that every match is an equi join.
    """
    blank = F.concat(*(F.when(is_blank(F.col(c)), "0").otherwise("1") for c in columns))
    keyed = rows.select("row_id", blank.alias("mask"), *(lookup_text(F.col(c)).alias(c) for c in columns))
    counted = None
    for i in range(1, 1 << len(columns)):
        mask = f"{i:0{len(columns)}b}"
        use = [c for c, m in zip(columns, mask, strict=True) if m == "1"]
        part = mapping.select("map_id", *(lookup_text(F.col(c)).alias(c) for c in use)).groupBy(*use).agg(F.count("*").alias("n"), F.min("map_id").alias("one"))
        part = part.select(F.lit(mask).alias("mask"), F.concat_ws("\u0001", *use).alias("key"), "n", "one")
        counted = part if counted is None else counted.union(part)
    key = F.concat_ws("\u0001", *(F.when(~is_blank(F.col(c)), F.col(c)) for c in columns))
    out = keyed.withColumn("key", key).join(counted, ["mask", "key"], "left")
    status = F.when(F.col("n").isNull(), "UNMAPPED").when(F.col("n") > 1, "AMBIGUOUS").otherwise("MAPPED")
    return out.select("row_id", status.alias("mapping_status"), F.when(F.col("n") == 1, F.col("one")).alias("mapped_id"))


def specific_lookup(rows: DataFrame, lookup: DataFrame, values: list[str]) -> DataFrame:
    """rows (row_id, key, account_number, activity_group) with the lookup's values of the most specific match, and lookup_issue.

    lookup has lookup_id, keys (array), account_number, activity_group, values. A filled account or activity must agree and
    counts two and one; a row with neither serves electricity only. A tie at the top is ambiguous and gives no values.
    Lookup rows are reduced to one for each key, account and activity, and whether it is the only one, before they meet a row: a key that many
    of them share costs a row two lookups, of its account and of none. They are shuffled, never broadcast: Spark sizes what an explode gives, such
    as of keys or months, like what it takes.
    """
    l_account, l_activity = lookup_text(F.col("account_number")), F.regexp_replace(lookup_text(F.col("activity_group")), "^purchased ", "")
    table = lookup.select("lookup_id", *values, F.coalesce(l_account, F.lit("")).alias("_tw_account"), F.coalesce(l_activity, F.lit("")).alias("_tw_activity"), F.explode(F.array_distinct(F.transform("keys", lookup_text))).alias("_tw_key"))
    one, id_ = F.struct("lookup_id", *values), F.struct("lookup_id")
    found = table.groupBy("_tw_key", "_tw_account", "_tw_activity").agg(F.min(one).alias("one"), (F.min(id_) == F.max(id_)).alias("only"))
    # a score stands for one account and activity: what a row may take lies in two maps by activity
    found = found.groupBy("_tw_key", "_tw_account").agg(F.map_from_entries(F.collect_list(F.struct("_tw_activity", F.struct("only", "one")))).alias("by"))
    general = found.where("_tw_account = ''").select("_tw_key", F.col("by").alias("_tw_general"))
    special = found.where("_tw_account <> ''").select("_tw_key", "_tw_account", F.col("by").alias("_tw_special"))
    account, activity = (F.coalesce(lookup_text(F.col(c)), F.lit("")) for c in ("account_number", "activity_group"))
    asked = rows.withColumns({"_tw_key": lookup_text(F.col("key")), "_tw_account": account, "_tw_activity": activity})
    hits = asked.join(special.hint("merge"), ["_tw_key", "_tw_account"], "left").join(general.hint("merge"), "_tw_key", "left")
    own = F.when(F.col("_tw_activity") != "", F.col("_tw_activity"))
    plain = F.when(F.col("_tw_activity") == "electricity", "")
    best = F.coalesce(*(F.try_element_at(by, act) for by, act in (("_tw_special", own), ("_tw_special", F.lit("")), ("_tw_general", own), ("_tw_general", plain))))
    # one row for one, so that a filter on what was found is not pushed below it and does not look it up anew for each mention
    hits = hits.select("*", F.inline(F.array(F.struct(best.alias("_tw_best")))))
    got = F.when(F.col("_tw_best.only"), F.col("_tw_best.one"))
    issue = F.when(~F.col("_tw_best.only"), "ambiguous mapping; specify account_number and activity_group").otherwise("")
    return hits.select(*rows.columns, *(got[v].alias(v) for v in ("lookup_id", *values)), issue.alias("lookup_issue"))


def first_match(rows: DataFrame, lookup: DataFrame, values: list[str], order: str, key: str = "lookup_key") -> DataFrame:
    """rows with the values of the first lookup row of their key; null where there is none. Only one lookup row a key meets the rows."""
    first = lookup.groupBy(key).agg(F.min_by(F.struct(*values), order).alias("_tw_first"))
    return rows.join(first, key, "left").select(*rows.columns, *(F.col(f"_tw_first.{v}").alias(v) for v in values))
