"""Bronze: fields from nested JSON documents, table lines, and marking of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import mojibake_repaired, nullif_blank, own_columns

PAYLOAD = "struct<valueString:string,valueNumber:string,valueDate:string,valueCurrency:string,content:string,confidence:double>"
LINE_ITEMS = f"array<struct<valueObject:map<string,{PAYLOAD}>>>"
FIELD = PAYLOAD[:-1] + f",valueArray:{LINE_ITEMS}>"
DOCUMENT = f"struct<sharepoint_link:string,document_confidence:double,status:string,createdDateTime:string,lastUpdatedDateTime:string,apiVersion:string,modelId:string,fields:map<string,{FIELD}>>"
VALUES = ("valueString", "valueNumber", "valueDate", "valueCurrency", "content")


def parsed(documents: DataFrame, json_col: str = "json") -> DataFrame:
    """documents with doc, the parsed root; where fields is absent the root itself is the map of fields."""
    root = F.from_json(json_col, DOCUMENT)
    bare = F.from_json(json_col, f"map<string,{FIELD}>")
    return documents.withColumn("doc", root).withColumn("fields", F.coalesce("doc.fields", bare))


#: What a document says of itself, beside its fields.
METADATA = ("sharepoint_link", "document_confidence", "status", "createdDateTime", "lastUpdatedDateTime", "apiVersion", "modelId")


def with_metadata(documents: DataFrame) -> DataFrame:
    """parsed() documents with a column for their link and each thing they say of themselves; null where they say nothing."""
    return documents.withColumns({c: F.col("doc")[c] for c in METADATA})


def value_of(payload: Column) -> Column:
    """The first value of a payload that is not blank, with wrongly decoded text put right."""
    return mojibake_repaired(F.coalesce(*(nullif_blank(payload[v]) for v in VALUES)))


def picked(fields: Column, sources: list[str]) -> Column:
    """The payload of the first source name that exists, even if its value is blank."""
    out = F.when(F.map_contains_key(fields, sources[0]), fields[sources[0]])
    for s in sources[1:]:
        out = out.when(F.map_contains_key(fields, s), fields[s])
    return out


def extracted(documents: DataFrame, mapping: dict[str, list[str]]) -> DataFrame:
    """A column and a confidence for each mapped field."""
    out = {}
    for name, sources in mapping.items():
        p = picked(F.col("fields"), sources)
        out |= {name: value_of(p), f"{name}_confidence": p["confidence"]}
    return documents.withColumns(out)


def table_lines(documents: DataFrame, table: str, mapping: dict[str, list[str]]) -> DataFrame:
    """One row a line item with line_id from 1; documents without any are one line. Columns of the items replace the document's."""
    own_columns(documents)
    items = F.filter(F.col("fields")[table]["valueArray"], lambda x: x["valueObject"].isNotNull())
    rows = documents.select("*", F.posexplode_outer(items).alias("_tw_pos", "_tw_item")).withColumn("line_id", (F.coalesce("_tw_pos", F.lit(0)) + 1).cast("string"))
    return rows.withColumns({name: value_of(picked(F.col("_tw_item.valueObject"), sources)) for name, sources in mapping.items()}).drop("_tw_pos", "_tw_item")


def mark_duplicates(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (content_hash, business_key) with duplicate_status, duplicate_of and match_type.

    Where equal hashes have equal business keys a group is one key: the first in order is PRIMARY. Rows without a key
    are PRIMARY and match nothing. Only the first of each group of two or more meets its rows again, so no group is
    gathered or sorted; a row whose order equals the first's is a primary too. Rows without a key are a group that is told apart after it is
    counted: a filter on the key would be pushed down and have keys that are computed made several times over.
    """
    kept = own_columns(rows)
    rows = rows.withColumn("_tw_group", F.coalesce(nullif_blank(F.col("business_key")), nullif_blank(F.col("content_hash")), F.lit("")))
    place = F.struct(*order)
    groups = rows.groupBy("_tw_group").agg(F.count("*").alias("_tw_n"), F.max(F.length("_tw_group")).alias("_tw_keyed"), F.min(F.struct(place.alias("at"), F.col("content_hash").alias("hash"))).alias("_tw_first"))
    out = rows.join(groups.where("_tw_n > 1 and _tw_keyed > 0").drop("_tw_n", "_tw_keyed"), "_tw_group", "left")
    dup = F.coalesce(place != F.col("_tw_first.at"), F.lit(False))
    kind = F.when(dup, F.when(F.col("content_hash") == F.col("_tw_first.hash"), "CONTENT_HASH").otherwise("BUSINESS_KEY"))
    marks = {"duplicate_status": F.when(dup, "DUPLICATE").otherwise("PRIMARY"), "duplicate_of": F.when(dup, F.col(f"_tw_first.at.{order[0]}")), "match_type": kind}
    return out.withColumns(marks).select(*(c for c in kept if c not in marks), *marks)


def split_duplicates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    dup = F.coalesce(F.upper("duplicate_status") == "DUPLICATE", F.lit(False))
    return rows.where(~dup), rows.where(dup)
