"""Scans of documents, all-text tables, lookup tables and their provenance."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.text import first_present, is_blank, lookup_text
from tallyweave.operators.silver import ACTIVITY_GROUPS

# The columns that a mapping table must have, and other names that such tables use for some.
MAPPING_COLUMNS = (
    "account_number", "division", "legal_entity", "unit_name", "supplier_name", "division_shorthand", "facility_type", "scope", "facility_identifier", "activity_group",
    "invoice_count", "invoice_frequency", "consumption_unit", "decimal_separator", "currency",
)
MORE_COLUMNS = ("effective_start_date", "effective_end_date", "ocr_unit_name_list", "ocr_legal_entity_name_list")
ALIASES = {
    "account_number": ("account no", "account #"),
    "legal_entity": ("legal entity name",),
    "unit_name": ("unit",),
    "supplier_name": ("supplier",),
    "activity_group": ("energy type",),
    "consumption_unit": ("energy unit",),
}
YES = ("", "y", "yes", "true", "1")


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row a JSON file, however many lines it has: its text without a byte order mark, name and path."""
    rows = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).withColumn("value", F.regexp_replace("value", "^\ufeff", ""))
    return rows.select(F.col("value").alias("json"), F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_path").alias("source_path"))


def _is_there(spark: SparkSession, path: str) -> bool:
    """Whether a path, which may be a pattern, names anything in its store."""
    try:
        return spark.read.format("binaryFile").load(path).select("path").limit(1).count() > 0
    except AnalysisException as fault:
        if fault.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def text_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV table with a header and these columns in this order, all as text; blanks are null.

    A byte order mark is none of the first name's letters. A missing path, and a file that is empty or holds a header alone, are an empty table.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    if not _is_there(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(path)


def named_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table whose header names its columns, all as text; blanks are null, and names lose a byte order mark and blanks around them."""
    rows = spark.read.option("header", True).option("inferSchema", False).option("encoding", "UTF-8").option("escape", '"').option("multiLine", True).csv(path)
    return rows.toDF(*(c.lstrip("\ufeff").strip() for c in rows.columns))


def lookup_table(df: DataFrame, keys: list[str], delimiter: str = "_") -> DataFrame:
    """Active rows with a lookup key; rows that are wholly null, and unnamed columns, are dropped."""
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ValueError(f"lookup table lacks {', '.join(missing)}")
    rows = df.select([c for c in df.columns if not c.startswith("Unnamed:")]).na.drop("all")
    if "active" in rows.columns:
        rows = rows.where(F.coalesce(lookup_text(F.col("active")) != "no", F.lit(True)))
    key = F.concat_ws(delimiter, *(F.coalesce(lookup_text(F.col(k).cast("string")), F.lit("")) for k in keys))
    return rows.withColumn("lookup_key", key).where(~is_blank(F.col("lookup_key")))


def plain_name(name: str) -> str:
    """A column's name as mapping tables are compared by: small letters and digits, all else one blank."""
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in name.lower()).split())


def account_mapping(df: DataFrame, required: tuple[str, ...] = MAPPING_COLUMNS) -> DataFrame:
    """A mapping table with canonical columns, each the first of its names that is filled, and scope 2's activity groups in their own spelling.

    Names are told apart by letters and digits alone, and other columns stay. A column required that no name stands for is a ValueError,
    which names all of them; one that is not required and not there stays away.
    """
    own = {plain_name(c): c for c in df.columns}
    out = {}
    for name in (*MAPPING_COLUMNS, *MORE_COLUMNS):
        present = [own[n] for n in dict.fromkeys(map(plain_name, (name, *ALIASES.get(name, ())))) if n in own]
        if present:
            out[name] = first_present(*(F.col(f"`{c}`") for c in present))
    missing = [c for c in required if c not in out]
    if missing:
        raise ValueError(f"mapping table lacks {', '.join(missing)}")
    if "activity_group" in out:
        group = lookup_text(out["activity_group"])
        known = F.create_map(*(F.lit(x) for g in ACTIVITY_GROUPS for x in (g.lower(), g)))
        out["activity_group"] = F.coalesce(F.try_element_at(known, group), out["activity_group"])
    return df.withColumns(out)


def entity_hierarchy(df: DataFrame) -> DataFrame:
    """Distinct active (division, legal_entity_name, unit), all three filled."""
    levels = ["division", "legal_entity_name", "unit"]
    rows = df.where(F.coalesce(lookup_text(F.col("active")), F.lit("")).isin(*YES))
    for c in levels:
        rows = rows.where(~is_blank(F.col(c)))
    return rows.select(*levels).dropDuplicates()


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """File, modification time, length and SHA-256 of every file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "modificationTime", "length", F.sha2("content", 256).alias("sha256"))
