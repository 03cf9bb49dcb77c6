"""Configuration of a category as a YAML or JSON document: checked as a whole, and turned into the expressions that the operators take."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import text
from tallyweave.operators import bronze, review, silver
from tallyweave.operators.review import Thresholds

CRITICALITY = ("critical", "optional", "noncritical")
CLEANERS = {"proper_case": text.proper_case, "upper_clean": text.upper_clean, "lookup_text": text.lookup_text, "energy_unit": text.energy_unit, "mojibake": text.mojibake_repaired}
TOP, ENTRY = ("fields", "line_items", "duplicate_key", "thresholds", "header", "tail"), ("sources", "criticality", "cleaner")


class ConfigError(ValueError):
    """All that is wrong with a document, one fault a line."""


@dataclass(frozen=True)
class Category:
    """A category's fields, the columns that make two of its lines duplicates, and its thresholds for review."""

    fields: silver.FieldConfig
    duplicate_key: tuple[str, ...]
    thresholds: Thresholds

    def bronze(self, documents: DataFrame) -> DataFrame:
        """Bronze lines of documents(source_file, json, ...): one a document, or one a line item, columns in the configured order."""
        own = self.fields
        rows = bronze.extracted(bronze.parsed(documents), own.fields)
        if own.table:
            rows = bronze.table_lines(rows, own.table, own.table_fields)
        elif "line_id" not in rows.columns:
            rows = rows.withColumn("line_id", F.lit("1"))
        return silver.projected(silver.cleaned(rows, own.cleaners), own.bronze_columns())

    def marked(self, rows: DataFrame) -> DataFrame:
        """rows with their duplicates marked, by the configured columns."""
        there = F.concat_ws("|", *self.duplicate_key)
        keyed = rows.withColumns({"content_hash": F.when(there != "", F.sha2(there, 256)), "business_key": F.lit(None).cast("string")})
        return bronze.mark_duplicates(keyed, list(self.fields.header))

    def reviewed(self, rows: DataFrame, old: DataFrame) -> review.Review:
        """The review of bronze lines, new or saved, without their duplicates, with the decisions of the review before."""
        return review.reviewed(bronze.split_duplicates(self.marked(rows))[0], self.fields.criticality, self.thresholds, old)


def parsed(content: str, name: str = "configuration") -> dict:
    """A document's content: JSON, or YAML where that library is installed."""
    try:
        out = json.loads(content)
    except json.JSONDecodeError as fault:
        try:
            import yaml
        except ModuleNotFoundError:
            raise ConfigError(f"{name} is no JSON ({fault}), and YAML needs the yaml library") from None
        try:
            out = yaml.safe_load(content)
        except yaml.YAMLError as wrong:
            raise ConfigError(f"{name} is neither JSON nor YAML: {wrong}") from None
    if not isinstance(out, dict):
        raise ConfigError(f"{name} is no mapping")
    return out


def _entries(found: object, where: str, faults: list[str]) -> dict[str, dict]:
    if not isinstance(found, dict) or not found:
        faults.append(f"{where}: names no field")
        return {}
    out = {}
    for name, entry in found.items():
        at = f"{where}.{name}"
        if not isinstance(entry, dict):
            faults.append(f"{at}: is no mapping")
            continue
        faults += [f"{at}: unknown key {k}" for k in entry if k not in ENTRY]
        sources = entry.get("sources")
        if not (isinstance(sources, list) and sources and all(isinstance(s, str) and s.strip() for s in sources)):
            faults.append(f"{at}.sources: is no list of names")
            sources = [str(name)]
        if entry.get("criticality", "optional") not in CRITICALITY:
            faults.append(f"{at}.criticality: {entry['criticality']} is none of {', '.join(CRITICALITY)}")
        if "cleaner" in entry and entry["cleaner"] not in CLEANERS:
            faults.append(f"{at}.cleaner: {entry['cleaner']} is none of {', '.join(CLEANERS)}")
        out[str(name)] = entry | {"sources": sources}
    return out


def category(doc: dict) -> Category:
    """The category that a document describes; every fault is named before anything is read."""
    faults = [f"unknown key {k}" for k in doc if k not in TOP]
    own = _entries(doc.get("fields"), "fields", faults)
    lines = doc.get("line_items") or {}
    if not isinstance(lines, dict) or lines and not isinstance(lines.get("table"), str):
        faults.append("line_items.table: is no name")
        lines = {}
    rows = _entries(lines.get("fields"), "line_items.fields", faults) if lines else {}
    every = own | rows
    header, tail = (doc.get(k, default) for k, default in (("header", ["source_file", "line_id"]), ("tail", [])))
    for k, names in (("header", header), ("tail", tail)):
        if not (isinstance(names, list) and all(isinstance(n, str) for n in names)):
            faults.append(f"{k}: is no list of names")
            names.clear() if isinstance(names, list) else None
    key = doc.get("duplicate_key", list(every))
    if not isinstance(key, list) or not key:
        faults.append("duplicate_key: is no list of names")
        key = []
    faults += [f"duplicate_key: {k} is no field" for k in key if k not in every and k not in header]
    limits = doc.get("thresholds", {})
    known = {f.name for f in fields(Thresholds)}
    if not isinstance(limits, dict):
        faults.append("thresholds: is no mapping")
        limits = {}
    for k, v in limits.items():
        if k not in known:
            faults.append(f"thresholds: unknown key {k}")
        elif isinstance(v, bool) or not isinstance(v, int | float) or not 0 <= v <= 1:
            faults.append(f"thresholds.{k}: {v} is no share from 0 to 1")
    if faults:
        raise ConfigError("\n".join(faults))
    chosen = silver.FieldConfig(
        fields={n: e["sources"] for n, e in own.items()}, table=lines.get("table"), table_fields={n: e["sources"] for n, e in rows.items()},
        criticality={n: e["criticality"] for n, e in every.items() if "criticality" in e}, cleaners={n: CLEANERS[e["cleaner"]] for n, e in every.items() if "cleaner" in e}, header=tuple(header), tail=tuple(tail),
    )
    return Category(chosen, tuple(key), Thresholds(**{k: float(v) for k, v in limits.items()}))


def read_category(spark: SparkSession, path: str) -> Category:
    """The category of a document in any store that Spark reads."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ConfigError(f"{path} is {'no document' if not rows else 'several documents'}")
    return category(parsed(rows[0]["value"], path))


def own_category(name: str) -> Category:
    """A category whose document lies in the package."""
    path = Path(__file__).resolve().parents[1] / "plans" / f"{name}.yaml"
    return category(parsed(path.read_text(encoding="utf-8"), path.name))
