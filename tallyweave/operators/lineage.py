"""Lineage of monthly amounts: which rows, splits, files and links an amount was made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import is_blank

from .rollup import MONTHLY_KEY, parts_of, passes_mapping_gate

#: Links that a report row shows at most; the list itself keeps all.
LINKS = 4


def split_key(split: Column) -> Column:
    """row|month|start|end of a split."""
    return F.concat_ws("|", split["row_id"], F.date_format(split["month"], "yyyy-MM"), split["split_start"], split["split_end"])


def monthly_lineage(splits: DataFrame, extra_keys: tuple[str, ...] = (), joined: tuple[str, ...] = (), parts: tuple[str, ...] = (), first: tuple[str, ...] = ()) -> DataFrame:
    """Per account and month the source rows, split keys, files and links of its billable splits, in the order of rows and dates.

    joined, parts and first name columns to carry along as distinct texts, as distinct parts of texts, and as the first value. A cell
    grows with the splits of its account and month: this is the form for reports, monthly_rollup() is the one for sums.
    """
    order, extra = ("row_id", "split_start", "split_end"), dict.fromkeys((*joined, *parts, *first))
    # one list a group, from which all cells are made: a list a cell would carry the order once for each
    one = F.struct(*order, "month", "invoice_id", "link", *(c for c in extra if c not in (*order, "month", "invoice_id", "link")))
    rows = splits.where(passes_mapping_gate()).groupBy(*MONTHLY_KEY, *extra_keys).agg(F.collect_list(one).alias("_tw_all"))
    place = lambda x: F.struct(*(x[c].alias(c) for c in order))
    pairs = lambda value: F.array_sort(F.transform("_tw_all", lambda x: F.struct(place(x).alias("o"), value(x).alias("v"))))
    listed = lambda value: F.transform(pairs(value), lambda x: x["v"])
    filled = lambda value: F.filter(listed(value), lambda v: ~is_blank(v.cast("string")))
    cell = lambda c: lambda x: x[c]
    return rows.select(
        *MONTHLY_KEY, *extra_keys,
        F.concat_ws("; ", F.array_distinct(filled(cell("row_id")))).alias("source_row_ids"),
        F.concat_ws("; ", F.array_distinct(filled(split_key))).alias("split_keys"),
        F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.transform("_tw_all", cell("invoice_id"))))), "; ").alias("source_files"),
        F.array_compact(F.array_distinct(listed(cell("link")))).alias("links"),
        *(F.concat_ws("; ", F.array_distinct(filled(cell(c)))).alias(c) for c in joined),
        *(parts_of(filled(cell(c))).alias(c) for c in parts),
        *(F.get(filled(cell(c)), F.lit(0)).alias(c) for c in first),
    )


def widened(df: DataFrame, column: str = "links", prefix: str = "sharepoint_link_", width: int = LINKS) -> DataFrame:
    """df with the first so many of a list's values as columns of their own, in place of the list."""
    shown = F.slice(column, 1, width)
    return df.withColumns({f"{prefix}{i + 1}": F.get(shown, F.lit(i)) for i in range(width)}).drop(column)


def split_ranges(df: DataFrame, column: str = "split_keys") -> DataFrame:
    """One row a split key with its month, start and end as dates; texts that are no split key give none."""
    rows = df.withColumn("split_key", F.explode(F.split(column, r";\s*")))
    part = lambda i: F.element_at(F.split("split_key", r"\|"), i)
    rows = rows.where(F.size(F.split("split_key", r"\|")) >= 4)
    return rows.withColumns({"month": F.try_to_date(part(-3), "yyyy-MM"), "split_start": F.try_to_date(part(-2), "yyyy-MM-dd"), "split_end": F.try_to_date(part(-1), "yyyy-MM-dd")})
