"""First-wins duplicate marking for rows with two keys that need not agree."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import nullif_blank, own_columns

from .graph import components

#: Turns in which pairs that are first under both their keys are settled all at once, before what is left is walked in order.
PEELS = 2


def mark_duplicates_any(rows: DataFrame, spill: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows (seq, content_hash, business_key) with duplicate_status, duplicate_of and match_type.

    In the order of seq, a row is a duplicate if an earlier primary has its hash or else its key; only primaries give theirs away. Rows with
    neither are primaries. seq is unique; a blank hash or key counts as none.

    Rows with the same hash and key share one fate after the first, so only pairs are settled. Two turns settle all pairs that are first
    under both keys, and those that meet such a pair: a hot hash is one minimum then. What is left hangs together in components of hashes
    and keys, and each is walked once, in order, as a sorted stream that remembers the keys of its primaries. The jobs do not grow with the
    length of a chain but for the logarithm that its components take.
    """
    own_columns(rows)
    base = rows.withColumns({"_tw_h": nullif_blank(F.col("content_hash")), "_tw_k": nullif_blank(F.col("business_key"))})
    left = spill(base.groupBy(F.col("_tw_h").alias("h"), F.col("_tw_k").alias("k")).agg(F.min("seq").alias("seq")).where("h is not null or k is not null"))
    found = None
    for _ in range(PEELS):
        first = [left.where(f"{c} is not null").groupBy(c).agg(F.min("seq").alias(f"first_{c}")) for c in "hk"]
        both = left.join(first[0], "h", "left").join(first[1], "k", "left")
        won = spill(both.where("coalesce(first_h, seq) = seq and coalesce(first_k, seq) = seq").select("h", "k", "seq"))
        found = won if found is None else found.union(won)
        left = spill(left.join(won.select("h").dropna(), "h", "left_anti").join(won.select("k").dropna(), "k", "left_anti"))
    if left.limit(1).count():
        found = found.union(_walked(left, spill))
    owner = {c: found.where(f"{c} is not null").select(F.col(c).alias(f"_tw_{c}"), F.col("seq").alias(f"_tw_own_{c}")) for c in "hk"}
    out = base.join(owner["h"], "_tw_h", "left").join(owner["k"], "_tw_k", "left")
    by_hash, by_key = F.col("_tw_own_h") < F.col("seq"), F.col("_tw_own_k") < F.col("seq")
    marks = {
        "duplicate_status": F.when(by_hash | by_key, "DUPLICATE").otherwise("PRIMARY"),
        "duplicate_of": F.when(by_hash, F.col("_tw_own_h")).when(by_key, F.col("_tw_own_k")),
        "match_type": F.when(by_hash, "CONTENT_HASH").when(by_key, "BUSINESS_KEY"),
    }
    return out.withColumns(marks).select(*(c for c in rows.columns if c not in marks), *marks)


def _walked(pairs: DataFrame, spill: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The primaries of pairs(h, k, seq), each component walked in order; of a component's rows only its primaries' keys are held."""
    node = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(c), c))
    nodes = pairs.withColumns({"a": node("h"), "b": node("k")})
    of = components(nodes.select("a", "b"), spill)
    placed = nodes.withColumn("node", F.coalesce("a", "b")).join(of, "node", "left").select("h", "k", "seq", F.coalesce("component", "node").alias("component"))

    def each(batches):
        component, seen = None, set()
        for b in batches:
            out = []
            for x in b.itertuples(index=False):
                if x.component != component:
                    component, seen = x.component, set()
                own = {(i, v) for i, v in enumerate((x.h, x.k)) if v is not None}
                if not own & seen:
                    seen |= own
                    out.append((x.h, x.k, x.seq))
            yield pd.DataFrame(out, columns=["h", "k", "seq"])

    kinds = ", ".join(f"{c} {placed.schema[c].dataType.simpleString()}" for c in ("h", "k", "seq"))
    return spill(placed.repartition("component").sortWithinPartitions("component", "seq").mapInPandas(each, kinds))
