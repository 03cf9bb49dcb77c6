"""SimHash near-duplicates found with anchor points of a covering code.

Every 64-bit fingerprint is cut into two 32-bit halves: fingerprints at two or fewer differing bits differ by at most one
bit in one half at least. Anchors for a half are the code words of the perfect Hamming(31, 26) code times the one free
bit: covering radius 1, 2**27 anchors. A fingerprint's home is the anchor within that radius; it is replicated to the anchors
within radius plus threshold that can be the home of a half one bit away (17 or fewer a half). Links are then compared per
anchor, home against replicas, as a join on the anchor that Spark can split where an anchor is crowded.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_id, written
from .components import components

LOWER = bytes(range(256)).translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
SEED = 42


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority of the bits of the XXH64 of all word shingles, repeats included; no words: 0."""
    words = text.encode().translate(LOWER).split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    n = max(1, len(words) - shingle + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        part = h[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long; null and empty texts have 0."""

    def each(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"id": b["id"], "fp": fp})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return by_id(rows, each, "fp long")


def _bit(p: str) -> str:
    """SQL for the mask of the 1-based bit p of a half; 0 where p is 0."""
    return f"shiftright(shiftleft(1L, {p}), 1)"


def _syndrome(half: str) -> Column:
    masks = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]
    return F.expr(" + ".join(f"(bit_count({half} & {m}L) % 2) * {1 << k}" for k, m in enumerate(masks)))


def _halves(fps: DataFrame) -> DataFrame:
    both = F.array(
        F.struct(F.lit(0).alias("side"), F.expr("fp & 4294967295L").alias("half")),
        F.struct(F.lit(1).alias("side"), F.expr("shiftrightunsigned(fp, 32)").alias("half")),
    )
    parts = fps.select("fp", F.explode(both).alias("x")).select("fp", "x.*")
    return parts.withColumn("s", _syndrome("half")).withColumn("home", F.expr(f"half ^ {_bit('s')}"))


def links(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints fp that differ in at most threshold (0 to 3) bits."""
    if not 0 <= threshold <= 3:
        raise ValueError("two halves of one covering radius serve thresholds up to 3")
    parts = written(_halves(fps.select("fp").distinct()), "halves")
    anchor = F.expr("home + side * 4294967296L")
    homes = parts.select(anchor.alias("anchor"), F.col("fp").alias("a"))
    flipped = parts.withColumn("i", F.explode(F.sequence(F.lit(-1), F.lit(31))))
    flipped = flipped.where("i = -1 or (s = 0 and i = 0) or (s <> 0 and i < (s ^ i))")
    near = F.expr(f"case when i = -1 then home ^ 2147483648L else half ^ {_bit('i')} ^ {_bit('(s ^ i)')} end + side * 4294967296L")
    copies = flipped.select(near.alias("anchor"), F.col("fp").alias("b"))
    same = (homes["anchor"] == copies["anchor"]) & (homes["a"] < copies["b"]) & (F.bit_count(homes["a"].bitwiseXOR(copies["b"])) <= threshold)
    # sized as if nothing was replicated, the replicas of a small table would be broadcast
    pairs = homes.join(copies.hint("merge"), same).select("a", "b")
    return pairs.distinct()


def near_parts(parts: DataFrame) -> DataFrame:
    """(part, a, b), a < b: the halves of parts(part, half) that differ in one bit, found at the anchors of each part by itself."""
    rows = parts.select("part", "half").distinct().withColumn("s", _syndrome("half")).withColumn("home", F.expr(f"half ^ {_bit('s')}"))
    rows = written(rows, "halves")
    anchor = F.expr("home + part * 4294967296L")
    homes = rows.select(anchor.alias("anchor"), "part", F.col("half").alias("a"))
    flipped = rows.withColumn("i", F.explode(F.sequence(F.lit(-1), F.lit(31)))).where("i = -1 or (s = 0 and i = 0) or (s <> 0 and i < (s ^ i))")
    near = F.expr(f"case when i = -1 then home ^ 2147483648L else half ^ {_bit('i')} ^ {_bit('(s ^ i)')} end + part * 4294967296L")
    copies = flipped.select(near.alias("anchor"), F.col("half").alias("b"))
    same = (homes["anchor"] == copies["anchor"]) & (homes["a"] != copies["b"]) & (F.bit_count(homes["a"].bitwiseXOR(copies["b"])) <= 1)
    return homes.join(copies.hint("merge"), same).select("part", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = 2) -> DataFrame:
    """(id, fingerprint, component): component is the smallest id reachable over links of at most threshold bits.

    Equal fingerprints are one class, so copies never become pairs: only its smallest id takes part in the search. Rows with
    repeated ids give one row each; an empty table gives none. Null and empty texts share the fingerprint 0.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    pairs = links(classes, threshold)
    a, b = (classes.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first")) for c in "ab")
    edges = pairs.join(a, "a").join(b, "b").select(F.col("a_first").alias("a"), F.col("b_first").alias("b"))
    found = components(edges).withColumnRenamed("node", "first")
    label = classes.join(found, "first", "left").select("fp", F.coalesce("component", "first").alias("component"))
    return fps.join(label, "fp").select("id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component")


def op4(spark, sf_dir):
    """Every document with its fingerprint and the smallest id that it reaches. Repeated ids give a row each; an empty table gives none."""
    from .common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "fingerprint", F.col("component").alias("component_id"))
