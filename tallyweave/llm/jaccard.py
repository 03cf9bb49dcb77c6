"""Near duplicates at a Jaccard similarity of word shingles: SimHash anchors, completed by MinHash bands, and verified exactly.

Two sets at a similarity of 0.8 differ in about a seventh of their fingerprints' bits. Anchors of the covering code reach one bit in
32: with four independent parts they find most pairs from 0.95 on, and about a third at 0.8. MinHash bands find the rest: a pair at the least
similarity shares no bucket with a probability of at most MISS. Texts meet first the one that stands for their part or bucket, then, where a
bucket still holds several groups, another one of them. What of a bucket is then still in different groups meets in full, in blocks of texts,
so no link between groups is left out; pairs within a group need none. Every candidate is verified by its exact similarity.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components
from .licenses import bands_for
from .simhash import LOWER, near_parts
from .substring import Powers, WordHashes, mixed, window_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: Independent 32-bit parts of a text's fingerprint, two from each 64 bits.
PARTS = 4
#: The most rows of a MinHash band.
ROWS = 6
#: Tasks that one text's comparisons are dealt over.
DEALS = 16
CHUNK = 2048
#: What the texts of a block of a bucket weigh, about, and what a text weighs beside its bytes.
BLOCK, ROW = 2 << 20, 1 << 10


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(LOWER).split() if text else []


def shingles(text: str | None, n: int = SHINGLE) -> set[tuple[bytes, ...]]:
    """The distinct runs of n words; fewer words are one run, and no words are the empty run."""
    words = words_of(text)
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def _hashes(text: str | None, shingle: int, cache: WordHashes, powers: Powers) -> np.ndarray:
    """A 64-bit hash of each shingle, repeats included."""
    words = words_of(text)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    return window_hashes(h, min(shingle, len(h)), powers) if len(h) else np.zeros(1, np.uint64)


def fingerprint_parts(hashes: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """The parts of a set of 64-bit hashes: each bit is that of the majority, each two parts from another mixing of the hashes."""
    out = np.zeros(parts, np.int64)
    for seed in range(-(-parts // 2)):
        h, ones = mixed(hashes ^ np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % (1 << 64))), np.zeros(64, np.int64)
        for at in range(0, len(h), CHUNK):
            ones += np.unpackbits(h[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[2 * seed : 2 * seed + 2] = np.packbits(ones * 2 > len(h), bitorder="little").view("<u4")[: parts - 2 * seed]
    return out


def parts_of(texts: DataFrame, shingle: int) -> DataFrame:
    """(key, part, half) of every text: 32 bits of each part of its fingerprint."""

    def each(batches):
        cache, powers = WordHashes(), Powers()
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "halves": [fingerprint_parts(np.unique(_hashes(t, shingle, cache, powers))) for t in b["text"]]})

    found = texts.mapInPandas(each, "key binary, halves array<long>").dropDuplicates(["key"])
    return found.select("key", F.posexplode("halves").alias("part", "half"))


def buckets(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(key, bucket) of every MinHash band of every text; of copies in one task only the first is read."""
    bands, rows = bands_for(similarity, rows=ROWS)
    seeds = np.random.default_rng(11).integers(0, 1 << 64, (2, bands * rows, 1), np.uint64)
    times, plus = seeds[0] | np.uint64(1), seeds[1]

    def each(batches):
        cache, powers, seen = WordHashes(), Powers(), set()
        for b in batches:
            out = []
            b = b[~b["key"].duplicated() & ~b["key"].isin(seen)]
            seen.update(b["key"])
            for text in b["text"]:
                h = np.unique(_hashes(text, shingle, cache, powers))
                low = np.full(bands * rows, np.iinfo(np.uint64).max)
                for at in range(0, len(h), CHUNK):
                    low = np.minimum(low, (h[at : at + CHUNK] * times + plus).min(1))
                out.append(np.array([xxhash.xxh3_64_intdigest(low[i : i + rows].tobytes(), i) for i in range(0, len(low), rows)], np.uint64).view(np.int64))
            yield pd.DataFrame({"key": b["key"], "buckets": out})

    return texts.mapInPandas(each, "key binary, buckets array<long>").select("key", F.explode("buckets").alias("bucket"))


def compared(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts(key, text), each key once, are similar enough, each pair once."""
    pairs = written(pairs.select("a", "b").distinct(), "pairs")
    pairs = pairs.withColumn("deal", F.pmod(F.xxhash64("b"), F.lit(DEALS)))
    texts = texts.hint("merge")  # near copies lie side by side in their files, which say little of what a broadcast of them would hold
    first = pairs.select("deal", "a").distinct().join(texts.withColumnRenamed("key", "a"), "a").select("deal", "a", F.lit(None).cast("binary").alias("b"), "text")
    rows = first.union(pairs.join(texts.withColumnRenamed("key", "b"), "b").select("deal", "a", "b", "text"))

    def each(batches):
        own = None
        for batch in batches:
            out = []
            for a, b, text in zip(batch["a"], batch["b"], batch["text"], strict=True):
                if b is None:
                    own = shingles(text, shingle)
                elif jaccard(own, shingles(text, shingle)) >= similarity:
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"])

    dealt = rows.repartition("deal", "a").sortWithinPartitions("deal", "a", F.col("b").asc_nulls_first())
    return written(dealt.mapInPandas(each, "a binary, b binary"), "compared")


def anchored(texts: DataFrame, shingle: int) -> DataFrame:
    """(a, b): each text with the one that stands for all with its part, and those with one another whose parts differ in one bit."""
    rows = written(parts_of(texts, shingle), "parts")
    first = written(rows.groupBy("part", "half").agg(F.min("key").alias("first"), F.count("*").alias("n")), "firsts")
    same = rows.join(first.where("n > 1"), ["part", "half"]).where("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    a, b = (first.select("part", F.col("half").alias(c), F.col("first").alias(f"first_{c}")) for c in "ab")
    near = near_parts(first).join(a, ["part", "a"]).join(b, ["part", "b"]).select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    return same.union(near.where("a <> b"))


def classes(texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(node, component) of every key of texts(key, text) that candidates link to another key at this similarity or more.

    Texts without words are all alike. Copies of one text have one key and need no links.
    """
    # one shuffle by bucket serves both: most buckets hold one text, and its rows go no further
    members = buckets(texts, shingle, similarity).repartition("bucket")
    centres = members.groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high")
    crowd = written(members.join(centres, "bucket").distinct(), "crowd")
    pairs = anchored(texts, shingle).union(crowd.where("key <> low").select(F.col("low").alias("a"), F.col("key").alias("b")))
    pairs = written(pairs.distinct(), "candidates")
    needed = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    few = written(texts.join(needed, "key").dropDuplicates(["key"]), "few")  # all texts move once; every comparison reads these
    label = components(compared(pairs, few, shingle, similarity))
    group = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"{c}_group"))
    apart = crowd.where("key <> low and key <> high").select("key", "high").distinct().join(group("key"), "key", "left").join(group("high"), "high", "left")
    apart = apart.where(F.coalesce("key_group", "key") != F.coalesce("high_group", "high")).select(F.col("key").alias("a"), F.col("high").alias("b"))
    more = written(components(joined(label, compared(apart, few, shingle, similarity))), "groups")
    rest = across(crowd, more, few, shingle, similarity)
    return components(joined(more, rest)) if rest.limit(1).count() else more


def joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """Edges of found groups (node, component) and of links between them."""
    return label.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links)


def across(crowd: DataFrame, label: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) between groups of label(node, component), of all pairs of crowd(bucket, key) that share a bucket but no group.

    A bucket of several groups is cut into blocks, and each two of its blocks meet in one task: a text is a row for each block, and no pair is
    a row. Of the links between two groups a task gives one; buckets of one group give none.
    """
    held = crowd.select("bucket", "key").join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    held = held.join(texts.select("key", (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW).alias("weight")), "key")
    blocks = F.least(F.count("*"), F.ceil(F.sum("weight") / BLOCK)).cast("int").alias("blocks")
    mixed = held.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), blocks).where("low <> high").select("bucket", "blocks")
    held = written(held.join(mixed, "bucket").select("bucket", "key", "component", "blocks", F.expr("pmod(xxhash64(key), blocks)").alias("own")), "mixed")
    rows = held.join(texts.select("key", "text").hint("merge"), "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "component", "text")

    def each(batches):
        out = []
        rows = (x for b in batches for x in zip(*(b[c] for c in b.columns), strict=True))
        for _, cell in groupby(rows, key=lambda x: x[:3]):
            out += links(*zip(*cell, strict=True), shingle, similarity)
            if len(out) >= CHUNK:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        yield pd.DataFrame(out, columns=["a", "b"])

    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return written(dealt.mapInPandas(each, "a binary, b binary"), "across")


def links(bucket: tuple, i: tuple, j: tuple, own: tuple, key: tuple, component: tuple, text: tuple, shingle: int, similarity: float) -> list[tuple[bytes, bytes]]:
    """Pairs of keys that join all groups with texts similar enough; in a cell of two blocks only texts of different ones meet.

    Common shingles are counted over lists of the texts that hold each, so texts without a common shingle cost nothing.
    """
    ids, names, out = {}, {}, []
    sets = [np.array([ids.setdefault(s, len(ids)) for s in shingles(t, shingle)]) for t in text]
    size, own, group = np.array([len(s) for s in sets]), np.array(own), np.array([names.setdefault(c, len(names)) for c in component])
    flat = np.concatenate(sets)
    holders, many = np.repeat(np.arange(len(sets)), size)[np.argsort(flat, kind="stable")], np.bincount(flat)
    begin = np.cumsum(many) - many
    for x in np.flatnonzero(group != np.bincount(group).argmax()):  # two texts of the largest group need not meet
        n = many[sets[x]]
        both = np.bincount(holders[np.repeat(begin[sets[x]] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))
        near = (both / (size[x] + size - both) >= similarity) & (group != group[x])
        for y in np.flatnonzero(near if i[0] == j[0] else near & (own != own[x])):
            if group[y] != group[x]:
                out.append((key[x], key[y]))
                group[group == group[y]] = group[x]
    return out


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Of each group of near duplicates, reached over pairs of this similarity or more, the row with the smallest id.

    Null ids come last. Rows go only for their texts: different texts of one id stay both. Of equal ids and near-duplicate texts one
    row stays, told by a hash of all its columns. Null and wordless texts are copies of one another. An empty table gives none.
    """
    row, text = F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.col(f"`{text_col}`")
    key, id_ = F.unhex(F.md5(F.coalesce(text, F.lit("")))), F.col(f"`{id_col}`")
    # a row is told by its text, its id and a hash of all its columns; rows alike in all three are equal
    rows = docs.select(row.alias("row"), key.alias("key"), id_.isNull().alias("none"), F.coalesce(id_.cast("string"), F.lit("")).alias("name"), F.xxhash64(F.to_json(row)).alias("hash"))
    own = docs.select(key.alias("key"), id_.isNull().alias("none"), id_.alias("id"), F.coalesce(id_.cast("string"), F.lit("")).alias("name"), F.xxhash64(F.to_json(row)).alias("hash"))
    ids = written(own.groupBy("key", "none", "id", "name").agg(F.min("hash").alias("hash")), "ids")
    owned = ids.join(classes(docs.select(key.alias("key"), text.alias("text")), shingle, similarity).withColumnRenamed("node", "key"), "key", "left")
    best = F.min(F.struct("none", "id", "key", "name", "hash")).alias("best")
    chosen = written(owned.groupBy(F.coalesce("component", "key")).agg(best).select("best.key", "best.none", "best.name", "best.hash"), "chosen")
    named = ["key", "none", "name", "hash"]
    return rows.join(chosen, named).dropDuplicates(named).select("row.*")
