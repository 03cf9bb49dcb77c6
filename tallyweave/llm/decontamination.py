"""Benchmark decontamination: an FM-index per shard of training text, searched backwards for the benchmark's phrases.

A shard is a run of documents in one partition. Words outside the benchmark's vocabulary cannot lie in a phrase, so they
end a run, and only runs at least as long as the shortest phrase are indexed: nothing that could match is left out.
The documents are never shuffled. The benchmark is the query set: it is sent out in blocks of bounded size, one pass each.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_id, written
from .fmindex import FMIndex

WINDOW = 10
#: Characters of benchmark text that make a block, and blocks sent to the workers in one plan before what they found is written.
BLOCK_CHARS, BLOCKS = 1 << 20, 8
#: A shard is indexed when it holds so many symbols or so many characters of text.
SHARD_SYMBOLS, SHARD_CHARS = 1 << 19, 32 << 20
#: Names that no table of documents has.
SPANS, ITEMS = "_tallyweave_spans", "_tallyweave_items"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes to words: A-Z in lower case, ASCII that is neither letter nor digit to a blank, the rest unchanged.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def split_words(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


class Phrases:
    """The distinct windows of one block of benchmark items as rows of symbols, and the items of each."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        of: dict[tuple[int, ...], list[str | None]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in split_words(text)]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                of.setdefault(tuple(ids[at : at + window]), []).append(item)
        self.items = list(of.values())
        self.lengths = np.array([len(p) for p in of], np.int64)
        self.symbols = np.zeros((len(of), window), np.int64)
        for i, p in enumerate(of):
            self.symbols[i, : len(p)] = p
        self.shortest = int(self.lengths.min(initial=window))


def _runs(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of positive symbols of at least this length."""
    on = np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]]))
    start, end = np.flatnonzero(on == 1), np.flatnonzero(on == -1)
    long = end - start >= least
    return start[long], end[long]


def in_order(items) -> list[str | None]:
    """The distinct items, null last."""
    return sorted(set(items), key=lambda i: (i is None, i or ""))


def search_shard(docs: list[np.ndarray], phrases: Phrases) -> list[tuple[list[int], list[str | None]]]:
    """For each document, as symbols: the flat list of [first, last) words of its occurrences, and the items found."""
    found: list[tuple[list[int], list[str | None]]] = [([], []) for _ in docs]
    whole = np.concatenate([np.append(d, 0) for d in docs]) if docs else np.zeros(0, np.int64)
    ends = np.cumsum([len(d) + 1 for d in docs])
    start, end = _runs(whole, phrases.shortest)
    if not len(start) or not len(phrases.items):
        return found
    sizes = end - start + 1
    base = np.cumsum(sizes) - sizes
    text = np.zeros(int(sizes.sum()), np.int64)
    inside = np.repeat(start - base, sizes) + np.arange(len(text))
    text[:] = whole[inside]  # the symbol after a run is 0
    index = FMIndex(text, len(phrases.vocabulary))
    low, high = index.search(phrases.symbols, phrases.lengths)
    hit = np.flatnonzero(low < high)
    if not len(hit):
        return found
    counts = (high - low)[hit]
    phrase = np.repeat(hit, counts)
    rows = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low[hit], counts)
    at = inside[index.locate(rows)]
    doc = np.searchsorted(ends, at, side="right")
    first = at - (ends - [len(d) + 1 for d in docs])[doc]
    order = np.argsort(doc, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1):
        s, p = first[own], phrase[own]
        found[doc[own[0]]] = (merged(s, s + phrases.lengths[p]), in_order(i for x in np.unique(p) for i in phrases.items[x]))
    return found


def merged(first: np.ndarray, last: np.ndarray) -> list[int]:
    """The union of spans [first, last) as a flat list in order."""
    out: list[int] = []
    for a, b in sorted(zip(map(int, first), map(int, last), strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def without_spans(text: str, spans: list[int]) -> str:
    """text without the words of these spans and what lies between the words of one span."""
    out, at, words = [], 0, [m.span() for m in WORD.finditer(text)]
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[at : words[a][0]])
        at = words[b - 1][1]
    return "".join([*out, text[at:]])


def _scan(rows: DataFrame, phrases: Phrases, text_col: str) -> DataFrame:
    """rows, all columns, with what is found added to SPANS and ITEMS."""

    def each(batches):
        for b in batches:
            shard: list[np.ndarray] = []
            found: list = []
            symbols = chars = 0
            for text in b.column(text_col).to_pylist():
                words = split_words(text)
                shard.append(np.fromiter(map(phrases.vocabulary.get, words, repeat(0)), np.int64, len(words)))
                symbols, chars = symbols + len(words), chars + len(text or "")
                if symbols >= SHARD_SYMBOLS or chars >= SHARD_CHARS:
                    found += search_shard(shard, phrases)
                    shard, symbols, chars = [], 0, 0
            found += search_shard(shard, phrases)
            for k, name in enumerate((SPANS, ITEMS)):
                at = b.schema.get_field_index(name)
                both = [[*old, *new[k]] for old, new in zip(b.column(at).to_pylist(), found, strict=True)]
                b = b.set_column(at, b.schema.field(at), pa.array(both, b.schema.field(at).type))
            yield b

    return rows.mapInArrow(each, rows.schema)


def _searched(docs: DataFrame, benchmark: DataFrame, text_col: str, window: int) -> DataFrame:
    """docs, all columns, with SPANS and ITEMS of all blocks of the benchmark as they were found."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("phrase")).where("phrase is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("phrase")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-chars // BLOCK_CHARS))
    rows = docs.select("*", F.expr(f"cast(array() as array<int>) {SPANS}"), F.expr(f"cast(array() as array<string>) {ITEMS}"))
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item", "phrase"), F.lit(blocks)) == k)
        if k and k % BLOCKS == 0:
            rows = written(rows, "searched")
        rows = _scan(rows, Phrases([(r["item"], r["phrase"]) for r in block.collect()], window), text_col)
    return rows


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, text, spans, items, n_words, n_hit, clean) for every row of docs.

    spans: [first, last) word numbers inside benchmark windows, merged, as a flat list; items: the benchmark's item_ids found, as
    sorted strings, a null one last; clean: the text without those spans. Null texts stay null and have no words; an empty text or
    benchmark has no hits. Repeated rows and ids give a row each. Null texts are left out of the benchmark; items without an id are searched.
    """
    rows = _searched(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), benchmark, "text", window)

    def finish(batches):
        for b in batches:
            out = []
            for doc, text, spans, found in b.itertuples(index=False):
                spans = merged(spans[::2], spans[1::2]) if len(spans) else []
                clean = without_spans(text, spans) if spans else text
                out.append((doc, text, spans, in_order(found), len(split_words(text)), sum(spans[1::2]) - sum(spans[::2]), clean))
            yield pd.DataFrame(out, columns=["id", "text", "spans", "items", "n_words", "n_hit", "clean"])

    return by_id(rows, finish, "text string, spans array<int>, items array<string>, n_words long, n_hit long, clean string")


def cleaned(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns, with the spans of contamination() cut out of their texts; n_chars, if any, is counted anew.

    Texts are cut where they are searched: nothing is joined, and null or repeated ids are rows like others.
    """
    rows, names = _searched(docs, benchmark, text_col, window), docs.columns

    def cut(batches):
        for b in batches:
            texts = []
            for text, spans in zip(b.column(text_col).to_pylist(), b.column(SPANS).to_pylist(), strict=True):
                spans = merged(spans[::2], spans[1::2])
                texts.append(without_spans(text, spans) if spans else text)
            at = b.schema.get_field_index(text_col)
            b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
            yield b.select(names)

    out = rows.mapInArrow(cut, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast("long"))
    return out.select(docs.columns)


def op7(spark, sf_dir):
    """Every document's words in benchmark windows. Repeated ids give a row each; an empty table gives none."""
    from .common import table

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
),
phrases AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT n FROM phrases),
windows AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS k
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, lengths WHERE len(w) >= n)
),
hits AS (SELECT doc_id, item_id, n, s FROM windows JOIN phrases USING (n, k)),
counts AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN counts USING (doc_id) LEFT JOIN items USING (doc_id)
"""
