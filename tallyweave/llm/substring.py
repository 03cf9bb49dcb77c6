"""Removal of passages that repeat across documents, by level-wise doubling of windows.

Level 1 looks at windows of half the target length. Of each run of neighbouring windows only the one with the smallest
hash is looked at: any target window holds exactly one such minimum, and equal windows hold equal ones, so no repeat is missed
while a thirteenth of the windows is shuffled. Whole copies are settled there. Each next level doubles the length: only target windows
whose minimum of the level before repeats in another document are looked at, again by one window each. Doubling goes on while windows
survive, up to the target, whose windows are all looked at. Windows stand for their word sequences by 64-bit hashes below the
target, and by 96 bits there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, by_id, written

WINDOW = 50
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
CACHE = 1 << 19


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int):
        if len(self.up) <= n:
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            size = max(n + 1, 1 << 15)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)])) for x in (BASE, inverse))
        return self.up, self.down


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def window_hashes(words: np.ndarray, w: int, powers: Powers) -> np.ndarray:
    """Polynomial hash of every window of w words."""
    n = len(words)
    if n < w:
        return np.empty(0, np.uint64)
    up, down = powers.to(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:n], dtype=np.uint64)])
    return mixed((sums[w:] - sums[:-w]) * down[: n - w + 1])


def smallest(h: np.ndarray, w: int) -> np.ndarray:
    """For every run of w neighbours, the place of the smallest, the leftmost on ties."""
    n = len(h) - w + 1
    if n < 1:
        return np.empty(0, np.int64)
    at, span, low = np.arange(len(h)), 1, h
    while span < w:
        step = min(span, w - span)
        m = len(low) - step
        right = low[step:] < low[:m]
        low, at, span = np.where(right, low[step:], low[:m]), np.where(right, at[step:], at[:m]), span + step
    return at[:n]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def _packed(docs: DataFrame) -> DataFrame:
    """(id, text) with each text compressed: whole texts go through a shuffle twice, at a third of their size."""

    def each(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "text": [pack((t or "").encode()) for t in b["text"]]})

    return by_id(docs, each, "text binary")


def _words(packed: bytes) -> list[bytes]:
    return zstandard.decompress(packed).split()


def _hash(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def minima(docs: DataFrame, window: int = WINDOW, half: int = WINDOW // 2) -> DataFrame:
    """(h, id, at, d, e, lead): in each document the minimal windows of the first length, half, of all its target windows.

    d and e are a 128-bit hash of all its words; lead marks one row of each document.
    """

    def each(batches):
        cache, powers = WordHashes(), Powers()
        for b in batches:
            hs, ids, ats, wholes, leads = [], [], [], [], []
            for doc, text in zip(b["id"], b["text"], strict=True):
                words = ascii_words(text)
                h = window_hashes(_hash(words, cache), half, powers)
                at = np.unique(smallest(h, window - half + 1))
                if len(at):
                    hs.append(h[at])
                    ids.append(np.full(len(at), doc))
                    ats.append(at)
                    wholes.append(np.repeat(np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), "<i8")[None], len(at), 0))
                    leads.append(np.arange(len(at)) == 0)
            if hs:
                whole = np.concatenate(wholes)
                h, at = np.concatenate(hs).view(np.int64), np.concatenate(ats).astype(np.int32)
                yield pd.DataFrame({"h": h, "id": np.concatenate(ids), "at": at, "d": whole[:, 0], "e": whole[:, 1], "lead": np.concatenate(leads)})

    return docs.mapInPandas(each, "h long, id long, at int, d long, e long, lead boolean")


def first_length(window: int, least: int) -> int:
    """The length that doubling starts from: the target halved as long as at least so many words are left."""
    n = max(1, window // 2)
    while n // 2 >= least:
        n //= 2
    return n


def _repeating(level: DataFrame, owner: str) -> DataFrame:
    """(id, ats): the places of each document's windows h of level(h, id, at, ...) that two owners have."""
    shared = level.groupBy("h").agg(F.min(owner).alias("low"), F.max(owner).alias("high")).where("low < high").select("h")
    shared = written(shared, "shared")  # so that both sides are plain shuffles and Spark can split a crowded window
    return level.select("h", "id", "at").join(shared, "h").groupBy("id").agg(F.collect_set("at").alias("ats"))


def doubled(kept: DataFrame, window: int, before: int, length: int) -> DataFrame:
    """(h, id, at) of kept(id, text, ats): windows of this length, one for each target window whose window of the length before is at ats."""

    def each(batches):
        cache, powers = WordHashes(), Powers()
        for b in batches:
            for doc, text, ats in zip(b["id"], b["text"], b["ats"], strict=True):
                words = _hash(_words(text), cache)
                live = np.zeros(len(words) + 1, bool)
                live[np.asarray(ats)] = True
                targets = live[smallest(window_hashes(words, before, powers), window - before + 1)]
                h = window_hashes(words, length, powers)
                at = np.unique(smallest(h, window - length + 1)[targets])
                yield pd.DataFrame({"h": h[at].view(np.int64), "id": np.full(len(at), doc), "at": at.astype(np.int32)})

    return kept.mapInPandas(each, "h long, id long, at int")


def repeated_windows(docs: DataFrame, window: int = WINDOW, least: int = 20) -> DataFrame:
    """(id, copy, starts): of each document that repeats one with a smaller id, whether it is a copy of it, else the starts
    of the target windows that also occur in such a document.

    Copies are settled first, by the hash of all words: they hold no window that their first does not hold, so neither they
    nor windows that only copies share go on to the next level. The first length is the target halved down to least words.
    """
    length = first_length(window, least)
    level = written(minima(docs.where("id is not null"), window, length), "minima")
    whole = level.where("lead").select("id", "d", "e")
    copies = whole.join(whole.groupBy("d", "e").agg(F.min("id").alias("first")), ["d", "e"]).where("first < id").select("id")
    copies = written(copies, "copies")
    alive = _repeating(level, "d").join(copies, "id", "left_anti")
    while 2 * length < window:
        before, length = length, 2 * length
        level = written(doubled(_packed(docs).join(alive, "id"), window, before, length), f"windows-{length}")
        if level.limit(1).count() == 0:
            break
        alive = _repeating(level, "id")
    kept = _packed(docs).join(alive, "id")

    def extend(batches):
        cache, powers = WordHashes(), Powers()
        for b in batches:
            his, los, ids, starts = [], [], [], []
            for doc, text, ats in zip(b["id"], b["text"], b["ats"], strict=True):
                words = _hash(_words(text), cache)
                part = smallest(window_hashes(words, length, powers), window - length + 1)
                live = np.zeros(len(words) + 1, bool)
                live[np.asarray(ats)] = True
                at = np.flatnonzero(live[part])
                his.append(window_hashes(words, window, powers)[at])
                los.append((window_hashes(mixed(words), window, powers)[at] >> np.uint64(32)).astype(np.int64))
                ids.append(np.full(len(at), doc))
                starts.append(at.astype(np.int32))
            lo = np.concatenate(los).astype(np.uint32).view(np.int32)
            yield pd.DataFrame({"hi": np.concatenate(his).view(np.int64), "lo": lo, "id": np.concatenate(ids), "start": np.concatenate(starts)})

    target = written(kept.mapInPandas(extend, "hi long, lo int, id long, start int"), "windows")
    keys = ["hi", "lo"]
    firsts = target.groupBy(*keys).agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    firsts = written(firsts, "firsts")
    hit = target.join(firsts, keys).where("first < id").groupBy("id").agg(F.collect_set("start").alias("starts"))
    return hit.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)), allowMissingColumns=True)


def covered(n: int, starts, window: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of starts."""
    edge = np.zeros(n + 1, np.int64)
    if starts is not None and len(starts):
        s = np.asarray(starts)
        np.add.at(edge, s, 1)
        np.add.at(edge, s + window, -1)
    return np.cumsum(edge[:n]) > 0


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, least: int = 20) -> DataFrame:
    """(id, n_words, n_removed, kept): kept is the words left, joined by one space.

    Ids must be unique; a row without one keeps all its words and takes none from others. A null text has no words, a text shorter than the window keeps all. Windows are judged on the
    input, so of several copies the one with the smallest id stays whole. An empty table gives no rows.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    texts = _texts(docs, id_col, text_col)
    joined = _packed(texts).join(repeated_windows(texts, window, least), "id", "left")

    def cut(batches):
        for b in batches:
            out = []
            for doc, text, copy, starts in zip(b["id"], b["text"], b["copy"], b["starts"], strict=True):
                words = _words(text)
                gone = np.ones(len(words), bool) if copy is True else covered(len(words), starts, window)
                kept = b" ".join([w for w, g in zip(words, gone, strict=True) if not g] if gone.any() else words)
                out.append((doc, len(words), int(gone.sum()), kept.decode()))
            yield pd.DataFrame(out, columns=["id", "n_words", "n_removed", "kept"])

    return by_id(joined, cut, "n_words long, n_removed long, kept string")


def op5(spark, sf_dir):
    """Every document's words, those removed, and a digest of those kept. Ids must be unique; an empty table gives none."""
    from .common import table

    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, s AS start, array_to_string(w[s:s + 49], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM words WHERE len(w) >= 50)
),
firsts AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k),
hits AS (SELECT doc_id, start FROM windows JOIN firsts USING (k) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 50)) AS i FROM hits),
each AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM words),
kept AS (
  SELECT doc_id, count(gone.i) AS n_removed,
    coalesce(string_agg(word, ' ' ORDER BY each.i) FILTER (WHERE gone.i IS NULL), '') AS kept
  FROM each LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
