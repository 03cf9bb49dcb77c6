"""Toxicity by multiple-instance learning: a document is a bag of sentences, and only documents have labels.

A sentence's score is a logistic function of its distinct words and their beginnings; a document's is the noisy-or of its
sentences: 1 - prod(1 - p). Gradients pass from document labels through the noisy-or to the sentences, so the model also
tells which sentences offend. It is fitted on a bounded sample of labelled documents and then scores every whole text.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_id

#: Documents of each label that the model is fitted on at most, chosen by hash.
MAX_TOXIC, MAX_CLEAN = 2000, 3000
SLOTS = 1 << 18
PREFIXES = (3, 4, 5, 6)
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
CACHE = 1 << 19


def features(word: str) -> list[int]:
    """Hashed features of a word: itself and its beginnings."""
    out = [zlib.crc32(b"w" + word.encode("utf-8", "replace")) % SLOTS]
    return out + [zlib.crc32(b"p" + word[:n].encode("utf-8", "replace")) % SLOTS for n in PREFIXES if len(word) > n]


def sentences(text: str | None) -> list[tuple[int, int, set[str]]]:
    """(start, end, distinct words) of every sentence that has words."""
    out = []
    for m in SENTENCE.finditer(text or ""):
        words = set(WORD.findall(m[0].lower()))
        if words:
            out.append((m.start(), m.end(), words))
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class WordScores(dict):
    """The summed weights of a word's features, remembered up to a bound."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        s = self[word] = float(self.weights[features(word)].sum())
        return s


def telling(bags: list[list[np.ndarray]], y: np.ndarray, least: int = 3, odds: float = 1.0, errors: float = 2.5) -> np.ndarray:
    """Slots that occur in so many toxic documents at least, and in a larger share of them by these log odds and standard errors."""
    seen = np.zeros((2, SLOTS))
    for bag, label in zip(bags, y, strict=True):
        if bag:
            seen[int(label), np.unique(np.concatenate(bag))] += 1
    share = (seen + 0.5) / (np.bincount(y, minlength=2)[:, None] + 1)
    log = np.log(share[1] / share[0])
    return np.flatnonzero((seen[1] >= least) & (log > odds) & (log > errors * np.sqrt((1 / (seen + 0.5)).sum(0))))


def fit_bags(bags: list[list[np.ndarray]], y: np.ndarray, steps: int = 200, rate: float = 0.05, decay: float = 3e-5) -> Model:
    """Adam on the noisy-or likelihood; bags hold the feature slots of each sentence. Only telling slots get weights."""
    full = [i for i, bag in enumerate(bags) if bag]
    if len(np.unique(y[full])) < 2:
        return Model(np.zeros(SLOTS, np.float32), 0.0 if (y == 1).any() else -6.0)
    used = telling(bags, y)
    place = np.full(SLOTS, -1)
    place[used] = np.arange(len(used))
    flat = [place[s] for i in full for s in bags[i]]
    sizes, n = np.array([len(bags[i]) for i in full]), len(flat)
    y, first, of = y[full].astype(np.float64), np.cumsum(sizes) - sizes, np.repeat(np.arange(len(full)), sizes)
    slots, sentence = np.concatenate(flat), np.repeat(np.arange(n), [len(s) for s in flat])
    slots, sentence = slots[slots >= 0], sentence[slots >= 0]
    w = np.append(np.zeros(len(used)), -5.0)  # the last is the bias
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for t in range(1, steps + 1):
        z = np.clip(np.bincount(sentence, w[slots], n) + w[-1], -30, 30)
        s = np.maximum(np.add.reduceat(np.logaddexp(0, z), first), 1e-12)
        back = np.where(y == 1, np.maximum(-1 / np.expm1(np.minimum(s, 50)), -20), 1.0)[of] / (1 + np.exp(-z)) / len(y)
        g = np.append(np.bincount(slots, back[sentence], len(used)) + decay * w[:-1], back.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * np.sqrt(1 - 0.99**t) / (1 - 0.9**t) * m / (np.sqrt(v) + 1e-8)
    weights = np.zeros(SLOTS, np.float32)
    weights[used] = w[:-1]
    return Model(weights, float(w[-1]))


def held_out(id_col: str = "doc_id"):
    """Rows that no model may learn from: crc32 of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int) -> DataFrame:
    """(text, toxic) of a bounded number of labelled documents that are not held out; of repeated labels the largest counts."""
    marked = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = marked.where("toxic = 1").orderBy(order, "doc_id").limit(max_toxic).union(marked.where("toxic = 0").orderBy(order, "doc_id").limit(max_clean))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, toxic); without labels of both kinds it is a constant."""

    def bags(batches):
        for b in batches:
            out = []
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                slots = [np.array([f for w in words for f in features(w)], "<i4") for _, _, words in sentences(text)]
                lens = np.array([len(s) for s in slots], "<i4").tobytes()
                out.append((int(toxic), lens, np.concatenate(slots).tobytes() if slots else b""))
            yield pd.DataFrame(out, columns=["toxic", "lens", "slots"])

    rows = training_sample(docs, labels, max_toxic, max_clean).mapInPandas(bags, "toxic int, lens binary, slots binary").collect()
    rows = sorted(rows, key=lambda r: (r["toxic"], bytes(r["slots"])))
    split = [np.split(np.frombuffer(r["slots"], "<i4"), np.cumsum(np.frombuffer(r["lens"], "<i4"))[:-1]) if r["lens"] else [] for r in rows]
    return fit_bags(split, np.array([r["toxic"] for r in rows]))


def _score(text: str | None, words: WordScores, model: Model) -> tuple[float, list[tuple[int, int, set[str]]], np.ndarray]:
    """A text's noisy-or, its sentences and their probabilities."""
    found = sentences(text)
    p = model.probabilities(np.array([sum(map(words.__getitem__, sorted(s))) for _, _, s in found]) + model.bias)
    return float(1 - np.exp(np.log1p(-p).sum())), found, p


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", offending: float = 0.3) -> DataFrame:
    """(id, score, spans) for every row: spans are (start, end, score) of the sentences that score offending or more.

    A null, empty or wordless text has no sentences and scores 0. Offsets are in characters of the text. Repeated rows and ids score each
    for itself; equal texts have equal scores; an empty table gives no rows.
    """

    def each(batches):
        words = WordScores(model.weights)
        for b in batches:
            ids, scores, spans = b["id"], [], []
            for text in b["text"]:
                total, found, p = _score(text, words, model)
                scores.append(total)
                spans.append([{"start": found[i][0], "end": found[i][1], "score": float(p[i])} for i in np.flatnonzero(p >= offending)])
            yield pd.DataFrame({"id": ids, "score": scores, "spans": spans})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return by_id(rows, each, "score double, spans array<struct<start: int, end: int, score: double>>")


def kept(docs: DataFrame, model: Model, limit: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below limit; repeated rows stay or go together, an empty table stays empty."""

    def each(batches):
        words = WordScores(model.weights)
        for b in batches:
            texts = b.column(text_col).to_pylist()
            yield b.filter(pa.array([_score(t, words, model)[0] < limit for t in texts], pa.bool_()))

    return docs.mapInArrow(each, docs.schema)


def op1(spark, sf_dir):
    """A score for every document, held out or not. Repeated ids give a row each; an empty table gives none."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("spans").alias("n_offending"))
