"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a bounded sample is cut into parts of like size that keep neighbours together. A small classifier, one softmax layer,
learns in which parts a vector's neighbours lie. It places every row in its likeliest part, and routes a query to the most probable ones, whose
rows are scored in double precision. How many parts a query visits is measured, not guessed: rows that the classifier has not seen are
searched by brute force over all rows, and the fewest parts are taken that find the wanted share of their true neighbours.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cells import Layout, candidates, first, fitted_sample, matrix, met, own_out, packed, usable, visited
from .common import table, written

#: Share of true neighbours to be found; it is measured on so many rows.
RECALL, PROBED = 0.95, 256
#: Rows of a part on average, most parts, and the sample's rows: at least, and for each part.
PART_ROWS, MOST_PARTS, SAMPLE, SAMPLE_A_PART = 800, 1024, 8192, 32
#: Neighbours of a graph node, and how much larger than the mean a part of the graph may be.
EDGES, ROOM = 16, 1.1


def parts_for(n: int) -> int:
    """How many parts n rows have."""
    return int(min(MOST_PARTS, max(1, min(n // 4, max(8, 2 ** round(np.log2(max(1, n / PART_ROWS))))))))


def graph(sample: np.ndarray, spark, edges: int = EDGES) -> np.ndarray:
    """The nearest others of each row of the sample, -1 where there are too few; rows are dealt to tasks, the sample is bounded."""
    held = spark.sparkContext.broadcast(sample)

    def each(batches):
        for b in batches:
            at = b["id"].to_numpy()
            scores = held.value[at] @ held.value.T
            scores[np.arange(len(at)), at] = -np.inf
            k = min(edges, scores.shape[1] - 1)
            near = np.argpartition(-scores, max(k - 1, 0), axis=1)[:, :k]
            yield pd.DataFrame({"id": at, "near": list(np.pad(near, ((0, 0), (0, edges - k)), constant_values=-1))})

    found = spark.range(len(sample)).mapInPandas(each, "id long, near array<long>").toPandas().sort_values("id")
    held.destroy()
    return np.stack(found["near"].to_numpy())


def balanced_parts(sample: np.ndarray, near: np.ndarray, parts: int, rng: np.random.Generator, sweeps: int = 20) -> np.ndarray:
    """The part of each node: halves along principal axes to begin with, then nodes move to where most neighbours are while there is room."""
    groups = [np.arange(len(sample))]
    while len(groups) < parts:
        halves = []
        for g in groups:
            x, axis = sample[g] - sample[g].mean(0), rng.normal(size=sample.shape[1])
            for _ in range(8):
                axis = x.T @ (x @ axis)
                axis /= np.linalg.norm(axis) + 1e-12
            order = g[np.argsort(x @ axis, kind="stable")]
            halves += [order[: len(g) // 2], order[len(g) // 2 :]]
        groups = halves
    part = np.zeros(len(sample), np.int64)
    for k, g in enumerate(groups):
        part[g] = k
    a, b = np.repeat(np.arange(len(sample)), near.shape[1]), near.ravel()
    a, b = np.concatenate([a[b >= 0], b[b >= 0]]), np.concatenate([b[b >= 0], a[b >= 0]])
    room = int(np.ceil(ROOM * len(sample) / parts))
    for _ in range(sweeps):
        pull = np.zeros((len(sample), parts))
        np.add.at(pull, (a, part[b]), 1)
        best = (pull + rng.random(pull.shape) / 2).argmax(1)
        gain = pull[np.arange(len(sample)), best] - pull[np.arange(len(sample)), part]
        size, moved = np.bincount(part, minlength=parts), 0
        for i in np.flatnonzero((gain > 0) & (rng.random(len(gain)) < 0.6)):
            if size[best[i]] < room:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i], moved = best[i], moved + 1
        if moved * 500 < len(sample):
            break
    return part


class Router:
    """Softmax over the parts: where a vector's neighbours lie."""

    def __init__(self, sample: np.ndarray, near: np.ndarray, part: np.ndarray, parts: int, rng: np.random.Generator, epochs: int = 12):
        self.scale = 1 / max(1e-300, float(np.sqrt((sample**2).sum(1).mean())) if len(sample) else 1.0)
        x, n = sample * self.scale, len(sample)
        goal = np.zeros((n, parts))
        held = near >= 0
        np.add.at(goal, (np.repeat(np.arange(n), held.sum(1)), part[near[held]]), 1.0)
        goal[np.arange(n), part] += 2
        goal /= goal.sum(1, keepdims=True)
        w = [np.zeros((x.shape[1], parts)), np.zeros(parts)]
        m, v, step, last = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0, epochs * -(-n // 256)
        for _ in range(epochs if n else 0):
            for at in np.array_split(rng.permutation(n), -(-n // 256)):
                step += 1
                off = (_softmax(x[at] @ w[0] + w[1]) - goal[at]) / len(at)
                rate = 0.01 * (1 + np.cos(np.pi * step / last)) / 2
                for p, g, m_, v_ in zip(w, (x[at].T @ off, off.sum(0)), m, v, strict=True):
                    m_ += 0.1 * (g - m_)
                    v_ += 0.001 * (g * g - v_)
                    p -= rate * (m_ / (1 - 0.9**step)) / (np.sqrt(v_ / (1 - 0.999**step)) + 1e-8)
        self.w, self.b = w

    def order(self, vectors: np.ndarray) -> np.ndarray:
        """The parts of each vector, the most probable first."""
        return np.argsort(-((vectors * self.scale) @ self.w + self.b), axis=1, kind="stable")


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _pack(rows: DataFrame) -> DataFrame:
    def each(batches):
        for b in batches:
            yield b.assign(vec=packed(np.array(b["vec"].tolist(), np.float64).reshape(len(b), -1)))

    return rows.mapInPandas(each, "id long, vec binary")


def _best(query: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, id, score) of each query's k nearest among the rows; ids ascend. Close scores are taken again, in one fixed order of sums."""
    with np.errstate(over="ignore", invalid="ignore"):
        scores = q @ c.T
        scores[np.isnan(scores)] = -np.inf
        own_out(scores, query, ids)
        slack = 1e-9 * np.linalg.norm(q, axis=1) * (np.linalg.norm(c, axis=1).max() if len(c) else 0.0)
        at, col = candidates(scores, k, np.full(len(q), -np.inf), slack)
        score = (q[at] * c[col]).sum(1)
    keep = first(at, score, ids[col], k)
    return at[keep], ids[col[keep]], score[keep]


class Index:
    """rows(id, vec, cell, shard), the router and the layout of the parts; built from whole tables, fitted on a bounded sample."""

    def __init__(self, rows: DataFrame, seed: int = 7):
        spark, rng = rows.sparkSession, np.random.default_rng(seed)
        rows = written(_pack(rows), "vectors")
        n = rows.count()
        self.parts = parts_for(n)
        most = max(SAMPLE, SAMPLE_A_PART * self.parts)
        seen = fitted_sample(rows, n, most + PROBED, "id", "vec")
        aside = min(PROBED, len(seen) // 4)  # measured on, not learnt from
        self.probes, learnt = seen[:aside], seen[aside:]
        x = matrix(learnt["vec"])
        near = graph(x.astype(np.float32), spark) if len(x) else np.zeros((0, EDGES), np.int64)
        part = balanced_parts(x, near, self.parts, rng) if len(x) else np.zeros(0, np.int64)
        self.router = Router(x, near, part, self.parts, rng)
        router, parts = self.router, self.parts

        def placed(batches):
            for b in batches:
                yield b.assign(cell=router.order(matrix(b["vec"]))[:, 0] if len(b) else np.zeros(0, np.int64))

        cells = written(rows.mapInPandas(placed, "id long, vec binary, cell long"), "parts")
        counts = np.zeros(parts, np.int64)
        for cell, rows_there in cells.groupBy("cell").count().toPandas().itertuples(index=False):  # as many rows as parts
            counts[cell] = rows_there
        self.layout = layout = Layout(counts)

        def dealt(batches):
            for b in batches:
                yield b.assign(shard=layout.shards(b["cell"].to_numpy(), b["id"].to_numpy()))

        self.rows = cells.mapInPandas(dealt, "id long, vec binary, cell long, shard long")

    def visits_for(self, k: int, recall: float) -> int:
        """The fewest parts a query must visit to find this share of its k nearest, measured by brute force over all rows."""
        if not len(self.probes):
            return self.parts
        ids, q = self.probes["id"].to_numpy(), matrix(self.probes["vec"])

        def each(batches):
            for b in batches:
                if len(b):
                    b = b.sort_values("id")
                    at, found, score = _best(ids, q, b["id"].to_numpy(), matrix(b["vec"]), k)
                    cell = b["cell"].to_numpy()[np.searchsorted(b["id"].to_numpy(), found)]
                    yield pd.DataFrame({"query": at, "id": found, "score": score, "cell": cell})

        found = ranked(self.rows.mapInPandas(each, "query long, id long, score double, cell long"), k).select("query", "cell").toPandas()
        turn = np.argsort(self.router.order(q), axis=1)[found["query"].to_numpy(), found["cell"].to_numpy()]
        reached = np.searchsorted(np.sort(turn), np.arange(self.parts), side="right") / max(1, len(turn))
        return int(min(self.parts, 1 + np.argmax(reached >= recall))) if len(turn) else self.parts

    def search(self, queries: DataFrame, k: int, visits: int) -> DataFrame:
        """(query, rank, id, score): the k nearest of each of queries(id, vec) found in so many parts."""
        router, layout = self.router, self.layout

        def routed(batches):
            for b in batches:
                order = router.order(matrix(b["vec"]))[:, :visits] if len(b) else ()
                rows = [(q, v, s, c) for q, v, o in zip(b["id"], b["vec"], order, strict=True) for s, c in layout.visits(o)]
                yield pd.DataFrame(rows, columns=["query", "vec", "shard", "cells"])

        def scored(rows, requests):
            query, q, out = requests["query"].to_numpy(), matrix(requests["vec"]), []
            for own, asking in visited(rows, requests):
                at, ids, score = _best(query[asking], q[asking], own["id"].to_numpy(), matrix(own["vec"]), k)
                out.append(pd.DataFrame({"at": asking[at], "id": ids, "score": score}))
            found = pd.concat(out) if out else pd.DataFrame({"at": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
            found = found.iloc[first(found["at"].to_numpy(), found["score"].to_numpy(), found["id"].to_numpy(), k)]
            return pd.DataFrame({"query": query[found["at"]], "id": found["id"], "score": found["score"]})

        asking = written(queries.select("id", "vec").mapInPandas(routed, "query long, vec binary, shard long, cells array<long>"), "requests")
        return ranked(met(self.rows, asking, scored, "query long, id long, score double"), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """Each query's k first: larger scores, then smaller ids."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(rows: DataFrame, asked: str, k: int = 20, recall: float = RECALL, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query, rank, id, score): the k nearest others of every row for which the SQL condition asked on id holds, by inner product.

    About the wanted share of the true neighbours is found; a score is exact. Rows with a null id, with a null or all-zero vector, or one with a null
    or non-finite component, neither ask nor are found. Rows with one id count as one, that with the smallest vector, and vectors of
    another length than most have are left out. Equal scores rank by id; equal vectors are separate rows. Fewer than k others give
    all that there are; an empty table gives no rows.
    """
    index = Index(usable(rows, id_col, vec_col, zero=False))
    return index.search(index.rows.where(asked), k, index.visits_for(k, recall))


def op11(spark, sf_dir):
    """The twenty nearest of every embedding whose id is divisible by 20, among all others. An empty table gives no rows."""
    found = nearest(table(spark, sf_dir, "embeddings"), "id % 20 = 0")
    return found.select(F.col("query").alias("query_id"), F.col("rank").cast("int"), F.col("id").alias("vec_id"), "score")
