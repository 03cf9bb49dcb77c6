"""Hard negatives by an inverted multi-index, exactly.

Vectors are cut into two halves, each with a codebook of its own; a pair of codes is a cell. For an anchor, no row of a code scores more in that half than
the centre does plus the anchor's length times the code's radius, so the sum of both halves' bounds bounds a cell. The multi-sequence heap visits
cells as their bounds fall. A window of scores is certified once it holds all the rows that it needs and the next bound is below the last of them, or below the window.

Anchors are searched in rounds. The heap's first cells give each window a score to beat; then the heap goes on to the last cell whose bound reaches it.
Positives are found so, then the windows that they set. Rows stay in their shards, anchors go to the shards of the cells that they visit.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cells import EXACT, Layout, candidates, first, fitted_sample, matrix, met, own_out, packed, usable, visited
from .common import table, written

#: Rows of a cell on average, most codes of a half, rows of the sample, and rows that the first round visits for an anchor.
CELL_ROWS, MOST_CODES, SAMPLE, FIRST_ROWS = 200, 256, 16384, 2000
#: A negative scores at least and at most so many hundredths of the positive.
LOW, HIGH = 30, 90
#: Below every score that is kept.
NONE = -(1 << 62)
FOUND = "query long, window int, id long, score long"


def codebook(x: np.ndarray, codes: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """The centres of k-means over x; fewer where x has fewer rows, one of zeros where it has none."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    centres = x[rng.permutation(len(x))[:codes]].astype(np.float64)
    for _ in range(rounds):
        code = nearest_code(x, centres)
        n = np.bincount(code, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, code, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest_code(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * (x @ centres.T), axis=1)


def multi_sequence(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(sum, i, j) of all pairs of the two halves' bounds, largest sum first."""
    a, b = np.argsort(-left, kind="stable"), np.argsort(-right, kind="stable")
    u, v = left[a].tolist(), right[b].tolist()
    heap, seen = [(-(u[0] + v[0]), 0, 0)], {(0, 0)}
    while heap:
        bound, p, q = heapq.heappop(heap)
        yield -bound, int(a[p]), int(b[q])
        for p_, q_ in ((p + 1, q), (p, q + 1)):
            if p_ < len(u) and q_ < len(v) and (p_, q_) not in seen:
                seen.add((p_, q_))
                heapq.heappush(heap, (-(u[p_] + v[q_]), p_, q_))


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers held as doubles, exact: by doubles while they cannot be rounded, else by long integers."""
    most = np.abs(a).max(initial=0.0) * np.abs(x).max(initial=0.0) * a.shape[1]
    if most < EXACT:
        return a @ x.T
    if most >= -NONE:
        raise ValueError("inner products beyond 62 bits")
    return a.astype(np.int64) @ x.astype(np.int64).T


class Codes:
    """Both halves' codebooks, the radii of their codes, and where the cells lie."""

    def __init__(self, sample: np.ndarray, codes: int, rng: np.random.Generator):
        self.cut = sample.shape[1] // 2
        self.centres = [codebook(half, codes, rng) for half in self.split(sample)]
        self.wide = len(self.centres[1])
        self.radii = [np.zeros(len(c)) for c in self.centres]
        self.layout = Layout(np.zeros(0, np.int64))

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[..., : self.cut], x[..., self.cut :]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The cell of each vector, and how far its halves are from their centres."""
        code = [nearest_code(h, c) for h, c in zip(self.split(x), self.centres, strict=True)]
        return code[0] * self.wide + code[1], [np.linalg.norm(h - c[k], axis=1) for h, c, k in zip(self.split(x), self.centres, code, strict=True)]

    def fill(self, held: pd.DataFrame) -> None:
        """Takes the rows and largest distances of the filled cells."""
        cell = held["cell"].to_numpy(np.int64)
        counts = np.zeros(len(self.centres[0]) * self.wide, np.int64)
        counts[cell] = held["n"]
        np.maximum.at(self.radii[0], cell // self.wide, held["left"].to_numpy(np.float64))
        np.maximum.at(self.radii[1], cell % self.wide, held["right"].to_numpy(np.float64))
        self.layout = Layout(counts)

    def bounds(self, vector: np.ndarray) -> list[np.ndarray]:
        """What no row of a code can exceed in its half, raised by more than rounding can take away."""
        out = []
        for x, centres, radii in zip(self.split(vector), self.centres, self.radii, strict=True):
            size = np.linalg.norm(x)
            out.append(centres @ x + size * radii + 1e-9 * (1 + size * (np.linalg.norm(centres, axis=1) + radii)))
        return out

    def cells(self, vector: np.ndarray, least: float | None) -> np.ndarray:
        """The filled cells that the heap visits in the first round (least None), or those after them whose bounds reach least."""
        counts, seen, out = self.layout.counts, 0, []
        for bound, i, j in multi_sequence(*self.bounds(vector)):
            cell, early = i * self.wide + j, seen < FIRST_ROWS
            if not early and (least is None or bound < least):
                break
            if counts[cell] and early == (least is None):
                out.append(cell)
            seen += int(counts[cell])
        return np.array(out, np.int64)


class MultiIndex:
    """rows(id, label, vec) in the cells of a multi-index: codebooks fitted on a bounded sample, radii and counts over all rows."""

    def __init__(self, rows: DataFrame, seed: int = 5):
        n = rows.count()
        size = int(min(MOST_CODES, max(1, round(np.sqrt(n / CELL_ROWS)))))
        codes = self.codes = Codes(matrix(fitted_sample(rows, n, SAMPLE, "vec")["vec"]), size, np.random.default_rng(seed))

        def placed(batches):
            for b in batches:
                if len(b):
                    cell, far = codes.place(matrix(b["vec"]))
                    yield b.assign(cell=cell, left=far[0], right=far[1])

        cells = written(rows.mapInPandas(placed, "id long, label long, vec binary, cell long, left double, right double"), "cells")
        codes.fill(cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("left").alias("left"), F.max("right").alias("right")).toPandas())
        layout = codes.layout

        def dealt(batches):
            for b in batches:
                yield b.assign(shard=layout.shards(b["cell"].to_numpy(), b["id"].to_numpy()))

        self.cells = cells.drop("left", "right").mapInPandas(dealt, "id long, label long, vec binary, cell long, shard long")

    def _round(self, asked: DataFrame, k: int, same: bool, later: bool) -> DataFrame:
        """(query, window, id, score) found in the cells of one round; each window's first k a shard, above what it has to beat."""
        codes = self.codes

        def planned(batches):
            for b in batches:
                rows = []
                for query, vec, least in zip(b["query"], b["vec"], b["least"], strict=True):
                    rows += [(query, *x) for x in codes.layout.visits(codes.cells(np.frombuffer(vec, "<f8"), least if later else None))]
                yield pd.DataFrame(rows, columns=["query", "shard", "cells"])

        def scored(rows, requests):
            query, label, a = requests["query"].to_numpy(), requests["label"].to_numpy(), matrix(requests["vec"])
            n = max(map(len, requests["lows"]), default=0)
            lows, highs = (np.array([[*x, *[fill] * (n - len(x))] for x in requests[c]], np.int64).reshape(-1, n) for c, fill in (("lows", 0), ("highs", -1)))
            out = [pd.DataFrame({"at": [], "id": [], "score": []}, dtype=np.int64)]
            for own, asking in visited(rows, requests):
                ids, scores = own["id"].to_numpy(), products(a[asking], matrix(own["vec"]))
                own_out(scores, query[asking], ids, NONE)
                scores[(own["label"].to_numpy() == label[asking][:, None]) != same] = NONE
                for w in range(n):
                    row, col = candidates(np.where(scores <= highs[asking, w][:, None], scores, NONE), k, lows[asking, w], none=NONE)
                    out.append(pd.DataFrame({"at": asking[row] * n + w, "id": ids[col], "score": scores[row, col].astype(np.int64)}))
            found = pd.concat(out)
            found = found.iloc[first(found["at"].to_numpy(), found["score"].to_numpy(), found["id"].to_numpy(), k)]
            at = found["at"].to_numpy()
            return pd.DataFrame({"query": query[at // max(n, 1)], "window": at % max(n, 1), "id": found["id"], "score": found["score"]})

        visits = written(asked.select("query", "vec", "least").mapInPandas(planned, "query long, shard long, cells array<long>"), "visits")
        requests = visits.join(asked.select("query", "label", "vec", "lows", "highs"), "query")
        return met(self.cells, requests, scored, FOUND)

    def first(self, asked: DataFrame, k: int, same: bool) -> DataFrame:
        """(query, window, rank, id, score): the first k rows in each window of asked(query, label, vec, lows, highs).

        They are others of the query's label, or with same false those of other labels, with scores from lows[window] to highs[window]. Windows without
        room find nothing.
        """
        least = F.expr("array_min(zip_with(lows, highs, (l, h) -> if(l <= h, l, null)))")
        asked = asked.withColumn("least", least).dropna(subset=["least"])
        early = written(self._round(asked, k, same, later=False), "found")
        reached = ranked(early, k).where(F.col("rank") == k).groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("reached"))
        raised = asked.join(reached, "query", "left").withColumn("lows", F.expr("transform(lows, (l, w) -> greatest(l, reached[w]))")).withColumn("least", least)
        late = written(self._round(written(raised.drop("reached"), "asked"), k, same, later=True), "found")
        return ranked(early.union(late), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """Each window's k first: larger scores, then smaller ids."""
    rank = F.row_number().over(Window.partitionBy("query", "window").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def whole(rows: DataFrame, scale: float) -> DataFrame:
    """rows(id, label, vec) with vec as packed whole numbers: floor(scale x)."""

    def each(batches):
        for b in batches:
            x = np.array(b["vec"].tolist(), np.float64).reshape(len(b), -1)
            yield b.assign(vec=packed(np.floor(scale * x)))

    return rows.select("id", "label", "vec").mapInPandas(each, "id long, label long, vec binary")


def hard_negatives(rows: DataFrame, label: Column, asked: str, positives: int = 5, k: int = 10, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(anchor, positive, rank, negative, positive_score, negative_score) for every row, as an anchor, for which the SQL condition asked on id holds.

    A row's score is the inner product of floor(scale x) with the anchor's; larger scores come first, of equal ones the smaller id.
    An anchor's positives are its first others of one label; a pair's negatives its first k of other labels that score LOW to HIGH hundredths
    of the positive; so a positive below zero has none. label is a whole number. Rows with a null id, label, vector or component, or a component that is not finite, take no
    part; rows with one id count as one, that with the smallest (vector, label), and vectors of another length than most have are left
    out. Fewer rows than asked for give all that there are; an anchor without a positive, and an empty table, give no rows. Scores
    beyond 62 bits fail the job.
    """
    taking = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), label.cast("long").alias("label"))
    held = written(whole(usable(taking, "id", "vec", "label"), scale), "vectors")
    index = MultiIndex(held)
    anchors = held.where(asked).select(F.col("id").alias("query"), "label", "vec")
    open_window = [F.array(F.lit(x).cast("long")) for x in (NONE + 1, -NONE)]
    near = index.first(anchors.withColumn("lows", open_window[0]).withColumn("highs", open_window[1]), positives, same=True)
    near = written(near.select("query", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive"), F.col("score").alias("positive_score")), "positives")
    hundred, rest = "(positive_score - pmod(positive_score, 100)) div 100", "pmod(positive_score, 100)"
    low, high = F.expr(f"{LOW} * ({hundred}) + ({LOW} * {rest} + 99) div 100"), F.expr(f"{HIGH} * ({hundred}) + {HIGH} * {rest} div 100")
    windows = near.select("query", F.struct("window", low.alias("low"), high.alias("high")).alias("x")).groupBy("query").agg(F.sort_array(F.collect_list("x")).alias("x"))
    windows = windows.select("query", F.col("x.low").alias("lows"), F.col("x.high").alias("highs"))
    far = index.first(anchors.join(windows, "query"), k, same=False)
    met_ = far.join(near, ["query", "window"])
    return met_.select(F.col("query").alias("anchor"), "positive", "rank", F.col("id").alias("negative"), "positive_score", F.col("score").alias("negative_score"))


def op12(spark, sf_dir):
    """Ten hard negatives for each of the five positives of every embedding whose id is divisible by 100. An empty table gives no rows."""
    label = F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")
    found = hard_negatives(table(spark, sf_dir, "embeddings"), label, "id % 100 = 0")
    return found.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int"), F.col("negative").alias("negative_id"), "positive_score", "negative_score")


OP12_SQL = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, r.id, a.label = r.label AS same,
  CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * r.v[i])) AS BIGINT) AS score
  FROM v a JOIN v r ON a.id <> r.id WHERE a.id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 10
"""
