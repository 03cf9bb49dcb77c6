"""Vectors in cells, and searches of cells: what the vector operators share.

Rows lie in cells. Small neighbouring cells share a shard, a crowded cell is dealt over several, so no shard outgrows its bound whatever the
skew. A request names the cells that it visits; it goes to their shards only, and a shard asked by very many meets them in several groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a shard, requests of one group, and requests scored at once.
SHARD_ROWS, GROUP_REQUESTS, TOGETHER = 4096, 4096, 512
#: Inner products of whole numbers below this are exact in a double.
EXACT = 1 << 53


def usable(rows: DataFrame, id_col: str, vec_col: str, *carried: str, zero: bool = True) -> DataFrame:
    """(id, vec, carried) of the rows that take part, one an id.

    Rows with a null id, a null carried value or vector, or a null or non-finite component are left out, and unless zero is allowed
    those with no component but zeros. Of rows with one id that with the smallest (vec, carried) stays. Vectors have the length that most
    have, the larger of two as frequent; others are left out, as nothing measures them against these.
    """
    out = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), *carried).dropna(subset=["id", "vec", *carried])
    out = out.where("not exists(vec, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    if not zero:
        out = out.where("exists(vec, x -> x <> 0)")
    common = out.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).select("n").first()
    out = out.where(F.size("vec") == (common["n"] if common else 0))
    one = out.groupBy("id").agg(F.min(F.struct("vec", *carried)).alias("x"))
    return one.select("id", "x.*")


def matrix(vectors: pd.Series) -> np.ndarray:
    """Packed vectors as rows of doubles."""
    return np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))


def packed(vectors: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in np.ascontiguousarray(vectors, "<f8")]


def fitted_sample(rows: DataFrame, n: int, most: int, *columns: str) -> pd.DataFrame:
    """About so many of the n rows at most, chosen by a hash of their ids, in that hash's order. This is all that a model sees."""
    part = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)).alias("h")
    chosen = rows.select(part, *columns)
    if n > most:
        chosen = chosen.where(F.col("h") < int((1 << 30) * (most / n)))
    return chosen.toPandas().sort_values("h", kind="stable").head(most).reset_index(drop=True)


class Layout:
    """Where cells lie: cell c in shards base[c] to base[c] + spread[c] - 1. counts: rows of each cell."""

    def __init__(self, counts: np.ndarray, rows: int = SHARD_ROWS):
        self.counts = counts
        self.spread = np.maximum(1, -(-counts // rows))
        self.base = np.zeros(len(counts), np.int64)
        shard, room = 0, rows
        for c in np.flatnonzero(counts):
            if counts[c] > room and room < rows:
                shard, room = shard + 1, rows
            self.base[c] = shard
            shard, room = (shard + int(self.spread[c]), rows) if self.spread[c] > 1 else (shard, room - int(counts[c]))

    def shards(self, cells: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The shards of rows in these cells; a crowded cell's rows are dealt by their ids."""
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return self.base[cells] + (mixed % self.spread[cells].astype(np.uint64)).astype(np.int64)

    def visits(self, cells: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, its cells among these) of every shard that must be asked; empty cells need none."""
        cells = cells[self.counts[cells] > 0]
        n = self.spread[cells]
        shard = np.repeat(self.base[cells], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        order, cell = np.argsort(shard, kind="stable"), np.repeat(cells, n)
        starts = np.flatnonzero(np.diff(shard[order], prepend=-1))
        for part in np.split(order, starts[1:]) if len(order) else ():
            yield int(shard[part[0]]), np.sort(cell[part])


def met(rows: DataFrame, requests: DataFrame, search, schema: str) -> DataFrame:
    """search(rows, requests) of every shard: rows(shard, ...) that are asked for meet the requests(shard, query, ...) that visit them."""
    dealt = requests.groupBy("shard").agg(F.ceil(F.count("*") / GROUP_REQUESTS).alias("groups"))
    asked = rows.join(dealt, "shard").withColumn("group", F.explode(F.expr("sequence(0, int(groups) - 1)"))).drop("groups")
    asking = requests.join(dealt, "shard").withColumn("group", F.expr("int(pmod(xxhash64(query), groups))")).drop("groups")
    return asked.groupBy("shard", "group").cogroup(asking.groupBy("shard", "group")).applyInPandas(search, schema)


def visited(rows: pd.DataFrame, requests: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(a cell's rows by ascending id, the places of the requests that visit it, some at a time) for every cell of a shard."""
    n = np.array([len(c) for c in requests["cells"]], np.int64)
    cells = np.concatenate([*requests["cells"], np.zeros(0, np.int64)]).astype(np.int64)
    who = np.repeat(np.arange(len(requests)), n)
    for cell, own in rows.sort_values("id").groupby("cell"):
        asking = who[cells == cell]
        for i in range(0, len(asking), TOGETHER):
            yield own, asking[i : i + TOGETHER]


def own_out(scores: np.ndarray, queries: np.ndarray, ids: np.ndarray, none: float = -np.inf) -> None:
    """A query does not find itself. ids ascend."""
    at = np.minimum(np.searchsorted(ids, queries), len(ids) - 1)
    hit = np.flatnonzero(ids[at] == queries)
    scores[hit, at[hit]] = none


def candidates(scores: np.ndarray, k: int, least: np.ndarray, slack: np.ndarray | None = None, none: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of all scores above none that reach both least and, less slack, their row's k-th: k a row, and more where some are equal."""
    bar = least
    if scores.shape[1] > k:
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        bar = np.maximum(least, kth if slack is None else np.where(np.isfinite(kth), kth - slack, kth))
    return np.nonzero((scores >= bar[:, None]) & (scores > none))


def first(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of each query's k first: larger scores, then smaller ids."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    start = np.flatnonzero(np.diff(q, prepend=-1))
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[rank < k]
