import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm.cells import Layout
from tallyweave.llm.negatives import hard_negatives, multi_sequence, products
from tallyweave.llm.neighbours import balanced_parts, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, cell long, shard string, vec int"


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, 1, "s", 2) for r in rows], SCHEMA).repartition(parts)


def usable(rows, zero):
    """Rows that take part, one an id, by the docstring."""
    ok = [r for r in rows if None not in r and all(x is not None and math.isfinite(x) for x in r[1]) and (zero or any(r[1]))]
    sizes = [len(r[1]) for r in ok]
    common = max(set(sizes), key=lambda n: (sizes.count(n), n), default=0)
    best = {}
    for i, v, label in ok:
        if len(v) == common:
            best[i] = min(best.get(i, (tuple(v), label)), (tuple(v), label))
    return best


def clusters(n, rng, d=16, copies=0):
    centre = rng.normal(size=(12, d))
    out = [(int(i), [float(np.float32(x)) for x in centre[i * i % 12] + rng.normal(size=d) * 0.4], int(rng.integers(4))) for i in range(n)]
    same = out[0][1]
    return out + [(n + i, list(same), i % 4) for i in range(copies)]


AWKWARD = [(None, [1.0] * 16, 1), (9007199254740993, [0.5] * 16, 2), (100000, None, 1), (100020, [0.0] * 16, 1), (100040, [float("nan")] + [1.0] * 15, 1), (100060, [None] + [1.0] * 15, 1)]
AWKWARD += [(100080, [1.0, 2.0], 1), (100100, [], 1), (100200, [float("inf")] * 16, 1), (300, [1.0] * 16, 1), (300, [0.25] * 16, 2), (300, [0.25] * 16, 2), (400, [1.0] * 16, None)]


def true_neighbours(rows, k):
    best = usable([(i, v, 0) for i, v, _ in rows], zero=False)
    ids = np.array(sorted(best))
    x = np.array([best[i][0] for i in ids])
    out = {}
    for at, i in enumerate(ids):
        if i % 20 == 0:
            score = (x[at] * x).sum(1)
            order = [j for j in np.lexsort((ids, -score)) if j != at][:k]
            out[int(i)] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def check_neighbours(spark, rows, k, least):
    got = {}
    for x in nearest(frame(spark, rows), "id % 20 = 0", k).orderBy("query", "rank").collect():
        got.setdefault(x["query"], []).append((x["id"], x["score"]))
        assert x["rank"] == len(got[x["query"]])
    want = true_neighbours(rows, k)
    assert set(got) == {q for q in want if want[q]} and all(len(got[q]) == len(want[q]) for q in got)
    best = usable([(i, v, 0) for i, v, _ in rows], zero=False)
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0])) and q not in [i for i, _ in found]
        assert all(abs(math.fsum(a * b for a, b in zip(best[q][0], best[i][0], strict=True)) - s) <= 1e-12 * max(1, abs(s)) for i, s in found)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in got)
    assert hits >= least * sum(len(want[q]) for q in got), hits / sum(len(want[q]) for q in got)


def test_neighbours_of_clusters_copies_and_awkward_rows(spark):
    rng = np.random.default_rng(1)
    rows = clusters(4000, rng)
    check_neighbours(spark, rows + AWKWARD, 20, 0.9)
    lengths = [(i, [float(np.float32(x * (1 + i % 7))) for x in v], c) for i, v, c in rows[:1500]]  # inner products, not angles
    check_neighbours(spark, lengths, 20, 0.9)


def test_a_third_of_all_rows_with_one_vector(spark):
    check_neighbours(spark, clusters(1000, np.random.default_rng(2), copies=500), 20, 0.9)


def test_neighbours_without_structure(spark):
    x = np.random.default_rng(3).normal(size=(3000, 64)).astype(np.float32)
    check_neighbours(spark, [(i, [float(c) for c in v], 0) for i, v in enumerate(x)], 20, 0.9)


def test_small_and_empty_tables(spark):
    for rows in ([], AWKWARD[:3], [(20, [1.0], 0)], [(0, [1.0, 0.0], 0), (20, [1.0, 0.0], 1), (21, [1.0, 0.0], 1)]):
        check_neighbours(spark, rows, 2, 1.0)
        assert negatives(spark, rows) == plain_negatives(rows)


def test_parts_of_the_graph_are_balanced():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(300, 8)) * 0.01, rng.normal(size=(300, 8)) + 3])
    near = np.argsort(-(x @ x.T), axis=1)[:, 1:9]
    sizes = np.bincount(balanced_parts(x, near, 8, rng), minlength=8)
    assert sizes.max() <= math.ceil(1.1 * 600 / 8)


def plain_negatives(rows, scale=256.0):
    best = {i: ([math.floor(scale * x) for x in v], label) for i, (v, label) in usable(rows, zero=True).items()}
    best = {i: (v, (label + 1) % 10 if i % 7 == 0 else label) for i, (v, label) in best.items()}
    out = []
    for a in (i for i in best if i % 100 == 0):
        score = {i: sum(p * q for p, q in zip(best[a][0], v, strict=True)) for i, (v, _) in best.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if best[i][1] == best[a][1]][:5]:
            window = [i for i in order if best[i][1] != best[a][1] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]][:10]
            out += [(a, p, n + 1, i, score[p], score[i]) for n, i in enumerate(window)]
    return sorted(out)


def negatives(spark, rows, scale=256.0):
    label = F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")
    return sorted(tuple(x) for x in hard_negatives(frame(spark, rows), label, "id % 100 = 0", scale=scale).collect())


def test_negatives_match_brute_force_over_awkward_rows_and_copies(spark):
    rows = clusters(5000, np.random.default_rng(5), copies=1200) + AWKWARD
    assert negatives(spark, rows) == plain_negatives(rows)


def test_negatives_match_brute_force_without_structure_and_in_one_dimension(spark):
    x = np.random.default_rng(6).normal(size=(2500, 24)).astype(np.float32)
    rows = [(i, [float(c) for c in v], i % 3) for i, v in enumerate(x)]
    assert negatives(spark, rows) == plain_negatives(rows)
    line = [(i * 10, [float((i * 37 % 101) - 50)], i % 3) for i in range(600)]  # ties, zeros and negative scores
    assert negatives(spark, line) == plain_negatives(line)


def test_scores_beyond_doubles_are_exact(spark):
    rng = np.random.default_rng(7)
    rows = [(i * 20, [float(x) for x in rng.integers(-9, 9, 4) * 2.0**18 + 1], i % 2) for i in range(300)]
    assert negatives(spark, rows) == plain_negatives(rows)
    with pytest.raises(ValueError):
        products(np.full((1, 2), 2.0**31), np.full((1, 2), 2.0**31))


def test_heap_visits_all_pairs_by_falling_bounds():
    rng = np.random.default_rng(8)
    u, v = rng.integers(0, 5, 7).astype(float), rng.normal(size=5)
    got = list(multi_sequence(u, v))
    assert sorted((i, j) for _, i, j in got) == [(i, j) for i in range(7) for j in range(5)]
    assert [b for b, _, _ in got] == sorted((u[:, None] + v).ravel().tolist(), reverse=True)


def test_layout_keeps_shards_bounded_and_visits_every_row_once():
    counts = np.array([0, 5, 300, 1000, 7, 0, 99, 100, 1])
    layout, ids = Layout(counts, 100), np.arange(counts.sum())
    cells = np.repeat(np.arange(len(counts)), counts)
    shards = layout.shards(cells, ids)
    assert np.bincount(shards).max() <= 160
    asked = dict(layout.visits(np.array([0, 2, 3, 6, 8])))
    assert {(s, c) for s, cs in asked.items() for c in cs} >= {(s, c) for s, c in zip(shards, cells, strict=True) if c in (2, 3, 6, 8)}
    assert all(set(cs) <= {2, 3, 6, 8} for cs in asked.values())
