import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tallyweave.llm.substring import first_length, smallest, without_repeats


def plain(rows, window):
    words = {d: [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t or "").split(" ") if w] for d, t in rows}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = set()
    for d, w in words.items():
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        out.add((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def rows(r):
    vocab = ["a", "b", "É", "dd", "x y"]
    passage = [" ".join(r.choices(vocab, k=n)) for n in (6, 9, 14, 40)]
    out = [(3, None), (4, ""), (5, "\n\t"), (6, "a " * 5000), (2, "a " * 300), (90, passage[3]), (1, passage[3])]
    for i in range(60):
        out.append((10 + i, " ".join([*r.choices(vocab, k=r.randrange(12)), r.choice(passage), *r.choices(vocab, k=r.randrange(9))])))
    return out


def test_matches_brute_force(spark):
    for window in (7, 12):
        data = rows(random.Random(window))
        docs = spark.createDataFrame([(d, t, 1, "x") for d, t in data], "doc_id long, text string, starts int, h string").repartition(3)
        found = {tuple(x) for x in without_repeats(docs, window=window).collect()}
        assert found == plain(data, window)
    assert without_repeats(docs.limit(0)).collect() == []


def test_every_level_of_doubling_is_exact(spark):
    for window, least in ((12, 2), (13, 1), (24, 3)):
        data = rows(random.Random(window))
        docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
        assert {tuple(x) for x in without_repeats(docs, window=window, least=least).collect()} == plain(data, window)
    assert [first_length(50, 20), first_length(50, 6), first_length(200, 20), first_length(2, 20)] == [25, 6, 25, 1]


def test_half_windows_of_equal_windows_are_equal():
    r = np.random.default_rng(0)
    h = r.integers(0, 6, 400).astype(np.uint64)
    for w in (1, 2, 5, 26):
        assert list(smallest(h, w)) == [i + int(np.argmin(h[i : i + w])) for i in range(len(h) - w + 1)]


def test_digest_column(spark):
    docs = spark.createDataFrame([(0, "p q  r"), (1, None)], "doc_id long, text string")
    got = {x.id: x.k for x in without_repeats(docs).select("id", F.sha2("kept", 256).alias("k")).collect()}
    assert got == {0: hashlib.sha256(b"p q r").hexdigest(), 1: hashlib.sha256(b"").hexdigest()}
