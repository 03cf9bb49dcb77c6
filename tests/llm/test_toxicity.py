import random
import zlib

import numpy as np

from tallyweave.llm.toxicity import fit, held_out, score


def corpus(r, n):
    calm, bad = [f"calm{i}" for i in range(300)], [f"vile{i}" for i in range(6)]
    docs, labels = [], []
    for i in range(n):
        parts = [" ".join(r.choices(calm, k=8)) for _ in range(r.randrange(1, 9))]
        toxic = i % 4 == 0
        if toxic:
            at = r.randrange(len(parts))
            parts[at] += f" {r.choice(bad)} {r.choice(bad)}"
        docs.append((i, ". ".join(parts)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_learns_from_documents_and_finds_the_sentence(spark):
    docs, labels = corpus(random.Random(3), 800)
    docs += [(9000, None), (9001, ""), (9002, "?!"), (9003, "calm1 " * 30000), (9003, "calm2")]
    table = spark.createDataFrame([(d, t, 0.5, "x") for d, t in docs], "doc_id long, text string, score double, spans string").repartition(3)
    marks = spark.createDataFrame([*labels, labels[0], (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = fit(table, marks, max_toxic=120, max_clean=300)
    found = {x.id: x for x in score(table, model).collect()}
    text, toxic = dict(docs), {d: t for d, _, t in labels}
    out = [d for d in toxic if zlib.crc32(str(d).encode()) % 4 == 2]
    right = sum((found[d].score >= 0.3) == bool(toxic[d]) for d in out)
    assert right >= 0.97 * len(out)
    hits = [(d, s) for d in out if toxic[d] for s in found[d].spans]
    assert hits and all("vile" in text[d][s.start : s.end] for d, s in hits)
    assert [found[d].score for d in (9000, 9001, 9002)] == [0.0] * 3
    assert all(0 <= x.score <= 1 for x in found.values())
    assert score(table.limit(0), model).collect() == []


def test_held_out_rule_and_constant_models(spark):
    ids = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long")
    assert all(x.h == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in ids.select("doc_id", held_out().alias("h")).collect())
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert not np.any(none.weights) and score(docs, none).first().score < 0.3
