import random
import re

import numpy as np

from tallyweave.llm import decontamination
from tallyweave.llm.decontamination import cleaned, contamination
from tallyweave.llm.fmindex import FMIndex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def plain(docs, items, window):
    out = []
    for d, t in docs:
        w, hit, found = WORD.findall(lower(t)), set(), set()
        for item, text in items:
            p = WORD.findall(lower(text))
            for i in range(max(1, len(p) - window + 1) if p else 0):
                k = p[i : i + window]
                for j in range(len(w) - len(k) + 1):
                    if w[j : j + len(k)] == k:
                        hit |= set(range(j, j + len(k)))
                        found.add(str(item))
        out.append((d, len(w), len(hit), tuple(sorted(found))))
    return sorted(out)


def data(r):
    vocab = ["Aa", "bé", "c1", "d", "out", "Zz"]
    items = [(i, " ".join(r.choices(vocab[:4], k=n))) for i, n in enumerate((1, 2, 3, 4, 5, 9, 0, 12))] + [(11, None), (12, "d! d? d"), (100, "c1 c1")]
    docs = [(i, ", ".join(r.choices(vocab, k=r.randrange(40)))) for i in range(80)] + [(200, None), (201, ""), (202, "d " * 4000), (202, "repeated d d d id")]
    return docs, items


def test_matches_brute_force_in_one_and_in_many_blocks_and_shards(spark, monkeypatch):
    docs, items = data(random.Random(5))
    left = spark.createDataFrame([(d, t, "x", 3) for d, t in docs], "doc_id long, text string, spans string, item int").repartition(2)
    right = spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items, 3)
    for block, shard in ((1 << 20, 1 << 19), (20, 50)):
        monkeypatch.setattr(decontamination, "BLOCK_CHARS", block)
        monkeypatch.setattr(decontamination, "SHARD_SYMBOLS", shard)
        found = contamination(left, right, window=3).collect()
        assert sorted((x.id, x.n_words, x.n_hit, tuple(x["items"])) for x in found) == want
    for x in found:
        assert len(WORD.findall(lower(x.clean))) == x.n_words - x.n_hit or x.n_hit
        if not x.n_hit:
            assert x.clean == x.text
    assert contamination(left.limit(0), right).collect() == []
    assert all(x.n_hit == 0 for x in contamination(left, right.limit(0)).collect())


def test_clean_text_keeps_what_lies_outside(spark):
    left = spark.createDataFrame([(1, "Keep, THIS! one two, three four. And that.")], "doc_id long, text string")
    right = spark.createDataFrame([(7, "one two three four")], "item_id long, text string")
    assert [x.clean for x in contamination(left, right).collect()] == ["Keep, THIS! . And that."]


def test_index_finds_every_place():
    r = np.random.default_rng(1)
    text = r.integers(1, 4, 3000)
    text[r.choice(3000, 200, replace=False)] = 0
    text[-1] = 0
    text = text[np.concatenate([[text[0] > 0], (text[1:] > 0) | (text[:-1] > 0)])]
    index = FMIndex(text, 3)
    phrases = np.zeros((60, 5), np.int64)
    lengths = r.integers(1, 6, 60)
    for i, n in enumerate(lengths):
        phrases[i, :n] = r.integers(1, 4, n)
    low, high = index.search(phrases, lengths)
    for i, n in enumerate(lengths):
        want = [j for j in range(len(text) - n + 1) if (text[j : j + n] == phrases[i, :n]).all()]
        assert sorted(index.locate(np.arange(low[i], max(low[i], high[i])))) == want


def test_null_ids_of_documents_and_items_are_worked(spark):
    docs = spark.createDataFrame([(None, "keep one two three and four five", 9), (None, "alone", 9), (3, "one two three", 9), (3, "four five", 9), (4, None, None)], "doc_id long, text string, n_chars long")
    items = spark.createDataFrame([(None, "one two three"), (8, "four five"), (None, "four five"), (9, None)], "item_id long, text string")
    found = {(x.id, x.text): (x.n_hit, x["items"]) for x in contamination(docs, items).collect()}
    assert found == {(None, "keep one two three and four five"): (5, ["8", None]), (None, "alone"): (0, []), (3, "one two three"): (3, [None]), (3, "four five"): (2, ["8", None]), (4, None): (0, [])}
    out = sorted(((x.doc_id or 0, x.text, x.n_chars) for x in cleaned(docs, items).collect()), key=str)
    assert out == sorted([(0, "keep  and ", 10), (0, "alone", 5), (3, "", 0), (3, "", 0), (4, None, None)], key=str)


def test_query_agrees_with_its_sql_on_null_ids(spark, tmp_path):
    import duckdb

    spark.createDataFrame([(1, "keep one two three and four five"), (2, "one two three"), (3, "none"), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, "one two three"), (8, "four five"), (None, "four five"), (9, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = sorted(db.execute(decontamination.OP7_SQL).fetchall())
    assert sorted(tuple(x) for x in decontamination.op7(spark, str(tmp_path)).collect()) == want
