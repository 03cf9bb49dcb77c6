import random

from tallyweave.llm.jaccard import jaccard, shingles, survivors


def plain(rows):
    """The ids that stay: the smallest of each component of pairs at 0.8 or more, null last."""
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and jaccard(sets[i], sets[j]) >= 0.8:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return sorted((min((d is None, d or 0) for (d, _), x in zip(rows, label, strict=True) if x == k) for k in set(label)))


def test_survivors_hold_against_brute_force_at_many_similarities(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows, at = [], 0
    for n in (7, 30, 60, 120, 250, 400):
        base = r.choices(words, k=n)
        for k in range(40):
            w = list(base)
            for _ in range(r.randrange(1 + n // 20)):
                w[r.randrange(n)] = r.choice(words)
            rows.append((1000 - at, " ".join(w[: n - k % 3])))
            at += 1
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "One two"), (2004, "one TWO"), (None, rows[0][1] + " end"), (None, "null and alone"), (2005, rows[50][1])]
    table = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, lang string").repartition(3)
    out = survivors(table)
    assert out.columns == table.columns
    left, want = [(x.doc_id is None, x.doc_id or 0) for x in out.collect()], plain(rows)
    assert set(want) <= set(left)  # no row goes that brute force keeps
    assert len(rows) - len(left) >= 0.98 * (len(rows) - len(want))
    assert survivors(table.limit(0)).collect() == []


def test_halves_one_bit_apart_meet_at_an_anchor(spark):
    from tallyweave.llm.simhash import near_parts

    r = random.Random(2)
    rows = set()
    for part in range(3):
        for _ in range(40):
            half = r.getrandbits(32)
            rows |= {(part, half), (part, half ^ 1 << r.randrange(32)), ((part + 1) % 3, half ^ 1), (part, half ^ 3 << r.randrange(31))}
    want = {(p, a, b) for p, a in rows for q, b in rows if p == q and a < b and bin(a ^ b).count("1") == 1}
    got = {tuple(x) for x in near_parts(spark.createDataFrame(sorted(rows), "part int, half long").repartition(2)).collect()}
    assert got == want and len(want) > 60


def test_every_pair_that_is_alone_is_found(spark):
    r = random.Random(8)
    rows, kind = [], {}
    for i in range(240):
        w = [f"w{r.randrange(5000)}" for _ in range(200)]
        rows.append((2 * i, " ".join(w)))
        edits = 1 + i % 6
        for at in r.sample(range(5, 195), edits):
            w[at] = f"changed{at}"
        rows.append((2 * i + 1, " ".join(w)))
        kind[2 * i + 1] = jaccard(shingles(rows[-2][1]), shingles(rows[-1][1]))
    left = {x.doc_id for x in survivors(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert {2 * i for i in range(240)} <= left
    assert {d for d in kind if d not in left} == {d for d, j in kind.items() if j >= 0.8}
    assert {j >= 0.8 for j in kind.values()} == {True, False}


def test_different_texts_of_one_id_stay(spark):
    rows = [(1, "first text of this id with words of its own"), (1, "and quite another text that says something else"), (2, "first text of this id with words of its own"), (1, "first text of this id with words of its own")]
    out = survivors(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.text) for x in out) == sorted(set(rows[:2]))


def test_no_link_of_a_crowd_around_the_threshold_is_left_out(spark):
    r = random.Random(5)
    base, rows = [f"w{i}" for i in range(105)], []
    for i in range(200):
        w = list(base)
        first, *others = r.sample(range(10, 95), 3)
        w[first] = f"x{i}"
        for at in others:
            v = list(w)
            v[at] = f"y{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(v)))
    out = survivors(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert [(False, d) for d in sorted(x.doc_id for x in out.collect())] == plain(rows)


def test_texts_of_a_bucket_that_stay_apart_are_no_row_a_pair(spark, monkeypatch):
    from tallyweave.llm import jaccard as module

    made, write = [], module.written

    def counted(df, label):
        out = write(df, label)
        made.append(out.count())
        return out

    r = random.Random(6)
    base, rows = [f"w{i}" for i in range(100)], []
    for i in range(300):  # most pairs are near 0.7, some at 0.8 or more
        w = list(base)
        for at in r.sample(range(6, 94, 6), 2):
            w[at] = f"x{i}"
        rows.append((i, " ".join(w)))
        if i % 10 == 0:
            rows.append((1000 + i, " ".join([*w[:-1], "end"])))
    monkeypatch.setattr(module, "written", counted)
    monkeypatch.setattr(module, "BLOCK", 100_000, raising=False)  # six blocks and more
    out = survivors(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert [(False, d) for d in sorted(x.doc_id for x in out.collect())] == plain(rows)
    bands, _ = module.bands_for(0.8, rows=module.ROWS)
    assert max(made) <= bands * len(rows) < len(rows) ** 2 // 4


def test_texts_are_not_broadcast(spark, tmp_path, monkeypatch):
    # near copies take little room in their files, and much in a driver that broadcasts them
    from tallyweave.llm import jaccard as module

    spark.range(50).selectExpr("unhex(md5(cast(id as string))) key", "concat(repeat('a b c d e f g h i j k l ', 20), id) text").write.parquet(f"{tmp_path}/texts")
    texts, plans = spark.read.parquet(f"{tmp_path}/texts"), []
    pairs = texts.crossJoin(texts.selectExpr("key b")).where("key < b").selectExpr("key a", "b")
    write = module.written
    monkeypatch.setattr(module, "written", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, label))
    assert module.compared(pairs, texts, 5, 0.8).count() == 50 * 49 // 2
    assert "BroadcastHashJoin" not in plans[-1] and plans[-1].count("SortMergeJoin") == 2
