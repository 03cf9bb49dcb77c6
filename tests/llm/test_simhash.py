import random

import xxhash

from tallyweave.llm.simhash import fingerprint, links, near_duplicates, near_parts


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def plain_components(rows):
    fp = [plain_fingerprint(t) for _, t in rows]
    label = [d for d, _ in rows]
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(fp[i] ^ fp[j]).count("1") <= 2 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return {(rows[i][0], f"{fp[i]:016x}", label[i]) for i in range(len(rows))}


def test_fingerprint_matches_plain_form():
    texts = [None, "", "  \n", "One", "a B", "Ünï É A B c d e", "x " * 5000 + "y z", "A b c d e F G"]
    assert [fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_components_match_brute_force_with_ties_nulls_and_extra_columns(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(r.choices(words, k=n)) for n in (3, 8, 40, 300, 300, 900)]
    rows = [(i, t) for i, t in enumerate([None, "", " ", *base, *base])]
    for i in range(60):
        w = r.choice(base).split()
        w[r.randrange(len(w))] = r.choice(words)
        rows.append((100 - i, " ".join(w)))
    docs = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, fp string, component int")
    found = {tuple(x) for x in near_duplicates(docs).collect()}
    assert found == plain_components(rows)
    assert near_duplicates(docs.limit(0)).collect() == []


def test_no_link_is_lost_between_different_fingerprints(spark):
    r = random.Random(2)
    centre = [r.getrandbits(64) for _ in range(20)]
    values = {c ^ sum(1 << b for b in r.sample(range(64), r.randrange(4))) for c in centre for _ in range(40)} | {0, 1, 3, 2**64 - 1, 2**63}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    found = {tuple(x) for x in links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    assert found == want


def test_replicas_are_not_broadcast(spark, tmp_path):
    # sized by their files, where nothing is replicated yet, they would seem small
    spark.range(1000).selectExpr("id * 7 fp", "0L part", "id half").write.parquet(f"{tmp_path}/fps")
    fps = spark.read.parquet(f"{tmp_path}/fps")
    for found in (links(fps), near_parts(fps)):
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
