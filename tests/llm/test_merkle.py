import hashlib
import random
import zlib

from pyspark.sql import functions as F

from tallyweave.llm.merkle import FIELDS, field_digest, folded, manifest

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, digest int, tree string, _at int"


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def leaf(row):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def path(tree, i):
    """(left, right) of each level."""
    for level in tree[:-1]:
        first = i // 3 * 3
        yield level[first:i], level[i + 1 : first + 3]
        i //= 3


def plain(rows):
    """The contract, row by row in one process."""
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: levels([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in order}
    top = levels([built[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, _, digest, row) in enumerate(sorted(trees[s], key=lambda x: x[:3])):
            steps = [*path(built[s], i), *path(top, k)]
            even = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            cur = leaf([*row[:4], row[4].replace("\n", "") if even and row[4] is not None else row[4]])
            for left, right in steps:
                cur = sha("".join(left) + cur + "".join(right))
            siblings = sha("".join(x for left, right in steps for x in left + right))
            out.append((row[0], digest, built[s][-1][0], top[-1][0], siblings, cur, cur == top[-1][0]))
    return out


def found(spark, rows, parts=3):
    docs = spark.createDataFrame([(*r, 0, "t", 1) for r in rows], COLUMNS).repartition(parts)
    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    seen = field_digest(*(cut if c == "text" else F.col(c) for c in FIELDS))
    return manifest(docs, field_digest(*map(F.col, FIELDS)), seen).collect()


def key(rows):
    return sorted(map(str, rows))


def digests(rows):
    return key((x.id, x.digest, x.subroot, x.root, sha(x.proof.replace("/", "").replace(".", "")), x.folded, x.verified) for x in rows)


def test_manifest_matches_plain_form_over_hot_tiny_null_and_repeated_rows(spark):
    r = random.Random(3)
    text = lambda: "".join(r.choice("ab \né") for _ in range(r.randrange(30)))
    rows = [(i * 7 + 1, "hot", "de", i, text()) for i in range(2300)]  # several superblocks, the last with a single run
    rows += [(i, f"s{i:04d}", None, None, "x\ny") for i in range(800)]  # more trees than a superblock has nodes
    rows += [(9007199254740993, None, "en", 1, "big\nid"), (None, None, None, None, None), (None, "hot", "en", 0, ""), (5, "é", "en", 2, "\n"), (5, "z" * 300, "en", 2, "y\n" * 200000)]
    rows += [(77, "twins", "en", 3, "same\n")] * 5 + [(77, "twins", "en", 3, "other\n")] * 2
    got = found(spark, rows)
    assert digests(got) == key(plain(rows))
    assert {x.verified for x in got} == {True, False}
    for x in got[::97]:
        assert folded(x.digest, x.proof) == x.root
        assert not x.proof or folded("0" * 64, x.proof) != x.root


def test_small_and_empty_tables(spark):
    for rows in ([], [(1, "a", "en", 1, "x")], [(4, "a", "en", 1, "x"), (2, "b", None, None, "\n")], [(None, None, None, None, None)] * 4):
        assert digests(found(spark, rows, 1)) == key(plain(rows))


def test_exactly_full_superblocks(spark):
    rows = [(i, "full", "en", 1, str(i)) for i in range(729)] + [(i, "over", "en", 1, str(i)) for i in range(730)]
    assert digests(found(spark, rows)) == key(plain(rows))
