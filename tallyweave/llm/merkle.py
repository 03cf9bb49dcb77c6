"""A Merkle manifest of a table: a root over all rows, a proof for each row, and a check of what was received against them.

Rows are leaves. Each tree's leaves stand in order; every three neighbours become the digest of their hex digests, level by
level, until one is left: the tree's subroot. Subroots, in the order of their trees, become the root in the same way.

A tree is cut into superblocks of 3**6 neighbouring nodes; small trees share one. A first pass reduces each superblock to its
node six levels up, and those nodes are cut and reduced again, so a hot tree is many groups and a table of any size takes few passes.
On the way down each superblock's own nodes are cogrouped with the outer nodes that its proofs need: one applyInPandas finishes the
local reduction, joins the local proof to the outer one, and folds what was received up to the root.

A proof is text: the levels from the leaf up, parted by "/"; in each the digests of the run's other nodes, a "." where the node itself stands.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

FANOUT, LEVELS = 3, 6
BLOCK = FANOUT**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree long, n long, pos long, digest string"


def field_digest(*fields: Column) -> Column:
    """Hex sha256 of the fields, each as its UTF-8 byte count, a colon and its text, or as a dash where it is null."""

    def encoded(c: Column) -> Column:
        text = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*map(encoded, fields)), 256)


def node(children: str) -> str:
    return hashlib.sha256(children.encode()).hexdigest()


def folded(digest: str, proof: str) -> str:
    """The root that a leaf and its proof lead to."""
    for step in filter(None, proof.split("/")):
        left, right = step.split(".")
        digest = node(left + digest + right)
    return digest


def _height(n: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def _levels(digests: list[str], n: int) -> list[list[str]]:
    """A superblock's nodes, level by level up to the one that it becomes; n: all nodes of its tree in the lowest of these levels."""
    out = [digests]
    for _ in range(min(LEVELS, _height(n))):
        below = out[-1]
        out.append([node("".join(below[i : i + FANOUT])) for i in range(0, len(below), FANOUT)])
    return out


def _proofs(levels: list[list[str]], outer: str) -> list[str]:
    """The whole proof of each of the lowest nodes, where outer is that of the highest."""
    above = [outer]
    for below in reversed(levels[:-1]):
        here = []
        for i in range(len(below)):
            first = i - i % FANOUT
            step = "".join(below[first:i]) + "." + "".join(below[i + 1 : first + FANOUT])
            here.append("/".join(filter(None, (step, above[i // FANOUT]))))
        above = here
    return above


def positioned(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows with (tree, n, pos): its tree as a number that follows the trees' order, that tree's rows, and the row's place among them from 0.

    Rows are dealt by range and numbered in their partition; the sizes of a tree's parts, one row a partition, are summed up. Nulls come first.
    """
    laid = rows.withColumnRenamed(tree, "_tree")
    order = ["_tree", *(c for c in order if c != tree)]
    laid = laid.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    laid = written(laid, "laid").withColumn("_part", F.shiftright("_at", 33))
    parts = laid.groupBy("_tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_here"))
    own, before = Window.partitionBy("_tree"), Window.partitionBy("_tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        F.col("_tree").alias("_t"),
        F.col("_part").alias("_p"),
        (F.coalesce(F.sum("_here").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.min("_first").over(own).alias("tree"),
        F.sum("_here").over(own).alias("n"),
    )
    met = laid.join(parts, laid["_tree"].eqNullSafe(parts["_t"]) & (laid["_part"] == parts["_p"]))
    return met.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_tree", "_t", "_p", "_part", "_at", "_shift")


def _superblocks(nodes: DataFrame) -> DataFrame:
    """nodes with (bundle, block): a large tree is cut every BLOCK nodes, small trees that begin near each other share a bundle."""
    large = F.col("n") > BLOCK
    return nodes.withColumn("bundle", F.when(large, F.col("tree")).otherwise(F.expr(f"-1 - tree div {BLOCK}"))).withColumn(
        "block", F.when(large, F.expr(f"pos div {BLOCK}")).otherwise(F.lit(0).cast("long"))
    )


def _trees(nodes: pd.DataFrame):
    """(tree, n, its nodes in order) of a superblock."""
    for tree, rows in nodes.sort_values(["tree", "pos"]).groupby("tree", sort=False):
        yield tree, int(rows["n"].iloc[0]), rows


def _up(nodes: DataFrame) -> DataFrame:
    """The nodes that the superblocks become, with the (bundle, block) that each came from."""

    def reduce(key, nodes):
        rows = [(tree, -(-n // BLOCK), key[1], _levels(list(rows["digest"]), n)[-1][0], *key) for tree, n, rows in _trees(nodes)]
        return pd.DataFrame(rows, columns=["tree", "n", "pos", "digest", "bundle", "block"])

    return _superblocks(nodes.select("tree", "n", "pos", "digest")).groupBy("bundle", "block").applyInPandas(reduce, f"{NODE}, bundle long, block long")


def _exchanged(nodes: DataFrame, above: DataFrame, carried: dict[str, str]) -> DataFrame:
    """(carried, digest, subroot, root, proof, folded) of nodes; above(bundle, block, tree, subroot, root, proof) has what each superblock became."""
    columns = [*carried, "digest", "subroot", "root", "proof", "folded"]

    def finish(nodes, outer):
        outer = {x.tree: x for x in outer.itertuples()}
        parts = []
        for tree, n, rows in _trees(nodes):
            levels, high, roots = _levels(list(rows["digest"]), n), outer[tree], {}
            proofs = _proofs(levels, high.proof)

            def fold(level: int, i: int, digest: str, levels=levels, high=high, roots=roots) -> str:
                if (level, i, digest) not in roots:
                    if level == len(levels) - 1:
                        roots[level, i, digest] = folded(digest, high.proof)
                    else:
                        first, run = i - i % FANOUT, levels[level]
                        up = node("".join(run[first:i]) + digest + "".join(run[i + 1 : first + FANOUT]))
                        roots[level, i, digest] = fold(level + 1, i // FANOUT, up)
                return roots[level, i, digest]

            seen = rows["seen"].where(rows["seen"].notna(), rows["digest"]) if "seen" in rows else rows["digest"]
            root_of = [fold(0, i, x) for i, x in enumerate(seen)]
            parts.append(rows.assign(subroot=high.subroot or "", root=high.root, proof=proofs, folded=root_of)[columns])
        return pd.concat(parts) if parts else pd.DataFrame(columns=columns)

    schema = ", ".join([f"{c} {t}" for c, t in carried.items()] + [f"{c} string" for c in columns[len(carried) :]])
    mine = _superblocks(nodes).groupBy("bundle", "block")
    return mine.cogroup(above.groupBy("bundle", "block")).applyInPandas(finish, schema)


def _climbed(leaves: DataFrame) -> list[DataFrame]:
    """The layers from the leaves up to that in which every tree is one node."""
    layers = [leaves]
    while layers[-1].where("n > 1").limit(1).count():
        layers.append(written(_up(layers[-1]), "layer"))
    return layers


def _descended(layers: list[DataFrame], top: DataFrame, carried: dict[str, str]) -> DataFrame:
    """Proofs of the lowest layer. top(tree, subroot, root, proof): those of the trees' own roots."""
    above = layers[-1].join(top, "tree")
    if len(layers) == 1:  # each tree is one leaf
        above = written(_superblocks(above.select("tree", "n", "pos", "subroot", "root", "proof")), "outer")
    for layer in layers[-2:0:-1]:
        moved = layer.select("tree", "n", "pos", "digest", F.col("bundle").alias("from_bundle"), F.col("block").alias("from_block"))
        found = _exchanged(moved, above, {"tree": "long", "from_bundle": "long", "from_block": "long"})
        above = written(found.select("tree", F.col("from_bundle").alias("bundle"), F.col("from_block").alias("block"), "subroot", "root", "proof"), "outer")
    return _exchanged(layers[0], above, carried)


def manifest(docs: DataFrame, digest: Column, seen: Column, id_col: str = "doc_id", tree_col: str = "source") -> DataFrame:
    """(id, digest, subroot, root, proof, folded, verified) of every row of docs.

    digest: a row's leaf, hex text. seen: the leaf of what was received for it; folded is the root that this leads to along the proof,
    and verified tells whether it is the manifest's root. Leaves of a tree ascend by id, null ids first; rows of one id by their digest, so repeated
    rows are leaves of their own. Null trees come first. An empty table gives no rows; empty and long texts are leaves like others.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    leaves = docs.select(F.col(id_col).alias("id"), F.col(tree_col).alias("source"), digest.alias("digest"), seen.alias("seen"))
    leaves = leaves.withColumn("seen", F.when(F.col("seen") != F.col("digest"), F.col("seen"))).withColumn("tie", F.monotonically_increasing_id())
    leaves = positioned(written(leaves, "leaves"), "source", ["id", "digest", "tie"])
    layers = _climbed(written(leaves.select(F.col("id").cast("string").alias("id"), "tree", "n", "pos", "digest", "seen"), "leaves"))
    subroots = layers[-1].select(F.col("tree").alias("item"), "digest", F.lit(0).alias("all"))
    forest = _climbed(written(positioned(subroots, "all", ["item"]).select("item", "tree", "n", "pos", "digest"), "subroots"))
    whole = forest[-1].select("tree", F.lit("").alias("subroot"), F.col("digest").alias("root"), F.lit("").alias("proof"))
    top = _descended(forest, whole, {"item": "long"}).select(F.col("item").alias("tree"), F.col("digest").alias("subroot"), "root", "proof")
    found = _descended(layers, written(top, "outer"), {"id": "string"})
    return found.select(F.col("id").cast(kind).alias("id"), "digest", "subroot", "root", "proof", "folded", (F.col("folded") == F.col("root")).alias("verified"))


def op13(spark, sf_dir):
    """The manifest of documents, checked against a copy in which the texts of even crc32(doc_id) lost their line ends. No documents: no rows."""
    docs = table(spark, sf_dir, "documents")
    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    seen = field_digest(*(cut if c == "text" else F.col(c) for c in FIELDS))
    found = manifest(docs, field_digest(*map(F.col, FIELDS)), seen)
    siblings = F.sha2(F.translate("proof", "./", ""), 256).alias("proof_sha256")
    return found.select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", siblings, F.col("folded").alias("folded_root"), "verified")


OP13_SQL = """
WITH RECURSIVE crc(t) AS (SELECT [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
  3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]),
p AS (SELECT *, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT & 15, ord(c)::BIGINT >> 4]))),
  lambda c, x: xor(c >> 4, t[(xor(c, x) & 15) + 1])) AS crc FROM documents, crc),
q AS (SELECT *, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS cut,
  coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
  || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head FROM p),
h AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) AS seen FROM q),
d AS (SELECT row_number() OVER () AS rid, doc_id, leaf, seen, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS n,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM h),
nodes AS (SELECT tree, 0 AS lvl, pos, n, leaf AS h FROM d
  UNION ALL SELECT tree, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, lvl, pos // 3, n),
forest AS (SELECT 0 AS lvl, tree AS pos, count(*) OVER () AS n, h FROM nodes WHERE n = 1
  UNION ALL SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM forest WHERE n > 1 GROUP BY lvl, pos // 3, n),
steps AS (SELECT tree, lvl, pos,
  coalesce(string_agg(h, '') OVER (PARTITION BY tree, lvl, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(h, '') OVER (PARTITION BY tree, lvl, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM nodes WHERE n > 1),
high AS (SELECT lvl, pos,
  coalesce(string_agg(h, '') OVER (PARTITION BY lvl, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(h, '') OVER (PARTITION BY lvl, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM forest WHERE n > 1),
walk AS (SELECT rid, tree, 0 AS lvl, pos, n, seen AS cur, '' AS proof FROM d
  UNION ALL SELECT w.rid, w.tree, w.lvl + 1, w.pos // 3, (w.n + 2) // 3, sha256(s.l || w.cur || s.r), w.proof || s.l || s.r
  FROM walk w JOIN steps s ON s.tree = w.tree AND s.lvl = w.lvl AND s.pos = w.pos WHERE w.n > 1),
rise AS (SELECT rid, 0 AS lvl, tree AS pos, cur, proof, (SELECT max(tree) + 1 FROM d) AS n FROM walk WHERE n = 1
  UNION ALL SELECT w.rid, w.lvl + 1, w.pos // 3, sha256(s.l || w.cur || s.r), w.proof || s.l || s.r, (w.n + 2) // 3
  FROM rise w JOIN high s ON s.lvl = w.lvl AND s.pos = w.pos WHERE w.n > 1)
SELECT d.doc_id, d.leaf, sub.h AS subroot, top.h AS root, sha256(r.proof) AS proof_sha256, r.cur AS folded_root, r.cur = top.h AS verified
FROM d JOIN rise r ON r.rid = d.rid AND r.n = 1 JOIN nodes sub ON sub.tree = d.tree AND sub.n = 1 JOIN forest top ON top.n = 1
"""
