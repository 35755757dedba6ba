"""Merkle manifest of a table: a tree per group, a tree over the groups, and a proof for each row.

Proofs are made by pointer jumping. Every node starts with the sibling that goes with it towards its
parent. A round joins the nodes with the nodes they point to: the distance of the pointer doubles, and
the siblings of the second way are put behind those of the first. After log2(depth) rounds a leaf
holds all siblings up to the root. A round needs only nodes whose level its distance divides, so the
nodes above the leaves are soon few; a leaf's segments are joined last, once for each distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripfold.llm.common import checkpoint, table

#: Levels of a tree that are built in one pass: a block is 2 to this power neighbouring nodes.
STEP = 8
#: Neighbouring leaves that meet an ancestor in one group of a join are 2 to this power at most.
CHUNK = 12


def leaf_digest(*values: Column) -> Column:
    """Lowercase hex sha256 of the values: each its UTF-8 length, a colon and itself, or - for NULL."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _numbered(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds idx (0, 1, ... within `tree`, by `order` and leaf) and n, the tree's number of leaves.

    Rows are dealt by ranges of (tree, order) and a per-row number, so that neither a tree nor a value
    that holds a third of the rows is one task's; which one of equal rows comes first does not matter.
    A window sees a row for each task and tree.
    """
    by = ["tree", *order, "leaf", "spread"]
    placed = (
        leaves.withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .drop("spread")
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("part", F.shiftrightunsigned("at", 33))
    )
    placed = checkpoint(placed)
    parts = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    before = W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select(
        "tree",
        "part",
        (F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("held").over(W.partitionBy("tree")).alias("n"),
    )
    return placed.join(starts, ["tree", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _levels(batches: Iterator[pd.DataFrame], base: int, step: int) -> Iterator[pd.DataFrame]:
    """The levels over each block, up to `step` more or the tree's root."""
    for batch in batches:
        out = []
        for tree, n, block, nodes in batch[["tree", "n", "block", "nodes"]].itertuples(index=False):
            nodes, start, depth = list(nodes), block << step, (n - 1).bit_length()
            out.append((tree, n, depth, base, start, nodes))
            for level in range(base + 1, min(base + step, depth) + 1):
                texts = [n.hex() for n in nodes]
                pairs = ("".join(texts[i : i + 2]) for i in range(0, len(texts), 2))
                nodes = [hashlib.sha256(p.encode()).digest() for p in pairs]
                start >>= 1
                out.append((tree, n, depth, level, start, nodes))
        yield pd.DataFrame(out, columns=["tree", "n", "depth", "level", "start", "nodes"])


def _blocks(nodes: DataFrame, base: int) -> DataFrame:
    """Levels base to base + STEP over each block of nodes at level base, as rows of one array a level.

    `nodes` has tree, n, idx, digest; the result tree, n, depth, level, start (idx of the first), nodes.
    A level's digest is that of every two neighbours below, or of the last one alone.
    """
    listed = F.sort_array(F.collect_list(F.struct("idx", "digest")))["digest"].alias("nodes")
    block = F.shiftright("idx", STEP).alias("block")
    blocks = nodes.groupBy("tree", "n", block).agg(listed)
    made = "tree string, n long, depth int, level int, start long, nodes array<binary>"
    return blocks.mapInPandas(partial(_levels, base=base, step=STEP), made)


def _nodes(blocks: DataFrame) -> DataFrame:
    """A row for each node: tree, n, depth, level, idx, digest, and `path`, its sibling as a list of one.

    The sibling is NULL where the node is alone; the list of a tree's root is empty.
    """
    each = blocks.select("*", F.posexplode("nodes").alias("i", "digest"))
    sibling = F.array(F.get("nodes", F.col("i").bitwiseXOR(F.lit(1))))
    path = F.when(F.col("level") < F.col("depth"), sibling).otherwise(F.array().cast("array<binary>"))
    return each.select("tree", "n", "depth", "level", (F.col("start") + F.col("i")).alias("idx"), "digest", path.alias("path"))


def _jump(rows: DataFrame, above: DataFrame, distance: int) -> DataFrame:
    """rows with the paths of their ancestors at `distance` behind their own.

    Rows whose path has reached the root find none. An ancestor of more than 2**CHUNK rows is there
    once for each chunk of them, and met by that chunk only.
    """
    cut = min(distance, CHUNK)
    wide = distance - cut
    # (n - 1 >> level) + 1 nodes stand at a level.
    last = F.least(F.shiftleft(F.col("idx") + 1, wide) - 1, F.expr(f"shiftright(shiftright(n - 1, level - {distance}), {cut})"))
    ways = above.where("level < depth").select(
        "tree",
        F.col("level").alias("to_level"),
        F.explode(F.sequence(F.shiftleft("idx", wide), last)).alias("chunk"),
        F.col("path").alias("further"),
    )
    asked = rows.withColumn("to_level", F.col("level") + distance).withColumn("chunk", F.shiftright("idx", cut))
    met = asked.join(ways, ["tree", "to_level", "chunk"], "left")
    further = F.coalesce("further", F.array().cast("array<binary>"))
    return met.withColumn("path", F.concat("path", further)).select(*rows.columns)


def proofs(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """leaves (tree, not NULL; the `order` columns; leaf, hex; more) with what proves each.

    Adds idx (place in its tree from 0), n (leaves of the tree), path (siblings from the leaf up, a
    list of binary with NULL where a node was alone) and subroot (hex).
    """
    numbered = checkpoint(_numbered(leaves, order))
    deepest = ((numbered.agg(F.max("n")).first()[0] or 1) - 1).bit_length()
    level = numbered.select("tree", "n", "idx", F.unhex("leaf").alias("digest"))
    built = []
    for base in range(0, max(deepest, 1), STEP):
        blocks = checkpoint(_blocks(level, base))
        # The top of a block is the ground of the next.
        top = (F.col("level") == base + STEP) & (F.col("depth") > base + STEP)
        built.append(_nodes(blocks.where(~top)))
        level = blocks.where(top).select("tree", "n", F.col("start").alias("idx"), F.col("nodes")[0].alias("digest"))
    nodes = built[0]
    for more in built[1:]:
        nodes = nodes.unionByName(more)

    grown, waiting, distance = nodes.where("level > 0").drop("digest"), [], 1
    while distance < deepest:
        # Nodes at odd multiples of the distance are met from below, the others go on.
        met = checkpoint(grown.where(F.col("level") % (2 * distance) == distance))
        waiting.append((distance, met.where(F.col("level") == distance)))
        grown = checkpoint(_jump(grown.where(F.col("level") % (2 * distance) == 0), met, distance))
        distance *= 2

    siblings = built[0].where("level = 0").select("tree", "idx", "path")
    found = numbered.withColumn("level", F.lit(0)).join(siblings, ["tree", "idx"])
    for distance, above in waiting:
        found = _jump(found, above, distance)
    subroots = nodes.where("level = depth").select("tree", "n", _hex(F.col("digest")).alias("subroot"))
    return per_tree(found, subroots).drop("level")


def per_tree(rows: DataFrame, trees: DataFrame) -> DataFrame:
    """rows (tree, idx, ...) with the columns of their tree (tree, n, ...); a large one meets them in chunks."""
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("n") - 1, CHUNK))).alias("chunk")
    each = trees.select("*", chunks).drop("n")
    return rows.withColumn("chunk", F.shiftright("idx", CHUNK)).join(each, ["tree", "chunk"]).drop("chunk")


def folded(leaf: Column, path: Column, idx: Column, first: Column | int = 0) -> Column:
    """The digest that a leaf and its siblings give; bit i - first of idx tells the sides of sibling i."""

    def beside(s: Column, i: Column) -> Column:
        right = F.call_function("shiftright", idx, i - first).bitwiseAND(F.lit(1)) == 1
        return F.struct(_hex(s).alias("s"), right.alias("right"))

    def up(digest: Column, x: Column) -> Column:
        both = F.when(x["right"], F.concat(x["s"], digest)).otherwise(F.concat(digest, x["s"]))
        return F.sha2(F.coalesce(both, digest).cast("binary"), 256)

    return F.aggregate(F.transform(path, beside), leaf, up)


def manifest(leaves: DataFrame, order: Sequence[str], claimed: str | None = None) -> DataFrame:
    """A Merkle tree for each tree, one over their roots, and every leaf proved.

    `leaves` has tree (text, may be NULL; roots go by it, NULL first), the `order` columns, leaf (hex),
    and more columns that are kept. The result adds subroot, root, proof_sha256 (sha256 of the hex
    siblings from leaf to root, left out where a node was alone), folded_root (what the `claimed` leaf,
    else the leaf, gives with those siblings) and verified (whether that is the root).

    Leaves that tie in all of `order` go by their digest; equal leaves take neighbouring places. A
    single leaf is its tree's root, and a single tree's root the root of all. An empty table gives
    no rows. Names must differ from those that are added, and from path, idx, n, part, at, level, depth.
    """
    known = leaves.withColumn("tree", F.coalesce(F.concat(F.lit("1"), "tree"), F.lit("0")))
    inner = checkpoint(proofs(checkpoint(known), order))
    roots = inner.where("idx = 0").select(
        F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("n").alias("size"), F.col("subroot").alias("leaf")
    )
    top = proofs(roots, ["name"]).select(
        F.col("name").alias("tree"),
        F.col("size").alias("n"),
        F.col("idx").alias("top_idx"),
        F.col("path").alias("top_path"),
        F.col("subroot").alias("root"),
    )
    rows = per_tree(inner, checkpoint(top))
    start = F.coalesce(F.col(claimed), F.col("leaf")) if claimed else F.col("leaf")
    there = F.transform(F.filter(F.concat("path", "top_path"), lambda s: s.isNotNull()), _hex)
    both = folded(folded(start, F.col("path"), F.col("idx")), F.col("top_path"), F.col("top_idx"))
    out = rows.withColumn("proof_sha256", F.sha2(F.array_join(there, "").cast("binary"), 256)).withColumn("folded_root", both)
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).drop(
        "tree", "path", "top_path", "top_idx", "idx", "n"
    )


def document_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document proved in a tree per language; a seventh of them with n_chars tampered with.

    Repeated rows are leaves of their own. A NULL doc_id sorts first and is never tampered with.
    """
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    other = leaf_digest(*(F.col(c) for c in ("doc_id", "source", "lang")), F.col("n_chars") + 1, F.col("text"))
    leaves = docs.select(
        F.col("lang").alias("tree"),
        "doc_id",
        leaf_digest(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))).alias("leaf"),
        F.when(tampered, other).alias("claimed"),
    )
    return manifest(leaves, ["doc_id"], "claimed").select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )


#: The same rows, level by level, in DuckDB.
MANIFEST_SQL = """
WITH RECURSIVE fields AS (
    SELECT *, row_number() OVER () AS row_id,
        coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-')
            || coalesce(octet_length(encode(source)) || ':' || source, '-')
            || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
        coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail,
        coalesce('1' || lang, '0') AS tree
    FROM documents),
hashed AS (
    SELECT *, sha256(head || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
        sha256(head || coalesce(octet_length(encode((n_chars + 1)::VARCHAR)) || ':' || (n_chars + 1), '-') || tail) AS other
    FROM fields),
leaves AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, row_id) - 1 AS idx FROM hashed),
checked AS (
    SELECT row_id, leaf, other, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ord(d)::BIGINT)),
        lambda c, d: list_reduce(
            list_prepend(xor(c, d), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))) AS crc
    FROM leaves),
nodes AS (
    SELECT tree, 0 AS level, idx, leaf AS digest, count(*) OVER (PARTITION BY tree) AS many FROM leaves
    UNION ALL
    SELECT a.tree, a.level + 1, a.idx // 2, sha256(a.digest || coalesce(b.digest, '')), (a.many + 1) // 2
    FROM nodes a LEFT JOIN nodes b ON a.tree = b.tree AND b.idx = a.idx + 1
    WHERE a.many > 1 AND a.idx % 2 = 0),
subroots AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS top_idx FROM nodes WHERE many = 1),
top AS (
    SELECT 0 AS level, top_idx AS idx, subroot AS digest, count(*) OVER () AS many FROM subroots
    UNION ALL
    SELECT a.level + 1, a.idx // 2, sha256(a.digest || coalesce(b.digest, '')), (a.many + 1) // 2
    FROM top a LEFT JOIN top b ON b.idx = a.idx + 1
    WHERE a.many > 1 AND a.idx % 2 = 0),
steps AS (
    SELECT l.row_id, n.level, n.idx % 2 = 1 AS on_left, s.digest AS sibling
    FROM leaves l JOIN nodes n ON n.tree = l.tree AND n.idx = l.idx >> n.level AND n.many > 1
    LEFT JOIN nodes s ON s.tree = n.tree AND s.level = n.level AND s.idx = xor(n.idx, 1)
    UNION ALL
    SELECT l.row_id, 1000 + n.level, n.idx % 2 = 1, s.digest
    FROM leaves l JOIN subroots r ON r.tree = l.tree JOIN top n ON n.idx = r.top_idx >> n.level AND n.many > 1
    LEFT JOIN top s ON s.level = n.level AND s.idx = xor(n.idx, 1)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY level) AS step FROM steps),
fold AS (
    SELECT row_id, 0 AS step, CASE WHEN crc % 7 = 0 THEN coalesce(other, leaf) ELSE leaf END AS digest FROM checked
    UNION ALL
    SELECT f.row_id, n.step, sha256(CASE WHEN n.sibling IS NULL THEN f.digest
        WHEN n.on_left THEN n.sibling || f.digest ELSE f.digest || n.sibling END)
    FROM fold f JOIN numbered n ON n.row_id = f.row_id AND n.step = f.step + 1),
ends AS (SELECT row_id, arg_max(digest, step) AS folded_root FROM fold GROUP BY row_id),
proof AS (SELECT row_id, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof_sha256 FROM steps GROUP BY row_id)
SELECT l.doc_id, l.leaf, r.subroot, t.digest AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
    e.folded_root, e.folded_root = t.digest AS verified
FROM leaves l JOIN subroots r USING (tree) JOIN ends e USING (row_id) LEFT JOIN proof p USING (row_id), top t
WHERE t.many = 1
"""
