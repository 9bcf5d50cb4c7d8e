"""Merkle manifest of a dataset: a tree per group of rows, a tree over the groups, an inclusion proof for every row.

The trees are reduced as a sparse forest: any set of nodes, keyed by tree, level and
index, merges with any other in any order, and a run of siblings becomes its parent as
soon as it is whole. How wide a run is follows from the number of leaves alone, so no
order of arrival matters. Partitions fold what they hold, fragments merge in rounds of
sixteen, and only unresolved nodes (a logarithm of the leaves for a contiguous range)
move. Nothing but the root reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wireloom.functions.ranking import ranked
from wireloom.llm import common
from wireloom.session import cut, discard

#: The tree over the groups' roots.
TOP = -1
#: Leaves under one node of this level are proved together, in one group.
BLOCK_LEVEL = 12
FAN_IN = 16


def digest(*parts: bytes) -> bytes:
    """SHA-256 of digests as lowercase hex text, concatenated."""
    return hashlib.sha256("".join([p.hex() for p in parts]).encode()).digest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    return (n - 1).bit_length()


class Forest:
    """Unresolved nodes of one or more binary trees. merge() is associative and commutative, an empty forest its identity.

    A node is added with the number of leaves of its tree. When its run (the sibling, or
    none at an uneven end) is whole, the run is replaced by its parent; a finished tree is
    a leaf of the tree TOP, which has n_trees leaves. done collects (tree, level, index,
    sibling) of consumed nodes of TOP and of level keep or more.
    """

    def __init__(self, n_trees: int, keep: int = 0) -> None:
        self.n_trees, self.keep = n_trees, keep
        self.nodes: dict[tuple[int, int, int], tuple[int, bytes]] = {}
        self.done: list[tuple[int, int, int, bytes]] = []
        self.root: bytes | None = None

    def add(self, tree: int, n: int, level: int, index: int, value: bytes) -> None:
        while True:
            width = ((n - 1) >> level) + 1
            if width == 1:
                if tree == TOP:
                    self.root = value
                    return
                tree, n, level, index = TOP, self.n_trees, 0, tree
                continue
            other = index ^ 1
            if other < width:
                held = self.nodes.pop((tree, level, other), None)
                if held is None:
                    self.nodes[tree, level, index] = (n, value)
                    return
                if tree == TOP or level >= self.keep:
                    self.done.append((tree, level, index, held[1]))
                    self.done.append((tree, level, other, value))
                value = digest(value, held[1]) if index < other else digest(held[1], value)
            else:
                value = digest(value)
            level, index = level + 1, index >> 1

    def merge(self, other: Forest) -> Forest:
        for (tree, level, index), (n, value) in other.nodes.items():
            self.add(tree, n, level, index, value)
        self.done += other.done
        self.root = self.root or other.root
        return self


STEP = "fragment long, tree long, n long, level int, idx long, value binary, state string"
_STEP_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.string())
_STEP_NAMES = [x.split()[0] for x in STEP.split(", ")]


def _rows(fragment: int, forest: Forest) -> pa.RecordBatch:
    """open: an unresolved node; done: a consumed node with the sibling as value; root: the top."""
    rows = [(fragment, t, n, lv, i, v, "open") for (t, lv, i), (n, v) in forest.nodes.items()]
    rows += [(fragment, t, 0, lv, i, v, "done") for t, lv, i, v in forest.done]
    if forest.root is not None:
        rows.append((fragment, TOP, forest.n_trees, height(forest.n_trees), 0, forest.root, "root"))
    cols = list(zip(*rows)) or [()] * len(_STEP_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _STEP_TYPES)], names=_STEP_NAMES)


def _fold(n_trees: int):  # noqa: ANN202
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here, forest = TaskContext.get().partitionId(), Forest(n_trees, BLOCK_LEVEL)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("tree", "n", "idx", "leaf"))):
                forest.add(row[0], row[1], 0, row[2], row[3])
        yield _rows(here, forest)

    return fold


def _merge(n_trees: int):  # noqa: ANN202
    def merge(key: tuple, table: pa.Table) -> pa.Table:
        forest = Forest(n_trees, BLOCK_LEVEL)
        for row in zip(*(table.column(c).to_pylist() for c in ("tree", "n", "level", "idx", "value"))):
            forest.add(*row)
        return pa.Table.from_batches([_rows(key[0].as_py(), forest)])

    return merge


def reduce_forest(leaves: DataFrame, n_trees: int) -> tuple[bytes | None, DataFrame]:
    """(root, consumed nodes) of leaves(tree, n, idx, leaf).

    Fragments of neighbouring partitions merge FAN_IN at a time until one is left, each
    round written to the shared folder. Consumed nodes (tree, level, idx, sibling) are
    those that proofs need above their blocks: level BLOCK_LEVEL and more, and TOP.
    """
    step = cut(leaves.select("tree", "n", "idx", "leaf").mapInArrow(_fold(n_trees), STEP), "forest")
    steps = [step]
    while ((step.where("state = 'open'").agg(F.max("fragment")).first()[0]) or 0) > 0:
        groups = step.where("state = 'open'").withColumn("part", F.floor(F.col("fragment") / FAN_IN)).groupBy("part")
        step = cut(groups.applyInArrow(_merge(n_trees), STEP), "forest")
        steps.append(step)
    found = steps[0]
    for s in steps[1:]:
        found = found.unionByName(s)
    done = cut(found.where("state = 'done'").select("tree", "level", "idx", F.col("value").alias("sibling")), "consumed")
    root = found.where("state = 'root'").select("value").first()
    if root is None and step.where("state = 'open'").limit(1).count():
        raise ValueError("the forest has nodes without siblings: a leaf is missing or has a wrong index")
    discard(*steps)
    return (bytes(root[0]) if root else None), done


def fold_proof(leaf: bytes, position: int, n: int, tree: int, n_trees: int, proof: bytes) -> tuple[bytes, bytes]:
    """(subroot, root) recomputed from a leaf and its proof, the siblings' digests from leaf to root."""
    value, at, out = leaf, 0, []
    for index, width in ((position, n), (tree, n_trees)):
        while width > 1:
            if index ^ 1 < width:
                sibling, at = proof[at : at + 32], at + 32
                value = digest(value, sibling) if index % 2 == 0 else digest(sibling, value)
            else:
                value = digest(value)
            index, width = index >> 1, (width + 1) >> 1
        out.append(value)
    return out[0], out[1]


def block_proofs(leaves: list[bytes], first: int, n: int) -> list[bytes]:
    """The siblings of every leaf below level BLOCK_LEVEL; leaves are those of one block, from index first."""
    proofs: list[list[bytes]] = [[] for _ in leaves]
    row, level, width = leaves, 0, n
    while width > 1 and level < BLOCK_LEVEL:
        start = first >> level
        for k in range(len(leaves)):
            i = ((first + k) >> level) - start
            if (i ^ 1) < len(row):  # blocks are aligned, so a run never crosses their border
                proofs[k].append(row[i ^ 1])
        row = [digest(*row[i : i + 2]) for i in range(0, len(row), 2)]
        level, width = level + 1, (width + 1) >> 1
    return [b"".join(p) for p in proofs]


PROVED = "tree long, n long, idx long, key binary, leaf binary, subroot binary, root binary, proof binary, folded_root binary, verified boolean"


def _prove(n_trees: int, root: bytes | None):  # noqa: ANN202
    def prove(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("idx")
        leaves, claims, idx = (left.column(c).to_pylist() for c in ("leaf", "claim", "idx"))
        tree, n = left.column("tree")[0].as_py(), left.column("n")[0].as_py()
        above = b"".join(right.column("above")[0].as_py()) if right.num_rows else b""
        proofs = [p + above for p in block_proofs(leaves, idx[0], n)]
        subroot = fold_proof(leaves[0], idx[0], n, tree, n_trees, proofs[0])[0]
        folded = [fold_proof(c or x, i, n, tree, n_trees, p)[1] for x, c, i, p in zip(leaves, claims, idx, proofs)]
        size = len(leaves)
        cols = [left.column("tree"), left.column("n"), left.column("idx"), left.column("key"), left.column("leaf"), pa.array([subroot] * size, pa.binary()), pa.array([root] * size, pa.binary())]
        cols += [pa.array(proofs, pa.binary()), pa.array(folded, pa.binary()), pa.array([f == root for f in folded])]
        return pa.Table.from_arrays(cols, names=[x.split()[0] for x in PROVED.split(", ")])

    return prove


def leaf_of(columns: list[Column]) -> Column:
    """SHA-256 of the values one after another: '-' for null, else byte count, ':' and the value."""

    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))

    return F.unhex(F.sha2(F.concat(*[part(c) for c in columns]).cast("binary"), 256))


def positioned(leaves: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """(leaves with tree, n and idx, number of trees): a tree for each value of group, leaves in order, counted from 0.

    One range partitioning by group and order deals a group of any size over many tasks; a
    leaf's index is its place in its partition plus the group's leaves of earlier ones.
    """
    keys = [F.col("group"), *[F.col(c) for c in order]]
    placed = cut(leaves.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("at_part"), F.col("group").alias("at_group")).agg(F.count(F.lit(1)).alias("m"), F.min("_id").alias("first"))
    sizes = cut(sizes, "sizes")
    trees = cut(ranked(sizes.groupBy(F.col("at_group").alias("of")).agg(F.sum("m").alias("n")).withColumn("_all", F.lit(0)), "_all", [F.col("of")], "tree").select("of", "n", "tree"), "trees")
    earlier = Window.partitionBy("at_group").orderBy("at_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("m").over(earlier), F.lit(0)) - F.col("first"))
    starts = cut(starts.join(trees, F.col("at_group").eqNullSafe(F.col("of"))).select("at_part", "at_group", "start", "n", "tree"), "starts")
    found = placed.withColumn("_part", part).join(starts, (F.col("_part") == F.col("at_part")) & F.col("group").eqNullSafe(F.col("at_group")))
    return found.withColumn("idx", F.col("_id") + F.col("start")).drop("_id", "_part", "at_part", "at_group", "start"), trees.count()


def manifest(docs: DataFrame, columns: list[str], group: str, order: str, claims: dict[str, Column] | None = None) -> DataFrame:
    """(key columns, tree, position, n_leaves, n_trees, leaf, subroot, root, proof, folded_root, verified), a row per row of docs.

    A leaf is the digest of the row's columns; leaves of equal group make a tree, in
    ascending order of the column order (null first; ties by leaf, and rows equal in all
    columns are interchangeable); trees stand by group, null first, strings bytewise.
    Pairs of consecutive nodes become their digest, an uneven last one its own digest, up
    to subroot, and the subroots likewise up to root. proof holds the siblings' 32-byte
    digests from leaf to root; fold_proof() takes it up again.

    claims gives some columns other values (what a store says they are now); folded_root
    is recomputed from the claimed leaf and the true siblings, verified says whether it is
    the root. Columns that aren't named are ignored, whatever their names; nulls and empty
    values have digests of their own; a text of any length is one digest before anything
    moves; an empty table gives no rows.
    """
    claims = claims or {}
    values = [F.col(f"`{c}`") for c in columns]
    claimed = [claims.get(c, F.col(f"`{c}`")) for c in columns]
    differs = F.lit(False)
    for a, b in zip(values, claimed):
        differs = differs | ~a.eqNullSafe(b)
    rows = docs.select(
        F.col(f"`{group}`").alias("group"), F.col(f"`{order}`").alias("order"), leaf_of(values).alias("leaf"),
        F.when(differs, leaf_of(claimed)).alias("claim") if claims else F.lit(None).cast("binary").alias("claim"),
    )
    leaves, n_trees = positioned(rows, ["order", "leaf"])
    root, done = reduce_forest(leaves, n_trees)
    block = F.shiftright("idx", BLOCK_LEVEL)
    blocks = leaves.where(F.col("idx") % (1 << BLOCK_LEVEL) == 0).select("tree", "n", block.alias("block"))
    high = F.expr("cast(length(bin(n - 1)) as int)")
    inside = blocks.where(f"n > {1 << BLOCK_LEVEL}").withColumn("lv", F.explode(F.sequence(F.lit(BLOCK_LEVEL), high - 1)))
    inside = inside.select("tree", "block", F.col("tree").alias("in_tree"), "lv", F.expr(f"shiftright(block, lv - {BLOCK_LEVEL})").alias("at"))
    over = blocks.where(F.lit(n_trees > 1)).withColumn("lv", F.explode(F.sequence(F.lit(0), F.lit(max(0, height(max(1, n_trees)) - 1)))))
    over = over.select("tree", "block", F.lit(TOP).cast("long").alias("in_tree"), "lv", F.expr("shiftright(tree, lv)").alias("at"))
    ways = inside.unionByName(over).join(done.select(F.col("tree").alias("in_tree"), F.col("level").alias("lv"), F.col("idx").alias("at"), "sibling"), ["in_tree", "lv", "at"])
    steps = F.array_sort(F.collect_list(F.struct((F.col("in_tree") == TOP).alias("top"), "lv", "sibling")))  # at most a logarithm of the leaves
    ways = ways.groupBy(F.col("tree").alias("of_tree"), F.col("block").alias("of_block")).agg(F.transform(steps, lambda s: s["sibling"]).alias("above"))
    typed = leaves.select("tree", "n", "idx", "leaf", "claim", block.alias("block"), F.col("order").cast("string").cast("binary").alias("key"))
    proved = typed.groupBy("tree", "block").cogroup(ways.groupBy("of_tree", "of_block")).applyInArrow(_prove(n_trees, root), PROVED)
    return proved.select(
        F.col("key").cast("string").cast(docs.schema[order].dataType).alias(order), "tree", F.col("idx").alias("position"), F.col("n").alias("n_leaves"), F.lit(n_trees).cast("long").alias("n_trees"),
        "leaf", "subroot", "root", "proof", "folded_root", "verified",
    )


def op12_merkle(docs: DataFrame) -> DataFrame:
    """Contract 12: a tree for each lang, leaves by doc_id; where 7 divides the checksum of doc_id, n_chars is claimed to be one more.

    A null doc_id stands first and is never tampered with, a null n_chars stays null.
    Repeated rows get a leaf each; other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"), "text")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    found = manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    text = lambda c: F.lower(F.hex(c))
    return found.select("doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), F.sha2(text("proof").cast("binary"), 256).alias("proof_sha256"), text("folded_root").alias("folded_root"), "verified")


#: Every 2 consecutive nodes by recursion, levels of all trees at once; then the tree over them, and folds along the levels.
OP12_SQL = r"""
WITH RECURSIVE flat AS (
  SELECT doc_id, lang, n_chars, coalesce(crc % 7 = 0, false) AS hit,
         CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS a,
         CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS z
  FROM (SELECT *, CRC_OF_ID AS crc FROM documents)
), leaves AS (
  SELECT doc_id, lang, sha256(a || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END || z) AS leaf,
         sha256(a || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars + hit::INT AS VARCHAR)) || ':' || (n_chars + hit::INT) END || z) AS claim
  FROM flat
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM leaves
), nodes AS (
  SELECT tree, 0 AS lv, idx, n AS width, leaf AS h FROM placed
  UNION ALL
  SELECT tree, lv + 1, idx // 2, any_value((width + 1) // 2), sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE width > 1 GROUP BY tree, lv + 1, idx // 2
), subs AS (SELECT tree, h AS subroot, count(*) OVER () AS k FROM nodes WHERE width = 1),
tops AS (
  SELECT 0 AS lv, tree AS idx, k AS width, subroot AS h FROM subs
  UNION ALL
  SELECT lv + 1, idx // 2, any_value((width + 1) // 2), sha256(string_agg(h, '' ORDER BY idx)) FROM tops WHERE width > 1 GROUP BY lv + 1, idx // 2
), steps AS (
  SELECT tree, lv, idx, width, h FROM nodes WHERE width > 1 UNION ALL SELECT -1, lv, idx, width, h FROM tops WHERE width > 1
), rise AS (
  SELECT doc_id, leaf, claim, tree AS mine, row_number() OVER () AS r, tree AS tree, 0 AS lv, idx, n AS width, claim AS h, '' AS proof FROM placed
  UNION ALL
  SELECT rise.doc_id, leaf, claim, mine, r,
         CASE WHEN rise.width > 1 THEN rise.tree ELSE -1 END, CASE WHEN rise.width > 1 THEN rise.lv + 1 ELSE 0 END,
         CASE WHEN rise.width > 1 THEN rise.idx // 2 ELSE mine END, CASE WHEN rise.width > 1 THEN (rise.width + 1) // 2 ELSE (SELECT any_value(k) FROM subs) END,
         CASE WHEN rise.width <= 1 THEN rise.h WHEN s.h IS NULL THEN sha256(rise.h) WHEN s.idx < rise.idx THEN sha256(s.h || rise.h) ELSE sha256(rise.h || s.h) END,
         proof || coalesce(s.h, '')
  FROM rise LEFT JOIN steps s ON rise.width > 1 AND s.tree = rise.tree AND s.lv = rise.lv AND s.idx = xor(rise.idx, 1) WHERE rise.width > 1 OR rise.tree >= 0
), top AS (SELECT h AS root FROM tops WHERE width = 1)
SELECT CAST(doc_id AS BIGINT) AS doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, rise.h AS folded_root, rise.h = root AS verified
FROM rise JOIN subs ON mine = subs.tree, top WHERE rise.tree = -1 AND rise.width = 1
""".replace("CRC_OF_ID", common.crc32_sql("doc_id"))
