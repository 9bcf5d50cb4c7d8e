"""Prefix trie of conversations: families are rebuilt and folded first, and only their combined nodes meet.

A node is known by a digest chained along its turns. Inside a family the rows come by
turn, all conversations side by side, so a task holds one open node per conversation and
no conversation as a whole. After the merge a node is (smallest member, depth): nodes of
one smallest member form a chain, chains hang off one another, and sums over subtrees
come from sums along chains and pointer doubling over the tree of chains.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wireloom.llm import common
from wireloom.session import cut, discard

ROOT = hashlib.sha256(b"").digest()
#: Conversation ids of one family; the first of them lends its turns to the others.
FAMILY = 20
#: Ids of ended conversations are joined to texts of about so many bytes before they are dealt by node.
CHUNK = 1 << 16

FAMILY_ROWS = "node binary, parent binary, depth long, conv_id long, n_convs long, n_words long, base long, ends string"
_KINDS = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
_NAMES = [x.split()[0] for x in FAMILY_ROWS.split(", ")]


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(base, conv_id, lend, turn, said, n_words): narrow rows, said being the digest of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    conv = F.col("conv_id").cast("long")
    return conversations.where(conv.isNotNull()).select(
        (conv - conv % FAMILY).alias("base"), conv.alias("conv_id"), (F.crc32(conv.cast("string").cast("binary")) % 4).cast("int").alias("lend"),
        F.col("turn").cast("long").alias("turn"), said.alias("said"), common.n_words(text).alias("n_words"),
    )


class FamilyTrie:
    """The trie of one family, built turn by turn. take() gets rows by (position, conv_id); nodes that no later row can reach come out.

    A rebuilt conversation is never more than 3 turns shorter than its position in the
    source says, so a node of depth d is complete once position d + 3 has passed.
    """

    def __init__(self, base: int) -> None:
        self.base = base
        self.heads: dict[int, tuple[bytes, int]] = {}  # conversation -> (digest of its last node, depth)
        self.lent: dict[int, tuple[bytes, int]] = {}  # position below 3 -> the base's turn there
        self.open: dict[int, dict[bytes, list]] = {}  # depth -> node -> [parent, smallest member, members, words]

    def _step(self, conv: int, said: bytes, n_words: int) -> None:
        parent, depth = self.heads[conv]
        node = hashlib.sha256(parent + said).digest()
        self.heads[conv] = (node, depth + 1)
        held = self.open.setdefault(depth + 1, {}).setdefault(node, [parent, conv, 0, n_words])
        held[1], held[2] = min(held[1], conv), held[2] + 1

    def take(self, position: int, conv: int, lend: int, said: bytes, n_words: int) -> None:
        if conv not in self.heads:  # position 0: every conversation starts with what the base lends
            self.heads[conv] = (ROOT, 0)
            for p in sorted(self.lent):
                if p < lend:
                    self._step(conv, *self.lent[p])
        if position >= lend:
            self._step(conv, said, n_words)

    def complete(self, position: int) -> Iterator[tuple]:
        for depth in [d for d in self.open if d + 3 < position]:
            for node, (parent, conv, n, words) in self.open.pop(depth).items():
                yield node, parent, depth, conv, n, words, self.base, None

    def close(self) -> Iterator[tuple]:
        yield from self.complete(1 << 62)
        yield ROOT, None, 0, min(self.heads), len(self.heads), 0, self.base, None
        ended: dict[tuple[bytes, int], list[int]] = {}
        for conv, head in self.heads.items():
            ended.setdefault(head, []).append(conv)
        for (node, depth), convs in ended.items():
            yield node, None, depth, None, 0, None, self.base, ",".join(map(str, sorted(convs)))


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie, out = None, []

    def emit() -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * len(_KINDS)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS)], names=_NAMES)

    last = -1
    for batch in batches:
        for base, position, conv, lend, said, n_words, lends in zip(*(batch.column(c).to_pylist() for c in ("base", "position", "conv_id", "lend", "said", "n_words", "lends"))):
            if trie is None or trie.base != base:
                if trie is not None:
                    out.extend(trie.close())
                trie, last = FamilyTrie(base), -1
            if lends:
                trie.lent[position] = (said, n_words)
                continue
            if position != last:
                out.extend(trie.complete(position))
                last = position
            trie.take(position, conv, lend, said, n_words)
        if len(out) > 5000:
            yield emit()
    if trie is not None:
        out.extend(trie.close())
    yield emit()


def family_nodes(turns: DataFrame) -> DataFrame:
    """Rows of the families' tries (FAMILY_ROWS): nodes with members, and with ends the ids that end there, ascending.

    The base's first 3 turns come a second time before all other rows of the family, as
    the side that lends; the other side are the family's conversations by position.
    """
    ordered = Window.partitionBy("base", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "said")
    placed = turns.repartition("base").withColumn("position", F.row_number().over(ordered) - 1)
    lends = (F.col("conv_id") == F.col("base")) & (F.col("position") < 3)
    both = placed.withColumn("lends", F.explode(F.when(lends, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    rows = both.select("base", F.col("lends").cast("boolean").alias("lends"), F.col("position").cast("long").alias("position"), "conv_id", "lend", "said", "n_words")
    return rows.sortWithinPartitions("base", F.col("lends").desc(), "position", "conv_id").mapInArrow(_families, FAMILY_ROWS)


def _streamed(joined: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (node, base, ends) in order: joined to longer texts, or digested node by node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, held, size, state = None, None, [], 0, None
        out: list[tuple] = []

        def flush() -> None:
            nonlocal held, size
            if now is not None and joined and held:
                out.append((now, first, ",".join(held)))
            elif now is not None and not joined:
                out.append((now, state.hexdigest()))
            held, size = [], 0

        def emit() -> pa.RecordBatch:
            kinds, names = ((pa.binary(), pa.int64(), pa.string()), ["node", "base", "ends"]) if joined else ((pa.binary(), pa.string()), ["node", "ends_sha256"])
            cols = list(zip(*out)) or [()] * len(kinds)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        for batch in batches:
            for node, base, ends in zip(*(batch.column(c).to_pylist() for c in ("node", "base", "ends"))):
                if node != now:
                    flush()
                    now, first, state = node, base, None if joined else hashlib.sha256(ends.encode())
                elif not joined:
                    state.update(b"," + ends.encode())
                if joined:
                    if size > CHUNK:
                        flush()
                        first = base
                    held.append(ends)
                    size += len(ends)
            if len(out) > 1000:
                yield emit()
        flush()
        yield emit()

    return run


def ends_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of rows (node, base, ends), in order of base.

    A range partitioning splits the ids of one node over tasks, which join them to few
    long texts; only these are dealt by node, where a digest takes them up as a stream.
    """
    long_ = ends.repartitionByRange("node", "base").sortWithinPartitions("node", "base").mapInArrow(_streamed(True), "node binary, base long, ends string")
    return long_.repartition("node").sortWithinPartitions("node", "base").mapInArrow(_streamed(False), "node binary, ends_sha256 string")


def subtree_sums(nodes: DataFrame, chains: DataFrame) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) over whole subtrees.

    nodes(conv_id, depth, leaf, saved) has every node's own part; chains(conv_id, top,
    above, at) has, for each smallest member, its chain's first depth and the node
    (above, at) it hangs from. Sums of whole chains go up the tree of chains by doubling:
    after round k a chain knows what hangs less than 2^k chains below it, and its
    2^k-th ancestor. The number of rounds is the logarithm of the number of chains on a path.
    """
    own = nodes.groupBy("conv_id").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    state = cut(own.join(chains.select("conv_id", F.col("above").alias("up")), "conv_id"), "chains")
    while state.where("up is not null").limit(1).count():
        lifted = state.where("up is not null").groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaf").alias("l2"), F.sum("saved").alias("s2"))
        ups = state.select(F.col("conv_id").alias("up"), F.col("up").alias("up2")).where("up2 is not null")
        after = state.join(lifted, "conv_id", "left").join(ups, "up", "left")
        after = cut(after.select("conv_id", (F.col("leaf") + F.coalesce("l2", F.lit(0))).alias("leaf"), (F.col("saved") + F.coalesce("s2", F.lit(0))).alias("saved"), F.col("up2").alias("up")), "chains")
        discard(state)
        state = after
    hung = chains.where("above is not null").join(state.select("conv_id", "leaf", "saved"), "conv_id")
    hung = hung.groupBy(F.col("above").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    parts = nodes.select("conv_id", "depth", "leaf", "saved").unionByName(hung).groupBy("conv_id", "depth").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return parts.select("conv_id", "depth", F.sum("leaf").over(below).alias("n_leaves"), F.sum("saved").over(below).alias("saved_tokens"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, node, n_words), a row per node.

    conversations needs conv_id, turn, role and text; other columns are ignored. Turns are
    ordered by turn, null first, ties by the digest of role and text; repeated rows are
    turns of their own. Null roles and texts are empty. Rows without conv_id belong to no
    conversation. Each conversation begins with up to 3 turns of its family's base, see
    FamilyTrie; one that is left without turns still counts at the root. An empty table
    has no conversations and gives no rows, not even a root.

    node is the chained digest. Texts of any length are digested before the first shuffle.
    """
    found = cut(family_nodes(turn_rows(conversations)), "families")
    merged = found.where("n_convs > 0").groupBy("node", "depth").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("n_words").alias("n_words"), F.max("parent").alias("parent"))
    merged = cut(merged, "nodes")
    digests = ends_digests(found.where("ends is not null").select("node", "base", "ends"))
    children = merged.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    full = merged.join(children, "node", "left").join(digests, "node", "left").join(parents, "parent", "left")
    none = hashlib.sha256(b"").hexdigest()
    full = full.select("node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_words", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
    full = cut(full, "trie")
    discard(found, merged)
    top = F.col("parent_conv_id").isNull() | (F.col("parent_conv_id") != F.col("conv_id"))
    chains = full.where(top).select("conv_id", F.col("parent_conv_id").alias("above"), (F.col("depth") - 1).alias("at"))
    own = full.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved"))
    return full.join(subtree_sums(own, chains), ["conv_id", "depth"])


def op11_trie(conversations: DataFrame) -> DataFrame:
    """Contract 11: every node of the trie of all rebuilt conversations. What odd rows give is said in prefix_trie()."""
    return prefix_trie(conversations).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


OP11_SQL = r"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said) - 1 AS p, said, n_words
  FROM (SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_words FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (SELECT DISTINCT conv_id, CRC_OF_ID % 4 AS h FROM own),
rebuilt AS (
  SELECT c.conv_id, c.h, o.p AS p, 0 AS part, o.said, o.n_words FROM convs c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.p < c.h
  UNION ALL
  SELECT c.conv_id, c.h, o.p, 1, o.said, o.n_words FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.p >= c.h
), paths AS (
  SELECT c.conv_id, coalesce(list(said ORDER BY part, p) FILTER (WHERE said IS NOT NULL), []) AS s, coalesce(list(n_words ORDER BY part, p) FILTER (WHERE said IS NOT NULL), []) AS w
  FROM convs c LEFT JOIN rebuilt r ON r.conv_id = c.conv_id GROUP BY c.conv_id
), steps AS (SELECT conv_id, d, s[1:d] AS path, CASE WHEN d = 0 THEN 0 ELSE w[d] END AS words, d = len(s) AS ends FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM paths)),
nodes AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM steps GROUP BY path, d
), kids AS (SELECT path[1:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY path[1:d - 1]),
vals AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.path = nodes.path),
sums AS (
  SELECT up AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved
  FROM (SELECT *, path[1:k] AS up FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM vals)) GROUP BY up
)
SELECT CAST(v.conv_id AS BIGINT) AS conv_id, CAST(v.d AS BIGINT) AS depth, CAST(u.conv_id AS BIGINT) AS parent_conv_id, CAST(v.n_convs AS BIGINT) AS n_convs, CAST(v.n_children AS BIGINT) AS n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, v.ends_sha256
FROM vals v JOIN sums s ON s.path = v.path LEFT JOIN nodes u ON v.d > 0 AND u.path = v.path[1:v.d - 1] AND u.d = v.d - 1
""".replace("CRC_OF_ID", common.crc32_sql("conv_id"))
