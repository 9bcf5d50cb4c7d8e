"""Balanced label propagation: linked documents move towards their neighbours' shards under quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.llm import common
from wireloom.session import cut, discard

FRACTION = 1 << 20
#: Nodes of a link that are kept side by side when a shard gives rows away.
HOME = 1000


def first_shard(node: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.col(node), F.lit(17)), F.lit(shards)).cast("int")


def propagate(links: DataFrame, shards: int, quota: int, n: int | None = None) -> DataFrame:
    """(node, label, home) for the nodes of links(node, link): nodes of a link are neighbours of each other.

    A link of more nodes than the quota fits no shard; it is split by a hash of the node into
    parts of about half the quota, which find room. Nodes start in the shard of their
    smallest link, their home (in one of more than HOME nodes each is its own home), so a
    link whose nodes have no other starts as a whole. Each round counts the nodes of every
    (link, shard); a node prefers the shard that most of its neighbours are in, over all its
    links, where a neighbour counts the less the more nodes its link has (ties: by a hash of
    link and shard, so no shard draws them all).
    Shards admit movers, link by link, until their linked nodes fill the quota; nodes
    without links need no counting here, as they can go anywhere at no cost afterwards.
    Rounds go on as long as fewer nodes, by that weight, are away from most of their link
    than ever before; that number falls from round to round, so they end, and the labels
    with the least are the result. n bounds the rows of links.
    """
    most = max(1, quota)
    counted = links.groupBy("link").agg(F.count(F.lit(1)).alias("whole"))
    part = F.when(F.col("whole") > most, F.pmod(F.xxhash64("node", F.lit(3)), F.ceil(F.col("whole") * 2 / most)))
    links = cut(links.join(counted, "link").select("node", F.xxhash64("link", part).alias("link"), "whole"), "links", n)
    sizes = cut(links.groupBy("link").agg(F.count(F.lit(1)).alias("of"), F.min("whole").alias("whole")), "sizes", n)
    links = links.drop("whole")
    homes = links.join(sizes, "link").groupBy("node").agg(F.min(F.struct("whole", "link", "of")).alias("_t"))
    homes = cut(homes.select("node", F.col("_t.link").alias("_first"), F.when(F.col("_t.of") <= HOME, F.col("_t.link")).otherwise(F.xxhash64("node", F.lit(5))).alias("home")), "homes", n)
    state = cut(homes.select("node", first_shard("_first", shards).alias("label")), "labels", n)
    least, best, turn = None, state, 0
    while True:
        votes = links.join(state, "node").groupBy("link", "label").agg(F.count(F.lit(1)).alias("n"))
        top = votes.groupBy("link").agg(F.max(F.struct(F.col("n"), F.xxhash64("link", "label").alias("_h"), F.col("label"))).alias("_t")).select("link", F.col("_t.label").alias("to"), F.col("_t.n").alias("n"))
        top = cut(top.join(sizes, "link"), "tops", n)
        away = top.agg(F.sum(((F.col("of") - F.col("n")) * FRACTION / F.col("whole")).cast("long"))).first()[0] or 0
        if least is not None and away >= least:
            discard(top, state)
            break
        if best is not state:
            discard(best)
        least, best = away, state
        if not away:
            discard(top)
            break
        weight = (F.col("n") * F.lit(FRACTION) / F.col("whole") / F.col("whole")).cast("long")  # whole numbers, so that sums don't depend on their order
        wish = links.join(top, "link").groupBy("node", "to").agg(F.sum(weight).alias("n"), F.min("link").alias("link"))
        wish = wish.groupBy("node").agg(F.max(F.struct("n", "link", "to")).alias("_t")).select("node", F.col("_t.to").alias("to"), F.col("_t.link").alias("link"))
        both = cut(state.join(wish, "node", "left").select("node", "label", F.coalesce("to", "label").alias("to"), "link"), "wishes", n)
        flow = {(r.label, r.to): r.n for r in both.groupBy("label", "to").agg(F.count(F.lit(1)).alias("n")).collect()}  # shards * shards rows at most
        held, into, out = {}, {}, {}
        for (a, b), m in flow.items():
            held[a] = held.get(a, 0) + m
            if a != b:
                into[b], out[a] = into.get(b, 0) + m, out.get(a, 0) + m
        if not into:
            discard(both, top)
            break
        share = [min(1.0, max(0.0, (quota - held.get(s, 0) + out.get(s, 0)) / into[s])) if into.get(s) else 0.0 for s in range(shards)]
        admitted = F.element_at(F.array(*[F.lit(int(x * FRACTION)) for x in share]), F.col("to") + 1)
        moves = (F.col("to") != F.col("label")) & (F.pmod(F.xxhash64("link", F.lit(turn)), F.lit(FRACTION)) < admitted)
        state = cut(both.select("node", F.when(moves, F.col("to")).otherwise(F.col("label")).alias("label")), "labels", n)
        discard(both, top)
        turn += 1
    discard(links, sizes)
    return best.join(homes.select("node", "home"), "node")


def balanced_shards(rows: DataFrame, links: DataFrame, shards: int = 24, n_links: int | None = None) -> DataFrame:
    """rows(node, ...) with shard and slot: counts of rows at most one apart, slots gapless from 0.

    links(node, link) says which nodes belong together. After propagation every shard
    keeps its first rows up to its exact quota, linked ones first; the rest fill the
    shards below theirs, those of a home side by side. Ranks come from bucketed running sums, so neither a shard nor a
    group is sorted in one task. Rows that share a node get one label. n_links bounds the
    rows of links (by default that of rows).
    """
    total = rows.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    shared = links.where("node is not null and link is not null").distinct()
    several = shared.groupBy("link").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("link")
    n_links = total if n_links is None else n_links
    shared = cut(shared.join(several, "link"), "linked", n_links)
    labels = propagate(shared, shards, max(quotas, default=0), n_links)
    held = rows.join(labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"), F.col("home").alias("_home")), F.col("node") == F.col("_node"), "left")
    held = held.select(*rows.columns, F.coalesce("_home", F.xxhash64(*rows.columns)).alias("_home"), F.coalesce("_label", first_shard("node", shards)).alias("_label"), F.col("_label").isNull().cast("int").alias("_class"), F.lit(1).cast("long").alias("_one"))
    held = cut(held, "labelled", total)
    counts = {(r[0], r[1]): r[2] for r in held.groupBy("_label", "_class").count().collect()}  # two rows per shard at most
    size = [counts.get((s, 0), 0) + counts.get((s, 1), 0) for s in range(shards)]
    over, short, deficits = [0], [0], []
    for s in range(shards):
        over.append(over[-1] + max(0, size[s] - quotas[s]))
        deficits.append(max(0, quotas[s] - size[s]))
        short.append(short[-1] + deficits[-1])

    def pick(values: list[int], at: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (at + 1).cast("int"))

    ranked = common.before(held, ["_label", "_class"], [F.col(c) for c in rows.columns], "_one", "_rank", together=F.col("_home"))
    rank = F.col("_rank") + F.when(F.col("_class") == 1, pick([counts.get((s, 0), 0) for s in range(shards)], F.col("_label"))).otherwise(0)
    ranked = ranked.withColumn("_r", rank).withColumn("_spare", F.col("_r") - pick(quotas, F.col("_label")))
    index = pick(over, F.col("_label")) + F.col("_spare")
    goes = F.size(F.filter(F.array(*[F.lit(v).cast("long") for v in short[1:]]), lambda v: v <= F.col("_index")))
    ranked = ranked.withColumn("_index", index).withColumn("_goes", goes)
    stays = F.col("_spare") < 0
    slot = F.when(stays, F.col("_r")).otherwise(pick([min(a, b) for a, b in zip(size, quotas)], F.least("_goes", F.lit(shards - 1))) + F.col("_index") - pick(short[:-1], F.least("_goes", F.lit(shards - 1))))
    return ranked.select(*rows.columns, F.when(stays, F.col("_label")).otherwise(F.col("_goes")).cast("int").alias("shard"), slot.cast("long").alias("slot"))


def digests(docs: DataFrame) -> DataFrame:
    """(node, text_key, doc_id, size, text_crc32): a null text has size 8 and the checksum of no bytes; a null doc_id is known by its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.xxhash64(text)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), key).alias("node"), key.alias("text_key"), F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def op6_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Contract 6 under the law 'rows': equal texts are links.

    Null texts count as empty ones and have size 8. Repeated rows are placed row by row, ties
    fall by hash. A null doc_id is known by its text. Other columns are ignored; an empty
    table gives an empty result.
    """
    rows = cut(digests(docs), "digests")
    placed = balanced_shards(rows, rows.select("node", F.col("text_key").alias("link")), shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


LINE = 24


def shared_lines(docs: DataFrame) -> DataFrame:
    """(node, link): the distinct lines of LINE characters or more of every document, as hashes. Equal texts without one are linked by the whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.xxhash64(text)
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= LINE)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), key).alias("node"), F.explode(F.array_union(F.array(key), F.transform(lines, lambda x: F.xxhash64(x, F.lit(1))))).alias("link"))


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """docs with shard and slot added (columns of these names in docs give way).

    Documents are linked by equal texts and by long lines that they share. Null texts count
    as empty ones, a null doc_id is known by its text, and rows equal in doc_id and text are
    one row repeated. An empty table gives an empty one.
    """
    rows = cut(digests(docs), "digests")
    links = shared_lines(docs)
    # lines that stand in one document link nothing, and go before they are written
    links = links.groupBy("link").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi")).where("_lo <> _hi").select("link").join(links, "link").select("node", "link").distinct()
    links = cut(links, "lines")
    placed = balanced_shards(rows, links, shards, links.count())
    lists = placed.groupBy(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).agg(F.collect_list(F.struct("shard", "slot")).alias("_places"))
    keyed = docs.select(common.packed(docs), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_h"))
    one = keyed.dropDuplicates(["_id", "_h"])
    out = one.join(lists, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_k")))
    out = out.select("_row", F.inline("_places"))
    return out.select(*common.unpacked(out, "shard", "slot"))
