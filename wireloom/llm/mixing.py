"""Mixing sources to target weights, in DataFrame functions alone.

Words are packed into blocks of a fixed length, source by source. Every output shard
draws how many of its slots come from which source; those counts number each source's
slots, slots go through a pseudorandom permutation of the source's block numbers, and
blocks are joined by that number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wireloom.llm import common
from wireloom.session import cut

WEIGHTS = (3, 1, 2)
BLOCK = 128
ROUNDS = 12
SPAN = 1 << 16


def permuted(x: Column, n: Column, *key: Column, back: bool = False) -> Column:
    """A bijection of 0..n-1 chosen by key: ROUNDS swap-or-not rounds, each of which swaps x with pivot - x or leaves both. back undoes it: each round undoes itself, so they run in reverse."""

    def turn(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - at, n)
        return F.when(F.pmod(F.xxhash64(*key, r, F.greatest(at, other)), F.lit(2)) == 1, other).otherwise(at)

    rounds = F.sequence(F.lit(ROUNDS), F.lit(1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, x, turn)


def source_targets(sized: DataFrame, share: float = 1.5, ceiling: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, sid, source_size, target) of sized(source, size), a row for each source (null is one).

    Sources in code point order, null last, weigh weights in turn and share share times
    all sizes. A target stops at ceiling times its source's size and the rest is shared
    again by weight until none is above: with sources in the order of ceiling / weight
    those that stop come first, so running sums give the answer in one pass.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") - 1) % len(weights) + 1)).withColumn("_cap", F.col("source_size") * ceiling)
    upto = Window.orderBy(F.col("_cap") / F.col("_w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pool, all_w = F.sum("source_size").over(whole) * share, F.sum("_w").over(whole)
    level = F.try_divide(pool - F.coalesce(F.sum("_cap").over(upto), F.lit(0)), all_w - F.coalesce(F.sum("_w").over(upto), F.lit(0)))
    full = ranked.withColumn("_full", F.coalesce(F.col("_cap") < level * F.col("_w"), F.lit(False)))
    left = pool - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0)).over(whole)
    left_w = all_w - F.sum(F.when(F.col("_full"), F.col("_w")).otherwise(0)).over(whole)
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.coalesce(F.try_divide(left, left_w), F.lit(0.0)) * F.col("_w"))
    return full.select("source", "sid", "source_size", F.least(target, F.col("_cap").cast("double")).alias("target"))


def block_order(k: Column, sid: Column, blocks: Column, epoch: Column, seed: int, back: bool = False) -> Column:
    """The number of the block in place k of a source's order in an epoch; with back, the place of block k."""
    return permuted(k, blocks.cast("long"), F.lit(seed), sid, epoch.cast("long"), back=back)


def draw_plan(targets: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """targets with blocks (how many the source fills), slots (how many it gets), first (its first slot number) and last (words of its last slot).

    Every block has block words but a source's last, which may have fewer. A source is to
    give exactly its target, rounded to a word: whole epochs take all its blocks, and in the
    epoch after them slots go on, in that epoch's order, until the target is met; the last
    one is cut short. So small sources meet their targets as closely as large ones.
    """
    size, words = F.col("source_size"), F.round("target").cast("long")
    held = targets.withColumn("blocks", F.ceil(size / block).cast("long")).withColumn("_words", F.when(size > 0, words).otherwise(0)).withColumn("_full", F.coalesce(F.floor(F.try_divide(F.col("_words"), size)), F.lit(0)).cast("long"))
    held = held.withColumn("_rest", F.col("_words") - F.col("_full") * size).withColumn("_tail", size - (F.col("blocks") - 1) * block)
    # the place of the short block in the epoch that is cut: places up to it are full blocks
    held = held.withColumn("_at", F.when(F.col("_rest") > 0, block_order(F.col("blocks") - 1, F.col("sid"), F.col("blocks"), F.col("_full"), seed, back=True)).otherwise(0))
    upto = F.col("_at") * block
    rest = F.col("_rest")
    places = F.when(rest <= upto, F.ceil(rest / block)).when(rest <= upto + F.col("_tail"), F.col("_at") + 1).otherwise(F.col("_at") + 1 + F.ceil((rest - upto - F.col("_tail")) / block)).cast("long")
    held = held.withColumn("_places", F.when(rest > 0, places).otherwise(0))
    done = (F.col("_places") - 1) * block - F.when(F.col("_places") - 1 > F.col("_at"), block - F.col("_tail")).otherwise(0)
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("slots", F.col("_full") * F.col("blocks") + F.col("_places")).withColumn("last", F.when(rest > 0, rest - done).otherwise(block).cast("long"))
    return held.withColumn("first", F.coalesce(F.sum("slots").over(before), F.lit(0))).drop("_words", "_full", "_rest", "_tail", "_at", "_places")


def shard_counts(plan: DataFrame, shard_slots: int = 4096, seed: int = 0) -> DataFrame:
    """(shard, sid, n): the draw of every output shard, how many of its slots come from which source.

    All slots, in a pseudorandom order, are cut into shards of shard_slots, so a shard's
    counts are a multinomial draw on the condition that all shards together give each
    source its slots exactly. (Free draws would miss small sources' targets and send
    sources at the ceiling above it.)
    """
    total = plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    spans = plan.where("slots > 0").select("sid", "first", (F.col("first") + F.col("slots")).alias("_end"), F.explode(F.sequence(F.floor(F.col("first") / SPAN), F.floor((F.col("first") + F.col("slots") - 1) / SPAN))).alias("_span"))
    at = plan.sparkSession.range(total).select(F.col("id").alias("_q"), F.floor(F.col("id") / SPAN).alias("_span"))
    place = permuted(F.col("_q"), F.lit(max(1, total)).cast("long"), F.lit(seed))
    drawn = at.join(spans, "_span").where("_q >= first and _q < _end").select(F.floor(place / shard_slots).alias("shard"), "sid")
    return drawn.groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n"))


def draws(plan: DataFrame, shard_slots: int = 4096, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """(shard, slot, sid, epoch, block, upto): the block in every slot of every output shard, of which the first upto words are taken.

    The shards' counts number a source's slots one after another; slot number k of a source
    holds the block in place k modulo blocks of the source's order in that epoch, so a
    block comes once an epoch. A shard's slots run from 0 without a gap, by source.
    """
    counts = cut(shard_counts(plan, shard_slots, seed), "counts")
    numbered = common.before(counts, ["sid"], [F.col("shard")], "n", "_k")
    numbered = numbered.withColumn("_slot", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    each = numbered.select("shard", "sid", "_k", "_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("_i"))
    k = F.col("_k") + F.col("_i")
    found = each.join(plan.select(F.col("sid").alias("_sid"), "blocks", "slots", "last"), F.col("sid") == F.col("_sid"))
    epoch = F.floor(k / F.col("blocks"))
    return found.select("shard", (F.col("_slot") + F.col("_i")).alias("slot"), "sid", epoch.alias("epoch"), block_order(k % F.col("blocks"), F.col("sid"), F.col("blocks"), epoch, seed).alias("block"), F.when(k == F.col("slots") - 1, F.col("last")).otherwise(block).alias("upto"))


def pieces(sized: DataFrame, targets: DataFrame, key: list[str], block: int = BLOCK) -> DataFrame:
    """sized with sid, source_size, target and start (the words of its source before it), and a row for each block it reaches into: block, from, to (its words there), at (where they begin in the block)."""
    small = targets.select(F.col("source").alias("_source"), "sid", "source_size", "target")
    held = sized.join(small, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = common.before(held, ["sid"], [*[F.col(k) for k in key], F.col("size")], "size", "start")
    spread = placed.withColumn("block", F.explode(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).otherwise(F.array(F.lit(-1).cast("long")))))
    start = F.greatest(F.lit(0), F.col("block") * block - F.col("start"))
    end = F.least(F.col("size"), (F.col("block") + 1) * block - F.col("start"))
    return spread.withColumn("from", start).withColumn("to", F.greatest(end, start)).withColumn("at", F.greatest(F.lit(0), F.col("start") - F.col("block") * block))


def taken_words() -> Column:
    """How many words of a piece its slot takes: those before the slot's end; none without a slot."""
    return F.when(F.col("upto") > F.col("at"), F.least(F.col("to") - F.col("from"), F.col("upto") - F.col("at"))).otherwise(0)


def op4_mix(docs: DataFrame) -> DataFrame:
    """Contract 4: the words that the mix takes from every document, and where they go.

    A source's taken words are its target, rounded to a word. n_slots counts the slots that
    hold words of the document, and first_shard and first_slot are the first of them (null
    where nothing is taken). Null and empty texts have size 0 and are never taken. Null
    sources are one source, the last. Repeated rows are documents of their own; which of
    them gets which words is a matter of place, their rows together are always the same.
    Other columns are ignored. An empty table gives an empty result.
    """
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), common.n_words(F.col("text")).alias("size")), "sizes")
    targets = cut(source_targets(sized), "targets")
    drawn = draws(draw_plan(targets))
    held = pieces(sized.where("size > 0"), targets, ["doc_id"]).join(drawn, ["sid", "block"], "left").withColumn("_n", taken_words())
    some = held.groupBy("sid", "start", "doc_id", "size", "source_size", "target").agg(
        F.sum("_n").cast("long").alias("taken"), F.count(F.when(F.col("_n") > 0, 1)).alias("n_slots"), F.min(F.when(F.col("_n") > 0, F.struct("shard", "slot"))).alias("_first")
    )
    some = some.select("doc_id", "size", "source_size", "target", "taken", "n_slots", F.col("_first.shard").cast("long").alias("first_shard"), F.col("_first.slot").cast("long").alias("first_slot"))
    small = targets.select(F.col("source").alias("_source"), "source_size", "target")
    none = sized.where("size = 0").join(small, F.col("source").eqNullSafe(F.col("_source")))
    zero, nowhere = F.lit(0).cast("long"), F.lit(None).cast("long")
    return some.unionByName(none.select("doc_id", "size", "source_size", "target", zero.alias("taken"), zero.alias("n_slots"), nowhere.alias("first_shard"), nowhere.alias("first_slot")))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixed corpus as rows of documents: a row for every epoch in which blocks of a document are drawn, with the words drawn, in order.

    A document drawn whole keeps its text as it is; of others the drawn words stay, each
    with the white space after it. n_chars is counted anew. Null and empty texts are never
    drawn, and null sources are one source. Rows equal in doc_id, source and text are one
    row repeated. An empty table gives an empty one.
    """
    keyed = docs.select(common.packed(docs), F.col("doc_id"), F.col("source"), F.xxhash64("text").alias("_h"))
    sized = cut(docs.select("doc_id", "source", F.xxhash64("text").alias("_h"), common.n_words(F.col("text")).alias("size")), "sizes")
    targets = cut(source_targets(sized), "targets")
    parts = pieces(sized.where("size > 0"), targets, ["doc_id", "_h"]).join(draws(draw_plan(targets)), ["sid", "block"])
    parts = parts.withColumn("to", F.col("from") + taken_words()).where(F.col("to") > F.col("from"))
    rows = parts.groupBy("sid", "start", "doc_id", "source", "_h", "size", "epoch").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("_parts"), F.sum(F.col("to") - F.col("from")).alias("_n"))
    plan = rows.groupBy("doc_id", "source", "_h").agg(F.collect_list(F.struct(F.when(F.col("_n") < F.col("size"), F.col("_parts")).alias("parts"))).alias("_copies"))
    plan = plan.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("_h").alias("_k"), "_copies")
    one = keyed.dropDuplicates(["doc_id", "source", "_h"])
    on = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("_h") == F.col("_k"))
    out = one.join(plan, on).withColumn("_copy", F.explode("_copies"))
    tokens = F.regexp_extract_all("_row.text", F.lit("[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*"), F.lit(0))
    chosen = F.array_join(F.transform(F.col("_copy.parts"), lambda p: F.array_join(F.slice(F.col("_tokens"), (p["from"] + 1).cast("int"), (p["to"] - p["from"]).cast("int")), "")), "")
    text = F.when(F.col("_copy.parts").isNull(), F.col("_row.text")).otherwise(chosen)
    out = out.withColumn("_tokens", F.when(F.col("_copy.parts").isNotNull(), tokens)).withColumn("_text", text)
    anew = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        anew["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[anew.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
