"""Snapshots of graphs, their differences, and upserts of fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff_edges(before: DataFrame, after: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """(keys, change, attribute, previous, new): edges added and removed, and every attribute that differs. One full outer join."""
    b = before.select(*keys, F.struct(*[F.col(a).cast("string").alias(a) for a in attributes]).alias("_b"))
    a = after.select(*keys, F.struct(*[F.col(x).cast("string").alias(x) for x in attributes]).alias("_a"))
    both = b.join(a, keys, "full_outer")
    kind = "struct<change:string,attribute:string,previous:string,new:string>"
    changed = F.array_compact(F.array(*[F.when(~F.col(f"_b.{x}").eqNullSafe(F.col(f"_a.{x}")), F.struct(F.lit("attribute_changed").alias("change"), F.lit(x).alias("attribute"), F.col(f"_b.{x}").alias("previous"), F.col(f"_a.{x}").alias("new"))) for x in attributes]))
    none = F.lit(None).cast("string")

    def whole(change: str):  # noqa: ANN202
        return F.array(F.struct(F.lit(change).alias("change"), none.alias("attribute"), none.alias("previous"), none.alias("new")))

    events = F.when(F.col("_b").isNull(), whole("edge_added")).when(F.col("_a").isNull(), whole("edge_removed")).otherwise(changed.cast(f"array<{kind}>"))
    return both.withColumn("_x", F.explode(events)).select(*keys, "_x.change", "_x.attribute", "_x.previous", "_x.new")


def diff_nodes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change) of nodes added and removed."""
    both = before.select(*keys, F.lit(1).alias("_b")).join(after.select(*keys, F.lit(1).alias("_a")), keys, "full_outer")
    return both.where("_b is null or _a is null").select(*keys, F.when(F.col("_b").isNull(), "node_added").otherwise("node_removed").alias("change"))


def timeline(versions: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """Differences of consecutive versions of versions(version, keys, attributes), all in one pass.

    Each row meets the row of its key one version later; a row without one was removed,
    unless it is of the last version, and a row without an earlier one was added, unless
    it is of the first.
    """
    bounds = versions.agg(F.min("version"), F.max("version")).first()
    first, last = bounds if bounds[0] is not None else (0, 0)
    now = versions.select(*keys, F.col("version"), F.struct(*[F.col(a).cast("string").alias(a) for a in attributes]).alias("_a"))
    was = versions.where(F.col("version") < last).select(*keys, (F.col("version") + 1).alias("version"), F.struct(*[F.col(a).cast("string").alias(a) for a in attributes]).alias("_b"))
    both = now.where(F.col("version") > first).join(was, [*keys, "version"], "full_outer")
    none = F.lit(None).cast("string")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"_b.{x}").eqNullSafe(F.col(f"_a.{x}")), F.struct(F.lit("attribute_changed").alias("change"), F.lit(x).alias("attribute"), F.col(f"_b.{x}").alias("previous"), F.col(f"_a.{x}").alias("new"))) for x in attributes]))

    def whole(change: str):  # noqa: ANN202
        return F.array(F.struct(F.lit(change).alias("change"), none.alias("attribute"), none.alias("previous"), none.alias("new")))

    events = F.when(F.col("_b").isNull(), whole("edge_added")).when(F.col("_a").isNull(), whole("edge_removed")).otherwise(changed)
    return both.withColumn("_x", F.explode(events)).select(F.col("version").alias("to_version"), *keys, "_x.change", "_x.attribute", "_x.previous", "_x.new")


def added_edges(versions: DataFrame, keys: list[str]) -> DataFrame:
    """(to_version, keys): the edge_added events of timeline() alone, from versions(version, keys), where rows may be repeated. Rows are sent to their key once, without attributes."""
    first = versions.agg(F.min("version")).first()[0]
    rows = versions.select(*keys, "version").repartition(*keys).distinct()
    was = F.lag("version").over(Window.partitionBy(*keys).orderBy("version"))
    named = F.concat(*[F.col(k).cast("string") for k in keys]).isNotNull()  # a key with a null is no other row's
    known = F.coalesce(named & (was == F.col("version") - 1), F.lit(False))
    return rows.withColumn("_known", known).where(~F.col("_known") & (F.col("version") > F.lit(first))).select(F.col("version").alias("to_version"), *keys)


def valid_between(snapshots: DataFrame) -> DataFrame:
    """(version, from_us, to_us) of snapshots(version, captured_us): what a snapshot has that the one before doesn't began after from_us (null: ever) and by to_us."""
    w = Window.orderBy("captured_us", "version")  # a row per snapshot
    return snapshots.select("version", F.lag("captured_us").over(w).alias("from_us"), F.col("captured_us").alias("to_us"))


def versions_of_flows(flows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """flows with version: the first snapshot that was captured when or after the flow began; flows after the last one drop out.

    Time is dealt into buckets of the mean interval, an interval stands in every bucket that
    it touches, and flows meet the intervals of their own bucket only.
    """
    spans = valid_between(snapshots)
    bounds = snapshots.agg(F.min("captured_us"), F.max("captured_us"), F.count(F.lit(1))).first()
    if not bounds[2]:
        return flows.withColumn("version", F.lit(None).cast("long")).where("1 = 0")
    low, high = bounds[0], bounds[1]
    width = max(1, (high - low) // max(1, bounds[2] - 1))
    bucket = lambda us: F.floor((us - F.lit(low)) / F.lit(width)).cast("long")
    first = F.coalesce(bucket(F.col("from_us") + 1), F.lit(-1).cast("long"))  # bucket -1 takes all that is before the first snapshot
    spans = spans.withColumn("_b", F.explode(F.sequence(F.greatest(F.lit(-1).cast("long"), first), bucket(F.col("to_us")))))
    keyed = flows.where(F.col("first_us") <= high).withColumn("_b", F.greatest(F.lit(-1).cast("long"), bucket(F.col("first_us"))))
    inside = (F.col("first_us") > F.col("from_us")) | F.col("from_us").isNull()
    return keyed.join(spans, "_b").where(inside & (F.col("first_us") <= F.col("to_us"))).drop("_b", "from_us", "to_us")


def flows_of_changes(changes: DataFrame, flows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(changes' columns, flow_id): the flows between a change's ends that began in the interval that its snapshot closes.

    changes has to_version, source and target, flows has flow_id, src_ip, dst_ip and
    first_us, in either direction. A change without such flows (an edge that went away)
    has one row with a null flow_id; a repeated flow_id counts once. Flows are rows, not a list, so a busy pair is no row of its own size.
    """
    placed = versions_of_flows(flows.where("src_ip <> dst_ip"), snapshots)
    placed = placed.select(F.col("version").alias("to_version"), F.least("src_ip", "dst_ip").alias("_lo"), F.greatest("src_ip", "dst_ip").alias("_hi"), "flow_id").distinct()
    ends = changes.withColumn("_lo", F.least("source", "target")).withColumn("_hi", F.greatest("source", "target"))
    return ends.join(placed, ["to_version", "_lo", "_hi"], "left").drop("_lo", "_hi")


def counted_flows_of_changes(changes: DataFrame, flows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """changes' columns with flows, first_flow and last_flow: the number of flow_ids that flows_of_changes() finds, the least and the greatest. Flows are counted where they are sent, and meet the changes as one row."""
    where = ["to_version", "_lo", "_hi"]
    placed = versions_of_flows(flows.where("src_ip <> dst_ip"), snapshots)
    placed = placed.select(F.col("version").alias("to_version"), F.least("src_ip", "dst_ip").alias("_lo"), F.greatest("src_ip", "dst_ip").alias("_hi"), "flow_id").repartition(*where)
    counted = placed.distinct().groupBy(*where).agg(F.count("flow_id").alias("flows"), F.min("flow_id").alias("first_flow"), F.max("flow_id").alias("last_flow"))
    ends = changes.withColumn("_lo", F.least("source", "target")).withColumn("_hi", F.greatest("source", "target"))
    return ends.join(counted, where, "left").withColumn("flows", F.coalesce("flows", F.lit(0).cast("long"))).drop("_lo", "_hi")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of every key over both tables, ties to new."""
    both = old.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc(), F.col("_p").desc())
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_p")


def history_range(events: DataFrame, column: str, start, end, order: list[str], limit: int, offset: int = 0) -> DataFrame:  # noqa: ANN001
    """A page of the events between start and end, both included."""
    return events.where(F.col(column).between(start, end)).orderBy(*order).offset(offset).limit(limit)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, as often."""
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def describe_change(events: DataFrame) -> DataFrame:
    """events with a sentence for each change."""
    return events.withColumn("text", F.concat_ws(" ", F.regexp_replace("change", "_", " "), F.concat_ws("-", "source", "target"), F.when(F.col("attribute").isNotNull(), F.concat(F.col("attribute"), F.lit(": "), F.coalesce("previous", F.lit("none")), F.lit(" to "), F.coalesce("new", F.lit("none"))))))
