"""Behaviour of nodes: features, trailing and tumbling windows, robust baselines, drift, anomalies, evolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wireloom.functions.expressions import SECOND

WINDOWS = (("short", 10), ("medium", 60), ("long", 300))
FEATURES = ("distinct_destinations", "mean_flow_duration_seconds", "outbound_byte_ratio", "total_byte_count")
MAD_FLOOR = 1e-6


def touches(flows: DataFrame) -> DataFrame:
    """A row per flow and node it touches (a flow to oneself once): ip, is_src, and the flow's columns."""
    ends = F.when(F.col("src_ip") == F.col("dst_ip"), F.array(F.struct(F.col("src_ip").alias("ip"), F.lit(True).alias("is_src"), F.lit(True).alias("is_dst")))).otherwise(
        F.array(F.struct(F.col("src_ip").alias("ip"), F.lit(True).alias("is_src"), F.lit(False).alias("is_dst")), F.struct(F.col("dst_ip").alias("ip"), F.lit(False).alias("is_src"), F.lit(True).alias("is_dst")))
    )
    return flows.withColumn("_e", F.explode(ends)).select("*", F.col("_e.ip").alias("ip"), F.col("_e.is_src").alias("is_src"), F.col("_e.is_dst").alias("is_dst")).drop("_e")


def feature_columns() -> list[Column]:
    sent = F.when(F.col("is_src"), F.col("byte_count") * F.col("forward_byte_ratio")).otherwise(F.col("byte_count") * (1 - F.col("forward_byte_ratio")))
    return [
        F.array_sort(F.collect_set(F.when(F.col("is_dst"), F.col("dst_port")))).alias("distinct_ports"), F.array_sort(F.collect_set("protocol")).alias("distinct_protocols"),
        F.count_distinct(F.when(F.col("is_src"), F.col("dst_ip"))).alias("distinct_destinations"), F.avg("duration_seconds").alias("mean_flow_duration_seconds"),
        F.coalesce(F.try_divide(F.sum(sent), F.sum("byte_count")), F.lit(0.0)).cast("double").alias("outbound_byte_ratio"), F.bool_or("is_persistent").alias("is_persistent_talker"), F.sum("byte_count").cast("long").alias("total_byte_count"),
    ]


def node_features(flows: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Features by (capture_id, ip); nodes adds all-zero rows for nodes without flows."""
    out = touches(flows).groupBy("capture_id", "ip").agg(*feature_columns())
    return out if nodes is None else zero_filled(nodes.select("capture_id", "ip").distinct(), out, ["capture_id", "ip"])


def zero_filled(keys: DataFrame, features: DataFrame, on: list[str]) -> DataFrame:
    joined = keys.join(features, on, "left")
    empty = {"distinct_ports": F.array().cast("array<int>"), "distinct_protocols": F.array().cast("array<string>"), "is_persistent_talker": F.lit(False)}
    return joined.select(*on, *[F.coalesce(F.col(c), empty.get(c, F.lit(0).cast(features.schema[c].dataType))).alias(c) for c in features.columns if c not in on])


def window_features(flows: DataFrame, windows: tuple[tuple[str, int], ...] = WINDOWS) -> DataFrame:
    """Features of each node over trailing windows that end at its own last flow; a window is open on the left."""
    t = touches(flows).withColumn("_anchor", F.max("last_us").over(Window.partitionBy("capture_id", "ip")))
    inside = F.array(*[F.when(F.col("last_us") > F.col("_anchor") - s * SECOND, F.lit(name)) for name, s in windows])
    return t.withColumn("window", F.explode(F.array_compact(inside))).groupBy("capture_id", "ip", "window").agg(*feature_columns())


def epoch_fingerprints(flows: DataFrame, epoch_seconds: float, start_us: int = 0, nodes: DataFrame | None = None, epochs: tuple[int, int] | None = None) -> DataFrame:
    """Features by tumbling epoch: a flow counts where its last packet lies. With nodes and epochs (first, end), missing ones are zero."""
    t = touches(flows).withColumn("epoch", F.floor((F.col("last_us") - start_us) / (epoch_seconds * SECOND)).cast("long"))
    out = t.groupBy("capture_id", "ip", "epoch").agg(*feature_columns())
    if nodes is None or epochs is None:
        return out
    keys = nodes.select("capture_id", "ip").distinct().withColumn("epoch", F.explode(F.sequence(F.lit(epochs[0]).cast("long"), F.lit(epochs[1] - 1).cast("long"))))
    return zero_filled(keys, out, ["capture_id", "ip", "epoch"])


def unpivoted(fingerprints: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    keys = [c for c in ("capture_id", "ip", "epoch") if c in fingerprints.columns]
    pairs = ", ".join(f"'{f}', cast(`{f}` as double)" for f in features)
    return fingerprints.selectExpr(*keys, f"stack({len(features)}, {pairs}) as (feature, value)")


def baseline(history: DataFrame, anchor: int | None = None, least: int = 5) -> DataFrame:
    """(capture_id, ip, feature, med, mad, n, sufficient): median and unscaled median deviation of each feature over a node's epochs; anchor keeps its oldest epochs alone."""
    if anchor is not None:
        history = history.withColumn("_k", F.row_number().over(Window.partitionBy("capture_id", "ip").orderBy("epoch"))).where(F.col("_k") <= anchor).drop("_k")
    keys = ["capture_id", "ip", "feature"]
    long = unpivoted(history)
    med = long.groupBy(*keys).agg(F.median("value").alias("med"), F.count(F.lit(1)).alias("n"))
    return long.join(med, keys).groupBy(*keys).agg(F.first("med").alias("med"), F.median(F.abs(F.col("value") - F.col("med"))).alias("mad"), F.first("n").alias("n")).withColumn("sufficient", F.col("n") >= least)


def historical_sets(history: DataFrame) -> DataFrame:
    """(capture_id, ip, ports, protocols): every port and protocol of the history."""
    return history.groupBy("capture_id", "ip").agg(F.array_distinct(F.flatten(F.collect_list("distinct_ports"))).alias("ports"), F.array_distinct(F.flatten(F.collect_list("distinct_protocols"))).alias("protocols"))


def z_score(value: Column) -> Column:
    return (value - F.col("med")) / F.greatest(F.col("mad"), F.lit(MAD_FLOOR))


def continuous_anomalies(base: DataFrame, fingerprints: DataFrame, threshold: float = 3.0) -> DataFrame:
    """(capture_id, ip, epoch, feature, value, z, score) of values at least threshold deviations from a sufficient baseline."""
    z = z_score(F.col("value"))
    out = unpivoted(fingerprints).join(base.where("sufficient"), ["capture_id", "ip", "feature"]).withColumn("z", z).where(F.abs("z") >= threshold)
    return out.select("capture_id", "ip", "epoch", "feature", "value", "z", (1 - F.exp(-F.abs("z") / threshold)).alias("score"))


def novelty_anomalies(history: DataFrame, fingerprints: DataFrame, scale: float = 1.0, least: int = 5) -> DataFrame:
    """(capture_id, ip, epoch, dimension, novel, score): ports and protocols that the history doesn't have."""
    known = historical_sets(history).join(history.groupBy("capture_id", "ip").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least), ["capture_id", "ip"])
    both = fingerprints.join(known, ["capture_id", "ip"])
    new = F.array(F.struct(F.lit("port").alias("dimension"), F.array_except("distinct_ports", "ports").cast("array<string>").alias("novel")), F.struct(F.lit("protocol").alias("dimension"), F.array_except("distinct_protocols", "protocols").alias("novel")))
    rows = both.withColumn("_x", F.explode(new)).where(F.size("_x.novel") > 0)
    return rows.select("capture_id", "ip", "epoch", F.col("_x.dimension").alias("dimension"), F.array_sort("_x.novel").alias("novel"), (1 - F.exp(-F.size("_x.novel") * F.lit(scale))).alias("score"))


def drift(base: DataFrame, fingerprints: DataFrame, alpha: float = 0.05, threshold: float = 2.0) -> DataFrame:
    """(capture_id, ip, feature, ewma, deviation, class): an exponential average from the baseline's median over the epochs in order."""
    series = unpivoted(fingerprints).groupBy("capture_id", "ip", "feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("epoch", "value"))), lambda x: x["value"]).alias("_v"))
    joined = series.join(base, ["capture_id", "ip", "feature"])
    ewma = F.aggregate("_v", F.col("med"), lambda e, x: F.lit(alpha) * x + F.lit(1 - alpha) * e)
    deviation = F.abs(ewma - F.col("med")) / F.greatest(F.col("mad"), F.lit(MAD_FLOOR))
    return joined.select("capture_id", "ip", "feature", ewma.alias("ewma"), deviation.alias("deviation"), F.when(deviation >= threshold, "concept_drift").otherwise("transient_anomaly").alias("class"))


def anomalies_with_drift(base: DataFrame, fingerprints: DataFrame, threshold: float = 3.0, alpha: float = 0.05, drift_threshold: float = 2.0, history: DataFrame | None = None) -> DataFrame:
    """(capture_id, ip, epoch, dimension, z, novel, score, class): what is unusual in each node's last fingerprint, and whether it is drift.

    A feature's class is that of drift() over all fingerprints of the node in order. With
    history, ports and protocols that it doesn't have are rows too, without z and always
    transient. Nodes without a sufficient baseline have no rows.
    """
    last = fingerprints.groupBy("capture_id", "ip").agg(F.max("epoch").alias("epoch"))
    newest = fingerprints.join(last, ["capture_id", "ip", "epoch"], "left_semi")
    classes = drift(base, fingerprints, alpha, drift_threshold).select("capture_id", "ip", "feature", "class")
    found = continuous_anomalies(base, newest, threshold).join(classes, ["capture_id", "ip", "feature"])
    found = found.select("capture_id", "ip", "epoch", F.col("feature").alias("dimension"), "z", F.lit(None).cast("array<string>").alias("novel"), "score", "class")
    if history is None:
        return found
    new = novelty_anomalies(history, newest)
    return found.unionByName(new.select("capture_id", "ip", "epoch", "dimension", F.lit(None).cast("double").alias("z"), "novel", "score", F.lit("transient_anomaly").alias("class")))


def sustained_drift(base: DataFrame, fingerprints: DataFrame, feature: str = "total_byte_count", drift_z: float = 1.5, least: int = 3) -> DataFrame:
    """(capture_id, ip, epoch, z): the first epoch that ends least epochs of z at or above drift_z, each above the one before."""
    b = base.where((F.col("feature") == feature) & F.col("sufficient"))
    w = Window.partitionBy("capture_id", "ip").orderBy("epoch")
    zs = unpivoted(fingerprints, (feature,)).join(b, ["capture_id", "ip", "feature"]).withColumn("z", z_score(F.col("value")))
    rises = F.col("z") >= drift_z
    for k in range(1, least):
        rises = rises & (F.lag("z", k).over(w) >= drift_z) & (F.lag("z", k - 1).over(w) > F.lag("z", k).over(w)) if k > 1 else rises & (F.lag("z", 1).over(w) >= drift_z) & (F.col("z") > F.lag("z", 1).over(w))
    return zs.withColumn("_r", rises).where("_r").withColumn("_k", F.row_number().over(w)).where("_k = 1").select("capture_id", "ip", "epoch", "z")


def evolution(fingerprints: DataFrame, fields: tuple[str, ...] = FEATURES) -> DataFrame:
    """(capture_id, ip, epoch, field, before, after): every field that differs from the node's fingerprint before; sets as sorted lists."""
    texts = {f: F.col(f).cast("string") for f in fields} | {f: F.array_join(F.col(f).cast("array<string>"), ",") for f in ("distinct_ports", "distinct_protocols") if f in fingerprints.columns}
    w = Window.partitionBy("capture_id", "ip").orderBy("epoch")
    held = fingerprints.select("capture_id", "ip", "epoch", F.struct(*[t.alias(f) for f, t in texts.items()]).alias("now")).withColumn("was", F.lag("now").over(w)).where("was is not null")
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"was.{f}").alias("before"), F.col(f"now.{f}").alias("after")) for f in texts])
    return held.withColumn("_x", F.explode(rows)).where(~F.col("_x.before").eqNullSafe(F.col("_x.after"))).select("capture_id", "ip", "epoch", "_x.field", "_x.before", "_x.after")


def partial_window_trusted(anomalies: DataFrame) -> DataFrame:
    """Continuous anomalies that count before a window has closed: destinations or volume above the baseline."""
    return anomalies.where(F.col("feature").isin("distinct_destinations", "total_byte_count") & (F.col("z") > 0))
