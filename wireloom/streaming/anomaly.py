"""Anomalies of nodes in a stream of flows, judged while an epoch is open and again, in full, when it closes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wireloom.functions.expressions import SECOND
from wireloom.operators import behavior
from wireloom.session import cut
from wireloom.streaming.engine import _exists, place_of

NODE = ["capture_id", "ip"]


class StreamingAnomalies:
    """(capture_id, ip, epoch, feature, z, partial) alerts against a baseline, once for each node, epoch and feature.

    State are sums by node and epoch, and the distinct destinations, in Parquet by epoch; a
    batch reads the epochs that are open when it comes and no earlier ones. Event time is
    the latest flow end seen. While an epoch is open, the nodes of a batch are judged by
    destinations and volume above the baseline, which more flows can't undo. Once time
    passes its end, every node of the baseline is judged on all of it, those without a
    flow too (their features are zero, unless silent is False). flush() judges the open
    epoch as if it had closed. Epochs in which nobody had a flow are passed over. Flows
    of a closed epoch come too late and are left out. The caller may name the place of the
    state, so that a stream that is started again goes on where it was.
    """

    def __init__(self, spark: SparkSession, base: DataFrame, epoch_seconds: float, start_us: int, threshold: float = 3.0, silent: bool = True, place: str | None = None) -> None:
        self.spark, self.threshold, self.silent = spark, threshold, silent
        self.width, self.start_us = int(epoch_seconds * SECOND), start_us
        self.base = cut(base.where("sufficient"), "baseline")
        self.place = place_of(spark, "anomalies", place)
        self.last = -1

    def _epoch(self, us) -> F.Column:  # noqa: ANN001
        return F.floor((us - F.lit(self.start_us)) / self.width).cast("long")

    def _state(self, name: str) -> DataFrame:
        rows = self.spark.read.option("basePath", f"{self.place}/{name}").parquet(f"{self.place}/{name}/_batch=*")
        return rows.withColumn("epoch", F.col("epoch").cast("long"))

    def _open(self, number: int) -> int | None:
        """The epoch that was open when a batch came."""
        if not _exists(self.spark, f"{self.place}/clock"):
            return None
        return self._state("clock").where(F.col("_batch") < number).agg(F.max("epoch")).first()[0]

    def ingest(self, flows: DataFrame, number: int) -> None:
        self.last = max(self.last, number)
        was = self._open(number)
        t = behavior.touches(flows.withColumn("epoch", self._epoch(F.col("last_us"))))
        if was is not None:
            t = t.where(F.col("epoch") >= was)
        sent = F.when(F.col("is_src"), F.col("byte_count") * F.col("forward_byte_ratio")).otherwise(F.col("byte_count") * (1 - F.col("forward_byte_ratio")))
        t = cut(t.select(*NODE, "epoch", "duration_seconds", "byte_count", sent.alias("sent"), F.when(F.col("is_src"), F.col("dst_ip")).alias("peer")), "touches")
        sums = t.groupBy(*NODE, "epoch").agg(F.count(F.lit(1)).alias("flows"), F.sum("duration_seconds").alias("duration"), F.sum("sent").alias("sent"), F.sum("byte_count").cast("long").alias("bytes"))
        sums.write.mode("overwrite").partitionBy("epoch").parquet(f"{self.place}/sums/_batch={number}")
        t.where("peer is not null").select(*NODE, "epoch", "peer").distinct().write.mode("overwrite").partitionBy("epoch").parquet(f"{self.place}/peers/_batch={number}")
        newest = t.agg(F.max("epoch")).first()[0]
        now = newest if was is None else max(was, was if newest is None else newest)
        self.spark.createDataFrame([(now,)], "epoch long").write.mode("overwrite").parquet(f"{self.place}/clock/_batch={number}")
        if now is None:
            return
        found = self.judged(now, now, number, False).join(t.select(*NODE).distinct(), NODE, "left_semi")
        found = behavior.partial_window_trusted(found).withColumn("partial", F.lit(True))
        if was is None or was < now:
            first = was if was is not None else t.agg(F.min("epoch")).first()[0]
            found = found.unionByName(self.judged(first, now - 1, number, self.silent).withColumn("partial", F.lit(False)))
        found.write.mode("overwrite").parquet(f"{self.place}/alerts/_batch={number}")

    def fingerprints(self, first: int, last: int, number: int, silent: bool) -> DataFrame:
        """Features by node and epoch of the state up to a batch, epochs first to last."""
        mine = F.col("epoch").between(first, last) & (F.col("_batch") <= number)
        sums = self._state("sums").where(mine).groupBy(*NODE, "epoch").agg(*[F.sum(c).alias(c) for c in ("flows", "duration", "sent", "bytes")])
        peers = self._state("peers").where(mine).select(*NODE, "epoch", "peer").distinct().groupBy(*NODE, "epoch").agg(F.count(F.lit(1)).alias("distinct_destinations")) if _exists(self.spark, f"{self.place}/peers") else None
        out = sums.join(peers, [*NODE, "epoch"], "left").select(
            *NODE, "epoch", F.coalesce("distinct_destinations", F.lit(0)).cast("long").alias("distinct_destinations"), (F.col("duration") / F.col("flows")).alias("mean_flow_duration_seconds"),
            F.coalesce(F.try_divide("sent", "bytes"), F.lit(0.0)).cast("double").alias("outbound_byte_ratio"), F.col("bytes").alias("total_byte_count"),
        )
        if not silent:
            return out
        seen = self._state("sums").where(mine).select("epoch").distinct()  # few: the epochs that close
        every = self.base.select(*NODE).distinct().join(F.broadcast(seen), F.lit(True))
        filled = every.join(out, [*NODE, "epoch"], "left")
        return filled.select(*NODE, "epoch", *[F.coalesce(F.col(c), F.lit(0).cast(out.schema[c].dataType)).alias(c) for c in behavior.FEATURES])

    def judged(self, first: int, last: int, number: int, silent: bool) -> DataFrame:
        return behavior.continuous_anomalies(self.base, self.fingerprints(first, last, number, silent), self.threshold).select(*NODE, "epoch", "feature", "z")

    def flush(self) -> None:
        """Judge the open epoch in full; the alerts stand under a batch number of their own."""
        now = self._open(self.last + 1)
        if now is not None:
            self.judged(now, now, self.last, self.silent).withColumn("partial", F.lit(False)).write.mode("overwrite").parquet(f"{self.place}/alerts/_batch={self.last + 1}")

    def run(self, stream: DataFrame) -> StreamingAnomalies:
        """Drive ingest() from a stream of flows until it is read."""
        stream.writeStream.foreachBatch(self.ingest).option("checkpointLocation", f"{self.place}/state").trigger(availableNow=True).start().awaitTermination()
        return self

    def alerts(self) -> DataFrame:
        w = Window.partitionBy(*NODE, "epoch", "feature").orderBy("_batch", F.desc("partial"))
        return self._state("alerts").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_batch")
