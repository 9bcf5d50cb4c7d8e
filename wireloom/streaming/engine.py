"""Structured Streaming forms of the operators, and helpers that run a stream over what is there and read the result back.

The batch operators are the reference for all of these: over the same rows, whatever the
micro-batches, each gives the rows of its batch form (see the tests). Watermarks bound
the state; rows later than the watermark are dropped, which a batch run wouldn't do.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wireloom.functions.expressions import micros
from wireloom.operators import flows, topology
from wireloom.session import shared_folder


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", files: int | None = None) -> DataFrame:
    """Files called name in folder as a stream, with ts as a timestamp."""
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/wireloom-stream-{name}-{uuid.uuid4().hex}"


def place_of(spark: SparkSession, name: str, place: str | None) -> str:
    """The folder of a stream's state: the one given, which a restarted stream finds again, or a new one."""
    return place.rstrip("/") if place else _place(spark, name)


def run_append(stream: DataFrame, name: str) -> DataFrame:
    """Run the stream over all available rows into Parquet (append mode), and read that back."""
    place = _place(stream.sparkSession, name)
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start(f"{place}/rows").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{place}/rows")


def run_update(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run the stream in update mode; the last row of every key is its result. Batches are written under their number, so a repeated batch replaces itself."""
    place = _place(stream.sparkSession, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/rows/_batch={number}")

    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.LongType())])
    rows = spark.read.schema(schema).option("basePath", f"{place}/rows").parquet(f"{place}/rows/*") if _exists(spark, f"{place}/rows") else spark.createDataFrame([], schema)
    w = Window.partitionBy(*keys).orderBy(F.col("_batch").desc())
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_batch")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def window_totals(stream: DataFrame, keys: list[str], size: str, watermark: str = "365 days", slide: str | None = None) -> DataFrame:
    """(keys, start_us, n, volume) by tumbling or sliding window: partial results in update mode."""
    win = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = stream.withWatermark("ts", watermark).groupBy(win.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("volume"))
    return g.select(*keys, micros(F.col("w.start")).alias("start_us"), "n", "volume")


def session_totals(stream: DataFrame, keys: list[str], gap: str, watermark: str = "1 day") -> DataFrame:
    """(keys, start_us, end_us, n) of sessions that the watermark has closed; end is the last row plus the gap."""
    g = stream.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*keys, micros(F.col("w.start")).alias("start_us"), micros(F.col("w.end")).alias("end_us"), "n")


def deduplicated(stream: DataFrame, keys: list[str], within: str) -> DataFrame:
    """The first row of every key, as long as repeats come within the time given."""
    return stream.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def fire_and_clear(low: float, high: float) -> Callable:
    """State function of alert_transitions: fires when a value goes to high or above, resolves when it falls below low."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        firing = state.get[0] if state.exists else False
        rows = pd.concat(list(frames)).sort_values(["us", "seq"])  # one key's rows of one micro-batch
        out = []
        for us, value in zip(rows["us"], rows["value"]):
            if not firing and value >= high:
                firing = True
                out.append((*key, us, "fired", value))
            elif firing and value < low:
                firing = False
                out.append((*key, us, "resolved", value))
        state.update((firing,))
        yield pd.DataFrame(out, columns=["rule", "scope", "us", "state", "value"])

    return run


TRANSITIONS = "rule string, scope string, us long, state string, value double"


def alert_transitions(stream: DataFrame, low: float, high: float) -> DataFrame:
    """(rule, scope, us, state, value) from rows (rule, scope, us, seq, value) in order: edges only, with hysteresis between low and high."""
    return stream.groupBy("rule", "scope").applyInPandasWithState(fire_and_clear(low, high), TRANSITIONS, "firing boolean", "append", "NoTimeout")


def batch_transitions(rows: DataFrame, low: float, high: float) -> DataFrame:
    """The same of a finite table, without state: a row's state is that of the last row at or above high, or below low."""
    w = Window.partitionBy("rule", "scope").orderBy("us", "seq")
    mark = F.when(F.col("value") >= high, True).when(F.col("value") < low, False)
    s = rows.withColumn("_s", F.coalesce(F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))
    s = s.withColumn("_p", F.coalesce(F.lag("_s").over(w), F.lit(False))).where("_s <> _p")
    return s.select("rule", "scope", "us", F.when(F.col("_s"), "fired").otherwise("resolved").alias("state"), "value")


def collector_claims(stream: DataFrame, tolerance: float = 0.001, late: str = "10 seconds") -> DataFrame:
    """topology.dedupe_collectors() of a stream: reports claim packets that are known by then, in order of arrival.

    The reports of one micro-batch are taken by time. An identity's packets stay in its state
    for tolerance and late after its last report, late being how far reports may come out of
    order; then the state goes away.
    """
    limit, columns = int(tolerance * 1_000_000), stream.columns

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        if state.hasTimedOut:
            state.remove()
            return
        us, who = state.get if state.exists else ([], [])
        held = [(t, set(w.split("\x1f"))) for t, w in zip(us, who)]
        rows = pd.concat(list(frames))
        rows = rows.assign(_us=rows["ts"].astype("int64") // (1000 if rows["ts"].dtype.str.endswith("[ns]") else 1), _who=rows["collector"].astype(str)).sort_values(["_us", "_who", "packet_seq"])
        keep = [not topology.nearest_claim(held, int(t), w, limit) for t, w in zip(rows["_us"], rows["_who"])]
        newest = max(t for t, _ in held)
        floor = max(state.getCurrentWatermarkMs() * 1000, 0) - limit
        held = [e for e in held if e[0] >= floor] or held[-1:]
        state.update(([t for t, _ in held], ["\x1f".join(sorted(w)) for _, w in held]))
        state.setTimeoutTimestamp(max(newest // 1000 + int(tolerance * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield rows.loc[keep, columns]

    keyed = stream.withWatermark("ts", late).withColumn("_key", topology.identity_key())
    return keyed.groupBy("_key").applyInPandasWithState(run, stream.schema, "us array<long>, who array<string>", "append", "EventTimeTimeout")


class IncrementalFlows:
    """Flows kept up to date with arriving packets: a batch re-derives the keys it touches, and nothing else.

    Packets are kept by bucket of their key; a batch reads the buckets of its keys, and
    writes the new flows of those keys under its number. flows() takes every key's flows
    from the last batch that touched it, so it equals the batch result of all packets.
    """

    def __init__(self, spark: SparkSession, udp_idle: float = 30.0, buckets: int = 64, place: str | None = None) -> None:
        self.spark, self.udp_idle, self.buckets = spark, udp_idle, buckets
        self.place = place_of(spark, "flows", place)
        self.batches: set[int] = set()

    def _keys(self, packets: DataFrame) -> DataFrame:
        k = flows.keyed(packets)
        key = F.xxhash64("capture_id", "lo", "hi", "protocol")
        return k.withColumn("_key", key).withColumn("_bucket", F.pmod(key, F.lit(self.buckets)).cast("int")).select(*packets.columns, "_key", "_bucket")

    def ingest(self, packets: DataFrame, number: int) -> None:
        """Take in a batch; the same number again replaces what it wrote before."""
        path = f"{self.place}/packets/_batch={number}"
        self._keys(packets).write.mode("overwrite").partitionBy("_bucket").parquet(path)
        new = self.spark.read.option("basePath", f"{self.place}/packets").parquet(path)
        touched = new.select("_key", "_bucket").distinct()
        hit = [r[0] for r in touched.select("_bucket").distinct().collect()]  # at most buckets rows
        kept = self.spark.read.parquet(f"{self.place}/packets").where(F.col("_bucket").isin(hit) & (F.col("_batch") <= number))
        mine = kept.join(touched.select("_key"), "_key", "left_semi").drop("_key", "_bucket", "_batch")
        again = F.count(F.lit(1)).over(Window.partitionBy(*flows.KEY)) > 1
        flows.units(mine, self.udp_idle).withColumn("is_persistent", again).withColumn("_key", F.xxhash64("capture_id", "lo", "hi", "protocol")).write.mode("overwrite").parquet(f"{self.place}/units/_batch={number}")
        self.batches.add(number)

    def changelog(self, number: int) -> DataFrame:
        """(sign, flow columns) of a batch: -1 for flows that no longer hold, 1 for those that do now; unchanged ones cancel out."""
        units = self.spark.read.parquet(f"{self.place}/units")
        now = units.where(F.col("_batch") == number).drop("_batch")
        before = self._latest(units.where(F.col("_batch") < number)).join(now.select("_key").distinct(), "_key", "left_semi").select(*now.columns)
        gone, come = before.exceptAll(now), now.exceptAll(before)
        return gone.withColumn("sign", F.lit(-1)).unionByName(come.withColumn("sign", F.lit(1))).drop("_key")

    @staticmethod
    def _latest(units: DataFrame) -> DataFrame:
        last = units.groupBy("_key").agg(F.max("_batch").alias("_batch"))
        return units.join(last, ["_key", "_batch"], "left_semi").drop("_batch")

    def flows(self) -> DataFrame:
        return self._latest(self.spark.read.parquet(f"{self.place}/units")).drop("_key")

    def packets(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.place}/packets").drop("_key", "_bucket", "_batch")

    def run(self, stream: DataFrame) -> IncrementalFlows:
        """Drive ingest() from a packet stream until it is read."""
        stream.writeStream.foreachBatch(self.ingest).option("checkpointLocation", f"{self.place}/state").trigger(availableNow=True).start().awaitTermination()
        return self

    def edges(self) -> DataFrame:
        """Edge signals and confidence of all flows so far, equal to the batch graph."""
        u = self.flows()
        u = u.withColumn("tls_version", F.lit(None).cast("string"))
        return topology.discover_edges(u, topology.discover_nodes(self.packets()))
