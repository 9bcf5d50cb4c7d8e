"""Dependency between nodes, kept up to date with a packet stream: aggregates that take retractions.

A flow changes as packets arrive, so its old form is taken back and its new form added.
Counts and sums take signs; the first, the last and the largest value of a pair survive
a deletion because every value is kept with its number. A batch reads the state of the
pairs it touches and of the neighbours of nodes whose flow times changed, nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wireloom.functions.expressions import bidirectionality
from wireloom.operators import dependency, topology
from wireloom.session import cut
from wireloom.streaming.engine import IncrementalFlows, place_of

PAIR = ["capture_id", "source", "target"]
SIGNALS = ("established", "fingerprinted", "persistent")


class SignedLog:
    """A table of signed rows by bucket of a key, in Parquet, a folder for each batch; written again under the same number, a batch replaces itself."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def write(self, rows: DataFrame, number: int) -> None:
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        rows.withColumn("_bucket", bucket).write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/_batch={number}")
        self.schema = T.StructType([*rows.schema.fields, T.StructField("_batch", T.LongType()), T.StructField("_bucket", T.IntegerType())])

    def batch(self, number: int) -> DataFrame:
        """The rows that a batch wrote."""
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(f"{self.path}/_batch={number}").drop("_batch", "_bucket")

    def read(self, keys: DataFrame, number: int) -> DataFrame:
        """All rows of these keys up to a batch; only their buckets are opened."""
        hit = [r[0] for r in keys.select(F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")).distinct().collect()]  # at most buckets rows
        rows = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(f"{self.path}/_batch=*")
        return rows.where(F.col("_bucket").isin(hit) & (F.col("_batch") <= number)).join(keys.distinct(), self.key, "left_semi").drop("_batch", "_bucket")


class IncrementalDependencies:
    """dependency_strength() of all packets so far, after each batch of a stream.

    ingest() takes a batch, dependencies() gives every pair's last row, candidates() those
    that may be causes. The caller may name the place of the state, so that a stream that
    is started again goes on where it was. Packets are those of flows.reconstruct_flows();
    TLS versions aren't known to a stream. State grows with flows, not with packets.
    """

    def __init__(self, spark: SparkSession, udp_idle: float = 30.0, seconds: float = 10.0, max_lag: int = 5, buckets: int = 64, place: str | None = None) -> None:
        self.spark, self.seconds, self.max_lag = spark, seconds, max_lag
        self.place = place_of(spark, "dependencies", place)
        self.flows = IncrementalFlows(spark, udp_idle, buckets, f"{self.place}/flows")
        self.sums = SignedLog(spark, f"{self.place}/sums", PAIR, buckets)
        self.values = SignedLog(spark, f"{self.place}/values", PAIR, buckets)
        self.times = SignedLog(spark, f"{self.place}/times", ["node"], buckets)
        self.ends = SignedLog(spark, f"{self.place}/ends", ["node"], buckets)

    def ingest(self, packets: DataFrame, number: int) -> None:
        self.flows.ingest(packets, number)
        change = cut(self.flows.changelog(number), "changes")
        pairs = change.where("src_ip <> dst_ip").withColumn("source", F.least("src_ip", "dst_ip")).withColumn("target", F.greatest("src_ip", "dst_ip"))
        flags = {"established": F.coalesce(F.col("tcp_state") == "established", F.lit(False)), "fingerprinted": F.col("fingerprinted_protocol").isNotNull(), "persistent": F.col("is_persistent")}
        sums = [F.sum(F.col("sign") * c).alias(name) for name, c in (("flows", F.lit(1)), ("packets", F.col("packet_count")), ("ratio", F.col("forward_byte_ratio")), *((k, c.cast("long")) for k, c in flags.items()))]
        self.sums.write(pairs.groupBy(*PAIR).agg(*sums), number)
        kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("double").alias("value")) for k, c in (("first", F.col("first_us")), ("last", F.col("last_us")), ("both_ways", bidirectionality(F.col("forward_byte_ratio"))))]))
        values = pairs.select(*PAIR, "sign", kinds.alias("v")).groupBy(*PAIR, "v.kind", "v.value").agg(F.sum("sign").alias("n"))
        self.values.write(values.where("n <> 0"), number)
        ends = F.explode(F.array_distinct(F.array("src_ip", "dst_ip"))).alias("node")
        times = change.select("sign", "first_us", ends).groupBy("node", F.col("first_us").alias("us")).agg(F.sum("sign").alias("n")).where("n <> 0")
        self.times.write(times, number)
        touched = pairs.select(*PAIR).distinct()
        self.ends.write(touched.select(*PAIR, F.explode(F.array("source", "target")).alias("node")), number)
        moved = self.times.batch(number).select("node").distinct()
        dirty = cut(touched.unionByName(self.ends.read(moved, number).select(*PAIR)).distinct(), "dirty")
        self.compute(dirty, number).write.mode("overwrite").parquet(f"{self.place}/found/_batch={number}")

    def compute(self, dirty: DataFrame, number: int) -> DataFrame:
        """Strength of these pairs from the state up to a batch; a pair whose flows are all gone has none."""
        sums = self.sums.read(dirty, number).groupBy(*PAIR).agg(*[F.sum(c).alias(c) for c in ("flows", "packets", "ratio", *SIGNALS)])
        values = self.values.read(dirty, number).groupBy(*PAIR, "kind", "value").agg(F.sum("n").alias("n")).where("n > 0")
        of = lambda kind: F.when(F.col("kind") == kind, F.col("value"))
        extremes = values.groupBy(*PAIR).agg(F.min(of("first")).cast("long").alias("first_us"), F.max(of("last")).cast("long").alias("last_us"), F.max(of("both_ways")).alias("bidirectional"))
        edges = sums.where("flows > 0").join(extremes, PAIR).select(
            *PAIR, F.col("flows").alias("observation_count"), "packets", "first_us", "last_us", "bidirectional", (F.col("ratio") / F.col("flows")).alias("mean_forward_ratio"), F.lit(0).alias("tls"), *[(F.col(c) > 0).cast("int").alias(c) for c in SIGNALS],
        )
        edges = cut(edges.withColumn("confidence", topology.confidence()), "edges")
        nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()
        times = self.times.read(nodes, number).groupBy("node", "us").agg(F.sum("n").alias("w")).where("w > 0")
        found = dependency.dependency_strength(edges, dependency.temporal_precedence(edges, cut(times, "times"), self.seconds, self.max_lag))
        return dirty.join(found, PAIR, "left")

    def run(self, stream: DataFrame) -> IncrementalDependencies:
        """Drive ingest() from a packet stream until it is read."""
        stream.writeStream.foreachBatch(self.ingest).option("checkpointLocation", f"{self.place}/state").trigger(availableNow=True).start().awaitTermination()
        return self

    def dependencies(self, number: int | None = None) -> DataFrame:
        """Every pair's row of the last batch that recomputed it; with number, as of that batch."""
        rows = self.spark.read.option("basePath", f"{self.place}/found").parquet(f"{self.place}/found/_batch=*")
        rows = rows if number is None else rows.where(F.col("_batch") <= number)
        last = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*PAIR).orderBy(F.desc("_batch")))).where("_k = 1 and observation_count is not null")
        return last.drop("_k", "_batch")

    def candidates(self, threshold: float = 0.5) -> DataFrame:
        return dependency.causal_candidates(self.dependencies(), threshold)


