"""The test tables as observations: packets, flows and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireloom.functions.expressions import micros
from wireloom.session import cut

PACKET_COLUMNS = ["capture_id", "packet_seq", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "size_bytes", "tcp_flags"]
FLAGS = (("signup", "SYN"), ("view", "ACK"), ("click", "PSH"), ("purchase", "FIN"), ("error", "RST"))
DAY_US = 86_400_000_000
EPOCH_START = 1_704_067_200_000_000  # 2024-01-01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as one-way UDP packets from a user to a service."""
    none = F.lit(None).cast("int")
    return table(spark, sf_dir, "events").select(
        F.lit("events").alias("capture_id"), F.col("event_id").alias("packet_seq"), "ts", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src_ip"), F.concat(F.lit("svc-"), "event_type").alias("dst_ip"),
        none.alias("src_port"), none.alias("dst_port"), F.lit("UDP").alias("protocol"), F.floor("value").cast("long").alias("size_bytes"), F.lit(None).cast("string").alias("tcp_flags"),
    )


def flag_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as TCP packets between a user and one server; the event type is the flag, odd event ids come back from the server."""
    flag = F.lit(None).cast("string")
    for kind, name in FLAGS:
        flag = F.when(F.col("event_type") == kind, name).otherwise(flag)
    user, back, none = F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("event_id") % 2 == 1, F.lit(None).cast("int")
    return table(spark, sf_dir, "events").select(
        F.lit("flags").alias("capture_id"), F.col("event_id").alias("packet_seq"), "ts", F.when(back, "server").otherwise(user).alias("src_ip"), F.when(back, user).otherwise(F.lit("server")).alias("dst_ip"),
        F.when(back, 443).otherwise(none).alias("src_port"), F.when(back, none).otherwise(F.lit(443)).alias("dst_port"), F.lit("TCP").alias("protocol"), F.floor("value").cast("long").alias("size_bytes"), flag.alias("tcp_flags"),
    )


def trade_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as conversations: a customer to a supplier at the order date, and back at the ship date."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate").join(o, "l_orderkey")
    c, s, none = F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.lit(None).cast("int")
    way = F.explode(F.array(F.struct(F.lit(0).alias("d"), F.col("o_orderdate").alias("ts"), c.alias("src"), s.alias("dst"), F.floor("l_quantity").cast("long").alias("size")), F.struct(F.lit(1).alias("d"), F.col("l_shipdate").alias("ts"), s.alias("src"), c.alias("dst"), F.floor(F.col("l_extendedprice") / 100).cast("long").alias("size"))))
    return line.withColumn("w", way).select(
        F.lit("trade").alias("capture_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber") * 2 + F.col("w.d")).alias("packet_seq"), F.col("w.ts").alias("ts"), F.col("w.src").alias("src_ip"), F.col("w.dst").alias("dst_ip"),
        none.alias("src_port"), none.alias("dst_port"), F.lit("UDP").alias("protocol"), F.col("w.size").alias("size_bytes"), F.lit(None).cast("string").alias("tcp_flags"),
    )


def event_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a flow of its own, with the port from its properties."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.lit("events").alias("capture_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src_ip"), F.concat(F.lit("svc-"), "event_type").alias("dst_ip"), F.get_json_object("props", "$.k").cast("int").alias("dst_port"),
        F.lit("UDP").alias("protocol"), micros(F.col("ts")).alias("first_us"), micros(F.col("ts")).alias("last_us"), F.lit(0.0).alias("duration_seconds"), F.floor("value").cast("long").alias("byte_count"), F.lit(1.0).alias("forward_byte_ratio"), F.lit(False).alias("is_persistent"),
    )


def sparse_graph(spark: SparkSession, sf_dir: str, least: float | None = 490_000.0) -> DataFrame:
    """Customers and suppliers of large orders, or with least None of all orders: (source, target, confidence)."""
    orders = table(spark, sf_dir, "orders")
    o = (orders if least is None else orders.where(F.col("o_totalprice") > least)).select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    pairs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(o, "l_orderkey")
    c, s = F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    return pairs.groupBy(c.alias("source"), s.alias("target")).agg(F.count(F.lit(1)).alias("observation_count")).select("source", "target", "observation_count", (1 - F.pow(F.lit(0.5), F.col("observation_count"))).alias("confidence"))


def nation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that trade, as undirected edges (source before target by name) with counts. Written once, as searches read it many times."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("_c"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("_s"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(c, "o_custkey").select("l_orderkey", "_c")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(s, "l_suppkey").select("l_orderkey", "_s")
    per = line.join(o, "l_orderkey").where("_c <> _s").groupBy("_c", "_s").agg(F.count(F.lit(1)).alias("n")).join(n.toDF("_c", "a"), "_c").join(n.toDF("_s", "b"), "_s")
    edges = per.groupBy(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target")).agg(F.sum("n").alias("observation_count"))
    return cut(edges.withColumn("confidence", 1 - F.exp(-F.col("observation_count") / 50.0)), "nations", 625)


def contact_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with the suppliers of its first and its last line item, and each supplier with its nation: a graph with cut nodes, bridges and cycles, from all rows."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(o, "l_orderkey").withColumn("_at", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    ends = line.groupBy("o_custkey").agg(F.array(*[f(F.struct("_at", "l_suppkey"))["l_suppkey"] for f in (F.min, F.max)]).alias("_s"))
    customers = ends.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"), F.explode(F.array_distinct("_s")).alias("_t")).select("source", F.concat(F.lit("s"), F.col("_t").cast("string")).alias("target"), F.lit(0.6).alias("confidence"))
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("source"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("target"), F.lit(0.9).alias("confidence"))
    return customers.unionByName(suppliers)
