"""Observations made to order: sampling, collector views, topologies, traffic and attacks, all as DataFrame rows from hashes of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wireloom.functions.expressions import micros

UNIT = 1 << 30


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from a hash of key: the same on every run and in every partition."""
    return F.pmod(F.xxhash64(*key), F.lit(UNIT)) / float(UNIT)


def sample_packets(packets: DataFrame, completeness: float, seed: int = 0) -> DataFrame:
    """Each packet with probability completeness."""
    return packets.where(uniform(F.col("packet_seq"), F.lit(seed)) < completeness)


def in_md5_sample(key: str, share: float) -> Column:
    """Whether a key's MD5 starts below share."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") < int(share * (1 << 32))


def md5_sample(df: DataFrame, key: str, share: float) -> DataFrame:
    """Rows whose key's MD5 starts below share: a sample that other engines can repeat."""
    return df.where(in_md5_sample(key, share))


def collector_views(packets: DataFrame, collectors: int, overlap: float, drop: float = 0.0, skew_us: int = 0, seed: int = 0) -> DataFrame:
    """packets with collector: every packet at a home collector, at each other one with probability overlap; views lose drop and have clocks skew_us apart."""
    home = F.pmod(F.xxhash64("packet_seq", F.lit(seed)), F.lit(collectors))
    all_ = packets.withColumn("collector", F.explode(F.sequence(F.lit(0), F.lit(collectors - 1))))
    sees = (F.col("collector") == home) | (uniform(F.col("packet_seq"), F.col("collector"), F.lit(seed + 1)) < overlap)
    kept = all_.where(sees & (uniform(F.col("packet_seq"), F.col("collector"), F.lit(seed + 2)) >= drop))
    return kept.withColumn("ts", F.timestamp_micros(micros(F.col("ts")) + F.col("collector") * skew_us))


def assign_ips(names: DataFrame) -> DataFrame:
    """(name, ip): 10.0.<i / 254>.<i % 254 + 1> over names in order."""
    from wireloom.functions.ranking import ranked

    r = ranked(names.select("name").distinct().withColumn("_g", F.lit(0)), "_g", [F.col("name")], "_i")
    return r.select("name", F.format_string("10.0.%d.%d", F.floor(F.col("_i") / 254), F.col("_i") % 254 + 1).alias("ip"))


def chain(spark: SparkSession, n: int) -> DataFrame:
    """(source, target) of n nodes in a row."""
    return spark.range(max(0, n - 1)).select(F.format_string("n%03d", "id").alias("source"), F.format_string("n%03d", F.col("id") + 1).alias("target"))


def star(spark: SparkSession, leaves: int) -> DataFrame:
    return spark.range(leaves).select(F.lit("hub").alias("source"), F.format_string("leaf%03d", "id").alias("target"))


def tiers(spark: SparkSession, sizes: list[int]) -> DataFrame:
    """Every node of a tier to every node of the next."""
    nodes = spark.createDataFrame([(t, i) for t, n in enumerate(sizes) for i in range(n)], "tier int, i int")
    a, b = nodes.select(F.col("tier").alias("t"), F.format_string("t%02dn%02d", "tier", "i").alias("source")), nodes.select((F.col("tier") - 1).alias("t"), F.format_string("t%02dn%02d", "tier", "i").alias("target"))
    return a.join(b, "t").select("source", "target")


def multi_path(spark: SparkSession, k: int) -> DataFrame:
    """k ways of two hops from a client to a server."""
    mid = F.format_string("mid%02d", "id")
    return spark.range(k).select(F.explode(F.array(F.struct(F.lit("client").alias("source"), mid.alias("target")), F.struct(mid.alias("source"), F.lit("server").alias("target")))).alias("e")).select("e.source", "e.target")


def traffic(edges: DataFrame, packets: int, start_us: int, span_seconds: float, capture_id: str, seed: int = 0) -> DataFrame:
    """Request and reply packets on every edge, spread over the span by hash."""
    rows = edges.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(packets - 1))))
    at = (F.lit(start_us) + uniform(F.col("source"), F.col("target"), F.col("_k"), F.lit(seed)) * span_seconds * 1_000_000).cast("long")
    size = (60 + uniform(F.col("source"), F.col("target"), F.col("_k"), F.lit(seed + 1)) * 1400).cast("long")
    way = F.explode(F.array(F.struct(F.lit(0).alias("d"), F.col("source").alias("src"), F.col("target").alias("dst")), F.struct(F.lit(1).alias("d"), F.col("target").alias("src"), F.col("source").alias("dst"))))
    r = rows.withColumn("_at", at).withColumn("_size", size).withColumn("w", way)
    seq = F.xxhash64("source", "target", "_k", F.col("w.d"))
    port = lambda back: F.when((F.col("w.d") == 1) == F.lit(back), 80).otherwise(40000)
    return r.select(F.lit(capture_id).alias("capture_id"), seq.alias("packet_seq"), F.timestamp_micros(F.col("_at") + F.col("w.d") * 1000).alias("ts"), F.col("w.src").alias("src_ip"), F.col("w.dst").alias("dst_ip"), port(True).alias("src_port"), port(False).alias("dst_port"), F.lit("TCP").alias("protocol"), F.col("_size").alias("size_bytes"), F.lit("ACK").alias("tcp_flags"))


def spoofed_sources(packets: DataFrame, fakes: int = 5, each: int = 25, seed: int = 0) -> DataFrame:
    """packets and, beside them, packets from addresses that don't exist: copies of real ones by hash, sent under made-up sources."""
    share = uniform(F.col("packet_seq"), F.lit(seed))
    fake = F.format_string("203.0.113.%d", F.pmod(F.xxhash64("packet_seq", F.lit(seed + 1)), F.lit(fakes)) + 1)
    total = packets.count()
    extra = packets.where(share < min(1.0, fakes * each / max(1, total))).withColumn("src_ip", fake).withColumn("packet_seq", F.xxhash64("packet_seq", F.lit(seed + 2)))
    return packets.unionByName(extra)


def decoy_pairs(nodes: DataFrame, declared: DataFrame, k: int = 3, seed: int = 0) -> DataFrame:
    """k pairs of nodes(ip) that no declared edge joins. nodes are a scenario's, a small table."""
    a, b = nodes.select(F.col("ip").alias("source")), nodes.select(F.col("ip").alias("target"))
    pairs = a.join(b, F.col("source") < F.col("target")).join(declared.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")), ["source", "target"], "left_anti")
    return pairs.orderBy(F.xxhash64("source", "target", F.lit(seed))).limit(k)


def ip_aliasing(packets: DataFrame, victim: str, aliases: int = 3) -> DataFrame:
    """The victim's packets under several addresses, by port."""
    def alias(ip: str, port: str) -> Column:
        n = F.pmod(F.coalesce(F.col(port), F.lit(0)), F.lit(aliases))
        return F.when((F.col(ip) == victim) & (n > 0), F.concat(F.lit(victim + "-alias"), n.cast("string"))).otherwise(F.col(ip))

    return packets.withColumn("src_ip", alias("src_ip", "src_port")).withColumn("dst_ip", alias("dst_ip", "dst_port"))
