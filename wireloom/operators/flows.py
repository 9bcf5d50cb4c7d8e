"""Packets to flows: sessions by key and idle gap, handshake states, features.

packets: capture_id, packet_seq (any order that breaks ties), ts, src_ip, dst_ip,
src_port, dst_port, protocol, size_bytes, tcp_flags (comma list).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wireloom.functions.expressions import SECOND, micros
from wireloom.functions.ranking import ranked

#: Well-known services by transport and port.
WELL_KNOWN = (("TCP", 80, "http"), ("TCP", 443, "tls"), ("TCP", 5432, "postgresql"), ("TCP", 6379, "redis"), ("UDP", 53, "dns"))
KEY = ["capture_id", "lo", "hi", "protocol"]
#: The key for windows: sorts compare a number before they compare endpoints.
FAST_KEY = ["key_hash", *KEY]


def service(protocol: Column, src_port: Column, dst_port: Column) -> Column:
    """The service that a port tells of, destination first."""

    def of(port: Column) -> Column:
        found = F.lit(None).cast("string")
        for p, n, name in WELL_KNOWN:
            found = F.when((protocol == p) & (port == n), name).otherwise(found)
        return found

    return F.coalesce(of(dst_port), of(src_port))


def endpoint(ip: str, port: str) -> Column:
    return F.struct(F.col(ip).alias("ip"), F.coalesce(F.col(port), F.lit(0)).cast("int").alias("port"))


def keyed(packets: DataFrame) -> DataFrame:
    """packets with a key that is the same in both directions: the two endpoints in order, and the protocol."""
    a, b = endpoint("src_ip", "src_port"), endpoint("dst_ip", "dst_port")
    p = packets.withColumn("lo", F.least(a, b)).withColumn("hi", F.greatest(a, b)).withColumn("from_lo", a == F.col("lo")).withColumn("us", micros(F.col("ts")))
    return p.withColumn("key_hash", F.xxhash64(*KEY))


def sessions(packets: DataFrame, udp_idle: float = 30.0) -> DataFrame:
    """TCP and UDP packets with gap (to the one before in the session) and session; only UDP is split, at gaps strictly above udp_idle."""
    w = Window.partitionBy(*FAST_KEY).orderBy("us", "packet_seq")
    p = keyed(packets.where(F.col("protocol").isin("TCP", "UDP")))
    p = p.withColumn("gap", F.col("us") - F.lag("us").over(w)).withColumn("_i", F.row_number().over(w))
    fresh = (F.col("protocol") == "UDP") & (F.col("gap") > int(udp_idle * SECOND))
    p = p.withColumn("_new", F.coalesce(fresh, F.lit(False)).cast("int"))
    p = p.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return p.withColumn("gap", F.when(F.col("_new") == 0, F.col("gap")))


def _flag(name: str) -> Column:
    return F.array_contains(F.split(F.coalesce(F.col("tcp_flags"), F.lit("")), ","), name)


def units(packets: DataFrame, udp_idle: float = 30.0) -> DataFrame:
    """A row per session: canonical endpoints (of its first packet), counts, gaps, forward bytes and TCP state.

    The state machine has a closed form: a plain ACK after the first SYN and before the
    first FIN makes a connection; RST beats everything; FINs in both directions close it.
    """
    whole = Window.partitionBy(*FAST_KEY)
    p = sessions(packets, udp_idle)
    p = p.withColumn("_syn", F.min(F.when(_flag("SYN"), F.col("_i"))).over(whole)).withColumn("_fin", F.min(F.when(_flag("FIN") & ~_flag("SYN"), F.col("_i"))).over(whole))
    shakes = _flag("ACK") & ~_flag("SYN") & ~_flag("FIN") & (F.col("_i") > F.col("_syn")) & (F.col("_fin").isNull() | (F.col("_i") < F.col("_fin")))
    fin = _flag("FIN") & ~_flag("SYN")
    first = (F.col("_i") == 1) | (F.col("_new") == 1)

    def of_first(c: str) -> Column:
        return F.max(F.when(first, F.col(c)))

    # numbers and flags alone, so that the aggregation hashes and doesn't sort again
    g = p.groupBy(*FAST_KEY, "session").agg(
        F.min("us").alias("first_us"), of_first("packet_seq").alias("first_seq"), of_first("from_lo").alias("_forward"), of_first("src_port").alias("src_port"), of_first("dst_port").alias("dst_port"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("packet_count"), F.sum("size_bytes").alias("byte_count"),
        F.sum(F.when(F.col("from_lo"), F.col("size_bytes")).otherwise(0)).alias("_lo_bytes"), F.count("gap").alias("_gaps"), F.avg("gap").alias("_gap"), F.stddev_pop("gap").alias("_dev"),
        F.bool_or(_flag("RST")).alias("_rst"), F.min("_syn").alias("_syn"), F.bool_or(F.coalesce(shakes, F.lit(False))).alias("_est"), F.bool_or(fin & F.col("from_lo")).alias("_fin_lo"), F.bool_or(fin & ~F.col("from_lo")).alias("_fin_hi"),
    )
    state = (
        F.when(F.col("_rst"), "reset").when(F.col("_syn").isNull() | ~F.col("_est"), "partial").when(F.col("_fin_lo") & F.col("_fin_hi"), "closed").when(F.col("_fin_lo") | F.col("_fin_hi"), "closing").otherwise("established")
    )
    forward = F.when(F.col("_forward"), F.col("_lo_bytes")).otherwise(F.col("byte_count") - F.col("_lo_bytes"))
    mean = F.coalesce(F.col("_gap") / SECOND, F.lit(0.0))
    return g.select(
        *KEY, "key_hash", "session", F.when(F.col("_forward"), F.col("lo.ip")).otherwise(F.col("hi.ip")).alias("src_ip"), F.when(F.col("_forward"), F.col("hi.ip")).otherwise(F.col("lo.ip")).alias("dst_ip"), "src_port", "dst_port",
        "first_us", "last_us", "first_seq", F.when(F.col("protocol") == "TCP", state).alias("tcp_state"),
        service(F.col("protocol"), F.col("src_port"), F.col("dst_port")).alias("fingerprinted_protocol"), "packet_count", "byte_count",
        ((F.col("last_us") - F.col("first_us")) / SECOND).alias("duration_seconds"), mean.alias("mean_inter_arrival_seconds"),
        F.when((F.col("_gaps") >= 2) & (mean > 0), F.col("_dev") / F.col("_gap")).otherwise(0.0).alias("burstiness"),
        F.coalesce(F.try_divide(forward, F.col("byte_count")), F.lit(0.0)).cast("double").alias("forward_byte_ratio"),
    )


def reconstruct_flows(packets: DataFrame, udp_idle: float = 30.0, tls: DataFrame | None = None, diversity: bool = True) -> DataFrame:
    """Flows of every capture: units with diversity of their source, persistence of their key, and TLS versions from tls(ip, port, version).

    destination_diversity and port_diversity count over the whole capture by canonical
    source (a null port counts as a value); without diversity they are left out, and flows
    are one pass over the packets.
    """
    u = units(packets, udp_idle).withColumn("is_persistent", F.count(F.lit(1)).over(Window.partitionBy(*FAST_KEY)) > 1).drop("key_hash")
    if diversity:
        u = with_diversity(u)
    return with_tls(u, tls)


def with_diversity(u: DataFrame) -> DataFrame:
    """u with the numbers of its source's destinations and their ports. Flows are sent to their source once: a value's place among the source's values says how many there are."""
    of = Window.partitionBy("capture_id", "src_ip")
    port = F.coalesce(F.col("dst_port"), F.lit(-1))
    u = u.where("capture_id is not null and src_ip is not null").withColumn("_d", F.dense_rank().over(of.orderBy(F.asc_nulls_last("dst_ip")))).withColumn("_p", F.dense_rank().over(of.orderBy(port)))
    destinations = F.coalesce(F.max(F.when(F.col("dst_ip").isNotNull(), F.col("_d"))).over(of), F.lit(0)).cast("long")
    return u.withColumn("destination_diversity", destinations).withColumn("port_diversity", F.max("_p").over(of).cast("long")).drop("_d", "_p")


def with_tls(u: DataFrame, tls: DataFrame | None) -> DataFrame:
    if tls is None:
        return u.withColumn("tls_version", F.lit(None).cast("string"))
    one = tls.groupBy("ip", "port").agg(F.max_by("version", "packet_seq").alias("version"))
    s = one.select(F.col("ip").alias("src_ip"), F.col("port").alias("src_port"), F.col("version").alias("_s"))
    d = one.select(F.col("ip").alias("dst_ip"), F.col("port").alias("dst_port"), F.col("version").alias("_d"))
    joined = u.join(s, ["src_ip", "src_port"], "left").join(d, ["dst_ip", "dst_port"], "left")
    return joined.withColumn("tls_version", F.when(F.col("protocol") == "TCP", F.coalesce("_s", "_d"))).drop("_s", "_d")


def numbered(flows: DataFrame) -> DataFrame:
    """flows with flow_id: the capture's flows by first packet."""
    r = ranked(flows, "capture_id", [F.col("first_us"), F.col("first_seq"), F.col("lo"), F.col("hi"), F.col("protocol"), F.col("session")], "_rank")
    return r.withColumn("flow_id", F.concat_ws(":", "capture_id", F.lit("flow"), F.col("_rank").cast("string"))).drop("_rank")


def with_direction(packets: DataFrame, udp_idle: float = 30.0) -> DataFrame:
    """packets with direction: forward or reverse to the first packet of their session; unknown where there is no flow."""
    p = sessions(packets, udp_idle)
    first = F.first("from_lo").over(Window.partitionBy(*KEY, "session").orderBy("us", "packet_seq"))
    flowing = p.withColumn("direction", F.when(F.col("from_lo") == first, "forward").otherwise("reverse")).select(*packets.columns, "direction")
    rest = packets.where(~F.coalesce(F.col("protocol").isin("TCP", "UDP"), F.lit(False))).withColumn("direction", F.lit("unknown"))
    return flowing.unionByName(rest)


def expand_records(records: DataFrame) -> DataFrame:
    """Flow records to packets: max(packets, 1) rows evenly spaced from start to end, octets shared evenly, the remainder on the last.

    records: capture_id, record_id, src_ip, dst_ip, src_port, dst_port, protocol, packets, octets, start_us, end_us.
    """
    n = F.greatest(F.coalesce(F.col("packets"), F.lit(0)), F.lit(1)).cast("long")
    r = records.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    step = F.when(F.col("_n") > 1, (F.col("end_us") - F.col("start_us")) / (F.col("_n") - 1)).otherwise(0.0)
    share = F.floor(F.col("octets") / F.col("_n"))
    size = F.when(F.col("_k") == F.col("_n") - 1, F.col("octets") - share * (F.col("_n") - 1)).otherwise(share)
    ports = F.col("protocol").isin("TCP", "UDP")
    return r.select(
        "capture_id", F.struct("record_id", "_k").alias("packet_seq"), F.timestamp_micros((F.col("start_us") + F.round(step * F.col("_k"))).cast("long")).alias("ts"), "src_ip", "dst_ip",
        F.when(ports, F.col("src_port")).alias("src_port"), F.when(ports, F.col("dst_port")).alias("dst_port"), "protocol", size.cast("long").alias("size_bytes"), F.lit(None).cast("string").alias("tcp_flags"),
    )


def expanded_counts(records: DataFrame) -> DataFrame:
    """(at_us, size_bytes, n): how many packets of expand_records(records) have a time and a size, without making them one by one.

    All packets of a record but the last have one size. Records of one start, spacing and size
    go together: the packet at a place stands for all of them that have a later one.
    """
    n = F.greatest(F.coalesce(F.col("packets"), F.lit(0)), F.lit(1)).cast("long")
    r = records.select("start_us", "end_us", "octets", n.alias("_n"))
    step = F.when(F.col("_n") > 1, (F.col("end_us") - F.col("start_us")) / (F.col("_n") - 1)).otherwise(0.0)
    share = F.floor(F.col("octets") / F.col("_n"))
    r = r.withColumn("_step", step).withColumn("_share", share).withColumn("_last", (F.col("octets") - share * (F.col("_n") - 1)).cast("long"))
    at = lambda k: (F.col("start_us") + F.round(F.col("_step") * k)).cast("long").alias("at_us")
    last = r.select(at(F.col("_n") - 1), F.col("_last").alias("size_bytes"), F.lit(1).cast("long").alias("n"))
    cells = r.where("_n > 1").groupBy("start_us", "_step", F.col("_share").cast("long").alias("size_bytes"), "_n").agg(F.count(F.lit(1)).alias("_w"))
    w = Window.partitionBy("start_us", "_step", "size_bytes").orderBy("_n")
    cells = cells.withColumn("_from", F.coalesce(F.lag("_n").over(w) - 1, F.lit(0))).withColumn("n", F.sum("_w").over(w.rowsBetween(0, Window.unboundedFollowing)))
    body = cells.withColumn("_k", F.explode(F.sequence(F.col("_from"), F.col("_n") - 2))).select(at(F.col("_k")), "size_bytes", "n")
    return body.unionByName(last).groupBy("at_us", "size_bytes").agg(F.sum("n").alias("n"))


def export_records(packets: DataFrame, inactive: float = 15.0, active: float = 1800.0) -> DataFrame:
    """Unidirectional flow records as an exporter makes them: split after inactive seconds without a packet, or once a record has lasted active seconds.

    The active limit counts from a record's own start, which depends on earlier splits:
    an ordered fold over the key's packets. A row is 16 bytes in that fold, and keys are
    first cut at inactive gaps, so a fold holds one busy spell of one key.
    """
    key = ["capture_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
    w = Window.partitionBy(*key).orderBy("us", "packet_seq")
    p = packets.withColumn("us", micros(F.col("ts")))
    p = p.withColumn("_new", F.coalesce(F.col("us") - F.lag("us").over(w) > int(inactive * SECOND), F.lit(False)).cast("int")).withColumn("spell", F.sum("_new").over(w))
    limit = int(active * SECOND)
    spells = p.groupBy(*key, "spell").agg(F.array_sort(F.collect_list(F.struct("us", "packet_seq", "size_bytes"))).alias("_p"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,packets:bigint,octets:bigint>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        fresh = F.struct(x["us"].alias("start"), x["us"].alias("end"), F.lit(1).cast("bigint").alias("packets"), x["size_bytes"].cast("bigint").alias("octets"))
        grown = F.struct(last["start"].alias("start"), x["us"].alias("end"), (last["packets"] + 1).alias("packets"), (last["octets"] + x["size_bytes"]).cast("bigint").alias("octets"))
        return F.when((F.size(acc) == 0) | (x["us"] - F.try_element_at(acc, F.lit(-1))["start"] >= limit), F.concat(acc, F.array(fresh))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown)))

    cut_up = spells.withColumn("r", F.explode(F.aggregate("_p", empty, lambda a, x: F.when(F.size(a) == 0, F.array(F.struct(x["us"].alias("start"), x["us"].alias("end"), F.lit(1).cast("bigint").alias("packets"), x["size_bytes"].cast("bigint").alias("octets")))).otherwise(step(a, x)))))
    return cut_up.select(*key, F.col("r.start").alias("start_us"), F.col("r.end").alias("end_us"), F.col("r.packets").alias("packets"), F.col("r.octets").alias("octets"))
