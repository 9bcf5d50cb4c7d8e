"""Flows to graphs: nodes, node-pair edges with noisy-or confidence, several collectors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.functions.expressions import bidirectionality, micros, survival, volume_evidence
from wireloom.functions.ranking import ranked

PACKET_SCALE, SIGNAL_STRENGTH = 20.0, 0.3


def discover_nodes(packets: DataFrame, as_of_us: int | None = None) -> DataFrame:
    """(capture_id, ip, first_us, last_us): every address seen as source or destination, up to as_of_us."""
    p = packets.select("capture_id", micros(F.col("ts")).alias("us"), F.explode(F.array("src_ip", "dst_ip")).alias("ip"))
    if as_of_us is not None:
        p = p.where(F.col("us") <= as_of_us)
    return p.where("ip is not null").groupBy("capture_id", "ip").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def numbered_nodes(nodes: DataFrame) -> DataFrame:
    """nodes with node_id: by first observation, then address."""
    r = ranked(nodes, "capture_id", [F.col("first_us"), F.col("ip")], "_rank")
    return r.withColumn("node_id", F.concat_ws(":", "capture_id", F.lit("node"), F.col("_rank").cast("string"))).drop("_rank")


def flow_pairs(flows: DataFrame, nodes: DataFrame | None = None, as_of_us: int | None = None) -> DataFrame:
    """flows with source and target node (node_id where nodes has it, else the address), in string order; flows to oneself or with unknown ends drop out.

    With as_of_us, flows that began by then count, with all their packets, later ones too.
    Without nodes every address is one, by its own name: then nothing is joined, which is
    the way for flows whose nodes come from the same packets.
    """
    if as_of_us is not None:
        flows = flows.where(F.col("first_us") <= as_of_us)
    if nodes is None:
        return flows.where(F.col("src_ip") != F.col("dst_ip")).withColumn("source", F.least("src_ip", "dst_ip")).withColumn("target", F.greatest("src_ip", "dst_ip"))
    label = "node_id" if "node_id" in nodes.columns else "ip"
    s = nodes.select("capture_id", F.col("ip").alias("src_ip"), F.col(label).alias("_s"))
    d = nodes.select("capture_id", F.col("ip").alias("dst_ip"), F.col(label).alias("_d"))
    both = flows.join(s, ["capture_id", "src_ip"]).join(d, ["capture_id", "dst_ip"]).where("_s <> _d")
    return both.withColumn("source", F.least("_s", "_d")).withColumn("target", F.greatest("_s", "_d")).drop("_s", "_d")


def edge_signals(pairs: DataFrame) -> DataFrame:
    """One row per node pair: sums and any/max signals of its flows. Partial sums happen before the shuffle."""
    return pairs.groupBy("capture_id", "source", "target").agg(
        F.count(F.lit(1)).alias("observation_count"), F.sum("packet_count").alias("packets"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
        F.max(F.coalesce((F.col("tcp_state") == "established").cast("int"), F.lit(0))).alias("established"), F.max(F.col("fingerprinted_protocol").isNotNull().cast("int")).alias("fingerprinted"),
        F.max(F.col("tls_version").isNotNull().cast("int")).alias("tls"), F.max(F.col("is_persistent").cast("int")).alias("persistent"), F.max(bidirectionality(F.col("forward_byte_ratio"))).alias("bidirectional"),
        F.avg("forward_byte_ratio").alias("mean_forward_ratio"), F.array_join(F.array_sort(F.collect_set("protocol")), ",").alias("protocols"),
    )


def confidence(packet_scale: float = PACKET_SCALE, strength: float = SIGNAL_STRENGTH) -> Column:
    """Noisy-or of traffic volume and five signals over columns of edge_signals."""
    signals = [F.col(c) * strength for c in ("established", "fingerprinted", "tls", "persistent", "bidirectional")]
    return 1 - survival(volume_evidence(F.col("packets"), packet_scale), *signals)


def discover_edges(flows: DataFrame, nodes: DataFrame | None = None, packet_scale: float = PACKET_SCALE, strength: float = SIGNAL_STRENGTH, as_of_us: int | None = None, min_bidirectionality: float = 0.0) -> DataFrame:
    edges = edge_signals(flow_pairs(flows, nodes, as_of_us)).withColumn("confidence", confidence(packet_scale, strength))
    return edges.where(F.col("bidirectional") >= min_bidirectionality) if min_bidirectionality > 0 else edges


def numbered_edges(edges: DataFrame) -> DataFrame:
    r = ranked(edges, "capture_id", [F.col("first_us"), F.col("source"), F.col("target")], "_rank")
    return r.withColumn("edge_id", F.concat_ws(":", "capture_id", F.lit("edge"), F.col("_rank").cast("string"))).drop("_rank")


def evidence(pairs: DataFrame, edges: DataFrame, strength: float = SIGNAL_STRENGTH) -> DataFrame:
    """(capture_id, source, target, evidence): a line per flow by time, then a summary line.

    pairs needs flow_id; the lines of one pair come together in its row, so ask for the
    pairs that somebody will read.
    """
    none = F.lit(None).cast("string")
    line = F.concat_ws(
        ", ",
        F.format_string("flow %s: %s %s:%s->%s:%s", "flow_id", "protocol", "src_ip", F.coalesce(F.col("src_port").cast("string"), F.lit("None")), "dst_ip", F.coalesce(F.col("dst_port").cast("string"), F.lit("None"))),
        F.concat(F.col("packet_count").cast("string"), F.lit(" packets")), F.concat(F.col("byte_count").cast("string"), F.lit(" bytes")),
        F.when(F.col("tcp_state").isNotNull(), F.concat(F.lit("tcp_state="), "tcp_state")).otherwise(none), F.when(F.col("fingerprinted_protocol").isNotNull(), F.concat(F.lit("fingerprinted_protocol="), "fingerprinted_protocol")).otherwise(none),
        F.when(F.col("tls_version").isNotNull(), F.concat(F.lit("tls_version="), "tls_version")).otherwise(none), F.when(F.col("is_persistent"), F.lit("is_persistent=True")).otherwise(none),
        F.format_string("forward_byte_ratio=%.3f", "forward_byte_ratio"),
    )
    lines = pairs.groupBy("capture_id", "source", "target").agg(F.transform(F.array_sort(F.collect_list(F.struct("first_us", "flow_id", line.alias("line")))), lambda x: x["line"]).alias("_lines"))

    def yes(c: str) -> Column:
        return F.when(F.col(c) > 0, "yes").otherwise("no")

    summary = F.format_string(
        f"confidence signals: established_handshake=%s, fingerprinted_protocol=%s, tls=%s, persistent=%s, bidirectional_strength=%.3f (signal_strength={strength}) -> confidence=%.3f",
        yes("established"), yes("fingerprinted"), yes("tls"), yes("persistent"), "bidirectional", "confidence",
    )
    joined = lines.join(edges, ["capture_id", "source", "target"])
    return joined.select("capture_id", "source", "target", F.concat("_lines", F.array(summary)).alias("evidence"))


def connected_nodes(nodes: DataFrame, edges: DataFrame, label: str = "ip") -> DataFrame:
    """nodes that an edge touches."""
    ends = edges.select("capture_id", F.explode(F.array("source", "target")).alias(label)).distinct()
    return nodes.join(ends, ["capture_id", label], "left_semi")


def resolve_collectors(edges: DataFrame, nodes: DataFrame, spread: float = 0.15) -> DataFrame:
    """How collectors agree on each edge: edges(collector, source, target, confidence) against nodes(collector, ip).

    supporting saw the edge; absent saw both ends but no edge. kind is existence (somebody
    is absent), confidence (values apart by more than spread), single_source or agree.
    """
    seen = edges.groupBy("source", "target").agg(F.count(F.lit(1)).alias("supporting"), (F.max("confidence") - F.min("confidence")).alias("_spread"))
    s = nodes.select("collector", F.col("ip").alias("source"))
    d = nodes.select("collector", F.col("ip").alias("target"))
    saw = seen.select("source", "target").join(s, "source").join(d, ["collector", "target"])
    absent = saw.join(edges.select("collector", "source", "target"), ["collector", "source", "target"], "left_anti").groupBy("source", "target").agg(F.count(F.lit(1)).alias("absent"))
    out = seen.join(absent, ["source", "target"], "left").withColumn("absent", F.coalesce("absent", F.lit(0)).cast("long"))
    kind = F.when(F.col("absent") > 0, "existence").when(F.col("_spread") > spread, "confidence").when(F.col("supporting") == 1, "single_source").otherwise("agree")
    return out.withColumn("kind", kind).drop("_spread")


def quorum(resolutions: DataFrame, min_absent: int = 2) -> DataFrame:
    """Edges without those that one collector alone saw and min_absent others should have seen."""
    return resolutions.where(~((F.col("supporting") == 1) & (F.col("absent") >= min_absent)))


IDENTITY = ["capture_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "size_bytes", "tcp_flags"]


def nearest_claim(held: list[tuple[int, set]], us: int, collector, tolerance_us: int) -> bool:  # noqa: ANN001
    """Whether a report is of a packet that another collector has reported; held are the packets known, (time, collectors), and are brought up to date.

    Of those within tolerance that this collector hasn't reported the nearest in time is
    the one, the one known first among equals; without one the report is of a new packet.
    """
    best = None
    for entry in held:
        gap = abs(entry[0] - us)
        if collector not in entry[1] and gap <= tolerance_us and (best is None or gap < abs(best[0] - us)):
            best = entry
    if best is None:
        held.append((us, {collector}))
        return False
    best[1].add(collector)
    return True


def identity_key() -> Column:
    """The columns of IDENTITY as one text, nulls apart from empty values."""
    return F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in IDENTITY])


def dedupe_collectors(packets: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """packets(collector, ...) with each packet that several collectors saw kept once, as its first report.

    Reports of one identity are taken by time, then collector and packet_seq; each claims the
    nearest packet within tolerance seconds that its collector hasn't reported yet, see
    nearest_claim(). A task goes through its identities as a sorted stream and keeps the
    packets of the last tolerance seconds, however many reports an identity has. Null times
    come first and are never near to any; a null collector is one of its own.
    """
    limit = int(tolerance * 1_000_000)
    columns = packets.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            keep = []
            for key, us, collector in zip(*(batch.column(c).to_pylist() for c in ("_key", "_us", "_who"))):
                if key != now:
                    now, held = key, []
                if us is None:
                    keep.append(True)
                    continue
                held = [e for e in held if us - e[0] <= limit]
                keep.append(not nearest_claim(held, us, collector, limit))
            out = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([out.column(f"_{i}") for i in range(len(columns))], names=columns)

    rows = packets.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns)], identity_key().alias("_key"), micros(F.col("ts")).alias("_us"), F.col("collector").cast("string").alias("_who"), F.col("packet_seq").alias("_seq"))
    ordered = rows.repartition("_key").sortWithinPartitions("_key", "_us", F.col("_who"), "_seq")
    return ordered.mapInArrow(run, packets.schema)
