"""Decoders, encoders and stores by round trips and malformed input."""

import struct

import pytest
from pyspark.sql import functions as F

from wireloom.operators import flows
from wireloom.sources import capture, store

REC = [{"src_ip": f"10.0.0.{i}", "dst_ip": "10.0.1.1", "src_port": 1000 + i, "dst_port": 80, "protocol": 6 if i % 2 else 17, "packets": i, "octets": 100 * i, "start_us": 1_767_225_600_000_000 + i * 1000, "end_us": 1_767_225_600_000_000 + i * 5000, "tcp_flags": 18} for i in range(1, 65)]


def ethernet(src, dst, sport, dport, flags, payload=b""):
    tcp = struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 5 << 4, flags, 0, 0, 0) + payload
    ip = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(tcp), 0, 0, 64, 6, 0) + bytes(map(int, src.split("."))) + bytes(map(int, dst.split(".")))
    return bytes(12) + b"\x08\x00" + ip + tcp


def pcap(frames):
    out = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(frames):
        out += struct.pack("<IIII", 1_767_225_600 + i, 5, len(f), len(f)) + f
    return out


HELLO = b"\x16\x03\x03\x00\x50\x02\x00\x00\x4c\x03\x03" + bytes(32) + b"\x00" + b"\x13\x01\x00" + b"\x00\x06\x00\x2b\x00\x02\x03\x04"


def test_exports_round_trip(spark, tmp_path):
    for name, encode in (("v5", capture.encode_netflow_v5), ("ipfix", capture.encode_ipfix)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.bin").write_bytes(encode(REC))
        (tmp_path / name / "bad.bin").write_bytes(encode(REC)[:-5])
        rows = capture.read_flow_export(spark, f"file://{tmp_path}/{name}", name)
        got = rows.where("error is null").orderBy("src_port").collect()
        assert [(r["src_ip"], r["dst_port"], r["packets"], r["octets"], r["start_us"], r["end_us"]) for r in got] == [(r["src_ip"], 80, r["packets"], r["octets"], r["start_us"], r["end_us"]) for r in REC]
        assert rows.where("error is not null").count() == 1
        assert flows.expand_records(rows.where("error is null")).count() == sum(r["packets"] for r in REC)


def test_ipfix_v6_and_errors():
    six = [REC[0] | {"src_ip": "2001:db8::1", "dst_ip": "2001:db8::2"}]
    assert list(capture.ipfix(capture.encode_ipfix(six)))[0]["src_ip"] == "2001:db8::1"
    for bad in (b"", b"\x00\x05", struct.pack(">HHIII", 10, 20, 0, 0, 1) + struct.pack(">HH", 300, 4), struct.pack(">HHIII", 9, 16, 0, 0, 1)):
        with pytest.raises(capture.DecodeError):
            list(capture.ipfix(bad))
    with pytest.raises(capture.DecodeError):
        list(capture.netflow_v5(struct.pack(">HHIIIIBBH", 9, 1, 0, 0, 0, 0, 0, 0, 0) + bytes(48)))


def test_pcap(spark, tmp_path):
    frames = [ethernet("10.0.0.1", "10.0.0.2", 4000, 443, 2), bytes(12) + b"\x08\x06" + bytes(30), ethernet("10.0.0.2", "10.0.0.1", 443, 4000, 18, HELLO), ethernet("10.0.0.1", "10.0.0.2", 4000, 443, 16)]
    (tmp_path / "x.pcap").write_bytes(pcap(frames))
    (tmp_path / "bad.pcap").write_bytes(b"nonsense")
    rows = capture.read_pcap(spark, f"file://{tmp_path}/*.pcap")
    good = rows.where("error is null")
    assert [r["packet_seq"] for r in good.orderBy("packet_seq").collect()] == [0, 2, 3]
    assert {r["tcp_flags"] for r in good.collect()} == {"SYN", "SYN,ACK", "ACK"}
    f = flows.reconstruct_flows(good, tls=capture.tls_versions(good)).collect()
    assert len(f) == 1 and f[0]["tcp_state"] == "established" and f[0]["tls_version"] == "TLS 1.3"
    assert capture.capture_manifest(rows).where("error is not null").count() == 1


def test_versioned_store(spark, tmp_path):
    path, df = f"file://{tmp_path}/s", spark.range(10).selectExpr("id", "cast(id as string) as t")
    assert store.append_version(df, path, "run") == 1 and store.append_version(df.limit(3), path, "run") == 2
    assert store.read_version(spark, path, "run").count() == 3 and store.read_version(spark, path, "run", 1).count() == 10
    with pytest.raises(FileExistsError):
        store.append_version(df, path, "run", "refuse")
    assert store.table_digest(df).first() == store.table_digest(df.repartition(5)).first()
    store.write_jsonl(df, f"{path}/j")
    assert store.read_jsonl(spark, f"{path}/j", "id long, t string").count() == 10
    spans = spark.createDataFrame([("a", "t", "1", None, {"k": "v"}), ("b", "t", "2", "1", {}), ("b", "u", "3", "1", {})], "name string, trace_id string, span_id string, parent_id string, attributes map<string,string>")
    assert store.spans(spans, "a", k="v").count() == 1 and store.children(spans, store.spans(spans, "a")).count() == 1


def test_counts_of_expanded_packets(spark):
    """Records that share a start and a spacing, of any lengths, and some without packets or octets."""
    rows = [("c", i, "a", "b", 1, 2, "UDP", p, o, s, s + span) for i, (p, o, s, span) in enumerate([(1, 10, 0, 0), (0, 7, 0, 0), (None, 3, 5, 9), (4, 43, 0, 3), (4, 43, 0, 3), (4, 41, 0, 3), (7, 75, 0, 6), (3, 30, 0, 2), (3, 30, 1, 100), (5, 3, 2, 7), (6, None, 0, 5), (2, 9, 0, 1)])]
    df = spark.createDataFrame(rows, "capture_id string, record_id int, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, packets long, octets long, start_us long, end_us long")
    want = sorted(map(tuple, flows.expand_records(df).groupBy(F.unix_micros("ts").alias("at"), "size_bytes").count().collect()), key=str)
    assert sorted(map(tuple, flows.expanded_counts(df).collect()), key=str) == want
    # a packet's place stands for all records that go on after it: 60 equal records make no more rows than one
    many = spark.createDataFrame([("c", i, "a", "b", 1, 2, "UDP", 9, 95, 0, 8) for i in range(60)], df.schema)
    assert {r["n"] for r in flows.expanded_counts(many).collect()} == {60}
