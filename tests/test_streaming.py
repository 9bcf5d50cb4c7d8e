"""Streams cut into several batches give the batch results."""

import pytest
from pyspark.sql import functions as F

from wireloom.operators import behavior, dependency, flows, topology
from wireloom.plans import catalog
from wireloom.sources import adapters
from wireloom.streaming import anomaly, engine
from wireloom.streaming.dependency import IncrementalDependencies


@pytest.fixture(scope="module")
def pieces(spark, sf_dir, tmp_path_factory):
    """events in five files by time, as a stream reads them one by one."""
    folder = tmp_path_factory.mktemp("pieces")
    e = adapters.table(spark, sf_dir, "events").withColumn("_p", F.ntile(5).over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("ts")))
    for i in range(1, 6):
        e.where(F.col("_p") == i).drop("_p").coalesce(1).write.mode("append").parquet(f"file://{folder}/in")
    return f"file://{folder}/in"


def stream(spark, pieces):
    return engine.event_stream(spark, pieces, "*.parquet", files=1)


def test_incremental_flows_equal_batch(spark, sf_dir, pieces):
    s = stream(spark, pieces)
    none = F.lit(None).cast("int")
    p = s.select(F.lit("events").alias("capture_id"), F.col("event_id").alias("packet_seq"), "ts", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src_ip"), F.concat(F.lit("svc-"), "event_type").alias("dst_ip"), none.alias("src_port"), none.alias("dst_port"), F.lit("UDP").alias("protocol"), F.floor("value").cast("long").alias("size_bytes"), F.lit(None).cast("string").alias("tcp_flags"))
    inc = engine.IncrementalFlows(spark, catalog.EVENT_IDLE, buckets=8).run(p)
    batch = flows.units(adapters.event_packets(spark, sf_dir), catalog.EVENT_IDLE)
    columns = ["src_ip", "dst_ip", "first_us", "last_us", "packet_count", "byte_count"]
    assert inc.flows().select(columns).exceptAll(batch.select(columns)).isEmpty() and inc.flows().count() == batch.count()
    assert len(inc.batches) == 5
    last = max(inc.batches)
    change = inc.changelog(last)
    assert change.where("sign = 1").count() >= change.where("sign = -1").count() > 0
    want = topology.discover_edges(flows.reconstruct_flows(adapters.event_packets(spark, sf_dir), catalog.EVENT_IDLE), topology.discover_nodes(adapters.event_packets(spark, sf_dir)))
    assert {(r["source"], r["target"], round(r["confidence"], 9)) for r in inc.edges().collect()} == {(r["source"], r["target"], round(r["confidence"], 9)) for r in want.collect()}


def test_alerts_over_batches(spark, sf_dir, pieces):
    s = stream(spark, pieces)
    rows = s.select(F.lit("value").alias("rule"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("scope"), F.unix_micros("ts").alias("us"), F.col("event_id").alias("seq"), "value")
    got = engine.run_append(engine.alert_transitions(rows, 20.0, 60.0), "t")
    want = catalog.QUERIES["alert_transitions"](spark, sf_dir)
    assert got.count() == want.count() and got.select(*want.columns).exceptAll(want).isEmpty()


def test_window_and_sessions(spark, sf_dir, pieces):
    s = stream(spark, pieces).select("ts", F.col("user_id").alias("k"), F.floor("value").cast("long").alias("size_bytes"))
    got = engine.run_update(engine.window_totals(s, ["k"], "1 day"), "w", ["k", "start_us"])
    e = adapters.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("k"), F.floor("value").cast("long").alias("size_bytes"))
    want = engine.window_totals(e, ["k"], "1 day")
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).isEmpty()
    closed = engine.run_append(engine.session_totals(s, ["k"], "12 hours"), "s")
    whole = engine.session_totals(e, ["k"], "12 hours")
    assert 0 < closed.count() <= whole.count() and closed.exceptAll(whole).isEmpty()


def as_packets(e):
    none = F.lit(None).cast("int")
    return e.select(F.lit("events").alias("capture_id"), F.col("event_id").alias("packet_seq"), "ts", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src_ip"), F.concat(F.lit("svc-"), "event_type").alias("dst_ip"), none.alias("src_port"), none.alias("dst_port"), F.lit("UDP").alias("protocol"), F.floor("value").cast("long").alias("size_bytes"), F.lit(None).cast("string").alias("tcp_flags"))


def strengths(df):
    return {(r["source"], r["target"]): tuple(round(r[c], 9) for c in ("strength", "precedence", "frequency", "confidence")) + (r["observation_count"], r["first_us"], r["last_us"]) for r in df.collect()}


def batch_strengths(packets):
    units = flows.reconstruct_flows(packets, catalog.EVENT_IDLE, diversity=False).cache()
    edges = topology.discover_edges(units)
    ends = units.select(F.explode(F.array_distinct(F.array("src_ip", "dst_ip"))).alias("node"), F.col("first_us").alias("us"))
    return strengths(dependency.dependency_strength(edges, dependency.temporal_precedence(edges, ends, 86_400)))


def test_dependencies_equal_batch_after_each_batch(spark, pieces, tmp_path):
    """Also where the stream stops and is started again at the same place, and where flows are taken back."""
    place = f"file://{tmp_path}/deps"
    inc = IncrementalDependencies(spark, catalog.EVENT_IDLE, 86_400, buckets=4, place=place)
    inc.run(as_packets(stream(spark, pieces)))
    retracted = sum(inc.flows.changelog(n).where("sign = -1").count() for n in (1, 2, 3, 4))
    assert retracted > 0
    for n in range(5):
        seen = spark.read.parquet(f"{place}/flows/packets").where(F.col("_batch") <= n).drop("_key", "_bucket", "_batch")
        assert strengths(inc.dependencies(n)) == batch_strengths(seen), n
    again = IncrementalDependencies(spark, catalog.EVENT_IDLE, 86_400, buckets=4, place=place).run(as_packets(stream(spark, pieces)))  # nothing new
    assert strengths(again.dependencies()) == strengths(inc.dependencies())
    want = dependency.causal_candidates(inc.dependencies(), 0.6).count()
    assert inc.candidates(0.6).count() == want


def test_dependencies_of_arrivals_out_of_order(spark):
    """An earlier packet joins two sessions into one: the later flow goes away, the pair's first time moves back, and a pair may lose its persistence."""
    rows = [(0, 100.0, "a", "b"), (1, 200.0, "a", "b"), (2, 205.0, "b", "a"), (3, 120.0, "a", "c"), (4, 125.0, "a", "b"), (5, 150.0, "a", "b"), (6, 175.0, "b", "a"), (7, 90.0, "a", "b")]
    kind = "packet_seq long, s double, src_ip string, dst_ip string"
    df = spark.createDataFrame(rows, kind).selectExpr("'cap' as capture_id", "packet_seq", "timestamp_micros(cast(s * 1000000 as bigint)) as ts", "src_ip", "dst_ip", "cast(null as int) as src_port", "cast(null as int) as dst_port", "'UDP' as protocol", "100l as size_bytes", "cast(null as string) as tcp_flags").cache()
    inc = IncrementalDependencies(spark, 30.0, 10.0, buckets=4)
    cuts = [(0, 3), (4, 4), (5, 6), (7, 7)]
    persistent = []
    for n, (_, upto) in enumerate(cuts):
        inc.ingest(df.where(F.col("packet_seq").between(cuts[n][0], upto)), n)
        units = flows.reconstruct_flows(df.where(F.col("packet_seq") <= upto), 30.0, diversity=False)
        edges = topology.discover_edges(units)
        ends = units.select(F.explode(F.array_distinct(F.array("src_ip", "dst_ip"))).alias("node"), F.col("first_us").alias("us"))
        got = inc.dependencies()
        assert strengths(got) == strengths(dependency.dependency_strength(edges, dependency.temporal_precedence(edges, ends, 10.0))), n
        persistent.append(got.where("target = 'b'").first()["persistent"])
    assert persistent[0] == 1 and persistent[-1] == 0


def test_anomalies_over_batches(spark, sf_dir, pieces, tmp_path):
    """Five batches give the alerts of one, and those of the batch operators over closed epochs, silent nodes included."""
    base = catalog.user_baseline(spark, sf_dir).cache()
    as_flows = lambda e: e.where(F.unix_micros("ts") >= catalog.EPOCH_START + 20 * catalog.DAY_US).select(F.lit("events").alias("capture_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src_ip"), F.concat(F.lit("svc-"), "event_type").alias("dst_ip"), F.get_json_object("props", "$.k").cast("int").alias("dst_port"), F.lit("UDP").alias("protocol"), F.unix_micros("ts").alias("first_us"), F.unix_micros("ts").alias("last_us"), F.lit(0.0).alias("duration_seconds"), F.floor("value").cast("long").alias("byte_count"), F.lit(1.0).alias("forward_byte_ratio"), F.lit(False).alias("is_persistent"))
    found = {}
    for name, source in (("five", stream(spark, pieces)), ("one", engine.event_stream(spark, sf_dir))):
        a = anomaly.StreamingAnomalies(spark, base, 86_400, catalog.EPOCH_START, place=f"file://{tmp_path}/{name}").run(as_flows(source))
        before = a.alerts().count()
        a.flush()
        found[name] = {(r["ip"], r["epoch"], r["feature"]): (round(r["z"], 6), r["partial"]) for r in a.alerts().collect()}
        assert len(found[name]) > before  # the open epoch is judged at the end
    assert set(found["five"]) == set(found["one"])
    assert all(found["one"][k][0] == z for k, (z, partial) in found["five"].items() if not partial and not found["one"][k][1])
    e = adapters.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    prints = behavior.epoch_fingerprints(as_flows(e), 86_400, catalog.EPOCH_START)
    epochs = [r[0] for r in prints.select("epoch").distinct().collect()]
    keys = base.select("capture_id", "ip").distinct().crossJoin(spark.createDataFrame([(x,) for x in epochs], "epoch long"))
    whole = behavior.continuous_anomalies(base, behavior.zero_filled(keys, prints, ["capture_id", "ip", "epoch"]))
    assert set(found["five"]) == {(r["ip"], r["epoch"], r["feature"]) for r in whole.collect()}


def test_destinations_and_late_flows(spark):
    """Both ends of a flow are judged; flows of a closed epoch come too late; a silent node is judged at the close."""
    base = spark.createDataFrame([("c", ip, "total_byte_count", 100.0, 1.0, 9, True) for ip in ("a", "b", "quiet")], "capture_id string, ip string, feature string, med double, mad double, n long, sufficient boolean")
    kind = "capture_id string, src_ip string, dst_ip string, first_us long, last_us long, duration_seconds double, byte_count long, forward_byte_ratio double"
    batch = lambda *rows: spark.createDataFrame([("c", s, d, t, t, 0.0, n, 1.0) for s, d, t, n in rows], kind)
    a = anomaly.StreamingAnomalies(spark, base, 10.0, 0)
    sec = 1_000_000
    a.ingest(batch(("a", "b", 1 * sec, 500)), 0)
    assert {(r["ip"], r["epoch"], r["partial"]) for r in a.alerts().collect()} == {("a", 0, True), ("b", 0, True)}
    a.ingest(batch(("a", "b", 25 * sec, 100)), 1)  # epoch 0 closes; nobody had a flow in epoch 1
    assert {(r["ip"], r["epoch"]) for r in a.alerts().where("not partial").collect()} == {("quiet", 0)}
    a.ingest(batch(("a", "b", 2 * sec, 9_000), ("a", "b", 26 * sec, 1)), 2)  # the first is late
    a.flush()
    assert {(r["ip"], r["epoch"]) for r in a.alerts().where("epoch > 0").collect()} == {("quiet", 2)}


def test_collector_claims_over_batches(spark, tmp_path):
    """Reports in three files by time; pairs that a file's border parts are still claimed."""
    rows = [("c", i, t * 100 + (400 if w == "x" else 0), w, "a", "b", None, 53, "UDP", 90, None) for i, (t, w) in enumerate((t, w) for t in range(0, 300, 7) for w in ("y", "x") if (t, w) != (70, "y"))]
    kind = "capture_id string, packet_seq long, us long, collector string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, size_bytes long, tcp_flags string"
    df = spark.createDataFrame(rows, kind).withColumn("ts", F.timestamp_micros(F.col("us") + 1_700_000_000_000_000)).drop("us").orderBy("ts")
    cuts = [0, 29, 58, len(rows)]
    ordered = df.collect()
    for a, b in zip(cuts, cuts[1:]):
        spark.createDataFrame(ordered[a:b], df.schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    got = engine.run_append(engine.collector_claims(s), "claims")
    want = topology.dedupe_collectors(df)
    assert got.count() == want.count() < len(rows) and {r["packet_seq"] for r in got.collect()} == {r["packet_seq"] for r in want.collect()}
