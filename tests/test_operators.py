"""Hand-computed cases, and graph algorithms against plain Python."""

import collections
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wireloom.operators import behavior, biconnected, causal, components, dependency, flows, generate, graph, history, learned, metrics, outcomes, roles, topology

T0 = 1_767_225_600_000_000
PACKET = "capture_id string, packet_seq long, us long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, size_bytes long, tcp_flags string"


def packets(spark, rows):
    df = spark.createDataFrame([("cap", i, T0 + round(t * 1e6), *r) for i, (t, *r) in enumerate(rows)], PACKET)
    return df.withColumn("ts", F.timestamp_micros("us")).drop("us")


def tcp(t, a, b, size=100, flags=None, back=False):
    return (t, b, a, 80, 1000, "TCP", size, flags) if back else (t, a, b, 1000, 80, "TCP", size, flags)


def test_flow_arithmetic(spark):
    p = packets(spark, [tcp(0, "A", "B"), tcp(2, "A", "B"), tcp(4, "A", "B", 50, back=True)])
    (f,) = flows.reconstruct_flows(p).collect()
    assert (f["packet_count"], f["byte_count"], f["duration_seconds"], f["mean_inter_arrival_seconds"], f["burstiness"]) == (3, 250, 4.0, 2.0, 0.0)
    assert f["forward_byte_ratio"] == 0.8 and (f["destination_diversity"], f["port_diversity"]) == (1, 1) and f["src_ip"] == "A" and f["fingerprinted_protocol"] == "http"


@pytest.mark.parametrize("gap,n", [(5.0, 1), (5.001, 2)])
def test_udp_boundary(spark, gap, n):
    p = packets(spark, [(0, "A", "B", 1, 2, "UDP", 1, None), (gap, "B", "A", 2, 1, "UDP", 1, None)])
    rows = flows.reconstruct_flows(p, 5.0).collect()
    assert len(rows) == n and all(r["is_persistent"] == (n > 1) for r in rows)


def fold(seq):
    syn = est = False
    fins = set()
    for flags, back in seq:
        flags = set(flags.split(","))
        if "RST" in flags:
            return "reset"
        if "SYN" in flags:
            syn = True
        elif "FIN" in flags:
            fins.add(back)
        elif "ACK" in flags and syn and not est and not fins:
            est = True
    if not syn or not est:
        return "partial"
    return ("established", "closing", "closed")[len(fins)]


def test_tcp_states_against_the_fold(spark):
    kinds = [(f, b) for f in ("SYN", "SYN,ACK", "ACK", "FIN,ACK", "RST", "PSH") for b in (False, True)]
    rng = random.Random(5)
    cases = [[("SYN", False), ("SYN,ACK", True), ("ACK", False)], [("SYN", False), ("SYN,ACK", True), ("ACK", False), ("FIN,ACK", False), ("FIN,ACK", True)]]
    cases += [[rng.choice(kinds) for _ in range(rng.randint(1, 7))] for _ in range(120)]
    rows = [(t, *tcp(0, f"h{i}", "srv", 1, flags, back)[1:]) for i, seq in enumerate(cases) for t, (flags, back) in enumerate(seq)]
    got = {}
    for r in flows.units(packets(spark, rows)).collect():
        got[r["src_ip"] if r["src_ip"] != "srv" else r["dst_ip"]] = r["tcp_state"]
    # directions count from the first packet, which only swaps the two FIN sides
    assert got == {f"h{i}": fold(seq) for i, seq in enumerate(cases)}


def test_self_flows_and_icmp(spark):
    p = packets(spark, [(0, "A", "A", 1, 1, "TCP", 5, None), (1, "A", "B", None, None, "ICMP", 5, None)])
    nodes = topology.discover_nodes(p)
    assert {r["ip"] for r in nodes.collect()} == {"A", "B"}
    f = flows.reconstruct_flows(p)
    assert f.count() == 1 and topology.discover_edges(f, nodes).count() == 0
    assert behavior.node_features(f, nodes).where("ip = 'B'").first()["total_byte_count"] == 0
    assert flows.with_direction(p).where("direction = 'unknown'").count() == 1


def test_baseline_and_anomaly(spark):
    rows = [("c", "n", i, 3 + i % 3, 1 + 0.1 * (i % 3), 0.5 + 0.01 * (i % 3), 1000 + 10 * (i % 3)) for i in range(10)]
    schema = "capture_id string, ip string, epoch long, distinct_destinations long, mean_flow_duration_seconds double, outbound_byte_ratio double, total_byte_count long"
    base = behavior.baseline(spark.createDataFrame(rows, schema))
    odd = spark.createDataFrame([("c", "n", 10, 100, 1.1, 0.51, 1010)], schema)
    found = behavior.continuous_anomalies(base, odd).collect()
    assert [r["feature"] for r in found] == ["distinct_destinations"] and found[0]["z"] == pytest.approx(96)
    assert behavior.continuous_anomalies(behavior.baseline(spark.createDataFrame(rows[:3], schema)), odd).count() == 0


def times(spark, node, buckets):
    return [(node, T0 + b * 10_000_000) for b in buckets]


def test_temporal_precedence(spark):
    a = [0, 4, 9, 15, 22]
    rows = times(spark, "A", a) + times(spark, "B", [x + 2 for x in a]) + times(spark, "C", a)
    t = spark.createDataFrame(rows, "node string, us long")
    pairs = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "A")], "source string, target string")
    got = {(r["source"], r["target"]): r["precedence"] for r in dependency.temporal_precedence(pairs, t).collect()}
    assert got["A", "B"] > 0.5 and got["A", "C"] == 0.0


def test_shapley_adds_up(spark):
    d = spark.createDataFrame([("a", "b", 0.4, 30.0, 0.7, 0.9, 0.2)], "source string, target string, frequency double, persistence_seconds double, directionality double, confidence double, precedence double")
    from wireloom.functions.expressions import survival

    r = dependency.shapley(d.withColumn("strength", 1 - survival(*dependency.signal_terms()))).first()
    assert sum(r[f"phi_{s}"] for s in dependency.SIGNALS) == pytest.approx(r["strength"])


EDGES = [("A", "B", 0.9), ("B", "D", 0.9), ("A", "C", 0.5), ("C", "D", 0.5), ("D", "E", 0.8), ("X", "Y", 0.7)]


def graph_df(spark, edges=EDGES):
    return spark.createDataFrame(edges, "source string, target string, confidence double")


def test_paths_and_components(spark):
    g = graph_df(spark)
    starts = spark.createDataFrame([("A",)], "start string")
    got = {r["node"]: (r["cost"], r["path"].split(graph.SEPARATOR)) for r in graph.shortest_paths(g, starts).collect()}
    assert got["D"][0] == pytest.approx(-2 * math.log(0.9)) and got["D"][1] == ["A", "B", "D"] and "X" not in got
    paths = [r["path"].split(graph.SEPARATOR) for r in graph.alternate_paths(g, "A", "D").orderBy("rank").collect()]
    assert paths == [["A", "B", "D"], ["A", "C", "D"]]
    assert {r["component"] for r in graph.components(g).collect()} == {"A", "X"}


def brute_betweenness(edges):
    nodes = sorted({x for e in edges for x in e[:2]})
    near = {n: {b for a, b, *_ in edges if a == n} | {a for a, b, *_ in edges if b == n} for n in nodes}

    def paths(s, t):
        level, found = [[s]], []
        while level and not found:
            found = [p for p in level if p[-1] == t]
            level = [p + [x] for p in level for x in near[p[-1]] if x not in p]
        return found

    out = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.combinations(nodes, 2):
        if ps := paths(s, t):
            for v in nodes:
                if v not in (s, t):
                    out[v] += sum(v in p for p in ps) / len(ps)
    n = len(nodes)
    return {v: 2 * x / ((n - 1) * (n - 2)) for v, x in out.items()}


def test_betweenness_and_criticality(spark):
    rng = random.Random(2)
    edges = [(f"n{a}", f"n{b}", 0.5) for a, b in itertools.combinations(range(9), 2) if rng.random() < 0.3]
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(graph_df(spark, edges)).collect()}
    assert got == pytest.approx(brute_betweenness(edges))
    star = {r["node"]: (r["articulation"], r["impact"]) for r in graph.criticality(graph_df(spark, [("H", x, 0.5) for x in "ABC"])).collect()}
    assert star == {"H": (True, 2), "A": (False, 0), "B": (False, 0), "C": (False, 0)}
    top = graph.root_causes(graph_df(spark, [("H", x, 0.5) for x in "ABC"]), "H").first()
    assert top["node"] == "H" and top["score"] == 1.0


def test_searches_reach_the_end_of_a_chain(spark):
    """Searches have no depth at which they stop: a chain of 17 edges, whose far end is past every former bound and past a cut of the plan."""
    names = [f"n{i:02d}" for i in range(18)]
    g = graph_df(spark, [(a, b, 0.9) for a, b in zip(names, names[1:])])
    starts = spark.createDataFrame([(names[0],)], "start string")
    assert {r["node"]: r["hop"] for r in graph.hops(g, starts).collect()} == {n: i for i, n in enumerate(names)}
    assert {r["node"]: r["cost"] for r in graph.shortest_paths(g, starts).collect()} == pytest.approx({n: -i * math.log(0.9) for i, n in enumerate(names)})
    want = {n: 2 * i * (17 - i) / (17 * 16) for i, n in enumerate(names)}
    assert {r["node"]: r["betweenness"] for r in graph.betweenness(g).collect()} == pytest.approx(want)


def test_metrics(spark):
    empty = spark.createDataFrame([], "k string")
    r = metrics.set_scores(empty, empty, ["k"]).first()
    assert (r["precision"], r["recall"], r["f1"]) == (1.0, 1.0, 1.0)
    p = spark.createDataFrame([(i, x) for i, x in enumerate([0.01, 0.04, 0.03, 0.005])], "i int, p double")
    assert [round(x["adjusted"], 9) for x in metrics.holm(p, "p").orderBy("i").collect()] == [0.03, 0.06, 0.06, 0.02]
    labels = spark.createDataFrame([("n", 0.0), ("n", 100.0)], "k string, onset double")
    found = spark.createDataFrame([("n", 10.0), ("n", 100.5)], "k string, at double")
    assert sorted(x["latency"] for x in metrics.match_events(labels, found, ["k"]).collect()) == [0.5, 10.0]
    t = spark.createDataFrame([(2.0, 10.0), (0.0, 4.0), (-3.5, 24.0)], "t double, df double").select(metrics.student_p(F.col("t"), F.col("df")).alias("p")).collect()
    assert [round(x["p"], 4) for x in t] == [0.0734, 1.0, 0.0018]


def greedy(labels, found):
    left, out = sorted(found), []
    for o in sorted(labels):
        hit = next((x for x in left if x >= o), None)
        if hit is not None:
            left.remove(hit)
        out.append((o, hit))
    return out


def test_matching_against_greedy(spark):
    rng = random.Random(8)
    for _ in range(5):
        labels, found = ([float(rng.randint(0, 60)) + i / 100 for i in range(rng.randint(0, 9))] for _ in range(2))
        a = spark.createDataFrame([("k", x) for x in labels], "k string, onset double")
        b = spark.createDataFrame([("k", x) for x in found], "k string, at double")
        got = sorted(((r["onset"], r["detected"]) for r in metrics.match_events(a, b, ["k"]).collect()), key=lambda x: x[0])
        assert got == greedy(labels, found)


def test_export_records_against_fold(spark):
    rng = random.Random(9)
    rows, t = [], 0
    for _ in range(80):
        t += rng.choice((500, 3000, 9000, 14900, 15000, 15500))
        rows.append((t / 1000, "A", "B", 1, 2, "UDP", 10, None))
    want, start, last = [], None, None
    for t, *_ in rows:
        t = round(t * 1000)
        if start is None or t - last > 15_000 or t - start >= 60_000:
            want.append([t, t, 0])
            start = t
        want[-1][1:] = [t, want[-1][2] + 1]
        last = t
    got = sorted(((r["start_us"] - T0) // 1000, (r["end_us"] - T0) // 1000, r["packets"]) for r in flows.export_records(packets(spark, rows), 15, 60).collect())
    assert got == [tuple(x) for x in want]


def brute_sweep(pairs):
    """Every failure by a search of its own."""
    links = {frozenset(p) for p in pairs if p[0] != p[1]}
    nodes = sorted({x for p in links for x in p})

    def parts(left, kept):
        out, todo = [], set(left)
        while todo:
            part, front = set(), {todo.pop()}
            while front:
                part |= front
                front = {y for e in kept if e & front for y in e} - part
            todo -= part
            out.append(len(part))
        return out

    before = len(parts(nodes, links))
    rows = {}
    for kind, what in [("node", n) for n in nodes] + [("edge", e) for e in links]:
        left = [n for n in nodes if kind == "edge" or n != what]
        kept = {e for e in links if (what not in e if kind == "node" else e != what)}
        sizes = parts(left, kept)
        touched = {y for e in kept for y in e}
        pieces = len(sizes) - before + 1
        key = (kind, what, what) if kind == "node" else (kind, *sorted(what))
        rows[key] = (pieces > 1, max(sizes, default=0) / len(nodes), len(touched) / len(nodes), len(left) - max(sizes, default=0))
    return rows


def test_failure_sweep_against_searches(spark):
    rng = random.Random(4)
    shapes = [
        [("a", "b")], [("a", "b"), ("b", "c"), ("c", "d")], [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("x", "y"), ("y", "y"), ("b", "a")],
        [(f"n{rng.randint(0, 25):02}", f"n{rng.randint(0, 25):02}") for _ in range(30)], [(f"n{i}", f"n{i // 2}") for i in range(1, 20)] + [("n7", "n8"), ("n19", "n5")],
    ]
    for k, pairs in enumerate([shapes[0], [(f"{i}{a}", f"{i}{b}") for i, shape in enumerate(shapes) for a, b in shape]]):  # all shapes are components of one graph
        df = spark.createDataFrame(pairs, "source string, target string")
        got = {(r["kind"], r["source"], r["target"]): tuple(r)[3:] for r in biconnected.failure_sweep(df).collect()}
        want = brute_sweep(pairs)
        assert set(got) == set(want), k
        for key in want:
            assert got[key] == pytest.approx(want[key]), (k, key)
    assert biconnected.failure_sweep(df.limit(0)).count() == 0


def test_failures_search_rows_in_proportion_to_nodes(spark, monkeypatch):
    """A dense graph's edges are contracted before they are searched, for the forest and for the blocks; a failure's rows stay right."""
    pairs = [(f"a{i:02}", f"b{j:02}") for i in range(30) for j in range(30) if (i < 15) == (j < 15) or (i, j) == (0, 20)]
    searched = []
    real = components.connected_components
    search = lambda e: searched.append(e.count()) or real(e)
    monkeypatch.setattr(components, "connected_components", search)
    monkeypatch.setattr(biconnected, "connected_components", search)
    df = spark.createDataFrame(pairs, "source string, target string")
    got = {(r["kind"], r["source"], r["target"]): tuple(r)[3:] for r in biconnected.failure_sweep(df).collect()}
    assert len(pairs) > 7 * 60 and max(searched) <= 2 * 60
    assert {k for k, v in got.items() if v[0]} == {("edge", "a00", "b20"), ("node", "a00", "a00"), ("node", "b20", "b20")} and len(got) == len(pairs) + 60
    assert got["edge", "a00", "b20"] == (True, 0.5, 1.0, 30) and got["node", "a00", "a00"] == (True, 0.5, 59 / 60, 29) and got["edge", "a01", "b01"] == (False, 1.0, 1.0, 0)


def test_components_after_failures_without_a_search_each(spark, monkeypatch):
    """Failed nodes' components, sizes and indicators against searches; the graph is searched as a whole and not once for each of them."""
    rng = random.Random(9)
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("e", "f"), ("x", "y"), ("y", "y"), ("b", "a"), ("loop", "loop"), ("q", "r"), ("q", "s"), ("q", "t")]
    pairs += [(f"m{rng.randint(0, 40):02}", f"m{rng.randint(0, 40):02}") for _ in range(45)] + [(f"t{i}", f"t{i // 2}") for i in range(1, 20)] + [("t7", "t8"), ("t19", "t5")]
    nodes = sorted({x for p in pairs for x in p})

    def parts(failed):
        name = {n: n for n in nodes if n != failed}
        for _ in nodes:
            for a, b in pairs:
                if failed not in (a, b):
                    name[a] = name[b] = min(name[a], name[b])
        return name

    df, who = spark.createDataFrame(pairs, "source string, target string"), spark.createDataFrame([(n,) for n in [*nodes, "none"]], "failed string")
    searched = []
    real = biconnected.connected_components
    monkeypatch.setattr(graph, "connected_components", lambda e: pytest.fail("a search of all scenarios"))
    monkeypatch.setattr(biconnected, "connected_components", lambda e: searched.append(e) or real(e))
    got = {(r["failed"], r["node"]): (r["component"], r["size"]) for r in graph.failed_components(df, who).collect()}
    assert len(searched) == 2  # the forest and its blocks
    once = biconnected.Failures(df, who)
    monkeypatch.setattr(biconnected, "Failures", lambda *_: once)
    far = {tuple(r) for r in graph.newly_unreachable(df, who).collect()}
    res = {r["failed"]: tuple(r)[1:] for r in graph.resilience(df, who).collect()}
    out = {r["failed"]: tuple(r)[1:] for r in outcomes.failure_outcomes(df, who).collect()}
    before = len(set(parts(None).values()))
    want, lost = {}, set()
    for f in [*nodes, "none"]:
        name = parts(f)
        size = collections.Counter(name.values())
        want |= {(f, n): (c, size[c]) for n, c in name.items()}
        best = min(size, key=lambda c: (-size[c], c))
        lost |= {(f, n) for n, c in name.items() if c != best}
        stranded = len(name) - size[best]
        assert res[f] == pytest.approx((size[best] / len(nodes), sum(size[c] >= 2 for c in name.values()) / len(nodes), stranded)), f
        assert out[f] == pytest.approx((stranded, stranded / len(nodes), len(size) > before)), f
    assert got == want and far == lost and set(res) == set(out) == {*nodes, "none"}


def test_resilience_indicators_against_searches(spark, monkeypatch):
    """All six indicators of every node's failure, with blocks that a task takes and with blocks shrunk by joins."""
    rng = random.Random(5)
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("e", "f"), ("y", "y"), ("b", "a"), ("loop", "loop"), ("q", "r"), ("q", "s"), ("q", "t"), ("f", "m3")]
    pairs += [(f"m{rng.randint(0, 30):02}", f"m{rng.randint(0, 30):02}") for _ in range(45)] + [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)] + [("r0", "r3"), ("m01", "m3")]
    nodes = sorted({x for p in pairs for x in p})
    links = {frozenset(p) for p in pairs if p[0] != p[1]}
    candidates = [(f"m{rng.randint(0, 30):02}", f"m{rng.randint(0, 30):02}") for _ in range(40)] + [("q", "r"), ("r", "q"), ("r", "far"), ("far", "farther")]

    def parts(gone):
        out, todo = [], set(nodes) - gone
        while todo:
            part, front = set(), {min(todo)}
            while front:
                part |= front
                front = {y for e in links if e & front for y in e} - part - gone
            todo -= part
            out.append(part)
        return sorted(out, key=lambda p: (-len(p), min(p)))

    cuts = lambda gone: {x for x in set(nodes) - gone if len(parts(gone | {x})) > len(parts(gone)) - (parts(gone).count({x}))}
    before, already = parts(set())[0], cuts(set())
    want = {}
    for f in [*nodes, "none"]:
        after = parts({f})
        reached = {f}
        for _ in range(2):
            reached |= {b for a, b in candidates if a in reached}
        near = {y for e in links if f in e for y in e} - {f}
        connected = sum(len(p) for p in after if len(p) > 1)
        want[f] = (len(after[0]) / len(before), connected / len(nodes), len(reached | (before - {f} - after[0])), -np.log(1e-9) * len(near), sorted(cuts({f}) - already), False, len(set(nodes) - {f}) - len(after[0]))
    df, who = spark.createDataFrame(pairs, "source string, target string"), spark.createDataFrame([(n,) for n in [*nodes, "none"]], "failed string")
    how = spark.createDataFrame(candidates, "source string, target string")
    once = biconnected.Failures(df, who)
    monkeypatch.setattr(biconnected, "Failures", lambda *_: once)
    for r in graph.resilience_indicators(df, who, how).collect():
        x = want.pop(r["failed"])
        assert r["bottlenecks"] == x[4] and r["alternative_path"] is x[5], r
        assert (r["connectivity_ratio"], r["reachable_ratio"], r["affected_services"], r["path_degradation"], r["stranded"]) == pytest.approx((*x[:4], x[6])), r
        want |= {(r["failed"], n): 1 for n in x[4]}
    assert len(want) > 20 and not set(want) & {*nodes, "none"}
    monkeypatch.setattr(biconnected, "BLOCK_EDGES", 8)
    monkeypatch.setattr(biconnected, "TOGETHER", (2, 9))
    assert {tuple(r): 1 for r in once.emerging().collect()} == want


def test_scenarios_by_turns(spark, monkeypatch, tmp_path):
    """Rows of many scenarios come some at a time, each for all nodes: the same rows, in files a fraction as large."""
    pairs = [(f"n{i:05}", f"n{i // 3:05}") for i in range(1, 800)]
    df = spark.createDataFrame(pairs, "source string, target string")
    f = biconnected.Failures(df, df.select(F.col("source").alias("failed")).distinct())
    sizes, rows = [], []
    for n in (1 << 30, 50):
        monkeypatch.setattr(biconnected, "IN_TURN", n)
        got = f.components()
        rows.append(got.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*got.columns).cast("decimal(38,0)"))).first())
        got.coalesce(1).select("failed", "node", "component").write.parquet(f"{tmp_path}/{n}")
        sizes.append(sum(p.stat().st_size for p in tmp_path.glob(f"{n}/*.parquet")))
    assert rows[0] == rows[1] and rows[0][0] == 799 * 799 and sizes[1] < 0.7 * sizes[0], sizes


def test_distances_of_many_starts(spark):
    """Starts share rows, 64 to one; hops() says the same."""
    rng = random.Random(2)
    pairs = [(f"n{rng.randint(0, 60):02}", f"n{rng.randint(0, 60):02}") for _ in range(70)] + [("z", f"z{i}") for i in range(12)]
    df = spark.createDataFrame([(a, b, 0.5) for a, b in pairs], "source string, target string, confidence double")
    starts = spark.createDataFrame([(x,) for x in sorted({x for p in pairs for x in p})] + [("none",)], "start string")
    assert starts.count() > 64
    for depth in (3, None):
        got = sorted(tuple(r) for r in graph.distances(df, starts, depth).collect())
        assert got == sorted(tuple(r)[:3] for r in graph.hops(df, starts, depth).collect())


def test_distances_in_wide_rows(spark, monkeypatch):
    """A level has one row of a node for up to 1,024 starts; rows of fewer starts say the same."""
    rng = random.Random(7)
    df = spark.createDataFrame([(f"n{rng.randint(0, 140):03}", f"n{rng.randint(0, 140):03}", 0.5) for _ in range(260)], "source string, target string, confidence double")
    starts = df.select(F.col("source").alias("start")).unionByName(df.select(F.col("target").alias("start"))).distinct()
    real, levels = graph.cut, []
    monkeypatch.setattr(graph, "cut", lambda d, name="cut", *rest: levels.append(real(d, name, *rest)) or levels[-1] if name == "level" else real(d, name, *rest))
    wide = sorted(tuple(r) for r in graph.distances(df, starts).collect())
    assert starts.count() > 128 and all(x.select("node").distinct().count() == x.count() for x in levels)
    monkeypatch.setattr(graph, "WORDS", 1)
    assert wide == sorted(tuple(r) for r in graph.distances(df, starts).collect())
    assert len(wide) > 5000 and max(x.count() for x in levels) > starts.count()


def brute_parents(series, target, sources, lag, alpha):
    """Tests by the inverse of whole covariance matrices, over arrays of one target."""
    n = min(map(len, series.values()))
    y = series[target][lag:]
    x = {(s, k): series[s][lag - k : n - k] for s in sorted({*sources, target}) for k in range(1, lag + 1)}

    def corr(key, given):
        m = np.stack([x[key], y, *[x[g] for g in given]]).astype(float)
        c = np.corrcoef(m)
        if np.isnan(c).any() or (len(given) and np.linalg.eigvalsh(c[2:, 2:])[0] < 1e-10):
            return None
        s = c[:2, :2] - (c[:2, 2:] @ np.linalg.solve(c[2:, 2:], c[2:, :2]) if len(given) else 0)
        return None if min(s[0, 0], s[1, 1]) < 1e-10 else s[0, 1] / np.sqrt(s[0, 0] * s[1, 1])

    strong = {k: abs(r) for k in x if np.ptp(x[k]) and np.ptp(y) and causal.fisher_z_p(r := corr(k, ()), len(y), 0) <= alpha}
    last = {k: (corr(k, ()), 0) for k in strong}
    for size in (1, 2, 3, None):
        before = dict(strong)
        for key in before:
            rivals = sorted((k for k in before if k != key), key=lambda k: (-before[k], k))[:6]
            for given in itertools.combinations(rivals, len(rivals) if size is None else size):
                if (r := corr(key, given)) is not None:
                    strong[key], last[key] = abs(r), (r, len(given))
                    if causal.fisher_z_p(r, len(y), len(given)) > alpha:
                        del strong[key]
                        break
    return {k: last[k] for k in strong}


def test_causal_discovery(spark):
    assert causal.fisher_z_p(0, 103, 0) == 1 and causal.fisher_z_p(0.1, 103, 0) == pytest.approx(0.3157, abs=1e-3) and causal.fisher_z_p(0.99, 5, 3) == 1
    assert causal.fisher_z_p(causal.least_correlation(50, 0.05), 50, 0) == pytest.approx(0.05) and causal.least_correlation(3, 0.05) > 1
    rng = np.random.default_rng(11)
    n = 240
    s = {k: rng.integers(0, 9, n) for k in "acdg"}
    s["b"] = np.concatenate(([0, 0], 3 * s["a"][:-2])) + rng.integers(0, 3, n)  # a drives b, b drives e: a only through b
    s["e"] = np.concatenate(([0], s["b"][:-1])) + rng.integers(0, 9, n)
    s["twin"], s["still"] = s["a"].copy(), np.full(n, 4)
    rows = [(k, i, int(v)) for k, x in s.items() for i, v in enumerate(x) if v or rng.random() < 0.5] + [("a", None, 1), (None, 3, 1)]
    pairs = [(x, y) for x in s for y in s if x != y] + [("a", "a"), ("a", "b")]
    df, who = spark.createDataFrame(rows, "node string, bucket long, n long"), spark.createDataFrame(pairs, "source string, target string")
    got = {(r["source"], r["target"]): r for r in causal.discover(df, who, 3, 0.01).collect()}
    want = {}
    for y in s:
        for (x, k), (r, size) in brute_parents(s, y, [v for v in s if v != y], 3, 0.01).items():
            if x != y and ((x, y) not in want or abs(r) > abs(want[x, y][1]) + 1e-12):
                want[x, y] = (k, r, size)
    assert set(got) == set(want) and ("b", "e") in got and ("c", "b") not in got and not any("still" in k for k in got)
    for key, (k, r, size) in want.items():
        assert (got[key]["lag"], got[key]["conditioned"]) == (k, size) and got[key]["r"] == pytest.approx(r, abs=1e-9) and got[key]["p"] == pytest.approx(causal.fisher_z_p(r, n - 3, size), abs=1e-9)
    few = causal.discover(df, spark.createDataFrame([("a", "b"), ("c", "b")], "source string, target string"), 3, 0.01)
    assert [(r["source"], r["lag"]) for r in few.collect()] == [("a", 2)]
    said = causal.as_candidates(few, 0.01).first()
    assert said["dependency_id"] == "pc:a->b" and said["strength"] > 0.9 and "2 bucket(s) earlier" in said["rationale"]
    assert causal.discover(df.limit(0), who).count() == 0 and causal.discover(df.where("bucket < 5"), who).count() == 0 and causal.discover(df, who.limit(0)).count() == 0


def test_lagged_sums_by_the_node_that_meets_fewer(spark):
    """A hub that all nodes meet is looked up and never sent to each of them, whichever way round the pairs are."""
    rng = np.random.default_rng(3)
    x = {k: rng.integers(0, 4, 40) for k in ["hub", *(f"n{i}" for i in range(12))]}
    for v in x.values():
        v[[0, -1]] = 1  # the first and the last bucket
    pairs = [(k, "hub") for k in x] + [("hub", k) for k in x if k < "n5"]
    df = spark.createDataFrame([(k, i, int(v)) for k, s in x.items() for i, v in enumerate(s)], "node string, bucket long, n long")
    who = spark.createDataFrame(pairs, "source string, target string")
    assert {tuple(r) for r in causal.led(who.toDF("a", "b")).collect()} == {(k, "hub") for k in x if k != "hub"}
    got = {(r["source"], r["target"], r["lag"]): r["r"] for r in causal.lagged_correlations(df, who, 3).collect()}
    want = {(a, b, k): np.corrcoef(x[a][3 - k : 40 - k], x[b][3:])[0, 1] for a, b in pairs for k in (1, 2, 3)}
    assert got == pytest.approx(want, abs=1e-9)


def test_paired_widths_and_sampling_stability(spark):
    """Three units with both ends (one tie), one without; a sample with a pair that the whole doesn't have; no pairs at all."""
    rows = [("g", u, lv, v) for u, lv, v in [(1, 0, 5.0), (1, 2, 1.0), (2, 0, 3.0), (2, 2, 3.0), (3, 0, 9.0), (3, 1, 0.0), (3, 2, 2.0), (4, 1, 7.0)]]
    got = metrics.paired_widths(spark.createDataFrame(rows, "g string, u int, lv int, v double"), ["u"], "lv", "v", ["g"]).first()
    assert (got["wider"], got["ties"], got["narrower"], got["monotone"]) == (2, 1, 0, True)
    pair = "source string, target string"
    full = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], pair)
    part = spark.createDataFrame([(0.5, "a", "b"), (0.5, "a", "b"), (0.5, "x", "b")], "lv double, " + pair)
    r = metrics.sampling_stability(part, full, "lv").first()
    assert (r["edges"], r["nodes"], r["edge_jaccard"], r["node_retention"]) == (2, 3, 0.25, 0.5)
    assert metrics.sampling_stability(part.limit(0), full, "lv").isEmpty()
    assert metrics.sampling_stability(part, full.limit(0), "lv").first()["node_retention"] == 1.0


def test_generators(spark):
    assert generate.chain(spark, 4).count() == 3 and generate.tiers(spark, [2, 4, 4, 2]).count() == 32 and generate.multi_path(spark, 3).count() == 6 and generate.star(spark, 10).count() == 10
    t = generate.traffic(generate.star(spark, 6), 15, T0, 60, "gen")
    assert t.count() == 180 and t.exceptAll(generate.traffic(generate.star(spark, 6), 15, T0, 60, "gen")).isEmpty()
    edges = topology.discover_edges(flows.reconstruct_flows(t), topology.discover_nodes(t))
    assert edges.count() == 6
    views = generate.collector_views(t, 3, 0.5)
    assert 180 < views.count() < 540 and topology.dedupe_collectors(views).count() <= 180
    s = generate.sample_packets(t, 0.5).count()
    assert 60 < s < 120 and generate.ip_aliasing(t, "hub").where("src_ip like 'hub-alias%'").count() >= 0


def test_roles_held_out_equal_refitting(spark):
    """Each row by the model of the others, against models that are fitted again."""
    rng = random.Random(6)
    rows = [(i, rng.choice("ab"), rng.gauss(0, 1), rng.gauss(5, 2), rng.random() < 0.5) for i in range(30)] + [(99, "alone", 9.0, 9.0, True)]
    rows = [(i, r, x + (2 if r == "a" else 0), y, b) for i, r, x, y, b in rows]
    kind = "id long, role string, x double, y double, b boolean"
    got = {r["id"]: (r["truth"], r["role"], r["p"], r["seen"]) for r in roles.held_out(spark.createDataFrame(rows, kind), "id", ["x", "y"], ["b"]).collect()}
    assert len(got) == 31 and got[99][3] is False
    for i, role, x, y, b in rows:
        rest = [r for r in rows if r[0] != i]
        lp = {}
        for name in {r[1] for r in rest}:
            mine = [r for r in rest if r[1] == name]
            value = math.log(len(mine) / len(rest))
            for k, v in ((2, x), (3, y)):
                xs = np.array([r[k] for r in mine])
                var = max(xs.var(), 1e-6)
                value -= 0.5 * (math.log(2 * math.pi * var) + (v - xs.mean()) ** 2 / var)
            rate = (sum(r[4] for r in mine) + 1) / (len(mine) + 2)
            lp[name] = value + math.log(rate if b else 1 - rate)
        best = max(lp, key=lp.get)
        assert got[i][:2] == (role, best) and got[i][2] == pytest.approx(1 / sum(math.exp(v - lp[best]) for v in lp.values()), abs=1e-6)
    assert roles.held_out(spark.createDataFrame(rows[:1], kind), "id", ["x", "y"], ["b"]).count() == 0


def test_paired_interval_covers_the_mean(spark):
    """Of 200 experiments nine in ten intervals or more hold the true difference; quantiles and detectable difference by hand."""
    rng = random.Random(7)
    rows = [(e, k, c, rng.gauss(10, 3) + (1.5 if c == "new" else 0)) for e in range(200) for k in range(25) for c in ("old", "new")]
    rows += [(900, k, "old", 1.0) for k in range(5)] + [(901, k, c, 2.0) for k in range(4) for c in ("old", "new")] + [(902, k, c, float(k)) for k in range(2) for c in ("old", "new")]
    got = {r["e"]: r for r in metrics.paired_interval(spark.createDataFrame(rows, "e long, k long, c string, v double"), "v", "c", "old", "new", ["k"], ["e"]).collect()}
    inside = sum(got[e]["low"] <= 1.5 <= got[e]["high"] for e in range(200))
    assert 176 <= inside < 200
    assert (got[900]["n"], got[900]["dropped"], got[900]["verdict"]) == (0, 5, "insufficient_n") and got[901]["verdict"] == "identical" and got[902]["verdict"] == "insufficient_n" and got[901]["low"] is None
    assert metrics.student_quantile(0.975, 24) == pytest.approx(2.063899, abs=1e-5) and metrics.student_quantile(0.8, 24) == pytest.approx(0.856855, abs=1e-5) and metrics.student_quantile(0.975, 1) == pytest.approx(12.7062, abs=1e-3) and metrics.student_quantile(0.2, 7) == -metrics.student_quantile(0.8, 7)
    r = got[3]
    assert r["mde"] == pytest.approx((2.063899 + 0.856855) * r["sd"] / 5, abs=1e-4)


def test_anomalies_with_drift(spark):
    """A node that rises for good has drift, one with a single burst at the end is transient, and new ports are novel."""
    kind = "capture_id string, ip string, epoch long, distinct_destinations long, mean_flow_duration_seconds double, outbound_byte_ratio double, total_byte_count long, distinct_ports array<int>, distinct_protocols array<string>"
    row = lambda ip, e, n, port=80: ("c", ip, e, 2, 1.0, 0.5, n, [port], ["TCP"])
    old = [row(ip, e, 100 + e % 3) for ip in ("up", "burst", "calm") for e in range(8)]
    new = [row("up", e, 400) for e in range(8, 14)] + [row("burst", e, 101) for e in range(8, 13)] + [row("burst", 13, 110, 4444)] + [row("calm", e, 101) for e in range(8, 14)]
    history, later = spark.createDataFrame(old, kind), spark.createDataFrame(new, kind)
    found = behavior.anomalies_with_drift(behavior.baseline(history), later, history=history).collect()
    assert {(r["ip"], r["dimension"], r["class"]) for r in found} == {("up", "total_byte_count", "concept_drift"), ("burst", "total_byte_count", "transient_anomaly"), ("burst", "port", "transient_anomaly")}
    assert {r["epoch"] for r in found} == {13} and [r["novel"] for r in found if r["dimension"] == "port"] == [["4444"]]


def test_repair_of_a_graph(spark):
    """h fails. In fact a, b, c, d stayed together: {c, d} is bridged to {a, b}, {x} was stranded in fact, and y of the main part was too."""
    pairs = [("a", "h"), ("a", "b"), ("b", "y"), ("c", "d"), ("d", "h"), ("h", "x"), ("p", "q")]
    edges = spark.createDataFrame([(*p, 0.9) for p in pairs], "source string, target string, confidence double")
    actual = spark.createDataFrame([(n,) for n in "abcdh"], "node string")
    bridges = graph.repair_bridges(edges, "h", actual)
    assert [tuple(r) for r in bridges.collect()] == [("a", "d", 2, 1)]
    assert graph.repair_bridges(graph.repaired(edges, bridges), "h", actual).count() == 0
    assert [tuple(r) for r in graph.repair_bridges(edges, "h", spark.createDataFrame([(n,) for n in "abypq"], "node string")).collect()] == [("a", "p", 2, 0)]


def test_flows_of_changes(spark):
    """Intervals are open on the left; a flow after the last snapshot has none; uneven snapshots; a change without flows keeps its row."""
    snapshots = spark.createDataFrame([(0, 100), (1, 110), (2, 500)], "version long, captured_us long")
    rows = [(1, "a", "b", 100), (2, "b", "a", 101), (3, "a", "b", 110), (4, "a", "b", 499), (5, "a", "b", 501), (6, "a", "c", 300), (7, "a", "b", -5000)]
    flows_ = spark.createDataFrame(rows, "flow_id long, src_ip string, dst_ip string, first_us long")
    got = {r["flow_id"]: r["version"] for r in history.versions_of_flows(flows_, snapshots).collect()}
    assert got == {1: 0, 7: 0, 2: 1, 3: 1, 4: 2, 6: 2}
    changes = spark.createDataFrame([(1, "a", "b", "edge_added"), (2, "c", "a", "edge_added"), (2, "x", "y", "edge_removed")], "to_version long, source string, target string, change string")
    assert {(r["to_version"], r["source"], r["flow_id"]) for r in history.flows_of_changes(changes, flows_, snapshots).collect()} == {(1, "a", 2), (1, "a", 3), (2, "c", 6), (2, "x", None)}
    assert history.versions_of_flows(flows_, snapshots.limit(0)).count() == 0


def reports(spark, rows):
    """rows (collector, microseconds, destination)."""
    kind = "capture_id string, packet_seq long, us long, collector string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, size_bytes long, tcp_flags string"
    df = spark.createDataFrame([("c", i, T0 + us, who, "a", dst, None, 53, "UDP", 90, None) for i, (who, us, dst) in enumerate(rows)], kind)
    return df.withColumn("ts", F.timestamp_micros("us")).drop("us")


def brute_claims(rows, tolerance):
    """One list of packets for each identity, searched as a whole for every report."""
    known, kept = {}, []
    for who, us, dst in sorted(rows, key=lambda r: (r[1], r[0])):
        free = [e for e in known.setdefault(dst, []) if who not in e[1] and us - e[0] <= tolerance]
        if free:
            min(free, key=lambda e: us - e[0])[1].add(who)
        else:
            known[dst].append((us, {who}))
            kept.append((us, dst))
    return sorted(kept)


def test_collectors_claim_the_nearest_packet(spark):
    """x missed the first of two packets: the i-th of x isn't the i-th of y, and its report at 900 goes with y's at 880."""
    rows = [("y", 0, "b"), ("y", 880, "b"), ("x", 900, "b"), ("x", 1300, "b")]
    got = sorted((r["packet_seq"] for r in topology.dedupe_collectors(reports(spark, rows)).collect()))
    assert got == [0, 1, 3]  # by order 900 would go with 0 and 1300 with 880, which leaves two packets
    rng = random.Random(3)
    many = [(rng.choice("xyz"), rng.randint(0, 30_000), rng.choice("bcd")) for _ in range(600)]
    many = list(dict.fromkeys(many))
    out = topology.dedupe_collectors(reports(spark, many).repartition(5)).collect()
    assert sorted((int(r["ts"].timestamp() * 1e6 + 0.5) - T0, r["dst_ip"]) for r in out) == brute_claims(many, 1000)
    assert topology.dedupe_collectors(reports(spark, rows).limit(0)).count() == 0


def test_pair_features_against_sets(spark):
    """Hubs of both sizes, triangles and a node that is its own neighbour; no path over a hub is made: links go up in degree."""
    edges = sorted({(f"n{i}", f"n{(i * i + 3 * k) % 23}") for i in range(40) for k in (1, 2, 5)} | {("hub", f"n{i}") for i in range(30)} | {("n1", "n2"), ("n2", "n3"), ("n1", "n3")})
    seen, rows = set(), []
    for a, b in edges:
        if (b, a) not in seen:
            seen.add((a, b))
            rows.append((a, b, 3, 0.5, a + b))
    near = {}
    for a, b in seen:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    df = spark.createDataFrame(rows, "source string, target string, observation_count long, bidirectional double, tag string")
    got = learned.pair_features(df).collect()
    assert len(got) == len(rows)
    for r in got:
        a, b = r["source"], r["target"]
        assert r["tag"] == a + b and r["log_degree_a"] == pytest.approx(math.log1p(len(near[a]))) and r["common"] == pytest.approx(math.log1p(len(near[a] & near[b]))), (a, b)
        assert r["near_b"] == pytest.approx(sum(math.log1p(len(near[x])) for x in near[b]) / len(near[b]))


def test_temporal_precedence_of_hubs_against_rows(spark, monkeypatch):
    """Both ends lead, series of different lengths, times dealt out over several keys, and times with a weight."""
    monkeypatch.setattr(dependency, "DEALT", 40)
    rng, width = random.Random(5), 10_000_000
    times = [(f"u{i}", T0 + rng.randrange(40 + 20 * i) * 3_000_000) for i in range(7) for _ in range(12)] + [(h, T0 + rng.randrange(30) * 7_000_000) for h in ("a", "z") for _ in range(60)]
    pairs = [(h, f"u{i}") if h < "u" else (f"u{i}", h) for i in range(7) for h in ("a", "z")] + [("a", "z")]
    per = collections.defaultdict(list)
    for node, us in times:
        per[node].append(us)
    want = {}
    for s, t in pairs:
        start = min(per[s] + per[t])
        size = (max(per[s] + per[t]) - start) // width + 1
        x, y = (np.bincount([(us - start) // width for us in per[k]], minlength=size).astype(float) for k in (s, t))
        r = [np.corrcoef(x[: size - k], y[k:])[0, 1] if size - k >= 2 and x[: size - k].std() > 0 and y[k:].std() > 0 else 0.0 for k in range(6)]
        want[s, t] = min(1.0, max(r[1:])) if max(r[1:]) > max(r[0], 0) else 0.0
    p = spark.createDataFrame(pairs, "source string, target string")
    df = spark.createDataFrame(times, "node string, us long")
    for rows in (df, df.groupBy("node", "us").agg(F.count(F.lit(1)).alias("w"))):
        got = {(r["source"], r["target"]): r["precedence"] for r in dependency.temporal_precedence(p, rows).collect()}
        assert got == pytest.approx(want) and len({*got.values()}) > 5


def test_diversity_sends_flows_once(spark):
    """Null ports are a value, null destinations aren't, a null source has no flow; nothing is written and read again, and flows meet no table of sources."""
    rows = [("s", "a", 1), ("s", "a", 2), ("s", "b", 2), ("s", "c", None), ("s", "c", None), ("t", "a", None), ("t", None, 9), ("u", None, 7), (None, "a", 1)]
    df = spark.createDataFrame([("x", *r) for r in rows], "capture_id string, src_ip string, dst_ip string, dst_port int")
    got = sorted(tuple(r)[1:] for r in flows.with_diversity(df).where("dst_ip is not null or src_ip <> 's'").distinct().select("capture_id", "src_ip", "destination_diversity", "port_diversity").distinct().collect())
    assert got == [("s", 3, 3), ("t", 1, 2), ("u", 0, 1)]
    f = flows.reconstruct_flows(packets(spark, [(0.0, "A", "B", 1, 2, "UDP", 10, None), (1.0, "A", "C", 1, 2, "UDP", 10, None)]))
    assert not f.inputFiles() and "Join" not in f._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["destination_diversity"], r["port_diversity"]) for r in f.collect()} == {(2, 1)}


def test_added_edges_and_counted_flows(spark):
    """As timeline() and flows_of_changes() say, with gaps between versions, repeated rows, edges of the first version, null keys and flows of either direction."""
    rng = random.Random(6)
    pairs = [(rng.choice((0, 1, 2, 5, 6)), rng.choice("abc"), rng.choice(("a", "b", "x", "y", None))) for _ in range(40)]
    df = spark.createDataFrame([*pairs, pairs[0]], "version long, source string, target string")
    want = sorted(tuple(map(str, r)) for r in history.timeline(df.distinct(), ["source", "target"], []).where("change = 'edge_added'").select("to_version", "source", "target").collect())
    added = history.added_edges(df, ["source", "target"])
    assert sorted(tuple(map(str, r)) for r in added.collect()) == want and want
    assert history.added_edges(df.limit(0), ["source", "target"]).count() == 0
    flows_ = spark.createDataFrame([(i % 70, *rng.sample("abxy", 2), rng.randint(0, 80)) for i in range(90)], "flow_id long, src_ip string, dst_ip string, first_us long")
    snapshots = spark.createDataFrame([(v, (v + 1) * 10) for v in (0, 1, 2, 5, 6)], "version long, captured_us long")
    rows = history.flows_of_changes(added, flows_, snapshots).groupBy("to_version", "source", "target").agg(F.count("flow_id"), F.min("flow_id"), F.max("flow_id")).collect()
    got = history.counted_flows_of_changes(added, flows_, snapshots).select("to_version", "source", "target", "flows", "first_flow", "last_flow").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, rows))) and any(r["flows"] for r in got) and not all(r["flows"] for r in got)
