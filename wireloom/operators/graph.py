"""Graph algorithms as joins: every scenario of a sweep, and every source of a search, goes through the same job.

Edges are undirected rows (source, target, confidence); loops are ignored.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wireloom.functions.expressions import edge_weight
from wireloom.functions.ranking import ranked
from wireloom.operators import biconnected
from wireloom.operators.components import connected_components
from wireloom.operators.dependency import propagate_failure
from wireloom.session import cut

SEPARATOR = "\x1f"
#: Levels of a search after which their union is written, so that its plan doesn't grow with the depth.
PLAN_STEPS = 16
#: Numbers of 64 bits in a row of distances().
WORDS = 16


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, confidence) in both directions."""
    e = edges.where("source <> target")
    return e.select(F.col("source").alias("a"), F.col("target").alias("b"), "confidence").unionByName(e.select(F.col("target").alias("a"), F.col("source").alias("b"), "confidence"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(node, degree, centrality, mean_confidence): neighbours, their share of the other nodes, and the mean over incident edges."""
    per = both_ways(edges).groupBy("a").agg(F.count_distinct("b").alias("degree"), F.avg("confidence").alias("mean_confidence"))
    per = per.join(F.broadcast(per.agg(F.count(F.lit(1)).alias("_nodes"))), F.lit(True))
    n = F.col("_nodes")
    return per.select(F.col("a").alias("node"), "degree", F.when(n > 1, F.col("degree") / (n - 1)).otherwise(0.0).alias("centrality"), "mean_confidence")


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): component is its smallest node."""
    found = connected_components(edges.select(F.col("source").alias("u"), F.col("target").alias("v")))
    if nodes is None:
        return found
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def node_failures(edges: DataFrame) -> DataFrame:
    """(scenario, failed, node): the other nodes of a graph, for the failure of each."""
    n = nodes_of(edges)
    return n.select(F.col("node").alias("failed")).join(n, F.col("failed") != F.col("node")).select(F.concat(F.lit("node:"), "failed").alias("scenario"), "failed", "node")


def failed_components(edges: DataFrame, failed: DataFrame) -> DataFrame:
    """(failed, node, component, size) of the graph without each node of failed(failed), from one search of the whole graph."""
    return biconnected.Failures(edges, failed).components().drop("best")


def newly_unreachable(edges: DataFrame, failed: DataFrame) -> DataFrame:
    """(failed, node): nodes outside the largest component (ties: the one with the smallest first node) of the graph without each node of failed(failed)."""
    return biconnected.Failures(edges, failed).components().where("component <> best").select("failed", "node")


def largest(components_: DataFrame, scenario: str = "failed") -> DataFrame:
    """(scenario, component) of the largest component, ties to the one with the smallest first node."""
    per = components_.groupBy(scenario, "component").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(scenario).agg(F.min(F.struct((-F.col("n")).alias("_n"), "component")).alias("_t")).select(scenario, F.col("_t.component").alias("component"), (-F.col("_t._n")).alias("size"))


def criticality(edges: DataFrame) -> DataFrame:
    """(node, articulation, impact): whether removing a node splits its component, and how many nodes then lie outside the largest one."""
    f = biconnected.failures(edges).where("kind = 'node'")
    return f.select(F.col("source").alias("node"), (F.col("pieces") > 1).alias("articulation"), (F.col("left") - F.col("largest")).alias("impact"))


def root_causes(edges: DataFrame, failed: str, top: int = 50) -> DataFrame:
    """(node, prevented, score, collateral, rank): whose single removal strands the most of the nodes that failed's removal strands."""
    nodes = nodes_of(edges).select(F.col("node").alias("failed"))
    after = cut(failed_components(edges, nodes), "failures")
    best = largest(after).select("failed", F.col("component").alias("_best"))
    stranded = after.join(best, "failed").where("component <> _best").select("failed", "node")
    target = stranded.where(F.col("failed") == failed).select("node")
    hits = stranded.join(target.withColumn("_hit", F.lit(1)), "node", "left").groupBy("failed").agg(F.sum(F.coalesce("_hit", F.lit(0))).alias("prevented"), F.sum(F.when(F.col("_hit").isNull(), 1).otherwise(0)).alias("collateral"))
    total = target.agg(F.count(F.lit(1)).alias("_total"))
    scored = hits.join(F.broadcast(total), F.lit(True)).withColumn("score", F.coalesce(F.try_divide("prevented", "_total"), F.lit(0.0)))
    w = Window.orderBy(F.col("score").desc(), "collateral", "failed")
    return scored.orderBy(F.col("score").desc(), "collateral", "failed").limit(top).withColumn("rank", F.row_number().over(w)).select(F.col("failed").alias("node"), "prevented", "score", "collateral", "rank")


def hops(edges: DataFrame, sources: DataFrame, depth: int | None = None) -> DataFrame:
    """(start, node, hop, paths): breadth-first distance from every start of sources(start), and the number of shortest paths; of all nodes that can be reached, or down to depth hops."""
    e = cut(both_ways(edges).select("a", "b").distinct(), "links")
    front = sources.select("start", F.col("start").alias("node"), F.lit(0).alias("hop"), F.lit(1).cast("double").alias("paths"))
    seen = cut(front, "hops")
    front = seen
    for hop in count(1) if depth is None else range(1, depth + 1):
        step = front.join(e, F.col("node") == F.col("a")).groupBy("start", F.col("b").alias("node")).agg(F.sum("paths").alias("paths"))
        step = cut(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").select("start", "node", F.lit(hop).alias("hop"), "paths"), "hops")
        if step.isEmpty():
            break
        seen, front = seen.unionByName(step), step
        if hop % PLAN_STEPS == 0:
            seen = cut(seen, "hops")
    return seen


def distances(edges: DataFrame, sources: DataFrame, depth: int | None = None) -> DataFrame:
    """(start, node, hop): hops() of distinct starts without the number of paths, the starts 1,024 at a time.

    A row of a level says of a node which of the starts of a block reach it there, as bits of
    WORDS numbers. Starts of one component go together, so that few bits are empty. A neighbour
    of a level's node lies in that level, the one before or the next, so a new level is held
    against two others only, in the aggregate that makes it.
    """
    words = [f"w{k}" for k in range(WORDS)]
    e = cut(both_ways(edges).select("a", "b").distinct(), "links")
    where = components(edges).select(F.col("node").alias("start"), "component")
    starts = sources.select("start").where("start is not null").distinct().join(where, "start", "left").select("start", F.struct("component", "start").alias("_by"), F.lit(0).alias("_all"))
    placed = cut(ranked(starts, "_all", [F.col("_by")], "_rank").select("start", F.floor(F.col("_rank") / (64 * WORDS)).alias("block"), (F.col("_rank") % (64 * WORDS)).cast("int").alias("bit")), "starts")
    bit = lambda k: F.when(F.floor(F.col("bit") / 64) == k, F.expr("shiftleft(1L, bit % 64)")).otherwise(F.lit(0).cast("long"))
    level = cut(placed.select(F.col("start").alias("node"), "block", *[bit(k).alias(w) for k, w in enumerate(words)], F.lit(0).alias("hop")), "level")
    levels = [level]
    for hop in count(1) if depth is None else range(1, depth + 1):
        step = levels[-1].join(e, F.col("node") == F.col("a")).select(F.col("b").alias("node"), "block", *words, F.lit(True).alias("_new"))
        for old in levels[-2:]:
            step = step.unionByName(old.select("node", "block", *words, F.lit(False).alias("_new")))
        of = lambda w, new: F.coalesce(F.bit_or(F.when(F.col("_new") == new, F.col(w))), F.lit(0).cast("long"))
        step = step.groupBy("node", "block").agg(*[of(w, True).bitwiseAND(F.bitwise_not(of(w, False))).alias(w) for w in words])
        level = cut(step.where(" or ".join(f"{w} <> 0" for w in words)).select("node", "block", *words, F.lit(hop).alias("hop")), "level")
        if level.isEmpty():
            break
        levels.append(level)
    found = levels[0].sparkSession.read.schema(level.schema).parquet(*[x._wireloom_path for x in levels])
    names = placed.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bit", "start"))).alias("starts"))  # 64 * WORDS at most
    part = lambda k: F.filter("starts", lambda x: F.floor(x["bit"] / 64) == k)
    here = lambda k, w: F.when(F.col(w) == 0, F.slice(f"s{k}", 1, 0)).otherwise(F.filter(f"s{k}", lambda x: F.getbit(w, x["bit"] % 64) == 1))["start"]
    names = names.select("block", *[part(k).alias(f"s{k}") for k in range(WORDS)])
    return found.join(names, "block").select(F.explode(F.concat(*[here(k, w) for k, w in enumerate(words)])).alias("start"), "node", "hop")


def betweenness(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, betweenness), normalised for an undirected graph: shortest-path counts outwards by level, dependencies back inwards by level."""
    nodes = nodes_of(edges)
    seen = cut(hops(edges, nodes.select(F.col("node").alias("start")), depth), "hops")
    e = cut(both_ways(edges).select("a", "b").distinct(), "links")
    deepest = seen.agg(F.max("hop")).first()[0] or 0
    delta = seen.where(F.col("hop") == deepest).select("start", "node", "hop", "paths", F.lit(0.0).alias("delta"))
    total = delta
    for hop in range(deepest, 1, -1):
        give = delta.select("start", F.col("node").alias("w"), F.col("paths").alias("_pw"), "delta").join(e, F.col("w") == F.col("b"))
        upper = seen.where(F.col("hop") == hop - 1)
        got = upper.join(give.select("start", F.col("a").alias("node"), "_pw", F.col("delta").alias("_dw")), ["start", "node"], "left").groupBy("start", "node", "hop", "paths").agg(F.coalesce(F.sum(F.col("paths") / F.col("_pw") * (1 + F.col("_dw"))), F.lit(0.0)).alias("delta"))
        delta = cut(got, "deltas")
        total = total.unionByName(delta)
        if hop % PLAN_STEPS == 0:
            total = cut(total, "deltas")
    n = nodes.count()
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    sums = total.where("hop > 0").groupBy("node").agg((F.sum("delta") * scale).alias("betweenness"))
    return nodes.join(sums, "node", "left").select("node", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def shortest_paths(edges: DataFrame, sources: DataFrame, weight: Column | None = None, rounds: int | None = None) -> DataFrame:
    """(start, node, cost, path): cheapest path from every start; among equal costs the lexicographically first path.

    Relaxation by rounds: only nodes whose cost fell in the last round send offers. It goes on until no cost
    falls, or for the given number of rounds. Offers are simple paths, so it ends.
    """
    e = cut(both_ways(edges).withColumn("w", weight if weight is not None else edge_weight(F.col("confidence"))).groupBy("a", "b").agg(F.min("w").alias("w")), "links")
    best = cut(sources.select("start", F.col("start").alias("node"), F.lit(0.0).alias("cost"), F.col("start").alias("path")), "costs")
    front = best
    for _ in count() if rounds is None else range(rounds):
        offers = front.join(e, F.col("node") == F.col("a")).where(~F.array_contains(F.split("path", SEPARATOR), F.col("b"))).select("start", F.col("b").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.concat_ws(SEPARATOR, "path", "b").alias("path"))
        top = best.withColumn("_old", F.lit(0)).unionByName(offers.withColumn("_old", F.lit(1))).groupBy("start", "node").agg(F.min(F.struct("cost", "path", "_old")).alias("_t"))
        after = cut(top.select("start", "node", "_t.cost", "_t.path", "_t._old"), "costs")
        front = after.where("_old = 1").drop("_old")
        best = after.drop("_old")
        if front.isEmpty():
            break
    return best


def alternate_paths(edges: DataFrame, source: str, target: str, k: int = 5, max_hops: int | None = None) -> DataFrame:
    """(rank, cost, path): the k cheapest simple paths, of any number of edges or of at most max_hops.

    Paths grow edge by edge. One whose cost and cheapest way on to the target come to more
    than the k-th best path found so far is given up, so the search ends by itself.
    """
    e = cut(both_ways(edges).withColumn("w", edge_weight(F.col("confidence"))).groupBy("a", "b").agg(F.min("w").alias("w")), "links")
    start = edges.sparkSession.createDataFrame([(source, 0.0, source)], "node string, cost double, path string")
    ahead = cut(shortest_paths(edges, start.select(F.lit(target).alias("start"))).select(F.col("node").alias("_to"), F.col("cost").alias("_ahead")), "ahead")
    paths, done = start, cut(start.where("1 = 0"), "paths")
    worst = None
    for _ in count() if max_hops is None else range(max_hops):
        step = paths.join(e, F.col("node") == F.col("a")).where(~F.array_contains(F.split("path", SEPARATOR), F.col("b"))).select(F.col("b").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.concat_ws(SEPARATOR, "path", "b").alias("path"))
        step = step.join(ahead, F.col("node") == F.col("_to"))  # nodes that don't reach the target drop out
        if worst is not None:
            step = step.where(F.col("cost") + F.col("_ahead") <= worst + 1e-9)
        step = cut(step.drop("_to", "_ahead"), "paths")
        if step.isEmpty():
            break
        done = cut(done.unionByName(step.where(F.col("node") == target)).orderBy("cost", "path").limit(k), "paths")
        found = done.agg(F.count(F.lit(1)), F.max("cost")).first()
        worst = found[1] if found[0] == k else None
        paths = step.where(F.col("node") != target)
    w = Window.orderBy("cost", "path")
    return done.orderBy("cost", "path").limit(k).withColumn("rank", F.row_number().over(w)).select("rank", "cost", "path")


def inject_failures(edges: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(scenario, source, target, confidence, cost): each scenario's graph.

    scenarios: scenario, kind (node, edge, latency, loss, bandwidth), node or source and target, magnitude. Node and
    edge failures take edges out; the others raise their cost: latency/100, -ln(1-loss), -ln(1-reduction).
    """
    both = scenarios.select("scenario", "kind", "node", F.col("source").alias("_s"), F.col("target").alias("_t"), "magnitude").join(edges, F.lit(True))
    hit_edge = (F.col("source") == F.least("_s", "_t")) & (F.col("target") == F.greatest("_s", "_t")) | (F.col("source") == F.col("_s")) & (F.col("target") == F.col("_t"))
    hit = F.coalesce(F.when(F.col("node").isNotNull(), (F.col("source") == F.col("node")) | (F.col("target") == F.col("node"))).otherwise(hit_edge), F.lit(False))
    extra = F.when(F.col("kind") == "latency", F.col("magnitude") / 100).when(F.col("kind").isin("loss", "bandwidth"), -F.log(F.greatest(1 - F.col("magnitude"), F.lit(1e-9)))).otherwise(0.0)
    kept = both.where(~(hit & F.col("kind").isin("node", "edge")))
    return kept.select("scenario", "source", "target", "confidence", (edge_weight(F.col("confidence")) + F.when(hit, extra).otherwise(0.0)).alias("cost"))


def counterfactual(edges: DataFrame, action: str, source: str | None = None, target: str | None = None, confidence: float = 0.5) -> DataFrame:
    """The graph after an action: remove_node(source), remove_edge, add_route, or an action that leaves the graph as it is."""
    pair = (F.col("source") == F.least(F.lit(source), F.lit(target))) & (F.col("target") == F.greatest(F.lit(source), F.lit(target)))
    if action == "remove_node":
        return edges.where((F.col("source") != source) & (F.col("target") != source))
    if action == "remove_edge":
        return edges.where(~pair)
    if action == "add_route":
        row = edges.sparkSession.range(1).select(F.least(F.lit(source), F.lit(target)).alias("source"), F.greatest(F.lit(source), F.lit(target)).alias("target"), F.lit(confidence).alias("confidence"))
        return edges.select("source", "target", "confidence").where(~pair).unionByName(row)
    return edges


def repair_bridges(edges: DataFrame, failed: str, actual: DataFrame) -> DataFrame:
    """(source, target, size, overlooked): edges that the graph must lack, as actual(node) stayed one component when failed failed.

    Of the components that the graph falls into, the one that has most of actual (ties: the
    larger, then the smaller id) is the main one. Any other that lies in actual as a whole
    is bridged to it, at the nodes that were next to failed, or the first ones where none
    was; size is the number of its nodes. overlooked counts nodes of the main one that
    were stranded in fact, which no edge can mend. No rows: the graph agrees.
    """
    near = both_ways(edges).where(F.col("a") == failed).select(F.col("b").alias("node"), F.lit(True).alias("_near")).distinct()
    real = actual.select("node").distinct().where(F.col("node") != failed).withColumn("_real", F.lit(True))
    left = components(counterfactual(edges, "remove_node", failed), nodes_of(edges).where(F.col("node") != failed))
    parts = cut(left.join(near, "node", "left").join(real, "node", "left"), "parts")
    per = parts.groupBy("component").agg(F.count(F.lit(1)).alias("_n"), F.count("_real").alias("_in"), F.coalesce(F.min(F.when(F.col("_near"), F.col("node"))), F.min("node")).alias("_at"))
    main = per.orderBy(F.desc("_in"), F.desc("_n"), "component").limit(1).select(F.col("component").alias("_main"), F.col("_at").alias("_to"), (F.col("_n") - F.col("_in")).alias("overlooked"))
    others = per.join(F.broadcast(main), F.lit(True)).where("component <> _main and _in = _n")  # main is one row
    return others.select(F.least("_at", "_to").alias("source"), F.greatest("_at", "_to").alias("target"), F.col("_n").alias("size"), "overlooked")


def repaired(edges: DataFrame, bridges: DataFrame, confidence: float = 0.5) -> DataFrame:
    """The graph with the bridges added."""
    return edges.select("source", "target", "confidence").unionByName(bridges.select("source", "target", F.lit(confidence).alias("confidence")))


def resilience(edges: DataFrame, failed: DataFrame) -> DataFrame:
    """(failed, connectivity_ratio, reachable_ratio, stranded): size of the largest component, and nodes in components of two or more, as shares of the nodes before."""
    f = biconnected.Failures(edges, failed).scenarios
    return f.select("failed", (F.col("top") / F.col("nodes")).alias("connectivity_ratio"), ((F.col("left") - F.col("alone")) / F.col("nodes")).alias("reachable_ratio"), (F.col("left") - F.col("top")).alias("stranded"))


def resilience_indicators(edges: DataFrame, failed: DataFrame, candidates: DataFrame) -> DataFrame:
    """The six indicators of each node of failed(failed), when it fails, and stranded: (failed, connectivity_ratio, reachable_ratio, affected_services, path_degradation, bottlenecks, alternative_path, stranded).

    connectivity_ratio: the largest component's size by that of the largest before. reachable_ratio: the share of the nodes
    before in components of two or more. affected_services: nodes that the failure reaches along candidates(source,
    target) in two hops, itself included, or that fall off the largest component. path_degradation: of the routes
    between the failed node and each of its neighbours, what their cost rose by; as a node that is gone has no route,
    each costs as much as an edge of the least confidence. bottlenecks: sorted, the nodes that are cut nodes now and
    weren't before. alternative_path: whether a pair of those that is still joined has two routes; none is joined.
    """
    f = biconnected.Failures(edges, failed)
    one, zero = F.lit(1.0), F.lit(0).cast("long")
    who = f.scenarios.select("failed")
    reached = propagate_failure(candidates, who.select(F.col("failed").alias("scenario"), F.col("failed").alias("node"))).select(F.col("scenario").alias("failed"), "node")
    reached = cut(reached.distinct(), "reached")
    hit = reached.groupBy("failed").agg(F.count(F.lit(1)).alias("_hit"))
    both = f.of(reached).where("unreachable").groupBy("failed").agg(F.count(F.lit(1)).alias("_both"))
    routes = both_ways(edges.select("source", "target", F.lit(None).alias("confidence"))).select(F.col("a").alias("failed"), "b").distinct().join(who, "failed").groupBy("failed").agg(F.count(F.lit(1)).alias("_routes"))
    neck = f.emerging().groupBy("failed").agg(F.sort_array(F.collect_list("node")).alias("_necks"))
    out = f.scenarios
    for part in (f.unreachable(), hit, both, routes, neck):
        out = out.join(part, "failed", "left")
    before = F.lit(f.first["all"] if f.first else None).cast("long")
    return out.select(
        "failed", F.coalesce(F.coalesce("top", zero) / before, one).alias("connectivity_ratio"), F.coalesce(F.try_divide(F.col("left") - F.col("alone"), F.col("nodes")), one).alias("reachable_ratio"),
        (F.col("unreachable") + F.coalesce("_hit", zero) - F.coalesce("_both", zero)).alias("affected_services"), (F.coalesce("_routes", zero) * edge_weight(F.lit(0.0))).alias("path_degradation"),
        F.coalesce("_necks", F.array().cast(neck.schema["_necks"].dataType)).alias("bottlenecks"), F.lit(False).alias("alternative_path"), (F.col("left") - F.coalesce("top", zero)).alias("stranded"),
    )


def recommendations(critical: DataFrame, between: DataFrame) -> DataFrame:
    """(rank, node, reason): articulation points by impact, then other nodes above the mean betweenness."""
    both = critical.join(between, "node")
    mean = F.avg("betweenness").over(Window.partitionBy(F.lit(0)))
    picked = both.withColumn("_mean", mean).where(F.col("articulation") | (F.col("betweenness") > F.col("_mean")))
    w = Window.orderBy(F.col("articulation").desc(), F.when(F.col("articulation"), -F.col("impact")).otherwise(0), (-F.round("betweenness", 9)), "node")
    return picked.withColumn("rank", F.row_number().over(w)).select("rank", "node", F.when(F.col("articulation"), "articulation").otherwise("betweenness").alias("reason"))
