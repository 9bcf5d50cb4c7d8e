"""Compositions: what a failure or a change does to a graph, how predictions compare with outcomes, and small reports."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wireloom.functions.expressions import survival
from wireloom.operators import biconnected, graph, metrics
from wireloom.session import cut


def route_changes(before: DataFrame, after: DataFrame, pairs: DataFrame, rounds: int | None = None) -> DataFrame:
    """(start, node, cost_before, cost_after, changed, lost) of pairs(start, node) on two graphs."""
    starts = pairs.select("start").distinct()
    a = graph.shortest_paths(before, starts, rounds=rounds).select("start", "node", F.col("cost").alias("cost_before"), F.col("path").alias("_a"))
    b = graph.shortest_paths(after, starts, rounds=rounds).select("start", "node", F.col("cost").alias("cost_after"), F.col("path").alias("_b"))
    out = pairs.join(a, ["start", "node"], "left").join(b, ["start", "node"], "left")
    return out.select("start", "node", "cost_before", "cost_after", (~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"), (F.col("_a").isNotNull() & F.col("_b").isNull()).alias("lost"))


def failure_outcomes(edges: DataFrame, failed: DataFrame) -> DataFrame:
    """(failed, stranded, share, articulation) of every node of failed(failed): nodes left outside the largest component, also as a share of all, and whether the graph falls apart."""
    f = biconnected.Failures(edges, failed).scenarios
    stranded = F.col("left") - F.col("top")
    return f.select("failed", stranded.alias("stranded"), (stranded / F.col("nodes")).alias("share"), F.col("apart").alias("articulation"))


def failure_targets(critical: DataFrame, degrees: DataFrame, k: int) -> DataFrame:
    """(rank, node): one node (the first by name) for each structural signature (articulation, impact, degree), then the k most critical signatures."""
    both = critical.join(degrees.select("node", "degree"), "node")
    one = both.groupBy("articulation", "impact", "degree").agg(F.min("node").alias("node"))
    w = Window.orderBy(F.col("articulation").desc(), F.col("impact").desc(), F.col("degree").desc(), "node")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("rank", "node", "articulation", "impact", "degree")


def edge_survival(observed: DataFrame, completeness: float) -> DataFrame:
    """observed(source, target, n, kept) with expected, the chance 1 - (1 - c)^n that sampling keeps some of n packets, and the mean gap to what it kept."""
    e = observed.withColumn("expected", 1 - F.pow(F.lit(1 - completeness), F.col("n")))
    return e.agg(F.avg("expected").alias("expected"), F.avg((F.col("kept") > 0).cast("double")).alias("observed"), F.count(F.lit(1)).alias("edges"))


def graph_from_probabilities(edges: DataFrame, probabilities: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(source, target, confidence, synthesized): pairs at or above threshold; known edges keep their rows with the new confidence, others are made."""
    p = probabilities.where(F.col("probability") >= threshold).select("source", "target", F.col("probability").alias("confidence"))
    known = edges.select("source", "target", F.lit(False).alias("_k"))
    return p.join(known, ["source", "target"], "left").select("source", "target", "confidence", F.coalesce("_k", F.lit(True)).alias("synthesized"))


def confidence_error(candidate: DataFrame, reference: DataFrame) -> DataFrame:
    """(mae, pairs): mean difference of confidence on pairs that both graphs have."""
    both = candidate.select("source", "target", F.col("confidence").alias("_a")).join(reference.select("source", "target", F.col("confidence").alias("_b")), ["source", "target"])
    return both.agg(F.coalesce(F.avg(F.abs(F.col("_a") - F.col("_b"))), F.lit(0.0)).alias("mae"), F.count(F.lit(1)).alias("pairs"))


def compare_experiments(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field, a, b, delta) of metrics that both runs have."""
    def long(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias(name)) for f in fields])).alias("x"))
        return rows.select(*keys, "x.*").where(F.col(name).isNotNull())

    return long(a, "a").join(long(b, "b"), [*keys, "field"]).withColumn("delta", F.col("b") - F.col("a"))


def axes(spark, **values: list) -> DataFrame:  # noqa: ANN001
    """Every combination of an experiment's settings; the axes are short lists of literals."""
    out = spark.range(1).select(*[F.array(*map(F.lit, v)).alias(k) for k, v in values.items()])
    for k in values:
        out = out.withColumn(k, F.explode(k))
    return out


def select_shots(pool: DataFrame, k: int) -> DataFrame:
    """k rows of pool(id, role), going round the roles by name and through each by id."""
    nth = F.row_number().over(Window.partitionBy("role").orderBy("id"))
    return pool.withColumn("_n", nth).orderBy("_n", "role").limit(k).drop("_n")


def labeled_edge_scores(edges: DataFrame, truth: DataFrame) -> DataFrame:
    """edges(source_ips, target_ips arrays, confidence) with label: whether some declared pair truth(a, b) joins one address of each side, in either direction."""
    e = edges.withColumn("_id", F.monotonically_increasing_id())
    ends = e.select("_id", F.explode("source_ips").alias("a"), "target_ips").select("_id", "a", F.explode("target_ips").alias("b"))
    t = truth.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    hit = ends.select("_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(t, ["a", "b"], "left_semi").select("_id").distinct().withColumn("_h", F.lit(True))
    return e.join(hit, "_id", "left").withColumn("label", F.coalesce("_h", F.lit(False))).drop("_id", "_h")


def validate_prediction(predicted: DataFrame, actual: DataFrame, predicted_share: DataFrame, actual_share: DataFrame) -> DataFrame:
    """(failed, precision, recall, f1, share_error): affected nodes (failed, node) as sets per failure, and the error of the stranded share."""
    s = metrics.set_scores(predicted, actual, ["node"], ["failed"]).select("failed", "precision", "recall", "f1")
    e = predicted_share.select("failed", F.col("share").alias("_p")).join(actual_share.select("failed", F.col("share").alias("_a")), "failed", "full_outer")
    e = e.select("failed", F.abs(F.coalesce("_p", F.lit(0.0)) - F.coalesce("_a", F.lit(0.0))).alias("share_error"))
    one = F.lit(1.0)  # a failure without affected nodes on either side is matched
    return e.join(s, "failed", "left").select("failed", F.coalesce("precision", one).alias("precision"), F.coalesce("recall", one).alias("recall"), F.coalesce("f1", one).alias("f1"), "share_error")


def expected_paths(declared: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(source, target, path, hops): every simple directed path of declared(source, target), or those of up to max_hops edges; for scenario graphs, which are small."""
    step = declared.select(F.col("source").alias("_s"), F.col("target").alias("_t")).distinct()
    paths = declared.distinct().select("source", "target", F.array("source", "target").alias("path"))
    out = paths
    for _ in count() if max_hops is None else range(max_hops - 1):
        paths = paths.join(step, F.col("target") == F.col("_s")).where(~F.array_contains("path", F.col("_t"))).select("source", F.col("_t").alias("target"), F.concat("path", F.array("_t")).alias("path"))
        paths = cut(paths, "paths")
        if paths.isEmpty():
            break
        out = out.unionByName(paths)
    return out.withColumn("hops", F.size("path") - 1)


def twin(edges: DataFrame, nodes: DataFrame, fingerprints: DataFrame, dependencies: DataFrame, version: int) -> dict[str, DataFrame]:
    """The state of a network at a version: a bundle of tables."""
    return {name: df.withColumn("version", F.lit(version)) for name, df in (("edges", edges), ("nodes", nodes), ("fingerprints", fingerprints), ("dependencies", dependencies))}


def twin_equal(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> bool:
    """Whether two bundles hold the same rows, whatever their versions."""
    from wireloom.operators.history import same_rows

    return set(a) == set(b) and all(same_rows(a[k].drop("version"), b[k].drop("version")) for k in a)


def grounding_table(nodes: DataFrame, degrees: DataFrame, limit: int = 200) -> DataFrame:
    """(line): a line of text per node, best connected first, for a prompt; limit is the size of the report."""
    both = nodes.join(degrees.select("node", "degree"), "node", "left")
    return both.orderBy(F.coalesce("degree", F.lit(0)).desc(), "node").limit(limit).select(F.concat_ws(" | ", "node", F.concat(F.lit("degree "), F.coalesce("degree", F.lit(0)).cast("string"))).alias("line"))


def unsupported_numbers(texts: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, numbers): numbers in texts(id, text) that no fact (id, fact) of the same id states."""
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))
    known = facts.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list(numbers("fact")))).alias("_k"))
    said = texts.select("id", numbers("text").alias("_n")).join(known, "id", "left")
    return said.select("id", F.array_sort(F.array_except("_n", F.coalesce("_k", F.array().cast("array<string>")))).alias("numbers")).where(F.size("numbers") > 0)


def noisy_or(*terms: Column) -> Column:
    return 1 - survival(*terms)
