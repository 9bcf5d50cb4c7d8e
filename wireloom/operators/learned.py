"""Learned scores as Spark jobs: edges from neighbourhood features, and anomalies from what a node's own past predicts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wireloom.session import cut

PAIR_FEATURES = ["one", "log_degree_a", "log_degree_b", "near_a", "near_b", "common", "log_observations", "bidirectional"]


def triangles(links: DataFrame) -> DataFrame:
    """(lo, hi, n): the common neighbours of pairs that have any, from links(a, b, da, db) of a graph, a row for each link, with both ends' degrees.

    Links go from the end with fewer neighbours to the other, so a hub has few links of its
    own; those to a node without any can't close a triangle and are left out first.
    """
    mine, other = F.struct(F.col("da").alias("d"), F.col("a").alias("node")), F.struct(F.col("db").alias("d"), F.col("b").alias("node"))
    first = mine < other
    out = links.where("a <> b").select(F.when(first, mine).otherwise(other).alias("u"), F.when(first, other).otherwise(mine).alias("v"))
    out = cut(out.select(F.col("u.node").alias("u"), F.col("v.node").alias("v"), F.col("v.d").alias("dv")).distinct(), "links")
    near = out.join(out.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
    wedges = near.join(out.select("u", F.col("v").alias("w"), F.col("dv").alias("dw")), "u").where("dv < dw or (dv = dw and v < w)").select("u", "v", "w")
    found = wedges.join(out.select(F.col("u").alias("v"), F.col("v").alias("w")), ["v", "w"])
    sides = F.explode(F.array(*[F.struct(F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi")) for x, y in (("u", "v"), ("u", "w"), ("v", "w"))]))
    return found.select(sides.alias("s")).groupBy("s.lo", "s.hi").agg(F.count(F.lit(1)).alias("n"))


def pair_features(edges: DataFrame) -> DataFrame:
    """Features of every observed edge(source, target, observation_count, bidirectional): degrees, the mean degree of neighbours (one step of message passing), shared neighbours. Other columns stay.

    The mean over a node's neighbours is taken where their degrees are known, as every link
    stands in both directions. A node that is its own neighbour is one of its neighbours' too.
    """
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b")))
    both = both.where("a is not null").repartition("a").distinct()
    both = cut(both.withColumn("d", F.log1p(F.count(F.lit(1)).over(Window.partitionBy("a")))), "links")
    node = both.groupBy(F.col("b").alias("node")).agg(F.avg("d").alias("near")).join(both.groupBy(F.col("a").alias("node")).agg(F.max("d").alias("deg")), "node").select("node", "deg", "near")
    rest = [c for c in edges.columns if c not in ("source", "target", "observation_count", "bidirectional")]
    e = edges.select("source", "target", F.log1p("observation_count").alias("log_observations"), "bidirectional", *rest)
    node = cut(node, "nodes")
    e = cut(e.join(node.toDF("source", "log_degree_a", "near_a"), "source").join(node.toDF("target", "log_degree_b", "near_b"), "target"), "features")
    shared = triangles(e.select(F.col("source").alias("a"), F.col("target").alias("b"), F.col("log_degree_a").alias("da"), F.col("log_degree_b").alias("db")))
    loops = both.join(both.where("a = b").select("a"), "a").where("b is not null")
    beside = loops.select(F.explode(F.array_compact(F.array(F.struct(F.col("a").alias("lo"), F.col("a").alias("hi")), F.when(F.col("a") != F.col("b"), F.struct(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")))))).alias("s"))
    shared = shared.unionByName(beside.groupBy("s.lo", "s.hi").agg(F.count(F.lit(1)).alias("n"))).groupBy("lo", "hi").agg(F.log1p(F.sum("n")).alias("common"))
    e = e.withColumn("lo", F.least("source", "target")).withColumn("hi", F.greatest("source", "target")).join(shared, ["lo", "hi"], "left").drop("lo", "hi")
    return e.withColumn("common", F.coalesce("common", F.lit(0.0))).withColumn("one", F.lit(1.0))


def _dot(weights: list[float], names: list[str]) -> Column:
    out = F.lit(0.0)
    for w, n in zip(weights, names):
        out = out + F.lit(float(w)) * F.col(n)
    return out


def fit_logistic(rows: DataFrame, features: list[str], label: str, steps: int = 8, ridge: float = 1e-2) -> list[float]:
    """Weights by Newton steps: each is one aggregate of gradient and curvature sums, so only features squared numbers reach the driver. rows are read once a step, so they should be a table."""
    w = np.zeros(len(features))
    for _ in range(steps):
        p = 1 / (1 + F.exp(-_dot(w.tolist(), features)))
        g = [F.sum((F.col(label) - p) * F.col(f)) for f in features]
        h = [F.sum(p * (1 - p) * F.col(features[i]) * F.col(features[j])) for i in range(len(features)) for j in range(i, len(features))]
        sums = [float(x or 0) for x in rows.agg(*g, *h).first()]
        grad = np.array(sums[: len(features)]) - ridge * w
        hess = np.zeros((len(features), len(features)))
        it = iter(sums[len(features) :])
        for i in range(len(features)):
            for j in range(i, len(features)):
                hess[i, j] = hess[j, i] = next(it)
        step = np.linalg.solve(hess + ridge * np.eye(len(features)), grad)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def score_edges(rows: DataFrame, weights: list[float], features: list[str] | None = None) -> DataFrame:
    return rows.withColumn("probability", 1 / (1 + F.exp(-_dot(weights, features or PAIR_FEATURES))))


def thresholded(edges: DataFrame, threshold: float = 0.5, column: str = "confidence") -> DataFrame:
    """The graph of edges that reach a threshold."""
    return edges.where(F.col(column) >= threshold)


def _middle(values: Column) -> Column:
    n = F.size(values)
    return F.when(n > 0, (F.element_at(values, F.floor((n + 1) / 2).cast("int")) + F.element_at(values, F.floor(n / 2 + 1).cast("int"))) / 2)


def normalised(series: DataFrame, value: str = "value", least: int = 2, floor: float = 1e-3) -> DataFrame:
    """series(key, epoch, value) with z: distance from the median of all earlier epochs, in robust deviations (at least 5 % of the median), held within 10. A node's history is its epochs, in one framed list."""
    w = Window.partitionBy("key").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    s = series.withColumn("_past", F.array_sort(F.collect_list(value).over(w))).where(F.size("_past") >= least)
    s = s.withColumn("_med", _middle(F.col("_past")))
    s = s.withColumn("_mad", _middle(F.array_sort(F.transform("_past", lambda x: F.abs(x - F.col("_med"))))))
    scale = F.greatest(1.4826 * F.col("_mad"), 0.05 * F.abs("_med"), F.lit(floor))
    return s.withColumn("z", F.greatest(F.lit(-10.0), F.least(F.lit(10.0), (F.col(value) - F.col("_med")) / scale))).drop("_past", "_med", "_mad")


def sequence_anomalies(series: DataFrame, train_before: int, quantile: float = 0.99) -> DataFrame:
    """(key, epoch, residual, threshold) where a node's next normalised value is further from the forecast than quantile of training residuals.

    The forecast is linear in the last two normalised values, one model for all nodes,
    fitted from sums over epochs before train_before.
    """
    w = Window.partitionBy("key").orderBy("epoch")
    z = normalised(series).withColumn("z1", F.lag("z", 1).over(w)).withColumn("z2", F.lag("z", 2).over(w)).where("z2 is not null").withColumn("one", F.lit(1.0))
    z = cut(z, "series")
    names = ["one", "z1", "z2"]
    train = z.where(F.col("epoch") < train_before)
    sums = [float(x or 0) for x in train.agg(*[F.sum(F.col(a) * F.col(b)) for a in names for b in names], *[F.sum(F.col(a) * F.col("z")) for a in names]).first()]
    weights = np.linalg.solve(np.array(sums[:9]).reshape(3, 3) + 1e-6 * np.eye(3), np.array(sums[9:])).tolist()
    r = z.withColumn("residual", F.abs(F.col("z") - _dot(weights, names)))
    limit = r.where(F.col("epoch") < train_before).agg(F.percentile("residual", F.lit(quantile)).alias("threshold"))
    return r.where(F.col("epoch") >= train_before).join(F.broadcast(limit), F.lit(True)).where("residual > threshold").select("key", "epoch", "residual", "threshold")
