"""Causal discovery on lagged series: sums of products from Spark, partial correlations from their inverses.

A variable is a node's series, some buckets back. No series is ever put together: sums of
products of two nodes come from a join on the bucket and an aggregate, for all lags of a
pair at once. Of a pair, the node that meets fewer others gives the rows, and the other
is looked up, so a node that all others meet sends its series once and not to each of them.
What a test needs of a candidate is a few correlations with its strongest rivals, a row of
fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, product
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wireloom.functions.expressions import SECOND
from wireloom.session import cut, discard

ALPHA, MAX_LAG, MAX_SET, MAX_RIVALS = 0.05, 5, 3, 6
#: A set whose correlation matrix has a smaller eigenvalue is one of dependent variables; a smaller share of unexplained variance is none.
LEAST_EIGENVALUE, LEAST_VARIANCE = 1e-10, 1e-10
VARIABLE = ["target", "source", "lag"]


def fisher_z_p(r: float, n: int, conditioned: int) -> float:
    """Two-sided p of a (partial) correlation over n samples given conditioned variables; 1 without degrees of freedom."""
    dof = n - conditioned - 3
    if dof <= 0:
        return 1.0
    r = max(-0.999999999, min(0.999999999, r))
    return math.erfc(abs(math.atanh(r)) * math.sqrt(dof) / math.sqrt(2))


def least_correlation(n: int, alpha: float) -> float:
    """The smallest |r| over n samples that Fisher's test finds significant; more than 1 without degrees of freedom."""
    return math.tanh(NormalDist().inv_cdf(1 - alpha / 2) / math.sqrt(n - 3)) if n > 3 else 2.0


def led(pairs: DataFrame) -> DataFrame:
    """(a, b): pairs of two nodes once each, the one that meets fewer others first. Rows of the first ends then come to few for each node where some nodes meet all others."""
    both = pairs.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    met = both.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("met"))
    for end in ("u", "v"):
        both = both.join(met.select(F.col("node").alias(end), F.col("met").alias(f"_{end}")), end)
    first = F.col("_u") <= F.col("_v")
    return both.select(F.when(first, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("b"))


class Lagged:
    """The variables of series(node, bucket, n), lags 0 to max_lag, over the buckets in which all lags are known.

    Buckets run from the first to the last one of any node; a bucket without a row counts
    as 0, several rows of one are added up. Rows with a null node or bucket are left out.
    """

    def __init__(self, series: DataFrame, max_lag: int) -> None:
        own = series.where("node is not null and bucket is not null").groupBy("node", "bucket").agg(F.sum("n").cast("double").alias("n"))
        self.own = cut(own, "series")
        self.first, self.last = self.own.agg(F.min("bucket"), F.max("bucket")).first()
        self.max_lag = max_lag
        self.samples = 0 if self.first is None else max(0, int(self.last - self.first) + 1 - max_lag)
        every = self.own.select("node", *[F.when(self._within(F.col("bucket") + k), F.col("n")).alias(f"n{k}") for k in range(max_lag + 1)])
        sums = every.groupBy("node").agg(*[f(k) for k in range(max_lag + 1) for f in (lambda k: F.sum(f"n{k}").alias(f"s{k}"), lambda k: F.sum(F.col(f"n{k}") * F.col(f"n{k}")).alias(f"ss{k}"))])
        self.sums = cut(sums, "sums")

    def _within(self, bucket: Column) -> Column:
        """Whether a bucket is one in which all lags are known."""
        return bucket.between((self.first or 0) + self.max_lag, self.last or 0)

    def _summed(self, rows: DataFrame, near: dict[int, Column], cells: list[tuple[int, int]]) -> DataFrame:
        """(a, b, sums) of rows(a, b, bucket, n): the sum of a's variable at lag i times b's at lag j, for each of cells (i, j). near gives b's n some buckets on."""
        sums = [F.sum(F.when(self._within(F.col("bucket") + i), F.col("n") * near[i - j])).alias(f"_{k}") for k, (i, j) in enumerate(cells)]
        return rows.groupBy("a", "b").agg(*sums).select("a", "b", F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"_{k}").alias("xy")) for k, (i, j) in enumerate(cells)]).alias("sums"))

    def _products(self, pairs: DataFrame, cells: list[tuple[int, int]]) -> DataFrame:
        """(a, i, b, j, xy) for distinct pairs(a, b): both ways round where both are pairs, or one is turned."""
        away = range(-self.max_lag, self.max_lag + 1)
        alone = pairs.where("a = b").select(F.col("a").alias("node")).distinct()
        on = Window.partitionBy("node").orderBy("bucket")
        beside = self.own.join(alone, "node", "left_semi").select(F.col("node").alias("a"), F.col("node").alias("b"), "bucket", "n", *[F.sum("n").over(on.rangeBetween(d, d)).alias(f"w{d + self.max_lag}") for d in away])
        near = {d: F.col(f"w{d + self.max_lag}") for d in away}
        both = cut(led(pairs), "pairs")
        followers = self.own.join(both.select(F.col("b").alias("node")).distinct(), "node", "left_semi")
        shifted = followers.select(F.col("node").alias("b"), "bucket", "n", F.explode(F.array(*map(F.lit, away))).alias("d")).withColumn("bucket", F.col("bucket") - F.col("d"))
        windows = cut(shifted.groupBy("b", "bucket").agg(*[F.sum(F.when(F.col("d") == d, F.col("n"))).alias(f"w{d + self.max_lag}") for d in away]), "windows")
        rows = both.join(self.own.withColumnRenamed("node", "a"), "a").join(windows, ["b", "bucket"])
        wide = sorted({(j, i) for i, j in cells} | set(cells))
        sums = self._summed(rows, near, wide)
        turned = sums.select(F.col("b").alias("a"), F.col("a").alias("b"), F.transform("sums", lambda x: F.struct(x["j"].alias("i"), x["i"].alias("j"), x["xy"].alias("xy"))).alias("sums"))
        out = sums.unionByName(turned).unionByName(self._summed(beside, near, cells))
        return out.select("a", "b", F.inline("sums")).where("xy is not null")

    def correlations(self, pairs: DataFrame, cells: list[tuple[int, int]]) -> DataFrame:
        """pairs(a, i, b, j) with r, the correlation of node a's variable at lag i and node b's at lag j; without those where one is constant. All (i, j) are of cells."""
        pairs = cut(pairs.where("a is not null and b is not null").distinct(), "asked")
        products = self._products(pairs.select("a", "b").distinct(), cells)
        found = pairs.join(products, ["a", "i", "b", "j"], "left")
        lags = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"s{k}").alias("s"), F.col(f"ss{k}").alias("ss")) for k in range(self.max_lag + 1)]))
        one = self.sums.select("node", lags.alias("x")).where("x.ss > 0")
        for node, lag, s in (("a", "i", "x"), ("b", "j", "y")):
            found = found.join(one.select(F.col("node").alias(node), F.col("x.lag").alias(lag), F.col("x.s").alias(f"{s}1"), F.col("x.ss").alias(f"{s}2")), [node, lag])
        n = F.lit(float(self.samples))
        spread = (n * F.col("x2") - F.col("x1") * F.col("x1")) * (n * F.col("y2") - F.col("y1") * F.col("y1"))
        r = (n * F.coalesce("xy", F.lit(0.0)) - F.col("x1") * F.col("y1")) / F.sqrt(spread)
        return found.where(spread > 0).select("a", "i", "b", "j", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)).alias("r"))


def lagged_correlations(series: DataFrame, pairs: DataFrame, max_lag: int = MAX_LAG) -> DataFrame:
    """(source, target, lag, r) of pairs(source, target): the source's activity lag buckets before the target's, lags 1 to max_lag."""
    return _screen(Lagged(series, max_lag), pairs, max_lag)


def _screen(lagged: Lagged, pairs: DataFrame, max_lag: int) -> DataFrame:
    lags = pairs.select(F.col("source").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(max_lag))).alias("i"), F.col("target").alias("b"), F.lit(0).alias("j"))
    return lagged.correlations(lags, [(k, 0) for k in range(1, max_lag + 1)]).select(F.col("a").alias("source"), F.col("b").alias("target"), F.col("i").alias("lag"), "r")


def conditional(r: np.ndarray) -> float | None:
    """Partial correlation of the first two variables of a correlation matrix given the others, or None where it isn't defined."""
    given = r[2:, 2:]
    if len(given):
        if np.linalg.eigvalsh(given)[0] < LEAST_EIGENVALUE:
            return None
        left = r[:2, :2] - r[:2, 2:] @ np.linalg.inv(given) @ r[2:, :2]
    else:
        left = r
    if min(left[0, 0], left[1, 1]) < LEAST_VARIANCE:
        return None
    return float(np.clip(left[0, 1] / math.sqrt(left[0, 0] * left[1, 1]), -1, 1))


def judge(r0: float, strength: float, rivals: list[dict], among: dict[tuple[int, int], float], size: int | None, n: int, alpha: float) -> tuple[bool, float | None, int]:
    """(stays, r of the last defined test, its number of conditioning variables) of one candidate.

    rivals, strongest first, have place, r (with the candidate) and r0 (with the target);
    among has the correlations between places. size None conditions on all rivals at once.
    """
    said: tuple[bool, float | None, int] = (True, None, 0)
    for chosen in combinations(rivals, len(rivals) if size is None else size):
        m = np.eye(2 + len(chosen))
        m[0, 1] = m[1, 0] = r0
        for k, z in enumerate(chosen, 2):
            m[0, k] = m[k, 0] = z["r"]
            m[1, k] = m[k, 1] = z["r0"]
            for l, w in enumerate(chosen[: k - 2], 2):
                m[k, l] = m[l, k] = among[z["place"], w["place"]]
        r = conditional(m)
        if r is None:
            continue
        said = (True, r, len(chosen))
        if fisher_z_p(r, n, len(chosen)) > alpha:
            return False, r, len(chosen)
    return said


_STATE = "target string, source string, lag int, r0 double, strength double, r double, conditioned int"


def _round(lagged: Lagged, state: DataFrame, size: int | None, alpha: float) -> DataFrame:
    """state after the tests of one size (None: the last pass). Rivals are the same for all tests of a round."""
    order = Window.partitionBy("target").orderBy(F.desc("strength"), "source", "lag")
    top = state.withColumn("place", F.row_number().over(order)).where(F.col("place") <= MAX_RIVALS + 1)
    top = cut(top.select("target", F.col("source").alias("z"), F.col("lag").alias("zlag"), F.col("r0").alias("z0"), "place"), "rivals")
    met = state.join(top, "target").where("source <> z or lag <> zlag")
    pairs = met.select(F.col("source").alias("a"), F.col("lag").alias("i"), F.col("z").alias("b"), F.col("zlag").alias("j"))
    cells = list(product(range(1, lagged.max_lag + 1), repeat=2))
    known = cut(lagged.correlations(pairs, cells), "correlations")
    met = met.join(known.select(F.col("a").alias("source"), F.col("i").alias("lag"), F.col("b").alias("z"), F.col("j").alias("zlag"), F.col("r").alias("rz")), ["source", "lag", "z", "zlag"])
    rivals = met.groupBy(*VARIABLE).agg(F.slice(F.array_sort(F.collect_list(F.struct("place", F.col("rz").alias("r"), F.col("z0").alias("r0")))), 1, MAX_RIVALS).alias("rivals"))
    one = top.select("target", F.col("z").alias("a"), F.col("zlag").alias("i"), F.col("place").alias("p"))
    two = top.select("target", F.col("z").alias("b"), F.col("zlag").alias("j"), F.col("place").alias("q"))
    among = one.join(two, "target").where("p <> q").join(known, ["a", "i", "b", "j"]).groupBy("target").agg(F.collect_list(F.struct("p", "q", "r")).alias("among"))
    n = lagged.samples

    def test(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                others = [] if row.rivals is None else list(row.rivals)
                between = {} if row.among is None else {(x["p"], x["q"]): x["r"] for x in row.among}
                stays, r, k = judge(row.r0, row.strength, others, between, size, n, alpha) if size is None or len(others) >= size else (True, None, 0)
                if stays:
                    out.append((row.target, row.source, row.lag, row.r0, row.strength if r is None else abs(r), row.r if r is None else r, row.conditioned if r is None else k))
            yield pd.DataFrame(out, columns=["target", "source", "lag", "r0", "strength", "r", "conditioned"])

    after = cut(state.join(rivals, VARIABLE, "left").join(among, "target", "left").mapInPandas(test, _STATE), "candidates")
    discard(top, known)
    return after


def discover(series: DataFrame, pairs: DataFrame, max_lag: int = MAX_LAG, alpha: float = ALPHA) -> DataFrame:
    """(source, target, lag, r, p, conditioned): edges from series(node, bucket, n) among pairs(source, target), each with its strongest lag.

    A candidate is a source of pairs, or the target itself, some buckets earlier. It must
    correlate with the target, then stay dependent given each set of up to MAX_SET of its
    MAX_RIVALS strongest rivals, and at last given all of those at once. A candidate is as
    strong as its last defined test of a round said; within a round rivals are those of
    its start, so results don't depend on the order of columns. A test that isn't defined
    (dependent rivals, nothing left to explain) takes nothing out. r, p and conditioned
    are those of the last defined test. The target's own past only explains away.

    Constant series take no part; with max_lag + 3 buckets or fewer, or no rows, there are
    no edges. Repeated pairs count once; pairs with a null or of a node with itself are
    left out of the edges.
    """
    lagged = Lagged(series, max_lag)
    pairs = pairs.select("source", "target").where("source <> target").distinct()
    spark = pairs.sparkSession
    if lagged.samples <= 3:
        return spark.createDataFrame([], "source string, target string, lag int, r double, p double, conditioned int")
    own = pairs.select(F.col("target").alias("source"), "target").distinct()
    found = _screen(lagged, pairs.unionByName(own), max_lag).where(F.abs("r") >= least_correlation(lagged.samples, alpha))
    state = cut(found.select("target", "source", "lag", F.col("r").alias("r0"), F.abs("r").alias("strength"), "r", F.lit(0).alias("conditioned")), "candidates")
    for size in (*range(1, MAX_SET + 1), None):
        after = _round(lagged, state, size, alpha)
        discard(state)
        state = after
    best = Window.partitionBy("source", "target").orderBy(F.desc(F.abs("r")), "lag")
    n = lagged.samples
    p = F.pandas_udf(lambda r, k: pd.Series([fisher_z_p(x, n, c) for x, c in zip(r, k)], dtype=float), "double")
    edges = state.where("source <> target").withColumn("_place", F.row_number().over(best)).where("_place = 1")
    return edges.select("source", "target", "lag", "r", p("r", "conditioned").alias("p"), "conditioned")


def activity_series(flows: DataFrame, seconds: float) -> DataFrame:
    """(node, bucket, n): flows that touch a node, by the bucket of their first packet, counted from the first flow of all."""
    start = flows.agg(F.min("first_us")).first()[0] or 0
    ends = F.array_distinct(F.array("src_ip", "dst_ip"))
    touching = flows.select(F.explode(ends).alias("node"), F.floor((F.col("first_us") - F.lit(start)) / int(seconds * SECOND)).alias("bucket"))
    return touching.groupBy("node", "bucket").agg(F.count(F.lit(1)).alias("n"))


def discover_edges(flows: DataFrame, seconds: float = 10.0, max_lag: int = MAX_LAG, alpha: float = ALPHA) -> DataFrame:
    """discover() over the activity of flows(src_ip, dst_ip, first_us); candidates are pairs that have a flow, in either direction."""
    met = flows.select(F.col("src_ip").alias("source"), F.col("dst_ip").alias("target"))
    both = met.unionByName(met.select(F.col("target").alias("source"), F.col("source").alias("target")))
    return discover(activity_series(flows, seconds), both, max_lag, alpha)


def as_candidates(edges: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Edges of discover() as causal candidates: strength and precedence are |r|, with the reason as text."""
    why = F.format_string(
        "activity of %s %d bucket(s) earlier goes with that of %s: partial correlation %.3f, p %.4f below %.3f, given %d other earlier series",
        "source", "lag", "target", "r", "p", F.lit(float(alpha)), "conditioned",
    )
    return edges.select(F.concat(F.lit("pc:"), "source", F.lit("->"), "target").alias("dependency_id"), "source", "target", F.abs("r").alias("strength"), F.abs("r").alias("precedence"), why.alias("rationale"))
