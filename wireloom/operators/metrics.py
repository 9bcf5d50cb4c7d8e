"""Evaluation: set scores, calibration, summaries, matching of events, tests, trends."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wireloom.functions.expressions import precision_recall_f1


def set_scores(predicted: DataFrame, actual: DataFrame, keys: list[str], group: list[str] | None = None) -> DataFrame:
    """(group, matched, predicted, actual, precision, recall, f1) of two sets of keys; both empty scores 1."""
    group = group or []
    both = predicted.select(*group, *keys).distinct().withColumn("_p", F.lit(1)).join(actual.select(*group, *keys).distinct().withColumn("_a", F.lit(1)), group + keys, "full_outer")
    sums = both.groupBy(*group).agg(F.coalesce(F.sum(F.col("_p") * F.col("_a")), F.lit(0)).alias("matched"), F.coalesce(F.sum("_p"), F.lit(0)).alias("predicted"), F.coalesce(F.sum("_a"), F.lit(0)).alias("actual"))
    p, r, f1 = precision_recall_f1(F.col("matched"), F.col("predicted"), F.col("actual"))
    return sums.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1)


def skeleton_scores(predicted: DataFrame, actual: DataFrame) -> DataFrame:
    """(correct, reversed, spurious, missing) of directed pairs(source, target): right way, wrong way, no such pair, not found."""
    a = actual.select("source", "target").distinct()
    p = predicted.select("source", "target").distinct()
    flags = p.join(a.withColumn("_d", F.lit(1)), ["source", "target"], "left").join(a.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit(1).alias("_r")), ["source", "target"], "left")
    found = flags.agg(F.coalesce(F.sum("_d"), F.lit(0)).alias("correct"), F.coalesce(F.sum(F.when(F.col("_d").isNull(), F.col("_r"))), F.lit(0)).alias("reversed"), F.sum(F.when(F.col("_d").isNull() & F.col("_r").isNull(), 1).otherwise(0)).alias("spurious"))
    lost = a.join(p, ["source", "target"], "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    return found.join(F.broadcast(lost), F.lit(True))


def jaccard(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    s = set_scores(a, b, keys)
    union = F.col("predicted") + F.col("actual") - F.col("matched")
    return s.select("matched", union.alias("union"), F.when(union == 0, 1.0).otherwise(F.try_divide("matched", union)).alias("jaccard"))


def calibration_bins(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_confidence, accuracy)."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("long")
    return rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def calibration_error(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    b = calibration_bins(rows, confidence, correct, bins)
    return b.agg(F.coalesce(F.try_divide(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))), F.sum("n")), F.lit(0.0)).alias("ece"), F.sum("n").alias("n"))


def brier(rows: DataFrame, p: str, y: str) -> DataFrame:
    return rows.agg(F.avg(F.pow(F.col(p) - F.col(y), F.lit(2))).alias("brier"), F.count(F.lit(1)).alias("n"))


def summary(rows: DataFrame, value: str, group: list[str]) -> DataFrame:
    """(group, n, mean, sd, min, max): nulls don't count; sd is the sample's, null below two values."""
    v = F.col(value)
    return rows.where(v.isNotNull()).groupBy(*group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.when(F.count(v) >= 2, F.stddev_samp(v)).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"))


def leave_one_out_shift(rows: DataFrame, value: str, group: list[str]) -> DataFrame:
    """(group, n, mean, shift): how far the mean moves at most when one row goes."""
    w = Window.partitionBy(*group)
    n, total = F.count(value).over(w), F.sum(value).over(w)
    held = rows.where(F.col(value).isNotNull()).select(*group, value, n.alias("n"), (total / n).alias("mean"), F.when(n > 1, F.abs((total - F.col(value)) / F.nullif(n - 1, F.lit(0)) - total / n)).alias("_s"))
    return held.groupBy(*group).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.coalesce(F.max("_s"), F.lit(0.0)).alias("shift"))


def match_events(labels: DataFrame, detections: DataFrame, keys: list[str]) -> DataFrame:
    """labels(keys, onset) with detected and latency: each label, by onset, takes the earliest detection(keys, at) at or after it that none before took.

    The i-th label's first possible detection is f(i); taking turns gives it number
    i + max over j up to i of (f(j) - j), so the one-to-one claim is a running maximum.
    f comes from counting detections before each onset in one sorted union.
    """
    times = labels.select(*keys, F.col("onset").alias("t"), F.lit(0).alias("kind")).unionByName(detections.select(*keys, F.col("at").alias("t"), F.lit(1).alias("kind")))
    w = Window.partitionBy(*keys).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = times.withColumn("_d", F.sum("kind").over(w)).withColumn("_l", F.sum(1 - F.col("kind")).over(w))
    first = both.where("kind = 0").withColumn("_f", F.col("_d"))  # detections strictly before
    claim = F.col("_l") + F.max(F.col("_f") - F.col("_l") + 1).over(Window.partitionBy(*keys).orderBy("_l").rowsBetween(Window.unboundedPreceding, 0))
    first = first.withColumn("_claim", claim)
    found = both.where("kind = 1").select(*keys, F.col("_d").alias("_claim"), F.col("t").alias("detected"))
    out = first.join(found, [*keys, "_claim"], "left")
    return out.select(*keys, F.col("t").alias("onset"), "detected", (F.col("detected") - F.col("t")).alias("latency"))


def holm(rows: DataFrame, p: str, group: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """rows with adjusted: Holm's step-down p values within each group of tests."""
    group = group or []
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    ranked = w.orderBy(p, *(order or []))
    scaled = F.least(F.lit(1.0), (F.count(F.lit(1)).over(w) - F.row_number().over(ranked) + 1) * F.col(p))
    return rows.withColumn("_s", scaled).withColumn("adjusted", F.max("_s").over(ranked.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def paired_difference(rows: DataFrame, value: str, condition: str, base: str, other: str, pair: list[str], group: list[str]) -> DataFrame:
    """(group, n, mean_diff, sd, t, dz): other minus base over pairs that have both."""
    wide = rows.groupBy(*group, *pair).agg(F.avg(F.when(F.col(condition) == base, F.col(value))).alias("_a"), F.avg(F.when(F.col(condition) == other, F.col(value))).alias("_b")).where("_a is not null and _b is not null")
    d = F.col("_b") - F.col("_a")
    s = wide.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_diff"), F.when(F.count(F.lit(1)) >= 2, F.stddev_samp(d)).alias("sd"))
    dz = F.try_divide("mean_diff", F.nullif("sd", F.lit(0.0)))
    return s.withColumn("dz", dz).withColumn("t", dz * F.sqrt("n"))


#: P(X <= k) of a Poisson variable of mean 1, k = 0, 1, 2, ...
POISSON_1 = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253, 0.999998874797402)


def poisson_weight(*names: Column) -> Column:
    """A Poisson(1) weight from a hash of names: the same for the same names, on any engine that has md5."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", *[n.cast("string") for n in names])), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    out = F.lit(0)
    for p in POISSON_1:
        out = out + (u >= p).cast("int")
    return out


def paired_interval(rows: DataFrame, value: str, condition: str, base: str, other: str, pair: list[str], group: list[str], draws: int = 200, level: float = 0.95, power: float = 0.8) -> DataFrame:
    """(group, n, dropped, mean_diff, sd, low, high, mde, verdict): other minus base over pairs, with a bootstrap interval of the mean.

    A draw weighs every pair by a hashed Poisson(1) number instead of drawing pairs with
    replacement, so all draws are one aggregate over (pair, draw) and give the same on
    every run; a draw of weight 0 in all is left out. dropped counts pairs with one side
    only. mde is the least mean difference that a two-sided paired t test finds with the
    power given. verdict: insufficient_n below 3 pairs, identical where no pair differs,
    else tested. Null values are left out of a side's mean.
    """
    sides = rows.groupBy(*group, *pair).agg(F.avg(F.when(F.col(condition) == base, F.col(value))).alias("_a"), F.avg(F.when(F.col(condition) == other, F.col(value))).alias("_b"))
    sides = sides.where("_a is not null or _b is not null").withColumn("_d", F.col("_b") - F.col("_a"))
    per = sides.groupBy(*group).agg(F.count("_d").alias("n"), F.sum(F.col("_d").isNull().cast("long")).alias("dropped"), F.avg("_d").alias("mean_diff"), F.stddev_samp("_d").alias("sd"), F.max(F.abs("_d")).alias("_most"))
    drawn = sides.where("_d is not null").withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_w", poisson_weight(*[F.col(c) for c in (*group, *pair)], F.col("_draw")))
    means = drawn.groupBy(*group, "_draw").agg(F.try_divide(F.sum(F.col("_w") * F.col("_d")), F.sum("_w")).alias("_mean")).where("_mean is not null")
    tail = (1 - level) / 2
    band = means.groupBy(*group).agg(F.percentile("_mean", F.array(F.lit(tail), F.lit(1 - tail))).alias("_band"))
    joined = per.join(band, group, "left") if group else per.join(F.broadcast(band), F.lit(True), "left")
    factor = F.pandas_udf(lambda n: pd.Series([student_quantile(1 - (1 - level) / 2, k - 1) + student_quantile(power, k - 1) if k > 1 else None for k in n], dtype=float), "double")
    verdict = F.when(F.col("n") < 3, "insufficient_n").when(F.col("_most") == 0, "identical").otherwise("tested")
    tested = verdict == "tested"
    return joined.select(*group, "n", "dropped", "mean_diff", F.when(F.col("n") > 1, F.col("sd")).alias("sd"), F.when(tested, F.col("_band")[0]).alias("low"), F.when(tested, F.col("_band")[1]).alias("high"), F.when(tested, factor("n") * F.col("sd") / F.sqrt("n")).alias("mde"), verdict.alias("verdict"))


def student_quantile(p: float, df: int) -> float:
    """The value below which Student's t with df degrees of freedom lies with probability p, by halving; the distribution by Simpson's rule on its density in the angle atan(t / sqrt(df))."""
    if p < 0.5:
        return -student_quantile(1 - p, df)
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    theta = np.linspace(0.0, 1.0, 2001)
    weights = np.where(np.arange(2001) % 2 == 1, 4.0, 2.0)
    weights[[0, -1]] = 1.0
    low, high = 0.0, math.pi / 2
    for _ in range(60):
        mid = (low + high) / 2
        below = 0.5 + scale * mid * float(np.cos(theta * mid) ** (df - 1) @ weights) / 6000
        low, high = (mid, high) if below < p else (low, mid)
    return math.sqrt(df) * math.tan(low)


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t, by Simpson's rule on the density over [0, |t|] in 400 steps, natively (relative error below 1e-6 for |t| under 40)."""
    x = F.least(F.abs(t), F.lit(40.0))
    h = x / 400
    # log of the normalising constant by Stirling's series with a shift of 8
    lg = lambda z: _log_gamma(z)
    logc = lg((df + 1) / 2) - lg(df / 2) - 0.5 * F.log(df * math.pi)
    dens = lambda u: F.exp(logc - (df + 1) / 2 * F.log1p(u * u / df))
    body = F.aggregate(F.sequence(F.lit(0), F.lit(400)), F.lit(0.0), lambda a, i: a + dens(h * i) * F.when((i == 0) | (i == 400), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0))
    return F.greatest(F.lit(0.0), 1 - 2 * body * h / 3)


def _log_gamma(z: Column) -> Column:
    w = z + 8
    series = (w - 0.5) * F.log(w) - w + 0.5 * math.log(2 * math.pi) + 1 / (12 * w) - 1 / (360 * w * w * w) + 1 / (1260 * w * w * w * w * w)
    for k in range(8):
        series = series - F.log(z + k)
    return series


def bootstrap_bands(rows: DataFrame, key: list[str], value: str, draws: int = 30, low: float = 0.05, high: float = 0.95, seed: int = 0) -> DataFrame:
    """(key, low, high, present): bands of sum(value) over Poisson(1) resamples of rows(key, id, value).

    A row's weight in a draw comes from a hash of its id, so reruns and partitions don't
    matter; the draws are columns of one aggregate, not copies of the rows.
    """
    u = lambda k: (F.pmod(F.xxhash64("id", F.lit(seed * 1000 + k)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    steps = []
    total = 0.0
    for i in range(8):
        total += math.exp(-1) / math.factorial(i)
        steps.append(total)

    def weight(k: int) -> Column:
        out = F.lit(0)
        for s in steps:
            out = out + (u(k) >= s).cast("int")
        return out

    sums = rows.groupBy(*key).agg(*[F.sum(weight(k) * F.col(value)).cast("double").alias(f"_s{k}") for k in range(draws)], *[F.max(weight(k) > 0).alias(f"_p{k}") for k in range(draws)])
    values = F.array_sort(F.array(*[F.col(f"_s{k}") for k in range(draws)]))
    present = sum((F.col(f"_p{k}").cast("int") for k in range(draws)), F.lit(0)) / draws

    def at(q: float) -> Column:
        place = q * (draws - 1)
        i, part = int(place), place - int(place)
        return F.element_at(values, i + 1) * (1 - part) + F.element_at(values, min(draws, i + 2)) * part

    return sums.select(*key, at(low).alias("low"), at(high).alias("high"), present.alias("present"))


def nearest_rank(rows: DataFrame, value: str, q: float, group: list[str]) -> DataFrame:
    """(group, value) at index min(n - 1, int(q * n)) of the sorted values: not interpolated."""
    w = Window.partitionBy(*group)
    r = rows.withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    return r.where(F.col("_i") == F.least(F.col("_n") - 1, F.floor(F.lit(q) * F.col("_n")))).select(*group, value)


def theil_sen(rows: DataFrame, x: str, y: str, group: list[str]) -> DataFrame:
    """(group, slope, tau): median of pairwise slopes, and Kendall's tau-b, of short series (all pairs of a series' points)."""
    a = rows.select(*group, F.col(x).alias("_xa"), F.col(y).alias("_ya"))
    b = rows.select(*group, F.col(x).alias("_xb"), F.col(y).alias("_yb"))
    pairs = a.join(b, group).where("_xa < _xb")
    s = F.signum(F.col("_yb") - F.col("_ya"))
    return pairs.groupBy(*group).agg(F.median((F.col("_yb") - F.col("_ya")) / (F.col("_xb") - F.col("_xa"))).alias("slope"), (F.sum(s) / F.nullif(F.sqrt(F.count(F.lit(1)).cast("double") * F.sum(F.abs(s))), F.lit(0.0))).alias("tau"))


def spearman(rows: DataFrame, x: str, y: str, group: list[str]) -> DataFrame:
    """(group, rho): Pearson's correlation of average ranks."""

    def mean_rank(c: str) -> Column:
        return F.rank().over(Window.partitionBy(*group).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*group, c)) - 1) / 2.0

    r = rows.withColumn("_rx", mean_rank(x)).withColumn("_ry", mean_rank(y))
    return r.groupBy(*group).agg(F.try_divide(F.covar_pop("_rx", "_ry"), F.nullif(F.stddev_pop("_rx") * F.stddev_pop("_ry"), F.lit(0.0))).alias("rho"))


def degradation(rows: DataFrame, step: str, value: str, limit: Column, group: list[str], run: int = 2) -> DataFrame:
    """(group, step): the first step from which run values in a row are below limit."""
    w = Window.partitionBy(*group).orderBy(step)
    bad = F.lit(True)
    held = rows.withColumn("_bad", F.col(value) < limit)
    for k in range(run):
        bad = bad & F.coalesce(F.lead("_bad", k).over(w), F.lit(False))
    return held.withColumn("_b", bad).where("_b").groupBy(*group).agg(F.min(step).alias(step))


def mode(rows: DataFrame, value: str, group: list[str]) -> DataFrame:
    """(group, value, n): the most frequent value, ties by value."""
    per = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("_n"), value)).alias("_t")).select(*group, F.col(f"_t.{value}").alias(value), (-F.col("_t._n")).alias("n"))


def paired_widths(rows: DataFrame, unit: list[str], level: str, value: str, group: list[str] | None = None, tie: float = 1e-12) -> DataFrame:
    """(group, wider, ties, narrower, monotone): each unit's value at the lowest level of its group against that at the highest.

    rows holds one value for each unit and level; units without both ends aren't counted.
    monotone says that more than half of the pairs are wider at the lowest level.
    """
    group = group or []
    ends = rows.groupBy(*group).agg(F.min(level).alias("_lo"), F.max(level).alias("_hi"))
    at_ends = rows.join(ends, group) if group else rows.join(F.broadcast(ends), F.lit(True))
    pairs = at_ends.groupBy(*group, *unit).agg(F.max(F.when(F.col(level) == F.col("_lo"), F.col(value))).alias("_a"), F.max(F.when(F.col(level) == F.col("_hi"), F.col(value))).alias("_b"))
    d = F.col("_a") - F.col("_b")
    counts = pairs.where(d.isNotNull()).groupBy(*group).agg(F.count_if(d > tie).alias("wider"), F.count_if(F.abs(d) <= tie).alias("ties"), F.count_if(d < -tie).alias("narrower"))
    return counts.withColumn("monotone", F.col("wider") * 2 > F.col("wider") + F.col("ties") + F.col("narrower"))


def sampling_stability(sampled: DataFrame, full: DataFrame, level: str) -> DataFrame:
    """(level, edges, nodes, edge_jaccard, node_retention) of pairs(level, source, target) seen in part against all pairs(source, target).

    A level without pairs has no row; against no pairs at all every share is 1.
    """

    def nodes(pairs: DataFrame, *keep: str) -> DataFrame:
        return pairs.select(*keep, F.explode(F.array("source", "target")).alias("node")).distinct()

    def shares(part: DataFrame, whole: DataFrame, keys: list[str], name: str) -> DataFrame:
        found = part.join(whole.withColumn("_in", F.lit(1)), keys, "left").groupBy(level).agg(F.count(F.lit(1)).alias(name), F.count("_in").alias(f"_{name}"))
        return found.join(F.broadcast(whole.agg(F.count(F.lit(1)).alias(f"_all_{name}"))), F.lit(True))

    ends = ["source", "target"]
    e = shares(sampled.select(level, *ends).distinct(), full.select(*ends).distinct(), ends, "edges")
    n = shares(nodes(sampled, level), nodes(full), ["node"], "nodes")
    jaccard = F.coalesce(F.try_divide("_edges", F.col("edges") + F.col("_all_edges") - F.col("_edges")), F.lit(1.0))
    kept = F.when(F.col("_all_nodes") == 0, 1.0).otherwise(F.try_divide("_nodes", "_all_nodes"))
    return e.join(n, level).select(level, "edges", "nodes", jaccard.alias("edge_jaccard"), kept.alias("node_retention"))
