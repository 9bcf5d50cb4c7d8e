"""Dependency between nodes: communication, temporal precedence, noisy-or strength, causal candidates, attribution, propagation."""

from __future__ import annotations

from itertools import combinations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.functions.expressions import SECOND, bidirectionality, survival
from wireloom.session import cut

DEALT = 500_000  # times and starts that meet under one key
FREQUENCY_SCALE, PERSISTENCE_SCALE, SIGNAL_STRENGTH = 1.0, 60.0, 0.3
PAIR = ["capture_id", "source", "target"]
SIGNALS = ("frequency", "persistence", "directionality", "confidence", "precedence")


def communication(edges: DataFrame) -> DataFrame:
    """edges with persistence_seconds and frequency (flows a second; the plain count where they took no time)."""
    span = (F.col("last_us") - F.col("first_us")) / SECOND
    return edges.withColumn("persistence_seconds", span).withColumn("frequency", F.when(span > 0, F.col("observation_count") / F.nullif(span, F.lit(0.0))).otherwise(F.col("observation_count").cast("double")))


def bucket_series(times: DataFrame, seconds: float, key: str = "node") -> DataFrame:
    """(key, bucket, n) of times(key, us): counts by bucket from each key's first time, with zeros in between."""
    width = int(seconds * SECOND)
    spans = times.groupBy(key).agg(F.min("us").alias("_start"), F.max("us").alias("_end"))
    counts = times.join(spans, key).groupBy(key, F.floor((F.col("us") - F.col("_start")) / width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    all_ = spans.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_end") - F.col("_start")) / width))).alias("bucket"))
    return all_.join(counts, [key, "bucket"], "left").select(key, "bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _aligned(starts: DataFrame, times: DataFrame, width: int) -> DataFrame:
    """(node, _start, b, n) of distinct starts(node, _start): the node's times by bucket from each start. Times of a busy node are dealt out over many keys."""
    of = starts.groupBy("node").agg(F.count(F.lit(1)).alias("_k"))
    parts = times.groupBy("node").agg(F.count(F.lit(1)).alias("_n")).join(of, "node").select("node", F.ceil(F.col("_n") * F.col("_k") / DEALT).cast("int").alias("_parts"))
    busy = F.broadcast(cut(parts.where("_parts > 1"), "busy", 1))  # no more rows than products / DEALT
    few = F.coalesce("_parts", F.lit(1))
    dealt = times.join(busy, "node", "left").select("node", "us", "w", F.pmod(F.xxhash64("us", "w"), few).cast("int").alias("_part"))
    every = starts.join(busy, "node", "left").select("node", "_start", F.explode(F.sequence(F.lit(0), few - 1)).alias("_part"))
    return every.join(dealt, ["node", "_part"]).groupBy("node", "_start", F.floor((F.col("us") - F.col("_start")) / width).alias("b")).agg(F.sum("w").alias("n"))


def temporal_precedence(pairs: DataFrame, times: DataFrame, seconds: float = 10.0, max_lag: int = 5) -> DataFrame:
    """(source, target, precedence) of pairs(source, target) from times(node, us), or times(node, us, w) where a time stands w times.

    Buckets start at the earlier first time of the two. A pair's score is its best
    correlation over lags 1 to max_lag, if that is positive and above the one at lag 0.
    Series stay sparse: sums of products come from buckets with traffic on both sides, and
    the zeros only count in the number of buckets, so a long quiet span costs nothing.

    The end that meets fewer others leads: its buckets are rows of the pair, all lags at
    once, and look up the other's, which stands once for each start. What the other sums
    up to is its total without the buckets that a lag cuts off at its first or last end.
    """
    width = int(seconds * SECOND)
    times = (times if "w" in times.columns else times.withColumn("w", F.lit(1))).select("node", "us", F.col("w").cast("long").alias("w"))
    spans = cut(times.groupBy("node").agg(F.min("us").alias("lo"), F.max("us").alias("hi")), "spans")
    both = pairs.select("source", "target").distinct()
    degree = both.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("met"))
    ends = spans.join(degree, "node")
    s, t = ends.toDF("source", "_slo", "_shi", "_smet"), ends.toDF("target", "_tlo", "_thi", "_tmet")
    start = F.least("_slo", "_tlo")
    first = F.col("_smet") <= F.col("_tmet")
    meta = both.join(s, "source").join(t, "target").select(
        F.when(first, F.col("source")).otherwise(F.col("target")).alias("lead"), F.when(first, F.col("target")).otherwise(F.col("source")).alias("other"), first.alias("ahead"),
        start.alias("_start"), (F.floor((F.greatest("_shi", "_thi") - start) / width) + 1).alias("buckets"),
    )
    meta = cut(meta, "pairs")
    near = range(-max_lag, max_lag + 1)
    followed = cut(_aligned(meta.select(F.col("other").alias("node"), "_start").distinct(), times, width).withColumnRenamed("node", "other"), "followed")
    shifted = followed.select("other", "_start", "n", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), (F.col("b") - d).alias("b")) for d in near])).alias("x"))
    windows = cut(shifted.groupBy("other", "_start", "x.b").agg(F.map_from_entries(F.collect_list(F.struct("x.d", "n"))).alias("near")), "windows")  # 2 * max_lag + 1 entries at most

    # the leading end: a row for each of its buckets, which add up to a row a pair
    own = _aligned(meta.select(F.col("lead").alias("node"), "_start").distinct(), times, width).withColumnRenamed("node", "lead")
    rows = meta.join(own, ["lead", "_start"]).join(windows, ["other", "_start", "b"], "left")
    sums = []
    for k in range(max_lag + 1):
        inside = F.when(F.col("ahead"), F.col("b") < F.col("buckets") - k).otherwise(F.col("b") >= k)
        there = F.coalesce(F.when(F.col("ahead"), F.try_element_at("near", F.lit(k))).otherwise(F.try_element_at("near", F.lit(-k))), F.lit(0))
        sums += [F.sum(F.when(inside, e).otherwise(0)).alias(f"{name}{k}") for name, e in (("l", F.col("n")), ("ll", F.col("n") * F.col("n")), ("lf", F.col("n") * there))]
    led = rows.groupBy("lead", "_start", "other", "ahead", "buckets").agg(*sums)

    # the other end: its totals, and the buckets that lags cut off, once for each start, length and side
    side = ["other", "_start", "ahead", "buckets"]
    off = [F.when(F.col("ahead"), F.lit(j).cast("long")).otherwise(F.col("buckets") - 1 - j) for j in range(max_lag)]
    asked = meta.select(*side).distinct().select(*side, F.posexplode(F.array(*off)).alias("j", "b"))
    cut_off = [F.sum(F.when(F.col("j") < k, e)).alias(f"{name}{k}") for k in range(1, max_lag + 1) for name, e in (("_o", F.col("n")), ("_oo", F.col("n") * F.col("n")))]
    edge = asked.join(followed, ["other", "_start", "b"]).groupBy(*side).agg(*cut_off)
    whole = followed.groupBy("other", "_start").agg(F.sum("n").alias("o"), F.sum(F.col("n") * F.col("n")).alias("oo"))
    others = cut(meta.select(*side).distinct().join(whole, ["other", "_start"]).join(edge, side, "left"), "others")

    n = lambda k: F.col("buckets") - k

    def correlation(k: int) -> Column:
        o, oo = (F.col(c) - (F.coalesce(f"_{c}{k}", F.lit(0)) if k else F.lit(0)) for c in ("o", "oo"))
        mine, theirs = n(k) * F.col(f"ll{k}") - F.col(f"l{k}") * F.col(f"l{k}"), n(k) * oo - o * o
        x, y = F.when(F.col("ahead"), mine).otherwise(theirs), F.when(F.col("ahead"), theirs).otherwise(mine)
        spread = x.cast("double") * y.cast("double")
        return F.when((n(k) >= 2) & (spread > 0), (n(k) * F.col(f"lf{k}") - F.col(f"l{k}") * o) / F.sqrt(spread))

    zero = F.lit(0.0)
    best = led.join(others, side).select(
        F.when(F.col("ahead"), F.col("lead")).otherwise(F.col("other")).alias("source"), F.when(F.col("ahead"), F.col("other")).otherwise(F.col("lead")).alias("target"),
        F.coalesce(correlation(0), zero).alias("_zero"), F.coalesce(F.array_max(F.array(zero, *[correlation(k) for k in range(1, max_lag + 1)])), zero).alias("_best"),
    )
    return best.select("source", "target", F.when((F.col("_best") > F.col("_zero")) & (F.col("_best") > 0), F.least(F.lit(1.0), F.col("_best"))).otherwise(0.0).alias("precedence"))


def signal_terms(strength: float = SIGNAL_STRENGTH) -> list[Column]:
    """The five noisy-or terms over columns frequency, persistence_seconds, directionality, confidence, precedence."""
    persistence = 1 - F.exp(-F.col("persistence_seconds") / PERSISTENCE_SCALE)
    return [1 - F.exp(-F.col("frequency") / FREQUENCY_SCALE), strength * persistence, strength * F.col("directionality"), strength * F.col("confidence"), strength * F.col("precedence")]


def dependency_strength(edges: DataFrame, precedence: DataFrame | None = None) -> DataFrame:
    """edges with frequency, persistence_seconds, directionality, precedence and strength."""
    e = communication(edges).withColumn("directionality", 1 - bidirectionality(F.col("mean_forward_ratio")))
    e = e.withColumn("precedence", F.lit(0.0)) if precedence is None else e.join(precedence, ["source", "target"], "left").withColumn("precedence", F.coalesce("precedence", F.lit(0.0)))
    return e.withColumn("strength", 1 - survival(*signal_terms()))


def causal_candidates(dependencies: DataFrame, threshold: float = 0.5) -> DataFrame:
    return dependencies.where((F.col("strength") >= threshold) & (F.col("precedence") > 0))


def shapley(dependencies: DataFrame) -> DataFrame:
    """dependencies with phi_<signal>, each signal's exact share of strength, and drop_<signal>, what strength loses without it.

    A term's marginal gain to a coalition is the term times what the coalition leaves
    over, so a share is a weighted sum over the subsets of the other four terms.
    """
    terms = [f"_t{i}" for i in range(len(SIGNALS))]
    held = dependencies.select("*", *[t.alias(name) for t, name in zip(signal_terms(), terms)])
    n, out = len(terms), []
    for i, name in enumerate(SIGNALS):
        others = [t for t in terms if t != terms[i]]
        phi = F.lit(0.0)
        for k in range(n):
            weight = factorial(k) * factorial(n - k - 1) / factorial(n)
            for chosen in combinations(others, k):
                phi = phi + weight * survival(*[F.col(c) for c in chosen])
        out += [(F.col(terms[i]) * phi).alias(f"phi_{name}"), (F.col(terms[i]) * survival(*[F.col(c) for c in others])).alias(f"drop_{name}")]
    return held.select("*", *out).drop(*terms)


def evidence_report(dependencies: DataFrame) -> DataFrame:
    """dependencies with evidence, counter_evidence and limitations: lists of sentences by fixed rules."""
    f = F.format_string
    evidence = F.array_compact(F.array(
        f("communicates %.3f times a second over %.1f seconds", "frequency", "persistence_seconds"), f("edge confidence %.3f", "confidence"),
        F.when(F.col("precedence") > 0, f("activity of the target follows the source (%.3f)", "precedence")), F.when(F.col("directionality") > 0.5, f("traffic goes one way (%.3f)", "directionality")),
    ))
    counter = F.array_compact(F.array(
        F.when(F.col("precedence") <= 0, F.lit("no temporal precedence")), F.when(F.col("directionality") <= 0.5, F.lit("traffic goes both ways")), F.when(F.col("persistence_seconds") <= 0, F.lit("seen at one moment only")), F.when(F.col("confidence") < 0.5, F.lit("low edge confidence")),
    ))
    return dependencies.withColumn("evidence", evidence).withColumn("counter_evidence", counter).withColumn("limitations", F.array(F.lit("observational data cannot prove causation"), F.lit("unobserved nodes may drive both sides")))


def propagate_failure(candidates: DataFrame, failed: DataFrame) -> DataFrame:
    """(scenario, node, hop, caused_by): nodes reached from failed(scenario, node) along candidates(source, target) in one and two hops, each once, its cause the smallest."""
    start = failed.select("scenario", "node", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("caused_by"))
    links = candidates.select(F.col("source").alias("node"), "target").distinct()
    seen, frontier = start, start
    for hop in (1, 2):
        step = frontier.select("scenario", "node").join(links, "node").groupBy("scenario", F.col("target").alias("node")).agg(F.min(F.col("node")).alias("caused_by"))
        step = step.join(seen.select("scenario", "node"), ["scenario", "node"], "left_anti").select("scenario", "node", F.lit(hop).alias("hop"), "caused_by")
        seen, frontier = seen.unionByName(step), step
    return seen
