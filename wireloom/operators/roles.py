"""Roles: mixed naive Bayes with Gaussian and Bernoulli features, temperature, and a test for unlike samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_roles(labeled: DataFrame, gaussian: list[str], binary: list[str], floor: float = 1e-6, smoothing: float = 1.0) -> DataFrame:
    """A row per role: log prior, mean and population variance of the gaussian columns, smoothed rate of the binary ones. One aggregate; as many rows as roles."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in gaussian:
        aggs += [F.avg(c).alias(f"mean_{c}"), F.greatest(F.var_pop(c), F.lit(floor)).alias(f"var_{c}")]
    for c in binary:
        aggs.append(((F.sum(F.col(c).cast("int")) + smoothing) / (F.count(F.lit(1)) + 2 * smoothing)).alias(f"rate_{c}"))
    from pyspark.sql import Window

    per = labeled.groupBy("role").agg(*aggs)
    return per.withColumn("log_prior", F.log(F.col("n") / F.sum("n").over(Window.partitionBy())))


def log_posteriors(samples: DataFrame, model: DataFrame, gaussian: list[str], binary: list[str]) -> DataFrame:
    """samples times roles with lp, the unnormalised log posterior. The model has a row per role, so it is broadcast."""
    both = samples.join(F.broadcast(model.withColumnRenamed("role", "role_")), F.lit(True))
    lp = F.col("log_prior")
    for c in gaussian:
        v = F.col(f"var_{c}")
        lp = lp - 0.5 * (F.log(2 * math.pi * v) + F.pow(F.col(c) - F.col(f"mean_{c}"), F.lit(2)) / v)
    for c in binary:
        lp = lp + F.when(F.col(c), F.log(f"rate_{c}")).otherwise(F.log(1 - F.col(f"rate_{c}")))
    return both.withColumn("lp", lp)


def softmax(posteriors: DataFrame, key: str, temperature: float = 1.0) -> DataFrame:
    """(key, role, p)."""
    from pyspark.sql import Window

    w = Window.partitionBy(key)
    e = posteriors.withColumn("_e", F.exp((F.col("lp") - F.max("lp").over(w)) / temperature))
    return e.select(key, F.col("role_").alias("role"), (F.col("_e") / F.sum("_e").over(w)).alias("p"))


def best_role(probabilities: DataFrame, key: str) -> DataFrame:
    """(key, role, p): the likeliest role, ties by name."""
    top = probabilities.groupBy(key).agg(F.min(F.struct((-F.col("p")).alias("_n"), "role")).alias("_t"))
    return top.select(key, F.col("_t.role").alias("role"), (-F.col("_t._n")).alias("p"))


def held_out(labeled: DataFrame, key: str, gaussian: list[str], binary: list[str], floor: float = 1e-6, smoothing: float = 1.0) -> DataFrame:
    """(key, truth, role, p, seen): each row's role by the model of all other rows.

    No model is fitted again: a row's own part is taken out of the sums of its role, so
    leaving each out costs one aggregate and a join with a row per role. A role whose only
    row is left out doesn't stand for election; seen is then false. Needs two rows.
    """
    from pyspark.sql import Window

    aggs = [F.count(F.lit(1)).alias("n_")]
    for c in gaussian:
        aggs += [F.sum(c).alias(f"s_{c}"), F.sum(F.col(c) * F.col(c)).alias(f"q_{c}")]
    aggs += [F.sum(F.col(c).cast("int")).alias(f"b_{c}") for c in binary]
    sums = labeled.groupBy(F.col("role").alias("role_")).agg(*aggs).withColumn("all_", F.sum("n_").over(Window.partitionBy()))  # a row per role
    both = labeled.withColumnRenamed("role", "truth").join(F.broadcast(sums), F.lit(True))
    own = (F.col("truth") == F.col("role_")).cast("int")
    n = F.col("n_") - own
    lp = F.log(n / (F.col("all_") - 1))
    for c in gaussian:
        mean = (F.col(f"s_{c}") - own * F.col(c)) / n
        v = F.greatest((F.col(f"q_{c}") - own * F.col(c) * F.col(c)) / n - mean * mean, F.lit(floor))
        lp = lp - 0.5 * (F.log(2 * math.pi * v) + F.pow(F.col(c) - mean, F.lit(2)) / v)
    for c in binary:
        rate = (F.col(f"b_{c}") - own * F.col(c).cast("int") + smoothing) / (n + 2 * smoothing)
        lp = lp + F.when(F.col(c), F.log(rate)).otherwise(F.log(1 - rate))
    scored = both.where((n > 0) & (F.col("all_") > 1)).withColumn("lp", lp)
    best = best_role(softmax(scored, key), key)
    seen = both.where(own == 1).select(key, "truth", (n > 0).alias("seen"))
    return seen.join(best, key).select(key, "truth", "role", "p", "seen")


def fit_temperature(posteriors: DataFrame, key: str, truth: str, low: float = 0.05, high: float = 20.0, size: int = 200) -> DataFrame:
    """(temperature, nll): the first of a logarithmic grid with the least negative log likelihood. Only the grid's sums leave the tasks."""
    per = posteriors.groupBy(key).agg(F.collect_list("lp").alias("_all"), F.max(F.when(F.col("role_") == F.col(truth), F.col("lp"))).alias("_true"))
    grid = [low * (high / low) ** (i / (size - 1)) for i in range(size)]
    at = per.withColumn("_g", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(grid)])))
    top = F.array_max("_all")
    p = F.exp((F.col("_true") - top) / F.col("_g.t")) / F.aggregate("_all", F.lit(0.0), lambda a, x: a + F.exp((x - top) / F.col("_g.t")))
    nll = at.groupBy("_g.i", "_g.t").agg(F.sum(-F.log(F.greatest(p, F.lit(1e-12)))).alias("nll"))
    return nll.orderBy("nll", "i").limit(1).select(F.col("t").alias("temperature"), "nll")


def out_of_distribution(posteriors: DataFrame, key: str, gaussian: list[str], limit: float = 4.0) -> DataFrame:
    """(key, ood): whether some feature is further than limit deviations from every role."""
    near = posteriors.groupBy(key).agg(*[F.min(F.abs(F.col(c) - F.col(f"mean_{c}")) / F.sqrt(f"var_{c}")).alias(f"z_{c}") for c in gaussian])
    far = F.lit(False)
    for c in gaussian:
        far = far | (F.col(f"z_{c}") > limit)
    return near.select(key, far.alias("ood"))


def robust_roles(probabilities: DataFrame, ood: DataFrame, key: str, roles: int) -> DataFrame:
    """(key, role, p) with even probabilities where the sample is like no role."""
    return probabilities.join(ood, key).select(key, "role", F.when(F.col("ood"), 1.0 / roles).otherwise(F.col("p")).alias("p"))
