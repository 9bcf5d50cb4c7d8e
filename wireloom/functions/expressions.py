"""Column expressions that several operators share. All of them stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp, with or without zone (the session's zone is UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(float(SECOND))


def bidirectionality(ratio: Column) -> Column:
    """0 for one-way traffic, 1 for an even exchange."""
    return 2 * F.least(ratio, 1 - ratio)


def survival(*terms: Column) -> Column:
    """The product of 1 - term: what a noisy-or leaves over."""
    out = F.lit(1.0)
    for t in terms:
        out = out * (1 - t)
    return out


def volume_evidence(packets: Column, scale: float) -> Column:
    return 1 - F.exp(-packets / F.lit(float(scale)))


def precision_recall_f1(matched: Column, predicted: Column, actual: Column) -> tuple[Column, Column, Column]:
    """Set precision, recall and F1; both sets empty counts as a perfect match."""
    empty = (predicted == 0) & (actual == 0)
    p = F.when(empty, 1.0).otherwise(F.coalesce(F.try_divide(matched, predicted), F.lit(0.0)))
    r = F.when(empty, 1.0).otherwise(F.coalesce(F.try_divide(matched, actual), F.lit(0.0)))
    return p, r, F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def pearson(x: str, y: str) -> Column:
    """Correlation as an aggregate; null where it is undefined (fewer than two rows, or a constant side)."""
    return F.when(F.count(F.lit(1)) >= 2, F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))))


def edge_weight(confidence: Column, floor: float = 1e-9) -> Column:
    """Path cost of an edge: minus the logarithm of its confidence, held within (0, 1]."""
    return -F.log(F.least(F.greatest(confidence, F.lit(floor)), F.lit(1.0)))
