"""Column functions on numbers, times and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 3.6e9


def decay(age_hours: Column, scale: float) -> Column:
    """exp(-age / scale): falls to 1/e at ``scale``, not to a half."""
    return F.exp(-age_hours / scale)


def time_proximity(a: Column, b: Column, scale: float = 48.0) -> Column:
    """Decay of the distance of two times, 0.5 where one is unknown."""
    return F.when(a.isNull() | b.isNull(), F.lit(0.5)).otherwise(decay(F.abs(hours_between(a, b)), scale))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where a vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def importance(evidence: Column, trust: Column, entities: Column, claims: Column) -> Column:
    """Event importance: .35 evidence (log scale to 10), .35 trust, .20 entities and .10 claims (to 10 each)."""
    ev = F.log2(F.least(evidence, F.lit(10)) + 1) / F.log2(F.lit(11.0))
    return clamp(0.35 * ev + 0.35 * trust + 0.20 * F.least(entities, F.lit(10)) / 10 + 0.10 * F.least(claims, F.lit(10)) / 10)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def logit(p: Column, eps: float = 1e-7) -> Column:
    p = clamp(p, eps, 1 - eps)
    return F.ln(p / (1 - p))


def authority(x: Column, scale: float) -> Column:
    """log1p(x) / log1p(scale), at most 1."""
    return clamp(F.log1p(x) / F.log1p(F.lit(scale)))


def ucb1(mean: Column, pulls: Column, total: Column, c: float = 2.0, least: int = 1) -> Column:
    """Upper confidence bound of an arm, infinite below ``least`` pulls."""
    return F.when(pulls < least, F.lit(float("inf"))).otherwise(mean + F.sqrt(c * F.ln(total) / pulls))
