"""Column expressions over probability arrays; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def own_prob(p: Column, label: Column) -> Column:
    """Probability of the given label."""
    return F.element_at(p, label.cast("int") + 1)


def argmax(p: Column) -> Column:
    """First index of the largest entry."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def best_other(p: Column, label: Column) -> Column:
    """Largest probability of any other class."""
    return F.array_max(F.filter(p, lambda x, i: i != label))


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x)


def normalized(p: Column) -> Column:
    s = total(p)
    return F.transform(p, lambda x: x / s)


def normalized_margin(p: Column, label: Column) -> Column:
    return (own_prob(p, label) - best_other(p, label) + 1) / 2


def normalized_entropy(p: Column) -> Column:
    """Entropy over ln K, with 0 ln 0 = 0."""
    s = F.aggregate(p, F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.ln(x)).otherwise(0.0))
    return -s / F.ln(F.size(p))


def confidence_weighted_entropy(p: Column, label: Column) -> Column:
    r = normalized_entropy(p) / F.greatest(own_prob(p, label), F.lit(EPS))
    return F.ln(r + 1) / F.greatest(r, F.lit(EPS))


def near_given(p: Column, label: Column) -> Column:
    """Whether the given label is the prediction once 1e-6 is added to it; such rows are never issues."""
    mine, other = own_prob(p, label) + EPS, best_other(p, label)
    first_other = F.array_position(F.transform(p, lambda x, i: F.when(i != label, x)), other) - 1
    return (mine > other) | ((mine == other) & (label < first_other))


def adjusted(p: Column, thresholds: list[float]) -> Column:
    """Probabilities less the class thresholds, shifted by the largest threshold and renormalised."""
    t = F.array(*[F.lit(float(x)) for x in thresholds])
    return normalized(F.zip_with(p, t, lambda x, y: x - y + F.lit(float(max(thresholds)))))


def softmin(s: Column, temperature: float) -> Column:
    """Sum of s weighted by softmax((1 - s) / T); the minimum for T = 0."""
    if temperature == 0:
        return F.array_min(s)
    top = F.array_max(F.transform(s, lambda x: (1 - x) / temperature))
    e = F.transform(s, lambda x: F.exp((1 - x) / temperature - top))
    return F.aggregate(F.zip_with(s, e, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x) / total(e)


def moving_average(s: Column, alpha: float) -> Column:
    """Exponential moving average over the scores from high to low; the lowest weighs most."""
    down = F.sort_array(s, asc=False)
    return F.aggregate(F.slice(down, 2, F.size(down)), F.element_at(down, 1), lambda a, x: alpha * x + (1 - alpha) * a)


def softmax(p: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(p)
    return normalized(F.transform(p, lambda x: F.exp((x - top) / temperature)))


def least_confidence(p: Column) -> Column:
    return F.array_max(p)


def generalized_entropy(p: Column, gamma: float = 0.1, m: int = 100) -> Column:
    q = F.slice(F.sort_array(softmax(p), asc=False), 1, m)
    s = F.aggregate(q, F.lit(0.0), lambda a, x: a + F.pow(x, F.lit(gamma)) * F.pow(1 - x, F.lit(gamma)))
    return 1 - s / m
