"""Scores as columns; all of them stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def logit(x: Column) -> Column:
    return F.log(x) - F.log1p(-x)


def logit_sum(values: list[Column]) -> Column:
    total = F.lit(0.0)
    for v in values:
        total = total + logit(v)
    return total


def product(values: list[Column]) -> Column:
    total = F.lit(1.0)
    for v in values:
        total = total * v
    return total


def weighted_models(values: dict[float, Column]) -> Column:
    """Average of models by weight."""
    total = sum(values)
    out = F.lit(0.0)
    for weight, value in values.items():
        out = out + value * (weight / total)
    return out


def uniform_count(k: Column, step: float = 0.4, eps: float = 1e-6) -> Column:
    return F.least(k * step, F.lit(1.0)) - eps


def _digamma(x: Column) -> Column:
    """For x of 64 or more, to double precision."""
    y = 1 / (x * x)
    return F.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def decaying_count(k: Column, step: float, rate: float, plain: int = 64) -> Column:
    """Sum over i below k of step / (i + rate); terms from ``plain`` (64 or more) on come as a difference of digammas."""
    terms = F.sequence(F.lit(0), F.least(k, F.lit(plain)).cast("int") - 1)
    first = F.aggregate(terms, F.lit(0.0), lambda total, i: total + step / (i + rate))
    rest = F.when(k > plain, step * (_digamma(F.floor(k).cast("double") + rate) - _digamma(F.lit(float(plain + rate))))).otherwise(F.lit(0.0))
    return F.when(k < 1, F.lit(0.0)).otherwise(first + rest)


def logarithmic_count(k: Column, base: float) -> Column:
    return F.least(F.log(k + 1.0) / math.log(base), F.lit(1.0))


def log_intensity(intensity: Column, error: Column, tolerance: float) -> Column:
    """One matched peak's part: log10 of its intensity, less towards the edge of the tolerance."""
    return F.log10(intensity) * (1 - F.pow(F.abs(error) / tolerance, F.lit(4.0)))


def log_factorial(n: Column) -> Column:
    """ln n! for n of 0 or more, to double precision: Stirling's series eight further on, less the logs between."""
    whole = F.floor(n).cast("double")
    x = whole + 9
    y = 1 / (x * x)
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y / 1188)))) / x
    between = whole + 1
    for j in range(2, 9):
        between = between * (whole + j)
    # A product of eight factors stays far below the largest double for any n that is a count.
    return series - F.log(between)


def hyperscore(n_forward: Column, n_backward: Column, forward_signal: Column, backward_signal: Column) -> Column:
    """Log factorials of the matched counts plus the logs of their summed intensities."""
    part = lambda n, signal: log_factorial(n) + F.log(F.greatest(signal, F.lit(1.0)))
    return part(n_forward, forward_signal) + part(n_backward, backward_signal)


def binomial_tail(n: Column, k: Column, p: Column, inclusive: bool = False) -> Column:
    """Sum over i from k to n - 1 (n if ``inclusive``) of C(n, i) p^i (1-p)^(n-i).

    The first term comes from log factorials, each further one from the one before, in logs.
    """
    last = n if inclusive else n - 1
    odds = F.log(p) - F.log1p(-p)
    first = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(p) + (n - k) * F.log1p(-p)
    start = F.struct(first.cast("double").alias("term"), F.exp(first).cast("double").alias("total"))

    def further(state: Column, i: Column) -> Column:
        term = state["term"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.cast("double").alias("term"), (state["total"] + F.exp(term)).cast("double").alias("total"))

    rest = F.when(k < last, F.sequence(k.cast("int") + 1, last.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(k > last, F.lit(0.0)).otherwise(F.aggregate(rest, start, further, lambda s: s["total"]))


def upper_tail(n: Column, k: Column, p: Column) -> Column:
    """``binomial_tail`` with n included, in few terms also for large n.

    Up to the mean the terms below k are taken from 1; above it, terms are left out where all that
    follow are less than e^-60 of the first, far below a double's precision.
    """
    below = k <= n * p
    start = F.when(below, F.lit(0)).otherwise(k)
    end = F.when(below, k - 1).otherwise(F.least(n, F.ceil(k + 12 * F.sqrt(n * p) + 60)))
    odds = F.log(p) - F.log1p(-p)
    first = log_factorial(n) - log_factorial(start) - log_factorial(n - start) + start * F.log(p) + (n - start) * F.log1p(-p)
    state = F.struct(first.cast("double").alias("term"), F.exp(first).cast("double").alias("total"))

    def further(state: Column, i: Column) -> Column:
        term = state["term"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.cast("double").alias("term"), (state["total"] + F.exp(term)).cast("double").alias("total"))

    rest = F.when(start < end, F.sequence(start.cast("int") + 1, end.cast("int"))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(rest, state, further, lambda s: s["total"])
    return F.when(k > n, F.lit(0.0)).when(k <= 0, F.lit(1.0)).when(below, 1 - total).otherwise(total)


def kl_terms(observed: Column, expected: Column) -> Column:
    return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(F.lit(0.0))


def mass_accuracy(error: Column, mean: Column, deviation: Column) -> Column:
    """-10 log10(1 - g) for a Gaussian g of the error."""
    gauss = F.exp(-F.pow(error - mean, F.lit(2.0)) / (2 * deviation * deviation)) * (1 - 1e-9)
    return -10 * F.log10(1 - gauss)


def unexpected_ion(ratio: Column) -> Column:
    return F.when(1 - ratio <= 0, F.lit(20.0)).otherwise(-10 * F.log10(1 - ratio))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i.cast("double") * j.cast("double")), F.lit(0.0), lambda t, v: t + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
