"""Column expressions for map distances, information, model costs and log sums."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def haldane(distance: Column, rate: float, low: float = 1e-15, high: float = 0.5) -> Column:
    """Haldane's recombination fraction, (1 - e^(-2dr)) / 2."""
    return F.least(F.greatest(0.5 * (1 - F.exp(-2 * distance * rate)), F.lit(low)), F.lit(high))


def poisson_switch(distance: Column, rate: float, low: float = 1e-15, high: float = 0.5) -> Column:
    """The chance of at least one event, 1 - e^(-dr)."""
    return F.least(F.greatest(1 - F.exp(-distance * rate), F.lit(low)), F.lit(high))


def linear_switch(distance: Column, rate: float, low: float = 1e-15, high: float = 0.5) -> Column:
    """dr, between bounds: the painting's map function."""
    return F.least(F.greatest(distance * rate, F.lit(low)), F.lit(high))


def information(p: Column) -> Column:
    """1 less the entropy of a chance in bits, negative below a half."""
    h = -p * F.log2(p) - (1 - p) * F.log2(1 - p)
    return F.when(p <= 0, -1.0).when(p >= 1, 1.0).otherwise(F.signum(p - 0.5) * (1 - h))


def add_information(a: Column, b: Column) -> Column:
    """(a + b) / (1 + ab), 0 where the denominator vanishes."""
    return F.when(F.abs(a * b + 1) < 1e-9, 0.0).otherwise((a + b) / (1 + a * b))


def from_information(value: Column, steps: int = 60) -> Column:
    """The chance with this information, by halving."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    mid = lambda s: (s["lo"] + s["hi"]) / 2
    halve = lambda s, _: F.struct(F.when(information(mid(s)) < value, mid(s)).otherwise(s["lo"]).alias("lo"), F.when(information(mid(s)) < value, s["hi"]).otherwise(mid(s)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, mid)


def combine_probabilities(first: Column, second: Column, prior: Column) -> Column:
    """Two chances joined as information beyond that of their prior."""
    own = information(prior)
    beyond = lambda p: add_information(information(p), -own)
    return from_information(add_information(add_information(beyond(first), beyond(second)), own))


def log_sum_exp(values: Column) -> Column:
    """ln of the sum of e^x over an array."""
    top = F.array_max(values)
    return top + F.ln(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def log_factorial(n: Column) -> Column:
    """ln n!, by the sum to 16 and Stirling's series beyond (to 1e-13)."""
    x = n.cast("double")
    series = x * F.ln(x) - x + 0.5 * F.ln(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    few = F.element_at(F.array(*[F.lit(math.lgamma(i + 1)) for i in range(17)]), F.least(n, F.lit(16)).cast("int") + 1)
    return F.when(n <= 16, few).otherwise(series)


def log_binomial(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def complexity_cost(scale: float, samples: Column, sites: Column, blocks: Column) -> Column:
    """The cost of one more founder: scale * (sites / 200) * samples * blocks."""
    return scale * (sites / 200.0) * samples * blocks


def outer_bic(k: Column, loss: Column, cost: Column) -> Column:
    return k * cost + 2 * loss


def mixture_bic(log_likelihood: Column, k: Column, features: Column, observations: Column) -> Column:
    return -2 * log_likelihood + (k * features + k - 1) * F.ln(observations)


def log_haplotype_sets(sites: Column, k: Column) -> Column:
    """ln C(2^sites, k), summed term by term."""
    term = lambda s, i: s + F.ln(F.pow(F.lit(2.0), sites) - i) - F.ln(i + 1.0)
    return F.when(k <= 0, 0.0).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(k, F.lit(1)).cast("int") - 1), F.lit(0.0), term))
