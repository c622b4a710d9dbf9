"""Random variates as expressions over seeded uniform columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(low: float, high: float, seed: int) -> Column:
    return F.rand(seed) * (high - low) + low


def dirac(value: float) -> Column:
    return F.lit(float(value))


def normal(mean: float, deviation: float, seed: int) -> Column:
    return F.randn(seed) * deviation + mean


def chi2(degrees: int, seed: int) -> Column:
    out = F.lit(0.0)
    for i in range(degrees):
        out = out + F.pow(F.randn(seed + i), 2)
    return out


def log_normal(mean: float, deviation: float, seed: int) -> Column:
    return F.exp(normal(mean, deviation, seed))


def exponential(rate: float, seed: int) -> Column:
    return -F.log(F.lit(1.0) - F.rand(seed)) / rate


def triangular(low: float, mode: float, high: float, seed: int) -> Column:
    u, turn = F.rand(seed), (mode - low) / (high - low)
    return F.when(u < turn, low + F.sqrt(u * (high - low) * (mode - low))).otherwise(high - F.sqrt((1 - u) * (high - low) * (high - mode)))


def symmetric_triangular(low: float, high: float, seed: int) -> Column:
    return triangular(low, (low + high) / 2, high, seed)


def beta(a: int, b: int, seed: int) -> Column:
    """For whole a and b: by sums of exponential variates."""
    x, y = F.lit(0.0), F.lit(0.0)
    for i in range(a):
        x = x + exponential(1.0, seed + i)
    for i in range(b):
        y = y + exponential(1.0, seed + a + i)
    return x / (x + y)


def cauchy(place: float, scale: float, seed: int) -> Column:
    return place + scale * F.tan(math.pi * (F.rand(seed) - 0.5))


def weibull(scale: float, shape: float, seed: int) -> Column:
    return scale * F.pow(-F.log(F.lit(1.0) - F.rand(seed)), 1.0 / shape)


def rand_int(low: int, high: int, seed: int) -> Column:
    """Whole numbers from low to high, both included."""
    return (F.floor(F.rand(seed) * (high - low + 1)) + low).cast("int")


def rand_string(length: int, seed: int) -> Column:
    letters = "abcdefghijklmnopqrstuvwxyz"
    return F.concat(*[F.substr(F.lit(letters), rand_int(1, 26, seed + i), F.lit(1)) for i in range(length)])
