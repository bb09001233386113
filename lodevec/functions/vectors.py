"""Column expressions over arrays of numbers, summed in index order in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def l2_squared(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def distance(metric: str, q: Column, x: Column) -> Column:
    """Exact distance: squared L2, 1 - cosine (0 at least; 1 from a zero vector), or the negative inner product."""
    if metric == "l2":
        return l2_squared(q, x)
    if metric == "ip":
        return -dot(q, x)
    size = norm(q) * norm(x)
    return F.when(size == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - dot(q, x) / F.nullif(size, F.lit(0.0))))


def quantized(value: Column, most: Column, step: Column) -> Column:
    """Code 0..254 on a scale of steps; 255 for what is beyond the scale or not finite; 0 if the scale is empty."""
    odd = F.isnan(value) | (value == INF) | (value > most + 0.5 * step)
    return F.when(odd, 255).when(most <= 0, 0).otherwise(F.least(F.lit(254), F.greatest(F.lit(0), F.round(value / step)))).cast("smallint")


def quantized_error(error: Column) -> Column:
    """Code 0..255 of an error in [0, 2], rounded up; 255 is a value like the others."""
    return F.ceil(F.least(F.lit(2.0), F.greatest(F.lit(0.0), error)) * 127.5 - 1e-7).cast("smallint")


def upper(est: Column, unc: Column, z: float) -> Column:
    """Upper end of an interval: the estimate itself for z = 0 or no uncertainty; nothing is known with an infinite one."""
    if z == 0:
        return F.when(F.isnan(est), INF).otherwise(est)
    end = est + unc * z
    return F.when(unc == 0, est).when((unc == INF) | F.isnan(end), INF).otherwise(end)


def lower(est: Column, unc: Column, z: float) -> Column:
    if z == 0:
        return F.when(F.isnan(est), -INF).otherwise(est)
    end = est - unc * z
    return F.when(unc == 0, est).when((unc == INF) | F.isnan(end), -INF).otherwise(end)
