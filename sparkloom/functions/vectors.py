"""Arithmetic on array<double> columns and scalar formulas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def max_abs_error(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def mean_abs_error(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))) / F.size(a)


def allclose(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    close = F.zip_with(a, b, lambda x, y: F.abs(x - y) <= atol + rtol * F.abs(y))
    return (F.size(a) == F.size(b)) & F.forall(close, lambda x: F.coalesce(x, F.lit(False)))


def finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def rms_norm(a: Column, weight: float = 1.0, eps: float = 1e-6) -> Column:
    scale = F.sqrt(dot(a, a) / F.size(a) + eps)
    return F.transform(F.arrays_zip(a.alias("x")), lambda s: s["x"].cast("double") / scale * weight)


def log_sum_exp(a: Column) -> Column:
    """Stable: the largest value is taken out first."""
    top = F.array_max(a)
    return top + F.ln(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def log_add_exp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.ln(1 + F.exp(-F.abs(a - b)))


def softmax(a: Column) -> Column:
    """Stable: the largest value is taken out first."""
    top = F.array_max(a)
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top))
    return F.transform(a, lambda x: F.exp(x.cast("double") - top) / total)


def bce_with_logits(x: Column, target: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) - x * target + F.ln(1 + F.exp(-F.abs(x)))


def depth_weight(depth: Column, gamma: float) -> Column:
    return F.exp(-depth / F.lit(float(gamma)))


def cosine_schedule(step: Column, warmup: int, total: int) -> Column:
    """Linear warm-up, then half a cosine down to zero."""
    rest = F.least(F.greatest((step - warmup) / F.lit(float(max(1, total - warmup))), F.lit(0.0)), F.lit(1.0))
    return F.when(step < warmup, (step + 1) / F.lit(float(max(1, warmup)))).otherwise(0.5 * (1 + F.cos(F.lit(math.pi) * rest)))


def interval(start: Column, end: Column) -> Column:
    """end - start where both are finite, positive and in order; else null."""
    ok = lambda c: c.isNotNull() & ~F.isnan(c) & (c > 0) & (c < float("inf"))
    return F.when(ok(start) & ok(end) & (end >= start), end - start)
