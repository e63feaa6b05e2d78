"""Arithmetic on vectors and budget histories held in arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_normalize(v: Column) -> Column:
    """The vector over its length, or over 1e-12 if it is shorter; arithmetic in doubles."""
    norm = F.sqrt(dot(v, v))
    return F.element_at(F.transform(F.array(F.greatest(norm, F.lit(1e-12))), lambda n: F.transform(v, lambda x: x.cast("double") / n)), 1)


def ew_weighted_mean(sims: Column, budgets: Column, alpha: float) -> Column:
    """Mean of the similarities with weights alpha^(n-1-j) * budget_j over the n values that both have.

    No values: null. All weights zero: 0.0.
    """
    n = F.least(F.size(sims), F.size(budgets))
    weight = F.transform(F.slice(budgets, F.lit(1), n), lambda b, j: F.pow(F.lit(float(alpha)), (n - 1 - j).cast("double")) * b.cast("double"))
    weighted = F.struct(total(F.zip_with(F.slice(sims, F.lit(1), n), weight, lambda s, w: s.cast("double") * w)).alias("num"), total(weight).alias("den"))
    mean = F.element_at(F.transform(F.array(weighted), lambda s: F.when(s["den"] != 0, s["num"] / s["den"]).otherwise(F.lit(0.0))), 1)
    return F.when(n > 0, mean)


def grid_of(h: Column, w: Column, patch: int = 16, frames: Column | None = None, temporal: int = 2) -> Column:
    """struct(t, h, w): patches of an image, or of a video whose frames are padded up to a multiple of ``temporal``."""
    t = F.lit(1) if frames is None else F.ceil(frames / temporal).cast("int")
    return F.struct(t.alias("t"), F.floor(h / patch).cast("int").alias("h"), F.floor(w / patch).cast("int").alias("w"))


def mm_token_count(grid: Column, merge: int = 2) -> Column:
    return F.floor(grid["t"] * grid["h"] * grid["w"] / (merge * merge)).cast("int")


def is_perfect_square(n: Column) -> Column:
    root = F.floor(F.sqrt(n.cast("double")))
    return (n >= 0) & (root * root == n)
