"""Single-pass folds over vectors; no lambda refers to an outer computed value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def moments(vec: Column, finish: Callable[[Column], Column]) -> Column:
    """Fold to struct(n, mean, m2) (count, running mean, sum of squared deviations), then finish.

    NULL components are skipped.
    """
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(acc: Column, x: Column) -> Column:
        value = x.cast("double")
        n = acc["n"] + F.lit(1.0)
        delta = value - acc["mean"]
        mean = acc["mean"] + delta / n
        m2 = acc["m2"] + delta * (value - mean)
        grown = F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"))
        return F.when(x.isNull(), acc).otherwise(grown)

    return F.aggregate(vec, zero, step, finish)


def sample_variance(vec: Column) -> Column:
    """Variance over components, divisor n-1; NULL for fewer than two components."""
    return moments(vec, lambda m: F.when(m["n"] > 1.0, m["m2"] / (m["n"] - F.lit(1.0))))


def mean(vec: Column) -> Column:
    return moments(vec, lambda m: F.when(m["n"] > 0.0, m["mean"]))


def population_variance(vec: Column) -> Column:
    return moments(vec, lambda m: F.when(m["n"] > 0.0, m["m2"] / m["n"]))


def l2_norm(vec: Column) -> Column:
    return F.sqrt(
        F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )
