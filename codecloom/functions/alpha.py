"""Learned rotation factor: bounded sigmoid of a raw weight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds of the factor and its value at the start of training.
ALPHA_MIN = 0.1
ALPHA_MAX = 2.0
ALPHA_INIT = 1.05


def alpha_from_weight(weight: Column, low: float = ALPHA_MIN, high: float = ALPHA_MAX) -> Column:
    return F.lit(low) + F.lit(high - low) / (F.lit(1.0) + F.exp(-weight))
