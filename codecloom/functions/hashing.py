"""Deterministic ordering keys: independent of partitioning, equal on every rerun."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_hash(keys: Sequence[str], seed: int | str) -> Column:
    """md5 of 'seed:key1:key2...'; hex text, so it sorts the same everywhere."""
    parts = [F.lit(str(seed))] + [F.col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts))
