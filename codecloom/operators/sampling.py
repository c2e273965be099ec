"""Caps, shuffles, batches and unions, all reproducible from a seed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecloom.operators.ranking import PREFIX_DIGITS, batch_places, global_rank, group_heads, seeded_cap

KEYS = ("utt_id",)


def source_cap(
    df: DataFrame, max_len: int | None, seed: int = 42, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Seeded sample of at most `max_len` rows of one source; None keeps everything."""
    return df if max_len is None else seeded_cap(df, keys, max_len, seed)


def ordered_union(sources: Sequence[DataFrame]) -> DataFrame:
    """Union all in the given order; duplicates stay, `source_ord` remembers the order."""
    if not sources:
        raise ValueError("no source to union")
    tagged = [df.withColumn("source_ord", F.lit(i)) for i, df in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def in_source_order(df: DataFrame, order: Sequence[str] = ("source_ord", "row_file", "row_ord")) -> DataFrame:
    """Restore config order, then row order inside each source (one range shuffle)."""
    return df.orderBy(*order)


def shuffle_rank(
    df: DataFrame,
    seed: int,
    epoch: int = 0,
    keys: Sequence[str] = KEYS,
    rank_col: str = "shuffle_rank",
    digits: int = PREFIX_DIGITS,
) -> DataFrame:
    """Place of each row in the shuffled order of one epoch."""
    return global_rank(df, keys, f"{seed}:{epoch}", rank_col, digits)


def assign_batches(
    df: DataFrame,
    batch_size: int,
    seed: int,
    epoch: int = 0,
    keys: Sequence[str] = KEYS,
    digits: int = PREFIX_DIGITS,
) -> DataFrame:
    """Shuffle and cut into batches of `batch_size` rows; the last batch may be short.

    Adds `batch_id`, `batch_pos` and the exchange key `batch_chunk` (see `batch_places`).
    """
    return batch_places(df, keys, f"{seed}:{epoch}", batch_size, digits)


def first_batches(df: DataFrame, max_batches: int = 10, batch: str = "batch_id") -> DataFrame:
    """Only the first evaluation batches."""
    return df.where(F.col(batch) < F.lit(max_batches))


def sample_targets(
    targets: DataFrame,
    max_samples: int = 32,
    seed: int = 42,
    keys: Sequence[str] = ("seq_id", "pos"),
    by: Sequence[str] = (),
) -> DataFrame:
    """At most `max_samples` scored positions per audio layer (and per `by` group).

    The first ones in the order of a hash. Prefixes of the hash are counted per group, whole prefixes
    behind the last sample are left out, and rows are numbered within a prefix: no task gets a whole
    layer, whatever the number of samples. `targets` is read twice, once for its keys only.
    """
    return group_heads(targets.where(F.col("layer").isNotNull()), keys, max_samples, [*by, "layer"], seed)
