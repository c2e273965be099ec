"""Exact global ranks and exact seeded caps without gathering rows in one task.

Both work on a hash prefix. The md5 prefix of a unique key spreads rows evenly whatever the data
looks like, and the number of prefixes is fixed, so the table of counts per prefix has a size
known in advance. Nothing depends on partitioning, so a lost executor cannot change a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecloom.functions.hashing import order_hash

# 16**4 = 65,536 prefixes: about 150,000 rows each at ten billion rows.
PREFIX_DIGITS = 4

_HASH, _PREFIX, _BEFORE, _COUNT = "__hash", "__prefix", "__before", "__count"


def _with_hash(df: DataFrame, keys: Sequence[str], seed: int | str, digits: int) -> DataFrame:
    return df.withColumn(_HASH, order_hash(keys, seed)).withColumn(
        _PREFIX, F.substring(_HASH, 1, digits)
    )


def _prefix_offsets(hashed: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows in front of each prefix; at most 16**digits rows per group."""
    counts = hashed.groupBy(*groups, _PREFIX).agg(F.count(F.lit(1)).alias(_COUNT))
    # One constant keeps the window definition valid when there is no group column.
    span = (
        Window.partitionBy(*groups, F.lit(0))
        .orderBy(_PREFIX)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return counts.withColumn(_BEFORE, F.coalesce(F.sum(_COUNT).over(span), F.lit(0)))


def global_rank(
    df: DataFrame,
    keys: Sequence[str],
    seed: int | str,
    rank_col: str = "rank",
    digits: int = PREFIX_DIGITS,
) -> DataFrame:
    """Add the 0-based rank of each row in the order (md5(seed:keys), keys).

    `keys` must be unique. One narrow aggregate for the offsets and one shuffle of the rows by
    prefix; the broadcast offsets have at most 16**digits rows.
    """
    hashed = _with_hash(df, keys, seed, digits)
    offsets = _prefix_offsets(hashed.select(_HASH, _PREFIX), []).select(_PREFIX, _BEFORE)
    inner = Window.partitionBy(_PREFIX).orderBy(_HASH, *keys)
    return (
        hashed.join(F.broadcast(offsets), _PREFIX)
        .withColumn(rank_col, F.col(_BEFORE) + F.row_number().over(inner) - F.lit(1))
        .drop(_HASH, _PREFIX, _BEFORE)
    )


def group_heads(
    df: DataFrame,
    keys: Sequence[str],
    n: int,
    groups: Sequence[str],
    seed: int | str = 42,
    digits: int = PREFIX_DIGITS,
) -> DataFrame:
    """The first `n` rows of each group in the order (md5(seed:keys), keys); NULL is a group, too.

    Only prefixes that reach into the first `n` rows are joined and numbered.
    """
    hashed = _with_hash(df, keys, seed, digits)
    offsets = _prefix_offsets(hashed.select(*groups, _HASH, _PREFIX), groups).where(F.col(_BEFORE) < F.lit(n))
    ahead = offsets.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col(_PREFIX).alias("__p"), _BEFORE)
    same = F.col(_PREFIX) == F.col("__p")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    inner = Window.partitionBy(*groups, _PREFIX).orderBy(_HASH, *keys)
    return (
        hashed.join(ahead, same)
        .withColumn("__n", F.col(_BEFORE) + F.row_number().over(inner))
        .where(F.col("__n") <= F.lit(n))
        .select(*df.columns)
    )


def batch_places(
    df: DataFrame,
    keys: Sequence[str],
    seed: int | str,
    size: int,
    digits: int = PREFIX_DIGITS,
) -> DataFrame:
    """Add `batch_id`, `batch_pos` and `batch_chunk`: batches of `size` rows in global rank order.

    The wide rows are moved once. A chunk is one hash prefix, except that the rows which complete
    a batch begun in an earlier prefix join the chunk of that prefix. Every batch then lies inside
    one chunk, and windows over (batch_chunk, batch_id) need no further exchange. Where a prefix
    hands rows over is found on the key columns alone: fewer than `size` rows per prefix take part.
    """
    hashed = _with_hash(df, keys, seed, digits)
    narrow = hashed.select(_HASH, _PREFIX, *keys)
    step = F.lit(size)
    ordered = Window.partitionBy(F.lit(0)).orderBy(_PREFIX)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    # `skip` rows at the head of a prefix belong to a batch that began in the chunk `owner`.
    plan = (
        _prefix_offsets(narrow, [])
        .withColumn("__skip", (step - F.col(_BEFORE) % step) % step)
        .withColumn("__starts", F.col(_COUNT) > F.col("__skip"))
        .withColumn(
            "__owner", F.last(F.when(F.col("__starts"), F.col(_PREFIX)), True).over(earlier)
        )
        .withColumn("__first", ((F.col(_BEFORE) + F.col("__skip")) / step).cast("bigint"))
    )
    head = Window.partitionBy(_PREFIX).orderBy(_HASH, *keys)
    place = F.struct(F.col(_HASH), *[F.col(k) for k in keys])
    heads = (
        narrow.withColumn("__n", F.row_number().over(head))
        .where(F.col("__n") < step)
        .join(F.broadcast(plan.select(_PREFIX, "__skip")), _PREFIX)
        .where(F.col("__n") <= F.col("__skip"))
        .groupBy(_PREFIX)
        .agg(F.max(place).alias("__cut"))
    )
    # Both tables have at most 16**digits rows.
    cuts = plan.select(_PREFIX, "__owner").join(F.broadcast(heads), _PREFIX, "left")
    chunked = hashed.join(F.broadcast(cuts), _PREFIX).withColumn(
        "batch_chunk",
        F.when(place <= F.col("__cut"), F.col("__owner")).otherwise(F.col(_PREFIX)),
    )
    firsts = plan.where("__starts").select(F.col(_PREFIX).alias("batch_chunk"), "__first")
    inner = Window.partitionBy("batch_chunk").orderBy(_HASH, *keys)
    local = F.row_number().over(inner) - F.lit(1)
    return (
        chunked.drop(_PREFIX, _BEFORE, "__cut", "__owner")
        .join(F.broadcast(firsts), "batch_chunk")
        .withColumn("__local", local)
        .withColumn("batch_id", F.col("__first") + F.floor(F.col("__local") / step))
        .withColumn("batch_pos", (F.col("__local") % step).cast("int"))
        .drop(_HASH, "__local", "__first")
    )


def seeded_cut(
    df: DataFrame,
    keys: Sequence[str],
    cap: int,
    seed: int | str = 42,
    digits: int = PREFIX_DIGITS,
) -> Column:
    """Whether a row is among the first `cap` rows of `df` in the order (md5(seed:keys), keys).

    The position of the cap is found on the key columns, first by prefix counts, then inside the one
    prefix that holds it; the condition compares a row with that cut-off, a scalar.
    """
    if cap <= 0:
        return F.lit(False)
    narrow = _with_hash(df, keys, seed, digits).select(_HASH, _PREFIX, *keys)
    edge = _prefix_offsets(narrow, []).where(
        (F.col(_BEFORE) < F.lit(cap)) & (F.col(_BEFORE) + F.col(_COUNT) >= F.lit(cap))
    )
    inner = Window.partitionBy(_PREFIX).orderBy(_HASH, *keys)
    place = F.struct(F.col(_HASH).alias("h"), *[F.col(k) for k in keys])
    cutoff = (
        narrow.join(F.broadcast(edge.select(_PREFIX, _BEFORE)), _PREFIX)
        .withColumn("__n", F.col(_BEFORE) + F.row_number().over(inner))
        .where(F.col("__n") == F.lit(cap))
        .select(place.alias("last"))
    )
    # No row in `cutoff` means the source holds fewer rows than the cap.
    limit = cutoff.agg(F.max("last").alias("last")).scalar()
    own = F.struct(order_hash(keys, seed).alias("h"), *[F.col(k) for k in keys])
    return limit.isNull() | (own <= limit)


def seeded_cap(
    df: DataFrame,
    keys: Sequence[str],
    cap: int,
    seed: int | str = 42,
    digits: int = PREFIX_DIGITS,
) -> DataFrame:
    """Keep the first `cap` rows in the order (md5(seed:keys), keys); all rows if there are fewer.

    The rows themselves are not shuffled or sorted: see `seeded_cut`.
    """
    return df.limit(0) if cap <= 0 else df.where(seeded_cut(df, keys, cap, seed, digits))
