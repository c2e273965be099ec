"""Row checks: why a source row cannot be prepared, and counts per stage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecloom.functions.codec import within_duration
from codecloom.layout import TokenLayout


# Lengths are stored as 32-bit numbers.
MAX_LENGTH = 2**31 - 1


def _has_null(layer: Column) -> Column:
    """Whether an array of INT holds a NULL; true for a NULL array.

    A value that is not found among elements of which one is NULL is NULL. Looking for one is a loop over
    numbers; the lambda, which makes an object of each, runs only where it is found or NULL.
    """
    least = F.array_contains(layer, F.lit(-(2**31)))
    return F.coalesce(least & F.exists(layer, lambda x: x.isNull()), F.lit(True))


def reject_reason(layout: TokenLayout) -> Column:
    """First reason why a row is unusable, or NULL for a good row."""
    layers = [F.col(c) for c in layout.layer_columns]
    sizes = [F.size(c) for c in layers]

    def either(conditions: list[Column]) -> Column:
        return reduce(lambda a, b: a | b, conditions)

    return (
        F.when(F.col("encoded_len").isNull(), "null_len")
        .when(F.col("encoded_len") > F.lit(MAX_LENGTH), "long_len")
        .when(F.col("text").isNull(), "null_text")
        .when(either([c.isNull() for c in layers]), "null_layer")
        .when(either([s != sizes[0] for s in sizes[1:]] or [F.lit(False)]), "ragged_layers")
        .when(sizes[0] == 0, "empty_codes")
        .when(either([_has_null(c) for c in layers]), "null_code")
    )


def flag_rows(df: DataFrame, layout: TokenLayout) -> DataFrame:
    return df.withColumn("reject_reason", reject_reason(layout))


def accepted(df: DataFrame, layout: TokenLayout) -> DataFrame:
    """Rows without a reject reason, as separate conditions so that the reader gets what it can."""
    layers = [F.col(c) for c in layout.layer_columns]
    good = df.where(F.col("encoded_len").isNotNull() & F.col("text").isNotNull())
    good = good.where(F.col("encoded_len") <= F.lit(MAX_LENGTH))
    good = good.where(layers[0].isNotNull() & (F.size(layers[0]) > 0))
    for layer in layers[1:]:
        good = good.where(layer.isNotNull() & (F.size(layer) == F.size(layers[0])))
    for layer in layers:
        good = good.where(~_has_null(layer))
    return good


def rejected(df: DataFrame, layout: TokenLayout) -> DataFrame:
    return flag_rows(df, layout).where(F.col("reject_reason").isNotNull())


def reject_summary(df: DataFrame, layout: TokenLayout) -> DataFrame:
    reason = F.coalesce(reject_reason(layout), F.lit("accepted"))
    return df.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))


def stage_counts(
    df: DataFrame,
    layout: TokenLayout,
    max_seconds: float | None,
    by: Sequence[str] = ("source",),
) -> DataFrame:
    """Rows per source: read, after the duration cap, rejected, prepared. One aggregate pass."""
    in_time = within_duration(F.col("encoded_len"), max_seconds)
    in_time = F.lit(True) if in_time is None else in_time
    # A NULL length cannot be compared; such rows count as rejected, not as filtered.
    passes = F.coalesce(in_time, F.lit(True))
    bad = reject_reason(layout).isNotNull()
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_read"),
        F.count_if(passes).alias("n_in_duration"),
        F.count_if(passes & bad).alias("n_rejected"),
        F.count_if(passes & ~bad).alias("n_prepared"),
    )


def collation_checks(batch: DataFrame, speaker_dim: int) -> DataFrame:
    """Per-row verdicts on a collated batch: label width and speaker vector."""
    width_ok = F.size("labels") == F.size("input_ids") + F.when(
        F.col("has_speaker"), F.lit(1)
    ).otherwise(F.lit(0))
    dim = F.when(F.col("speaker_emb").isNotNull(), F.size("speaker_emb"))
    reason = (
        F.when(~width_ok, "label_width")
        .when(dim.isNull(), "no_speaker")
        .when(dim != F.lit(speaker_dim), "speaker_dim")
        .otherwise("ok")
    )
    return batch.withColumn("speaker_dim", dim).withColumn("check", reason)
