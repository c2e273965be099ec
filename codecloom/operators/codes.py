"""Codec layers to audio tokens. All narrow: no exchange."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecloom.functions.codec import (
    layer_codes,
    layer_frames,
    within_duration,
    without_repeats,
)
from codecloom.layout import TokenLayout
from codecloom.session import small_batches


def filter_duration(df: DataFrame, max_seconds: float | None, length: str = "encoded_len") -> DataFrame:
    predicate = within_duration(F.col(length), max_seconds)
    return df if predicate is None else df.where(predicate)


def within_or_unknown(
    df: DataFrame, max_seconds: float | None, length: str = "encoded_len"
) -> DataFrame:
    """Rows inside the cap and rows without a length: what validation has to look at."""
    predicate = within_duration(F.col(length), max_seconds)
    return df if predicate is None else df.where(predicate | F.col(length).isNull())


def add_frames(df: DataFrame, layout: TokenLayout) -> DataFrame:
    """Column `frames` from the parallel layer arrays."""
    small_batches(df.sparkSession)
    return df.withColumn("frames", layer_frames(layout))


def drop_repeated_frames(df: DataFrame, frames: str = "frames") -> DataFrame:
    return df.withColumn(frames, without_repeats(F.col(frames)))


def add_codes(df: DataFrame, layout: TokenLayout) -> DataFrame:
    """Layers -> frames -> repeated frames dropped -> `codes`; the layer columns are dropped.

    Only ragged rows are made into frames here; the layers of the others go to the worker as they are.
    """
    small_batches(df.sparkSession)
    layers = [F.col(c) for c in layout.layer_columns]
    even = reduce(and_, [c.isNotNull() & (F.size(c) == F.size(layers[0])) for c in layers])
    frames = F.when(~F.coalesce(even, F.lit(False)), layer_frames(layout))
    return df.withColumn("codes", layer_codes(layout)(*layers, frames)).drop("frames", *layout.layer_columns)


def nonempty_codes(df: DataFrame, codes: str = "codes") -> DataFrame:
    """Drop rows whose codes are NULL or empty.

    Dropping repeats never empties a row, so a plan that checks the layer arrays first (as
    `accepted` does) does not need this filter on the computed column.
    """
    return df.where(F.size(codes) > 0)
