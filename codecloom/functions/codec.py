"""Column expressions on codec layers and frames."""

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codecloom.functions.slices import slices
from codecloom.layout import TokenLayout

# Fixed value: codec frames per second.
FRAMES_PER_SECOND = 12.5

# A worker flattens the frames of an Arrow batch in slices of so many.
FRAMES_PER_SLICE = 1 << 19


def duration_seconds(encoded_len: Column) -> Column:
    return encoded_len / F.lit(FRAMES_PER_SECOND)


def within_duration(encoded_len: Column, max_seconds: float | None) -> Column | None:
    """Predicate for the duration cap; None when the cap is null or 0 (no filter).

    The length is compared with an integer, not divided, so that the parquet reader gets the filter.
    """
    if not max_seconds:
        return None
    return encoded_len <= F.lit(int(math.floor(FRAMES_PER_SECOND * max_seconds)))


def layer_frames(layout: TokenLayout) -> Column:
    """Parallel layer arrays -> array of frames (one struct field per layer)."""
    return F.arrays_zip(*[F.col(c) for c in layout.layer_columns])


def without_repeats(frames: Column) -> Column:
    """Drop each frame that equals the one just before it in every layer.

    Every frame is zipped with its predecessor, so the lambda reads nothing but its arguments. An
    index form that reads `frames` inside the lambda is as fast on a stored column, but becomes
    quadratic as soon as the optimizer inlines a computed array there, for example while pushing
    a filter on the result down.
    """
    first = F.array(F.get(frames, F.lit(-1)))  # a NULL frame of the right type
    marked = F.zip_with(
        frames,
        F.concat(first, frames),
        lambda frame, previous: F.when(frame.isNull() | (frame == previous), F.lit(None)).otherwise(frame),
    )
    return F.filter(marked, lambda frame: frame.isNotNull())


def shift_layers(frames: Column, layout: TokenLayout) -> Column:
    """Move layer k into its own code range by adding k codebook sizes, in Arrow batches."""
    names = list(layout.layer_columns)
    shifts = [k * layout.audio_codebook_size for k in range(len(names))]
    kind = T.StructType([T.StructField(name, T.LongType()) for name in names])

    @F.arrow_udf(T.ArrayType(kind))
    def shifted(rows: pa.Array) -> pa.Array:
        given = rows.flatten()
        fields = dict(zip([f.name for f in given.type], given.flatten(), strict=True))
        moved = [pc.add(fields[name].cast(pa.int64()), shift) for name, shift in zip(names, shifts, strict=True)]
        offsets = rows.offsets.to_numpy() - rows.offsets[0].as_py()
        mask = rows.is_null() if rows.null_count else None
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(moved, names), mask=mask)

    return shifted(frames)


def frame_texts(frames: Column, layout: TokenLayout) -> Column:
    """Frames as text, "a,b,c,d;a,b,c,d", in Arrow batches; NULL codes and NULL frames leave nothing."""
    names = list(layout.layer_columns)
    cut = slices(FRAMES_PER_SLICE)

    @F.arrow_udf(T.StringType())
    def texts(whole: pa.Array) -> pa.Array:
        found = []
        for rows in cut(whole, np.diff(whole.offsets.to_numpy())):
            given = rows.flatten()
            fields = dict(zip([f.name for f in given.type], given.flatten(), strict=True))
            parts = [fields[name].cast(pa.string()) for name in names]
            if any(p.null_count for p in parts):
                # Led by a part that is never NULL: Arrow loses rows without any part.
                lead = pa.array(np.full(len(given), ""), pa.string())
                each = pc.binary_join_element_wise(lead, *parts, ",", null_handling="skip")
                each = pc.utf8_slice_codeunits(each, 1)
            else:
                each = pc.binary_join_element_wise(*parts, ",")
            offsets = rows.offsets.to_numpy() - rows.offsets[0].as_py()
            mask = rows.is_null() if rows.null_count else None
            found.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), each, mask=mask), ";"))
        return pa.concat_arrays(found) if found else pa.array([], pa.string())

    return texts(frames)


def frame_tokens(frames: Column, layout: TokenLayout) -> Column:
    """Raw frames -> flat audio token ids, frame by frame; the layer shift is folded in."""
    names = layout.layer_columns

    def ids(frame: Column) -> Column:
        return F.array(
            *[
                frame[name].cast("bigint") + F.lit(layout.layer_start(k))
                for k, name in enumerate(names)
            ]
        )

    return F.flatten(F.transform(frames, ids))


def layer_codes(layout: TokenLayout) -> Callable[..., Column]:
    """Arrow function of the layers and of the frames of ragged rows: `frame_tokens` of `without_repeats`.

    Rows whose layers are of one length need no frames, which are an object each: their last argument is
    not looked at. It takes a batch at a time, like the tokenizer: Spark then calls both in one step with
    one worker.
    """
    starts = [layout.layer_start(k) for k in range(len(layout.layer_columns))]
    cut = slices(FRAMES_PER_SLICE)

    def flat(offsets: np.ndarray, fields: list[pa.Array], gone: np.ndarray, mask: pa.Array | None) -> pa.Array:
        fresh = np.zeros(len(gone) + 1, dtype=bool)
        fresh[offsets[:-1]] = True
        fresh = fresh[:-1]
        fresh[1:] |= gone[:-1]
        values, absent = [], []
        for field in fields:
            value = field.fill_null(0).to_numpy(zero_copy_only=False)
            fresh[1:] |= value[1:] != value[:-1]
            null = field.is_null().to_numpy(zero_copy_only=False) if field.null_count else None
            if null is not None:
                fresh[1:] |= null[1:] != null[:-1]
            values.append(value)
            absent.append(null)
        kept = fresh & ~gone
        at = np.flatnonzero(kept)
        ids = np.empty((len(at), len(starts)), dtype=np.int64)
        for k, (value, start) in enumerate(zip(values, starts, strict=True)):
            np.add(value[at], start, out=ids[:, k], dtype=np.int64)
        nulls = None
        if any(a is not None for a in absent):
            nulls = np.stack([np.zeros(len(ids), dtype=bool) if a is None else a[kept] for a in absent], axis=1).ravel()
        ends = np.concatenate([[0], np.cumsum(kept)])[offsets] * len(starts)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.ravel(), mask=nulls), mask=mask)

    def of_layers(layers: list[pa.Array], sizes: np.ndarray) -> list[pa.Array]:
        found = []
        for part in cut(pa.array(np.arange(len(sizes))), sizes):
            rows = [x.slice(part[0].as_py(), len(part)) for x in layers]
            offsets = rows[0].offsets.to_numpy() - rows[0].offsets[0].as_py()
            found.append(flat(offsets, [x.flatten() for x in rows], np.zeros(offsets[-1], dtype=bool), None))
        return found

    def of_frames(frames: pa.Array) -> list[pa.Array]:
        found = []
        for rows in cut(frames, np.diff(frames.offsets.to_numpy())):
            given = rows.flatten()
            offsets = rows.offsets.to_numpy() - rows.offsets[0].as_py()
            gone = given.is_null().to_numpy(zero_copy_only=False)
            found.append(flat(offsets, given.flatten(), gone, rows.is_null() if rows.null_count else None))
        return found

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def codes(*given: pa.Array) -> pa.Array:
        none, layers, frames = pa.array([], pa.list_(pa.int64())), given[:-1], given[-1]
        sizes = [np.diff(x.offsets.to_numpy()) for x in layers]
        even = np.ones(len(frames), dtype=bool)
        for x, size in zip(layers, sizes, strict=True):
            even &= x.is_valid().to_numpy(zero_copy_only=False) & (size == sizes[0])
        if even.all():
            return pa.concat_arrays([none, *of_layers(layers, sizes[0])])
        apart = [x.filter(pa.array(even)) for x in layers]
        found = [*of_layers(apart, sizes[0][even]), *of_frames(frames.filter(pa.array(~even)))]
        place = np.empty(len(even), dtype=np.int64)
        place[np.concatenate([np.flatnonzero(even), np.flatnonzero(~even)])] = np.arange(len(even))
        return pa.concat_arrays([none, *found]).take(pa.array(place))

    return codes
