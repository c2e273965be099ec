"""Column expressions that build token sequences, masks, labels and positions.

No lambda here refers to an outer array or to an outer computed value: Catalyst may inline such
a value into the lambda and then compute it once per element.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codecloom.layout import TokenLayout


def language_prompt(text: Column, tag: Column) -> Column:
    return F.when(tag.isNotNull(), F.concat(F.lower(tag), F.lit(": "), text)).otherwise(text)


def _ids(*values: int) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def training_sequence(text_tokens: Column, codes: Column, layout: TokenLayout) -> Column:
    """Human turn with the text, then AI turn with the speech codes."""
    return F.concat(
        _ids(layout.start_of_human),
        text_tokens,
        _ids(layout.end_of_human, layout.start_of_ai, layout.start_of_speech),
        codes,
        _ids(layout.end_of_speech, layout.end_of_ai),
    )


def ones_like(ids: Column) -> Column:
    return F.array_repeat(F.lit(1).cast("bigint"), F.size(ids))


def insert_second(values: Column, item: Column) -> Column:
    """Insert one item at index 1; an empty array stays empty."""
    rest = F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))
    return F.when(F.size(values) > 0, F.concat(F.slice(values, 1, 1), F.array(item), rest)).otherwise(
        values
    )


def speaker_positions(positions: Column) -> Column:
    """Positions after a speaker slot is inserted at index 1: p0, p0+1, then the rest plus 1."""
    rest = F.slice(positions, F.lit(2), F.greatest(F.size(positions) - 1, F.lit(0)))
    moved = F.transform(rest, lambda p: p + F.lit(1.0))
    slot = F.array(F.get(positions, F.lit(0)) + F.lit(1.0))
    return F.when(F.size(positions) > 0, F.concat(F.slice(positions, 1, 1), slot, moved)).otherwise(
        positions
    )


def canonical_positions(
    n_text: Column, n_codes: Column, layout: TokenLayout, audio_step: float = 1.0
) -> Column:
    """Frame-level positions of a `training_sequence` row from its two lengths alone.

    Four marker tokens surround the text in front of the codes and two follow the codes, so the
    positions are 0..p-1, then p + frame * step for the codes, then two more.
    """
    step = F.lit(float(audio_step))
    lead = n_text + F.lit(4)
    n_frames = F.floor(n_codes / F.lit(layout.tokens_per_frame)).cast("int")
    head = F.sequence(F.lit(0), lead - 1).cast("array<double>")
    audio = F.flatten(
        F.zip_with(
            F.array_repeat(lead, n_frames),
            F.sequence(F.lit(0), F.greatest(n_frames - 1, F.lit(0))),
            lambda base, frame: F.array_repeat(base + frame * step, layout.tokens_per_frame),
        )
    )
    end = lead + n_frames * step
    return F.when(n_frames > 0, F.concat(head, audio, F.array(end, end + F.lit(1.0)))).otherwise(
        F.concat(head, F.array(end, end + F.lit(1.0)))
    )
