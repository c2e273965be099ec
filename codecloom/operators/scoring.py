"""Metrics from logits and labels: perplexity per layer, layer confusion, loss.

`by` columns (for example run_id, step) are part of the keys everywhere. Positions are aggregated
once, by `score_totals`; every metric is then arithmetic on that one row per group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecloom.functions import vectors
from codecloom.functions.logits import reduce_logits
from codecloom.layout import TokenLayout


def is_scored(label: Column, mask: Column | None, layout: TokenLayout) -> Column:
    """A position counts when its label is not the ignore value and its mask is set."""
    real = label != F.lit(layout.ignore_label)
    return real if mask is None else real & mask.cast("boolean")


def shifted_targets(labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Labels moved one place down: position p gets label and mask of p+1.

    Positions of a sequence are consecutive, so the shift is arithmetic on the key and needs no
    window; the first label drops out, and the last position has no target.
    """
    return labels.where(F.col("pos") > 0).select(
        *by, "seq_id", (F.col("pos") - F.lit(1)).alias("pos"), "label", "mask"
    )


def scored_targets(labels: DataFrame, layout: TokenLayout, by: Sequence[str] = ()) -> DataFrame:
    """Shifted labels that count, with their audio layer and text flag."""
    shifted = shifted_targets(labels, by)
    return (
        shifted.where(is_scored(F.col("label"), F.col("mask"), layout))
        .drop("mask")
        .withColumn("layer", layout.audio_layer(F.col("label")))
        .withColumn("is_text", layout.is_text(F.col("label")))
    )


def score_aligned(
    aligned: DataFrame,
    layout: TokenLayout,
    top_k: int = 5,
    by: Sequence[str] = (),
    wide: bool | None = None,
) -> DataFrame:
    """One row per position: label, layer, nll, topk. The logits end here. No exchange.

    `aligned` has logits and target side by side. A writer that has the labels at hand should
    store its logits like that, or `align_logits` be stored once: then no metric moves logits again.
    """
    reduced = aligned.withColumn(
        "__r", reduce_logits(F.col("logits"), F.col("label"), layout, top_k, wide)
    )
    return reduced.select(
        *by,
        "seq_id",
        "pos",
        "label",
        layout.audio_layer(F.col("label")).alias("layer"),
        layout.is_text(F.col("label")).alias("is_text"),
        F.col("__r.nll").alias("nll"),
        F.col("__r.topk").alias("topk"),
    )


def align_logits(
    logits: DataFrame, labels: DataFrame, layout: TokenLayout, by: Sequence[str] = ()
) -> DataFrame:
    """(by, seq_id, pos, logits, label): logits with their shifted target, scored positions only.

    Keys are (by, seq_id, pos), which no hot sequence can skew. Targets are a few narrow columns;
    the planner broadcasts them when their measured size allows and joins by shuffle otherwise.
    Positions without a partner on the other side drop out; `unmatched_positions` counts them.
    """
    targets = scored_targets(labels, layout, by).drop("layer", "is_text")
    return logits.select(*by, "seq_id", "pos", "logits").join(targets, [*by, "seq_id", "pos"])


def score_positions(
    logits: DataFrame,
    labels: DataFrame,
    layout: TokenLayout,
    top_k: int = 5,
    by: Sequence[str] = (),
    wide: bool | None = None,
) -> DataFrame:
    """`align_logits` and `score_aligned` in one plan, for logits that are scored once."""
    return score_aligned(align_logits(logits, labels, layout, by), layout, top_k, by, wide)


def unmatched_positions(
    logits: DataFrame, labels: DataFrame, layout: TokenLayout, by: Sequence[str] = ()
) -> DataFrame:
    """Scored targets without logits, as when the label sequence is longer than the logits."""
    keys = [*by, "seq_id", "pos"]
    return scored_targets(labels, layout, by).join(logits.select(*keys), keys, "left_anti")


def _layers(layout: TokenLayout) -> range:
    return range(layout.num_audio_layers)


def score_totals(scored: DataFrame, layout: TokenLayout, by: Sequence[str] = ()) -> DataFrame:
    """Everything the metrics need in one aggregation pass, one row per group.

    ppl: perplexity by layer (NULL where a layer has no scored position). confusion[i][j]:
    positions of true layer i with any top id in layer j; a position counts once per predicted
    layer, text and special predictions count nowhere. Conditional aggregates are combined in each
    task, so a layer that holds most rows does not load one task.
    """
    layer, nll = F.col("layer"), F.col("nll")
    predicted = F.transform("topk", layout.audio_layer)
    flagged = scored.withColumn("__pred", F.when(layer.isNotNull(), predicted))
    ppl = [F.exp(F.avg(F.when(layer == F.lit(k), nll))) for k in _layers(layout)]
    counts = [
        F.array(
            *[
                F.count_if((layer == F.lit(i)) & F.array_contains("__pred", F.lit(j)))
                for j in _layers(layout)
            ]
        )
        for i in _layers(layout)
    ]
    return flagged.groupBy(*by).agg(
        F.avg(nll).alias("loss"),
        F.count(nll).alias("n_positions"),
        F.exp(F.avg(F.when(F.col("is_text"), nll))).alias("text_ppl"),
        F.array(*ppl).alias("ppl"),
        F.array(*counts).alias("confusion"),
    )


def layer_perplexity(totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, layer, ppl) for every layer."""
    return totals.select(*by, F.posexplode("ppl").alias("layer", "ppl"))


def text_perplexity(totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return totals.select(*by, "text_ppl")


def lm_loss(totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean cross-entropy over all scored positions: text, special and audio."""
    return totals.select(*by, "loss", "n_positions")


def perplexity_columns() -> list[Column]:
    """Mean, squared coefficient of variation, population std and range over layers with data."""
    ppl = F.col("ppl")
    variance, center = vectors.population_variance(ppl), vectors.mean(ppl)
    return [
        center.alias("avg_audio_ppl"),
        (variance / (center * center)).alias("ppl_variance"),
        F.sqrt(variance).alias("ppl_std"),
        (F.array_max(ppl) - F.array_min(ppl)).alias("ppl_max_diff"),
    ]


def perplexity_summary(totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return totals.select(*by, *perplexity_columns())


def _cells(layout: TokenLayout) -> list[tuple[int, int]]:
    return [(i, j) for i in _layers(layout) for j in _layers(layout)]


def _grid(layout: TokenLayout, name: str, cell: Callable[[int, int], Column]) -> Column:
    rows = [
        F.struct(F.lit(i).alias("true_layer"), F.lit(j).alias("pred_layer"), cell(i, j).alias(name))
        for i, j in _cells(layout)
    ]
    return F.inline(F.array(*rows))


def _count(i: int, j: int) -> Column:
    return F.col("confusion")[i][j]


def confusion_share(layout: TokenLayout, i: int, j: int) -> Column:
    """A cell over its row sum; a row without counts stays zero."""
    total = reduce(lambda a, b: a + b, [_count(i, k) for k in _layers(layout)])
    return F.coalesce(_count(i, j) / F.nullif(total, F.lit(0)), F.lit(0.0))


def layer_confusion(totals: DataFrame, layout: TokenLayout, by: Sequence[str] = ()) -> DataFrame:
    """(by, true_layer, pred_layer, n) for the whole grid."""
    return totals.select(*by, _grid(layout, "n", _count))


def confusion_normalized(
    totals: DataFrame, layout: TokenLayout, by: Sequence[str] = ()
) -> DataFrame:
    return totals.select(*by, _grid(layout, "share", lambda i, j: confusion_share(layout, i, j)))


def confusion_columns(layout: TokenLayout) -> list[Column]:
    """Mean and minimum on the diagonal, mean and maximum off it; empty rows count as zero."""
    diagonal = F.array(*[confusion_share(layout, i, j) for i, j in _cells(layout) if i == j])
    other = F.array(*[confusion_share(layout, i, j) for i, j in _cells(layout) if i != j])
    return [
        vectors.mean(diagonal).alias("avg_diagonal"),
        F.array_min(diagonal).alias("min_diagonal"),
        vectors.mean(other).alias("avg_off_diagonal"),
        F.array_max(other).alias("max_off_diagonal"),
    ]


def confusion_summary(totals: DataFrame, layout: TokenLayout, by: Sequence[str] = ()) -> DataFrame:
    return totals.select(*by, *confusion_columns(layout))
