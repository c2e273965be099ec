"""Evaluation: one wide metric row per group and its long form (`full_report` judges it)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecloom.layout import TokenLayout
from codecloom.operators import scoring as sc
from codecloom.operators.attention_stats import influence_share, output_variance, variance_per_output
from codecloom.operators.run_metrics import TRAIN_PREFIX, eval_mean, long_metrics
from codecloom.operators.sampling import first_batches

SUMMARY_METRICS = (
    "text_ppl",
    "avg_audio_ppl",
    "ppl_variance",
    "ppl_std",
    "ppl_max_diff",
    "avg_diagonal",
    "min_diagonal",
    "avg_off_diagonal",
    "max_off_diagonal",
    "avg_output_variance",
    "min_output_variance",
    "max_output_variance",
)


def metric_row(
    scored: DataFrame, hidden: DataFrame, layout: TokenLayout, by: Sequence[str] = ()
) -> DataFrame:
    """All summary metrics side by side. Positions and hidden vectors are each read once."""
    totals = sc.score_totals(scored, layout, by)
    summary = totals.select(
        *by,
        "loss",
        "ppl",
        "text_ppl",
        *sc.perplexity_columns(),
        "confusion",
        *sc.confusion_columns(layout),
    )
    variance = output_variance(variance_per_output(hidden, by), by)
    if by:
        return summary.join(variance, list(by), "left")
    # Without groups the variance is one row, read as a scalar.
    single = variance.select(F.struct("*").alias("v")).scalar()
    return summary.withColumn("__v", single).select("*", "__v.*").drop("__v")


def layer_columns(layout: TokenLayout) -> dict[str, Column]:
    """Perplexity of each layer and each cell of the confusion, by name."""
    layers = range(layout.num_audio_layers)
    return {f"layer_{k}_ppl": F.col("ppl")[k] for k in layers} | {
        f"confusion_{i}_{j}": sc.confusion_share(layout, i, j) for i in layers for j in layers
    }


def metric_table(row: DataFrame, layout: TokenLayout, by: Sequence[str] = ()) -> DataFrame:
    """Long form of everything in a metric row, layers and confusion cells included."""
    layers = layer_columns(layout)
    return long_metrics(row.withColumns(layers), [*layers, *SUMMARY_METRICS], by)


def batch_evaluation(
    aligned: DataFrame,
    layout: TokenLayout,
    max_batches: int = 10,
    by: Sequence[str] = ("step",),
    batch: str = "batch_id",
) -> DataFrame:
    """(by, metric, value): loss and perplexities of each batch, averaged over the first batches.

    Later batches are left out before their logits are read. A batch without a value for a metric
    does not count in its mean.
    """
    keys = [*by, batch]
    scored = sc.score_aligned(first_batches(aligned, max_batches, batch), layout, by=keys)
    layers = {f"layer_{k}_ppl": F.col("ppl")[k] for k in range(layout.num_audio_layers)}
    totals = sc.score_totals(scored, layout, keys).withColumns(layers)
    return eval_mean(long_metrics(totals, ["loss", "text_ppl", *layers], keys), by)


def whole_evaluation(
    aligned: DataFrame,
    hidden: DataFrame,
    influences: DataFrame,
    layout: TokenLayout,
    max_batches: int = 10,
    by: Sequence[str] = ("step",),
    batch: str = "batch_id",
) -> DataFrame:
    """(by, metric, value): all metrics of each batch, averaged over the first batches.

    Three inputs of different grain, each keyed by (by, batch) and read once: logits with their targets
    (a row a position), hidden vectors (a row a position and output) and classified influences (a row a
    pair, see `influence_by_target`), of which the first batch alone counts. They meet as metric rows, so
    nothing is joined; later batches are left out before their rows are read. A batch without a value for a
    metric does not count in its mean, and a metric without any value is left out.
    """
    keys = [*by, batch]
    scored = sc.score_aligned(first_batches(aligned, max_batches, batch), layout, by=keys)
    totals = sc.score_totals(scored, layout, keys).select(
        *keys, "loss", "ppl", "text_ppl", *sc.perplexity_columns(), "confusion", *sc.confusion_columns(layout)
    )
    named = totals.withColumns(layer_columns(layout))
    from_scores = [m for m in SUMMARY_METRICS if not m.endswith("output_variance")]
    scores = long_metrics(named, ["loss", *layer_columns(layout), *from_scores], keys)
    outputs = variance_per_output(first_batches(hidden, max_batches, batch), keys)
    spread = [m for m in SUMMARY_METRICS if m.endswith("output_variance")]
    variances = long_metrics(output_variance(outputs, keys), spread, keys)
    shares = influence_metrics(influence_share(first_batches(influences, 1, batch), keys), keys)
    return eval_mean(scores.unionByName(variances).unionByName(shares), by)


def influence_metrics(shares: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Long form of influence shares; layers without influence have no rows."""
    kinds = ("text_influence", "same_layer_influence", "cross_layer_influence")
    rows = [
        F.struct(
            F.concat(
                F.lit(f"{TRAIN_PREFIX}layer_"), F.col("layer").cast("string"), F.lit(f"_{kind}")
            ).alias("metric"),
            F.col(kind).alias("value"),
        )
        for kind in kinds
    ]
    return shares.select(*by, F.inline(F.array(*rows)))
