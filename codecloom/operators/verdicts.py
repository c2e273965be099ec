"""Threshold verdicts on metric tables: (by, subject, metric, value, verdict, passed).

All inequalities are strict. NULL means no data. Each rule is an array of verdict rows computed
from a metric row, so a report over many rules reads the metric row once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecloom.functions.alpha import ALPHA_INIT


@dataclass(frozen=True)
class Thresholds:
    # Default limits of the verdicts.
    ppl_variance: float = 0.1
    output_variance: float = 1.5
    same_layer: float = 0.6
    cross_layer: float = 0.2
    confusion_diagonal: float = 0.8
    alpha_unchanged: float = 0.01
    alpha_pattern: float = 0.05


DEFAULTS = Thresholds()


def _row(subject: Column | str, metric: str, value: Column, word: Column, passed: Column) -> Column:
    return F.struct(
        (F.lit(subject) if isinstance(subject, str) else subject).alias("subject"),
        F.lit(metric).alias("metric"),
        value.cast("double").alias("value"),
        F.when(value.isNull(), "No data").otherwise(word).alias("verdict"),
        F.when(value.isNotNull(), passed).alias("passed"),
    )


def _with_data(rows: Column) -> Column:
    return F.filter(rows, lambda r: r["value"].isNotNull())


def _layer_name(layer: Column) -> Column:
    return F.concat(F.lit("layer_"), layer.cast("string"))


def _perplexity_row(layer: Column, ppl: Column) -> Column:
    word = (
        F.when(ppl < 50.0, "Excellent")
        .when(ppl < 100.0, "Good")
        .when(ppl < 200.0, "Acceptable")
        .otherwise("Poor")
    )
    return _row(_layer_name(layer), "ppl", ppl, word, ppl < 200.0)


def _isolation_rows(limits: Thresholds) -> Column:
    value = F.col("ppl_variance")
    good = value < F.lit(limits.ppl_variance)
    word = F.when(good, "Good layer isolation").otherwise("High variance")
    return _with_data(F.array(_row("all_layers", "ppl_variance", value, word, good)))


def _variance_rows(limits: Thresholds) -> Column:
    value = F.col("avg_output_variance")
    word = (
        F.when(value > 2.0, "Excellent")
        .when(value > F.lit(limits.output_variance), "Good")
        .when(value > 1.0, "Acceptable")
        .otherwise("Poor")
    )
    return F.array(_row("outputs", "avg_output_variance", value, word, value > 1.0))


def _confusion_rows(limits: Thresholds) -> Column:
    value = F.col("min_diagonal")
    word = (
        F.when(value > F.lit(limits.confusion_diagonal), "Excellent")
        .when(value > 0.6, "Good")
        .otherwise("Poor")
    )
    return F.array(_row("diagonal", "min_diagonal", value, word, value > 0.6))


def _overall_rows(limits: Thresholds) -> Column:
    ppl, out, diag = F.col("ppl_variance"), F.col("avg_output_variance"), F.col("min_diagonal")
    checks = [
        ("ppl_variance", ppl, ppl < F.lit(limits.ppl_variance), "consistent", "too high"),
        ("avg_output_variance", out, out > F.lit(limits.output_variance), "focused", "too diffuse"),
        ("min_diagonal", diag, diag > F.lit(limits.confusion_diagonal), "excellent", "poor"),
    ]
    rows = [
        _row("overall", name, value, F.when(ok, yes).otherwise(no), ok)
        for name, value, ok, yes, no in checks
    ]
    return _with_data(F.array(*rows))


def perplexity_verdicts(layer_ppl: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    row = _perplexity_row(F.col("layer"), F.col("ppl"))
    return layer_ppl.select(*by, F.inline(F.array(row)))


def isolation_verdict(
    summary: DataFrame, by: Sequence[str] = (), limits: Thresholds = DEFAULTS
) -> DataFrame:
    """Spread of the perplexity over layers; nothing is said without data."""
    return summary.select(*by, F.inline(_isolation_rows(limits)))


def variance_verdict(
    stats: DataFrame, by: Sequence[str] = (), limits: Thresholds = DEFAULTS
) -> DataFrame:
    return stats.select(*by, F.inline(_variance_rows(limits)))


def confusion_verdict(
    summary: DataFrame, by: Sequence[str] = (), limits: Thresholds = DEFAULTS
) -> DataFrame:
    """Judged on the minimum of the diagonal, not on its mean."""
    return summary.select(*by, F.inline(_confusion_rows(limits)))


def overall_assessment(
    metrics: DataFrame, by: Sequence[str] = (), limits: Thresholds = DEFAULTS
) -> DataFrame:
    """Three checks on a wide metric row; a metric without data gives no line."""
    return metrics.select(*by, F.inline(_overall_rows(limits)))


def full_report(
    metrics: DataFrame, by: Sequence[str] = (), limits: Thresholds = DEFAULTS
) -> DataFrame:
    """Every verdict on a wide metric row (`ppl` holds the perplexities by layer)."""
    layers = F.transform("ppl", lambda ppl, layer: _perplexity_row(layer, ppl))
    rows = F.concat(
        layers,
        _isolation_rows(limits),
        _variance_rows(limits),
        _confusion_rows(limits),
        _overall_rows(limits),
    )
    return metrics.select(*by, F.inline(rows))


def influence_verdicts(
    shares: DataFrame, by: Sequence[str] = (), limits: Thresholds = DEFAULTS
) -> DataFrame:
    """Two rows per layer with data: same-layer and cross-layer share."""
    same, cross = F.col("same_layer_influence"), F.col("cross_layer_influence")
    enough, isolated = same > F.lit(limits.same_layer), cross < F.lit(limits.cross_layer)
    subject = _layer_name(F.col("layer"))
    rows = F.array(
        _row(
            subject, "same_layer_influence", same, F.when(enough, "Good").otherwise("Low"), enough
        ),
        _row(
            subject,
            "cross_layer_influence",
            cross,
            F.when(isolated, "Good isolation").otherwise("High cross-layer leak"),
            isolated,
        ),
    )
    return shares.where(same.isNotNull()).select(*by, F.inline(rows))


def alpha_changes(
    params: DataFrame, by: Sequence[str] = (), limits: Thresholds = DEFAULTS
) -> DataFrame:
    """Change of each factor from its starting value."""
    delta = F.col("alpha") - F.lit(ALPHA_INIT)
    word = (
        F.when(F.abs(delta) < F.lit(limits.alpha_unchanged), "no change")
        .when(delta > 0.0, "up")
        .otherwise("down")
    )
    return params.select(*by, "layer", "alpha", delta.alias("change"), word.alias("verdict"))


def alpha_pattern(
    halves: DataFrame, by: Sequence[str] = (), limits: Thresholds = DEFAULTS
) -> DataFrame:
    early, late, gap = F.col("early_alpha"), F.col("late_alpha"), F.lit(limits.alpha_pattern)
    word = (
        F.when(early > late + gap, "early-stronger")
        .when(late > early + gap, "late-stronger")
        .otherwise("similar")
    )
    return halves.select(*by, "early_alpha", "late_alpha", word.alias("pattern"))
