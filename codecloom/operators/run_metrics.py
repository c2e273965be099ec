"""Metric logs in long form: (run_id, step, [batch_id], metric, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_PREFIX, EVAL_PREFIX = "metrics/", "eval_metrics/"


def every_steps(df: DataFrame, n: int, step: str = "step") -> DataFrame:
    """Steps divisible by n."""
    return df.where(F.col(step) % F.lit(n) == 0)


def due_reports(
    df: DataFrame, log_steps: int = 100, influence_steps: int = 1000, step: str = "step"
) -> DataFrame:
    """Logged steps, with flags for the costly influence metric and the console report."""
    return every_steps(df, log_steps, step).withColumns(
        {
            "influence_due": F.col(step) % F.lit(influence_steps) == 0,
            "report_due": F.col(step) % F.lit(log_steps * 10) == 0,
        }
    )


def strip_prefix(metric: Column) -> Column:
    return F.replace(metric, F.lit(TRAIN_PREFIX), F.lit(""))


def eval_prefix(metric: Column) -> Column:
    return F.regexp_replace(metric, f"^{TRAIN_PREFIX}", EVAL_PREFIX)


def long_metrics(wide: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per metric with the training prefix; absent values stay NULL."""
    rows = F.array(
        *[
            F.struct(F.lit(TRAIN_PREFIX + m).alias("metric"), F.col(m).cast("double").alias("value"))
            for m in metrics
        ]
    )
    return wide.select(*by, F.inline(rows))


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Append to the metric log."""
    metrics.write.mode("append").parquet(path)


def eval_mean(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of each metric over the evaluated batches. NaN and NULL mean no data and are skipped;
    a metric without any value is left out."""
    value = F.nanvl("value", F.lit(None).cast("double"))
    return (
        log.groupBy(*by, "metric")
        .agg(F.avg(value).alias("value"))
        .where(F.col("value").isNotNull())
    )
