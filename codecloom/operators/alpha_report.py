"""Reports on the learned rotation factors, one per attention layer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecloom.functions.alpha import alpha_from_weight


def rotation_parameters(params: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Learned rotation weights among named parameters; the layer is the third part of the name."""
    name = F.col("param_name")
    layer = F.get(F.split(name, "\\."), F.lit(2)).cast("int")
    kept = params.where(name.contains("learnable_rope") & name.contains("alpha_weight"))
    weight = F.col("value").cast("double")
    return kept.select(
        *by,
        "param_name",
        layer.alias("layer"),
        weight.alias("weight"),
        alpha_from_weight(weight).alias("alpha"),
    )


def alpha_stats(params: DataFrame, by: Sequence[str] = ("step",)) -> DataFrame:
    """Over layers: mean, min, max and sample std (NULL for a single layer)."""
    return params.groupBy(*by).agg(
        F.avg("alpha").alias("alpha_mean"),
        F.min("alpha").alias("alpha_min"),
        F.max("alpha").alias("alpha_max"),
        F.stddev_samp("alpha").alias("std_samp"),
    )


def alpha_report(params: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Over layers: range, mean and population std of the factor; range and mean of the weight."""
    return params.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_layers"),
        F.min("alpha").alias("alpha_min"),
        F.max("alpha").alias("alpha_max"),
        F.avg("alpha").alias("alpha_mean"),
        F.stddev_pop("alpha").alias("std_pop"),
        F.min("weight").alias("weight_min"),
        F.max("weight").alias("weight_max"),
        F.avg("weight").alias("weight_mean"),
    )


def alpha_metrics(params: DataFrame, by: Sequence[str] = ("step",)) -> DataFrame:
    """Long metric rows of a training step: factor and raw weight of each layer, the gradient norm
    where the table has one (`grad_norm`), and the statistics over layers."""
    layer = F.col("layer").cast("string")

    def row(group: str, name: str, value: str) -> Column:
        label = F.concat(F.lit(f"rope_{group}/layer_"), layer, F.lit(f"/{name}"))
        return F.struct(label.alias("metric"), F.col(value).cast("double").alias("value"))

    rows = [row("alpha", "value", "alpha"), row("alpha", "raw_weight", "weight")]
    if "grad_norm" in params.columns:
        rows.append(row("grad", "norm", "grad_norm"))
    stats = [
        F.struct(F.lit(f"rope_alpha/{name}").alias("metric"), F.col(column).alias("value"))
        for name, column in (
            ("mean", "alpha_mean"), ("min", "alpha_min"), ("max", "alpha_max"), ("std", "std_samp")
        )
    ]
    per_layer = params.select(*by, F.inline(F.array(*rows)))
    overall = alpha_stats(params, by).select(*by, F.inline(F.array(*stats)))
    return per_layer.unionByName(overall).where(F.col("value").isNotNull())


def _layer_order(lexicographic: bool) -> str:
    return "param_name" if lexicographic else "layer"


def layer_order(
    params: DataFrame, by: Sequence[str] = (), lexicographic: bool = False
) -> DataFrame:
    """0-based place of each layer, by number or (as plain name sorting gives) by name.

    A window group is the layers of one model state, a number fixed by the model.
    """
    span = Window.partitionBy(*by, F.lit(0)).orderBy(_layer_order(lexicographic))
    return params.withColumn("place", F.row_number().over(span) - F.lit(1))


def early_late(
    params: DataFrame, by: Sequence[str] = (), lexicographic: bool = False
) -> DataFrame:
    """Mean factor of the first floor(n/2) layers and of the rest; needs two layers or more."""
    everyone = Window.partitionBy(*by, F.lit(0))
    placed = layer_order(params, by, lexicographic).withColumn(
        "__half", F.floor(F.count(F.lit(1)).over(everyone) / F.lit(2))
    )
    early = F.col("place") < F.col("__half")
    return (
        placed.groupBy(*by)
        .agg(
            F.avg(F.when(early, F.col("alpha"))).alias("early_alpha"),
            F.avg(F.when(~early, F.col("alpha"))).alias("late_alpha"),
        )
        .where(F.col("early_alpha").isNotNull())
    )
