"""Output variance and token influence, from tables of hidden vectors and gradient sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecloom.functions.vectors import sample_variance
from codecloom.layout import TokenLayout
from codecloom.operators.sampling import sample_targets


def variance_per_output(
    hidden: DataFrame, by: Sequence[str] = (), output: str = "model_layer"
) -> DataFrame:
    """Mean over positions of the variance over components, per recorded output."""
    return hidden.groupBy(*by, output).agg(F.avg(sample_variance(F.col("vec"))).alias("variance"))


def output_variance(per_output: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, minimum and maximum over outputs; NULL when nothing was recorded."""
    return per_output.groupBy(*by).agg(
        F.avg("variance").alias("avg_output_variance"),
        F.min("variance").alias("min_output_variance"),
        F.max("variance").alias("max_output_variance"),
    )


def variance_reports(recorded: DataFrame, reports: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, step, n_values, avg, min, max) of the values recorded since the report before.

    `recorded` has one row (by, step, variance) for each recorded output, `reports` one (by, step) for each
    report, which then starts anew: a value counts in the first report at or after its step, once, and
    values after the last report in none. A report without values has NULL metrics.

    Values are first added up by step. A report covers an interval of steps; both sides meet on buckets of
    steps as wide as the mean interval, of which a report covers few, so no task gets a whole run.
    """
    names = [F.col(c) for c in by]
    steps = (
        recorded.where(F.col("variance").isNotNull())
        .groupBy(*by, "step")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("variance").alias("total"),
            F.min("variance").alias("least"),
            F.max("variance").alias("most"),
        )
    )
    due = reports.select(*by, "step").distinct()
    reach = due.groupBy(*by).agg(F.min("step").alias("lo"), F.max("step").alias("hi"), F.count(F.lit(1)).alias("k"))
    begun = steps.groupBy(*by).agg(F.min("step").alias("begun"))
    if by:
        reach = reach.join(begun, list(by), "left")
    else:
        reach = reach.withColumn("begun", begun.select("begun").scalar())
    lo = F.least("lo", "begun")
    reach = reach.select(
        *by, lo.alias("lo"), F.ceil((F.col("hi") - lo + F.lit(1)) / F.col("k")).cast("bigint").alias("width")
    )
    # A row a report; one constant keeps the window valid without group columns.
    order = Window.partitionBy(*by, F.lit(0)).orderBy("step")
    placed = due.withColumn("before", F.lag("step").over(order))
    placed = placed.join(reach, list(by)) if by else placed.crossJoin(F.broadcast(reach))
    after = F.coalesce(F.col("before") + F.lit(1), F.col("lo"))

    def bucket(step: Column) -> Column:
        return F.floor((step - F.col("lo")) / F.col("width")).cast("bigint")

    covered = placed.select(
        *by,
        F.col("step").alias("report"),
        after.alias("after"),
        F.explode(F.sequence(bucket(after), bucket(F.col("step")))).alias("bucket"),
    )
    numbered = steps.join(reach, list(by)) if by else steps.crossJoin(F.broadcast(reach))
    met = numbered.withColumn("bucket", bucket(F.col("step"))).join(covered, [*by, "bucket"])
    inside = (F.col("step") >= F.col("after")) & (F.col("step") <= F.col("report"))
    summed = (
        met.where(inside)
        .groupBy(*names, F.col("report").alias("step"))
        .agg(
            F.sum("n").alias("n_values"),
            (F.sum("total") / F.sum("n")).alias("avg_output_variance"),
            F.min("least").alias("min_output_variance"),
            F.max("most").alias("max_output_variance"),
        )
    )
    return due.join(summed, [*by, "step"], "left").withColumn("n_values", F.coalesce("n_values", F.lit(0)))


# Positions of a sequence are dealt to tasks in spans of this many.
SPAN = 4096

# A sample is broadcast only if it cannot exceed this many narrow rows.
MAX_BROADCAST_TARGETS = 100_000


def _sampled(
    targets: DataFrame, layout: TokenLayout, max_samples: int, seed: int, by: Sequence[str]
) -> DataFrame:
    """Sampled targets; broadcast where the sampling itself bounds their number.

    With `by` groups the number of groups is unknown and the planner decides.
    """
    chosen = sample_targets(targets, max_samples, seed, by=by).select(*by, "seq_id", "pos", "layer")
    bound = max_samples * layout.num_audio_layers
    return F.broadcast(chosen) if not by and bound <= MAX_BROADCAST_TARGETS else chosen


def past_token_pairs(
    targets: DataFrame,
    sources: DataFrame,
    layout: TokenLayout,
    max_samples: int = 32,
    seed: int = 42,
    by: Sequence[str] = (),
    span: int = SPAN,
) -> DataFrame:
    """Sampled targets with the tokens of their own sequence up to their own position.

    The output is at most `max_samples` times the number of layers times the sequence length per
    group, not all pairs of a sequence. Where a sample cannot be broadcast, both sides meet on spans of a
    sequence: a target is repeated for every span up to its own, so the tokens of a long sequence go to
    many tasks, and positions are compared in the target's own span only.
    """
    past = sources.withColumnRenamed("pos", "src_pos")
    chosen = _sampled(targets, layout, max_samples, seed, by)
    if not by:
        return past.join(chosen, [*by, "seq_id"]).where(F.col("src_pos") <= F.col("pos"))

    def span_of(pos: str) -> Column:
        return F.floor(F.col(pos) / F.lit(span)).cast("bigint")

    first = F.lit(0).cast("bigint")
    reached = chosen.withColumn("__span", F.explode(F.sequence(first, F.greatest(first, span_of("pos")))))
    met = past.withColumn("__span", span_of("src_pos")).join(reached, [*by, "seq_id", "__span"])
    return met.where((F.col("__span") < span_of("pos")) | (F.col("src_pos") <= F.col("pos"))).drop("__span")


def influence_by_target(
    influences: DataFrame,
    targets: DataFrame,
    sources: DataFrame,
    layout: TokenLayout,
    max_samples: int = 32,
    seed: int = 42,
    by: Sequence[str] = (),
) -> DataFrame:
    """Recorded influences on sampled targets, with the target's and the source token's layer.

    Both joins are equi-joins on positions. The sample cuts the influences and, by sequence, the
    source tokens down before these two meet.
    """
    chosen = _sampled(targets, layout, max_samples, seed, by)
    tokens = sources.select(
        *by,
        "seq_id",
        F.col("pos").alias("src_pos"),
        layout.audio_layer(F.col("token_id")).alias("src_layer"),
    ).join(chosen.select(*by, "seq_id"), [*by, "seq_id"], "left_semi")
    kept = influences.join(
        chosen.withColumnRenamed("layer", "target_layer"), [*by, "seq_id", "pos"]
    )
    return kept.join(tokens, [*by, "seq_id", "src_pos"])


def influence_share(classified: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of the influence on a layer that comes from text, the same layer, other layers.

    Text is everything outside the audio layers. Layers with a total of 0 are absent.
    """
    amount, source, target = F.col("influence"), F.col("src_layer"), F.col("target_layer")
    sums = classified.groupBy(*by, "target_layer").agg(
        F.sum(amount).alias("total"),
        F.sum(F.when(source.isNull(), amount).otherwise(0.0)).alias("text"),
        F.sum(F.when(source == target, amount).otherwise(0.0)).alias("same"),
        F.sum(F.when(source != target, amount).otherwise(0.0)).alias("other"),
    )
    total = F.col("total")
    return sums.where(total > 0).select(
        *by,
        F.col("target_layer").alias("layer"),
        (F.col("text") / total).alias("text_influence"),
        (F.col("same") / total).alias("same_layer_influence"),
        (F.col("other") / total).alias("cross_layer_influence"),
    )
