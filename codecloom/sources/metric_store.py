"""A metric log that may be written again: one row for each (run, step, batch, metric).

The log is partitioned by run and by blocks of steps. A write first builds the blocks it touches, with
its rows in place of those of the same key, in a staged folder; when that is complete it gets its final
name, and the blocks replace those of the log (dynamic partition overwrite). A job that dies before the
staged folder is complete has changed nothing. One that dies later leaves a complete staged folder, which
the next write, or `recover`, puts in place: doing that twice gives the same log. One writer at a time.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codecloom.sources.files import children, exists, move, remove

LOG_SCHEMA = "step bigint, batch_id bigint, metric string, value double, run_id string, step_block bigint"
KEYS = ("run_id", "step", "batch_id", "metric")
BLOCKS = ("run_id", "step_block")
STEP_BLOCK = 10_000
_READY = "ready-"


def _staged(path: str) -> str:
    return path.rstrip("/") + "_staged"


def _same(left: str, right: str) -> Column:
    pairs = [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in KEYS]
    return reduce(lambda a, b: a & b, pairs)


def _keyed(metrics: DataFrame, block: int) -> DataFrame:
    """Rows in the log's schema, one a key."""
    absent = [F.lit(None).cast("bigint").alias("batch_id")] if "batch_id" not in metrics.columns else []
    rows = metrics.select("*", *absent).select(
        F.col("step").cast("bigint").alias("step"),
        F.col("batch_id").cast("bigint").alias("batch_id"),
        F.col("metric").cast("string").alias("metric"),
        F.col("value").cast("double").alias("value"),
        F.col("run_id").cast("string").alias("run_id"),
    )
    lost = F.col("run_id").isNull() | F.col("step").isNull()
    checked = rows.withColumn("step", F.when(lost, F.raise_error(F.lit("a metric without run or step"))).otherwise(F.col("step")))
    number = F.floor(F.col("step") / F.lit(block)).cast("bigint")
    return checked.groupBy(*KEYS).agg(F.max("value").alias("value")).withColumn("step_block", number)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, step, batch_id, metric, value)."""
    return spark.read.schema(LOG_SCHEMA).parquet(path).select(*KEYS, "value")


def stage_metrics(metrics: DataFrame, path: str, block: int = STEP_BLOCK) -> str:
    """Build the blocks that a write replaces; returns the name of the complete staged folder."""
    spark, name = metrics.sparkSession, uuid.uuid4().hex
    base = _staged(path)
    new_path, building = f"{base}/new-{name}", f"{base}/building-{name}"
    # A block has its rows in one task and one file, else every task writes a file in every block.
    _keyed(metrics, block).repartition(*BLOCKS).write.partitionBy(*BLOCKS).parquet(new_path)
    new = spark.read.schema(LOG_SCHEMA).parquet(new_path)
    merged = new
    if exists(spark, path):
        # Only the touched blocks of the log are read: their partitions are pruned by the join.
        touched = new.select(*BLOCKS).distinct()
        old = spark.read.schema(LOG_SCHEMA).parquet(path).join(touched, list(BLOCKS), "left_semi")
        merged = old.alias("o").join(new.alias("n"), _same("o", "n"), "left_anti").unionByName(new)
    merged.repartition(*BLOCKS).write.partitionBy(*BLOCKS).parquet(building)
    move(spark, building, f"{base}/{_READY}{name}")
    remove(spark, new_path)
    return f"{_READY}{name}"


def apply_staged(spark: SparkSession, path: str, name: str) -> None:
    """Put the blocks of a complete staged folder in place of the log's."""
    staged = f"{_staged(path)}/{name}"
    rows = spark.read.schema(LOG_SCHEMA).parquet(staged)
    if rows.take(1):
        replaced = rows.repartition(*BLOCKS).write.mode("overwrite")
        replaced.option("partitionOverwriteMode", "dynamic").partitionBy(*BLOCKS).parquet(path)
    remove(spark, staged)


def recover(spark: SparkSession, path: str) -> None:
    """Finish complete writes that were not put in place, and forget incomplete ones."""
    for name in children(spark, _staged(path)):
        if name.startswith(_READY):
            apply_staged(spark, path, name)
        else:
            remove(spark, f"{_staged(path)}/{name}")


def write_metrics(metrics: DataFrame, path: str, block: int = STEP_BLOCK) -> None:
    """Write (run_id, step, [batch_id], metric, value); a key that is there already gets the new value.

    `block` must be the same in all writes of a log. Of rows that repeat a key within a write the largest
    value counts (NaN is the largest, NULL only if there is no other). A NULL batch is a key of its own; a
    NULL run or step is an error.
    """
    spark = metrics.sparkSession
    recover(spark, path)
    apply_staged(spark, path, stage_metrics(metrics, path, block))
