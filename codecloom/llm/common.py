"""Reading tables, the shared folder, and Arrow batches in bounded slices."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codecloom.session import shared_path

# Stands for a NULL id where an order is needed: such rows come last.
LAST_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: computed once, safe from lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_name(base: str, taken: Iterable[str]) -> str:
    """`base`, led by as many underscores as it takes to be none of the names (whatever their case)."""
    held = {name.lower() for name in taken}
    while base.lower() in held:
        base = f"_{base}"
    return base


def with_place(df: DataFrame, name: str) -> DataFrame:
    """`df` with its rows numbered from 0 in the order in which its files hold them.

    Spark numbers files by the task that wrote them. A table that was not read from files is numbered
    in the order of its partitions. `name` must be new; other columns keep their names and values. The
    starts of the files are added up in Spark (a row a file) and joined as the planner sees fit.
    """
    if df.inputFiles():
        path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    else:
        path = F.spark_partition_id().cast("string")
        row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    file, inside = (fresh_name(n, [*df.columns, name]) for n in ("file", "inside"))
    numbered = df.select("*", path.alias(file), row.alias(inside))
    written_by = F.regexp_extract(F.substring_index(file, "/", -1), "^(?:part-)?([0-9]+)", 1)
    order = F.coalesce(F.expr(f"try_cast(`{name}` AS bigint)"), F.lit(0))
    sizes = numbered.groupBy(file).agg(F.count(F.lit(1)).alias("n")).withColumn(name, written_by)
    earlier = Window.orderBy(order, file).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(file, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(name))
    # Stored, so that the planner knows its size: it broadcasts it while that is small.
    starts = written(starts, "file-starts")
    place = (F.col(f"s.{name}") + F.col(f"d.{inside}")).alias(name)
    joined = numbered.alias("d").join(starts.alias("s"), F.col(f"d.{file}") == F.col(f"s.{file}"))
    return joined.select(*[F.col(f"d.`{c}`") for c in df.columns], place)


def id_order(col: str) -> Column:
    """An id as a number that sorts NULL last."""
    return F.coalesce(F.col(col).cast("bigint"), F.lit(LAST_ID))


def whole_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text falls on the remainder; false for a NULL id."""
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    return F.coalesce(crc % F.lit(modulus) == F.lit(remainder), F.lit(False))


def slices(
    batches: Iterator[pa.RecordBatch], text: int | None = None, rows: int = 512, size: int = 4 << 20
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice has at most `rows` rows and about `size` bytes of column `text`.

    A single row above the size makes a slice of its own.
    """
    for batch in batches:
        if text is None:
            ends = range(rows, batch.num_rows + rows, rows)
        else:
            lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
            ends, count, held = [], 0, 0
            for i, n in enumerate(lengths):
                if count and (count == rows or held + n > size):
                    ends.append(i)
                    count = held = 0
                count += 1
                held += n
            ends.append(batch.num_rows)
        start = 0
        for end in ends:
            end = min(end, batch.num_rows)
            if end > start:
                yield batch.slice(start, end - start)
            start = end
