"""Row numbers in file order and contiguous shards, without a sort of the rows.

A row's number is the number of rows in the files before its own plus its place in the file. Only the
counts per file are added up; rows are neither shuffled nor sorted. `row_file` and `row_ord` come from the
loader (`load_source` of a Parquet source) and must be those of the unfiltered source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILE_KEYS = ("source_ord", "row_file")


def file_starts(df: DataFrame) -> DataFrame:
    """(source_ord, row_file, file_start, file_rows, source_rows): one row a file."""
    sizes = df.groupBy(*FILE_KEYS).agg(F.count(F.lit(1)).alias("file_rows"))
    whole = Window.partitionBy("source_ord")
    earlier = whole.orderBy("row_file").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        *FILE_KEYS,
        F.coalesce(F.sum("file_rows").over(earlier), F.lit(0)).alias("file_start"),
        "file_rows",
        F.sum("file_rows").over(whole).alias("source_rows"),
    )


def with_row_numbers(df: DataFrame, starts: DataFrame | None = None, number: str = "row_no") -> DataFrame:
    """Add each row's number in its source, from 0 and without gaps.

    The table of starts has a row a file; the planner decides by its size how to join it.
    """
    starts = file_starts(df) if starts is None else starts
    joined = df.join(starts.select(*FILE_KEYS, "file_start"), list(FILE_KEYS))
    return joined.withColumn(number, F.col("file_start") + F.col("row_ord")).drop("file_start")


def shard_start(rows: Column, n: int, i: int) -> Column:
    """First row of shard i of n: sizes differ by one at most, the larger shards come first."""
    extra = rows % F.lit(n)
    return F.lit(i) * F.floor(rows / F.lit(n)).cast("bigint") + F.least(extra, F.lit(i))


def shard(df: DataFrame, n: int, i: int, starts: DataFrame | None = None) -> DataFrame:
    """Shard i of n of every source: a contiguous stretch of its rows, with their numbers.

    Files that hold no row of the stretch drop out in the join.
    """
    if not 0 <= i < n:
        raise ValueError(f"shard {i} of {n}")
    starts = file_starts(df) if starts is None else starts
    first, end = (shard_start(F.col("source_rows"), n, k) for k in (i, i + 1))
    met = starts.withColumns({"first": first, "end": end}).where(
        (F.col("file_start") < F.col("end")) & (F.col("file_start") + F.col("file_rows") > F.col("first"))
    )
    joined = df.join(met.select(*FILE_KEYS, "file_start", "first", "end"), list(FILE_KEYS))
    numbered = joined.withColumn("row_no", F.col("file_start") + F.col("row_ord"))
    inside = (F.col("row_no") >= F.col("first")) & (F.col("row_no") < F.col("end"))
    return numbered.where(inside).drop("file_start", "first", "end")
