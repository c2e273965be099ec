"""Folders of any Hadoop file system, seen from the driver: a few calls a job, none a row."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Row groups of long arrays are kept small: a writer holds one in memory, a reader decodes as many rows
# of one as fit its batch, and codes and ids take many times their size in the file, however well they
# compress. So their rows are limited, too.
ROW_GROUP_BYTES = 16 << 20
ROW_GROUP_ROWS = 64
LONG_ARRAYS = {
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.block.row.count.limit": str(ROW_GROUP_ROWS),
    "compression": "zstd",
}


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _folder(spark, path)
    return files.exists(place)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    files, place = _folder(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def move(spark: SparkSession, source: str, target: str) -> None:
    files, place = _folder(spark, source)
    if not files.rename(place, _folder(spark, target)[1]):
        raise OSError(f"{source} could not be renamed to {target}")


def remove(spark: SparkSession, path: str) -> None:
    files, place = _folder(spark, path)
    files.delete(place, True)
