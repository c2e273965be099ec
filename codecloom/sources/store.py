"""Write and open prepared corpora and their statistics.

A corpus is a folder: `rows` holds accepted and rejected rows by status, `manifest` one row a file with
its number of rows and a checksum. The manifest is written last, and a folder without one is not opened,
so a job that died in between leaves nothing to read; the next one replaces it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecloom.operators.corpus_stats import length_stats, stats_document
from codecloom.operators.sampling import shuffle_rank
from codecloom.sources.files import LONG_ARRAYS, exists

TRAINING_SCHEMA = (
    "source_ord int, row_file string, row_ord bigint, utt_id string, input_ids array<bigint>, "
    "labels array<bigint>, attention_mask array<bigint>, encoded_len int, "
    "speaker_emb array<float>"
)

COUNTS_SCHEMA = (
    "source_ord int, source string, n_read bigint, n_in_duration bigint, n_rejected bigint, "
    "n_prepared bigint, cap bigint, n_kept bigint, short_of_cap boolean"
)

STATS_SCHEMA = (
    "total_samples bigint, "
    + ", ".join(
        f"{name} struct<mean: double, std: double, min: double, max: double, median: double, "
        "quartiles: struct<q25: double, q50: double, q75: double>>"
        for name in ("duration_seconds", "encoded_length")
    )
)


ROWS_PER_FILE = 1_000_000
ACCEPTED, REJECTED = "accepted", "rejected"
REJECT_SCHEMA = "source_ord int, row_file string, row_ord bigint, utt_id string, source string, reject_reason string"
# What a file's checksum is taken over: narrow columns, so that a check does not read the sequences.
_CHECKED = "source_ord int, row_file string, row_ord bigint, utt_id string, encoded_len int, reject_reason string"
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def _file_facts(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_rows, checksum) of the files under `rows`."""
    rows = spark.read.schema(_CHECKED).parquet(f"{path}/rows")
    file = F.substring_index(F.col("_metadata.file_path"), "/rows/", -1)
    return (
        rows.select(file.alias("file"), F.xxhash64("*").alias("hash"))
        .groupBy("file")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor("hash").alias("checksum"))
    )


def write_rows(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write rows by `status` in one job. An unfinished corpus is replaced, a finished one is an error.

    Each task writes both statuses side by side, so the rows need no sort.
    """
    spark = df.sparkSession
    if exists(spark, f"{path}/manifest"):
        raise FileExistsError(f"there is a corpus at {path}")
    before = spark.conf.get(_WRITERS, None)
    spark.conf.set(_WRITERS, "4")
    try:
        writer = df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
        writer.options(**LONG_ARRAYS).partitionBy("status").parquet(f"{path}/rows")
    finally:
        spark.conf.unset(_WRITERS) if before is None else spark.conf.set(_WRITERS, before)


def write_manifest(spark: SparkSession, path: str) -> None:
    """Declare a corpus finished: a row a file."""
    _file_facts(spark, path).coalesce(1).write.parquet(f"{path}/manifest")


def open_manifest(spark: SparkSession, path: str) -> DataFrame:
    path = path.rstrip("/")
    if not exists(spark, f"{path}/manifest/_SUCCESS"):
        raise FileNotFoundError(f"no finished corpus at {path}")
    return spark.read.schema("file string, n_rows bigint, checksum bigint").parquet(f"{path}/manifest")


def damaged_files(spark: SparkSession, path: str) -> DataFrame:
    """Files whose rows differ from the manifest, that are missing or that it does not name."""
    found = _file_facts(spark, path.rstrip("/")).select(
        "file", F.col("n_rows").alias("n_found"), F.col("checksum").alias("checksum_found")
    )
    both = open_manifest(spark, path).join(found, "file", "full")
    same = F.col("n_rows").eqNullSafe(F.col("n_found")) & F.col("checksum").eqNullSafe(F.col("checksum_found"))
    return both.where(~same)


def save_training(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write prepared rows as a finished corpus. They keep their order columns and need no sort."""
    path = path.rstrip("/")
    write_rows(df.withColumn("status", F.lit(ACCEPTED)), path, rows_per_file)
    write_manifest(df.sparkSession, path)


def _rows(spark: SparkSession, path: str, schema: str, status: str) -> DataFrame:
    open_manifest(spark, path)
    rows = spark.read.schema(f"{schema}, status string").parquet(f"{path.rstrip('/')}/rows")
    return rows.where(F.col("status") == F.lit(status)).drop("status")


def open_training(spark: SparkSession, path: str) -> DataFrame:
    """Open a saved corpus; a missing path, an unfinished or an empty corpus is an error."""
    df = _rows(spark, path, TRAINING_SCHEMA, ACCEPTED)
    if not df.select("encoded_len").limit(1).take(1):
        raise ValueError(f"the corpus at {path} is empty")
    return df


def open_rejects(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a saved corpus that could not be prepared, with the reason."""
    return _rows(spark, path, REJECT_SCHEMA, REJECTED)


def open_counts(spark: SparkSession, path: str) -> DataFrame:
    """The stage counts that were observed while the corpus was written."""
    open_manifest(spark, path)
    return spark.read.schema(COUNTS_SCHEMA).parquet(f"{path.rstrip('/')}/counts")


def load_training(spark: SparkSession, path: str, seed: int, epoch: int = 0) -> DataFrame:
    """Open a saved corpus and give each row its place in the shuffled order of an epoch.

    Sources may share ids, so the order follows the source and the id.
    """
    return shuffle_rank(open_training(spark, path), seed, epoch, keys=("source_ord", "utt_id"))


def save_length_stats(df: DataFrame, path: str) -> bool:
    """Write the statistics document next to the corpus; False when there is no length at all.

    The document is one aggregate row, so a single output file is its natural size.
    """
    rows = stats_document(length_stats(df)).toArrow()
    if not rows.num_rows:
        return False
    df.sparkSession.createDataFrame(rows).coalesce(1).write.mode("overwrite").json(path)
    return True


def read_length_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATS_SCHEMA).json(path)


def flatten_length_stats(document: DataFrame) -> DataFrame:
    """(section, statistic, value) rows of a statistics document."""
    names = ["mean", "std", "min", "max", "median", "quartiles.q25", "quartiles.q50", "quartiles.q75"]
    rows = [
        F.struct(
            F.lit(section).alias("section"),
            F.lit(name.split(".")[-1]).alias("statistic"),
            F.col(f"{section}.{name}").alias("value"),
        )
        for section in ("duration_seconds", "encoded_length")
        for name in names
    ]
    return document.select("total_samples", F.inline(F.array(*rows)))
