"""Session defaults and the shared folder for written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter for long array rows: adaptive re-planning with skew handling, and
# Arrow batches bounded by bytes as well as rows.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 * 1024 * 1024),
}

_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def local_session(cores: int | str = 8, app: str = "codecloom", memory: str = "12g") -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session you are given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        # Array work is uneven (row lengths vary widely): more, smaller splits balance the cores.
        .config("spark.sql.files.minPartitionNum", str(4 * int(cores)))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit on bytes of an Arrow batch to that of `SETTINGS`; a lower one stays.

    Steps that send long arrays to workers call it: a task holds several batches a function, in the JVM
    outside its heap and in the worker, and a batch may take twice the limit.
    """
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if size(spark.conf.get(_BATCH_BYTES)) > int(SETTINGS[_BATCH_BYTES]):
        spark.conf.set(_BATCH_BYTES, SETTINGS[_BATCH_BYTES])


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder every executor sees, named by `spark.checkpoint.dir`."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="codecloom-")
    return f"{base.rstrip('/')}/codecloom/{name}-{uuid.uuid4().hex}"
