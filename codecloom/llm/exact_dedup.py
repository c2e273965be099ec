"""Exact deduplication through an extendible-hash index on shared files, in DataFrame operations only.

A key is the 64-bit hash of a normalised text. The index is a folder with

* `rows`: the hash of every row, with its id,
* `directory`: 2**depth cells, each pointing to a bucket that owns a range of hashes,
* `entries`: one row per distinct text (bucket, hash, chain, chain_length, sha, n_bytes, keep_id, n_rows),
  dealt to owner tasks by bucket and sorted by hash inside it, and
* `chains`: the texts of hashes that several texts share.

The directory comes first. It starts at the depth the number of keys asks for and is doubled while a
bucket holds more than `capacity` distinct keys; only overfull buckets are split. Then every text goes to
the bucket its cell names and is compared there, byte by byte, with the texts under its hash: an equal one
takes it in, a different one makes the chain longer. Copies are combined in each task before they move.

A row finds its entry the same way: cell, bucket, hash. Under a hash with one text that is the entry; along
a longer chain the row's text is compared with each. A row whose cell names another bucket than the one
that took its text finds nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codecloom.llm.common import whole_text, written
from codecloom.session import shared_path

BUCKET_CAPACITY = 1024
MAX_DEPTH = 48
# Cells of 16 bytes that are sent to every task; a larger directory is joined as the planner sees fit.
BROADCAST_CELLS = 1 << 20


def normalised(col: str) -> Column:
    """Every run of ASCII white space as one space; NULL as the empty text.

    A single space is left alone by the pattern, which would put back what it takes.
    """
    return F.regexp_replace(whole_text(col), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def hashed(text: Column, bits: int) -> Column:
    """The first `bits` bits of a text's hash; the others are zero."""
    spare = 64 - bits
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), spare), spare) if spare else F.xxhash64(text)


def text_rows(docs: DataFrame, id_col: str, text_col: str, bits: int) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    return rows.withColumn("hash", hashed(F.col("norm"), bits))


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("hash", 64 - depth) if depth else F.lit(0).cast("bigint")


@dataclass(frozen=True)
class HashIndex:
    """Where an index lies, how deep its directory is, and how many bits its hashes have."""

    path: str
    depth: int
    bits: int = 64

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")

    def entries(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/entries")

    def chains(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/chains")

    def directory(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/directory")

    def routed(self, rows: DataFrame) -> DataFrame:
        """Rows with the bucket their cell of the directory names, in a new column `bucket`."""
        cells = self.directory(rows.sparkSession)
        if cells.count() <= BROADCAST_CELLS:
            cells = F.broadcast(cells)
        return rows.withColumn("cell", _prefix(self.depth)).join(cells, "cell").drop("cell")


def grow_directory(keys: DataFrame, capacity: int = BUCKET_CAPACITY) -> tuple[DataFrame, int]:
    """Buckets (depth, prefix, n_keys) of a column of distinct hashes, and the directory's depth.

    Each round looks only at the keys of buckets that were overfull in the round before.
    """
    total = keys.count()
    depth = max(0, min(MAX_DEPTH, math.floor(math.log2(max(1, total / capacity)))))
    pending, buckets = keys, None
    while True:
        counts = pending.groupBy(_prefix(depth).alias("prefix")).agg(F.count(F.lit(1)).alias("n_keys"))
        counts = written(counts, "hash-buckets")
        last = depth == MAX_DEPTH
        full = counts.where(F.lit(not last) & (F.col("n_keys") > F.lit(capacity)))
        settled = counts.where(F.lit(last) | (F.col("n_keys") <= F.lit(capacity))).select(
            F.lit(depth).alias("depth"), "prefix", "n_keys"
        )
        buckets = settled if buckets is None else buckets.unionByName(settled)
        if full.isEmpty():
            return buckets, depth
        pending = pending.withColumn("prefix", _prefix(depth)).join(
            full.select("prefix"), "prefix", "left_semi"
        )
        pending = pending.select("hash")
        depth += 1


def directory_cells(buckets: DataFrame, depth: int) -> DataFrame:
    """One row per cell of the doubled directory; a bucket of lesser depth owns several cells."""
    width = F.pow(F.lit(2.0), F.lit(depth) - F.col("depth")).cast("bigint")
    cells = F.sequence(F.col("prefix") * width, (F.col("prefix") + F.lit(1)) * width - F.lit(1))
    bucket = F.col("prefix") * F.lit(64) + F.col("depth")
    return buckets.select(bucket.alias("bucket"), F.explode(cells).alias("cell"))


def build_index(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = BUCKET_CAPACITY,
    bits: int = 64,
) -> HashIndex:
    """Index every text of `docs` in a new shared folder. Fewer `bits` of the hash make longer chains."""
    spark = docs.sparkSession
    path = shared_path(spark, "hash-index")
    texts = text_rows(docs, id_col, text_col, bits)
    copies = F.count(F.lit(1)).alias("copies")
    texts.groupBy("id", "hash").agg(copies).write.parquet(f"{path}/rows")
    keys = spark.read.parquet(f"{path}/rows").select("hash").distinct()
    buckets, depth = grow_directory(keys, capacity)
    directory_cells(buckets, depth).write.parquet(f"{path}/directory")
    index = HashIndex(path, depth, bits)
    chain = Window.partitionBy("bucket", "hash")
    (
        index.routed(texts)
        .groupBy("bucket", "hash", "norm")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n_rows"))
        .select(
            "bucket", "hash", F.sha2("norm", 256).alias("sha"), F.octet_length("norm").alias("n_bytes"),
            "keep_id", "n_rows",
        )
        .repartition("bucket")
        .withColumn("chain", F.row_number().over(chain.orderBy("sha")))
        .withColumn("chain_length", F.count(F.lit(1)).over(chain))
        .sortWithinPartitions("bucket", "hash", "chain")
        .write.parquet(f"{path}/entries")
    )
    chained = index.entries(spark).where(F.col("chain_length") > F.lit(1))
    if chained.isEmpty():
        chained.select("bucket", "hash", "chain", F.lit("").alias("norm")).write.parquet(f"{path}/chains")
    else:
        held = texts.join(chained.select("hash").distinct(), "hash").select("hash", "norm").distinct()
        held.withColumn("sha", F.sha2("norm", 256)).join(chained, ["hash", "sha"]).select(
            "bucket", "hash", "chain", "norm"
        ).write.parquet(f"{path}/chains")
    return index


def index_lookup(
    docs: DataFrame, index: HashIndex, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, copies, keep_id, n_rows, sha) of the indexed rows of `docs`, found through the directory."""
    spark = docs.sparkSession
    entries = index.entries(spark)
    facts = ["id", "copies", "keep_id", "n_rows", "sha"]
    alone = entries.where(F.col("chain_length") == F.lit(1))
    found = index.routed(index.rows(spark)).join(alone, ["bucket", "hash"]).select(*facts)
    chains = index.chains(spark)
    if chains.isEmpty():
        return found
    texts = text_rows(docs, id_col, text_col, index.bits).join(chains.select("hash").distinct(), "hash")
    texts = texts.groupBy("id", "hash", "norm").agg(F.count(F.lit(1)).alias("copies"))
    told = index.routed(texts).join(chains, ["bucket", "hash", "norm"])
    return found.unionByName(told.join(entries, ["bucket", "hash", "chain"]).select(*facts))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = BUCKET_CAPACITY,
    bits: int = 64,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the smallest id stays. NULL and empty texts are the same text; NULL ids
    come last, and a group of NULL ids alone keeps one of them. Of rows that repeat an id and a text,
    one is kept. An empty table gives an empty result; other columns are ignored.
    """
    index = build_index(docs, id_col, text_col, capacity, bits)
    copy = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy")
    return (
        index_lookup(docs, index, id_col, text_col)
        .select("id", "keep_id", "n_rows", "sha", copy)
        .select(
            F.col("id").alias(id_col),
            "keep_id",
            F.col("n_rows").alias("group_size"),
            (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == F.lit(1))).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )
