"""Line deduplication across documents with levelled sorted runs of line hashes.

Documents come in batches of ascending ids. A batch's distinct line keys are merge-anti-joined with
the runs of earlier batches; what is new becomes a run of its own, which holds for each key the first
document. When a level has `fanout` runs they are compacted into one run of the next level. A run is
a table bucketed and sorted by the hash, so a join with it moves the batch only.

Keys are 128-bit hashes. A document's fate needs the first document of each of its keys, so equal
lines meet as keys combined in each task, and the one join of all lines with the runs is between two
shuffles, whose hot partitions Spark splits.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codecloom.llm.common import LAST_ID, id_order, slices, whole_text, written
from codecloom.session import shared_path

STRIPPED = " \t\n\v\f\r"
LOWER = {c: c + 32 for c in range(65, 91)}
MIN_POINTS = 10
BATCHES = 4
FANOUT = 2


def line_key(line: str, min_points: int = MIN_POINTS) -> bytes | None:
    """The 128-bit hash of a stripped, A-Z lower-cased line; None for a line that is too short."""
    if len(line) < min_points:
        return None
    line = line.strip(STRIPPED)
    if len(line) < min_points:
        return None
    return xxhash.xxh3_128_digest(line.translate(LOWER).encode("utf-8", "surrogatepass"))


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_points: int) -> DataFrame:
    """(id, hi, lo): the distinct line keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=1):
            ids, his, los = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {line_key(line, min_points) for line in text.split("\n")}
                found.discard(None)
                for digest in found:
                    hi, lo = struct.unpack(">qq", digest)
                    ids.append(key)
                    his.append(hi)
                    los.append(lo)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (ids, his, los)], ["id", "hi", "lo"]
            )

    rows = docs.select(id_order(id_col).alias("id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, "id bigint, hi bigint, lo bigint")


class Runs:
    """The levels of sorted runs; each run is a bucketed table whose files lie in the shared folder."""

    def __init__(self, spark, buckets: int, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def unseen(self, keys: DataFrame) -> DataFrame:
        for level in self.levels:
            for name in level:
                keys = keys.join(self.spark.table(name).select("hi", "lo"), ["hi", "lo"], "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """Write new keys as a run of level 0, then compact every level that is full."""
        self._push(0, self._write(keys))

    def _push(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = None
            for run in full:
                part = self.spark.table(run)
                merged = part if merged is None else merged.unionByName(part)
            compacted = self._write(merged)
            for run in full:
                self._forget(run)
            self._push(level + 1, compacted)

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = shared_path(self.spark, "line-run")
        (
            keys.select("hi", "lo", "first")
            .repartition(self.buckets, "hi", "lo")
            .write.bucketBy(self.buckets, "hi", "lo")
            .sortBy("hi", "lo")
            .option("path", self.paths[name])
            .saveAsTable(name)
        )
        return name

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")  # external: the entry of the catalog only

    def rows(self) -> DataFrame:
        """All runs as plain files, for joins in which the other side is skewed."""
        paths = [self.paths[name] for level in self.levels for name in level]
        return self.spark.read.schema("hi bigint, lo bigint, first bigint").parquet(*paths)

    def close(self) -> None:
        for level in self.levels:
            for name in level:
                self._forget(name)


def batch_bounds(keys: DataFrame, batches: int) -> list[int]:
    """Upper ends of the batches, the last one open; one row of quantiles reaches the driver."""
    parts = [i / batches for i in range(1, batches)]
    row = keys.agg(F.percentile_approx("id", parts, 1000).alias("q")).first()
    return sorted(set(row["q"] or []) - {LAST_ID}) + [LAST_ID]


def first_seen(keys: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> Runs:
    """Feed (id, hi, lo) batch by batch into the runs."""
    spark = keys.sparkSession
    runs = Runs(spark, int(spark.conf.get("spark.sql.shuffle.partitions")), fanout)
    low = None
    for high in batch_bounds(keys, batches):
        part = keys.where(F.col("id") <= F.lit(high))
        part = part if low is None else part.where(F.col("id") > F.lit(low))
        runs.add(runs.unseen(part.groupBy("hi", "lo").agg(F.min("id").alias("first"))))
        low = high
    return runs


def rebuilt(pairs: DataFrame, min_points: int) -> DataFrame:
    """(id, text, drop, others...) -> (id, n_lines, n_dropped, kept, kept_sha256, others...).

    `drop` holds the keys to drop, NULL for none.
    """
    others = pairs.columns[3:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=1):
            counts, dropped, kept = [], [], []
            for text, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines = text.split("\n")
                if drop:
                    gone = set(drop)
                    stay = [x for x in lines if line_key(x, min_points) not in gone]
                else:
                    stay = lines
                counts.append(len(lines))
                dropped.append(len(lines) - len(stay))
                kept.append("\n".join(stay))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(dropped, pa.int64()),
                    pa.array(kept, pa.string()),
                    pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in kept]),
                    *batch.columns[3:],
                ],
                ["id", "n_lines", "n_dropped", "kept", "kept_sha256", *others],
            )

    schema = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("n_lines", T.LongType()),
            T.StructField("n_dropped", T.LongType()),
            T.StructField("kept", T.StringType()),
            T.StructField("kept_sha256", T.StringType()),
            *pairs.schema.fields[3:],
        ]
    )
    return pairs.mapInArrow(run, schema)


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_points: int = MIN_POINTS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(id, n_lines, n_dropped, kept, kept_sha256) and the columns of `carry` for every row.

    A line whose key has `min_points` code points or more and occurs in another document with a
    smaller id is dropped; other lines are joined again by a line feed. NULL and empty texts are one
    empty line. Rows that share an id are one document, NULL ids together are the last document.
    A document that loses all its lines is left with an empty text.
    """
    keys = written(line_keys(docs, id_col, text_col, min_points), "line-keys")
    runs = first_seen(keys, batches, fanout)
    digest = F.concat(
        F.unhex(F.lpad(F.hex("hi"), 16, "0")), F.unhex(F.lpad(F.hex("lo"), 16, "0"))
    )
    later = (
        keys.join(runs.rows(), ["hi", "lo"])
        .where(F.col("first") < F.col("id"))
        .groupBy("id")
        .agg(F.collect_set(digest).alias("drop"))
    )
    later = written(later, "line-drops")
    runs.close()
    pairs = (
        docs.select(
            F.col(id_col).cast("bigint").alias("own"),
            id_order(id_col).alias("id"),
            whole_text(text_col).alias("text"),
            *[F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)],
        )
        .join(later, "id", "left")
        .select("own", "text", "drop", *[f"carried_{i}" for i in range(len(carry))])
    )
    done = rebuilt(pairs, min_points)
    return done.toDF(id_col, *done.columns[1:5], *carry)
