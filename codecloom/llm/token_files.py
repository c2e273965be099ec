"""Token ids in Arrow files of fixed-size lists: equal-length sequences and masks, read without a copy.

Documents are dealt to tasks by ranges of their id and sorted there. A task tokenises its documents
one after another, ends each with `end_id`, cuts the stream into sequences of `width` ids and writes
them in batches of `BATCH_ROWS` to one Arrow file of its own: two columns of fixed-size lists, `ids`
(the smallest unsigned type that holds the vocabulary) and `mask` (true for an id, false for the padding
behind the last id of a file; a bit each). A batch's list values lie side by side, so a sequence, or any run of
ids, is a view of the mapped file.

Files of failed or repeated attempts have names of their own and are in no index. The index (a row a
document: file, first id there, number of ids) and the manifest (a row a file) are Spark tables beside
the files; the manifest is written last.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codecloom.llm.common import id_order, slices, whole_text
from codecloom.llm.token_ids import SLICE_BYTES, SLICE_ROWS, encoder, vocabulary_size

WIDTH = 2048
END_ID = 2
BATCH_ROWS = 256
OPEN_FILES = 8


def filesystem(uri: str):
    """(file system, path) of a path or URI that pyarrow can open on every executor."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def sequence_schema(dtype: str, width: int) -> pa.Schema:
    ids = pa.from_numpy_dtype(np.dtype(dtype))
    return pa.schema([("ids", pa.list_(ids, width)), ("mask", pa.list_(pa.bool_(), width))])


class SequenceWriter:
    """Cuts a stream of ids into sequences and writes them in batches of equal size."""

    def __init__(self, uri: str, dtype: str, width: int):
        self.dtype, self.width = np.dtype(dtype), width
        self.schema = sequence_schema(dtype, width)
        files, path = filesystem(uri)
        self.sink = files.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.waiting = self.n_ids = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.waiting += len(ids)
        self.n_ids += len(ids)
        full = BATCH_ROWS * self.width
        if self.waiting >= full:
            flat = np.concatenate(self.held)
            whole = len(flat) // full * full
            for start in range(0, whole, full):
                self._batch(flat[start : start + full], full)
            self.held = [flat[whole:]]
            self.waiting = len(flat) - whole

    def _batch(self, ids: np.ndarray, n: int) -> None:
        """Write a batch whose first `n` ids are real."""
        mask = np.arange(len(ids)) < n
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(values), self.width) for values in (ids, mask)
        ]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.waiting:
            flat = np.concatenate(self.held)
            padded = np.zeros(-(-len(flat) // self.width) * self.width, dtype=self.dtype)
            padded[: len(flat)] = flat
            self._batch(padded, len(flat))
        self.writer.close()
        self.sink.close()


class TokenFile:
    """One file: sequences by number and runs of ids by place, as views of the mapped file."""

    def __init__(self, uri: str):
        files, path = filesystem(uri)
        local = files.type_name == "local"
        self.source = pa.memory_map(path) if local else files.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.width = self.reader.schema.field("ids").type.list_size
        self._at, self._batch = -1, (np.zeros(0), pa.array([], pa.bool_()))

    def _values(self, batch: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """All ids and masks of a batch."""
        if batch != self._at:
            held = self.reader.get_batch(batch)
            ids = held.column(0).flatten().to_numpy(zero_copy_only=True)
            self._at, self._batch = batch, (ids, held.column(1).flatten())
        return self._batch

    def __len__(self) -> int:
        last = self.reader.num_record_batches - 1
        return 0 if last < 0 else last * BATCH_ROWS + len(self._values(last)[0]) // self.width

    def sequence(self, number: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """(ids, mask) of a sequence: both refer to the file's bytes."""
        ids, mask = self._values(number // BATCH_ROWS)
        start = number % BATCH_ROWS * self.width
        return ids[start : start + self.width], mask.slice(start, self.width)

    def run(self, first: int, n: int) -> Iterator[np.ndarray]:
        """`n` ids from place `first` on, in views of one batch each."""
        full = BATCH_ROWS * self.width
        while n:
            ids, mask = self._values(first // full)
            start = first % full
            part = min(n, full - start)
            if mask.slice(start, part).true_count != part:
                raise ValueError("a document reaches into the padding of its file")
            yield ids[start : start + part]
            first, n = first + part, n - part


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    end_id: int = END_ID,
) -> None:
    """Write the sequences of all documents in ascending order of their id to `folder`.

    `folder` must be seen by every executor and must not exist. NULL and empty texts are the end id
    alone. NULL ids come last; rows that repeat an id lie side by side in the order of a hash of their
    text. A hot id is spread over tasks by that hash and the place of the row. Other columns are
    ignored; an empty table gives no file and an empty index.
    """
    spark = docs.sparkSession
    folder = folder.rstrip("/")
    dtype = "<u2" if max(vocabulary_size(tokenizer_path), end_id + 1) <= 1 << 16 else "<u4"
    files, path = filesystem(folder)
    files.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        words = encoder(tokenizer_path)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.arrow"
        writer = None
        for batch in slices(batches, text=1, rows=SLICE_ROWS, size=SLICE_BYTES):
            writer = writer or SequenceWriter(f"{folder}/{name}", dtype, width)
            ids, offsets = words.encode(batch.column(1))
            before = writer.n_ids
            writer.add(np.insert(ids, offsets[1:], end_id))
            firsts = before + offsets[:-1] + np.arange(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.full(batch.num_rows, part), pa.int32()),
                    pa.array([name] * batch.num_rows, pa.string()),
                    pa.array(firsts, pa.int64()),
                    pa.array(np.diff(offsets) + 1, pa.int64()),
                ],
                ["id", "part", "file", "first", "n_tokens"],
            )
        if writer:
            writer.close()

    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        whole_text(text_col).alias("text"),
        id_order(id_col).alias("order"),
        F.xxhash64(text_col).alias("mixed"),
        F.monotonically_increasing_id().alias("row"),
    )
    keys = ["order", "mixed", "row"]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "text")
    index = dealt.mapInArrow(run, "id bigint, part int, file string, first bigint, n_tokens bigint")
    index.write.parquet(f"{folder}/index")
    sizes = (
        spark.read.parquet(f"{folder}/index")
        .groupBy("part", "file")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_ids"))
        .withColumn("n_sequences", F.ceil(F.col("n_ids") / F.lit(width)).cast("bigint"))
    )
    # A row a file, in the order of the ranges.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = {
        f"{name}_before": F.coalesce(F.sum(f"n_{name}").over(earlier), F.lit(0)).cast("bigint")
        for name in ("ids", "sequences")
    }
    sizes.withColumns(starts).coalesce(1).write.parquet(f"{folder}/manifest")


def document_places(spark: SparkSession, folder: str) -> DataFrame:
    """(id, file, first, n_tokens, start): where each document lies; `start` counts all ids before it."""
    folder = folder.rstrip("/")
    index = spark.read.schema("id bigint, part int, file string, first bigint, n_tokens bigint")
    manifest = spark.read.schema("part int, ids_before bigint").parquet(f"{folder}/manifest")
    # The planner broadcasts the manifest as long as its files are small.
    return (
        index.parquet(f"{folder}/index")
        .join(manifest, "part")
        .select("id", "file", "first", "n_tokens", (F.col("ids_before") + F.col("first")).alias("start"))
    )


def read_documents(spark: SparkSession, folder: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of every document, from the files.

    The checksum is that of the ids as little-endian unsigned 32-bit integers; `with_ids` adds them as
    bytes. Rows of the index were written in the order of their file, so a task meets few files.
    """
    base = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: OrderedDict[str, TokenFile] = OrderedDict()
        for batch in slices(batches, rows=4096 if not with_ids else 64):
            crcs, kept = [], []
            places = zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))
            for file, first, n in places:
                if file not in opened:
                    opened[file] = TokenFile(f"{base}/{file}")
                    if len(opened) > OPEN_FILES:
                        opened.popitem(last=False)
                crc, parts = 0, []
                for view in opened[file].run(first, n):
                    raw = view.astype("<u4").tobytes()
                    crc = zlib.crc32(raw, crc)
                    if with_ids:
                        parts.append(raw)
                crcs.append(crc)
                kept.append(b"".join(parts))
            columns = [batch.column(0), batch.column(4), batch.column(3), pa.array(crcs, pa.int64())]
            names = ["id", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(kept, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")
    return document_places(spark, base).mapInArrow(run, schema).withColumnRenamed("id", id_col)


class TokenSequences:
    """Random access to all sequences of a folder, in order: `sequences[i]` is (ids, mask).

    Local files are mapped, and the arrays are views of them. Only the manifest (a row a file) is read
    at the start.
    """

    def __init__(self, folder: str):
        import pyarrow.parquet as pq

        self.folder = folder.rstrip("/")
        files, path = filesystem(f"{self.folder}/manifest")
        rows = pq.read_table(path, filesystem=files).sort_by("part")
        self.files = rows.column("file").to_pylist()
        self.before = rows.column("sequences_before").to_pylist()
        self.n = sum(rows.column("n_sequences").to_pylist())
        self.opened: dict[str, TokenFile] = {}

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, number: int) -> tuple[np.ndarray, pa.BooleanArray]:
        if not 0 <= number < self.n:
            raise IndexError(number)
        k = bisect_right(self.before, number) - 1
        name = self.files[k]
        if name not in self.opened:
            self.opened[name] = TokenFile(f"{self.folder}/{name}")
        return self.opened[name].sequence(number - self.before[k])
