"""Packing token sequences by first-fit decreasing with a tournament tree, in randomised groups.

Every document is tokenised where it is read; only its lengths and checksums travel. A document
longer than a sequence is cut into full pieces, which fill sequences of their own, and a remainder.
Documents are dealt to groups by a hash of their id, so a group is a random sample of about
`group_docs` documents whatever the sources look like, and the number of groups follows the table.
Where the documents have an order to keep (a mixture), a group is a stretch of `group_docs` places of
it instead, and sequences are numbered along the order.
Inside a group the remainders are placed in descending order, each into the first open sequence with
room: a tournament tree over the sequences' free places finds it in a logarithmic number of steps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codecloom.llm.common import slices, whole_text
from codecloom.llm.token_ids import SLICE_BYTES, SLICE_ROWS, encoder

WIDTH = 2048
END_ID = 1
GROUP_DOCS = 4096
# Sequence ids are group * GROUP_SPAN + number in the group.
GROUP_SPAN = 1 << 32


class TournamentTree:
    """Bins in the order they were opened; the winner of a node is the larger free place below it."""

    def __init__(self, bins: int, width: int):
        self.leaves = 1 << max(0, (max(1, bins) - 1).bit_length())
        self.free = [width] * (2 * self.leaves)
        self.width = width

    def place(self, size: int) -> tuple[int, int]:
        """Take `size` from the first bin with room; returns (bin, offset)."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        offset = self.width - free[node]
        free[node] -= size
        bin_number = node - self.leaves
        node //= 2
        while node:
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
            node //= 2
        return bin_number, offset


def first_fit_decreasing(sizes: Sequence[int], width: int) -> tuple[list[int], list[int], int]:
    """Bin and offset of every size (all of them at most `width`), and the number of bins."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    tree = TournamentTree(len(sizes), width)
    bins, offsets, used = [0] * len(sizes), [0] * len(sizes), 0
    for i in order:
        bins[i], offsets[i] = tree.place(sizes[i])
        used = max(used, bins[i] + 1)
    return bins, offsets, used


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str,
    text_col: str,
    width: int,
    with_ids: bool,
    place_col: str | None = None,
) -> DataFrame:
    """(id, n_tokens, crcs[, ids][, place]) per row: a checksum for every piece of at most `width` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path)
        end = np.array([END_ID], dtype="<u4").tobytes()
        step = 4 * width
        for batch in slices(batches, text=1, rows=SLICE_ROWS, size=SLICE_BYTES):
            lengths, crcs, kept = [], [], []
            found, offsets = words.encode(batch.column(1))
            bounds = offsets.tolist()
            for first, last in zip(bounds, bounds[1:]):
                ids = found[first:last].tobytes() + end
                lengths.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[k : k + step]) for k in range(0, len(ids), step)])
                if with_ids:
                    kept.append(ids)
            columns = [batch.column(0), pa.array(lengths, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))]
            names = ["id", "n_tokens", "crcs"]
            if with_ids:
                columns.append(pa.array(kept, pa.binary()))
                names.append("ids")
            if place_col is not None:
                columns.append(batch.column(2))
                names.append("place")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "id bigint, n_tokens bigint, crcs array<bigint>" + (", ids binary" if with_ids else "")
    columns = [F.col(id_col).cast("bigint").alias("id"), whole_text(text_col).alias("text")]
    if place_col is not None:
        schema += ", place bigint"
        columns.append(F.col(place_col).cast("bigint").alias("place"))
    rows = docs.select(*columns)
    return rows.mapInArrow(run, schema)


def pack_group(group: int, rows: pd.DataFrame, width: int) -> pd.DataFrame:
    """Pieces of one group with their places; full pieces first, then the packed remainders.

    With a column `place`, equal lengths are packed in its order, and sequences are numbered by the
    place of the document that opened them.
    """
    rows = rows.assign(first_crc=[c[0] for c in rows["crcs"]])
    ties = ["place"] if "place" in rows else ["id", "first_crc"]
    rows = rows.sort_values(["n_tokens", *ties], na_position="last", kind="stable")
    tokens = rows["n_tokens"].to_numpy()
    full, rest = tokens // width, tokens % width
    with_rest = np.flatnonzero(rest)
    bins, offsets, _ = first_fit_decreasing(rest[with_rest].tolist(), width)
    n_full = int(full.sum())
    owner = np.concatenate([np.repeat(np.arange(len(rows)), full), with_rest])
    number = np.concatenate(
        [np.arange(n_full) - np.repeat(np.cumsum(full) - full, full), full[with_rest]]
    ).astype("int64")
    length = np.concatenate([np.full(n_full, width), rest[with_rest]]).astype("int64")
    place = np.concatenate([np.arange(n_full), n_full + np.array(bins, dtype="int64")]).astype("int64")
    if "place" in rows and len(place):
        # The piece at offset 0 opened its sequence.
        opened = np.concatenate([np.zeros(n_full, dtype="int64"), np.array(offsets, dtype="int64")]) == 0
        order = np.lexsort((place[opened], rows["place"].to_numpy()[owner[opened]]))
        renumbered = np.empty(len(order), dtype="int64")
        renumbered[place[opened][order]] = np.arange(len(order))
        place = renumbered[place]
    out = pd.DataFrame(
        {
            "id": rows["id"].array[owner],
            "start": number * width,
            "length": length,
            "ids_crc32": [rows["crcs"].iat[i][k] for i, k in zip(owner, number)],
            "doc_tokens": tokens[owner],
            "sequence_id": group * GROUP_SPAN + place,
            "offset": np.concatenate([np.zeros(n_full, dtype="int64"), np.array(offsets, dtype="int64")]),
        }
    )
    if "ids" in rows:
        out["ids"] = [
            rows["ids"].iat[i][4 * s : 4 * (s + n)] for i, s, n in zip(owner, out["start"], length)
        ]
    return out


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    group_docs: int = GROUP_DOCS,
    seed: int = 1,
    with_ids: bool = False,
    place_col: str | None = None,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    A document is its token ids followed by id 1, so NULL and empty texts are one token. Pieces of a
    sequence lie side by side from offset 0. `with_ids` adds the ids (little-endian unsigned 32 bits).
    Rows that repeat an id are documents of their own; NULL ids are allowed and stay NULL. An empty
    table gives an empty result; other columns are ignored.

    `place_col` holds each row's place in an order, 0 and up without gaps: groups are then stretches of
    that order, and sequence ids ascend along it (inside a group by the place of the document that
    opened the sequence). Without it documents are dealt to groups at random.
    """
    pieces = token_pieces(docs, tokenizer_path, id_col, text_col, width, with_ids, place_col)
    if place_col is None:
        groups = max(1, -(-docs.count() // group_docs))
        mixed = F.xxhash64(F.col("id"), F.element_at("crcs", 1), F.lit(seed))
        part = F.pmod(mixed, F.lit(groups))
    else:
        part = F.floor(F.col("place") / F.lit(group_docs))
    grouped = pieces.withColumn("part", part)
    fields = [
        T.StructField(c, T.LongType())
        for c in ("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    ] + ([T.StructField("ids", T.BinaryType())] if with_ids else [])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows["id"] = rows["id"].astype("Int64")
        return pack_group(int(key[0]), rows.drop(columns="part"), width)

    packed = grouped.groupBy("part").applyInPandas(run, T.StructType(fields))
    return packed.withColumnRenamed("id", id_col)
