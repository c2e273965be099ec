"""Removing passages that an earlier document holds, by induced sorting of suffixes in shards.

1. Anchors. In every window of WINDOW bytes the GRAM-byte string with the smallest hash (the leftmost
   of several) is the window's anchor. Equal windows have equal anchors, and an anchor is shared by a
   run of neighbouring windows. A window holds its anchor and SIDE bytes before or after it, so hashes
   of the anchor with either side are dealt by ranges of the anchor's hash, in packed arrays and in the
   order of the text; a range answers with one bit an anchor: two texts at least have it with the same
   side, or not.
2. Segments. The run of windows around such an anchor is a segment of its text, some 66 bytes for 17
   windows. Equal segments are combined in each task before they are shuffled.
3. Shards. Segments are dealt to shards by anchor, so equal windows meet in one shard. A shard sorts
   the suffixes of its segments by induction (`induced_sort`), and neighbours that agree on WINDOW
   bytes form a group, whose smallest document is known then. Bytes are compared, not hashes.
   Shards above SHARD_LIMIT bytes (an anchor at the edge of a passage that very many documents hold has
   as many segments) are not sorted whole: their segments are cut into pieces of BLOCK windows at places
   fixed by the anchor, and pieces are dealt by the bytes that all windows of a piece hold, so equal
   windows still meet. Equal pieces are combined before they are shuffled.
4. Spans. Windows whose smallest document is another one are joined to their documents, and the bytes
   they cover are cut out.

Steps 2 to 4 are one plan that meets the texts three times by their keys, always with the same columns,
so that their one exchange is reused; segments are cut anew rather than stored.

Texts that are copies of an earlier document as a whole are found by SHA-256 and need no search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecloom.llm.common import id_order, slices, whole_text, written
from codecloom.llm.induced_sort import sorted_suffixes

WINDOW = 50
GRAM = 16
SIDE = (WINDOW - GRAM + 1) // 2
KEY_BYTES = 12
RANGES = 24
RANGE_ANCHORS = 4 << 20
SHARDS = 64
SHARD_BYTES = 6 << 20
SHARD_LIMIT = 2 * SHARD_BYTES
BLOCK = 3
PIECE_BYTES = 5  # of pieces for a byte of segments
MOST_BROADCAST = 1 << 20
CHUNK = 8 << 20


def text_key(col: str = "text"):
    return F.substring(F.unhex(F.sha2(F.col(col), 256)), 1, KEY_BYTES)


def anchors(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, position, first window, windows) of the anchors of a text, in chunks of windows."""
    steps = WINDOW - GRAM + 1
    for base in range(0, len(text) - WINDOW + 1, CHUNK):
        part = text[base : base + CHUNK + WINDOW - 1]
        n = len(part)
        eight = np.ndarray((n - 7,), "<u8", part, strides=(1,))
        h = np.zeros(n - GRAM + 1, dtype=np.uint64)
        for k in range(0, GRAM, 8):
            h ^= eight[k : k + len(h)] * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        # Position in the low bits: of equal hashes the leftmost wins.
        low = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= steps:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < steps:
            low = np.minimum(low[: len(low) - (steps - width)], low[steps - width :])
        at = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        count = np.diff(np.append(first, len(at)))
        yield h[at[first]], at[first] + base, first + base, count


def sides(text: bytes, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of anchors with the SIDE bytes before them, and after them; without such bytes, of the anchor.

    The bytes are those of the whole text, so they do not depend on its chunks.
    """
    words = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    out = []
    for begin in (at - SIDE, at + GRAM):
        there = np.flatnonzero((begin >= 0) & (begin + SIDE <= len(text)))
        mixed = h.copy()
        for k in (*range(0, SIDE - 8, 8), SIDE - 8):
            x = mixed[there] ^ (words[begin[there] + k] * np.uint64(0x9E3779B97F4A7C15))
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xD6E8FEB86659FD93)
            mixed[there] = x ^ (x >> np.uint64(32))
        out.append((mixed & np.uint64(0xFFFFFFFF)).astype("<u4"))
    return out[0], out[1]


def dealt(h: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors in the order of their hash ranges, and where each range begins. Text order stays within."""
    # Anchors have small high bits, so the low ones are left to tell anchors of a range apart.
    part = (h >> np.uint64(32)) % np.uint64(ranges)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(ranges + 1))


def all_anchors(text: bytes) -> list[np.ndarray]:
    """The columns of `anchors` over all chunks of a text."""
    return [np.concatenate(x) for x in zip(*anchors(text))]


def dealt_anchors(texts: DataFrame, ranges: int) -> DataFrame:
    """(part, keys, counts, before, after): anchors of a slice of texts that fall into a hash range.

    Each text with an anchor there has a key and a count; hashes with the bytes before and after the
    anchors follow in the order of the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=0, rows=4096, size=16 << 20):
            keys: dict[bytes, int] = {}
            hashes, owners, before, after = [], [], [], []
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                key = hashlib.sha256(text).digest()[:KEY_BYTES]
                if len(text) < WINDOW or key in keys:
                    continue
                for h, at, _, _ in anchors(text):
                    hashes.append(h)
                    for column, values in zip((before, after), sides(text, h, at)):
                        column.append(values)
                    owners.append(np.full(len(h), len(keys), dtype="<u2"))
                keys[key] = len(keys)
            if not keys:
                continue
            h, owner = np.concatenate(hashes), np.concatenate(owners)
            left, right = np.concatenate(before), np.concatenate(after)
            names = np.frombuffer(b"".join(keys), dtype=np.uint8).reshape(-1, KEY_BYTES)
            order, bounds = dealt(h, ranges)
            for r in range(ranges):
                o = order[bounds[r] : bounds[r + 1]]
                if len(o):
                    held, counts = np.unique(owner[o], return_counts=True)
                    arrays = (names[held], counts.astype("<u4"), left[o], right[o])
                    row = [r, *[x.tobytes() for x in arrays]]
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row))], schema)

    columns = ("keys", "counts", "before", "after")
    schema = pa.schema([("part", pa.int32()), *[(c, pa.binary()) for c in columns]])
    return texts.select("text").mapInArrow(run, "part int, " + ", ".join(f"{c} binary" for c in columns))


def shared_anchors(rows: pd.DataFrame) -> pd.DataFrame:
    """(key, part, n, bits) of the texts that share an anchor of a hash range: one bit an anchor."""
    raw = np.frombuffer(b"".join(rows["keys"]), dtype=np.uint8).reshape(-1, KEY_BYTES)
    head = np.ascontiguousarray(raw[:, :8]).view("<u8").ravel()
    tail = np.ascontiguousarray(raw[:, 8:]).view("<u4").ravel()
    counts = np.frombuffer(b"".join(rows["counts"]), dtype="<u4").astype(np.int64)
    # The same text of several slices counts once.
    order = np.lexsort((tail, head))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (head[order][1:] != head[order][:-1]) | (tail[order][1:] != tail[order][:-1])
    once = np.zeros(len(order), dtype=bool)
    once[order[fresh]] = True
    taken = np.repeat(once, counts)
    counts, raw = counts[once], raw[once]
    owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    flags = np.zeros(len(owner), dtype=bool)
    for side in ("before", "after"):
        low = np.frombuffer(b"".join(rows[side]), dtype="<u4")[taken]
        order = np.argsort(low, kind="stable")
        at = low[order]
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        ends = np.append(starts[1:], len(at))
        # Owners ascend within equal hashes, as the sort is stable.
        several = owner[order[starts]] != owner[order[ends - 1]]
        flags[order] |= np.repeat(several, ends - starts)
    begin = np.cumsum(counts) - counts
    n = np.add.reduceat(flags.astype(np.int64), begin)
    found = np.flatnonzero(n)
    return pd.DataFrame(
        {
            "key": [raw[i].tobytes() for i in found],
            "part": np.full(len(found), rows["part"].iloc[0]),
            "n": n[found],
            "bits": [np.packbits(flags[begin[i] : begin[i] + counts[i]]).tobytes() for i in found],
        }
    )


def segment_id(segment: bytes) -> int:
    """Spark's xxhash64 of the bytes."""
    h = xxhash.xxh64_intdigest(segment, 42)
    return h - (1 << 64) if h >> 63 else h


def segments(found: DataFrame, ranges: int, bytes_too: bool) -> DataFrame:
    """(num, first, start, anchor, sid) of the runs of windows around shared anchors.

    With `bytes_too` (first, anchor, segment) instead. Segments are told apart by anchor and sid. `anchor`
    holds the anchor's hash in its low 32 bits and its place in the segment above them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=2, rows=256):
            out = [[] for _ in names]
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for num, first, text, places in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, batch.column(3).to_pylist()
            ):
                h, at, start, count = all_anchors(text)
                order, bounds = dealt(h, ranges)
                pick = []
                for place in places:
                    o = order[bounds[place["part"]] : bounds[place["part"] + 1]]
                    bits = np.unpackbits(np.frombuffer(place["bits"], dtype=np.uint8), count=len(o))
                    pick.append(o[bits.astype(bool)])
                pick = np.sort(np.concatenate(pick))
                codes = (h[pick] & np.uint64(0xFFFFFFFF)).astype(np.int64) | (at[pick] - start[pick]) << 32
                for i, a, c in zip(codes.tolist(), start[pick].tolist(), count[pick].tolist()):
                    segment = text[a : a + c - 1 + WINDOW]
                    row = (first, i, segment) if bytes_too else (num, first, a, i, segment_id(segment))
                    for column, value in zip(out, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names)

    if bytes_too:
        names, kinds = ["first", "anchor", "segment"], [pa.int64(), pa.int64(), pa.binary()]
        schema = "first bigint NOT NULL, anchor bigint NOT NULL, segment binary NOT NULL"
    else:
        names = ["num", "first", "start", "anchor", "sid"]
        kinds = [pa.int64()] * 5
        schema = "num bigint, first bigint, start bigint, anchor bigint, sid bigint"
    # The id is not used here, but all readers of the texts take the same columns.
    return found.select("num", "first", "text", "places", "id").mapInArrow(run, schema)


def oversized(distinct: DataFrame, most: int) -> DataFrame:
    """(shard, parts) of the shards that are cut up. `most` bounds their number; beyond it they are not broadcast."""
    sizes = distinct.groupBy("shard").agg(
        F.sum(F.octet_length("segment")).alias("held"), F.min("first").alias("oldest"), F.max("last").alias("newest")
    )
    # No document is above the last one: this holds always, but all readers of the segments take the same columns.
    large = sizes.where((F.col("held") > F.lit(SHARD_LIMIT)) & (F.col("oldest") <= F.col("newest")))
    parts = F.ceil(F.col("held") * F.lit(PIECE_BYTES) / F.lit(SHARD_BYTES)).alias("parts")
    large = large.select("shard", parts)
    return F.broadcast(large) if most <= MOST_BROADCAST else large


def pieces(hot: DataFrame) -> DataFrame:
    """(anchor, sid, shift, shard, part, code, piece, first, last): segments cut into pieces of BLOCK windows.

    A window's block is given by the bytes before its anchor, so equal windows are in equal blocks, and all
    windows of a block hold the same core of WINDOW - BLOCK + 1 bytes, by which pieces are dealt. `code` is
    to the piece what `anchor` is to the segment, and `shift` is the piece's place in the segment.
    """
    at = F.shiftright("anchor", 32).cast("int").alias("at")
    windows = (F.octet_length("segment") - F.lit(WINDOW - 1)).alias("windows")
    blocks = F.expr(f"sequence((at - windows + 1) div {BLOCK}, at div {BLOCK})")
    # No sequence is empty; the outer form puts no filter on the segments, which other readers would not share.
    cut = hot.select("*", at, windows).select("*", F.explode_outer(blocks).alias("block"))
    # The block's windows would be those from `begin` on; the segment may hold some of them only.
    begin = F.col("at") - F.col("block").cast("int") * F.lit(BLOCK) - F.lit(BLOCK - 1)
    cut = cut.withColumn("begin", begin).withColumn("shift", F.greatest(F.lit(0), "begin"))
    end = F.least(F.col("windows"), F.col("begin") + F.lit(BLOCK)) + F.lit(WINDOW - 1)
    core = F.substr("segment", F.col("begin") + F.lit(BLOCK), F.lit(WINDOW - BLOCK + 1))
    return cut.select(
        "anchor",
        F.xxhash64("segment").alias("sid"),
        "shift",
        "shard",
        F.pmod(F.xxhash64("block", core), F.col("parts")).alias("part"),
        (F.col("anchor") - F.shiftleft(F.col("shift").cast("bigint"), 32)).alias("code"),
        F.substr("segment", F.col("shift") + F.lit(1), end - F.col("shift")).alias("piece"),
        "first",
        "last",
    )


def merged_pieces(cut: DataFrame) -> DataFrame:
    """(shard, part, anchor, segment, first, last): one row per distinct piece."""
    return (
        cut.groupBy("shard", "part", "code", "piece")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .select("shard", "part", F.col("code").alias("anchor"), F.col("piece").alias("segment"), "first", "last")
    )


def runs_of_owners(distinct: DataFrame, most: int) -> DataFrame:
    """(anchor, sid, runs): runs of windows of a segment and their smallest document; several rows a segment.

    The exchange of the segments is read three times. Keys that cannot be NULL keep filters out of it.
    """
    large = oversized(distinct, most)
    owners = "anchor bigint, sid bigint, offsets array<bigint>, firsts array<bigint>"
    runs = F.arrays_zip(
        F.slice("offsets", F.lit(1), F.size("firsts")).alias("a"),
        F.slice("offsets", F.lit(2), F.size("firsts")).alias("b"),
        F.col("firsts").alias("f"),
    ).alias("runs")
    # An anti-join would be moved below the exchange.
    small = distinct.join(large, "shard", "left").where(F.col("parts").isNull()).drop("parts")
    whole = small.groupBy("shard").applyInPandas(window_owners, owners)
    cut = pieces(distinct.join(large, "shard"))
    fates = merged_pieces(cut).groupBy("shard", "part").applyInPandas(window_owners, owners)
    fates = fates.select(F.col("anchor").alias("code"), F.col("sid").alias("piece_sid"), runs)
    # The condition always holds and keeps the columns of the exchange, as in `oversized`.
    places = cut.where(F.col("first") <= F.col("last"))
    places = places.select("anchor", "sid", "shift", "code", F.xxhash64("piece").alias("piece_sid"))
    moved = F.transform(
        "runs",
        lambda x: F.struct(
            (F.col("shift") + x["a"]).alias("a"), (F.col("shift") + x["b"]).alias("b"), x["f"].alias("f")
        ),
    )
    parts = places.join(fates, ["code", "piece_sid"]).select("anchor", "sid", moved.alias("runs"))
    return whole.select("anchor", "sid", runs).unionByName(parts)


def window_owners(rows: pd.DataFrame) -> pd.DataFrame:
    """(anchor, sid, offsets, firsts): the smallest document of a segment's windows, as runs.

    Segments whose holders all come no later than any of these documents are left out.
    """
    raw = b"\x00".join(rows["segment"]) + b"\x00"
    data = np.frombuffer(raw, dtype=np.uint8)
    lengths = np.fromiter(map(len, rows["segment"]), dtype=np.int64, count=len(rows))
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    windows = lengths - (WINDOW - 1)
    # Symbols: 0 the end, 1 between segments, bytes from 2 on.
    text = data.astype(np.uint16) + np.uint16(2)
    text[starts + lengths] = 1
    text = np.append(text, np.uint16(0))
    owner = np.full(len(text), -1, dtype=np.int32)
    owner[np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())] = np.repeat(
        np.arange(len(rows), dtype=np.int32), windows
    )
    first = rows["first"].to_numpy()
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    smallest = np.zeros(len(text), dtype=np.int64)
    held = np.zeros(0, dtype=np.int64)  # the group that is still open

    def close(group: np.ndarray) -> None:
        same = np.ones(max(0, len(group) - 1), dtype=bool)
        for k in (*range(0, WINDOW - 8, 8), WINDOW - 8):
            at = words[group + k]
            same &= at[1:] == at[:-1]
        heads = np.concatenate([[0], np.flatnonzero(~same) + 1])
        least = np.minimum.reduceat(first[owner[group]], heads)
        smallest[group] = np.repeat(least, np.diff(np.append(heads, len(group))))

    for part in sorted_suffixes(text, 258, WINDOW):
        held = np.concatenate([held, part[owner[part] >= 0]])
        if len(held) > 1 << 19:
            # Cut between groups: the last group may go on in the next part.
            tail = len(held) - 1
            last = raw[held[tail] : held[tail] + WINDOW]
            while tail and raw[held[tail - 1] : held[tail - 1] + WINDOW] == last:
                tail -= 1
            if tail:
                close(held[:tail])
                held = held[tail:]
    if len(held):
        close(held)
    offsets, firsts, kept = [], [], []
    for i, (s, n, last) in enumerate(zip(starts.tolist(), windows.tolist(), rows["last"].tolist())):
        values = smallest[s : s + n]
        if values.min() >= last:
            continue
        kept.append(i)
        heads = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])
        offsets.append(np.append(heads, n))
        firsts.append(values[heads])
    some = rows.iloc[kept]
    sids = np.array([segment_id(x) for x in some["segment"]], dtype=np.int64)
    # Without a row the type of a list could not be told.
    lists = {k: pd.Series(v, dtype=object) for k, v in (("offsets", offsets), ("firsts", firsts))}
    return pd.DataFrame({"anchor": some["anchor"].array, "sid": sids, **lists})


def cut(text: bytes, starts: list[int], ends: list[int]) -> tuple[bytes, int, int]:
    """What is left of a text without the spans, the bytes removed and the maximal removed runs."""
    left, at, removed, runs = [], 0, 0, 0
    for a, b in sorted(zip(starts, ends)):
        if b <= at and runs:
            continue
        if a > at or not runs:
            left.append(text[at:a])
            runs += 1
            removed += b - a
        else:
            removed += b - at
        at = max(at, b)
    left.append(text[at:])
    return b"".join(left), removed, runs


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row; `kept` is binary.

    A byte goes if a string of 50 bytes that covers it also starts in a document with a smaller id.
    NULL is the empty text; texts under 50 bytes lose nothing. Cuts may fall inside a character. Rows
    that share an id do not cut each other; NULL ids come last. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), whole_text(text_col).alias("text"))
    firsts = texts.groupBy(text_key().alias("key")).agg(
        F.min(id_order("id")).alias("first"), F.max(F.octet_length("text")).alias("n_bytes")
    )
    firsts = written(firsts.withColumn("num", F.monotonically_increasing_id()), "suffix-texts")
    size = firsts.agg(F.sum("n_bytes")).first()[0] or 0
    ranges = max(RANGES, size // (17 * RANGE_ANCHORS))
    shared = (
        dealt_anchors(texts, ranges)
        .groupBy("part")
        .applyInPandas(shared_anchors, "key binary, part int, n bigint, bits binary")
        .groupBy("key")
        .agg(F.sum("n").alias("n"), F.collect_list(F.struct("part", "bits")).alias("places"))
    )
    shared = written(
        shared.join(firsts, "key").select(F.col("key").alias("at"), "num", "first", "n", "places"), "suffix-anchors"
    )
    total = (shared.agg(F.sum("n")).first()[0] or 0) * (WINDOW + (WINDOW - GRAM) // 2)
    shards = max(SHARDS, total // SHARD_BYTES)
    keyed = texts.select("id", text_key().alias("key"), "text")
    # No id is below the first one; an equality here would become a part of the exchange's key.
    owners = keyed.join(shared, (F.col("key") == F.col("at")) & (id_order("id") <= F.col("first")))
    # One row per distinct segment; those that many documents hold are combined in each task.
    distinct = (
        segments(owners, ranges, True)
        .groupBy("anchor", "segment")
        .agg(F.min("first").alias("first"), F.max("first").alias("last"))
        .withColumn("shard", F.coalesce(F.col("anchor").bitwiseAND(F.lit(0xFFFFFFFF)) % F.lit(shards), F.lit(0)))
    )
    fates = runs_of_owners(distinct, 2 * total // SHARD_LIMIT)
    hits = F.filter("runs", lambda x: x["f"] < F.col("first"))
    spans = (
        segments(owners, ranges, False)
        .join(fates, ["anchor", "sid"])
        .select("num", "start", hits.alias("hits"))
        .where(F.size("hits") > F.lit(0))
        .select(
            "num",
            F.transform("hits", lambda x: F.col("start") + x["a"]).alias("a"),
            F.transform("hits", lambda x: F.col("start") + x["b"] + F.lit(WINDOW - 1)).alias("b"),
        )
        .groupBy("num")
        .agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
        .select("num", F.flatten("a").alias("a"), F.flatten("b").alias("b"))
    )
    facts = firsts.join(spans, "num", "left").select(F.col("key").alias("at"), "first", "a", "b")
    rows = keyed.join(facts, F.col("key") == F.col("at")).withColumn("ord", id_order("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=3):
            out = [[] for _ in range(5)]
            found = batch.select(["ord", "first", "a", "b"]).to_pylist()
            for text, row in zip(batch.column(3).cast(pa.binary()).to_pylist(), found):
                if row["ord"] != row["first"] and len(text) >= WINDOW:
                    left, removed, count = b"", len(text), 1
                else:
                    left, removed, count = cut(text, row["a"] or [], row["b"] or [])
                for column, value in zip(out, (len(text), removed, count, hashlib.sha256(left).hexdigest(), left)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, t) for x, t in zip(out, kinds)]], names
            )

    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    done = rows.select("id", "ord", "first", "text", "a", "b").mapInArrow(
        run, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    )
    return done.withColumnRenamed("id", id_col)
