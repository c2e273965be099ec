"""SimHash near-duplicates found by multi-index hashing.

A 64-bit fingerprint is cut into two segments of 32 bits. Two fingerprints that differ in at most
three bits differ in at most one bit of one of the segments, so for each segment the ball of radius
one around a fingerprint's value (33 values) is looked up in the table of segment values, and the
complete distance of every match is verified in the join itself.

Copies of a fingerprint are combined before the search, so a group of copies is one row in it. Links
are turned into components by passing on the smallest label and jumping along labels; every round is
written to the shared folder, and only fingerprints that have a link take part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codecloom.llm.common import id_order, slices, whole_text, written

SHINGLE = 3
DISTANCE = 3
SEGMENT_BITS = 32
SEED = 42


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """A hash for every run of `size` words of a UTF-8 text; one for all words if there are fewer."""
    words = text.lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        digest = xxhash.xxh64_intdigest
        spans = zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist())
        hashes = [digest(joined[a:b], SEED) for a, b in spans]
    return np.array(hashes, dtype=np.uint64)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text as an unsigned integer."""
    values = shingle_hashes(text, size)
    if not len(values):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(values), 65536):
        part = values[k : k + 65536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """(id, ord, fp) per row; `fp` holds the 64 bits as a signed long, `ord` sorts NULL ids last.

    The columns of `carry` follow as one struct `row`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=2):
            found = [fingerprint(x) for x in batch.column(2).cast(pa.binary()).to_pylist()]
            fp = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fp), *batch.columns[3:]], names)

    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        id_order(id_col).alias("ord"),
        whole_text(text_col).alias("text"),
        *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []),
    )
    fields = [T.StructField(n, T.LongType()) for n in ("id", "ord", "fp")] + rows.schema.fields[3:]
    names = [f.name for f in fields]
    return rows.mapInArrow(run, T.StructType(fields))


def _segments(value):
    mask = F.lit((1 << SEGMENT_BITS) - 1)
    return [value.bitwiseAND(mask), F.shiftrightunsigned(value, SEGMENT_BITS)]


def close_pairs(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b), a < b: distinct fingerprints `fp` that differ in 1 to `distance` bits, up to 3."""
    if distance > 3:
        raise ValueError("two segments with balls of radius one find distances up to 3")
    fp = F.col("fp")
    # The ball: the value itself and the value with each single bit flipped.
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << i).cast("bigint") for i in range(SEGMENT_BITS)])
    rows = F.array(
        *[F.struct(F.lit(i).alias("seg"), value.alias("value")) for i, value in enumerate(_segments(fp))]
    )
    table = distinct.select(fp.alias("b"), F.explode(rows).alias("r")).select("b", "r.seg", "r.value")
    probes = (
        distinct.select(fp.alias("a"), F.explode(rows).alias("r"))
        .select("a", "r.seg", "r.value", F.explode(flips).alias("flip"))
        .select("a", "seg", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
    )
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= F.lit(distance)
    same = (F.col("p.seg") == F.col("t.seg")) & (F.col("p.value") == F.col("t.value"))
    # Each fingerprint has 66 probes and 2 rows of the table, but the planner sizes what is exploded like the
    # stored fingerprints: it would broadcast the probes of some hundred thousand. So the join is named.
    return (
        probes.alias("p")
        .hint("merge")
        .join(table.alias("t").hint("merge"), same & (F.col("a") < F.col("b")) & near)
        .select("a", "b")
        .distinct()
    )


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(fp, label): the smallest `ord` of the nodes that each linked node (fp, ord) can reach.

    Nodes without a pair are left out. A round passes the smallest label on to the neighbours and
    then replaces each label by the label its own node has by now, so long chains take few rounds.
    """
    edges = written(
        pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))),
        "simhash-edges",
    )
    linked = edges.select(F.col("a").alias("fp")).distinct()
    # A label is the (ord, fp) of a node, so that a label's node can be found again.
    state = nodes.join(linked, "fp", "left_semi").select("fp", "ord", F.col("ord").alias("label"))
    state = written(state, "simhash-labels")
    while True:
        told = (
            edges.join(state.select(F.col("fp").alias("b"), "label"), "b")
            .groupBy("a")
            .agg(F.min("label").alias("told"))
        )
        passed = state.join(told.withColumnRenamed("a", "fp"), "fp").select(
            "fp", "ord", F.col("label").alias("old"), F.least("label", "told").alias("label")
        )
        passed = written(passed, "simhash-passed")
        by_label = passed.select(F.col("ord").alias("label"), F.col("label").alias("jump"))
        jumped = passed.join(by_label, "label").select("fp", "ord", "old", F.col("jump").alias("label"))
        state = written(jumped, "simhash-labels")
        if state.where(F.col("label") < F.col("old")).isEmpty():
            return state.select("fp", "label")
        state = state.drop("old")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """(id, fingerprint, component_id[, component_fp, row]) for every row.

    Rows whose fingerprints differ in at most 3 bits are linked; the component id is the smallest id
    that can be reached along links. Texts without a word (NULL, empty, white space) have fingerprint
    zero and are linked like any other. NULL ids come last: a component of such rows alone has a NULL
    component id. Rows that repeat an id keep a row each. Other columns are ignored, unless `carry` names
    them: then they come back in the struct `row`, next to `component_fp`, the fingerprint that stands for
    the component (components of rows that repeat an id may share their smallest id, but never that).
    """
    marks = written(fingerprints(docs, id_col, text_col, carry), "simhash-marks")
    # Several fingerprints may share a smallest id where ids repeat or are NULL: number them apart.
    nodes = marks.groupBy("fp").agg(F.min("ord").alias("first"))
    nodes = written(nodes, "simhash-nodes")
    pairs = close_pairs(nodes.select("fp"))
    keyed = nodes.select("fp", F.struct("first", "fp").alias("ord"))
    found = components(keyed, pairs).select("fp", F.col("label").alias("found"))
    label = F.coalesce("found", F.struct("first", "fp"))
    smallest = nodes.join(found, "fp", "left").select("fp", label.alias("label"))
    component = F.when(F.col("label.first") != F.lit(2**63 - 1), F.col("label.first"))
    more = [F.col("label.fp").alias("component_fp"), "row"] if carry else []
    return marks.join(smallest, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        component.alias("component_id"),
        *more,
    )
