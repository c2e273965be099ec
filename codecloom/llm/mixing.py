"""Mixing sources to target weights with Pfair scheduling.

Each source is cut into blocks of documents in a seeded random order. Block k of a source of weight w
is released at slot floor(k / w) and due before slot ceil((k + 1) / w); in every slot the released
block with the earliest deadline runs. With weights that sum to one every block runs inside its
window, so a source is never a whole block ahead of or behind its share.

Weights are exact: a float is the fraction it stands for, and windows are computed in whole numbers, so
no error grows with the table. The schedule is as long as the blocks, one to `block_docs` documents: one
task emits it in order, holding one block a source, and the documents are joined to it. A source that
has run out leaves its slots empty; the others keep to their windows and so to their proportions among
themselves.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codecloom.llm.common import written

BLOCK_DOCS = 32
# A source without a weight gets one slot of a period.
PERIOD = 1024
# Slots per source in a period at least, so that such sources take little from the others.
SLOTS_PER_SOURCE = 16
# The smallest share of a source with a weight: slots stay far below 2**63.
LEAST_SHARE = Fraction(1, 1 << 30)
MAX_SOURCES = 65_536
TEMPERATURE = 0.5
# A source's rows are ranked inside 2**PREFIX_BITS ranges of their hash.
PREFIX_BITS = 12


def _in_order(names) -> list[str | None]:
    return sorted(names, key=lambda s: (s is None, s or ""))


def exact_weights(weights: Mapping[str | None, float], period: int = PERIOD) -> dict[str | None, int]:
    """Whole numbers in the proportions of the weights, none of them zero.

    Sources whose weight is not above zero get one slot of a period each; the others share the rest
    exactly. If no weight is above zero, all are equal.
    """
    if len(weights) > MAX_SOURCES:
        raise ValueError(f"{len(weights)} sources; at most {MAX_SOURCES} can be mixed")
    period = max(period, SLOTS_PER_SOURCE * len(weights))
    positive = {s: Fraction(weights[s]) for s in _in_order(weights) if weights[s] > 0}
    if not positive:
        return dict.fromkeys(_in_order(weights), 1)
    # Multiples of the finest of the floats' binary fractions.
    scale = math.lcm(*(x.denominator for x in positive.values()))
    whole = {s: int(x * scale) for s, x in positive.items()}
    total = sum(whole.values())
    least = -(-total * LEAST_SHARE.numerator // LEAST_SHARE.denominator)
    whole = {s: max(n, least) for s, n in whole.items()}
    others = len(weights) - len(positive)
    each = sum(whole.values())
    return {s: whole[s] * (period - others) if s in whole else each for s in _in_order(weights)}


def block_slots(
    weights: Mapping[str | None, int], blocks: Mapping[str | None, int]
) -> Iterator[tuple[str | None, int, int]]:
    """(source, block, slot) of every block: earliest deadline first among the released blocks."""
    total = sum(weights.values())
    names = _in_order(weights)
    waiting = [(0, number, 0) for number, name in enumerate(names) if blocks.get(name, 0) > 0]
    ready: list[tuple[int, int, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, number, block = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(block + 1) * total // weights[names[number]]), number, block))
        deadline, number, block = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a block missed its deadline")
        yield names[number], block, slot
        slot += 1
        if block + 1 < blocks[names[number]]:
            release = (block + 1) * total // weights[names[number]]
            heapq.heappush(waiting, (max(slot, release), number, block + 1))


def source_sizes(docs: DataFrame, source_col: str = "source") -> dict[str | None, int]:
    rows = docs.groupBy(F.col(source_col).cast("string").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return {r["s"]: r["n"] for r in rows.limit(MAX_SOURCES + 1).collect()}


def size_weights(sizes: Mapping[str | None, int], temperature: float = TEMPERATURE) -> dict:
    """A weight per source: its number of documents to the power `temperature`."""
    return {s: n**temperature for s, n in sizes.items()}


def planned(
    docs: DataFrame, weights: Mapping[str | None, int], blocks: Mapping[str | None, int]
) -> DataFrame:
    """(_s, _b, _t): source, block and slot of every block, emitted by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            found = block_slots(weights, blocks)
            while rows := list(islice(found, 16_384)):
                columns = zip(*rows)
                types = [pa.string(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, t) for c, t in zip(columns, types)]
                yield pa.RecordBatch.from_arrays(arrays, ["_s", "_b", "_t"])

    one = docs.sparkSession.range(0, 1, 1, 1)
    return one.mapInArrow(run, "_s string, _b bigint, _t bigint")


def mixed_order(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    block_docs: int = BLOCK_DOCS,
    period: int = PERIOD,
    seed: int = 1,
) -> DataFrame:
    """All rows and columns of `docs`, with mix_block, mix_slot and mix_position.

    `mix_position` orders the mixture: slot times `block_docs` plus the place in the block. Every row
    appears once. NULL is a source like any other; a source that `weights` does not name gets one slot
    of a period. Without weights the sources' sizes give them
    (`size_weights`). NULL ids and rows that repeat an id are ranked like others, in any order among
    equals. An empty table gives an empty result. Columns that already bear one of the three new
    names are replaced.
    """
    docs = docs.drop("mix_block", "mix_slot", "mix_position")
    sizes = source_sizes(docs, source_col)
    weights = size_weights(sizes) if weights is None else {s: weights.get(s, 0.0) for s in sizes}
    plan = written(
        planned(docs, exact_weights(weights, period), {s: -(-n // block_docs) for s, n in sizes.items()}),
        "mixing-plan",
    )
    # The input's columns travel in one struct, so that they cannot meet a name used here.
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"))
    hashed = docs.select(
        F.struct(*columns).alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        key.alias("hash"),
        F.shiftrightunsigned(key, 64 - PREFIX_BITS).alias("prefix"),
    )
    # Rows of a source in front of each hash range: at most 2**PREFIX_BITS rows a source.
    counts = hashed.groupBy(F.col("source").alias("s"), F.col("prefix").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("s", "p", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "prefix").orderBy("hash", "id")
    ranked = hashed.withColumn("number", F.row_number().over(inside) - F.lit(1))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("prefix") == F.col("p"))
    rank = F.col("number") + F.col("before")
    ranked = ranked.join(counts, same).select("row", "source", rank.alias("rank"))
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / F.lit(block_docs)))
    placed = ranked.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    position = F.col("_t") * F.lit(block_docs) + F.col("rank") % F.lit(block_docs)
    return placed.select(
        "row.*",
        F.col("block").alias("mix_block"),
        F.col("_t").alias("mix_slot"),
        position.alias("mix_position"),
    )


def in_mixed_order(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options
) -> DataFrame:
    """The rows of `docs` sorted by their place in the mixture, for writing the mixture as files.

    All columns come back as they were, whatever their names.
    """
    nested = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{source_col}`").alias("source"),
    )
    placed = mixed_order(nested, id_col="id", source_col="source", **options)
    return placed.sort("mix_position").select("row.*")
