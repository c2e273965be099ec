"""Exact top-k search by inner product with a table of distances to pivots.

Vectors are scaled and rounded down to integers. With one more component that brings every candidate
to the same length M, a larger inner product is a smaller distance: |q - x|^2 = |q|^2 + M^2 - 2 q.x.
The distances of every candidate to a fixed set of pivots are computed once and written. A query's
distances to the pivots then bound its distance to a candidate from below, by the largest difference
over all pivots, and so bound the score from above. Candidates are evaluated in the order of that
bound until it falls below the k-th score found: no later candidate can enter the result.

Queries meet candidates in blocks. A block holds candidates with the same nearest pivot; the least and
largest distances of such a cell to every pivot bound the scores of all its candidates. A query starts
with the k-th score among a bounded sample of candidates and is sent only to the blocks whose bound
reaches it, before any vector moves; each block returns at most k rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codecloom.llm.common import slices, written

SCALE = 256
QUERY_STEP = 50
TOP = 5
PIVOTS = 32
# Rows from which pivots and starting scores are taken: those with the smallest hashes of their id.
SAMPLE_ROWS = 1024
QUERY_BLOCK = 4096
MIN_BLOCK, MAX_BLOCK, AIMED_BLOCKS = 512, 65_536, 128
EXACT_DOUBLE, EXACT_LONG = 2.0**53, 2.0**62
# Squared lengths from here on leave no room for the sums of squares in the bounds.
LARGEST_BOUND = 1e300
LEAST_LONG = -(2.0**63)


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec, norm2): floor(256 x) as float64 bytes, of vectors whose scaled components are all finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=4096):
            ids, rows, norms = [], [], []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key is None or not raw.is_valid or raw.values.null_count:
                    continue
                x = raw.values.to_numpy(zero_copy_only=False).astype(np.float64)
                with np.errstate(over="ignore"):
                    q = np.floor(SCALE * x)
                    norm = float(q @ q)
                if not np.isfinite(q).all():
                    continue
                ids.append(key)
                rows.append(q.tobytes())
                norms.append(norm)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(rows, pa.binary()), pa.array(norms, pa.float64())],
                ["id", "vec", "norm2"],
            )

    plain = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))
    return plain.mapInArrow(run, "id bigint, vec binary, norm2 double")


def matrix(rows, width: int) -> np.ndarray:
    """Vectors from bytes as rows of a matrix; shorter ones are filled up with zeros."""
    out = np.zeros((len(rows), width))
    for i, raw in enumerate(rows):
        x = np.frombuffer(raw, dtype=np.float64)
        out[i, : len(x)] = x
    return out


def scores(x: np.ndarray, q: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products as longs; beyond the range of a long they stop at its ends."""
    if largest < EXACT_DOUBLE:
        return (x @ q).astype(np.int64)
    if largest < EXACT_LONG:
        return x.astype(np.int64) @ q.astype(np.int64)
    other = [int(b) for b in q]
    exact = [sum(int(a) * b for a, b in zip(row, other)) for row in x]
    return np.array([max(-(2**63), min(2**63 - 1, v)) for v in exact], dtype=np.int64)


def best(values: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values, ties to the smaller id."""
    return np.lexsort((ids, -values.astype(object) if values.size and values.min() == -(2**63) else -values))[:k]


def farthest_first(x: np.ndarray, count: int) -> np.ndarray:
    """Places of up to `count` rows, each the farthest from those before; distinct rows only."""
    if not len(x):
        return np.zeros(0, dtype=int)
    chosen, gap = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < count and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def pivot_distances(x: np.ndarray, norm2: np.ndarray, pivots: np.ndarray, m2: float, query: bool) -> np.ndarray:
    """Distances to the lengthened pivots; a query's extra component is zero."""
    lengthened = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, m2 - norm2))
    pivot_norm2 = (pivots**2).sum(axis=1)
    pivot_extra = np.sqrt(np.maximum(0.0, m2 - pivot_norm2))
    square = norm2[:, None] + pivot_norm2[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(0.0, square + (lengthened[:, None] - pivot_extra[None, :]) ** 2))


def score_bound(low, q_norm2, m2: float):
    """The largest score at a distance of at least `low`, with slack for the rounding of distances.

    Sums of squares below 2^53 are exact; beyond, a small distance is known to about 1e-7 of the length.
    """
    slack = 1e-9 if m2 < EXACT_DOUBLE else 1e-5
    return (q_norm2 + m2 - low * low) / 2 + slack * (q_norm2 + m2) + 1


def eliminate(q, q_id, q_norm2, q_dist, start, x, ids, dist, m2, k):
    """(ids, scores) of a block's candidates that may be among the k best of a query.

    `start` is a score that k candidates are known to reach.
    """
    if dist.shape[1]:
        bound = score_bound(np.abs(dist - q_dist).max(axis=1), q_norm2, m2)
    else:
        bound = np.full(len(x), np.inf)
    possible = np.flatnonzero((bound >= start) & (ids != q_id))
    order = possible[np.argsort(-bound[possible], kind="stable")]
    found_ids, found = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    floor, step, at = start, 64, 0
    while at < len(order) and bound[order[at]] >= floor:
        part = order[at : at + step]
        found = np.concatenate([found, scores(x[part], q, m2)])
        found_ids = np.concatenate([found_ids, ids[part]])
        keep = best(found, found_ids, k)
        found, found_ids = found[keep], found_ids[keep]
        if len(found) == k:
            floor = max(floor, known_score(found[-1]))
        at, step = at + step, step * 4
    keep = found >= start
    return found_ids[keep], found[keep]


def known_score(score: int) -> float:
    """A score as a bound; the end of the longs is shared by all lower ones and bounds nothing."""
    return float(score) if score > LEAST_LONG else float("-inf")


def extents(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(cell, lo, hi) of batches of (cell, dist): least and largest distances of a cell to every pivot."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column(0).to_numpy(zero_copy_only=False)
        order = np.argsort(cell, kind="stable")
        dist = matrix(batch.column(1).to_pylist(), width)[order]
        cells, first = np.unique(cell[order], return_index=True)
        sides = [f.reduceat(dist, first, axis=0) for f in (np.minimum, np.maximum)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells, pa.int32()), *[pa.array([r.tobytes() for r in s], pa.binary()) for s in sides]],
            ["cell", "lo", "hi"],
        )


def exact_top_k(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = TOP,
    query_step: int = QUERY_STEP,
    pivots: int = PIVOTS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates, ties to the smaller id.

    Queries are rows whose id is divisible by `query_step`; candidates are all rows but the query's
    own. NULL vectors, NULL ids and vectors with a NULL or non-finite component take no part, nor do
    those with a component that is no longer finite times 256 (from about 7e305). A shorter vector counts as filled up with zeros. Of rows that repeat an id the smallest vector
    counts. An empty table gives an empty result; other columns are ignored.
    """
    table = written(quantised(vectors, id_col, vector_col), "topk-vectors")
    ids = table.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    if not ids.where(F.col("n") > F.lit(1)).isEmpty():
        smallest = F.min(F.struct("vec", "norm2")).alias("v")
        table = written(table.groupBy("id").agg(smallest).select("id", "v.*"), "topk-vectors")
    facts = table.agg(
        F.count(F.lit(1)).alias("n"), F.max("norm2").alias("m2"), F.max(F.octet_length("vec")).alias("size")
    ).first()
    n, m2, width = facts["n"], facts["m2"] or 0.0, (facts["size"] or 0) // 8
    sample = table.orderBy(F.xxhash64("id"), "id", "vec").limit(SAMPLE_ROWS).toPandas()
    sample_x, sample_ids = matrix(sample["vec"], width), sample["id"].to_numpy(dtype=np.int64)
    usable = m2 < LARGEST_BOUND
    pivot_x = sample_x[farthest_first(sample_x, pivots)] if usable else sample_x[:0]
    block = max(MIN_BLOCK, min(MAX_BLOCK, n // AIMED_BLOCKS))
    query_blocks = max(1, -(-n // (query_step * QUERY_BLOCK)))

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=4096):
            norm2 = batch.column(2).to_numpy(zero_copy_only=False)
            found, cell = [b""] * len(norm2), np.zeros(len(norm2))
            if len(pivot_x):
                x = matrix(batch.column(1).to_pylist(), width)
                dist = pivot_distances(x, norm2, pivot_x, m2, False)
                found, cell = [d.tobytes() for d in dist], dist.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.binary()), pa.array(cell.astype(np.int32))], [*names, "cell"]
            )

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=1024):
            x = matrix(batch.column(1).to_pylist(), width)
            norm2 = batch.column(2).to_numpy(zero_copy_only=False)
            dist = pivot_distances(x, norm2, pivot_x, m2, True) if len(pivot_x) else np.zeros((len(x), 0))
            first, reached = [], []
            for q, q_dist, q_norm2, key in zip(x, dist, norm2, batch.column(0).to_pylist()):
                known = scores(sample_x[sample_ids != key], q, m2)
                start = known_score(np.sort(known)[-k]) if len(known) >= k else float("-inf")
                first.append(start)
                low = np.maximum(0.0, np.maximum(cell_lo - q_dist, q_dist - cell_hi)).max(axis=1, initial=0.0)
                inside = score_bound(low, q_norm2, m2) >= start if len(pivot_x) else np.ones(len(low), bool)
                reached.append(np.flatnonzero(np.repeat(inside, cell_blocks)))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns, pa.array([d.tobytes() for d in dist], pa.binary()),
                    pa.array(first, pa.float64()), pa.array(reached, pa.list_(pa.int64())),
                ],
                [*names, "start", "blocks"],
            )

    names = ["id", "vec", "norm2", "dist"]
    schema = "id bigint, vec binary, norm2 double, dist binary"
    pivot_table = written(table.mapInArrow(distances, f"{schema}, cell int"), "topk-pivots")

    # A row for each cell, and there are no more cells than pivots.
    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        lo, hi = (matrix(rows[c], len(pivot_x)) for c in ("lo", "hi"))
        sides = {"lo": [lo.min(axis=0).tobytes()], "hi": [hi.max(axis=0).tobytes()]}
        return pd.DataFrame({"cell": rows["cell"].iloc[:1].to_numpy(), **sides})

    sides = "cell int, lo binary, hi binary"
    spans = pivot_table.select("cell", "dist").mapInArrow(lambda b: extents(b, len(pivot_x)), sides)
    spans = spans.groupBy("cell").applyInPandas(merged, sides).toPandas().set_index("cell")
    counts = {r["cell"]: r["count"] for r in pivot_table.groupBy("cell").count().collect()}
    cells = max(1, len(pivot_x))
    cell_blocks = np.array([-(-counts.get(c, 0) // block) for c in range(cells)], dtype=np.int64)
    first_block = np.cumsum(cell_blocks) - cell_blocks
    cell_lo, cell_hi = np.zeros((cells, len(pivot_x))), np.zeros((cells, len(pivot_x)))
    for c, row in spans.iterrows():
        cell_lo[c], cell_hi[c] = np.frombuffer(row["lo"]), np.frombuffer(row["hi"])
    reaching = f"{schema}, start double, blocks array<bigint>"
    queries = table.where(F.col("id") % F.lit(query_step) == 0).mapInArrow(starts, reaching)

    def number(seed: int, blocks):
        return F.pmod(F.xxhash64("id", F.lit(seed)), blocks)

    def of_cell(values: np.ndarray):
        return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("cell") + F.lit(1)).cast("bigint")

    # A pair of blocks is the unit of work: candidates are repeated once per query block (one for every
    # 204,800 rows) that has a query for them, queries once per block they reach.
    right = written(
        queries.withColumn("qb", number(2, F.lit(query_blocks))).withColumn("cb", F.explode("blocks")).drop("blocks"),
        "topk-queries",
    )
    pairs = right.select(F.col("cb").alias("pair_cb"), F.col("qb").alias("pair_qb")).distinct()
    left = pivot_table.withColumn("cb", of_cell(first_block) + number(1, of_cell(np.maximum(1, cell_blocks))))
    left = left.join(pairs, F.col("cb") == F.col("pair_cb")).select(*names, "cb", F.col("pair_qb").alias("qb"))

    def search(candidates: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        x, ids = matrix(candidates["vec"], width), candidates["id"].to_numpy(dtype=np.int64)
        dist = matrix(candidates["dist"], len(pivot_x))
        query_ids, out_ids, out_scores = [], [], []
        for row in wanted.itertuples():
            q = matrix([row.vec], width)[0]
            q_dist = np.frombuffer(row.dist, dtype=np.float64)
            got, value = eliminate(q, row.id, row.norm2, q_dist, row.start, x, ids, dist, m2, k)
            query_ids.append(np.full(len(got), row.id, dtype=np.int64))
            out_ids.append(got)
            out_scores.append(value)
        none = [np.zeros(0, dtype=np.int64)]
        return pd.DataFrame(
            {
                "query_id": np.concatenate(query_ids or none),
                "vec_id": np.concatenate(out_ids or none),
                "score": np.concatenate(out_scores or none),
            }
        )

    found = (
        left.groupBy("cb", "qb")
        .cogroup(right.groupBy("cb", "qb"))
        .applyInPandas(search, "query_id bigint, vec_id bigint, score bigint")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= F.lit(k))
        .select("query_id", "rank", "vec_id", "score")
    )
