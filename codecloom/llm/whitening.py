"""Whitening of embeddings from a covariance over distinct vectors, each whitened once.

Components are turned into integers, so identical vectors are found exactly by grouping. The fit
counts every distinct vector once, or with its multiplicity as weight. The mean is an exact integer
sum; vectors are centred as integers before the product of matrices, so no digits cancel. Each
distinct vector is whitened once, and the result is joined back to the rows by the integer vector.

Only figures of the dimensions' size (sums, the covariance) reach the driver. A vector that many rows
share is dealt to several tasks in the join, in proportion to its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecloom.llm.common import written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
# Entries whose scaled value is no safe long: such vectors take no part.
LARGEST = float(2**55)
EXACT = 2**62
# A vector with more than this share of the rows is dealt to several tasks: at most so many vectors.
SHARES = 1024


def integer_vector(vector: Column) -> Column:
    """Every entry c, as double, as the long floor(64 c) + 1,000,000."""
    return F.transform(
        vector, lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))).cast("bigint") + F.lit(SHIFT)
    )


def usable(vector: Column) -> Column:
    """The vector and all its entries are there and finite."""
    return vector.isNotNull() & F.forall(
        vector, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(LARGEST), F.lit(False))
    )


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a matrix of longs; vectors shorter than the longest are filled up with entries 0."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    size = np.diff(column.offsets.to_numpy())
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.full((len(size), width), SHIFT, dtype=np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def _weights(batch: pa.RecordBatch, counted: bool) -> np.ndarray:
    n = batch.column(1).to_numpy()
    return n if counted else np.ones(len(n), dtype=np.int64)


def _sums(distinct: DataFrame, width: int, counted: bool) -> list[int]:
    """Exact weighted sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for batch in batches:
            x, w = matrix(batch.column(0), width), _weights(batch, counted)
            if x.size and int(np.abs(x).max()) * int(w.sum()) >= EXACT:
                x, w = x.astype(object), w.astype(object)
            total = [t + int(s) for t, s in zip(total, w @ x)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(width), pa.int32()),
                pa.array([Decimal(t) for t in total], pa.decimal128(38, 0)),
            ],
            ["d", "s"],
        )

    rows = distinct.select("x", "n").mapInArrow(run, "d int, s decimal(38,0)")
    held = {r["d"]: int(r["s"]) for r in rows.groupBy("d").agg(F.sum("s").alias("s")).collect()}
    return [held[d] for d in range(width)]


def _products(parts: DataFrame, width: int) -> np.ndarray:
    """Sum of the upper triangles (i, j, v) of symmetric matrices."""
    out = np.zeros((width, width))
    summed = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j = summed.column("i").to_numpy(), summed.column("j").to_numpy()
    out[i, j] = out[j, i] = summed.column("v").to_numpy()
    return out


def _triangle(held: np.ndarray) -> pa.RecordBatch:
    i, j = np.triu_indices(len(held))
    return pa.RecordBatch.from_arrays(
        [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(held[i, j])], ["i", "j", "v"]
    )


class Centre:
    """The mean as a whole number and a fraction per dimension, so that vectors are centred exactly."""

    def __init__(self, sums: list[int], n: int):
        self.sums, self.n = sums, n
        self.whole = [s // n for s in sums]
        self.rest = [s - n * a for s, a in zip(sums, self.whole)]

    def centred(self, x: np.ndarray) -> np.ndarray:
        near = x - np.array(self.whole, dtype=np.int64)
        return near.astype(np.float64) - np.array([r / self.n for r in self.rest])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None beyond a long."""
        near, rest = x - np.array(self.whole, dtype=np.int64), np.array(self.rest, dtype=object)
        largest = (int(np.abs(near).max()) + 1) * self.n if near.size else 0
        if near.shape[1] * largest * largest < EXACT:
            far = near * self.n - rest.astype(np.int64)
        else:
            far = near.astype(object) * self.n - rest
        return [s if s < 2**63 else None for s in map(int, (far * far).sum(axis=1))]


def _covariance(distinct: DataFrame, centre: Centre, width: int, counted: bool) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((width, width))
        for batch in batches:
            y = centre.centred(matrix(batch.column(0), width))
            held += (y * _weights(batch, counted)[:, None]).T @ y
        yield _triangle(held)

    parts = distinct.select("x", "n").mapInArrow(run, "i int, j int, v double")
    return _products(parts, width) / centre.n


def components(covariance: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns), falling; only those above the rounding of the trace."""
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:count]
    floor = max(0.0, np.trace(covariance)) * len(covariance) * np.finfo(float).eps
    order = order[values[order] > floor]
    return values[order], vectors[:, order]


def _identity_error(white: DataFrame, n: int, width: int, counted: bool) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One more column of ones gives the sums beside the products.
        held = np.zeros((width + 1, width + 1))
        for batch in batches:
            z = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            z = np.hstack([z, np.ones((len(z), 1))])
            held += (z * _weights(batch, counted)[:, None]).T @ z
        yield _triangle(held)

    held = _products(white.select("whitened", "n").mapInArrow(run, "i int, j int, v double"), width + 1) / n
    mean = held[:width, width]
    return float(np.abs(held[:width, :width] - np.outer(mean, mean) - np.eye(width)).max())


def whiten(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    count: int = COMPONENTS,
    weights: str = "one",
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) per row and component.

    `weights` is "one" (every distinct vector counts once) or "count" (as often as it occurs); `n` is
    the sum of the weights. Rows whose vector is NULL or holds NULL, non-finite or enormous entries (2^55
    and more) take no part. Vectors shorter than the longest are filled up with entries 0, and equal
    vectors are those that are equal then. Rows that repeat an id are rows of their own; NULL ids stay
    NULL; other columns are ignored. A deviation beyond a long is NULL. Components without variance
    are left out, so one distinct vector, and an empty table, give no rows.
    """
    if weights not in ("one", "count"):
        raise ValueError(f"weights {weights!r}: one or count")
    counted = weights == "count"
    given = vectors.where(usable(F.col(vector_col))).select(
        F.col(id_col).cast("bigint").alias("id"), integer_vector(F.col(vector_col)).alias("x")
    )
    width = given.agg(F.max(F.size("x"))).first()[0] or 0
    missing = F.lit(width) - F.size("x")
    rows = given.withColumn("x", F.concat("x", F.array_repeat(F.lit(SHIFT).cast("bigint"), missing)))
    distinct = written(rows.groupBy("x").agg(F.count(F.lit(1)).alias("n")), "distinct-vectors")
    facts = distinct.agg(F.count(F.lit(1)), F.sum("n")).first()
    n_rows = facts[1] or 0
    n = n_rows if counted else facts[0]
    schema = f"{id_col} bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not n or not width:
        return vectors.sparkSession.createDataFrame([], schema)
    centre = Centre(_sums(distinct, width, counted), n)
    covariance = _covariance(distinct, centre, width, counted)
    values, directions = components(covariance, count)
    if not len(values):
        return vectors.sparkSession.createDataFrame([], schema)
    project = directions / np.sqrt(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0), width)
            z = centre.centred(x) @ project
            offsets = np.arange(len(x) + 1, dtype=np.int32) * z.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(centre.deviations(x), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(z.ravel())),
                ],
                ["x", "n", "deviation", "whitened"],
            )

    fields = "x array<bigint>, n bigint, deviation bigint, whitened array<double>"
    white = written(distinct.mapInArrow(run, fields), "whitened-vectors")
    error = _identity_error(white, n, len(values), counted)
    explained = (values / np.trace(covariance)).tolist()

    # A vector gets a task for each 1/1,024 of the rows, so at most 1,024 vectors get more than one.
    parts = F.ceil(F.col("n") * F.lit(SHARES) / F.lit(n_rows)).cast("bigint")
    hot = distinct.select(F.col("x").alias("hot_x"), parts.alias("parts")).where(F.col("parts") > 1)
    place = F.monotonically_increasing_id()
    dealt = rows.withColumn("place", place).join(F.broadcast(hot), F.col("x") == F.col("hot_x"), "left")
    dealt = dealt.select("id", "x", F.pmod("place", F.coalesce("parts", F.lit(1))).alias("part"))
    copies = white.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - F.lit(1))))
    joined = dealt.join(copies.drop("n"), ["x", "part"])
    return joined.select(
        F.col("id").alias(id_col), "deviation", F.posexplode("whitened").alias("k", "whitened")
    ).select(
        id_col,
        (F.col("k") + F.lit(1)).alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(F.array(*map(F.lit, explained)), F.col("k")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
