"""Reduce a logits vector to what the metrics need: label loss and best ids.

Two forms with equal results, on every row: a NULL element counts as NaN; the loss of a vector with a
NaN is NaN, of a vector without any logit above -inf NULL; NaN is never better than a number; a NULL
vector has neither loss nor ids. The expression form stays in the JVM and suits narrow vocabularies;
the Arrow form handles a whole batch with numpy and suits vocabularies of tens of thousands of ids,
where interpreted array folds cost far more than the transfer. `reduce_logits` picks by width.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from codecloom.layout import TokenLayout

# At 64 ids the Arrow form takes half the time of the fold, at 80,538 ids a twentieth.
WIDE_VOCABULARY = 256

NAN, LOWEST = float("nan"), float("-inf")


def log_sum_exp(logits: Column) -> Column:
    """ln(sum(exp(x))) in one pass, rescaling the running sum when the maximum grows."""
    start = F.struct(F.lit(LOWEST).alias("top"), F.lit(0.0).alias("total"))

    def step(acc: Column, x: Column) -> Column:
        value = F.coalesce(x.cast("double"), F.lit(NAN))
        top = F.greatest(acc["top"], value)
        total = acc["total"] * F.exp(acc["top"] - top) + F.exp(value - top)
        # -inf adds nothing, and -inf less -inf is not a number.
        total = F.when(value == F.lit(LOWEST), acc["total"]).otherwise(total)
        return F.struct(top.alias("top"), total.alias("total"))

    def finish(acc: Column) -> Column:
        return F.when(acc["top"] > F.lit(LOWEST), acc["top"] + F.ln(acc["total"]))

    return F.aggregate(logits, start, step, finish)


def label_nll(logits: Column, label: Column) -> Column:
    """Cross-entropy of one position. NULL when the label lies outside the vector."""
    place = label.cast("int")
    inside = (place >= F.lit(0)) & (place < F.size(logits))
    target = F.coalesce(F.get(logits, place).cast("double"), F.lit(NAN))
    return F.when(inside, log_sum_exp(logits) - target)


def top_ids(logits: Column, k: int) -> Column:
    """Ids of the k highest logits, best first; equal logits go to the lower id."""

    def pair(v: Column, i: Column) -> Column:
        value = F.coalesce(F.nanvl(v.cast("double"), F.lit(LOWEST)), F.lit(LOWEST))
        return F.struct((-value).alias("neg"), i.cast("int").alias("id"))

    pairs = F.transform(logits, pair)
    return F.transform(F.slice(F.sort_array(pairs), 1, k), lambda p: p["id"])


def arrow_reducer(k: int):
    """Arrow UDF (logits, label) -> struct(nll, topk).

    The function refers to nothing else in this package, so executors need not have it installed.
    """

    @F.arrow_udf("struct<nll: double, topk: array<int>>")
    def reduce(logits: pa.Array, label: pa.Array) -> pa.Array:
        values = logits.flatten().to_numpy(zero_copy_only=False)
        starts = logits.offsets.to_numpy() - logits.offsets[0].as_py()
        nll: list[float | None] = []
        best: list[np.ndarray | None] = []
        for i, (target, known) in enumerate(zip(label.to_pylist(), logits.is_valid().to_pylist())):
            if not known:
                nll.append(None)
                best.append(None)
                continue
            row = values[starts[i] : starts[i + 1]].astype(np.float64)
            if target is None or not 0 <= target < row.size:
                nll.append(None)
            else:
                top = row.max()
                if top == -np.inf:
                    nll.append(None)
                else:
                    nll.append(float(top + np.log(np.exp(row - top).sum()) - row[target]))
            row = np.where(np.isnan(row), -np.inf, row)
            # All ids at or above the k-th value, in id order; a stable sort keeps ties that way.
            size = min(k, row.size)
            floor = np.partition(row, row.size - size)[row.size - size] if size else np.inf
            ids = np.flatnonzero(row >= floor)
            best.append(ids[np.argsort(-row[ids], kind="stable")][:size].astype(np.int32))
        return pa.StructArray.from_arrays(
            [pa.array(nll, pa.float64()), pa.array(best, pa.list_(pa.int32()))], ["nll", "topk"]
        )

    return reduce


def reduce_logits(
    logits: Column, label: Column, layout: TokenLayout, k: int, wide: bool | None = None
) -> Column:
    """struct(nll, topk) of one position."""
    if wide is None:
        wide = layout.total_vocab_size > WIDE_VOCABULARY
    if wide:
        return arrow_reducer(k)(logits, label)
    return F.struct(label_nll(logits, label).alias("nll"), top_ids(logits, k).alias("topk"))
