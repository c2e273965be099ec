"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the presence of hashed words, pairs of neighbours and pairs with one or two
words between them. Learning runs on shards of labelled documents: in each, FTRL-proximal passes over
the documents in a fixed order with a learning rate per coordinate and L1 shrinkage, and the shards'
weights are averaged. What is left after shrinkage is a small sparse vector of at most 2**HASH_BITS
weights, which scoring tasks receive with their code.

Learning uses at most about MAX_SHARDS * SHARD_ROWS labelled documents, picked by a hash of their id;
every document is scored. `setting_losses` compares settings by cross-validation over labelled rows that
may be learnt from; held-out labels take no part in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecloom.llm.common import held_out, slices, whole_text

HASH_BITS = 18
SHARD_ROWS = 4096
MAX_SHARDS = 16
THRESHOLD = 0.3
HELD_OUT = (4, 2)
# Labelled rows that the comparison of settings uses at most, about, and its folds.
SEARCH_ROWS = 8192
FOLDS = 4


@dataclass(frozen=True)
class Settings:
    """How FTRL-proximal learns: the learning rate alpha / (beta + sqrt(n)), shrinkage, and passes.

    alpha, l1 and the passes are those of least loss in `setting_losses` over GRID.
    """

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.1
    epochs: int = 3


GRID = tuple(Settings(alpha=a, l1=s) for a in (0.3, 1.0, 3.0) for s in (2.0, 4.0, 8.0, 16.0, 32.0))
GRID_EPOCHS = 8

# A-Z to lower case, ASCII white space, controls and punctuation to a space.
_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def features(text: bytes) -> np.ndarray:
    """Hashed indexes of words, neighbouring pairs and skip pairs, with repeats."""
    words = text.translate(_LETTERS).split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    h = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))
    parts = [h * np.uint64(0x9E3779B97F4A7C15)]
    for gap in (1, 2, 3):
        if len(h) > gap:
            pair = h[:-gap] * np.uint64(0xC2B2AE3D27D4EB4F) + h[gap:] * np.uint64(0x165667B19E3779F9)
            parts.append((pair + np.uint64(gap)) * np.uint64(0x9E3779B97F4A7C15))
    return (np.concatenate(parts) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


class Ftrl:
    """FTRL-proximal over binary features, with an intercept that is not shrunk."""

    def __init__(self, settings: Settings, size: int = 1 << HASH_BITS):
        self.s = settings
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.bias = size

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(0.0, np.abs(z) - self.s.l1)
        w = -shrunk / ((self.s.beta + np.sqrt(n)) / self.s.alpha + self.s.l2)
        if isinstance(at, slice):
            w[self.bias] = self.intercept()
        return w

    def intercept(self) -> float:
        return -self.z[self.bias] / ((self.s.beta + np.sqrt(self.n[self.bias])) / self.s.alpha)

    def learn(self, at: np.ndarray, label: int) -> None:
        """One step on a text with the distinct features `at`."""
        w, w0 = self.weights(at), self.intercept()
        p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + w0, -35, 35)))
        g = p - label
        for where, value in ((at, w), (self.bias, w0)):
            n = self.n[where]
            sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha
            self.z[where] += g - sigma * value
            self.n[where] = n + g * g


def probability(score: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(score, -35, 35)))


def train_shard(texts: list[bytes], labels: list[int], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and values of the weights that are not zero."""
    model = Ftrl(settings)
    found = [np.unique(features(t)) for t in texts]
    for _ in range(settings.epochs):
        for at, label in zip(found, labels):
            model.learn(at, label)
    w = model.weights()
    at = np.flatnonzero(w)
    return at, w[at]


def learnable(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(_id, _y) of the labels that may be learnt from; of several of one id the largest."""
    return (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .where(~held_out(id_col, *HELD_OUT))
        .groupBy(F.col(id_col).cast("bigint").alias("_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    )


def at_most(known: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """About `limit` of the rows, picked by a hash of the id, and how many there were."""
    n = known.count()
    if n > limit:
        share = int(limit / n * (1 << 30))
        known = known.where(F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(1 << 30)) < F.lit(share))
    return known, n


def labelled_texts(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    # The labels picked are bounded in number, so they may be sent to every task.
    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), whole_text(text_col).alias("_t"))
    return texts.join(F.broadcast(known), "_id").withColumn("_order", F.xxhash64("_id", F.lit(13)))


def in_order(rows: pd.DataFrame) -> tuple[list[bytes], list[int]]:
    rows = rows.sort_values(["_order", "_id", "_t"])
    return [t.encode("utf-8", "surrogatepass") for t in rows["_t"]], rows["_y"].tolist()


def setting_losses(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    grid: tuple[Settings, ...] = GRID,
    epochs: int = GRID_EPOCHS,
) -> DataFrame:
    """(setting, epochs, n, loss): mean log loss of each setting of `grid` after each number of passes.

    Labelled rows that may be learnt from, at most about SEARCH_ROWS of them, are dealt to folds by a hash
    of their id; a group learns on all folds but one and is measured on that one. Held-out rows are not read.
    """
    known, _ = at_most(learnable(labels, id_col, label_col), SEARCH_ROWS)
    rows = labelled_texts(docs, known, id_col, text_col)
    rows = rows.withColumn("_in", F.pmod(F.xxhash64("_id", F.lit(17)), F.lit(FOLDS)).cast("int"))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    rows = rows.withColumn("_fold", every(FOLDS)).withColumn("_setting", every(len(grid)))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fold, setting = key
        model = Ftrl(grid[setting])
        inside = rows["_in"] == fold
        sets = []
        for part in (rows[~inside], rows[inside]):
            texts, marks = in_order(part)
            sets.append(([np.unique(features(t)) for t in texts], np.array(marks)))
        (learn, learn_y), (test, test_y) = sets
        out = []
        for done in range(1, epochs + 1):
            for at, label in zip(learn, learn_y):
                model.learn(at, label)
            w = model.weights()
            p = probability(np.array([w[at].sum() for at in test]) + w[model.bias])
            loss = -np.log(np.where(test_y == 1, p, 1 - p)).sum()
            out.append((setting, done, len(test), float(loss)))
        return pd.DataFrame(out, columns=["setting", "epochs", "n", "loss"])

    found = rows.groupBy("_fold", "_setting").applyInPandas(run, "setting int, epochs int, n bigint, loss double")
    return found.groupBy("setting", "epochs").agg(
        F.sum("n").alias("n"), (F.sum("loss") / F.greatest(F.sum("n"), F.lit(1))).alias("loss")
    )


def train(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, settings: Settings
) -> tuple[np.ndarray, np.ndarray]:
    """Averaged weights over the shards (indexes, values); empty if there is nothing to learn from."""
    known, n = at_most(learnable(labels, id_col, label_col), MAX_SHARDS * SHARD_ROWS)
    shards = max(1, min(MAX_SHARDS, n // SHARD_ROWS))
    rows = labelled_texts(docs, known, id_col, text_col)
    rows = rows.withColumn("_shard", F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(shards)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        at, w = train_shard(*in_order(rows), settings)
        return pd.DataFrame({"at": at, "w": w})

    per_shard = rows.groupBy("_shard").applyInPandas(run, "at bigint, w double")
    mean = per_shard.groupBy("at").agg((F.sum("w") / F.lit(float(shards))).alias("w")).toPandas()
    mean = mean.sort_values("at")
    return mean["at"].to_numpy(dtype=np.int64), mean["w"].to_numpy(dtype=np.float64)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    settings: Settings = Settings(),
) -> DataFrame:
    """(id, held_out, score, predicted) for every row.

    The score is the probability of label 1; NULL and empty texts have the score of a text without
    features. Labels of NULL, of unknown ids and of held-out rows are not used; of several labels of
    one id the largest counts. Without labels every score is 0. NULL ids are not held out. Other
    columns are ignored.
    """
    at, values = train(docs, labels, id_col, text_col, label_col, settings)
    bias_at = 1 << HASH_BITS
    learned = bool(len(at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(bias_at + 1)
        weights[at] = values
        active = weights != 0
        for batch in slices(batches, text=2):
            out = []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                found = features(text)
                found = np.unique(found[active[found]])
                out.append(float(weights[found].sum() + weights[bias_at]))
            score = probability(np.array(out)) if learned else np.zeros(len(out))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                ["id", "held_out", "score", "predicted"],
            )

    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        held_out(id_col, *HELD_OUT).alias("held_out"),
        whole_text(text_col).alias("text"),
    )
    scored = rows.mapInArrow(run, "id bigint, held_out boolean, score double, predicted int")
    return scored.withColumnRenamed("id", id_col)
