"""Language identification as multilingual mixture inference.

Learning counts hashed character trigrams per language over all documents that may be used; the model
is a table of 2**HASH_BITS smoothed probabilities per language. A document is taken as a mixture of
languages: expectation-maximisation estimates the share of each from the likelihoods of the document's
trigrams. The set of languages grows by the next likely language as long as the likelihood, less a
penalty for every further language, does.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codecloom.llm.common import held_out, slices

HASH_BITS = 14
SMOOTHING = 0.5
ROUNDS = 10
# Neighbouring trigrams share letters, so a document holds about a third as many independent ones.
PENALTY = 3.0
MIN_SHARE = 0.01
MAX_LANGUAGES = 1024
UNKNOWN = "und"
HELD_OUT = (3, 1)
STEP = 1 << 20


class Trigrams:
    """Counts of hashed trigrams of the letters of a text; other characters separate words."""

    def __init__(self):
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)

    def counts(self, text: str) -> np.ndarray | None:
        """2**HASH_BITS counts, or None for a text without a letter. Long texts go in steps."""
        total, tail = None, np.array([32], dtype=np.uint32)
        for k in range(0, len(text), STEP):
            lowered = text[k : k + STEP].lower().encode("utf-32-le", "surrogatepass")
            points = np.frombuffer(lowered, dtype="<u4")
            is_letter = self.letter[points]
            if total is None and not is_letter.any():
                continue
            points = np.concatenate([tail, np.where(is_letter, points, np.uint32(32))])
            space = points == 32
            points = points[np.concatenate([[True], ~(space[1:] & space[:-1])])]
            tail = points[-2:]
            if len(points) < 3:
                total = np.zeros(1 << HASH_BITS, dtype=np.int64) if total is None else total
                continue
            p = points.astype(np.uint64)
            h = (p[:-2] * np.uint64(0x9E3779B1) + p[1:-1] * np.uint64(0x85EBCA77)) ^ (
                p[2:] * np.uint64(0xC2B2AE3D)
            )
            h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)
            found = np.bincount(h.astype(np.int64), minlength=1 << HASH_BITS)
            total = found if total is None else total + found
        return total


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities (2**HASH_BITS by languages)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trigrams, seen = Trigrams(), {}

        def flush():
            for lang, total in seen.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])],
                    ["lang", "bucket", "n"],
                )
            seen.clear()

        for batch in slices(batches, text=1):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = trigrams.counts(text)
                if found is not None:
                    seen[lang] = seen[lang] + found if lang in seen else found
                    if len(seen) > 256:
                        yield from flush()
        yield from flush()

    rows = docs.where(~held_out(id_col, *HELD_OUT)).where(
        F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
    )
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    languages = rows.select("lang").distinct().count()
    if languages > MAX_LANGUAGES:
        raise ValueError(f"{languages} languages; at most {MAX_LANGUAGES} are modelled")
    counts = rows.mapInArrow(run, "lang string, bucket bigint, n bigint")
    # One row per language and bucket: the size follows the number of languages only.
    table = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(table["lang"].unique())
    place = {lang: i for i, lang in enumerate(langs)}
    counted = np.full((1 << HASH_BITS, len(langs)), SMOOTHING)
    np.add.at(counted, (table["bucket"].to_numpy(), table["lang"].map(place).to_numpy(dtype=int)), table["n"])
    return langs, np.log(counted / counted.sum(axis=0)) if langs else counted


def mixture(p: np.ndarray, c: np.ndarray, shares: np.ndarray, rounds: int) -> np.ndarray:
    """Shares of the columns of `p` after EM rounds over items with counts `c`."""
    total = c.sum()
    for _ in range(rounds):
        shares = shares * (p.T @ (c / (p @ shares))) / total
    return shares / shares.sum()


def infer(p: np.ndarray, log_p: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen columns and their shares, largest first."""
    single = c @ log_p
    first = int(single.argmax())
    chosen, shares, value = np.array([first]), np.ones(1), single[first]
    if p.shape[1] == 1:
        return chosen, shares
    # EM over all languages gives the order in which they are tried.
    every = mixture(p, c, np.full(p.shape[1], 1.0 / p.shape[1]), ROUNDS)
    penalty = PENALTY * np.log(max(2.0, c.sum()))
    for nxt in np.argsort(-every):
        if nxt == first:
            continue
        if every[nxt] < MIN_SHARE:
            break
        trial = np.append(chosen, nxt)
        start = np.maximum(every[trial], MIN_SHARE)
        got = mixture(p[:, trial], c, start / start.sum(), ROUNDS)
        reached = c @ np.log(p[:, trial] @ got)
        if reached - value <= penalty:
            break
        chosen, shares, value = trial, got, reached
    order = np.argsort(-shares, kind="stable")
    return chosen[order], shares[order]


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    carry: Sequence[str] = (),
) -> DataFrame:
    """(id, held_out, lang_pred, score, languages, has_letter[, row]) for every row.

    `lang_pred` is the language with the largest share in the chosen set, `score` that share, and
    `languages` the set as `lang:share` pairs. NULL texts and texts without a letter are `und` with
    score 0, and so is every text if there is nothing to learn from; `has_letter` tells the two apart. Rows
    without a language are predicted but not learnt from. NULL ids are not held out. Other columns are
    ignored, unless `carry` names them: then they come back in the struct `row`.
    """
    langs, log_p = learn(docs, id_col, text_col, lang_col)
    log_p = log_p.astype(np.float32)
    # A text that comes back in the row is sent once.
    inside = list(carry).index(text_col) if text_col in carry else None

    def with_text(batch: pa.RecordBatch) -> pa.RecordBatch:
        if inside is None:
            return batch
        row = batch.column(2)
        return pa.RecordBatch.from_arrays([*batch.columns[:2], row.field(inside), row], ["id", "held_out", "text", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trigrams = Trigrams()
        log_table = log_p.astype(np.float64)
        table = np.exp(log_table)
        for batch in slices(map(with_text, batches), text=2):
            best, share, sets, letters = [], [], [], []
            for text in batch.column(2).to_pylist():
                found = trigrams.counts(text) if text else None
                letters.append(found is not None)
                if found is None or not langs:
                    best.append(UNKNOWN)
                    share.append(0.0)
                    sets.append("")
                    continue
                at = np.flatnonzero(found)
                c = found[at].astype(np.float64)
                if not len(at):  # a single letter: no trigram
                    chosen, shares = np.array([0]), np.array([1.0 / len(langs)])
                else:
                    chosen, shares = infer(table[at], log_table[at], c)
                best.append(langs[chosen[0]])
                share.append(min(1.0, float(shares[0])))
                sets.append(",".join(f"{langs[i]}:{s:.3f}" for i, s in zip(chosen, shares)))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array(best, pa.string()),
                    pa.array(share, pa.float64()),
                    pa.array(sets, pa.string()),
                    pa.array(letters, pa.bool_()),
                    *batch.columns[3:],
                ],
                schema.names,
            )

    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        held_out(id_col, *HELD_OUT).alias("held_out"),
        *([F.col(text_col).alias("text")] if inside is None else []),
        *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []),
    )
    schema = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("held_out", T.BooleanType()),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("languages", T.StringType()),
            T.StructField("has_letter", T.BooleanType()),
            *[field for field in rows.schema.fields[2:] if field.name == "row"],
        ]
    )
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
