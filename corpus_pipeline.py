"""The training-data pipeline: five stages over `documents`, each written and read again.

Languages are identified, missing ones filled in and texts without one dropped; repeated lines go; of each
near-duplicate group one document stays; the sources are interleaved by target weights; the result is packed into
sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecloom.llm.common import fresh_name, id_order, table, with_place, written
from codecloom.llm.language_id import UNKNOWN, identify
from codecloom.llm.line_dedup import line_dedup
from codecloom.llm.mixing import in_mixed_order
from codecloom.llm.packing import pack_documents
from codecloom.llm.queries import tokenizer_path
from codecloom.llm.simhash import near_duplicates


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: NULL texts and texts without a letter.

    A NULL `lang` becomes the predicted language; a given one is kept. If no row may be learnt from, nothing
    is predicted and texts with a letter stay as they are. Other columns come back untouched.
    """
    known = identify(docs, carry=docs.columns).where("has_letter")
    predicted = F.when(F.col("lang_pred") != F.lit(UNKNOWN), F.col("lang_pred"))
    lang = F.coalesce(F.col("row.lang"), predicted).alias("lang")
    return known.select(*[lang if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that an earlier document holds. `n_chars` counts what is left; other columns stay."""
    changed = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("bigint")}
    others = [c for c in docs.columns if c not in ("doc_id", *changed)]
    nested = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in others]).alias("others"))
    done = line_dedup(nested, carry=("others",))
    return done.select(
        *[
            F.col("doc_id") if c == "doc_id" else changed[c].alias(c) if c in changed else F.col(f"others.`{c}`")
            for c in docs.columns
        ]
    )


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate group: that of the smallest id, the first in the files of several.

    Documents are linked if the fingerprints of their three-word shingles differ in at most three bits.
    Rows are told apart by their place in the files, so rows that repeat an id stay or go by their own
    text, and of a group of rows without an id the first stays. Documents without words, which the line
    stage may leave, are one group.
    """
    place = fresh_name("place", docs.columns)
    placed = with_place(docs, place)
    own = F.col(f"row.`{place}`").alias("place")
    marks = near_duplicates(placed, carry=(place,)).select("component_fp", id_order("doc_id").alias("ord"), own)
    marks = written(marks, "near-copies")
    first = F.min(F.struct("ord", "place")).alias("first")
    kept = marks.groupBy("component_fp").agg(first).select(F.col("first.place").alias("place"))
    dropped = marks.select("place").join(kept, "place", "left_anti")
    dropped = written(dropped.withColumnRenamed("place", place), "near-copies-dropped")
    return placed.join(dropped, place, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Interleave the sources; the files hold the documents in the order of the mixture."""
    return in_mixed_order(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences that ascend in the order of the mixture's files."""
    place = fresh_name("place", docs.columns)
    return pack_documents(with_place(docs, place), tokenizer_path(), place_col=place)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("source_mixing", mixing_stage),
    ("packing", packing_stage),
]

# Fingerprints, token ids and the learnt language model are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every stage but the last is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
