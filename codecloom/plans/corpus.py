"""Corpus preparation: sources -> filter -> codes and tokens -> sequences -> union -> save."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from codecloom.config import CorpusConfig
from codecloom.functions.codec import within_duration
from codecloom.functions.sequences import ones_like, training_sequence
from codecloom.layout import TokenLayout
from codecloom.operators.codes import add_codes, filter_duration, within_or_unknown
from codecloom.operators.ranking import seeded_cut
from codecloom.operators.sampling import KEYS, ordered_union, source_cap
from codecloom.operators.tokens import add_text_tokens
from codecloom.operators.validate import accepted, flag_rows, rejected, stage_counts
from codecloom.sources.load import load_sources
from codecloom.sources.store import (
    ACCEPTED,
    COUNTS_SCHEMA,
    REJECTED,
    ROWS_PER_FILE,
    save_length_stats,
    write_manifest,
    write_rows,
)

ORDER_KEYS = ("source_ord", "row_file", "row_ord", "utt_id")
DERIVED_COLUMNS = ("labels", "attention_mask")
TRAINING_COLUMNS = ("input_ids", "labels", "attention_mask", "encoded_len", "speaker_emb")

Tokenizer = Callable[[Column], Column]


def build_sequences(df: DataFrame, tokenizer: Tokenizer, layout: TokenLayout) -> DataFrame:
    """Usable canonical rows -> text_tokens, codes, input_ids. Narrow: no exchange.

    Rows without codes are gone before this point (`usable_rows` checks the layer arrays).
    """
    coded = add_codes(add_text_tokens(df, tokenizer, layout), layout)
    return coded.withColumn(
        "input_ids", training_sequence(F.col("text_tokens"), F.col("codes"), layout)
    )


def add_labels_and_mask(df: DataFrame) -> DataFrame:
    """Labels equal the ids (the prompt is not masked) and the mask is all ones.

    Both follow from `input_ids`, so add them after shuffles, not before.
    """
    return df.withColumns({"labels": F.col("input_ids"), "attention_mask": ones_like(F.col("input_ids"))})


def training_columns(df: DataFrame, derived: bool = True, extra: Sequence[str] = ()) -> DataFrame:
    """Order keys and the five training columns.

    With derived=False, labels and mask are left out: they repeat `input_ids`, take as much space
    again, and the collation fills them in. `extra` columns follow.
    """
    keys = [k for k in ORDER_KEYS if k in df.columns]
    skipped = () if derived else DERIVED_COLUMNS
    whole = df.withColumn("encoded_len", F.col("encoded_len").cast("int"))
    full = add_labels_and_mask(whole) if derived else whole
    return full.select(*keys, *[c for c in TRAINING_COLUMNS if c not in skipped], *extra)


def usable_rows(df: DataFrame, layout: TokenLayout, max_seconds: float | None) -> DataFrame:
    """Duration cap on the original length, then rows that can be prepared at all."""
    return accepted(filter_duration(df, max_seconds), layout)


def prepare_corpus(
    spark: SparkSession,
    config: CorpusConfig,
    tokenizer: Tokenizer,
    layout: TokenLayout = TokenLayout(),
    derived: bool = True,
) -> DataFrame:
    """The unified training corpus as one lazy plan.

    Every stage is row by row except the cap of a source, which is taken before the arrays are
    built: preparation maps one row to one row, so the sample is the same and the work smaller.
    """
    prepared = []
    for cfg, rows in zip(config.sources, load_sources(spark, config, layout), strict=True):
        usable = usable_rows(rows, layout, config.max_duration_sec)
        capped = source_cap(usable, cfg.max_len, config.seed)
        prepared.append(training_columns(build_sequences(capped, tokenizer, layout), derived))
    return ordered_union(prepared)


def corpus_rejects(
    spark: SparkSession, config: CorpusConfig, layout: TokenLayout = TokenLayout()
) -> DataFrame:
    """Rows of all sources that cannot be prepared, with the reason; the cap does not hide them."""
    parts = [
        rejected(within_or_unknown(rows, config.max_duration_sec), layout).select(
            *ORDER_KEYS, "source", "reject_reason"
        )
        for rows in load_sources(spark, config, layout)
    ]
    return ordered_union(parts)


def corpus_counts(
    spark: SparkSession, config: CorpusConfig, layout: TokenLayout = TokenLayout()
) -> DataFrame:
    """Stage counts per source, with the configured cap and whether the source falls short of it."""
    parts = []
    for cfg, rows in zip(config.sources, load_sources(spark, config, layout), strict=True):
        counts = stage_counts(rows, layout, config.max_duration_sec, ["source"])
        cap = F.lit(cfg.max_len).cast("bigint")
        parts.append(
            counts.withColumns(
                {
                    "cap": cap,
                    "n_kept": F.least(F.col("n_prepared"), cap),
                    "short_of_cap": F.coalesce(F.col("n_prepared") < cap, F.lit(False)),
                }
            )
        )
    return ordered_union(parts)


def observed_rows(
    spark: SparkSession,
    config: CorpusConfig,
    tokenizer: Tokenizer,
    layout: TokenLayout = TokenLayout(),
    derived: bool = True,
) -> tuple[DataFrame, list[Observation]]:
    """Accepted and rejected rows of all sources in one plan, and the counts of each source.

    Every source is scanned once: the reason is computed with the row, the counts are taken on the way
    to the writer. Rejected rows have the order keys, `source` and the reason; their arrays are NULL. Only
    a cap reads a source's keys besides, to find the cut-off.
    """
    parts, counts = [], []
    for k, (cfg, rows) in enumerate(zip(config.sources, load_sources(spark, config, layout), strict=True)):
        in_time = within_duration(F.col("encoded_len"), config.max_duration_sec)
        # A NULL length cannot be compared; such rows are rejected, not filtered.
        passes = F.lit(True) if in_time is None else F.coalesce(in_time, F.lit(True))
        flagged = flag_rows(rows, layout).withColumn("__passes", passes)
        bad = F.col("reject_reason").isNotNull()
        seen = Observation(f"source-{k}")
        flagged = flagged.observe(
            seen,
            F.count(F.lit(1)).alias("n_read"),
            F.count_if("__passes").alias("n_in_duration"),
            F.count_if(F.col("__passes") & bad).alias("n_rejected"),
            F.count_if(F.col("__passes") & ~bad).alias("n_prepared"),
        )
        counts.append(seen)
        kept = flagged.where("__passes")
        if cfg.max_len is not None:
            usable = usable_rows(rows, layout, config.max_duration_sec)
            kept = kept.where(bad | seeded_cut(usable, KEYS, cfg.max_len, config.seed))
        # A rejected row goes through the array work as an empty one.
        empty = F.array().cast("array<int>")
        safe = {c: F.when(bad, empty).otherwise(F.col(c)) for c in layout.layer_columns}
        safe["text"] = F.when(bad, F.lit("")).otherwise(F.col("text"))
        built = build_sequences(kept.withColumns(safe), tokenizer, layout)
        built = built.withColumn("input_ids", F.when(~bad, F.col("input_ids")))
        whole = training_columns(built, derived, ("source", "reject_reason"))
        status = F.when(bad, F.lit(REJECTED)).otherwise(F.lit(ACCEPTED))
        length = F.when(~bad, F.col("encoded_len"))
        parts.append(whole.withColumns({"encoded_len": length, "status": status}))
    return ordered_union(parts), counts


def run_preparation(
    spark: SparkSession,
    config: CorpusConfig,
    tokenizer: Tokenizer,
    output: str,
    layout: TokenLayout = TokenLayout(),
    derived: bool = True,
    rows_per_file: int = ROWS_PER_FILE,
) -> None:
    """Save the corpus with its rejected rows, stage counts and (if configured) statistics.

    One job writes the rows of both kinds and counts them. The statistics read the saved lengths. The
    manifest comes last; until then nothing can be opened, and a repeated run starts anew. A source with
    fewer usable rows than its cap contributes all of them; the counts mark it.
    """
    base = output.rstrip("/")
    rows, seen = observed_rows(spark, config, tokenizer, layout, derived)
    write_rows(rows, base, rows_per_file)
    counts = []
    for k, (cfg, found) in enumerate(zip(config.sources, seen, strict=True)):
        n, cap = found.get, cfg.max_len
        kept = n["n_prepared"] if cap is None else min(n["n_prepared"], cap)
        counts.append(
            (k, cfg.name, n["n_read"], n["n_in_duration"], n["n_rejected"], n["n_prepared"], cap, kept,
             cap is not None and n["n_prepared"] < cap)
        )
    spark.createDataFrame(counts, COUNTS_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{base}/counts")
    if config.length_statistics:
        lengths = spark.read.schema("encoded_len int, status string").parquet(f"{base}/rows")
        lengths = lengths.where(F.col("status") == F.lit(ACCEPTED))
        save_length_stats(lengths, f"{base}_length_statistics")
    write_manifest(spark, base)
