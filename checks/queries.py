"""One query per operator, over the whole provided tables.

Long arrays are reported as length plus md5 of their comma-joined text, which any SQL engine can
repeat. Floating results are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codecloom import fixtures as fx
from codecloom.config import CorpusConfig, SourceConfig
from codecloom.functions import alpha, codec, logits, sequences, vectors
from codecloom.layout import TokenLayout, join_layer_ranges
from codecloom.operators import alpha_report as ar
from codecloom.operators import attention_stats as at
from codecloom.operators import codes as cd
from codecloom.operators import collate as co
from codecloom.operators import corpus_stats as cs
from codecloom.operators import positions as ps
from codecloom.operators import run_metrics as rm
from codecloom.operators import sampling as sm
from codecloom.operators import scoring as sc
from codecloom.operators import shards as sh
from codecloom.operators import tokens as tk
from codecloom.operators import validate as va
from codecloom.operators import verdicts as vd
from codecloom.plans import corpus as pc
from codecloom.plans import evaluation as ev
from codecloom.plans import training_view as tv
from codecloom.session import shared_path
from codecloom.sources import load as ld
from codecloom.sources import metric_store as ms
from codecloom.sources import store as st

L = TokenLayout()
TINY = fx.TINY
SEED = 7
BATCH = 8
CAP_SECONDS = 120
STEP = 0.5

Query = Callable[[SparkSession, str], DataFrame]


def joined_digest(values: Column) -> Column:
    """`digest` of an array that a lambda makes: it is evaluated once here."""
    return F.md5(F.array_join(values.cast("array<string>"), ","))


def digest(values: Column) -> Column:
    """md5 of whole numbers joined by commas; NULL elements are left out, a NULL array is NULL.

    JSON writes the numbers into one buffer, where a cast makes a string of each. Arrays with a NULL
    element (or the least long, which the look for one takes) are joined; the others fill one of two places.
    """
    text = F.to_json(values)
    inside = F.substring(text.cast("binary"), F.lit(2), F.octet_length(text) - F.lit(2))
    # Not found among elements of which one is NULL is NULL.
    odd = F.coalesce(F.array_contains(values, F.lit(-(2**63)).cast("bigint")), F.lit(True))
    return F.get(F.array(F.md5(inside), F.when(odd, joined_digest(values))), odd.cast("int"))


def frame_digest(frames: Column) -> Column:
    return F.md5(codec.frame_texts(frames, L))


def half_steps(positions: Column) -> Column:
    """Positions with step 0.5 as whole numbers of half steps."""
    return F.transform(positions, lambda p: (p * F.lit(2.0)).cast("bigint"))


def r6(df: DataFrame, **places: int) -> DataFrame:
    """Round double columns to six places, or to the places given by name."""
    return df.select(
        *[
            F.round(c, places.get(c, 6)).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


# --- shared inputs ---------------------------------------------------------------------------


_TOKENIZERS: dict[tuple[str, str], tk.WordTokenizer] = {}


def tokenizer(spark: SparkSession, sf: str) -> tk.WordTokenizer:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = tk.WordTokenizer(fx.vocabulary(spark, sf), L)
    return _TOKENIZERS[key]


def rows(spark: SparkSession, sf: str) -> DataFrame:
    return fx.codec_table(spark, sf)


def sequences_of(spark: SparkSession, sf: str) -> DataFrame:
    usable = pc.usable_rows(rows(spark, sf), L, None)
    return pc.build_sequences(usable, tokenizer(spark, sf).column, L)


def corpus_config(spark: SparkSession, sf: str) -> CorpusConfig:
    entry = {
        "reponame": fx.codec_path(spark, sf),
        "name": "main",
        "id_col": "utt_id",
        "speaker_emb": "speaker_emb",
        "language_tag": "EN",
    }
    return CorpusConfig.from_dict(
        {
            "max_duration_sec": None,
            "lenght_statistics": True,
            "hf_datasets": [entry, {**entry, "name": "second", "language_tag": None, "max_len": 150}],
        }
    )


def prepared_path(spark: SparkSession, sf: str) -> str:
    key = (spark.sparkContext.applicationId, sf, "prepared")
    if key not in fx._TABLES:
        path = shared_path(spark, "prepared")
        pc.run_preparation(
            spark, corpus_config(spark, sf), tokenizer(spark, sf).column, path, L
        )
        fx._TABLES[key] = path
    return fx._TABLES[key]


def _tail(column: str):
    """All elements but the first."""
    return F.slice(column, F.lit(2), F.greatest(F.size(column) - F.lit(1), F.lit(0)))


def damaged(spark: SparkSession, sf: str) -> DataFrame:
    """Codec rows with every kind of defect put into some of them."""
    u = F.col("utt_id")
    empty = F.array().cast("array<int>")
    broken = {
        "encoded_len": F.when(u % 41 != 0, F.col("encoded_len")),
        "nano_layer_2": F.when(u % 43 != 0, F.col("nano_layer_2")),
        "nano_layer_3": F.when(u % 47 == 0, _tail("nano_layer_3")).otherwise(
            F.col("nano_layer_3")
        ),
        "nano_layer_4": F.when(
            u % 59 == 0, F.concat(F.array(F.lit(None).cast("int")), _tail("nano_layer_4"))
        ).otherwise(F.col("nano_layer_4")),
    }
    hurt = rows(spark, sf).withColumns(broken)
    return hurt.withColumns(
        {c: F.when(u % 53 == 0, empty).otherwise(F.col(c)) for c in L.layer_columns}
    )


def batched(spark: SparkSession, sf: str) -> DataFrame:
    """Batched sequences; some rows lack a speaker vector, a mask or labels."""
    u = F.col("utt_id")
    ids = F.col("input_ids")
    seqs = sequences_of(spark, sf).select(
        "utt_id",
        "input_ids",
        F.when(u % 23 != 0, F.col("speaker_emb")).alias("speaker_emb"),
    )
    placed = sm.assign_batches(seqs, BATCH, SEED)
    return placed.withColumns(
        {
            "attention_mask": F.when(u % 29 != 0, sequences.ones_like(ids)),
            "labels": F.when(
                u % 31 != 0, F.concat(F.array(F.lit(-100).cast("bigint")), _tail("input_ids"))
            ),
        }
    )


def prediction_labels(spark: SparkSession, sf: str) -> DataFrame:
    return fx.predictions(spark, sf).drop("logits")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return sc.score_aligned(fx.aligned_predictions(spark, sf), TINY)


def targets_of(spark: SparkSession, sf: str) -> DataFrame:
    return sc.scored_targets(prediction_labels(spark, sf), TINY)


def influence_pairs(spark: SparkSession, sf: str) -> DataFrame:
    sources = fx.predictions(spark, sf).select(
        "seq_id", "pos", vectors.l2_norm(F.col("logits")).alias("norm")
    )
    pairs = at.past_token_pairs(targets_of(spark, sf), sources, TINY)
    gap = F.lit(1) + F.col("pos") - F.col("src_pos")
    return pairs.withColumn("influence", F.col("norm") / gap)


def shares(spark: SparkSession, sf: str) -> DataFrame:
    tokens = prediction_labels(spark, sf).select("seq_id", "pos", F.col("label").alias("token_id"))
    recorded = influence_pairs(spark, sf).select("seq_id", "pos", "src_pos", "influence")
    return at.influence_share(
        at.influence_by_target(recorded, targets_of(spark, sf), tokens, TINY)
    )


def totals(spark: SparkSession, sf: str) -> DataFrame:
    return sc.score_totals(scored(spark, sf), TINY)


def per_output(spark: SparkSession, sf: str) -> DataFrame:
    return at.variance_per_output(fx.hidden_states(spark, sf))


def alphas(spark: SparkSession, sf: str) -> DataFrame:
    return ar.rotation_parameters(fx.parameter_log(spark, sf), ["step"])


def metric_row(spark: SparkSession, sf: str) -> DataFrame:
    return ev.metric_row(scored(spark, sf), fx.hidden_states(spark, sf), TINY)


# --- sources and sinks -----------------------------------------------------------------------


def source_split(spark, sf):
    """Two splits and no split of a corpus in folders of subsets, partitioned by split."""

    def parts():
        train = F.when(F.col("utt_id") % 5 == 0, "validation").otherwise("train")
        return rows(spark, sf).withColumn("split", train)

    key = (spark.sparkContext.applicationId, sf, "split_rows")
    if key not in fx._TABLES:
        path = shared_path(spark, "split_rows")
        parts().write.partitionBy("split").parquet(f"{path}/speech")
        fx._TABLES[key] = path
    entry = {"path": fx._TABLES[key], "subset": "speech", "id_col": "utt_id", "speaker_emb": "speaker_emb"}
    entries = [
        {**entry, "name": "train", "split": "train", "split_col": "split"},
        {**entry, "name": "validation", "split": "split=validation"},
        {**entry, "name": "all"},
    ]
    config = CorpusConfig.from_dict({"sources": entries})
    return sm.ordered_union(ld.load_sources(spark, config, L)).groupBy("source_ord", "source").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("encoded_len").alias("frames"),
        F.sum(F.size("nano_layer_4").cast("bigint")).alias("codes"),
    )


def metric_log_rewritten(spark, sf):
    """The log written twice, the second time by a job that dies before its blocks are in place."""
    path = shared_path(spark, "metric_store")
    log = fx.metric_log(spark, sf).withColumn("run_id", F.concat(F.lit("run-"), F.col("step") % F.lit(3)))
    ms.write_metrics(log.where(F.col("step") % 4 != 0), path)
    ms.stage_metrics(log, path)
    ms.write_metrics(log.where(F.col("step") % 7 == 0), path)
    kept = F.nanvl("value", F.lit(None).cast("double"))
    return r6(
        ms.read_metrics(spark, path)
        .groupBy("run_id", "metric", "batch_id")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count(kept).alias("n_values"),
            F.max("step").alias("last_step"),
            F.avg(kept).alias("mean_value"),
        )
    )


def preparation_counts(spark, sf):
    """Counts observed while the rows of damaged sources were written, with the rejects beside them."""
    key = (spark.sparkContext.applicationId, sf, "damaged_corpus")
    if key not in fx._TABLES:
        fx.stored(spark, sf, "damaged", lambda: damaged(spark, sf))
        stored = fx._TABLES[(spark.sparkContext.applicationId, sf, "damaged")]
        entry = {"path": stored, "name": "damaged", "id_col": "utt_id"}
        entries = [entry, {**entry, "name": "capped", "max_len": 40}]
        config = CorpusConfig.from_dict({"max_duration_sec": CAP_SECONDS, "sources": entries})
        path = shared_path(spark, "damaged_corpus")
        pc.run_preparation(spark, config, tokenizer(spark, sf).column, path, L, derived=False)
        fx._TABLES[key] = path
    path = fx._TABLES[key]
    found = st.open_rejects(spark, path).groupBy("source_ord").agg(
        F.count(F.lit(1)).alias("rejects_found"), F.count_distinct("reject_reason").alias("reasons")
    )
    kept = st.open_training(spark, path).groupBy("source_ord").agg(
        F.count(F.lit(1)).alias("rows_found"), F.sum(F.col("encoded_len").cast("bigint")).alias("frames")
    )
    return st.open_counts(spark, path).join(found, "source_ord").join(kept, "source_ord")


def tokenizer_plugin(spark, sf):
    """A plugged-in tokenizer that takes lists of texts: every word becomes its number of bytes."""

    def factory():
        return lambda texts: [[len(w.encode()) for w in text.split(" ") if w] for text in texts]

    prompts = tk.add_prompt(rows(spark, sf)).select("utt_id", "prompt")
    ids = prompts.select("utt_id", tk.batch_tokenizer(factory)(F.col("prompt")).alias("ids"))
    return ids.select("utt_id", F.size("ids").alias("n"), digest(F.col("ids")).alias("ids_md5"))


def source_load(spark, sf):
    union = sm.ordered_union(ld.load_sources(spark, corpus_config(spark, sf), L))
    return union.groupBy("source_ord", "source", "language_tag").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("utt_id").alias("n_ids"),
        F.sum(F.col("encoded_len").cast("bigint")).alias("frames"),
        F.sum(F.size("nano_layer_1").cast("bigint")).alias("codes"),
        F.sum(F.size("speaker_emb").cast("bigint")).alias("speaker_values"),
    )


def training_load(spark, sf):
    corpus = st.open_training(spark, prepared_path(spark, sf))
    return sm.shuffle_rank(corpus, SEED, keys=("source_ord", "utt_id")).select(
        "source_ord", "utt_id", "shuffle_rank"
    )


def training_save(spark, sf):
    return st.open_training(spark, prepared_path(spark, sf)).select(
        "source_ord",
        "utt_id",
        F.size("input_ids").alias("n_ids"),
        digest(F.col("input_ids")).alias("ids_md5"),
        (F.col("labels") == F.col("input_ids")).alias("labels_are_ids"),
        "encoded_len",
    )


def stats_save(spark, sf):
    document = st.read_length_stats(spark, f"{prepared_path(spark, sf)}_length_statistics")
    return r6(st.flatten_length_stats(document))


def metric_log(spark, sf):
    path = shared_path(spark, "metric_log")
    log = fx.metric_log(spark, sf).select("step", "metric", "value")
    rm.append_metrics(log, path)
    rm.append_metrics(log.withColumn("metric", rm.eval_prefix(F.col("metric"))), path)
    kept = F.nanvl("value", F.lit(None).cast("double"))
    return r6(
        spark.read.schema("step bigint, metric string, value double")
        .parquet(path)
        .groupBy("metric")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count(kept).alias("n_values"),
            F.max("step").alias("last_step"),
            F.avg(kept).alias("mean_value"),
        )
    )


def rope_params(spark, sf):
    return r6(alphas(spark, sf).select("step", "param_name", "layer", "weight"))


# --- projections -----------------------------------------------------------------------------


def canonical_rename(spark, sf):
    cfg = SourceConfig(
        path="-",
        name="renamed",
        text_col="sentence",
        layer_cols=("q1", "q2", "q3", "q4"),
        encoded_len_col="n",
        speaker_col="grouped",
        language_tag="EN",
    )
    raw = rows(spark, sf).select(
        "utt_id",
        F.col("text").alias("sentence"),
        *[F.col(c).alias(f"q{k + 1}") for k, c in enumerate(L.layer_columns)],
        F.col("encoded_len").cast("bigint").alias("n"),
        F.col("speaker_emb").alias("grouped"),
    )
    renamed = raw.select("utt_id", *ld.canonical_columns(cfg, L))
    return renamed.select(
        "utt_id",
        "text",
        "language_tag",
        "encoded_len",
        *[digest(F.col(c)).alias(c) for c in L.layer_columns],
        F.size("speaker_emb").alias("speaker_dim"),
    )


def lang_prompt(spark, sf):
    untagged = rows(spark, sf).withColumn(
        "language_tag", F.upper(F.nullif(F.col("language_tag"), F.lit("de")))
    )
    return tk.add_prompt(untagged).select("utt_id", "prompt")


def text_tokens(spark, sf):
    out = tk.add_text_tokens(rows(spark, sf), tokenizer(spark, sf).column, L)
    return out.select(
        "utt_id", F.size("text_tokens").alias("n"), digest(F.col("text_tokens")).alias("tokens_md5")
    )


def text_tokens_join(spark, sf):
    out = tk.text_tokens_by_join(rows(spark, sf), fx.vocabulary(spark, sf), L)
    return out.select(
        "utt_id", F.size("text_tokens").alias("n"), digest(F.col("text_tokens")).alias("tokens_md5")
    )


def input_ids(spark, sf):
    return sequences_of(spark, sf).select(
        "utt_id", F.size("input_ids").alias("n"), digest(F.col("input_ids")).alias("ids_md5")
    )


def labels_mask(spark, sf):
    out = pc.add_labels_and_mask(sequences_of(spark, sf))
    return out.select(
        "utt_id",
        F.size("labels").alias("n_labels"),
        digest(F.col("labels")).alias("labels_md5"),
        F.size("attention_mask").alias("n_mask"),
        F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("mask_sum"),
    )


def training_columns(spark, sf):
    out = pc.training_columns(sequences_of(spark, sf))
    return out.select(
        "utt_id",
        F.size("input_ids").alias("n"),
        "encoded_len",
        F.size("speaker_emb").alias("speaker_dim"),
        F.lit(",".join(out.columns)).alias("columns"),
    )


def vocab_extension(spark, sf):
    used = _token_counts(spark, sf).withColumnRenamed("n", "n_used")
    # The extension has a fixed number of rows, so the counts join onto it whatever their size.
    return (
        L.custom_tokens(spark)
        .join(used, "token_id", "left")
        .select("token", "token_id", F.coalesce("n_used", F.lit(0)).alias("n_used"))
    )


def _token_counts(spark, sf):
    return tk.token_counts(sequences_of(spark, sf))


def token_layer(spark, sf):
    return _token_counts(spark, sf).select(
        "token_id",
        L.audio_layer(F.col("token_id")).alias("layer"),
        L.is_text(F.col("token_id")).alias("is_text"),
        "n",
    )


def layer_range_join(spark, sf):
    return join_layer_ranges(_token_counts(spark, sf), "token_id", L).select("token_id", "layer", "n")


# --- filters ---------------------------------------------------------------------------------


def duration_filter(spark, sf):
    return cd.filter_duration(rows(spark, sf), CAP_SECONDS).select("utt_id", "encoded_len")


def nonempty_codes(spark, sf):
    coded = damaged(spark, sf).select(
        "utt_id", F.col("nano_layer_2").alias("codes")
    )
    return cd.nonempty_codes(coded).select("utt_id", F.size("codes").alias("n"))


def valid_labels(spark, sf):
    return prediction_labels(spark, sf).select(
        "seq_id", "pos", "label", sc.is_scored(F.col("label"), F.col("mask"), TINY).alias("scored")
    )


def layer_mask(spark, sf):
    return sc.scored_targets(prediction_labels(spark, sf), TINY).select(
        "seq_id", "pos", "label", "layer", "is_text"
    )


def step_cadence(spark, sf):
    return rm.due_reports(fx.metric_log(spark, sf), 100, 1000).select(
        "step", "metric", "influence_due", "report_due"
    )


def row_validation(spark, sf):
    return va.rejected(damaged(spark, sf), L).select("utt_id", "reject_reason")


def reject_summary(spark, sf):
    return va.reject_summary(damaged(spark, sf), L)


def corpus_counts(spark, sf):
    config = corpus_config(spark, sf)
    return pc.corpus_counts(spark, config, L)


def corpus_rejects(spark, sf):
    """Rejects of a source that was written with damaged rows."""
    key = (spark.sparkContext.applicationId, sf, "damaged")
    fx.stored(spark, sf, "damaged", lambda: damaged(spark, sf))
    entry = {"path": fx._TABLES[key], "name": "damaged", "id_col": "utt_id"}
    config = CorpusConfig.from_dict({"max_duration_sec": CAP_SECONDS, "sources": [entry, entry]})
    return pc.corpus_rejects(spark, config, L).select(
        "source_ord", "utt_id", "source", "reject_reason"
    )


def collation_checks(spark, sf):
    out = va.collation_checks(co.collate(batched(spark, sf), L), fx.SPEAKER_DIM)
    return out.select("utt_id", "batch_id", "has_speaker", "speaker_dim", "check")


# --- frames, sequences, positions ------------------------------------------------------------


def frame_zip(spark, sf):
    return cd.add_frames(rows(spark, sf), L).select(
        "utt_id", F.size("frames").alias("n"), frame_digest(F.col("frames")).alias("frames_md5")
    )


def layer_offset(spark, sf):
    framed = cd.add_frames(rows(spark, sf), L)
    shifted = framed.select("utt_id", codec.shift_layers(F.col("frames"), L).alias("frames"))
    return shifted.select("utt_id", frame_digest(F.col("frames")).alias("frames_md5"))


def frame_dedup(spark, sf):
    kept = cd.drop_repeated_frames(cd.add_frames(rows(spark, sf), L))
    return kept.select(
        "utt_id",
        "encoded_len",
        F.size("frames").alias("n_frames_kept"),
        frame_digest(F.col("frames")).alias("frames_md5"),
    )


def flatten_codes(spark, sf):
    return cd.add_codes(rows(spark, sf), L).select(
        "utt_id", F.size("codes").alias("n"), digest(F.col("codes")).alias("codes_md5")
    )


def frame_positions(spark, sf):
    out = ps.add_canonical_positions(sequences_of(spark, sf), L, STEP)
    return out.select(
        "utt_id",
        F.size("position_ids").alias("n"),
        joined_digest(half_steps(F.col("position_ids"))).alias("positions_md5"),
    )


def frame_positions_sequences(spark, sf):
    found = ps.sequence_positions(L, STEP)(F.col("input_ids"))
    out = sequences_of(spark, sf).select("utt_id", found.alias("position_ids"))
    return out.select(
        "utt_id",
        F.size("position_ids").alias("n"),
        joined_digest(half_steps(F.col("position_ids"))).alias("positions_md5"),
    )


def frame_positions_tokens(spark, sf):
    tokens = prediction_labels(spark, sf).select("seq_id", "pos", F.col("label").alias("token_id"))
    return ps.token_positions(tokens, TINY, STEP).select("seq_id", "pos", "position")


def speaker_positions(spark, sf):
    out = ps.add_canonical_positions(sequences_of(spark, sf), L, STEP, speaker_slot=True)
    return out.select(
        "utt_id",
        F.size("position_ids").alias("n"),
        joined_digest(half_steps(F.col("position_ids"))).alias("positions_md5"),
    )


def mask_insert(spark, sf):
    out = co.insert_speaker_mask(co.collate(batched(spark, sf), L))
    return out.select(
        "utt_id",
        F.size("attention_mask").alias("n"),
        digest(F.col("attention_mask")).alias("mask_md5"),
    )


def label_insert(spark, sf):
    out = co.insert_speaker_label(co.batch_defaults(batched(spark, sf)), L)
    return out.select(
        "utt_id",
        "has_speaker",
        F.size("labels").alias("n"),
        digest(F.col("labels")).alias("labels_md5"),
    )


def pad_batch(spark, sf):
    out = co.pad_batch(co.batch_defaults(batched(spark, sf)), L)
    return out.select(
        "utt_id",
        "batch_id",
        *[F.size(c).alias(f"n_{c}") for c in ("input_ids", "labels", "attention_mask")],
        *[digest(F.col(c)).alias(f"{c}_md5") for c in ("input_ids", "labels", "attention_mask")],
    )


def batch_defaults(spark, sf):
    out = co.batch_defaults(batched(spark, sf))
    return out.select(
        "utt_id",
        "batch_id",
        F.get("labels", F.lit(0)).alias("first_label"),
        digest(F.col("labels")).alias("labels_md5"),
        F.size("attention_mask").alias("n_mask"),
    )


def training_batches(spark, sf):
    corpus = sequences_of(spark, sf).select("utt_id", "input_ids", "speaker_emb")
    out = tv.training_batches(corpus, L, BATCH, SEED, audio_step=STEP)
    return out.select(
        "utt_id",
        "batch_id",
        "batch_pos",
        F.size("input_ids").alias("n_ids"),
        F.size("labels").alias("n_labels"),
        F.size("attention_mask").alias("n_mask"),
        joined_digest(half_steps(F.col("position_ids"))).alias("positions_md5"),
    )


# --- scoring ---------------------------------------------------------------------------------


def causal_shift(spark, sf):
    return sc.shifted_targets(prediction_labels(spark, sf))


def token_nll(spark, sf):
    return r6(scored(spark, sf).select("seq_id", "pos", "label", "nll"))


def token_nll_wide(spark, sf):
    p = fx.predictions(spark, sf)
    out = sc.score_positions(p, p.drop("logits"), TINY, wide=True)
    return r6(out.select("seq_id", "pos", "nll", F.array_join("topk", ",").alias("topk")))


def topk_tokens(spark, sf):
    top = logits.top_ids(F.col("logits"), 5)
    return fx.predictions(spark, sf).select("seq_id", "pos", F.array_join(top, ",").alias("topk"))


def vector_variance(spark, sf):
    return r6(
        fx.hidden_states(spark, sf).select(
            "seq_id", "pos", vectors.sample_variance(F.col("vec")).alias("variance")
        )
    )


def vector_norm(spark, sf):
    return r6(
        fx.hidden_states(spark, sf).select("seq_id", "pos", vectors.l2_norm(F.col("vec")).alias("norm"))
    )


def token_lookup(spark, sf):
    exploded = tk.add_prompt(rows(spark, sf)).select(
        "utt_id", F.posexplode(tk.words(F.col("prompt"))).alias("word_pos", "word")
    )
    return tk.lookup_words(exploded, fx.vocabulary(spark, sf), L).select(
        "utt_id", "word_pos", F.array_join(F.col("token_ids").cast("array<string>"), ",").alias("token_ids")
    )


def past_token_pairs(spark, sf):
    return r6(influence_pairs(spark, sf).select("seq_id", "pos", "layer", "src_pos", "influence"))


# --- aggregations ----------------------------------------------------------------------------


def length_stats(spark, sf):
    usable = pc.usable_rows(rows(spark, sf), L, CAP_SECONDS)
    return r6(cs.length_stats(usable, ["language_tag"]))


def corpus_preparation(spark, sf):
    """Flagship: filter, codes, tokens and sequences, summed up by language."""
    usable = pc.usable_rows(rows(spark, sf), L, CAP_SECONDS)
    seqs = pc.build_sequences(usable, tokenizer(spark, sf).column, L)
    return seqs.groupBy("language_tag").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col("encoded_len").cast("bigint")).alias("frames"),
        F.sum(F.size("codes").cast("bigint")).alias("codes"),
        F.sum(F.size("text_tokens").cast("bigint")).alias("text_tokens"),
        F.sum(F.size("input_ids").cast("bigint")).alias("tokens"),
        F.max(F.size("input_ids")).alias("longest"),
    )


def stage_counts(spark, sf):
    return va.stage_counts(damaged(spark, sf), L, CAP_SECONDS)


def layer_ppl(spark, sf):
    return r6(sc.layer_perplexity(totals(spark, sf)))


def text_ppl(spark, sf):
    return r6(sc.text_perplexity(totals(spark, sf)))


def ppl_summary(spark, sf):
    return r6(sc.perplexity_summary(totals(spark, sf)))


def layer_confusion(spark, sf):
    return sc.layer_confusion(totals(spark, sf), TINY)


def confusion_normalized(spark, sf):
    return r6(sc.confusion_normalized(totals(spark, sf), TINY))


def confusion_summary(spark, sf):
    return r6(sc.confusion_summary(totals(spark, sf), TINY))


def output_variance(spark, sf):
    return r6(at.output_variance(per_output(spark, sf)))


def influence_share(spark, sf):
    return r6(shares(spark, sf))


def eval_mean(spark, sf):
    return r6(rm.eval_mean(fx.metric_log(spark, sf)))


def batch_evaluation(spark, sf):
    """Sequences stand for batches here: five batches a step, of which the first three count."""
    s = F.col("seq_id")
    batches = fx.aligned_predictions(spark, sf).withColumns(
        {"step": F.floor(s / F.lit(5)).cast("bigint"), "batch_id": s % F.lit(5)}
    )
    return r6(ev.batch_evaluation(batches, TINY, 3))


def whole_evaluation(spark, sf):
    """Sequences stand for batches: five a step, of which three count; influences of the first one."""
    s = F.col("seq_id")
    keys = {"step": F.floor(s / F.lit(5)).cast("bigint"), "batch_id": s % F.lit(5)}
    by = ["step", "batch_id"]
    targets = sm.first_batches(targets_of(spark, sf).withColumns(keys), 1)
    given = fx.predictions(spark, sf).withColumns(keys)
    norms = given.select(*by, "seq_id", "pos", vectors.l2_norm(F.col("logits")).alias("norm"))
    pairs = at.past_token_pairs(targets, norms, TINY, by=by, span=4)
    gap = F.lit(1) + F.col("pos") - F.col("src_pos")
    recorded = pairs.select(*by, "seq_id", "pos", "src_pos", (F.col("norm") / gap).alias("influence"))
    tokens = given.select(*by, "seq_id", "pos", F.col("label").alias("token_id"))
    classified = at.influence_by_target(recorded, targets, tokens, TINY, by=by)
    aligned = fx.aligned_predictions(spark, sf).withColumns(keys)
    hidden = fx.hidden_states(spark, sf).withColumns(keys)
    return r6(ev.whole_evaluation(aligned, hidden, classified, TINY, 3))


def variance_reports(spark, sf):
    """Outputs recorded at every tenth step; reports between them, some right behind another."""
    hidden = fx.hidden_states(spark, sf).withColumn("step", F.col("seq_id") * F.lit(10))
    recorded = at.variance_per_output(hidden, ["step"])
    every = hidden.select("seq_id").distinct()
    late = every.where(F.col("seq_id") % 4 == 3).select((F.col("seq_id") * 10 + 5).alias("step"))
    empty = every.where(F.col("seq_id") % 8 == 7).select((F.col("seq_id") * 10 + 7).alias("step"))
    exact = every.where(F.col("seq_id") % 6 == 0).select((F.col("seq_id") * 10).alias("step"))
    return r6(at.variance_reports(recorded, late.union(empty).union(exact)))


def length_sketches(spark, sf):
    """Sketches stored by source and language and merged: exact moments, quartiles within their rank error."""
    usable = pc.usable_rows(rows(spark, sf), L, None).select("source", "language_tag", "encoded_len")
    stored = fx.stored(
        spark, sf, "length_sketches", lambda: cs.length_sketches(usable, ["source", "language_tag"])
    )
    stats = cs.sketch_stats(cs.merge_sketches(stored, ["language_tag"]), ["language_tag"])
    quartiles = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    hist = cs.length_histogram(usable, ["language_tag"]).join(
        stats.select(F.col("language_tag").alias("tag"), *quartiles),
        F.col("language_tag").eqNullSafe(F.col("tag")),
    )
    share = {q: F.sum(F.when(F.col("len") <= F.col(q), F.col("freq")).otherwise(0)) / F.sum("freq") for q in quartiles}
    below = {q: F.sum(F.when(F.col("len") < F.col(q), F.col("freq")).otherwise(0)) / F.sum("freq") for q in quartiles}
    near = [
        ((share[q] >= F.lit(p - 0.02)) & (below[q] <= F.lit(p + 0.02))).alias(f"{q}_near")
        for q, p in quartiles.items()
    ]
    checked = hist.groupBy("tag").agg(*near)
    joined = stats.join(checked, F.col("language_tag").eqNullSafe(F.col("tag"))).drop("tag", *quartiles)
    return r6(joined)


def alpha_stats(spark, sf):
    return r6(ar.alpha_stats(alphas(spark, sf)))


def alpha_metrics(spark, sf):
    return r6(ar.alpha_metrics(alphas(spark, sf)))


def alpha_report(spark, sf):
    # Means of 16 short decimals end in exact halves at six places; eight places hold them.
    return r6(ar.alpha_report(alphas(spark, sf), ["step"]), weight_mean=8)


def alpha_early_late(spark, sf):
    return r6(ar.early_late(alphas(spark, sf), ["step"]))


def lm_loss(spark, sf):
    return r6(sc.lm_loss(totals(spark, sf)))


def metric_table(spark, sf):
    return r6(ev.metric_table(metric_row(spark, sf), TINY))


# --- order, sampling, unions -----------------------------------------------------------------


def _by_language(spark, sf):
    """Five sources: three languages, all other rows, and the first language again."""
    base = rows(spark, sf).select("utt_id", "language_tag", "encoded_len")
    en, fr, de = (base.where(F.col("language_tag") == lang) for lang in ("en", "fr", "de"))
    rest = base.where(~F.coalesce(F.col("language_tag").isin("en", "fr", "de"), F.lit(False)))
    return [en, fr, de, rest, en]


def ordered_union(spark, sf):
    return sm.ordered_union(_by_language(spark, sf))


def _in_files(spark, sf):
    """The documents twice, as two sources, each row with its place in its file."""
    docs = fx.table(spark, sf, "documents").select(
        "doc_id", F.col("_metadata.file_path").alias("row_file"), F.col("_metadata.row_index").alias("row_ord")
    )
    return sm.ordered_union([docs, docs])


def shard_order(spark, sf):
    """Shards for three numbers of shards, put back together: every row with its shard and its number."""
    given = _in_files(spark, sf)
    starts = sh.file_starts(given)
    parts = [
        sh.shard(given, n, i, starts).select("source_ord", "doc_id", "row_no", F.lit(n).alias("n"), F.lit(i).alias("shard"))
        for n in (1, 3, 8)
        for i in range(n)
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def in_source_order(spark, sf):
    """The order of the files restored after the rows were dealt anew: the sorted rows, numbered."""
    numbered = sh.with_row_numbers(_in_files(spark, sf)).repartition(7, "doc_id")
    placed = sm.in_source_order(numbered)
    return placed.select("source_ord", "doc_id", "row_no")


def source_cap(spark, sf):
    caps = (50, 60, None, 100000, 0)
    parts = [sm.source_cap(p, cap) for p, cap in zip(_by_language(spark, sf), caps, strict=True)]
    return sm.ordered_union(parts)


def training_shuffle(spark, sf):
    return sm.shuffle_rank(rows(spark, sf).select("utt_id"), SEED, epoch=1)


def influence_sample(spark, sf):
    return sm.sample_targets(targets_of(spark, sf)).select("seq_id", "pos", "layer")


def batch_assign(spark, sf):
    out = sm.assign_batches(rows(spark, sf).select("utt_id"), BATCH, SEED)
    return out.select("utt_id", "batch_id", "batch_pos")


def eval_batch_limit(spark, sf):
    first = sm.first_batches(fx.metric_log(spark, sf), 5)
    flagged = first.withColumn("is_nan", F.coalesce(F.isnan("value"), F.lit(False)))
    return r6(flagged.withColumn("value", F.when(~F.col("is_nan"), F.col("value"))))


def layer_sort(spark, sf):
    by_number = ar.layer_order(alphas(spark, sf), ["step"])
    by_name = ar.layer_order(
        by_number.withColumnRenamed("place", "number_place"), ["step"], lexicographic=True
    )
    return by_name.select("step", "layer", "number_place", F.col("place").alias("name_place"))


# --- scalars ---------------------------------------------------------------------------------


def duration_sec(spark, sf):
    return r6(
        rows(spark, sf).select("utt_id", codec.duration_seconds(F.col("encoded_len")).alias("seconds"))
    )


def alpha_from_weight(spark, sf):
    value = F.col("value").cast("double")
    return r6(
        fx.parameter_log(spark, sf).select(
            "step", "param_name", alpha.alpha_from_weight(value).alias("alpha")
        )
    )


def metric_names(spark, sf):
    metric = F.col("metric")
    return (
        fx.metric_log(spark, sf)
        .groupBy("metric")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            rm.strip_prefix(metric).alias("plain"), rm.eval_prefix(metric).alias("evaluated"), "n"
        )
    )


# --- verdicts --------------------------------------------------------------------------------


def ppl_verdict(spark, sf):
    found = totals(spark, sf)
    layers = vd.perplexity_verdicts(sc.layer_perplexity(found))
    return r6(layers.unionByName(vd.isolation_verdict(sc.perplexity_summary(found))))


def variance_verdict(spark, sf):
    return r6(vd.variance_verdict(at.output_variance(per_output(spark, sf))))


def influence_verdict(spark, sf):
    return r6(vd.influence_verdicts(shares(spark, sf)))


def confusion_verdict(spark, sf):
    return r6(vd.confusion_verdict(sc.confusion_summary(totals(spark, sf), TINY)))


def overall_assessment(spark, sf):
    return r6(vd.overall_assessment(metric_row(spark, sf)))


def verdict_report(spark, sf):
    return r6(vd.full_report(metric_row(spark, sf)))


def influence_metrics(spark, sf):
    return r6(ev.influence_metrics(shares(spark, sf)))


def unmatched_positions(spark, sf):
    """Targets whose logits are missing, here those of the first position of each sequence."""
    p = fx.predictions(spark, sf)
    short = p.where(F.col("pos") > 0)
    return sc.unmatched_positions(short, p.drop("logits"), TINY).select("seq_id", "pos", "label")


def alpha_change(spark, sf):
    return r6(vd.alpha_changes(alphas(spark, sf), ["step"]))


def alpha_pattern(spark, sf):
    return r6(vd.alpha_pattern(ar.early_late(alphas(spark, sf), ["step"]), ["step"]))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        source_load, source_split, training_load, training_save, stats_save, metric_log, metric_log_rewritten, rope_params,
        canonical_rename, lang_prompt, text_tokens, text_tokens_join, tokenizer_plugin, input_ids, labels_mask,
        training_columns, vocab_extension, token_layer,
        duration_filter, nonempty_codes, valid_labels, layer_mask, step_cadence, row_validation,
        reject_summary, corpus_rejects, corpus_counts, preparation_counts, collation_checks,
        frame_zip, layer_offset, frame_dedup, flatten_codes, frame_positions,
        frame_positions_sequences, frame_positions_tokens, speaker_positions, mask_insert,
        label_insert, pad_batch, batch_defaults, training_batches,
        causal_shift, token_nll, token_nll_wide, topk_tokens, vector_variance, vector_norm,
        token_lookup, layer_range_join, past_token_pairs,
        length_stats, length_sketches, corpus_preparation, stage_counts, layer_ppl, text_ppl, ppl_summary,
        layer_confusion, confusion_normalized, confusion_summary, output_variance,
        influence_share, eval_mean, batch_evaluation, whole_evaluation, variance_reports, alpha_stats, alpha_metrics, alpha_report, alpha_early_late, lm_loss,
        metric_table,
        ordered_union, in_source_order, shard_order, source_cap, training_shuffle, influence_sample, batch_assign,
        eval_batch_limit, layer_sort,
        duration_sec, alpha_from_weight, metric_names,
        ppl_verdict, variance_verdict, influence_verdict, confusion_verdict, overall_assessment,
        verdict_report, influence_metrics, unmatched_positions,
        alpha_change, alpha_pattern,
    )
}
