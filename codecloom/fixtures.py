"""Views that stand in for codec corpora and model outputs, derived from the provided tables.

No provided table holds codec rows or logits, so they are computed with integer arithmetic and
joins that any SQL engine repeats exactly.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codecloom.functions.slices import slices
from codecloom.layout import TokenLayout
from codecloom.operators.scoring import align_logits
from codecloom.operators.tokens import vocabulary_of_counts, word_counts
from codecloom.session import shared_path
from codecloom.sources.files import LONG_ARRAYS

# Tiny layout whose 64 ids match the 64 components of the embedding vectors.
TINY = TokenLayout(text_vocab_size=6, audio_codebook_size=12)

SPEAKER_DIM = 64

# Texts are turned into arrays in slices of so many bytes.
BYTES_PER_SLICE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """Spread by key for the array work: a file of one row group is read by a single task."""
    return df.repartition(partitions, key)


def code_layers(text: Column) -> Column:
    """The four layer arrays of a text, a frame a code point; an empty text is one frame of zeros."""
    cut = slices(BYTES_PER_SLICE)
    names = TokenLayout().layer_columns

    @F.arrow_udf(T.StructType([T.StructField(c, T.ArrayType(T.IntegerType(), False)) for c in names]))
    def layers(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in cut(batch, pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False)):
                filled = pc.if_else(pc.equal(texts, ""), "\0", texts)
                c = np.frombuffer("".join(filled.drop_null().to_pylist()).encode("utf-32-le"), dtype="<u4").astype(np.int32)
                sizes = pc.fill_null(pc.utf8_length(filled), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                i = np.arange(len(c)) - np.repeat(ends[:-1], sizes)
                offsets = pa.array(ends.astype(np.int32))
                absent = pc.is_null(texts)
                flat = (c % 4032, c * 7 % 4032, (i // 3 % 4032).astype(np.int32), c // 2 % 4032)
                arrays = [pa.ListArray.from_arrays(offsets, pa.array(x), mask=absent) for x in flat]
                yield pa.StructArray.from_arrays(arrays, names=list(names), mask=absent)

    return layers(text)


def codec_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document = one utterance, one character = one frame.

    The vectors are joined to the texts, before the arrays are built: those are many times as long.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    embeddings = table(spark, sf_dir, "embeddings")
    n = max(1, embeddings.count())
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(spark.sparkContext.defaultParallelism * 4, shuffled)
    # Spread by the join key the rows move once; too few vectors to spread by are broadcast.
    spread = "__key" if n >= 16 * partitions else "doc_id"
    base = _spread(docs.withColumn("__key", F.col("doc_id") % F.lit(n)), spread, partitions)
    vectors = embeddings.select(
        F.col("vec_id").alias("__vec"), F.col("embedding").alias("speaker_emb")
    )
    joined = base.join(vectors, F.col("__key") == F.col("__vec"), "left")
    return joined.withColumn("__layers", code_layers(F.col("text"))).select(
        F.col("doc_id").alias("utt_id"),
        "source",
        F.col("lang").alias("language_tag"),
        "text",
        *[F.col(f"__layers.{c}") for c in TokenLayout().layer_columns],
        F.col("n_chars").cast("int").alias("encoded_len"),
        "speaker_emb",
    )


_LISTS = "spark.sql.parquet.writeLegacyFormat"
_TABLES: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written once per application to the shared folder and read from there.

    Queries then meet what a real corpus gives them: stored array columns, which the reader can
    prune and filter, and several files.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        path = shared_path(spark, name)
        df = build()
        long = any(kind.startswith("array") for _, kind in df.dtypes)
        # Lists without NULL elements are two levels deep in the older form: a third less work an element.
        before = spark.conf.get(_LISTS)
        try:
            if long:
                spark.conf.set(_LISTS, "true")
            df.write.options(**LONG_ARRAYS if long else {}).parquet(path)
        finally:
            spark.conf.set(_LISTS, before)
        _TABLES[key] = path
    return spark.read.parquet(_TABLES[key])


def codec_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "codec_rows", lambda: codec_rows(spark, sf_dir))


def codec_path(spark: SparkSession, sf_dir: str) -> str:
    codec_table(spark, sf_dir)
    return _TABLES[(spark.sparkContext.applicationId, sf_dir, "codec_rows")]


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stored(spark, sf_dir, "word_counts", lambda: word_counts(codec_table(spark, sf_dir)))
    return stored(spark, sf_dir, "vocabulary", lambda: vocabulary_of_counts(counts, TokenLayout()))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty positions per sequence, 64 logits each, with label and mask of the same position."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.floor(v / F.lit(20)).cast("bigint").alias("seq_id"),
        (v % F.lit(20)).alias("pos"),
        F.col("embedding").alias("logits"),
        F.when(v % F.lit(11) == 0, F.lit(-100).cast("bigint"))
        .otherwise((v * F.lit(7) + F.lit(3)) % F.lit(64))
        .alias("label"),
        (v % F.lit(13) != 0).alias("mask"),
    )


def aligned_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits stored next to their targets, as a model run should write them."""

    def build() -> DataFrame:
        p = predictions(spark, sf_dir)
        return align_logits(p, p.drop("logits"), TINY)

    return stored(spark, sf_dir, "aligned", build)


def hidden_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("model_layer"),
        F.floor(F.col("vec_id") / F.lit(20)).cast("bigint").alias("seq_id"),
        (F.col("vec_id") % F.lit(20)).alias("pos"),
        F.col("embedding").alias("vec"),
    )


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric values per step and batch, some absent (NULL) and some NaN."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("step"),
        (F.col("user_id") % F.lit(10)).alias("batch_id"),
        F.concat(F.lit("metrics/"), F.col("event_type")).alias("metric"),
        F.when(e % F.lit(17) == 0, F.lit(None).cast("double"))
        .when(e % F.lit(19) == 0, F.lit(float("nan")))
        .otherwise(F.col("value"))
        .alias("value"),
    )


def parameter_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named parameters per step: sixteen rotation weights."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.floor(e / F.lit(16)).cast("bigint").alias("step"),
        F.concat(
            F.lit("model.learnable_rope_layers."),
            (e % F.lit(16)).cast("string"),
            F.lit(".alpha_weight"),
        ).alias("param_name"),
        ((F.col("value") - F.lit(50.0)) / F.lit(50.0)).alias("value"),
    )
