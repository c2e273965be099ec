"""Text to token ids: a bounded vocabulary inside Arrow batches, or a relational lookup.

No text is lost: a word outside the vocabulary is spelled, as the byte id of a space and the byte ids of
its UTF-8 form. Words hold no space, so the ids give back the words.
"""

import sys
import types
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codecloom.functions.hashing import order_hash
from codecloom.functions.sequences import language_prompt
from codecloom.functions.slices import slices
from codecloom.layout import TokenLayout
from codecloom.operators.ranking import global_rank
from codecloom.session import small_batches

# Ids of the text range: ten for markers, 256 for bytes, then words.
FIRST_BYTE_ID = 10
FIRST_WORD_ID = FIRST_BYTE_ID + 256
SPELLED_ID = FIRST_BYTE_ID + ord(" ")

# A vocabulary of more bytes is neither broadcast nor fetched.
MAX_VOCABULARY_BYTES = 64 << 20
# A worker looks up the words of an Arrow batch in slices of so many.
WORDS_PER_SLICE = 1 << 18
# A worker counts the ids of an Arrow batch in slices of so many.
IDS_PER_SLICE = 1 << 20
# Prompts of a partition whose words are regrouped: a million or two of words, 100 bytes each as rows.
PROMPT_BYTES = 8 << 20
_SPACE = " \\t\\r\\n\\f"
_BLANK_BYTES = b" \t\r\n\f"


def add_prompt(df: DataFrame) -> DataFrame:
    """Column `prompt`: the text, led by the lower-cased language tag where there is one."""
    return df.withColumn("prompt", language_prompt(F.col("text"), F.col("language_tag")))


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; an empty array for a blank text."""
    return F.regexp_extract_all(text, F.lit(f"([^{_SPACE}]+)"), F.lit(1))


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): how often each word occurs. Counted in each task before the shuffle."""
    return (
        df.select(F.explode(words(F.col(text))).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def vocabulary_of_counts(counts: DataFrame, layout: TokenLayout) -> DataFrame:
    """(word, token_id) of the most frequent words, ties in md5 order, as many as the text range holds.

    `counts` is read several times and should be a stored table. The lowest count that still fits is
    found on the histogram of counts (N words have at most sqrt(2 N) different ones); of the words with
    that count as many are taken as there is room for. Only the chosen words are numbered in one task.
    """
    room = max(0, layout.text_vocab_size - FIRST_WORD_ID)
    above = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        counts.groupBy("n")
        .agg(F.count(F.lit(1)).alias("size"))
        .withColumn("before", F.coalesce(F.sum("size").over(above), F.lit(0)))
        .where(F.col("before") < F.lit(room))
        .agg(F.min("n").alias("n"), F.max("before").alias("before"))
        .first()
    )
    lowest, before = (cut["n"], cut["before"]) if cut["n"] is not None else (0, 0)
    ties = global_rank(counts.where(F.col("n") == F.lit(lowest)), ["word"], "vocab", "__rank")
    chosen = (
        counts.where((F.col("n") > F.lit(lowest)) & F.lit(cut["n"] is not None))
        .unionByName(ties.where(F.col("__rank") < F.lit(room - before)).drop("__rank"))
        .withColumn("__hash", order_hash(["word"], "vocab"))
    )
    place = F.row_number().over(Window.orderBy(F.desc("n"), "__hash", "word"))
    return chosen.select("word", (place + F.lit(FIRST_WORD_ID - 1)).cast("bigint").alias("token_id"))


def build_vocabulary(df: DataFrame, layout: TokenLayout, text: str = "text") -> DataFrame:
    """The vocabulary of a table's texts; store `word_counts` and number those for a large corpus."""
    return vocabulary_of_counts(word_counts(df, text), layout)


def vocabulary_bytes(vocab: DataFrame, layout: TokenLayout) -> int:
    """Size of the words of a vocabulary. Bad ids, words that occur twice or NULL raise an error."""
    facts = vocab.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("word").alias("words"),
        F.count_if(~F.coalesce(F.col("token_id").between(FIRST_WORD_ID, layout.text_vocab_size - 1), F.lit(False)))
        .alias("outside"),
        F.coalesce(F.sum(F.octet_length("word").cast("bigint")), F.lit(0)).alias("bytes"),
    ).first()
    if facts["outside"]:
        raise ValueError(f"{facts['outside']} ids are not in [{FIRST_WORD_ID}, {layout.text_vocab_size})")
    if facts["rows"] != facts["words"]:
        raise ValueError("a word of the vocabulary is NULL or occurs twice")
    return facts["bytes"]


def spelled(word: Column) -> Column:
    """Ids of a word outside the vocabulary."""
    pairs = F.regexp_extract_all(F.hex(F.encode(word, "UTF-8")), F.lit("(..)"), F.lit(1))
    ids = F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("bigint") + F.lit(FIRST_BYTE_ID))
    return F.concat(F.array(F.lit(SPELLED_ID).cast("bigint")), ids)


def _broadcast(vocab: DataFrame, layout: TokenLayout) -> bool:
    return vocabulary_bytes(vocab, layout) <= MAX_VOCABULARY_BYTES


def lookup_words(exploded: DataFrame, vocab: DataFrame, layout: TokenLayout) -> DataFrame:
    """Column `token_ids` for a `word` column: the vocabulary's id, or the spelled word.

    The vocabulary is broadcast when its measured size allows; else the planner chooses the join.
    """
    small = _broadcast(vocab, layout)
    known = vocab.select("word", F.col("token_id").cast("bigint").alias("token_id"))
    found = exploded.join(F.broadcast(known) if small else known, "word", "left")
    ids = F.when(F.col("token_id").isNotNull(), F.array("token_id")).when(
        F.col("word").isNotNull(), spelled(F.col("word"))
    )
    return found.withColumn("token_ids", ids).drop("token_id")


def text_tokens_by_join(
    df: DataFrame, vocab: DataFrame, layout: TokenLayout, keys: Sequence[str] = ("utt_id",)
) -> DataFrame:
    """(keys, text_tokens) by exploding the prompt, joining the vocabulary and regrouping by key.

    `keys` must be unique. A prompt is one row's text, so a group is bounded by it. With a broadcast
    vocabulary the prompts are shuffled by key and their words are not: a word takes many times its own
    size as a row. The regrouping sorts the words of a partition, so there are as many partitions as
    keep them in memory; the sizes of the prompts are added up first. `WordTokenizer` gives the same ids
    without a shuffle.
    """
    prompts = add_prompt(df).select(*keys, "prompt")
    if _broadcast(vocab, layout):
        size = prompts.agg(F.sum(F.octet_length("prompt").cast("bigint"))).first()[0] or 0
        least = df.sparkSession.sparkContext.defaultParallelism
        prompts = prompts.repartition(max(least, -(-size // PROMPT_BYTES)), *keys)
    exploded = prompts.select(*keys, F.posexplode_outer(words(F.col("prompt"))).alias("word_pos", "word"))
    found = lookup_words(exploded, vocab, layout)
    item = F.when(F.col("word").isNotNull(), F.struct("word_pos", "token_ids"))
    ordered = F.transform(F.sort_array(F.collect_list(item)), lambda x: x["token_ids"])
    return (
        found.groupBy(*keys)
        .agg(F.flatten(ordered).alias("__ids"))
        .withColumn(
            "text_tokens",
            F.concat(
                F.array(F.lit(layout.start_of_text).cast("bigint")),
                "__ids",
                F.array(F.lit(layout.end_of_text).cast("bigint")),
            ),
        )
        .drop("__ids")
    )


def token_counts(df: DataFrame, ids: str = "input_ids") -> DataFrame:
    """(token_id, n): how often each id occurs in an array column; NULL elements are counted as an id.

    A worker counts the ids of a slice of rows; its counts follow the first row of the slice and are added
    up behind the shuffle, so that no id becomes a row of its own.
    """
    small_batches(df.sparkSession)
    cut = slices(IDS_PER_SLICE)
    count = T.StructType([T.StructField("token_id", T.LongType()), T.StructField("n", T.LongType())])

    @F.arrow_udf(T.ArrayType(count))
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in batches:
            for rows in cut(whole, np.diff(whole.offsets.to_numpy())):
                found = pc.value_counts(rows.flatten())
                offsets = np.full(len(rows) + 1, len(found), dtype=np.int32)
                offsets[0] = 0
                pairs = pa.StructArray.from_arrays([found.field("values"), found.field("counts")], ["token_id", "n"])
                yield pa.ListArray.from_arrays(pa.array(offsets), pairs)

    column = F.col(ids).cast("array<bigint>")
    counts = df.select(F.explode(counted(column)).alias("__count")).select("__count.*")
    return counts.groupBy("token_id").agg(F.sum("n").alias("n"))


class WordTokenizer:
    """Arrow tokenizer over a bounded vocabulary: no shuffle and no per-row Python.

    The vocabulary is fetched once (its ids and its size are checked) and sent to the executors as a
    Spark broadcast. A worker builds its index once, looks up the different words of an Arrow batch
    and gathers their ids.
    """

    def __init__(self, vocab: DataFrame, layout: TokenLayout):
        if vocabulary_bytes(vocab, layout) > MAX_VOCABULARY_BYTES:
            raise ValueError(
                f"vocabulary of more than {MAX_VOCABULARY_BYTES} bytes; use text_tokens_by_join instead"
            )
        table = vocab.select("word", F.col("token_id").cast("bigint").alias("token_id")).toArrow()
        self._shared = vocab.sparkSession.sparkContext.broadcast(
            (table.column("word").to_pylist(), table.column("token_id").to_numpy())
        )

    def column(self, prompt: Column) -> Column:
        """Token ids of a prompt, without start and end markers."""
        shared = self._shared
        first, lead = FIRST_BYTE_ID, SPELLED_ID
        cut = slices(WORDS_PER_SLICE)
        blank = np.zeros(256, dtype=bool)
        blank[list(_BLANK_BYTES)] = True

        kept = {}

        @F.arrow_udf(T.ArrayType(T.LongType()))
        def encode(whole: pa.Array) -> pa.Array:
            if not kept:  # once a task, which gets a copy of this function
                known, kept["ids"] = shared.value
                kept["index"] = pd.Index(known, dtype=object)
            ids, index = kept["ids"], kept["index"]
            # The words are cut here: in the JVM each would be an object and a row of the batch.
            texts = pc.fill_null(whole, "").cast(pa.large_binary())
            ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
            ends = ends - ends[0]
            ink = ~blank[data]
            edges = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(data))]  # no word goes beyond its row
            opens, closes = ink.copy(), ink.copy()
            opens[1:] &= ~ink[:-1]
            closes[:-1] &= ~ink[1:]
            opens[edges], closes[edges - 1] = ink[edges], ink[edges - 1]
            opens, closes = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            word = np.searchsorted(opens, ends)
            found, done = [pa.array([], pa.list_(pa.int64()))], 0
            for batch in cut(whole, np.diff(word)):
                rows = word[done : done + len(batch) + 1]
                letters = slice(ends[done], ends[done + len(batch)])
                done += len(batch)
                lengths = closes[rows[0] : rows[-1]] - opens[rows[0] : rows[-1]]
                rows = rows - rows[0]
                starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                buffers = [None, pa.py_buffer(starts), pa.py_buffer(data[letters][ink[letters]])]
                coded = pa.Array.from_buffers(pa.large_binary(), len(lengths), buffers).dictionary_encode()
                different = [x.decode("utf-8", "replace") for x in coded.dictionary.to_pylist()]
                place = index.get_indexer(pd.Index(different, dtype=object))
                different = [x.encode() for x in different]
                text = np.frombuffer(b"".join(different), dtype=np.uint8)
                size = np.fromiter(map(len, different), dtype=np.int64, count=len(different))
                # One run of ids for each different word: its id, or a space and its bytes.
                runs = np.where(place >= 0, 1, size + 1)
                begin = np.cumsum(runs) - runs
                flat = np.full(int(runs.sum()), lead, dtype=np.int64)
                flat[begin[place >= 0]] = ids[place[place >= 0]]
                out = np.repeat(place < 0, size)
                shift = begin + 1 - (np.cumsum(size) - size)
                flat[(np.repeat(shift, size) + np.arange(len(text)))[out]] = text[out].astype(np.int64) + first
                codes = coded.indices.to_numpy()
                counts = runs[codes]
                until = np.concatenate([[0], np.cumsum(counts)])
                tokens = flat[np.repeat(begin[codes] - until[:-1], counts) + np.arange(until[-1])]
                found.append(pa.ListArray.from_arrays(pa.array(until[rows], pa.int32()), pa.array(tokens)))
            return pa.concat_arrays(found)

        return encode(prompt)


def custom_tokenizer(
    factory: Callable[[], Callable[[str], list[int]]],
) -> Callable[[Column], Column]:
    """Wrap a user's own tokenizer; `factory` builds it once per task, not once per row."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = factory()
        for prompts in batches:
            yield prompts.map(tokenizer)

    return encode


def batch_tokenizer(
    factory: Callable[[], Callable[[list[str]], list[list[int]]]],
) -> Callable[[Column], Column]:
    """Wrap a tokenizer that takes a list of texts; one call an Arrow batch.

    `factory` builds it once per Python worker: it is kept in a module of that process, beyond the task. A
    NULL text has NULL ids and is not handed over.
    """
    kept = f"_codecloom_tokenizer_{uuid.uuid4().hex}"

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        module = sys.modules.get(kept)
        if module is None:
            module = types.ModuleType(kept)
            module.tokenizer = factory()
            sys.modules[kept] = module
        for prompts in batches:
            found = iter(module.tokenizer(prompts.drop_null().to_pylist()))
            rows = [next(found) if there else None for there in prompts.is_valid().to_pylist()]
            yield pa.array(rows, pa.list_(pa.int64()))

    return encode


def add_text_tokens(
    df: DataFrame, tokenizer: Callable[[Column], Column], layout: TokenLayout, lead: bool = True
) -> DataFrame:
    """Column `text_tokens`: optional start marker, the tokenizer's ids, end marker."""
    small_batches(df.sparkSession)
    start = [layout.start_of_text] if lead else []
    ids = tokenizer(F.col("prompt"))
    return (
        add_prompt(df)
        .withColumn("__ids", ids)
        .withColumn(
            "text_tokens",
            F.concat(
                *[F.array(F.lit(v).cast("bigint")) for v in start],
                F.col("__ids"),
                F.array(F.lit(layout.end_of_text).cast("bigint")),
            ),
        )
        .drop("__ids", "prompt")
    )
