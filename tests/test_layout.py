from pyspark.sql import functions as F

from codecloom.layout import TokenLayout, join_layer_ranges
from tests.helpers import L, TINY, values

EDGES = [(64399, None), (64409, None), (64410, 0), (68441, 0), (68442, 1), (80537, 3), (80538, None)]


def test_sizes():
    assert L.audio_start == 64410
    assert L.total_vocab_size == 80538
    assert L.pad == 64407
    assert TINY.total_vocab_size == 64


def test_layer_of_id_by_arithmetic_and_by_range_join(spark):
    df = spark.createDataFrame([(t,) for t, _ in EDGES], "token_id bigint")
    by_rule = df.select("token_id", L.audio_layer(F.col("token_id")).alias("layer"))
    assert values(by_rule, "token_id", "layer") == EDGES
    assert values(join_layer_ranges(df, "token_id", L), "token_id", "layer") == EDGES


def test_special_ids_are_neither_text_nor_audio(spark):
    df = spark.range(64400, 64410)
    flags = df.select(
        L.is_text(F.col("id")).alias("t"), L.audio_layer(F.col("id")).isNotNull().alias("a")
    )
    assert not any(r.t or r.a for r in flags.collect())


def test_custom_tokens(spark):
    df = L.custom_tokens(spark, base=100)
    assert df.count() == 16138
    first, last = df.orderBy("token_id").first(), df.orderBy(F.desc("token_id")).first()
    assert (first.token, first.token_id) == ("<custom_token_0>", 100)
    assert (last.token, last.token_id) == ("<custom_token_16137>", 100 + 16137)


def test_layer_table_follows_the_layout(spark):
    layout = TokenLayout(text_vocab_size=5, audio_codebook_size=3, num_audio_layers=2)
    assert values(layout.layer_ranges(spark), "layer", "lo", "hi") == [(0, 15, 18), (1, 18, 21)]
