import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codecloom.functions.sequences import insert_second, speaker_positions, training_sequence
from codecloom.operators.positions import (
    add_canonical_positions,
    padded_positions,
    sequence_positions,
    token_positions,
)
from codecloom.plans.corpus import add_labels_and_mask, training_columns
from tests.helpers import L, one

EXAMPLE = [100, 200, 64410, 68442, 72474, 76506, 300]


def brute_force(ids, step):
    audio = np.array([t >= 64410 for t in ids])
    before = np.concatenate([[0], np.cumsum(audio)[:-1]]) if len(ids) else audio
    text = np.arange(len(ids)) - before
    return list(text + before // 4 * step)


def test_sequence_layout(spark):
    df = spark.createDataFrame([([7, 8, 2], [64410])], "text_tokens array<bigint>, codes array<bigint>")
    df = df.withColumn("input_ids", training_sequence(F.col("text_tokens"), F.col("codes"), L))
    row = one(add_labels_and_mask(df))
    assert row.input_ids == [64403, 7, 8, 2, 64404, 64405, 64401, 64410, 64402, 64406]
    assert row.labels == row.input_ids
    assert row.attention_mask == [1] * 10
    assert len(row.input_ids) == len(row.text_tokens) + len(row.codes) + 6


def test_derived_columns_can_be_left_out(spark):
    df = spark.createDataFrame(
        [("a", [1], 1, [0.5])], "utt_id string, input_ids array<bigint>, encoded_len int, speaker_emb array<float>"
    )
    assert training_columns(df).columns == [
        "utt_id", "input_ids", "labels", "attention_mask", "encoded_len", "speaker_emb"
    ]
    assert training_columns(df, derived=False).columns == [
        "utt_id", "input_ids", "encoded_len", "speaker_emb"
    ]


@pytest.mark.parametrize("step, last", [(1.0, 3.0), (0.5, 2.5)])
def test_positions_of_the_documented_example(spark, step, last):
    df = spark.createDataFrame([(EXAMPLE,)], "ids array<bigint>")
    row = one(df.select(sequence_positions(L, step)(F.col("ids")).alias("p")))
    assert row.p == [0, 1, 2, 2, 2, 2, last]


@given(
    st.lists(st.lists(st.sampled_from([5, 64403, 64410, 70000, 80600]), max_size=30), min_size=1, max_size=10)
)
@settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
def test_array_and_window_positions_agree_with_brute_force(spark, sequences):
    df = spark.createDataFrame(list(enumerate(sequences)), "seq_id bigint, ids array<bigint>")
    arrays = df.select("seq_id", sequence_positions(L, 0.5)(F.col("ids")).alias("p")).collect()
    assert {r.seq_id: r.p for r in arrays} == {
        i: brute_force(s, 0.5) for i, s in enumerate(sequences)
    }
    tokens = df.select("seq_id", F.posexplode("ids").alias("pos", "token_id"))
    for span in (3, 65_536):
        found = token_positions(tokens, L, 0.5, span=span).collect()
        assert len(found) == sum(len(s) for s in sequences)
        for r in found:
            assert r.position == brute_force(sequences[r.seq_id], 0.5)[r.pos]


def test_one_long_sequence_is_split(spark):
    """All rows in one sequence: no task gets more than a span of it."""
    ids = spark.range(0, 20_000, 1, 8).select(
        F.lit(1).alias("seq_id"),
        F.col("id").alias("pos"),
        F.when(F.col("id") % 5 == 0, 7).otherwise(64410).cast("bigint").alias("token_id"),
    )
    out = {r.pos: r.position for r in token_positions(ids, L, 1.0, span=1000).collect()}
    want = brute_force([7 if i % 5 == 0 else 64410 for i in range(20_000)], 1.0)
    assert [out[i] for i in range(20_000)] == want


@pytest.mark.parametrize("n_text, n_codes, step", [(1, 4, 1.0), (3, 12, 0.5), (6, 20, 0.25), (2, 0, 1.0)])
def test_closed_form_positions(spark, n_text, n_codes, step):
    text, codes = [9] * n_text, [64410] * n_codes
    df = spark.createDataFrame([(text, codes)], "text_tokens array<bigint>, codes array<bigint>")
    row = one(add_canonical_positions(df, L, step))
    ids = [64403, *text, 64404, 64405, 64401, *codes, 64402, 64406]
    assert row.position_ids == brute_force(ids, step)


@pytest.mark.parametrize("step", [1.0, 0.5])
@pytest.mark.parametrize("ids", [EXAMPLE, [64410] * 6, [5], [5, 64410, 64410, 64410, 64410, 64410]])
@pytest.mark.parametrize("pads", [0, 1, 5])
def test_padded_positions(spark, ids, pads, step):
    rows = [(ids, True), (ids, False)]
    df = spark.createDataFrame(rows, "input_ids array<bigint>, has_speaker boolean")
    length = F.lit(len(ids) + pads)
    out = padded_positions(df, L, length, step, F.col("has_speaker")).collect()
    plain = brute_force(ids + [L.pad] * pads, step)
    assert out[1].position_ids == plain
    assert out[0].position_ids == [plain[0], plain[0] + 1] + [p + 1 for p in plain[1:]]


def test_null_sequence_has_null_positions(spark):
    df = spark.createDataFrame([(1, [5, 6]), (2, None), (3, [])], "id int, ids array<bigint>")
    rows = df.select("id", sequence_positions(L)(F.col("ids")).alias("p")).orderBy("id").collect()
    assert [r.p for r in rows] == [[0.0, 1.0], None, []]


def test_speaker_slot(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0, 2.0, 2.0, 2.0],), ([],), ([4.0],)], "p array<double>")
    rows = [r.q for r in df.select(speaker_positions(F.col("p")).alias("q")).collect()]
    assert rows == [[0, 1, 2, 3, 3, 3, 3], [], [4, 5]]


def test_insert_second(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1],), ([],)], "a array<bigint>")
    rows = [r.b for r in df.select(insert_second(F.col("a"), F.lit(-100)).alias("b")).collect()]
    assert rows == [[1, -100, 2, 3], [1, -100], []]
