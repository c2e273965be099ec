import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codecloom.config import SourceConfig
from codecloom.functions import codec
from codecloom.functions.codec import duration_seconds, shift_layers, without_repeats
from codecloom.operators.codes import (
    add_codes,
    add_frames,
    drop_repeated_frames,
    filter_duration,
    nonempty_codes,
)
from codecloom.sources.load import load_source
from tests.helpers import L, layers, one

A, B = (1, 2, 3, 4), (5, 6, 7, 8)
A4 = (1, 2, 3, 9)


def frames_of(df):
    return [[tuple(f) for f in r.frames] for r in df.orderBy("utt_id").collect()]


def brute_force(frames):
    return [f for i, f in enumerate(frames) if i == 0 or f != frames[i - 1]]


@pytest.mark.parametrize(
    "given_frames, kept",
    [([A, A, B, A], [A, B, A]), ([A, A4], [A, A4]), ([A], [A]), ([A] * 5, [A])],
)
def test_only_consecutive_repeats_in_every_layer_are_dropped(spark, given_frames, kept):
    df = drop_repeated_frames(add_frames(layers(spark, [(1, given_frames)]), L))
    assert frames_of(df) == [kept]


def test_codes_are_offset_by_layer_and_flattened_by_frame(spark):
    row = one(add_codes(layers(spark, [(1, [A, A, B])]), L))
    base = [64410, 68442, 72474, 76506]
    assert row.codes == [b + c for f in (A, B) for b, c in zip(base, f)]
    assert "nano_layer_1" not in row.asDict()


def test_layer_shift_alone(spark):
    df = add_frames(layers(spark, [(1, [A])]), L)
    assert tuple(one(df.select(shift_layers(F.col("frames"), L).alias("f"))).f[0]) == (
        1,
        2 + 4032,
        3 + 8064,
        4 + 12096,
    )


@given(
    st.lists(
        st.lists(st.tuples(*[st.integers(0, 1)] * 4), min_size=1, max_size=12), min_size=1, max_size=20
    )
)
@settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
def test_repeats_property(spark, utterances):
    df = add_frames(layers(spark, list(enumerate(utterances))), L)
    once = drop_repeated_frames(df)
    found = frames_of(once)
    assert found == [brute_force(u) for u in utterances]
    assert frames_of(drop_repeated_frames(once)) == found
    codes = [r.codes for r in add_codes(df.drop("frames"), L).collect()]
    assert all(len(c) % 4 == 0 for c in codes)


def test_repeats_stay_linear_when_inlined_into_a_filter(spark):
    """A filter on the result is pushed below the projections with the expression inlined."""
    frames = F.transform(
        F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.struct((i % 7).alias("a"), i.alias("b"))
    )
    df = spark.range(2).select(without_repeats(frames).alias("kept")).where(F.size("kept") > 1)
    assert [r.n for r in df.select(F.size("kept").alias("n")).collect()] == [60_000] * 2


def test_duration_edge_and_no_cap(spark):
    df = spark.createDataFrame([(500,), (501,)], "encoded_len int")
    assert [r[0] for r in filter_duration(df, 40).collect()] == [500]
    assert filter_duration(df, None).count() == 2
    assert filter_duration(df, 0).count() == 2
    assert one(df.limit(1).select(duration_seconds(F.col("encoded_len")).alias("s"))).s == 40.0


def test_duration_filter_reaches_the_reader(spark, tmp_path):
    path = str(tmp_path / "lens")
    spark.range(10).selectExpr("cast(id as int) encoded_len", "id").write.parquet(path)
    plan = filter_duration(spark.read.parquet(path), 40.04)._jdf.queryExecution().toString()
    assert "LessThanOrEqual(encoded_len,500)" in plan


def test_duration_filter_of_a_source_reaches_the_reader(spark, tmp_path):
    for kind in ("int", "bigint"):
        path = str(tmp_path / kind)
        columns = [f"array(1) {c}" for c in L.layer_columns]
        spark.range(1000).selectExpr(f"cast(id as {kind}) n", "'t' text", *columns).write.parquet(path)
        source = load_source(spark, SourceConfig(path=path, name="s", encoded_len_col="n"), 0, L)
        capped = filter_duration(source, 40.04)
        assert "LessThanOrEqual(n,500)" in capped._jdf.queryExecution().toString()
        assert capped.count() == 501


def test_empty_and_null_codes_are_dropped(spark):
    df = spark.createDataFrame([(1, [1]), (2, []), (3, None)], "id int, codes array<int>")
    assert [r.id for r in nonempty_codes(df).collect()] == [1]


def test_codes_need_no_exchange(spark, tmp_path):
    path = str(tmp_path / "codec")
    layers(spark, [(1, [A, B])]).write.parquet(path)
    plan = add_codes(spark.read.parquet(path), L)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("arrays_zip") == 1


def test_shift_and_texts_go_to_workers_once(spark, monkeypatch):
    """NULL codes, frames, arrays and slices of a row; nothing is computed a frame in the JVM."""
    frames = [
        [(1, 2, 3, 4), None, (5, None, 7, 8)],
        [],
        None,
        [(None, None, None, None), (9, 9, 9, 9)],
        [(i, 0, 0, i) for i in range(50)],
    ]
    names = ", ".join(f"{c}: int" for c in L.layer_columns)
    df = spark.createDataFrame(list(enumerate(frames)), f"id int, frames array<struct<{names}>>").coalesce(1)
    shifts = [k * L.audio_codebook_size for k in range(4)]

    def moved(frame):
        return tuple(None if x is None else x + s for x, s in zip(frame or (None,) * 4, shifts))

    wanted = [None if f is None else [moved(x) for x in f] for f in frames]
    got = [r.f for r in df.select("id", shift_layers(F.col("frames"), L).alias("f")).orderBy("id").collect()]
    assert [None if f is None else [tuple(x) for x in f] for f in got] == wanted
    texts = [
        None if f is None else ";".join(",".join(str(x) for x in frame if x is not None) for frame in f) for f in wanted
    ]
    for size in (1, 1 << 19):
        monkeypatch.setattr(codec, "FRAMES_PER_SLICE", size)
        out = df.select("id", codec.frame_texts(shift_layers(F.col("frames"), L), L).alias("t")).orderBy("id")
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "transform(" not in plan
        assert [r.t for r in out.collect()] == texts
