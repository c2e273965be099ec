"""Long arrays: what is moved, written and held at a time."""

import pathlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from checks.queries import digest
from codecloom import fixtures as fx
from codecloom.functions import codec
from codecloom.functions.slices import slices
from codecloom.layout import TokenLayout
from codecloom.operators import positions, tokens
from codecloom.operators.codes import add_codes, add_frames, drop_repeated_frames
from codecloom.operators.positions import sequence_positions
from codecloom.operators.tokens import FIRST_BYTE_ID, SPELLED_ID, WordTokenizer
from codecloom.operators.validate import accepted, rejected
from codecloom.plans.corpus import build_sequences
from codecloom.session import SETTINGS, small_batches
from codecloom.sources.files import ROW_GROUP_BYTES, ROW_GROUP_ROWS
from codecloom.sources.store import write_rows

L = TokenLayout()


def _given(spark, folder, texts, n_vectors):
    docs = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    vectors = [(i, [float(i)]) for i in range(n_vectors)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").write.parquet(
        f"{folder}/embeddings.parquet"
    )
    return str(folder)


def test_codec_rows(spark, tmp_path):
    texts = ["", None, "aé\U0001f600́", "\0x", "aaaa" * 3]
    found = {r.utt_id: r for r in fx.codec_rows(spark, _given(spark, tmp_path, texts, 2)).collect()}
    for i, text in enumerate(texts):
        c = None if text is None else [ord(x) for x in text] or [0]
        row = found[i]
        assert row.nano_layer_1 == (c and [x % 4032 for x in c])
        assert row.nano_layer_2 == (c and [x * 7 % 4032 for x in c])
        assert row.nano_layer_3 == (c and [k // 3 % 4032 for k in range(len(c))])
        assert row.nano_layer_4 == (c and [x // 2 % 4032 for x in c])
        assert row.speaker_emb == [float(i % 2)]


def test_codec_rows_move_texts_and_not_arrays(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for n in (2, 2000):
            rows = fx.codec_rows(spark, _given(spark, tmp_path / str(n), ["ab", "c"], n))
            plan = rows._jdf.queryExecution().optimizedPlan().toString().split("\n")
            join = next(k for k, line in enumerate(plan) if "Join" in line)
            below = "\n".join(plan[join:])
            assert "layers" not in below and "transform" not in below
            # With many vectors the texts move once, by the key of the join.
            assert ("RepartitionByExpression [__key" in below) == (n == 2000)
            assert rows.count() == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _largest_group(folder):
    sizes = []
    for file in folder.rglob("*.parquet"):
        facts = pq.ParquetFile(file).metadata
        sizes += [facts.row_group(k).total_byte_size for k in range(facts.num_row_groups)]
    return max(sizes)


def test_row_groups_of_long_arrays_are_small(spark, tmp_path):
    ids = F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda x: F.xxhash64(x, F.col("id")))
    wide = spark.range(0, 4000, 1, 1).select("id", ids.alias("ids"))  # 64 MB
    write_rows(wide.withColumn("status", F.lit("accepted")), str(tmp_path / "rows"))
    assert _largest_group(tmp_path / "rows") < 2 * ROW_GROUP_BYTES


def test_slices():
    rows = pa.array(["a", "bb", None, "c" * 9, "", "d"])
    cut = slices(3)
    parts = [p.to_pylist() for p in cut(rows, np.array([1, 2, 0, 9, 0, 1]))]
    assert parts == [["a", "bb", None], ["c" * 9], ["", "d"]]


def test_workers_take_slices(spark, monkeypatch):
    """Results are those of whole batches when every slice holds a row or two."""
    monkeypatch.setattr(tokens, "WORDS_PER_SLICE", 2)
    monkeypatch.setattr(positions, "IDS_PER_SLICE", 3)
    vocab = spark.createDataFrame([("a", 300), ("b", 301)], "word string, token_id bigint")
    texts = ["a b c", "", None, "c", "b a", "a"] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "id int, p string").coalesce(1)
    known = {"a": [300], "b": [301], "c": [SPELLED_ID, FIRST_BYTE_ID + ord("c")]}
    got = df.select("id", WordTokenizer(vocab, L).column(F.col("p")).alias("t")).orderBy("id").collect()
    for row, text in zip(got, texts, strict=True):
        assert (row.t or []) == [x for w in (text or "").split() for x in known[w]]
    audio = L.audio_start
    ids = [[1, audio, audio, 2], [], None, [audio] * 5, [7]] * 4
    df = spark.createDataFrame(list(enumerate(ids)), "id int, ids array<bigint>").coalesce(1)
    got = [r.q for r in df.select("id", sequence_positions(L)("ids").alias("q")).orderBy("id").collect()]
    assert got == [[0.0, 1.0, 1.0, 1.0], [], None, [0.0, 0.0, 0.0, 0.0, 1.0], [0.0]] * 4


def test_codes_are_those_of_the_array_expressions(spark, monkeypatch):
    """Repeats at the edges of slices, NULL codes, ragged, empty and NULL layers."""
    rows = [
        ([1, 1, 1, 2], [5, 5, 5, 5], [0, 0, 0, 0], [9, 9, 9, 9]),
        ([1, 1, None, None, 0], [5] * 5, [0] * 5, [9] * 5),
        ([1, 1, 1], [2, 2], [3], [4, 4, 4]),
        ([], [], [], []),
        ([9], [9], [9], [9]),
        ([9, 9], [9, 9], [9, 9], [9, 9]),
        (None, [1], [1], [1]),
        ([None] * 3, [None] * 3, [None] * 3, [None] * 3),
    ] * 3
    names = ", ".join(f"{c} array<int>" for c in L.layer_columns)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"id int, {names}").coalesce(1)
    slow = drop_repeated_frames(add_frames(df, L)).select("id", codec.frame_tokens(F.col("frames"), L).alias("codes"))
    expected = [r.codes for r in slow.orderBy("id").collect()]
    for size in (1, 6, 1 << 19):
        monkeypatch.setattr(codec, "FRAMES_PER_SLICE", size)
        found = add_codes(df, L).select("id", "codes").orderBy("id")
        assert [r.codes for r in found.collect()] == expected
        assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()


def test_row_groups_of_long_arrays_have_few_rows(spark, tmp_path):
    """Arrays that compress well take little room in the file and much in a reader."""
    wide = spark.range(0, 2000, 1, 1).select("id", F.array_repeat(F.lit(1), 2000).alias("ids"))
    write_rows(wide.withColumn("status", F.lit("accepted")), str(tmp_path / "rows"))
    fx.stored(spark, str(tmp_path), "wide", lambda: wide)
    fx.stored(spark, str(tmp_path), "narrow", lambda: wide.select("id"))
    paths = {n: fx._TABLES[(spark.sparkContext.applicationId, str(tmp_path), n)] for n in ("wide", "narrow")}
    for folder in (str(tmp_path / "rows"), paths["wide"]):
        facts = [pq.ParquetFile(f).metadata for f in pathlib.Path(folder).rglob("*.parquet")]
        sizes = [m.row_group(k).num_rows for m in facts for k in range(m.num_row_groups)]
        assert sum(sizes) == 2000 and max(sizes) <= ROW_GROUP_ROWS
    assert spark.read.parquet(paths["narrow"]).count() == 2000


def test_long_arrays_go_to_workers_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    most = int(SETTINGS[name])
    before = spark.conf.get(name)

    @F.arrow_udf("array<bigint>")
    def sizes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([[batch.nbytes]] * len(batch))

    names = ", ".join(f"{c} array<int>" for c in L.layer_columns)
    empty = spark.createDataFrame([], f"id int, {names}")
    try:
        spark.conf.set(name, str(8 * most))
        add_codes(empty, L)
        assert spark.conf.get(name) == str(most)
        wide = spark.range(0, 400, 1, 1).select(F.array_repeat(F.lit(1).cast("bigint"), 16_384).alias("ids"))  # 52 MB
        assert max(r.n[0] for r in wide.select(sizes("ids").alias("n")).collect()) < 2 * most
        for given in ("64m", "64MB", "67108864b", "1g"):
            spark.conf.set(name, given)
            small_batches(spark)
            assert spark.conf.get(name) == str(most)
        spark.conf.set(name, "1000")
        small_batches(spark)
        assert spark.conf.get(name) == "1000"
    finally:
        spark.conf.set(name, before)


def test_sequences_take_one_worker_step(spark):
    """A step that evaluates Python keeps its rows in pages of up to 64 MB and has a worker for each task."""
    vocab = spark.createDataFrame([("a", 300)], "word string, token_id bigint")
    names = ", ".join(f"{c} array<int>" for c in L.layer_columns)
    schema = f"utt_id int, text string, language_tag string, {names}"
    df = spark.createDataFrame([(1, "a b", "EN", *[[1, 1, 2]] * 4), (2, None, None, *[[3]] * 4)], schema)
    built = build_sequences(df, WordTokenizer(vocab, L).column, L)
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_extract_all" not in plan
    rows = {r.utt_id: r for r in built.collect()}
    spelled = [x for w in ("en:", "b") for x in [SPELLED_ID, *(FIRST_BYTE_ID + b for b in w.encode())]]
    assert rows[1].text_tokens == [L.start_of_text, *spelled[:4], 300, *spelled[4:], L.end_of_text]
    assert rows[1].codes == [L.layer_start(k) + c for c in (1, 2) for k in range(4)]
    assert rows[2].text_tokens == [L.start_of_text, L.end_of_text]


def test_words_cut_in_workers_are_those_of_the_expression(spark, monkeypatch):
    texts = ["a\tb\r\n c\f d\x0be", "", None, "a", "b", " \t ", " a", "a ", " x  ", "é \U0001f600b", "\0 c", ""] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "id int, p string").coalesce(1)
    vocab = spark.createDataFrame([("a", 300), ("é", 301)], "word string, token_id bigint")
    cut = {r.id: r.w or [] for r in df.select("id", tokens.words(F.col("p")).alias("w")).collect()}
    known = {"a": [300], "é": [301]}
    for size in (1, 3, 1 << 18):
        monkeypatch.setattr(tokens, "WORDS_PER_SLICE", size)
        for r in df.select("id", WordTokenizer(vocab, L).column(F.col("p")).alias("t")).collect():
            want = [known.get(w) or [SPELLED_ID, *(FIRST_BYTE_ID + b for b in w.encode())] for w in cut[r.id]]
            assert r.t == [x for ids in want for x in ids]


def test_readers_decode_few_rows_at_a_time(spark, tmp_path):
    """A reader's vectors hold a row group of values with their levels, many times its size in the file."""
    wide = spark.range(0, 500, 1, 1).select("id", F.array_repeat(F.lit(1), 2000).alias("ids"))
    fx.stored(spark, str(tmp_path), "few", lambda: wide)
    path = fx._TABLES[(spark.sparkContext.applicationId, str(tmp_path), "few")]
    facts = [pq.ParquetFile(f).metadata for f in pathlib.Path(path).rglob("*.parquet")]
    assert max(m.row_group(k).num_rows for m in facts for k in range(m.num_row_groups)) <= 64


def test_lists_of_codes_are_stored_in_two_levels(spark, tmp_path):
    texts = ["", None, "aé", "b" * 5000]
    before = spark.conf.get("spark.sql.parquet.writeLegacyFormat")
    folder = _given(spark, tmp_path, texts, 2)
    found = {r.utt_id: r for r in fx.codec_table(spark, folder).collect()}
    assert spark.conf.get("spark.sql.parquet.writeLegacyFormat") == before
    assert found == {r.utt_id: r for r in fx.codec_rows(spark, folder).collect()}
    for file in pathlib.Path(fx.codec_path(spark, folder)).rglob("*.parquet"):
        columns = pq.ParquetFile(file).schema
        kinds = {columns.column(k).path: columns.column(k).max_definition_level for k in range(len(columns))}
        assert all(kinds[f"{c}.array"] == 2 for c in L.layer_columns)


def test_rows_of_even_layers_make_no_frames(spark):
    names = ", ".join(f"{c} array<int>" for c in L.layer_columns)
    df = spark.createDataFrame([(1, *[[1, 1, 2]] * 4), (2, *[[3]] * 3, [4, 5]), (3, *[[1]] * 3, None)], f"id int, {names}")
    found = add_codes(df, L).select("id", "codes")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "codes(nano_layer_1" in plan and plan.count("arrays_zip") == 1
    rows = {r.id: r.codes for r in found.collect()}
    s = [L.layer_start(k) for k in range(4)]
    assert rows[1] == [s[k] + c for c in (1, 2) for k in range(4)]
    assert rows[2] == [3 + s[0], 3 + s[1], 3 + s[2], 4 + s[3], None, None, None, 5 + s[3]] and rows[3] is None


def test_null_codes_are_found_beside_the_value_looked_for(spark):
    least = -(2**31)
    rows = [[1, 2], [1, None], [least, 1], [least, None], [None], [0] * 50]
    names = ", ".join(f"{c} array<int>" for c in L.layer_columns)
    schema = f"utt_id int, text string, encoded_len int, {names}"
    for k in range(4):
        layers = [[x if j == k else [0] * len(x) for j in range(4)] for x in rows]
        df = spark.createDataFrame([(i, "t", len(x[0]), *x) for i, x in enumerate(layers)], schema)
        assert {r.utt_id for r in accepted(df, L).collect()} == {0, 2, 5}
        assert {(r.utt_id, r.reject_reason) for r in rejected(df, L).collect()} == {(i, "null_code") for i in (1, 3, 4)}


def test_digests_make_no_string_of_each_element(spark):
    arrays = [[1, None, 2], [None], [None, None], [], None, [5], [None, 7], [-100, 7, None], [-1, 0, 3], [4] * 3000]
    for kind, more in (("bigint", [[-(2**63), 5], [2**63 - 1], [-(2**63), None]]), ("int", [[-(2**31), 2**31 - 1]])):
        df = spark.createDataFrame(list(enumerate(arrays + more)), f"id int, x array<{kind}>")
        for column in (F.col("x"), F.concat("x", F.array_repeat(F.lit(8).cast(kind), 2))):  # stored, computed
            plain = F.md5(F.array_join(column.cast("array<string>"), ","))
            found = df.select(digest(column).alias("a"), plain.alias("b"))
            assert all(r.a == r.b for r in found.collect())
            text = found.select("a")._jdf.queryExecution().optimizedPlan().toString().lower()
            assert "json" in text
