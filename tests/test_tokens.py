import pytest
from pyspark.sql import functions as F

from codecloom.layout import TokenLayout
from codecloom.operators import tokens as tk
from tests.helpers import L, one

W = tk.FIRST_WORD_ID
SMALL = TokenLayout(text_vocab_size=W + 3)


def spell(word):
    return [tk.SPELLED_ID, *[b + tk.FIRST_BYTE_ID for b in word.encode()]]


def read_words(ids, names):
    """The words that ids stand for."""
    out = []
    for i in ids:
        if i >= W:
            out.append(bytes(names[i], "utf-8"))
        elif i == tk.SPELLED_ID:
            out.append(b"")
        else:
            out[-1] += bytes([i - tk.FIRST_BYTE_ID])
    return [w.decode() for w in out]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [
        (1, "the cat  sat", "EN"),
        (2, "\tthe\nend ", None),
        (3, "", None),
        (4, "unknown-word " + "x" * 70, "fr"),
    ]
    return spark.createDataFrame(rows, "utt_id bigint, text string, language_tag string")


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame(
        [("the", W), ("cat", W + 1), ("sat", W + 2), ("en:", W + 3), ("end", W + 4)], "word string, token_id bigint"
    )


WANT = {
    1: [1, W + 3, W, W + 1, W + 2, 2],
    2: [1, W, W + 4, 2],
    3: [1, 2],
    4: [1, *spell("fr:"), *spell("unknown-word"), *spell("x" * 70), 2],
}


def test_prompt(texts):
    rows = {r.utt_id: r.prompt for r in tk.add_prompt(texts).collect()}
    assert rows[1] == "en: the cat  sat" and rows[2] == "\tthe\nend "


def test_arrow_lookup_and_join_agree(texts, vocab):
    tokenizer = tk.WordTokenizer(vocab, L)
    for parts in (1, 7):
        a = tk.add_text_tokens(texts.repartition(parts), tokenizer.column, L)
        assert {r.utt_id: r.text_tokens for r in a.collect()} == WANT
    b = tk.text_tokens_by_join(texts, vocab, L)
    assert {r.utt_id: r.text_tokens for r in b.collect()} == WANT


def test_start_marker_is_optional(texts, vocab):
    out = tk.add_text_tokens(texts, tk.WordTokenizer(vocab, L).column, L, lead=False)
    assert {r.utt_id: r.text_tokens for r in out.collect()} == {k: v[1:] for k, v in WANT.items()}


def test_own_tokenizer(texts):
    column = tk.custom_tokenizer(lambda: lambda text: [len(w) for w in text.split()])
    out = tk.add_text_tokens(texts, column, L)
    assert {r.utt_id: r.text_tokens for r in out.collect()}[1] == [1, 3, 3, 3, 3, 2]


def test_vocabulary_stays_in_the_text_range(spark):
    df = spark.createDataFrame([("a b c d e a a " + "y" * 80,), ("b b c",), (None,), ("",)], "text string")
    full = {r.word: r.token_id for r in tk.build_vocabulary(df, L).collect()}
    assert set(full) == {*"abcde", "y" * 80}
    assert sorted(full.values()) == list(range(W, W + 6))
    # By count; words of one count by md5.
    assert {full["a"], full["b"]} == {W, W + 1} and full["c"] == W + 2
    few = {r.word: r.token_id for r in tk.build_vocabulary(df, SMALL).collect()}
    assert few == {k: v for k, v in full.items() if v < W + 3}
    four = tk.build_vocabulary(df, TokenLayout(text_vocab_size=W + 4)).collect()
    assert {r.word: r.token_id for r in four} == {k: v for k, v in full.items() if v < W + 4}
    assert tk.build_vocabulary(df, TokenLayout(text_vocab_size=W)).count() == 0
    assert tk.build_vocabulary(df.where("false"), L).count() == 0


def test_tokens_give_back_the_words(spark):
    texts = ["a a b  c", "日本 naïve a", "zz\tzz 🙂 b", "", None, "x" * 5000 + " a"]
    df = spark.createDataFrame(list(enumerate(texts)), "utt_id bigint, text string")
    df = df.withColumn("language_tag", F.lit(None).cast("string"))
    for layout in (SMALL, L, TokenLayout(text_vocab_size=W)):
        vocab = tk.build_vocabulary(df, layout)
        names = {r.token_id: r.word for r in vocab.collect()}
        arrow = tk.add_text_tokens(df, tk.WordTokenizer(vocab, layout).column, layout)
        joined = tk.text_tokens_by_join(df, vocab, layout)
        got = {r.utt_id: r.text_tokens for r in arrow.collect()}
        assert got == {r.utt_id: r.text_tokens for r in joined.collect()}
        for i, text in enumerate(texts):
            assert read_words(got[i][1:-1], names) == (text or "").split()


def test_bad_vocabularies_are_refused(spark):
    def words(*rows):
        return spark.createDataFrame(list(rows), "word string, token_id bigint")

    for bad in (words(("a", W - 1)), words(("a", W + 3)), words(("a", W), ("a", W + 1)), words((None, W)), words(("a", None))):
        with pytest.raises(ValueError):
            tk.WordTokenizer(bad, SMALL)
        with pytest.raises(ValueError):
            tk.lookup_words(spark.createDataFrame([("a",)], "word string"), bad, SMALL)


def test_large_vocabularies_are_joined_without_broadcast(spark, texts, vocab, monkeypatch):
    monkeypatch.setattr(tk, "MAX_VOCABULARY_BYTES", 3)
    with pytest.raises(ValueError):
        tk.WordTokenizer(vocab, L)
    out = tk.text_tokens_by_join(texts, vocab, L)
    assert {r.utt_id: r.text_tokens for r in out.collect()} == WANT


def test_hot_word_is_not_shuffled_by_word(spark, vocab):
    hot = spark.range(1000).select(F.when(F.col("id") % 3 > 0, "the").otherwise("cat").alias("word"))
    out = tk.lookup_words(hot, vocab, L)
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    assert one(out.agg(F.sum(F.col("token_ids")[0]).alias("s"))).s == 666 * W + 334 * (W + 1)


def test_prompts_are_shuffled_and_words_are_not(spark, texts, vocab, monkeypatch):
    monkeypatch.setattr(tk, "PROMPT_BYTES", 1)
    out = tk.text_tokens_by_join(texts, vocab, L)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("Generate") < plan.index("Exchange hashpartitioning")
    assert {r.utt_id: r.text_tokens for r in out.collect()} == WANT
    # As many partitions as the sizes of the prompts ask for.
    size = tk.add_prompt(texts).agg(F.sum(F.octet_length("prompt"))).first()[0]
    assert f"hashpartitioning(utt_id" in plan and f", {max(size, 8)})" in plan


def test_prompts_with_repeated_and_null_keys(spark, vocab):
    given = spark.createDataFrame([(1, "the cat"), (1, "cat"), (None, "the"), (2, None)], "utt_id bigint, text string")
    df = given.withColumn("language_tag", F.lit(None).cast("string"))
    got = {r.utt_id: r.text_tokens for r in tk.text_tokens_by_join(df, vocab, L).collect()}
    start, end = L.start_of_text, L.end_of_text
    assert got == {1: [start, W, W + 1, W + 1, end], None: [start, W, end], 2: [start, end]}


def test_counts_of_ids_make_no_row_of_each_id(spark, monkeypatch):
    rows = [[5, 5, 7], None, [], [None, 7, None], [5] * 40, [-3], [2**40, 5]] * 3
    for kind, given in (("bigint", rows), ("int", [r for r in rows if not r or 2**40 not in r])):
        df = spark.createDataFrame(list(enumerate(given)), f"id int, input_ids array<{kind}>").coalesce(2)
        plain = df.select(F.explode("input_ids").alias("t")).groupBy("t").count()
        want = {(None if r.t is None else int(r.t), r["count"]) for r in plain.collect()}
        for size in (1, 4, 1 << 20):
            monkeypatch.setattr(tk, "IDS_PER_SLICE", size)
            found = tk.token_counts(df)
            assert {tuple(r) for r in found.collect()} == want
            assert [t for _, t in found.dtypes] == ["bigint", "bigint"]
    generated = [n for n in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Generate explode(" in n]
    assert generated and all("pythonUDF" in n for n in generated)
