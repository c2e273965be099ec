"""Registered queries against SQL, and the pipeline stage by stage."""

import os

import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from checks import compare
from codecloom.llm.common import written
from codecloom.llm.oracle import ORACLE
from codecloom.llm.queries import QUERIES
from codecloom.llm.simhash import near_duplicates

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_operator_has_one_query():
    names = [f"op{n}_" for n in range(1, 14)]
    assert all(sum(q.startswith(n) for q in QUERIES) == 1 for n in names)
    assert {*QUERIES, "pipeline"} <= entry_module.queries().keys()
    assert ORACLE.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, monkeypatch, name):
    monkeypatch.setitem(compare.QUERIES, name, QUERIES[name])
    monkeypatch.setitem(compare.ORACLE, name, ORACLE[name])
    ok, note = compare.compare(spark, compare.oracle_connection(SF), SF, name)
    assert ok, note


def test_pipeline_stages(spark):
    """Odd rows through every stage: what each decides is seen in what is left."""
    line = "a line that several documents hold"
    words = " ".join(f"w{i}" for i in range(200))
    rows = [
        (1, f"{line}\nfirst of its own words and more of them", "en", "a", 0),
        (2, f"{line}\nsecond text with other content in it", "en", "a", 0),
        (3, None, "en", "b", 0),
        (4, "123 456", "en", "b", 0),
        (5, words, "en", None, 0),
        (6, words, None, "a", 0),
        (7, "", "de", "c", 0),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, schema)
    ids, texts = {}, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids[name] = {r["doc_id"] for r in docs.collect()}
        texts[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert ids["language_id"] == {1, 2, 5, 6}
    # The copy loses its only line, and what is left of it is an empty text, a group of its own.
    assert texts["line_dedup"][2] == "second text with other content in it" and texts["line_dedup"][6] == ""
    assert texts["line_dedup"][1].startswith(line)
    assert ids["simhash_near_dedup"] == ids["source_mixing"] == {1, 2, 5, 6}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.collect()} == {1, 2, 5, 6}


def near(spark, rows, schema="doc_id bigint, text string"):
    docs = written(spark.createDataFrame(rows, schema).coalesce(1), "test-near")
    return corpus_pipeline.near_duplicate_stage(spark, docs, SF)


def test_near_copies_by_fingerprint_are_dropped(spark):
    """The stage keeps one row of each component of the operator."""
    rows = []
    for k in range(30):
        words = [f"t{k}w{i}" for i in range(400)]
        rows.append((2 * k, " ".join(words)))
        rows.append((2 * k + 1, " ".join([*words[:-1], "edited"])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    groups = {r["component_id"] for r in near_duplicates(docs).collect()}
    left = sorted(r["doc_id"] for r in near(spark, rows).collect())
    assert left == sorted(groups) and len(left) < 60


def test_rows_of_one_id_stay_or_go_by_their_own_text(spark):
    copy, other, third = (" ".join(f"{c}{i}" for i in range(80)) for c in "abc")
    rows = [(2, copy), (1, copy), (2, other), (None, third), (None, third), (None, copy)]
    got = near(spark, rows).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, third), (1, copy), (2, other)]
    assert near(spark, [(None, third), (None, third)]).count() == 1
    # Two components may share their smallest id: both keep a row.
    assert near(spark, [(3, copy), (3, other), (4, copy), (4, other)]).count() == 2


def test_tables_without_any_language_keep_their_documents(spark):
    rows = [(i, f"a text with some letters {i}", None) for i in range(5)] + [(9, "12 34", None), (8, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = corpus_pipeline.language_stage(spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in got) == [0, 1, 2, 3, 4] and all(r["lang"] is None for r in got)


def test_missing_languages_are_filled_in(spark):
    texts = {"en": "the cat and the dog were in the house with them", "de": "der hund und die katze sind nicht im haus"}
    rows = [(i, texts[lang], lang) for i, lang in enumerate(["en", "de"] * 30)] + [(100, texts["de"], None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_stage(spark, docs, SF).collect()}
    assert got[100] == "de" and all(got[i] == lang for i, _, lang in rows[:-1])


CLASHING = ("_rank", "_h", "_s", "_p", "_before", "_path", "_row", "file", "place", "score", "languages", "held_out",
            "lang_pred", "row", "kept", "n_lines", "hash", "id", "others", "component_fp", "mix_block", "own")


def test_extra_columns_come_through_the_stages(spark):
    """Columns that bear names used inside keep their values, repeated and NULL ids included."""
    ids = [1, 2, 2, None, 5, 6]
    rows = [
        (i, f"text number {k} has words of its own {k * 7}", "en" if k % 2 else None, f"s{k % 2}", 5, *[f"{c}-{k}" for c in CLASHING])
        for k, i in enumerate(ids)
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    docs = spark.createDataFrame(rows, schema + ", ".join(f"`{c}` string" for c in CLASHING)).repartition(2)
    want = {tuple(r[5:]) for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), f"test-clash-{name}")
        assert docs.columns[5:] == list(CLASHING)
        assert {tuple(r)[5:] for r in docs.collect()} == want and docs.count() == len(ids)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert sorted((r["doc_id"] or 0) for r in packed.collect()) == [0, 1, 2, 2, 5, 6]


def test_sequences_follow_the_mixture(spark):
    """A large source and small ones: each prefix of sequences holds the shares of the mixture."""
    sizes = {"a": 6400, "b": 1600, "c": 400}
    rows = [(i, "x", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    mixed = written(corpus_pipeline.mixing_stage(spark, docs, SF), "test-mixture")
    packed = corpus_pipeline.packing_stage(spark, mixed, SF).join(docs.drop("text"), "doc_id")
    got = packed.select("sequence_id", "source").sort("sequence_id").collect()
    # The square roots 80, 40, 20 are the weights until c is used up, after 2,800 documents.
    second = sorted({r["sequence_id"] for r in got})[1]
    prefix = [r["source"] for r in got if r["sequence_id"] <= second]
    for source, share in {"a": 4 / 7, "b": 2 / 7, "c": 1 / 7}.items():
        assert abs(prefix.count(source) / len(prefix) - share) < 0.05
    # Long documents, one to a sequence: sequences are in the order of the files.
    long = [(i, " ".join(["word"] * (1200 + i % 7))) for i in reversed(range(60))]
    stored = written(spark.createDataFrame(long, "doc_id bigint, text string"), "test-order")
    placed = corpus_pipeline.packing_stage(spark, stored, SF).sort("sequence_id").collect()
    assert [r["doc_id"] for r in placed] == [i for i, _ in long]


def test_pipeline_runs_and_repeats(spark):
    first, second = (
        {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} for _ in range(2)
    )
    assert first and first == second
