import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from codecloom.config import CorpusConfig
from codecloom.operators.tokens import custom_tokenizer
from codecloom.operators.validate import accepted, flag_rows, reject_summary
from codecloom.plans.corpus import (
    corpus_counts,
    corpus_rejects,
    prepare_corpus,
    run_preparation,
)
from codecloom.sources.load import load_sources
from codecloom.sources.store import (
    damaged_files,
    load_training,
    open_counts,
    open_manifest,
    open_rejects,
    open_training,
    read_length_stats,
    save_training,
)
from tests.helpers import L, one

LAYERS = ", ".join(f"{c} array<int>" for c in L.layer_columns)
SCHEMA = f"sentence string, {LAYERS}, frames bigint, voice array<double>"
A, B = (1, 2, 3, 4), (5, 6, 7, 8)


def split(frames):
    return [[f[k] for f in frames] for k in range(4)]


def utterance(text, frames, n=None, voice=(0.5,)):
    return (text, *split(frames), len(frames) if n is None else n, list(voice))


tokenizer = custom_tokenizer(lambda: lambda text: [len(w) for w in text.split()])


@pytest.fixture
def config(spark, tmp_path):
    good = [utterance(f"word {'x' * i}", [A, A, B][: i % 3 + 1]) for i in range(6)]
    bad = [
        ("null layer", *split([A])[:3], None, 1, [0.5]),
        ("ragged", *split([A, B])[:3], [4], 2, [0.5]),
        utterance("empty", []),
        ("no length", *split([A]), None, [0.5]),
        utterance("null code", [(1, None, 3, 4)]),
        utterance(None, [A]),
        utterance("too long", [A], n=501),
    ]
    for name, rows in (("one", good + bad), ("two", good)):
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / name))
    entry = {
        "text_col_name": "sentence", "encoded_len": "frames", "speaker_emb": "voice",
        **{c: c for c in L.layer_columns},
    }
    return CorpusConfig.from_dict(
        {
            "max_duration_sec": 40,
            "lenght_statistics": True,
            "hf_datasets": [
                {**entry, "reponame": str(tmp_path / "one"), "language_tag": "EN"},
                {**entry, "reponame": str(tmp_path / "two"), "max_len": 4},
                {**entry, "reponame": str(tmp_path / "two"), "name": "again", "max_len": 99},
            ],
        }
    )


def test_preparation_end_to_end(spark, config, tmp_path):
    out = str(tmp_path / "out")
    run_preparation(spark, config, tokenizer, out)
    corpus = open_training(spark, out)
    assert {r.source_ord: r["count"] for r in corpus.groupBy("source_ord").count().collect()} == {
        0: 6, 1: 4, 2: 6
    }
    row = corpus.where("source_ord = 0 and encoded_len = 3").first()
    codes = [t for t in row.input_ids if t >= 64410]
    assert codes == [64411, 68444, 72477, 76510, 64415, 68448, 72481, 76514]  # A once, then B
    assert row.labels == row.input_ids and set(row.attention_mask) == {1}
    assert row.input_ids[:3] == [64403, 1, 3]  # the prompt begins with "en:"
    assert row.encoded_len == 3 and row.speaker_emb == [0.5]  # the length before the repeats went

    stats = one(read_length_stats(spark, f"{out}_length_statistics"))
    assert stats.total_samples == 16
    assert stats.encoded_length.max == 3.0 and stats.duration_seconds.max == pytest.approx(0.24)

    rejects = open_rejects(spark, out)
    assert {r.reject_reason for r in rejects.collect()} == {
        "null_layer", "ragged_layers", "empty_codes", "null_len", "null_code", "null_text"
    }

    shuffled = load_training(spark, out, seed=5)
    assert sorted(r.shuffle_rank for r in shuffled.collect()) == list(range(16))


def test_keys_are_stable_and_unique(spark, config):
    def keys():
        parts = load_sources(spark, config, L)
        return sorted(r.utt_id for p in parts for r in p.select("utt_id").collect())

    first = keys()
    assert len(set(first)) == len(first) == 25
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert keys() == first
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_compact_corpus(spark, config):
    df = prepare_corpus(spark, config, tokenizer, derived=False)
    assert "labels" not in df.columns and "attention_mask" not in df.columns
    assert df.count() == 16


def test_counts_and_short_source(spark, config):
    rows = {r.source_ord: r for r in corpus_counts(spark, config).collect()}
    assert (rows[0].n_read, rows[0].n_in_duration, rows[0].n_rejected, rows[0].n_prepared) == (13, 12, 6, 6)
    assert rows[0].cap is None and not rows[0].short_of_cap
    assert rows[1].n_kept == 4 and not rows[1].short_of_cap
    assert rows[2].n_kept == 6 and rows[2].short_of_cap


def test_every_row_is_either_accepted_or_rejected(spark, config):
    rows = load_sources(spark, config, L)[0]
    assert accepted(rows, L).count() == flag_rows(rows, L).where("reject_reason is null").count() == 7
    assert {r.reason: r.n_rows for r in reject_summary(rows, L).collect()}["accepted"] == 7
    assert corpus_rejects(spark, config).count() == 6


def test_missing_column_is_an_error(spark, config, tmp_path):
    wrong = CorpusConfig.from_dict({"sources": [{"path": str(tmp_path / "one")}]})
    with pytest.raises(AnalysisException):
        load_sources(spark, wrong, L)[0].collect()


def test_missing_or_empty_corpus_is_an_error(spark, config, tmp_path):
    with pytest.raises(FileNotFoundError):
        open_training(spark, str(tmp_path / "nowhere"))
    empty = str(tmp_path / "empty")
    save_training(prepare_corpus(spark, config, tokenizer).where(F.lit(False)), empty)
    with pytest.raises(ValueError):
        open_training(spark, empty)


def test_config_files(tmp_path):
    cfg = {"max_duration_sec": None, "length_statistics": True, "sources": [{"path": "/a/b", "max_len": "7"}]}
    path = tmp_path / "c.json"
    path.write_text(json.dumps(cfg))
    found = CorpusConfig.from_file(str(path))
    assert found.length_statistics and found.sources[0].max_len == 7 and found.sources[0].name == "b"
    yaml = pytest.importorskip("yaml")
    path = tmp_path / "c.yaml"
    path.write_text(yaml.safe_dump(cfg))
    assert CorpusConfig.from_file(str(path)) == found
    with pytest.raises(ValueError):
        CorpusConfig.from_dict({"sources": [{"name": "x"}]})


def test_json_source(spark, config, tmp_path):
    rows = [utterance("a b", [A, B]), utterance("c", [A])]
    path = str(tmp_path / "json")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(path)
    entry = {
        "path": path, "format": "json", "text_col_name": "sentence", "encoded_len": "frames",
        "speaker_emb": "voice",
    }
    df = prepare_corpus(spark, CorpusConfig.from_dict({"sources": [entry]}), tokenizer)
    assert sorted(len(r.input_ids) for r in df.collect()) == [6 + 3 + 4, 6 + 4 + 8]
    capped = CorpusConfig.from_dict({"sources": [{**entry, "max_len": 1}]})
    with pytest.raises(ValueError):
        prepare_corpus(spark, capped, tokenizer)


def test_std_of_long_lengths_is_exact(spark):
    from codecloom.operators.corpus_stats import length_stats

    df = spark.range(1000).select((F.col("id") % 2 + 100_000_000).alias("encoded_len"))
    assert length_stats(df).first()["frames_std"] == 0.5


def test_rows_of_a_partitioned_folder_have_keys_of_their_own(spark, tmp_path):
    from codecloom.config import SourceConfig
    from codecloom.sources.load import load_source

    rows = spark.range(200).select(
        (F.col("id") % 4).alias("part"), F.lit("t").alias("text"), F.lit(3).alias("encoded_len"),
        *[F.array(F.lit(1)).alias(f"nano_layer_{k}") for k in range(1, 5)],
    )
    # One file a folder, all of one task and so of one name.
    rows.coalesce(1).write.partitionBy("part").parquet(str(tmp_path / "in"))
    cfg = SourceConfig.from_dict({"name": "s", "path": str(tmp_path / "in"), "speaker_emb": None})
    assert load_source(spark, cfg, 0, L).select("utt_id").distinct().count() == 200


def test_counts_are_observed_while_writing(spark, config, tmp_path):
    out = str(tmp_path / "observed")
    run_preparation(spark, config, tokenizer, out)
    columns = ["source_ord", "source", "n_read", "n_in_duration", "n_rejected", "n_prepared", "cap", "n_kept", "short_of_cap"]
    seen = {tuple(r) for r in open_counts(spark, out).select(columns).collect()}
    assert seen == {tuple(r) for r in corpus_counts(spark, config).select(columns).collect()}
    keys = ["source_ord", "utt_id", "reject_reason"]
    assert {tuple(r) for r in open_rejects(spark, out).select(keys).collect()} == {
        tuple(r) for r in corpus_rejects(spark, config).select(keys).collect()
    }
    kept = {tuple(r) for r in open_training(spark, out).select("source_ord", "utt_id").collect()}
    assert kept == {tuple(r) for r in prepare_corpus(spark, config, tokenizer).select("source_ord", "utt_id").collect()}


def test_a_source_is_scanned_once(spark, config):
    from dataclasses import replace

    from codecloom.plans.corpus import observed_rows

    plain = replace(config, sources=tuple(replace(s, max_len=None) for s in config.sources))
    rows, _ = observed_rows(spark, plain, tokenizer)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 3 and "Exchange" not in plan


def test_an_unfinished_corpus_cannot_be_opened(spark, config, tmp_path, monkeypatch):
    from codecloom.plans import corpus

    out = str(tmp_path / "died")

    def dies(*_):
        raise RuntimeError("the job died")

    with monkeypatch.context() as patch:
        patch.setattr(corpus, "save_length_stats", dies)
        with pytest.raises(RuntimeError):
            run_preparation(spark, config, tokenizer, out)
    for opened in (open_training, open_rejects, open_counts, open_manifest):
        with pytest.raises(FileNotFoundError):
            opened(spark, out)
    run_preparation(spark, config, tokenizer, out, rows_per_file=2)
    manifest = open_manifest(spark, out).collect()
    assert open_training(spark, out).count() == 16
    assert sum(r.n_rows for r in manifest) == 22 and max(r.n_rows for r in manifest) <= 2
    assert damaged_files(spark, out).count() == 0
    with pytest.raises(FileExistsError):
        run_preparation(spark, config, tokenizer, out)
    first = next(iter(sorted((tmp_path / "died" / "rows" / "status=accepted").glob("*.parquet"))))
    first.unlink()
    assert damaged_files(spark, out).count() == 1
