"""The command that prepares a corpus from a configuration file."""

import json

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from codecloom.layout import TokenLayout
from codecloom.prepare import file_factory, main, named_factory
from codecloom.sources.store import open_counts, open_training

WORDS = {"en": 10, ":": 11, "hello": 12, "there": 13, "<unk>": 0}


def lengths_factory():
    return lambda texts: [[100 + len(t)] for t in texts]


@pytest.fixture
def files(spark, tmp_path):
    layers = [[1, 2], [3, 4], [5, 6], [7, 8]]
    rows = [("hello there", *layers, 2), ("hello", *layers, 2), (None, *layers, 2)]
    names = ["text", *[f"nano_layer_{k}" for k in range(1, 5)], "encoded_len"]
    types = ", ".join(f"{n} {'array<int>' if 'layer' in n else 'int' if 'len' in n else 'string'}" for n in names)
    spark.createDataFrame(rows, types).write.parquet(str(tmp_path / "talk"))
    entry = {n: n for n in names if n != "text"} | {"reponame": str(tmp_path / "talk"), "language_tag": "EN"}
    (tmp_path / "corpus.json").write_text(json.dumps({"hf_datasets": [entry, {**entry, "name": "capped", "max_len": 9}]}))
    tokenizer = Tokenizer(models.WordLevel(WORDS, unk_token="<unk>"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.save(str(tmp_path / "tokenizer.json"))
    return tmp_path


def text_ids(spark, out):
    rows = open_training(spark, out).where("source_ord = 0").select("input_ids").collect()
    return sorted([t for t in r["input_ids"] if 10 <= t < 64_000] for r in rows)


def test_corpus_by_a_tokenizer_file(spark, files, capsys):
    out = str(files / "out")
    status = main([str(files / "corpus.json"), out, "--tokenizer-file", str(files / "tokenizer.json")], spark)
    printed = capsys.readouterr().out
    assert status == 1 and "talk: read 3, rejected 1, kept 2" in printed and "cap of 9" in printed
    assert "total: 4 rows" in printed
    assert text_ids(spark, out) == [[10, 11, 12], [10, 11, 12, 13]]
    assert open_counts(spark, out).count() == 2
    assert "labels" not in spark.read.parquet(f"{out}/rows").columns


def test_corpus_by_a_factory_and_by_a_vocabulary(spark, files):
    config = str(files / "corpus.json")
    main([config, str(files / "a"), "--tokenizer", f"{__name__}:lengths_factory", "--stored-labels"], spark)
    assert text_ids(spark, str(files / "a")) == [[109], [115]]
    assert "labels" in spark.read.parquet(str(files / "a" / "rows")).columns
    spark.createDataFrame([("hello", 300), ("there", 301), ("en:", 302)], "word string, token_id int").write.parquet(
        str(files / "vocab")
    )
    main([config, str(files / "b"), "--vocabulary", str(files / "vocab"), "--rows-per-file", "1"], spark)
    assert text_ids(spark, str(files / "b")) == [[302, 300], [302, 300, 301]]


def test_refused_arguments(files):
    with pytest.raises(SystemExit):
        main([str(files / "corpus.json"), "out"])
    with pytest.raises(ValueError, match="module:function"):
        named_factory("json")
    with pytest.raises(ValueError, match="5 ids"):
        file_factory(str(files / "tokenizer.json"), TokenLayout(text_vocab_size=4))
