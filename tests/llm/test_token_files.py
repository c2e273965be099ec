"""Token ids, their files, phrase collocations and whitening against brute force."""

import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from codecloom.llm.collocations import Words, collocations, phrase_counts
from codecloom.llm.packing import pack_documents
from codecloom.llm.queries import tokenizer_path
from codecloom.llm.token_files import TokenFile, TokenSequences, read_documents, write_token_files
from codecloom.llm.token_ids import WordIds
from codecloom.llm.whitening import whiten
from codecloom.session import shared_path

LONG = " ".join(f"word{i % 977}." for i in range(30_000))
TEXTS = [
    (5, "The quick brown fox"), (3, None), (1, ""), (2, "a <|endoftext|> b # c"), (9, LONG),
    (4, " lead and tail "), (4, " lead and tail "), (4, "another text of a repeated id"), (None, "no id"),
    (None, None), (-7, "two  spaces\n\n and lines\r\n"), (8, "日本 語 é \x1c emoji 😀 it's"), (7, "x" * 9000),
]


@pytest.fixture(scope="module")
def docs(spark):
    # The extra columns bear names used inside.
    rows = [(i, t, k, "f", 1) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, id int, file string, start int"
    ).repartition(3).cache()


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(tokenizer_path())


def plain_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("cache", [1, 1 << 20])
def test_word_ids_equal_the_plain_tokenizer(plain, cache):
    random.seed(3)
    letters = "ab 'sSté1\n\t .,-²😀日  \r½\x85\x1c\xa0"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(4000)]
    texts += [t or "" for _, t in TEXTS] + ["<|endoftext|>", "x<|endoftext|>y z", "'ll 've don't I'm"]
    encoder = WordIds(tokenizer_path(), cache_bytes=cache)
    for _ in range(2):
        for part in (texts[:1500], texts[1500:], []):
            ids, offsets = encoder.encode(pa.array(part, pa.string()))
            got = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
            assert got == [plain_ids(plain, t) for t in part]


def test_word_ids_of_another_kind_of_vocabulary():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["The Quick  brown", " a", ""]
    ids, offsets = WordIds(path).encode(pa.array(texts))
    other = Tokenizer.from_file(path)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [plain_ids(other, t) for t in texts]


def test_packing_counts_the_marker_as_the_tokenizer_does(docs, plain):
    rows = pack_documents(docs, tokenizer_path()).where("doc_id = 2").collect()
    assert [r["doc_tokens"] for r in rows] == [len(plain_ids(plain, TEXTS[3][1])) + 1]
    assert 50256 in plain_ids(plain, TEXTS[3][1])


def test_token_files_round_trip(spark, docs, plain):
    folder = shared_path(spark, "files")
    write_token_files(docs, tokenizer_path(), folder, width=64)
    got = read_documents(spark, folder, with_ids=True).toPandas().sort_values("start")
    want = Counter()
    for key, text in TEXTS:
        want[(key, np.array(plain_ids(plain, text) + [2], dtype="<u4").tobytes())] += 1
    keys = [None if pd.isna(k) else int(k) for k in got["doc_id"]]
    assert Counter(zip(keys, map(bytes, got["ids"]))) == want
    # Ascending ids, NULL last, without gaps.
    assert keys == sorted(keys, key=lambda k: (k is None, k or 0))
    assert got["start"].tolist() == [0, *np.cumsum(got["n_tokens"])[:-1]]
    assert [zlib.crc32(x) for x in got["ids"]] == got["ids_crc32"].tolist()
    # Sequences in order hold the same stream, padded at the end of each file.
    sequences = TokenSequences(folder)
    parts = [sequences[i] for i in range(len(sequences))]
    assert all(len(ids) == len(mask) == 64 and ids.dtype == np.dtype("<u2") for ids, mask in parts)
    stream = np.concatenate([ids[mask.to_numpy(zero_copy_only=False)] for ids, mask in parts])
    assert stream.astype("<u4").tobytes() == b"".join(got["ids"])
    with pytest.raises(IndexError):
        sequences[len(sequences)]


def test_sequences_are_views_of_the_file(spark, docs):
    folder = shared_path(spark, "views")
    write_token_files(docs, tokenizer_path(), folder, width=64)
    name = max(Path(folder).glob("*.arrow"), key=lambda p: p.stat().st_size)
    before = pa.total_allocated_bytes()
    file = TokenFile(str(name))
    kept = [file.sequence(i) for i in range(len(file))]
    assert len(kept) > 256 and pa.total_allocated_bytes() == before
    assert not any(ids.flags.owndata or ids.flags.writeable for ids, _ in kept)
    assert kept[300][1].true_count == 64


def test_empty_token_files(spark, docs):
    folder = shared_path(spark, "none")
    write_token_files(docs.limit(0), tokenizer_path(), folder)
    assert read_documents(spark, folder).collect() == []
    assert len(TokenSequences(folder)) == 0


# --- phrases ---------------------------------------------------------------------------------


def brute_collocations(rows, min_count, top, longest=5):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[(lang, *words[i : i + k])] += 1
    out = {}
    for key, a in f.items():
        lang, words = key[0], key[1:]
        if a < min_count or len(words) < 2:
            continue
        longer = max(
            (b for other, b in f.items() if b >= min_count and other[0] == lang and len(other) > len(key)
             and any(other[i : i + len(words)] == words for i in range(1, len(other) - len(words) + 1))),
            default=0,
        )
        if longer >= a:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[(lang, *words[:k])], f[(lang, *words[k:])]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return {
        (lang, r, p.decode(), -a, left, right, n[lang], -score)
        for lang, found in out.items()
        for r, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    }


def phrase_rows():
    random.seed(5)
    vocabulary = ["Alpha", "beta", "gamma", "é", "ÉA", "x-y", "10", "the", "of"]
    rows = []
    for k in range(300):
        words = [random.choice(vocabulary[: 3 + k % 7]) for _ in range(random.randint(0, 40))]
        text = "".join(w + random.choice([" ", " ", "  ", "\t", ", ", ".\n"]) for w in words)
        rows.append((random.choice(["en", "de", None]), text))
    return rows + [("en", None), ("en", ""), ("fr", " \t.,"), ("en", "the of the of the of " * 400)]


@pytest.mark.parametrize("bits, slice_bytes", [(64, 300), (6, 1 << 20)])
def test_collocations_equal_brute_force(spark, bits, slice_bytes):
    """Few fingerprint bits make most n-grams collide; small slices cut long texts into parts."""
    rows = phrase_rows()
    table = [(k % 250, lang, text, 1) for k, (lang, text) in enumerate(rows)]
    docs = spark.createDataFrame(table, "doc_id bigint, lang string, text string, fp int").repartition(3)
    got = collocations(docs, min_count=12, top=40, fingerprint_bits=bits, slice_bytes=slice_bytes)
    found = {tuple(r)[:8] for r in got.collect()}
    assert found == brute_collocations(rows, 12, 40) and found


def test_phrase_counts_name_a_document(spark):
    rows = [(7, "en", "one two one two"), (3, "en", "one two"), (None, "de", "one two")]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    got = {tuple(r) for r in phrase_counts(docs, min_count=2).collect()}
    assert {("en", 2, "one two", 3, 3, 0), ("en", 1, "two", 3, 3, 1)} <= got
    assert {r[:4] for r in got if r[1] == 0} == {("en", 0, "", 6), ("de", 0, "", 2)}
    assert collocations(docs.limit(0)).collect() == []


def test_equal_word_hashes_are_told_apart():
    words = Words([b"aa bb aa cc bb"], np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))
    words.hash[:] = 7
    numbers, texts = words.word_numbers()
    assert [texts[i].as_py() for i in numbers] == ["aa", "bb", "aa", "cc", "bb"]
    assert numbers[0] == numbers[2] and numbers[1] == numbers[4] and len(set(numbers)) == 3


# --- whitening -------------------------------------------------------------------------------


def vectors(n=400, d=20, seed=1):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 0.3 + 5).astype(np.float32)


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening_equals_numpy(spark, weights):
    given = vectors()
    rows = [(i, v.tolist(), "x") for i, v in enumerate(given)]
    rows += [(1000 + i, given[7].tolist(), "x") for i in range(900)]  # a hot vector
    rows += [(3, given[3].tolist(), "x"), (None, given[4].tolist(), "x")]
    bad = [(2000, None, "x"), (2001, [None] + given[0].tolist()[1:], "x"), (2002, [float("nan")] * 20, "x"),
           (2003, [float("-inf")] * 20, "x"), (2004, [1e300] * 20, "x")]
    table = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>, n string")
    if weights == "one":  # 1e300 is no float: it was infinite
        table = table.withColumn("deviation", table["vec_id"])
    got = whiten(table.repartition(5), weights=weights).toPandas()
    assert len(got) == 16 * len(rows)
    x = np.floor(64 * given.astype(np.float64)).astype(int) + 1_000_000
    keys = [tuple(v) for v in x.tolist()]
    counts = Counter(keys[i % 1000 if i < 1000 else 7] for i in [*range(400), *[1007] * 900, 3, 4])
    distinct = np.array(sorted(counts))
    w = np.array([counts[tuple(v)] if weights == "count" else 1 for v in distinct.tolist()])
    n, total = int(w.sum()), (distinct * w[:, None]).sum(axis=0)
    y = distinct - total / n
    covariance = (y * w[:, None]).T @ y / n
    values, directions = np.linalg.eigh(covariance)
    values, directions = values[::-1][:16], directions[:, ::-1][:, :16]
    assert (got["n"] == n).all() and (got["identity_error"] < 1e-9).all()
    one = got[got["vec_id"] == 5].sort_values("component")
    want = (x[5] - total / n) @ directions / np.sqrt(values)
    assert np.allclose(np.abs(one["whitened"]), np.abs(want), atol=1e-8)
    assert np.allclose(one["explained"], values / np.trace(covariance))
    assert one["deviation"].iloc[0] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[5], total))
    assert (got["vec_id"] == 3).sum() == 32 and got["vec_id"].isna().sum() == 16
    hot = got[(got["vec_id"] >= 1000) & (got["component"] == 1)]
    assert len(hot) == 900 and hot["whitened"].nunique() == 1


def test_whitening_of_odd_tables(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).collect() == []
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    assert whiten(spark.createDataFrame([(1, [])], schema)).collect() == []
    ragged = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [4.0, 0.5]), (4, [1.0, 0.0])], schema)
    rows = whiten(ragged).toPandas()
    assert len(rows) == 8 and (rows["n"] == 3).all()
    same = rows.pivot(index="vec_id", columns="component", values="whitened")
    assert (same.loc[2] == same.loc[4]).all()
    with pytest.raises(ValueError):
        whiten(ragged, weights="some")


def test_deviations_beyond_a_long_are_null(spark):
    rows = [(i, [float(i) * 2.0**50, 1.0]) for i in range(4)]
    got = whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).toPandas()
    assert got["deviation"].isna().all() and (got["identity_error"] < 1e-4).all()
