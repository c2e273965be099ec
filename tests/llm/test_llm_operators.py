"""Operators against brute force on small tables that hold every odd case."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from codecloom.llm import mixing, packing, suffix_dedup as suffixes, topk
from codecloom.llm.common import written
from codecloom.llm.exact_dedup import HashIndex, build_index, exact_groups, index_lookup
from codecloom.llm.induced_sort import sorted_suffixes
from codecloom.llm.language_id import identify
from codecloom.llm.line_dedup import line_dedup
from codecloom.llm.oracle import ORACLE
from codecloom.llm.queries import tokenizer_path
from codecloom.llm.quote_links import threaded_conversations
from codecloom.llm.simhash import fingerprint, near_duplicates
from codecloom.llm.suffix_dedup import suffix_dedup
from codecloom.llm.token_ids import WordIds
from codecloom.llm.toxicity import Settings, features, setting_losses, toxicity, train_shard

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
PASSAGE = "This sentence is long enough to be a passage of more than fifty bytes, surely. "
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today"),
    (2, "The  quick brown fox\tjumps over the lazy dog near the old river bank today"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "A repeated line here\nsomething of its own\nA repeated line here"),
    (7, "  a REPEATED line here \nother words entirely\nshort\n"),
    (8, "short\nA repeated line here"),
    (9, PASSAGE + "Nine follows with words of its own."),
    (10, "Ten begins. " + PASSAGE + PASSAGE + " and ends"),
    (11, LONG),
    (12, LONG + " tail"),
    (12, "another text under a repeated id"),
    (13, "exact copy of a text that is longer than fifty bytes, for the byte search"),
    (14, "exact copy of a text that is longer than fifty bytes, for the byte search"),
    (14, "exact copy of a text that is longer than fifty bytes, for the byte search"),
    (None, "exact copy of a text that is longer than fifty bytes, for the byte search"),
    (None, "a row without an id\nA repeated line here"),
    (15, "é" * 60),
    (16, "x" + "é" * 60),
    (17, "12345 67890 !!!"),
    (18, "aaaa" * 40),
    (19, "aaaa" * 50),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if k % 2 else None, f"s{k % 3}" if k % 4 else None, 7) for k, (i, t) in enumerate(TEXTS)]
    # Extra columns bear names that operators use inside.
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, hash int"
    ).repartition(4).cache()


def bag(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def order(i):
    return 2**63 - 1 if i is None else i


@pytest.mark.parametrize("capacity, bits", [(1, 64), (3, 64), (1024, 64), (3, 2), (1024, 3)])
def test_exact_groups(docs, capacity, bits):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in TEXTS]
    want, seen = [], set()
    for i, t in norm:
        ids = [j for j, u in norm if u == t and j is not None]
        keep = min(ids) if ids else None
        first = i == keep and (i, t) not in seen
        seen.add((i, t))
        want.append((i, keep, sum(u == t for _, u in norm), first, hashlib.sha256(t.encode()).hexdigest()))
    got = exact_groups(docs, capacity=capacity, bits=bits)
    assert bag(got, *got.columns) == sorted(want, key=repr)


def test_index_buckets_hold_their_capacity(spark, docs):
    index = build_index(docs, capacity=2)
    entries = index.entries(spark)
    cells = index.directory(spark)
    # Cells without a key have no bucket; every other cell has one.
    assert cells.count() == cells.select("cell").distinct().count() <= 2**index.depth
    assert entries.groupBy("bucket").count().agg({"count": "max"}).first()[0] <= 2
    assert entries.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in TEXTS})


def test_texts_of_one_hash_make_a_chain(spark, docs):
    index = build_index(docs, bits=1)
    assert index.entries(spark).agg({"chain": "max"}).first()[0] > 2
    assert index.chains(spark).count() == index.entries(spark).where("chain_length > 1").count()
    assert build_index(docs).chains(spark).isEmpty()


def test_rows_are_found_through_the_directory(spark, docs, tmp_path):
    index = build_index(docs, capacity=2)
    assert index_lookup(docs, index).agg({"copies": "sum"}).first()[0] == len(TEXTS)
    # The same rows and entries under a directory that names each bucket for its neighbour's cell.
    cells = sorted(index.directory(spark).collect(), key=lambda r: r["cell"])
    turned = [(cells[k - 1]["bucket"], c["cell"]) for k, c in enumerate(cells)]
    wrong = HashIndex(str(tmp_path / "wrong"), index.depth)
    spark.createDataFrame(turned, "bucket bigint, cell bigint").write.parquet(f"{wrong.path}/directory")
    for part in ("rows", "entries", "chains"):
        spark.read.parquet(f"{index.path}/{part}").write.parquet(f"{wrong.path}/{part}")
    assert index_lookup(docs, wrong).count() < index_lookup(docs, index).count()


@pytest.mark.parametrize("batches", [1, 3])
def test_line_dedup(docs, batches):
    def key(line):
        k = line.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
        return k if len(k) >= 10 else None

    first = {}
    for i, t in TEXTS:
        for line in (t or "").split("\n"):
            if key(line):
                first[key(line)] = min(order(i), first.get(key(line), order(i)))
    want = []
    for i, t in TEXTS:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not key(x) or first[key(x)] == order(i)]
        kept = "\n".join(stay)
        want.append((i, len(lines), len(lines) - len(stay), kept, hashlib.sha256(kept.encode()).hexdigest()))
    got = line_dedup(docs, batches=batches)
    assert bag(got, *got.columns) == sorted(want, key=repr)


def test_fingerprint_of_short_texts():
    assert fingerprint(b"") == fingerprint(b" \t\n") == 0
    assert fingerprint(b"Ab cD") == xxhash.xxh64_intdigest(b"ab cd", 42)
    one, two = (xxhash.xxh64_intdigest(x, 42) for x in (b"a b c", b"b c d"))
    assert fingerprint(b"a  b\nc d") == one & two


def test_near_duplicates(docs):
    prints = [fingerprint((t or "").encode()) for _, t in TEXTS]
    label = [order(i) for i, _ in TEXTS]
    for _ in TEXTS:
        for a, x in enumerate(prints):
            label[a] = min(label[b] for b, y in enumerate(prints) if (x ^ y).bit_count() <= 3)
    want = [
        (i, f"{x:016x}", None if c == order(None) else c) for (i, _), x, c in zip(TEXTS, prints, label)
    ]
    got = near_duplicates(docs)
    assert bag(got, "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)


def test_components_of_a_chain_of_fingerprints(spark):
    """A chain in which neighbours differ by three bits, far from each other at its ends."""
    from codecloom.llm.simhash import close_pairs, components
    from pyspark.sql import functions as F

    values, x = [0], 0
    for k in range(0, 60, 3):
        x ^= 0b111 << k
        values.append(x - (1 << 64) if x >> 63 else x)
    nodes = spark.createDataFrame([(v, 100 - i) for i, v in enumerate(values)], "fp bigint, first bigint")
    keyed = nodes.select("fp", F.struct("first", "fp").alias("ord"))
    found = components(keyed, close_pairs(nodes.select("fp")))
    assert {r["label"]["first"] for r in found.collect()} == {100 - len(values) + 1}


def test_probes_of_stored_fingerprints_are_not_broadcast(spark):
    """The planner sizes exploded rows like the stored ones, of which there are 66 times fewer."""
    from codecloom.llm.simhash import close_pairs

    base = [k * 0x9E3779B97F4A7C15 % 2**62 for k in range(1, 200)]
    pairs = [(v, v ^ 7 << 30) for v in base]  # bits of both segments
    stored = written(spark.createDataFrame([(v,) for p in pairs for v in p], "fp bigint"), "fingerprints")
    found = close_pairs(stored)
    assert {(r.a, r.b) for r in found.collect()} == {(min(p), max(p)) for p in pairs}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_packing_is_a_partition_of_the_tokens(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = packing.pack_documents(docs, tokenizer_path(), group_docs=8, with_ids=True).toPandas()
    whole = sorted(
        np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4").tobytes()
        for _, t in TEXTS
    )
    for row in got.itertuples():
        assert zlib.crc32(row.ids) == row.ids_crc32 and len(row.ids) == 4 * row.length
    assert got["length"].sum() == sum(len(x) // 4 for x in whole)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= 2048
    # Ids that occur once: their pieces in order are the document.
    for key in (1, 4, 11, 17):
        pieces = got[got["doc_id"] == key].sort_values("start")
        assert b"".join(pieces["ids"]) in whole and pieces["doc_tokens"].nunique() == 1


@pytest.mark.parametrize("text", ["", "a b", " a  b\n c", "it's\n\n x", "x  y", "a\tb  ", "\x1cq \x85z", "a.\nB c\nd", "a.\nB c\n\nd", "x\n", "\nq r",
             "a\n\tb", "a\n b", "a \nb", "\n", "it's\n's\nx"])
def test_cut_words_have_the_ids_of_the_whole_text(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    encoder = WordIds(tokenizer_path())
    for _ in range(2):  # from the tokenizer, then from memory
        ids, _ = encoder.encode(pa.array([text]))
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_first_fit_decreasing_is_first_fit():
    sizes = np.random.default_rng(3).integers(1, 101, 300).tolist()
    bins, offsets, used = packing.first_fit_decreasing(sizes, 100)
    free, want = [], {}
    for i in sorted(range(300), key=lambda i: (-sizes[i], i)):
        b = next((b for b, room in enumerate(free) if room >= sizes[i]), len(free))
        if b == len(free):
            free.append(100)
        want[i] = (b, 100 - free[b])
        free[b] -= sizes[i]
    assert [want[i] for i in range(300)] == list(zip(bins, offsets)) and used == len(free)


def test_pfair_windows_and_deviation():
    weights = {"a": 0.61, "b": 0.2, None: 0.1, "d": 0.09, "e": 1e-9}
    parts, total = mixing.exact_weights(weights), sum(weights.values())
    done = dict.fromkeys(parts, 0)
    for source, block, slot in mixing.block_slots(parts, {s: int(1024 * w) for s, w in weights.items()}):
        assert block == done[source]
        done[source] += 1
        for s in ("a", "b", None, "d"):
            assert done[s] - weights[s] / total * (slot + 1) < 1


@pytest.mark.parametrize("name", ["one holds a third", "half among a hundred", "odd shares"])
def test_deviation_from_the_target_weights_over_many_periods(name):
    weights = {
        "one holds a third": {f"s{i}": (9.5 if i == 0 else 1.0) ** 0.5 for i in range(20)},
        "half among a hundred": {f"s{i}": 0.5 if i == 0 else 0.5 / 99 for i in range(100)},
        "odd shares": {"a": 0.1, "b": 1 / 3, None: 2**0.5, "d": 1e-4},
    }[name]
    slots, total = 20_000, sum(weights.values())
    blocks = {s: int(slots * w / total) for s, w in weights.items()}
    exact, done = mixing.exact_weights(weights), dict.fromkeys(weights, 0)
    for source, block, slot in mixing.block_slots(exact, blocks):
        # Just before and just after its slot the source is less than a block from its target.
        assert block == done[source]
        assert abs(block - weights[source] / total * slot) < 1 + 1e-9
        assert abs(block + 1 - weights[source] / total * (slot + 1)) < 1 + 1e-9
        done[source] += 1
    assert done == blocks


def test_slots_of_mixed_rows_follow_the_target_weights(spark):
    """A hot source of weight one half among a hundred, over several periods."""
    rows = [(i, "hot" if i % 2 else f"s{i // 2 % 99}") for i in range(8000)]
    weights = {"hot": 0.5} | {f"s{i}": 0.5 / 99 for i in range(99)}
    df = spark.createDataFrame(rows, "doc_id bigint, source string")
    got = mixing.mixed_order(df, weights, block_docs=1).where("source = 'hot'").collect()
    assert len(got) == 4000
    assert all(abs(r["mix_block"] + 1 - (r["mix_slot"] + 1) / 2) < 1 for r in got)


def test_mixed_order_keeps_every_row(docs):
    got = mixing.mixed_order(docs, {"s0": 3.0, "s1": 1.0}, block_docs=2, period=64)
    assert bag(got, "doc_id", "text") == sorted(((i, t) for i, t in TEXTS), key=repr)
    positions = [r[0] for r in got.select("mix_position").collect()]
    assert len(set(positions)) == len(TEXTS)
    assert got.columns == [*docs.columns, "mix_block", "mix_slot", "mix_position"]


VECTORS = [
    (0, [0.5, -0.25, 1.0]), (50, [0.1, 0.2]), (1, [0.5, -0.25, 1.0]), (2, [0.5, -0.25, 1.0]), (3, None),
    (4, [float("nan"), 0.0, 0.0]), (5, [1.0, None, 0.0]), (6, [float("inf"), 0.0, 0.0]), (7, []),
    (8, [-0.001, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (100, [2.0, 2.0, 2.0]), (9, [3.0, -3.0, 0.5]),
    (150, [1.0, -1.7e308, 0.0]),
]


@pytest.mark.parametrize("scale", [1.0, 1e7, 1e16, 1e300])
def test_exact_top_k(spark, scale):
    rows = [(i, None if v is None else [None if x is None else x * scale for x in v]) for i, v in VECTORS]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    usable = {
        i: [int(np.floor(256 * x)) for x in v]
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(256 * x) for x in v)
    }
    want = []
    for q in (k for k in usable if k % 50 == 0):
        dots = [(-min(2**63 - 1, max(-(2**63), sum(a * b for a, b in zip(usable[q], v)))), i) for i, v in usable.items() if i != q]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(dots)[:5], 1)]
    got = topk.exact_top_k(df)
    assert bag(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


def test_sorted_suffixes_with_and_without_disk():
    rng = np.random.default_rng(5)
    for trial in range(30):
        body = rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(1, 300)))
        body = np.tile(body[: max(1, len(body) // 6)], 7) if trial % 3 == 0 else body
        text = np.append(body, 0).astype(np.uint16)
        parts = list(sorted_suffixes(text, 258, 50, memory=int(rng.integers(64, 20_000))))
        got = np.concatenate(parts).tolist()
        assert sorted(got) == list(range(len(body)))
        heads = [tuple(text[i : i + 50].tolist()) for i in got]
        assert heads == sorted(heads)


@pytest.mark.parametrize("limit", [suffixes.SHARD_LIMIT, 300, 1])
@pytest.mark.parametrize("most", [0, suffixes.MOST_BROADCAST])
def test_suffix_dedup(docs, monkeypatch, limit, most):
    """Shards of any size may be cut up, whether their numbers are broadcast or not."""
    monkeypatch.setattr(suffixes, "SHARD_LIMIT", limit)
    monkeypatch.setattr(suffixes, "MOST_BROADCAST", most)
    raw = [(order(i), (t or "").encode()) for i, t in TEXTS]
    first = {}
    for o, b in raw:
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(o, first.get(b[p : p + 50], o))
    want = []
    for (i, _), (o, b) in zip(TEXTS, raw):
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < o:
                gone[p : p + 50] = b"\x01" * 50
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    got = suffix_dedup(docs)
    assert bag(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)


def test_one_passage_in_very_many_documents(spark, monkeypatch):
    """The edges of the passage are anchors with a segment a document: no group holds them all."""
    n = 100_000
    monkeypatch.setattr(suffixes, "SHARD_LIMIT", 1 << 20)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 1 << 19)
    taken = []
    monkeypatch.setattr(suffixes, "pieces", lambda hot, make=suffixes.pieces: taken.append(make(hot)) or taken[0])
    texts = [(i, hashlib.sha256(str(i).encode()).hexdigest(), hashlib.md5(str(i).encode()).hexdigest()) for i in range(n)]
    docs = spark.sql(
        f"SELECT id AS doc_id, concat(sha2(CAST(id AS STRING), 256), '{PASSAGE}', md5(CAST(id AS STRING))) AS text "
        f"FROM range({n})"
    )
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup(docs).collect()}
    seen, want = {"", }, {}
    for i, left, right in texts:
        ends = [right[:k] for k in range(1, 20)], [left[-k:] + "|" for k in range(1, 20)]
        # What earlier documents have next to the passage goes with it.
        more = sum(next(k for k, e in enumerate(end) if e not in seen) for end in ends)
        want[i] = (len(PASSAGE) + more, 1) if i else (0, 0)
        seen.update(*ends)
    assert got == want
    sizes = suffixes.merged_pieces(taken[0]).groupBy("shard", "part").agg(F.sum(F.octet_length("segment")).alias("held"))
    largest, total = sizes.agg(F.max("held"), F.sum("held")).first()
    assert total > 10 << 20 and largest < 2 << 20


def test_languages(spark):
    en = "the house and the garden are where they have been for years "
    de = "das haus und der garten sind dort wo sie seit jahren waren "
    rows = [(i, (en if i % 2 else de) * 3, "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "123 !!!", "en"), (103, en * 5 + de * 5, None), (None, de, None)]
    rows += [(104, en * 20_000, None)]
    got = {r["doc_id"]: r for r in identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(60))
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(60))
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (100, 101, 102))
    assert "en:" in got[103]["languages"] and "de:" in got[103]["languages"]
    assert got[None]["lang_pred"] == "de" and got[104]["lang_pred"] == "en"


def test_toxicity(spark):
    rows = [(i, f"some plain words number {i} " + ("you awful grumble" if i % 3 == 0 else "and a kind greeting")) for i in range(300)]
    rows += [(1000, None), (1001, ""), (None, "an awful grumble")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame(
        [(i, int(i % 3 == 0)) for i in range(300)] + [(7, None), (None, 1), (5000, 1)], "doc_id bigint, toxic int"
    )
    got = toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 300:
            assert r["predicted"] == int(r["doc_id"] % 3 == 0)
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    none = toxicity(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0}


def test_threads(spark):
    rows = [
        (1, 0, "user", "First question line\nSecond question line"),
        (1, 1, "assistant", "An unrelated remark"),
        (1, 2, "user", "> first  QUESTION line\n>second question line\nMy answer"),
        (1, 3, None, "> My answer\n> > First question line\nThanks"),
        (1, 4, "user", ">> First question line\n> never said\nLate"),
        (1, 5, "user", "> Thanks\nbye"),
        (2, 0, "user", "> My answer\nno link across conversations"),
        (2, 1, "user", None),
        (2, None, "user", "> no link across conversations\nno turn"),
        (None, 3, "user", "no conversation"),
        (2, 1, "user", "a repeated turn"),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    got = threaded_conversations(df)
    seen = {(r["conv_id"], r["turn"], r["body"]): r for r in got.collect()}
    assert len(seen) == len(rows)

    def facts(*key):
        return tuple(seen[key][c] for c in ("reply_to", "thread_root", "depth", "n_quoted", "n_linked"))

    assert facts(1, 0, rows[0][3]) == (None, 0, 0, 0, 0)
    assert facts(1, 1, "An unrelated remark") == (None, 1, 0, 0, 0)
    # Both lines and the passage they make.
    assert facts(1, 2, "My answer") == (0, 0, 1, 2, 3)
    assert facts(1, 3, "Thanks") == (2, 0, 2, 2, 2)
    assert facts(1, 4, "Late") == (0, 0, 1, 2, 1)
    assert facts(1, 5, "bye") == (3, 0, 3, 1, 1)
    assert facts(2, 0, "no link across conversations") == (None, 0, 0, 1, 0)
    assert facts(2, None, "no turn") == (None, None, 0, 1, 0)
    assert seen[(1, 3, "Thanks")]["chat"] == "<|unknown|>\nThanks"
    in_one = [r["turn"] for r in got.where("conv_id = 1").collect()]
    assert in_one == [0, 2, 3, 4, 5, 1]


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e9])
def test_top_k_of_clusters_skips_blocks(spark, scale, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 12)) * 10
    x = np.round((centres[rng.integers(0, 8, 3000)] + rng.normal(size=(3000, 12)) * 0.1) * scale, 3)
    x[::7] = x[0]
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)] + [(50, [1e3] * 12), (50, x[50].tolist())]
    sent = []
    monkeypatch.setattr(topk, "written", lambda df, name: (sent.append((name, w := written(df, name))), w)[1])
    got = topk.exact_top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    kept = {}
    for i, v in rows:
        q = np.floor(256 * np.array(v))
        if i not in kept or q.tobytes() < kept[i].tobytes():
            kept[i] = q
    whole = {i: [int(c) for c in v] for i, v in kept.items()}
    want = []
    for q in range(0, 3000, 50):
        dots = [(-min(2**63 - 1, sum(a * b for a, b in zip(whole[q], v))), i) for i, v in whole.items() if i != q]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(dots)[:5], 1)]
    assert bag(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    asked = dict(sent)["topk-queries"]
    if scale < 1e9:  # beyond, most scores stop at the largest long, and no bound is below that
        blocks = asked.select("cb").distinct().count()
        assert asked.groupBy("id").count().agg({"count": "avg"}).first()[0] < blocks / 2


def slow_ftrl(found, labels, s):
    """Weights by coordinate, a dictionary and a loop for each step."""
    z, n = {}, {}

    def weight(i):
        if i != "bias" and abs(z.get(i, 0.0)) <= s.l1:
            return 0.0
        shrink, l2 = (0.0, 0.0) if i == "bias" else (s.l1, s.l2)
        rate = (s.beta + math.sqrt(n.get(i, 0.0))) / s.alpha + l2
        return -(z.get(i, 0.0) - math.copysign(shrink, z.get(i, 0.0))) / rate

    for _ in range(s.epochs):
        for at, label in zip(found, labels):
            w = {i: weight(i) for i in [*at, "bias"]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in w:
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / s.alpha * w[i]
                n[i] = old + g * g
    return {i: weight(i) for i in z if weight(i) != 0}


@pytest.mark.parametrize("settings", [Settings(l1=0.2), Settings(alpha=0.3, beta=2.0, l1=1.0, l2=0.5, epochs=5)])
def test_ftrl_equals_a_slow_one(settings):
    words = "calm kind awful grumble river stone paper".split()
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(words, rng.integers(0, 9))).encode() for _ in range(80)]
    labels = [int(b"awful" in t) for t in texts]
    at, w = train_shard(texts, labels, settings)
    want = slow_ftrl([sorted(set(features(t).tolist())) for t in texts], labels, settings)
    want = {1 << 18 if i == "bias" else i: x for i, x in want.items()}
    assert sorted(at.tolist()) == sorted(want)
    assert np.allclose(w, [want[i] for i in at.tolist()], rtol=1e-9, atol=1e-12)


def test_held_out_labels_take_no_part_in_the_choice_of_settings(spark):
    texts = [(i, f"word{i % 7} " + ("you awful grumble" if i % 3 == 0 else "a kind greeting")) for i in range(200)]
    docs = spark.createDataFrame([*texts, (None, None), (500, None), (501, "")], "doc_id bigint, text string")
    grid = (Settings(l1=0.5), Settings(l1=50.0))

    def losses(flip):
        marks = [(i, int(i % 3 == 0) ^ (flip and zlib.crc32(str(i).encode()) % 4 == 2)) for i, _ in texts]
        labels = spark.createDataFrame([*marks, (500, 0), (501, 0), (7, None)], "doc_id bigint, toxic int")
        return bag(setting_losses(docs, labels, grid=grid, epochs=2), "setting", "epochs", "n", "loss")

    plain = losses(False)
    assert plain == losses(True) and len(plain) == 4
    assert plain[1][3] < plain[3][3]  # weights that are all shrunk away learn nothing
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert setting_losses(docs, none, grid=grid).count() == 0


def test_very_long_texts_have_scores(spark):
    rows = [(i, ("you awful grumble " if i % 3 == 0 else "a kind greeting ") * 4) for i in range(120)]
    rows += [(200, "you awful grumble " * 100_000), (201, "x" * 2_000_000), (202, "a kind greeting " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity(docs, labels, settings=Settings(l1=1.0)).collect()}
    assert got[200] == 1 and got[202] == 0 and len(got) == len(rows)


QUOTES = [
    (1, 0, "Thanks"),
    (1, 1, "The harbour was built of granite. Its walls were raised again after the flood.\nThanks"),
    (1, 2, "Thanks\n\nSomething else"),
    # Wrapped anew, so that no quoted line is a line of the original.
    (1, 3, "> The harbour was built of\n> granite. Its walls were raised\n>  again after the flood.\n> Thanks\nWhen?"),
    # One sentence of it, wrapped.
    (1, 4, "> Its walls were\n> raised again after the flood.\nWhich flood?"),
    # A passage of several levels; the outermost level links first.
    (1, 5, "> Which flood?\n> > Its walls were raised again after the flood.\n> Which flood?\nThe one of 1953."),
    # A shared line alone goes to the latest that has it.
    (1, 6, "> Thanks\nWelcome"),
    (1, 7, "> A b.\n> C d.\nnothing of it was said"),
    (2, 0, "A b. C d."), (2, 1, "A b."), (2, 2, "C d."),
    (2, 3, "> A b. C d.\nthe whole passage was said in turn 0"),
    (2, 3000, "> A b.\nblocks of turns later"),
    (2, 5000, "A b."), (2, 5000, "A b."),
    (2, 5001, ">a B.\nsame block"),
    (2, 5000, "> A b.\na message does not quote itself"),
    (3, 0, ""), (3, 1, "> \n>\n> -\n>> 1\n"), (3, -5, "-\n1"),
]


def test_quoted_passages(spark, tmp_path):
    rows = [(c, t, "user", x) for c, t, x in QUOTES]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    got = threaded_conversations(df)
    reply = {(r["conv_id"], r["turn"]): r["reply_to"] for r in got.collect()}
    assert [reply[1, t] for t in range(8)] == [None, None, None, 1, 1, 4, 2, None]
    assert [reply[2, t] for t in (3, 3000, 5000, 5001)] == [0, 1, 1, 5000]
    assert reply[3, 1] == -5
    # The same rows by SQL.
    df.coalesce(1).write.parquet(str(tmp_path / "talks"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/talks/*.parquet')")
    want = con.execute(ORACLE["op1_quote_links"])
    names = [d[0] for d in want.description]
    assert bag(got, *names) == sorted(want.fetchall(), key=repr)


def test_a_line_that_a_long_conversation_repeats(spark):
    rows = [(1, t, "user", "> Same line.\nSame line." if t else "Same line.") for t in range(5000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    got = threaded_conversations(df)
    assert got.where("turn > 0 and (reply_to <> turn - 1 or thread_root <> 0 or depth <> turn)").isEmpty()
    assert got.count() == len(rows)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    talks = spark.createDataFrame([], "conv_id bigint, turn int, role string, text string")
    results = [
        exact_groups(docs), line_dedup(docs), near_duplicates(docs), suffix_dedup(docs), identify(docs),
        mixing.mixed_order(docs), packing.pack_documents(docs, tokenizer_path()), toxicity(docs, labels),
        topk.exact_top_k(vectors), threaded_conversations(talks),
    ]
    assert [r.count() for r in results] == [0] * len(results)
