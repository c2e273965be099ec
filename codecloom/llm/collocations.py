"""Phrase collocations by Rabin-Karp fingerprints of every n-gram.

A slice of whole texts is one array of bytes. Prefix sums of a polynomial over the bytes give the hash
of every word, prefix sums of a polynomial over the words that of every n-gram of every length. Length
by length, tasks count fingerprints and Spark adds them up. An n-gram can be frequent only if both
n-grams one word shorter are, so a filter of the frequent fingerprints (a Bloom filter of bounded size:
it may let too much through, never too little) spares the shuffle most n-grams of the next length.

Fingerprints only preselect. In a last pass over the texts, the occurrences of frequent fingerprints
are compared, word by word, with the occurrence that stands for them, and those that differ are counted
apart. Counts are added up by the words themselves, each with a pointer to an occurrence: a collision
cannot change a count. Only these phrases are ever written out as text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codecloom.llm.common import id_order, slices, whole_text, written

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
SLICE_BYTES = 3 << 20
# Filters take 16 bits a fingerprint, within these limits.
LEAST_BITS, MOST_BITS = 1 << 13, 1 << 27
UNKNOWN = "und"

_MASK = (1 << 64) - 1
# Odd multipliers of the two polynomials.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_SPACE, _BREAK = 32, 10


def _byte_classes() -> np.ndarray:
    """What becomes of each byte: lower case, a space between words, a break between pieces."""
    out = np.arange(256, dtype=np.uint8)
    out[ord("A") : ord("Z") + 1] += 32
    out[9] = _SPACE
    out[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = _BREAK
    return out


_CLASSES = _byte_classes()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of a common generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BYTE_BASE))


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as have been asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, factor in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, factor, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS = Powers(BYTE_BASE), Powers(WORD_BASE)


def prefix_sums(values: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Sums of values times powers, modulo 2^64, before each place: one entry more than values."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up, out=out[1:])
    return out


class Words:
    """The words of several documents: where they lie, what they hash to, which may form a phrase."""

    def __init__(self, texts: list[bytes], docs: np.ndarray, langs: np.ndarray, fingerprint_bits: int = 64):
        """`docs` and `langs` give a number for the document and the language of each text."""
        raw = _CLASSES[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
        blank = (raw == _SPACE) | (raw == _BREAK)
        edge = np.flatnonzero(np.diff(blank, prepend=True))
        # Every text ends in a break, so words begin and end in turn.
        self.raw, self.start, self.end = raw, edge[0::2], edge[1::2]
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        first = np.cumsum(size) - size
        self.text = np.searchsorted(first, self.start, side="right") - 1
        self.piece = np.searchsorted(np.flatnonzero(raw == _BREAK), self.start)
        self.n = len(self.start)
        self.docs, self.langs = docs, langs
        self.lang = langs[self.text]
        up, down = _BYTE_POWERS.get(len(raw) + 1)
        sums = prefix_sums(_BYTE_VALUES[raw], up[:-1])
        self.hash = mixed((sums[self.end] - sums[self.start]) * down[self.start])
        self.sums = prefix_sums(self.hash, _WORD_POWERS.get(max(1, self.n))[0][: self.n])
        self.keep = np.uint64(_MASK >> (64 - fingerprint_bits))

    def numbers(self) -> np.ndarray:
        """Each word's number in its text."""
        first = np.searchsorted(self.text, np.arange(len(self.docs)))
        return np.arange(self.n) - first[self.text]

    def fingerprints(self, n: int, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprints of the n-grams at each word, which of them lie within a piece).

        The salt of its language is part of a fingerprint.
        """
        count = max(0, self.n - n + 1)
        down = _WORD_POWERS.get(max(1, self.n))[1][:count]
        window = (self.sums[n : n + count] - self.sums[:count]) * down
        found = mixed(window + salts[self.lang[:count]] + np.uint64(n)) & self.keep
        return found, self.piece[:count] == self.piece[n - 1 : n - 1 + count]

    def word_numbers(self) -> tuple[np.ndarray, pa.StringArray]:
        """(a number for each word, the different words); equal hashes are compared by their bytes."""
        _, first, group = np.unique(self.hash, return_index=True, return_inverse=True)
        size = self.end - self.start
        other = size != size[first[group]]
        same = np.flatnonzero(~other)
        mine, theirs = self._bytes(same), self._bytes(first[group[same]])
        other[np.repeat(same, size[same])[mine != theirs]] = True
        if other.any():
            numbers: dict[tuple[int, bytes], int] = {}
            more = []
            for i in np.flatnonzero(other).tolist():
                key = (int(group[i]), self.raw[self.start[i] : self.end[i]].tobytes())
                if key not in numbers:
                    numbers[key] = len(first) + len(more)
                    more.append(i)
                group[i] = numbers[key]
            first = np.concatenate([first, more])
        offsets = np.zeros(len(first) + 1, dtype=np.int32)
        np.cumsum(size[first], out=offsets[1:])
        text = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(self._bytes(first)))
        return group, text

    def _bytes(self, words: np.ndarray) -> np.ndarray:
        """The bytes of some words, one after another."""
        size = (self.end - self.start)[words]
        at = np.arange(int(size.sum()))
        return self.raw[at + np.repeat(self.start[words] - np.cumsum(size) + size, size)]


def passes(table: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which fingerprints have both their bits set in a filter; its size is a power of two."""
    mask = np.uint64(len(table) * 64 - 1)
    out = np.ones(len(found), dtype=bool)
    for place in (found & mask, (found >> np.uint64(32)) & mask):
        out &= (table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return out


def _filter(frequent: DataFrame) -> np.ndarray:
    """The filter of a table of fingerprints `fp`: at most 2^27 bits, set in the tasks."""
    rows = frequent.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * rows).bit_length()))
    places = F.array(F.col("fp"), F.shiftrightunsigned("fp", 32))
    words = (
        frequent.select(F.explode(places).alias("p"))
        .select(F.col("p").bitwiseAND(F.lit(bits - 1)).alias("p"))
        .groupBy(F.shiftright("p", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS INT))")).alias("bits"))
        .toArrow()
    )
    table = np.zeros(bits // 64, dtype=np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return table


def _parts(text: bytes, size: int, longest: int) -> Iterator[tuple[bytes, int]]:
    """Pieces of a text of about `size` bytes, with `longest` - 1 words of the next one; (bytes, own bytes)."""
    start, n = 0, len(text)
    blank = np.flatnonzero(np.isin(_CLASSES[np.frombuffer(text, dtype=np.uint8)], (_SPACE, _BREAK)))
    while start < n:
        k = np.searchsorted(blank, start + size)
        end = int(blank[k]) if k < len(blank) else n
        more, words = k, 0
        while more < len(blank) and words < longest:
            words += more + 1 >= len(blank) or blank[more + 1] != blank[more] + 1
            more += 1
        yield text[start : int(blank[more]) if more < len(blank) else n], end - start
        start = end


def _slices(
    batches: Iterator[pa.RecordBatch], size: int, longest: int, bits: int
) -> Iterator[tuple[Words, list[str], np.ndarray, np.ndarray]]:
    """(words, names of the languages, salts, which words begin an n-gram of this slice).

    Texts beyond `size` bytes are cut between words; a part knows the words behind it, and an n-gram
    belongs to the part in which it begins.
    """
    for batch in slices(batches, text=2, rows=1 << 16, size=size):
        texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(2).cast(pa.binary())]
        docs = batch.column(0).to_numpy()
        coded = batch.column(1).dictionary_encode()
        names, langs = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        salts = np.array([_salt(name) for name in names], dtype=np.uint64)
        if len(texts) == 1 and len(texts[0]) > size:
            seen = 0
            for part, own in _parts(texts[0], size, longest):
                words = Words([part], docs, langs, bits)
                mine = words.start < own
                yield words, names, salts, np.where(mine, seen, -1)
                seen += int(mine.sum())
        elif texts:
            words = Words(texts, docs, langs, bits)
            yield words, names, salts, np.zeros(words.n, dtype=np.int64)


def _salt(name: str) -> int:
    value = 0
    for byte in name.encode():
        value = (value * BYTE_BASE + byte + 1) & _MASK
    return int(mixed(np.array([value], dtype=np.uint64))[0])


def _fingerprint_counts(
    docs: DataFrame, n: int, shorter: np.ndarray | None, min_count: int, size: int, longest: int, bits: int
) -> DataFrame:
    """(fp, a) of the n-gram fingerprints that occur often."""
    shared = None if shorter is None else docs.sparkSession.sparkContext.broadcast(shorter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, _, salts, own in _slices(batches, size, longest, bits):
            found, whole = words.fingerprints(n, salts)
            kept = whole & (own[: len(found)] >= 0)
            if shared is not None:
                less, _ = words.fingerprints(n - 1, salts)
                known = passes(shared.value, less)
                kept &= known[:-1][: len(found)] & known[1:]
            at = np.flatnonzero(kept)
            different, count = np.unique(found[at], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(different.view(np.int64)), pa.array(count.astype(np.int64))], ["fp", "n"]
            )

    rows = docs.mapInArrow(run, "fp bigint, n bigint")
    return rows.groupBy("fp").agg(F.sum("n").alias("a")).where(F.col("a") >= F.lit(min_count))


def _phrase_counts(
    docs: DataFrame, filters: list[np.ndarray], min_count: int, size: int, bits: int
) -> DataFrame:
    """The table of `phrase_counts`."""
    longest = len(filters)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def rows_of(lang: pa.Array, n: int, phrase: pa.Array, count, doc, word) -> pa.RecordBatch:
        columns = [lang, pa.array(np.full(len(lang), n, dtype=np.int32)), phrase, *map(pa.array, (count, doc, word))]
        return pa.RecordBatch.from_arrays(columns, ["lang", "n_words", "phrase", "n", "doc", "word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, names, salts, own in _slices(batches, size, longest, bits):
            if not words.n:
                continue
            numbers, texts = words.word_numbers()
            places = words.numbers() + own
            langs = pa.array(names, pa.string())
            total = np.bincount(words.lang[own >= 0], minlength=len(names)).astype(np.int64)
            none = np.zeros(len(names), dtype=np.int64)
            yield rows_of(langs, 0, pa.array([""] * len(names)), total, none, none)
            for n in range(1, longest + 1):
                found, whole = words.fingerprints(n, salts)
                at = np.flatnonzero(whole & (own[: len(found)] >= 0))
                at = at[passes(shared.value[n - 1], found[at])]
                _, first, group, count = np.unique(
                    found[at], return_index=True, return_inverse=True, return_counts=True
                )
                stands = at[first]
                other = words.lang[at] != words.lang[stands[group]]
                for k in range(n):
                    other |= numbers[at + k] != numbers[stands[group] + k]
                count = count - np.bincount(group[other], minlength=len(first))
                apart: dict[tuple[int, ...], list[int]] = {}
                for i in at[other].tolist():
                    key = (int(words.lang[i]), *numbers[i : i + n].tolist())
                    apart.setdefault(key, [i, 0])[1] += 1
                place = np.concatenate([stands, [i for i, _ in apart.values()]]).astype(np.int64)
                count = np.concatenate([count, [c for _, c in apart.values()]]).astype(np.int64)
                parts = [texts.take(pa.array(numbers[place + k])) for k in range(n)]
                phrase = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")
                lang = langs.take(pa.array(words.lang[place]))
                yield rows_of(lang, n, phrase, count, words.docs[words.text[place]], places[place])

    rows = docs.mapInArrow(
        run, "lang string, n_words int, phrase string, n bigint, doc bigint, word bigint"
    )
    counted = rows.groupBy("lang", "n_words", "phrase").agg(
        F.sum("n").alias("a"), F.min("doc").alias("first_doc"), F.min_by("word", "doc").alias("first_word")
    )
    return counted.where((F.col("a") >= F.lit(min_count)) | ((F.col("n_words") == 0) & (F.col("a") > 0)))


def phrase_counts(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    longest: int = LONGEST,
    min_count: int = MIN_COUNT,
    slice_bytes: int = SLICE_BYTES,
    fingerprint_bits: int = 64,
) -> DataFrame:
    """(lang, n_words, phrase, a, first_doc, first_word) of every phrase of up to `longest` words that occurs
    often enough, with the place of an occurrence: the smallest id and the number of its first word there.

    Rows with n_words 0 count all words of a language; their place means nothing. The table is written once.
    """
    given = docs.select(
        id_order(id_col).alias("doc"),
        F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"),
        whole_text(text_col).alias("text"),
    )
    filters: list[np.ndarray] = []
    for n in range(1, longest + 1):
        shorter = filters[-1] if filters else None
        counts = _fingerprint_counts(given, n, shorter, min_count, slice_bytes, longest, fingerprint_bits)
        filters.append(_filter(written(counts, f"fingerprints-{n}")))
    return written(_phrase_counts(given, filters, min_count, slice_bytes, fingerprint_bits), "phrases")


def _scored(phrases: DataFrame) -> DataFrame:
    """Candidates with their lowest-scoring cut: with the place of an occurrence."""
    whole = "decimal(38,0)"
    frequent = phrases.where(F.col("n_words") > 0)
    totals = phrases.where(F.col("n_words") == 0).select("lang", F.col("a").alias("n"))
    words = F.split("phrase", " ")
    cuts = (
        frequent.where(F.col("n_words") > 1)
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.lit(1))))
        .withColumn("left", F.array_join(F.slice(words, F.lit(1), F.col("k")), " "))
        .withColumn("right", F.array_join(F.slice(words, F.col("k") + F.lit(1), F.col("n_words")), " "))
    )
    # Parts of a frequent phrase are frequent, so both joins find their row.
    left = frequent.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    right = frequent.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r"))
    joined = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(totals, "lang")
    exact = joined.withColumn(
        "score",
        F.expr(f"(cast(1000 AS {whole}) * cast(a AS {whole}) * n) div (cast(l AS {whole}) * cast(r AS {whole}))"),
    )
    lowest = F.min(F.struct("score", "k", "l", "r"))
    return (
        exact.groupBy("lang", "phrase", "n_words", "a", "n", "first_doc", "first_word")
        .agg(lowest.alias("cut"))
        .select("lang", "phrase", "n_words", "a", "cut.l", "cut.r", "n", "cut.score", "first_doc", "first_word")
    )


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    longest: int = LONGEST,
    min_count: int = MIN_COUNT,
    top: int = TOP,
    slice_bytes: int = SLICE_BYTES,
    fingerprint_bits: int = 64,
) -> DataFrame:
    """The `top` phrases of two to `longest` words of each language, by falling score.

    Texts are taken whole, with A-Z lower-cased, cut into pieces at .,;:!? and line ends and into words
    at spaces and tabs; phrases do not cross pieces. A phrase that occurs at least `min_count` times (a)
    scores floor(1000 a n / (l r)) at its lowest cut into parts that occur l and r times among n words.
    Phrases inside a longer one that occurs as often are left out. Returns lang, rank, phrase, a, l, r, n,
    score, first_doc and first_word: the smallest id of a document that holds the phrase (NULL ids count as
    the largest long) and the number of the phrase's first word in it. NULL languages are `und`, NULL texts empty; rows that repeat an id or a text count each
    time; an empty table gives no rows; other columns are ignored. Products are exact up to 38 digits.
    """
    phrases = phrase_counts(
        docs, text_col, lang_col, id_col, longest, min_count, slice_bytes, fingerprint_bits
    )
    words = F.split("phrase", " ")
    # A phrase inside a longer one that is as frequent lies inside one of the phrases one word longer that is.
    longer = (
        phrases.where(F.col("n_words") > 2)
        .select(
            "lang",
            "a",
            F.explode(
                F.array(
                    F.array_join(F.slice(words, F.lit(1), F.col("n_words") - F.lit(1)), " "),
                    F.array_join(F.slice(words, F.lit(2), F.col("n_words") - F.lit(1)), " "),
                )
            ).alias("phrase"),
        )
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )
    own = _scored(phrases).join(longer, ["lang", "phrase"], "left")
    kept = own.where(F.coalesce(F.col("longer") < F.col("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.lit(top))
    return ranked.select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score", "first_doc", "first_word"
    )
