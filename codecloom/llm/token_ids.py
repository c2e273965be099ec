"""Token ids of whole texts by a `tokenizers` file, with the ids of space-led words remembered.

In a byte-level vocabulary a space in front of a character that is not white space always begins a
new piece. A text whose spaces are all of that kind is cut in front of them; the different words of a
slice are looked up, and the ids of the slice are gathered by numpy. Unknown words are cut further by
the vocabulary's own rule for pieces, and only unknown pieces go through its merges. That rule is
applied here to characters whose classes never changed between Unicode versions; words with others,
texts with other spaces or with the string of an added token, and all texts of other kinds of
vocabularies are tokenised whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
import unicodedata
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A remembered piece takes about this many bytes besides its characters and ids.
ENTRY_BYTES = 150
CACHE_BYTES = 48 << 20
# Texts tokenised together: more of them share more words.
SLICE_ROWS, SLICE_BYTES = 8192, 8 << 20
# A space before white space or at the end of a text does not begin a word.
LOOSE_SPACE = r" (?:[\s\v\x1c-\x1f\x{85}\p{Z}]|\z)"
# Characters up to the Latin extensions, without controls and spaces other than these.
PLAIN = "\t\n\r\x20-\x7e¡-¬®-ɏ"


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


# Fixed value: the rule by which byte-level vocabularies of this family cut texts into pieces.
_PIECE = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^\\s{L}{N}]+|\\s+(?!\\S)|\\s+".format(
        L=_class("L"), N=_class("N")
    )
)
_NOT_PLAIN = re.compile(f"[^{PLAIN}]")

# Functions reach the workers by value, globals included; a module in `sys.modules` outlives a task.
_KEPT = "_codecloom_encoders"


def encoder(path: str) -> "WordIds":
    """The encoder of a tokenizer file, kept for the life of a Python worker."""
    kept = sys.modules.setdefault(_KEPT, types.ModuleType(_KEPT)).__dict__
    if path not in kept:
        kept[path] = WordIds(path)
    return kept[path]


def vocabulary_size(path: str) -> int:
    """One more than the largest id of a tokenizer file, added tokens included."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1


def byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary writes each byte.

    Printable bytes stand for themselves, the others for the letters from 256 on, in order.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)]


def gathered(store: np.ndarray, size: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(runs of `store` one after another in the order of `codes`, offsets of each run).

    Run k of the store has `size[k]` elements.
    """
    begin = np.cumsum(size) - size
    count = size[codes]
    offsets = np.zeros(len(codes) + 1, dtype=np.int64)
    np.cumsum(count, out=offsets[1:])
    # Half the memory where places fit 32 bits.
    kind = np.int32 if max(len(store), int(offsets[-1])) < 1 << 31 else np.int64
    place = np.repeat((begin[codes] - offsets[:-1]).astype(kind), count)
    place += np.arange(len(place), dtype=kind)
    return store[place], offsets


def stored(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids given as bytes, one after another, and how many each has."""
    size = np.fromiter(map(len, entries), dtype=np.int64, count=len(entries)) // 4
    return np.frombuffer(b"".join(entries), dtype="<u4"), size


class WordIds:
    """Ids of texts, as by `Tokenizer.encode(text, add_special_tokens=False)`."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        rule = parts.get("pre_tokenizer") or {}
        self.cuts = (
            parts.get("normalizer") is None
            and rule.get("type") == "ByteLevel"
            and rule.get("use_regex", True)
            and not rule.get("add_prefix_space")
            and parts["model"].get("type") == "BPE"
        )
        self.markers = [t["content"] for t in parts.get("added_tokens", []) if t["content"]]
        self.letters = dict(enumerate(byte_letters()))
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.held, self.cache_bytes = 0, cache_bytes

    def _whole(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _shrink(self) -> None:
        """Forget the older half of the pieces."""
        self.known = dict(islice(self.known.items(), len(self.known) // 2, None))
        self.held = sum(ENTRY_BYTES + len(k) + len(ids) for k, ids in self.known.items())

    def _learn(self, pieces: list[str]) -> None:
        """Remember the ids of pieces."""
        # The byte 0 is in no plain piece.
        letters = "\0".join(pieces).encode().decode("latin-1").translate(self.letters)
        merge = self.model.tokenize
        found = [[token.id for token in merge(word)] for word in letters.split(self.letters[0])]
        raw = np.fromiter(chain.from_iterable(found), dtype="<u4").tobytes()
        end = 0
        for piece, ids in zip(pieces, found):
            start, end = end, end + 4 * len(ids)
            self.known[piece] = raw[start:end]
            self.held += ENTRY_BYTES + len(piece) + end - start

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of pieces one after another, offsets of each piece's ids)."""
        if not pieces:
            return np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        different = coded.dictionary.to_pylist()
        missing = [piece for piece in different if piece not in self.known]
        if missing:
            self._learn(missing)
        return gathered(*stored([self.known[piece] for piece in different]), coded.indices.to_numpy())

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each has) of words with a space in front; an empty word has none.

        Joined words are cut into pieces at once: a piece that begins with a space begins a word.
        """
        rough = []
        if _NOT_PLAIN.search("".join(words)):
            rough = [i for i, word in enumerate(words) if _NOT_PLAIN.search(word)]
        odd = self._whole([" " + words[i] for i in rough])
        skipped = {*rough, *(i for i, word in enumerate(words) if not word)}
        smooth = [word for i, word in enumerate(words) if i not in skipped] if skipped else words
        size = np.zeros(len(words), dtype=np.int64)
        store = np.zeros(0, dtype="<u4")
        mask = np.ones(len(words), dtype=bool)
        mask[list(skipped)] = False
        if smooth:
            pieces = _PIECE.findall(" " + " ".join(smooth))
            store, offsets = self._ids(pieces)
            leads = pc.starts_with(pa.array(pieces, pa.large_string()), " ").to_numpy(zero_copy_only=False)
            size[mask] = np.diff(np.append(offsets[np.flatnonzero(leads)], offsets[-1]))
        if rough:
            more, size[rough] = stored(odd)
            order = np.concatenate([np.flatnonzero(mask), rough])
            place = np.zeros(len(words), dtype=np.int64)
            place[order] = np.arange(len(order))
            used = np.sort(order)
            store, _ = gathered(np.concatenate([store, more]), size[order], place[used])
        return store, size

    def _firsts(self, texts: list[str], whole: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each has) of the first parts of texts and of texts to be taken whole."""
        rough = [w or bool(_NOT_PLAIN.search(text)) for text, w in zip(texts, whole)]
        odd = iter(self._whole([text for text, r in zip(texts, rough) if r]))
        found = [[] if r else _PIECE.findall(text) for text, r in zip(texts, rough)]
        ids, offsets = self._ids(list(chain.from_iterable(found)))
        ends = offsets[np.cumsum([0, *map(len, found)])].tolist()
        return stored([next(odd) if r else ids[a:b].tobytes() for r, a, b in zip(rough, ends, ends[1:])])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of each text's ids): one entry more than texts."""
        n = len(texts)
        if not n:
            return np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)
        if self.held > self.cache_bytes:
            self._shrink()
        texts = texts.cast(pa.large_string())
        if self.cuts:
            loose = pc.match_substring_regex(texts, LOOSE_SPACE)
            for marker in self.markers:
                loose = pc.or_(loose, pc.match_substring(texts, marker))
        else:
            loose = pa.array(np.ones(n, dtype=bool))
        split = pc.split_pattern(pc.if_else(loose, pa.scalar("", pa.large_string()), texts), " ")
        begins = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()
        flat = split.flatten()
        # The first part of a text has no space in front: it is an entry of its own, as is a whole text.
        first = pc.if_else(loose, texts, flat.take(pa.array(begins))).to_pylist()
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        codes[begins] = len(coded.dictionary) + np.arange(n)
        used = np.zeros(len(coded.dictionary) + n, dtype=bool)
        used[codes] = True
        words = [word if u else "" for word, u in zip(coded.dictionary.to_pylist(), used.tolist())]
        ids, size = self._words(words)
        more, more_size = self._firsts(first, loose.to_pylist())
        out, offsets = gathered(np.concatenate([ids, more]), np.concatenate([size, more_size]), codes)
        return out, offsets[np.concatenate([begins, [len(codes)]])]
