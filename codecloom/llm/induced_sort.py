"""Induced sorting of the suffixes of one shard with disk-backed queues.

The order of the leftmost S-type suffixes is found first, by inducing from them in text order, naming
their substrings and ranking the shorter string of names; all other suffixes are then induced, L-type
ones upwards and S-type ones downwards. What waits for its turn stands in a priority queue keyed by
the first symbol. Tuples reach a key in their final order, so a key's part of the queue is a spool of
arrays, and the part of the spools above the memory budget lies in an unnamed scratch file of the
task. A whole key is induced at a time, in rounds for runs of the same symbol.

The order is exact in the first `depth` symbols; suffixes equal that far are in any order.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

MEMORY = 96 << 20


class Spools:
    """Arrays of positions appended to keys and read back in order; above the budget on disk."""

    def __init__(self, keys: int, memory: int = MEMORY):
        self.parts: list[list] = [[] for _ in range(keys)]
        self.memory, self.held, self.file = memory, 0, None

    def append(self, key: int, values: np.ndarray) -> None:
        if self.held + values.nbytes <= self.memory:
            self.parts[key].append(values)
            self.held += values.nbytes
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        self.file.write(values.tobytes())
        self.parts[key].append((at, len(values), values.dtype))

    def _load(self, part) -> np.ndarray:
        if isinstance(part, np.ndarray):
            return part
        at, count, dtype = part
        self.file.seek(at)
        return np.frombuffer(self.file.read(count * dtype.itemsize), dtype=dtype)

    def read(self, key: int, backwards: bool = False) -> Iterator[np.ndarray]:
        parts = self.parts[key]
        for part in reversed(parts) if backwards else parts:
            values = self._load(part)
            yield values[::-1] if backwards else values

    def take(self, key: int) -> Iterator[np.ndarray]:
        """Read a key for the last time."""
        parts, self.parts[key] = self.parts[key], []
        for part in parts:
            values = self._load(part)
            if isinstance(part, np.ndarray):
                self.held -= part.nbytes
            yield values

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def s_types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last symbol must be the smallest."""
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:])
    following = differs[np.minimum(np.searchsorted(differs, np.arange(n)), len(differs) - 1)]
    types = text[following] < text[np.minimum(following + 1, n - 1)]
    types[-1] = True
    return types


def induce(text: np.ndarray, types: np.ndarray, seeds: np.ndarray, symbols: int, memory: int):
    """(L, S) spools by first symbol from leftmost S-type positions in order; S is read backwards."""
    ahead, lower = Spools(symbols, memory // 4), Spools(symbols, memory // 4)
    bounds = np.searchsorted(text[seeds], np.arange(symbols + 1))

    def push(queue: Spools, found: np.ndarray, s_type: bool, same: int) -> list[np.ndarray]:
        """Queue the predecessors of the wanted type; those that start with `same` are returned."""
        before = found[found > 0] - 1
        before = before[types[before] == s_type]
        if not len(before):
            return []
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        keys, starts = np.unique(first, return_index=True)
        again = []
        for key, a, b in zip(keys.tolist(), starts.tolist(), [*starts[1:].tolist(), len(before)]):
            if key == same:
                again.append(before[a:b])
            else:
                queue.append(key, before[a:b])
        return again

    for key in range(symbols):
        pending = list(ahead.take(key))
        while pending:
            found = np.concatenate(pending)
            lower.append(key, found)
            pending = push(ahead, found, False, key)
        push(ahead, seeds[bounds[key] : bounds[key + 1]], False, -1)
    ahead.close()
    queue, upper = Spools(symbols, memory // 4), Spools(symbols, memory // 4)
    for key in range(symbols - 1, -1, -1):
        pending = list(queue.take(key))
        while pending:
            found = np.concatenate(pending)
            upper.append(key, found)
            pending = push(queue, found, True, key)
        for part in lower.read(key, backwards=True):
            push(queue, part, True, -1)
    queue.close()
    return lower, upper


def in_order(lower: Spools, upper: Spools, symbols: int) -> Iterator[np.ndarray]:
    for key in range(symbols):
        yield from lower.read(key)
        yield from upper.read(key, backwards=True)


def ranked(names: np.ndarray, steps: int) -> np.ndarray:
    """Ranks of the suffixes of a string of names by their first `steps` names, by doubling."""
    rank, width = names.astype(np.int64), 1
    while width < steps:
        top = int(rank.max()) + 2
        after = np.zeros(len(rank), dtype=np.int64)
        after[:-width] = rank[width:] + 1
        rank = np.unique(rank * top + after, return_inverse=True)[1].astype(np.int64)
        if rank.max() + 1 == len(rank):
            break
        width *= 2
    return rank


def seed_order(text: np.ndarray, types: np.ndarray, symbols: int, depth: int, memory: int) -> np.ndarray:
    """Leftmost S-type positions in the order of their suffixes."""
    seeds = np.flatnonzero(types[1:] & ~types[:-1]).astype(np.int32) + 1
    if len(seeds) < 2:
        return seeds
    rough = seeds[np.argsort(text[seeds], kind="stable")]
    lower, upper = induce(text, types, rough, symbols, memory)
    is_seed = np.zeros(len(text), dtype=bool)
    is_seed[seeds] = True
    parts = [part[is_seed[part]] for part in in_order(lower, upper, symbols)]
    lower.close()
    upper.close()
    # The last symbol is a seed that nothing induces; it comes first.
    order = np.concatenate([seeds[-1:], *parts])
    # Substrings from a seed to the next are compared by their symbols' hashes.
    ends = np.append(seeds[1:], len(text) - 1)
    values = np.random.default_rng(1).integers(1, 1 << 63, symbols, dtype=np.uint64)[text]
    power = np.multiply.accumulate(np.full(len(text), 0x9E3779B97F4A7C15, dtype=np.uint64))
    inverse = pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    back = np.multiply.accumulate(np.full(len(text), inverse, dtype=np.uint64))
    total = np.add.accumulate(values * power)
    digest = (total[ends] - total[seeds] + values[seeds] * power[seeds]) * back[seeds]
    del values, power, back, total
    place = np.zeros(len(text), dtype=np.int32)
    place[seeds] = np.arange(len(seeds), dtype=np.int32)
    at = place[order]
    length = ends - seeds
    new = (digest[at][1:] != digest[at][:-1]) | (length[at][1:] != length[at][:-1])
    names = np.zeros(len(seeds), dtype=np.int64)
    names[at] = np.concatenate([[0], np.cumsum(new)])
    # A step from seed to seed takes two symbols at least.
    rank = ranked(names, depth // 2 + 1)
    return seeds[np.argsort(rank, kind="stable")]


def sorted_suffixes(
    text: np.ndarray, symbols: int, depth: int, memory: int = MEMORY
) -> Iterator[np.ndarray]:
    """Positions of all suffixes but the last, in order, as a stream of arrays.

    `text` holds symbols below `symbols` and ends with its only 0.
    """
    types = s_types(text)
    seeds = seed_order(text, types, symbols, depth, memory)
    lower, upper = induce(text, types, seeds, symbols, memory)
    try:
        yield from in_order(lower, upper, symbols)
    finally:
        lower.close()
        upper.close()
