"""Vectorised words, shingles and MinHash over whole texts, for use inside tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: bytes of text that are turned into arrays at once
SLICE = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values: the usual 64-bit finaliser
_BASE = 0x9E3779B97F4A7C15  # fixed value: odd, 2**64 over the golden ratio
_SEPARATES = np.zeros(256, bool)
_SEPARATES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; one to one."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE + 1)
        _POWERS[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0][:n], _POWERS[1][:n]


def binary(column: pa.Array) -> pa.Array:
    """The column as binary values, null as empty."""
    import pyarrow.compute as pc

    return pc.fill_null(column.cast(pa.large_binary()), b"")


def slices(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) in slices of bounded bytes; one longer text is a slice of its own."""
    values, first, held, size = binary(batch.column(batch.schema.get_field_index(text))), 0, [], 0
    for i in range(len(values)):
        value = values[i].as_py()
        if held and size + len(value) > SLICE:
            yield first, held
            first, held, size = i, [], 0
        held.append(value)
        size += len(value) + 1
    if held:
        yield first, held


def _hash_words(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = ~_SEPARATES[part]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(len(part) + 1)
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((_LOWER[part].astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts, ends


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lowered, cut at white space), and where they start and end.

    A text longer than a slice is read in pieces that end between words, so that
    memory beyond the text is one slice and a few bytes per word.
    """
    raw = np.frombuffer(data, np.uint8)
    if len(raw) <= SLICE:
        return _hash_words(raw)
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + SLICE)
        if end < len(raw):
            gaps = np.flatnonzero(_SEPARATES[raw[at:end]])
            while not len(gaps) and end < len(raw):  # one word longer than a slice
                end = min(len(raw), end + SLICE)
                gaps = np.flatnonzero(_SEPARATES[raw[at:end]])
            if len(gaps) and end < len(raw):
                end = at + int(gaps[-1]) + 1
        hashes, starts, ends = _hash_words(raw[at:end])
        out.append((hashes, starts + at, ends + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; of the whole sequence where it is shorter; none without words."""
    n = min(k, len(words))
    if n == 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    up = powers(k + 1)[0]
    for i in range(n):
        total += words[i : len(words) - n + 1 + i] * up[i + 1]
    return mix(total + np.uint64(n))


def shingle_set(data: bytes, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(word_hashes(data)[0], k))


def set_id(hashes: np.ndarray) -> bytes:
    """A 128-bit digest of a sorted set."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


class MinHash:
    """Signatures of ``size`` 32-bit minima."""

    def __init__(self, size: int, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.a = draw.integers(0, 1 << 63, size, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 1 << 63, size, np.uint64)
        self.size = size

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(self.size, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(hashes), 512):
            part = hashes[i : i + 512]
            np.minimum(least, (self.a[:, None] * part[None, :] + self.b[:, None]).min(axis=1), out=least)
        return (least >> np.uint64(32)).astype("<u4")

    def runs(self, hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Signatures of the runs hashes[first:last], none empty; runs may overlap, each hash is looked at once."""
        least, step = np.full((len(first), self.size), np.iinfo(np.uint64).max, np.uint64), 1024
        for at in range(0, len(hashes), step):
            part = hashes[at : at + step]
            here = np.flatnonzero((first < at + len(part)) & (last > at))
            if not len(here):
                continue
            values = np.full((self.size, len(part) + 1), np.iinfo(np.uint64).max, np.uint64)  # the last column ends a run
            np.add(self.a[:, None] * part[None, :], self.b[:, None], out=values[:, :-1])
            edges = np.stack((np.maximum(first[here] - at, 0), np.minimum(last[here] - at, len(part))), axis=1).ravel()
            least[here] = np.minimum(least[here], np.minimum.reduceat(values, edges, axis=1)[:, ::2].T)
        return (least >> np.uint64(32)).astype("<u4")
