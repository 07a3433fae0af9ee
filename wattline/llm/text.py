"""Words and shingles of Arrow text columns as 64-bit hashes, with numpy.

A word is a run of bytes other than space and 0x09-0x0D; ``A-Z`` count as ``a-z``. Null is
the empty text. Work goes on in slices of about a megabyte, so memory follows the slice,
or a single text that is longer than one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
SHINGLE = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd random numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _ODD + np.uint64(seed)) | np.uint64(1)


_BYTE = seeds(256, 1)
_PLACE = seeds(16, 2)
_BASE = 0xD6E8FEB86659FD93
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        both = []
        for base in (_BASE, inverse):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            both.append(np.multiply.accumulate(table))
        _powers = tuple(both)
    return _powers


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about ``limit`` bytes, or one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    low = 0
    while low < len(ends):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield low, high
        low = high


@dataclass
class Words:
    """Words of some texts: text ``i`` has words ``first[i]`` to ``first[i + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the border of each."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    borders = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[borders[0] : borders[-1]], borders - borders[0]


def lowered(texts: pa.Array) -> pa.Array:
    """The texts with A-Z as a-z, as bytes."""
    raw, borders = utf8(texts)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(borders.astype(np.int64)), pa.py_buffer(_LOWER[raw])])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each byte span, from differences of one running polynomial."""
    power, inverse = _power_tables(len(data) + 1)
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=running[1:])
    return mix((running[ends] - running[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words(texts: pa.Array, lower: bool = True) -> Words:
    raw, borders = utf8(texts)
    data = _LOWER[raw] if lower else raw
    solid = np.concatenate(([False], ~_SPACE[raw], [False]))
    cut = np.zeros(len(raw) + 1, bool)
    cut[borders] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | cut[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | cut[1:])) + 1
    first = np.searchsorted(starts, borders)
    return Words(data, starts, ends, first, span_hashes(data, starts, ends))


def shingles(found: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, repeats included, and the border of each text's.

    A text with fewer words has its whole sequence as its only run; one without words has none.
    """
    n = len(found.hashes)
    place = np.arange(n)
    counts = found.counts
    end = np.repeat(found.first[1:], counts)
    begin = np.repeat(found.first[:-1], counts)
    total = np.zeros(n, np.uint64)
    padded = np.concatenate((found.hashes, np.zeros(size, np.uint64)))
    for j in range(size):
        total += np.where(place + j < end, padded[j : n + j] * _PLACE[j], np.uint64(0))
    keep = (place + size <= end) | (place == begin)
    total = mix(total + np.minimum(end - place, size).astype(np.uint64))[keep]
    per_text = np.maximum(counts - size + 1, np.minimum(counts, 1))
    return total, np.concatenate(([0], np.cumsum(per_text)))


def distinct(values: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each text and their borders."""
    sets = [np.unique(values[a:b]) for a, b in zip(borders[:-1], borders[1:], strict=True)]
    return (np.concatenate(sets) if sets else values), np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, as one table each; a run may cross batches."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        borders = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
