"""Hashed n-grams of tokens and of token shapes, counted per text with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from wattline.llm import text as T

BUCKETS = 1 << 16

_KIND = np.where(T.WORD_BYTE, 1, 2)  # 2: mark, 1: word, 0: space
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
_A, _B, _C = T.seeds(3, 11)


def tokens(texts: pa.Array) -> T.Words:
    """Runs of word characters and runs of marks, case kept."""
    raw, borders = T.utf8(texts)
    kind = _KIND[raw]
    head = np.zeros(len(raw) + 1, bool)
    head[borders] = True
    turn = head[:-1].copy()
    turn[1:] |= kind[1:] != kind[:-1]
    cuts = np.flatnonzero(turn)
    ends = np.append(cuts[1:], len(raw))[: len(cuts)]
    solid = kind[cuts] > 0
    starts, ends = cuts[solid], ends[solid]
    return T.Words(raw, starts, ends, np.searchsorted(starts, borders), T.span_hashes(raw, starts, ends))


def shapes(found: T.Words, owner: np.ndarray) -> np.ndarray:
    """Per token: mark (by its first byte), lower, capital, upper, mixed or digits, and whether it repeats one of the two before."""
    upper, digit = (np.concatenate(([0], np.cumsum(t[found.data]))) for t in (_UPPER, _DIGIT))
    size = found.ends - found.starts
    big, figures = upper[found.ends] - upper[found.starts], digit[found.ends] - digit[found.starts]
    first = found.data[found.starts] if len(size) else np.zeros(0, np.uint8)
    shape = np.where(big == 0, 0, np.where((big == 1) & (_UPPER[first] == 1), 1, np.where(2 * big >= size, 2, 3)))
    shape = np.where(figures > 0, 4, shape)
    shape = np.where(_KIND[first] == 2, 5 + first.astype(np.int64), shape)
    again = np.zeros(len(size), np.int64)
    for back in (1, 2):
        again[back:] |= (found.hashes[back:] == found.hashes[:-back]) & (owner[back:] == owner[:-back])
    return 2 * shape + again


def buckets(texts: pa.Array, size: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of all texts and the text it is in.

    N-grams are tokens, pairs of tokens, and runs of three token shapes.
    """
    found = tokens(texts)
    owner = np.repeat(np.arange(len(texts)), found.counts)
    n = len(owner)
    shape = shapes(found, owner).astype(np.uint64)
    pair = np.flatnonzero(owner[1:] == owner[:-1]) if n > 1 else np.zeros(0, np.int64)
    triple = np.flatnonzero(owner[2:] == owner[:-2]) if n > 2 else np.zeros(0, np.int64)
    values = (
        found.hashes,
        T.mix(found.hashes[pair] * _A + found.hashes[pair + 1]),
        T.mix((shape[triple] << np.uint64(40)) + (shape[triple + 1] << np.uint64(20)) + shape[triple + 2] + _C),
    )
    return (np.concatenate(values) % np.uint64(size)).astype(np.int64), np.concatenate((owner, owner[pair], owner[triple]))
