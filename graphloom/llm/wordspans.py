"""Words of many texts at once as numpy arrays: where they are, and 64-bit hashes of them and of their sequences."""

from __future__ import annotations

import numpy as np

#: Fixed value: the bytes that separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, np.int64).astype(np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(max(n, 1024) - 1, _STEP))])
    return _powers[:n]


def spans(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words of every text; `apart` tells the bytes between words."""
    inside = ~apart[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each piece (pieces are not empty, in order and apart)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    at = np.cumsum(lengths) - lengths
    where = np.arange(lengths.sum()) - np.repeat(at, lengths)
    power = powers(int(lengths.max()))[where]
    where += np.repeat(starts, lengths)
    values = (_BYTE ^ np.uint64(salt))[data[where]] * power
    return mixed(np.add.reduceat(values, at) ^ (lengths.astype(np.uint64) * _STEP))


def sequence_hashes(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n words in a row within a text, or of all its words where they are fewer (texts without words have
    none), in order of the texts; and how many each text has."""
    ends = np.cumsum(counts)
    have = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    starts = np.repeat(ends - counts, have) + (np.arange(have.sum()) - np.repeat(np.cumsum(have) - have, have))
    limit = np.repeat(ends, have)
    out = np.zeros(len(starts), np.uint64)
    steps = powers(n + 1)[1:]
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    for i, step in enumerate(steps):
        there = starts + i < limit
        out += np.where(there, mixed(padded[starts + i] + np.uint64(i + 1)), np.uint64(i + 1)) * step
    return mixed(out), have
