"""Words and their hashes straight from the UTF-8 bytes of an Arrow batch.

A word is ``[^\\x20\\x09-\\x0D]+``. All six separators are ASCII, so the cut can
be made on bytes. Hashes are multilinear: each byte's random value times a random
multiplier of its place in the word, summed modulo 2**64 and then mixed.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    x = np.asarray(x, _U)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def randoms(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit values of a seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed * 0x632BE59BD9B4E019 % 2**64)) | _U(1)


_PLACES: dict[int, np.ndarray] = {}


def places(n: int, seed: int) -> np.ndarray:
    have = _PLACES.get(seed)
    if have is None or len(have) < n:
        have = _PLACES[seed] = randoms(max(4096, 1 << int(n - 1).bit_length()), seed)
    return have


def byte_values(seed: int, spaces: bool) -> np.ndarray:
    t = randoms(256, seed + 1000)
    if not spaces:
        t = np.where(SPACE, _U(0), t)
    return t


def segment_hash(data: np.ndarray, starts: np.ndarray, seed: int = 1, spaces: bool = False) -> np.ndarray:
    """Hash of each stretch data[starts[i]:starts[i+1]] (the last one to the end); spaces: they count."""
    if not len(starts):
        return np.zeros(0, _U)
    lens = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lens)
    with np.errstate(over="ignore"):
        v = byte_values(seed, spaces)[data[starts[0] :]] * places(int(lens.max()) + 1, seed)[place]
        return mix(np.add.reduceat(v, starts - starts[0]))


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words, and per text the index of its first word (with the total at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    before = np.concatenate(([False], word[:-1]))
    after = np.concatenate((word[1:], [False]))
    starts = np.flatnonzero(word & (~before | cut[:-1]))
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, seed: int = 1) -> np.ndarray:
    return segment_hash(data, starts, seed)


def window_hash(words: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """Hash of each n consecutive entries, by first entry."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    c = randoms(n, seed)
    out = np.zeros(m, _U)
    with np.errstate(over="ignore"):
        for k in range(n):
            out += words[k : k + m] * c[k]
    return mix(out)


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def per_text(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of values[offs[i]:offs[i+1]] for each text."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offs[1:]] - total[offs[:-1]]


def repeats_within(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each key, whether it is found twice or more in its own text."""
    if not len(keys):
        return np.zeros(0, bool)
    with np.errstate(over="ignore"):
        k = mix(keys + mix(owner.astype(_U) + _U(1)))
    order = np.argsort(k, kind="stable")
    s = k[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(k), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice
