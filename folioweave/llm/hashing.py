"""Hashes of words and windows over whole byte strings, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK = 1 << 21
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 4096)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A number for each byte at each of the first LONG places of a word. Sums of them tell words apart; polynomials modulo
#: 2**64 don't, as some words of 1,024 letters and more agree in every base. Longer words are hashed one by one.
LONG = 64
_LETTERS = mixed(mixed(np.arange(LONG * 256, dtype=np.uint64) + np.uint64(1)) * np.uint64(BASE))


def prefix(buf: np.ndarray) -> np.ndarray:
    """Sums of byte * BASE**position before each position; differences give hashes of slices."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(buf)), out=out[1:])
    return out


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word between ASCII white space. Long strings go in pieces that are cut at white space."""
    if len(raw) > CHUNK:
        parts, at = [], 0
        while at < len(raw):
            end = min(len(raw), at + CHUNK)
            while end < len(raw) and not _SPACE[raw[end]]:
                end += 1
            parts.append(_word_hashes(raw[at:end]))
            at = end
        return np.concatenate(parts)
    return _word_hashes(raw)


def _word_hashes(raw: bytes) -> np.ndarray:
    buf = np.frombuffer(raw, np.uint8)
    space = np.empty(len(buf) + 2, bool)
    space[0] = space[-1] = True
    space[1:-1] = _SPACE[buf]
    turns = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = turns[::2], turns[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    at = np.flatnonzero(~space[1:-1])
    place = at - np.repeat(starts, size)
    sums = np.add.reduceat(_LETTERS[(place & (LONG - 1)) << 8 | buf[at]], np.cumsum(size) - size)
    for k in np.flatnonzero(size > LONG).tolist():
        sums[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : ends[k]])
    return mixed(sums + size.astype(np.uint64))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of `size` words; of all words as one, if there are fewer."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    k = min(size, len(words))
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = mixed(out + words[j : j + n]) * np.uint64(BASE)
    return np.unique(mixed(out))
