"""Suffix arrays by two-stage sorting, in numpy.

Stage one sorts directly only the suffixes that are smaller than their successors (type B). Stage two induces the
others (type A) by scanning the buckets of first bytes in order: a suffix that is larger than its successor follows
the successor's place. Within a bucket the scan goes in waves, as a run of one byte induces into its own bucket.
"""

from __future__ import annotations

import numpy as np

WORD = 8


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian number; zeros follow the end."""
    padded = np.concatenate([text, np.zeros(WORD, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for j in range(WORD):
        out = (out << np.uint64(8)) | padded[j : j + len(text)]
    return out


def is_smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Type B; the last position, a unique smallest end, counts as A."""
    n = len(text)
    step = np.sign(text[1:].astype(np.int16) - text[:-1])
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    following = np.minimum.accumulate(at[::-1])[::-1]  # equal bytes take the type of the run's end
    out = np.zeros(n, bool)
    out[:-1] = np.append(step, -1)[following] > 0
    return out


def sort_directly(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Suffix starts in order of their first `depth` bytes at least. Only groups that differ in the next word are sorted again."""
    last = len(words) - 1
    at = at[np.argsort(words[at], kind="stable")]
    key = words[at]
    starts = np.r_[True, key[1:] != key[:-1]]
    alive = np.flatnonzero(~(starts & np.r_[starts[1:], True]))  # in a group of more than one
    for d in range(WORD, depth, WORD):
        if not len(alive):
            break
        head = starts[alive]
        key = words[np.minimum(at[alive] + d, last)]
        differs = np.r_[False, (key[1:] != key[:-1])] & ~head
        group = np.cumsum(head) - 1
        torn = np.zeros(group[-1] + 1, bool)
        torn[group[differs]] = True
        hit = np.flatnonzero(torn[group])
        if len(hit):
            order = hit[np.lexsort((key[hit], group[hit]))]
            at[alive[hit]] = at[alive[order]]
            k, g = key[order], group[hit]
            starts[alive[hit]] = np.r_[True, (k[1:] != k[:-1]) | (g[1:] != g[:-1])]
        s = starts[alive]
        alive = alive[~(s & np.r_[s[1:], True])]
    return at


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix starts in order of their first `depth` bytes at least. text: uint8, its last byte is its only final 0."""
    n = len(text)
    small = is_smaller_than_next(text)
    in_b = sort_directly(np.flatnonzero(small), words_at(text), depth)
    size = np.bincount(text, minlength=256)
    n_b = np.bincount(text[in_b], minlength=256)
    start = np.cumsum(size) - size
    out = np.empty(n, np.int64)
    b_at = np.cumsum(n_b) - n_b
    for c in np.flatnonzero(n_b):
        out[start[c] + size[c] - n_b[c] : start[c] + size[c]] = in_b[b_at[c] : b_at[c] + n_b[c]]
    out[0] = n - 1
    heads = start.copy()
    heads[0] += 1

    def induce(seg: np.ndarray) -> None:
        before = seg - 1
        before = before[before >= 0]
        before = before[~small[before]]
        if not len(before):
            return
        c = text[before]
        order = np.argsort(c, kind="stable")
        c = c[order]
        count = np.bincount(c, minlength=256)
        first = np.cumsum(count) - count
        out[heads[c] + np.arange(len(c)) - first[c]] = before[order]
        heads[:] += count

    for c in np.flatnonzero(size):
        lo = start[c]
        while lo < heads[c]:
            hi = heads[c]
            induce(out[lo:hi])
            lo = hi
        if n_b[c]:
            induce(out[start[c] + size[c] - n_b[c] : start[c] + size[c]])
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """For each place in the order but the first: bytes in common with the place before, up to `limit`."""
    words = words_at(text)
    last = len(text) - 1
    out = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for d in range(0, limit, WORD):
        x = words[np.minimum(order[alive] + d, last)] ^ words[np.minimum(order[alive - 1] + d, last)]
        same = x == 0
        gone = ~same
        if gone.any():
            bits = x[gone]
            lead = np.zeros(len(bits), np.int64)
            for j in range(WORD - 1):  # leading equal bytes
                lead += (lead == j) & (bits >> np.uint64(8 * (WORD - 1 - j)) == 0)
            out[alive[gone]] = d + lead
        alive = alive[same]
        if not len(alive):
            break
    out[alive] = limit
    return np.minimum(out, limit)
