"""Pieces of a buffer of bytes looked up by their contents, many at a time."""

from __future__ import annotations

import numpy as np

from folioweave.llm.hashing import mixed

#: Pieces of up to eight bytes a number are looked up in tables, longer ones go by dictionaries.
WORDS = 3
LONGEST = 8 * WORDS - 1


def contents(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The bytes of pieces of up to LONGEST bytes as WORDS numbers. Zeros fill up; as a piece may hold them, the top byte is its size."""
    padded = np.r_[buf, np.zeros(8 * WORDS, np.uint8)]
    at_each = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    out = []
    for w in range(WORDS):
        held = np.clip(sizes - 8 * w, 0, 8).astype(np.uint64)
        mask = np.where(held == 8, np.uint64((1 << 64) - 1), (np.uint64(1) << (held * np.uint64(8) % np.uint64(64))) - np.uint64(1))
        out.append(at_each[starts + 8 * w] & mask)
    out[-1] |= sizes.astype(np.uint64) << np.uint64(56)
    return out


class Table:
    """Numbers of contents. What is found is equal in all bytes."""

    def __init__(self, most: int) -> None:
        """most: numbers that it will hold; the table stays at most half full."""
        self.most, self.slots = most, np.full(1 << (2 * most - 1).bit_length(), -1, np.int32)
        self.content = [np.zeros(1 << 16, np.uint64) for _ in range(WORDS)]

    def number(self, content: list[np.ndarray], first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of each, its hash, and the places of new contents, which get the numbers from `first` on in that order."""
        h = np.zeros(len(content[0]), np.uint64)
        for x in content:
            h = mixed(h ^ x)
        out = self._find(content, h)
        lacking = np.flatnonzero(out < 0)
        order = lacking[np.lexsort([x[lacking] for x in content])]
        differs = np.zeros(len(order), bool)
        differs[:1] = True
        for x in content:
            differs[1:] |= x[order[1:]] != x[order[:-1]]
        out[order] = first + np.cumsum(differs) - 1
        return out, h, order[differs]

    def _find(self, content: list[np.ndarray], h: np.ndarray) -> np.ndarray:
        out, mask = np.full(len(h), -1, np.int64), len(self.slots) - 1
        left, at = np.arange(len(h)), (h & np.uint64(mask)).astype(np.int64)
        while len(left):
            number = self.slots[at]
            same = number >= 0
            for own, x in zip(self.content, content, strict=True):
                same &= own[number] == x[left]
            out[left[same]] = number[same]
            on = (number >= 0) & ~same
            left, at = left[on], (at[on] + 1) & mask
        return out

    def place(self, content: list[np.ndarray], h: np.ndarray, numbers: np.ndarray) -> None:
        """Remember new contents; numbers ascend and stay below `most`."""
        if not len(numbers):
            return
        while numbers[-1] >= len(self.content[0]):
            self.content = [np.r_[x, np.zeros_like(x)] for x in self.content]
        for own, x in zip(self.content, content, strict=True):
            own[numbers] = x
        mask = len(self.slots) - 1
        at = (h & np.uint64(mask)).astype(np.int64)
        while len(at):
            free = self.slots[at] < 0
            self.slots[at[free]] = numbers[free]
            on = self.slots[at] != numbers
            numbers, at = numbers[on], (at[on] + 1) & mask
