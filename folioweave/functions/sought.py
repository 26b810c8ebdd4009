"""Searches of patterns, letter case aside, that a look for words comes before.

Python tries a pattern without case at every letter. Whether one of the words without which it can't match stands in the text
is told many times faster, so nearly all searches end there. The rest are those of the pattern itself: no match is lost or added.
"""

from __future__ import annotations

import re


def folded(text: str) -> str:
    """text with the letters that match an ASCII one, case aside, as that one in lower case."""
    low = text.replace("\u0130", "i").lower()
    return low if low.isascii() else low.replace("\u0131", "i").replace("\u017f", "s")


class Sought:
    """pattern, which can't match a text without one of the words; tail: a pattern of lower case that a folded text must match, too."""

    def __init__(self, pattern: str, *words: str, tail: str | None = None) -> None:
        self.pattern, self.words = re.compile(pattern, re.I), words
        self.tail = re.compile(tail) if tail else None

    def possible(self, fold: str) -> bool:
        """fold: the folded text."""
        return any(w in fold for w in self.words) and (self.tail is None or self.tail.search(fold) is not None)

    def search(self, text: str, fold: str | None = None) -> re.Match[str] | None:
        return self.pattern.search(text) if self.possible(folded(text) if fold is None else fold) else None
