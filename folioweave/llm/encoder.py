"""Texts to token ids by a tokenizers file, with a memory of the pieces that the pre-tokeniser cuts.

A byte-level tokenizer cuts a text into pieces by a fixed pattern and encodes each by itself. The cuts of a batch of texts are
found here in numpy; each piece's bytes are looked up in a table of pieces, and only those that it lacks go through the
library's model. Pieces that came once are not kept. Around characters whose class this module doesn't state, all up to the
next blank between words goes through the whole library. Tokenizers of another kind encode whole texts.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from folioweave.llm.contents import LONGEST, Table, contents

#: Pieces that a memory holds before it starts anew.
MOST = 700_000
LETTER, DIGIT, OTHER, WHITE, ODD, REST = range(6)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of each byte that says it alone, and of each byte after 0xC2. REST: a later byte of a character."""
    ascii_ = [WHITE if c == " " or "\t" <= c <= "\r" else LETTER if c.isalpha() else DIGIT if c.isdigit() else OTHER for c in map(chr, range(128))]
    one = np.array(ascii_ + [REST] * 64 + [ODD] * 64, np.uint8)
    one[0xC3:0xCA] = LETTER
    latin = np.full(256, OTHER, np.uint8)
    latin[[0x85, 0xA0]] = ODD
    latin[[ord(c) for c in "ªµº"]] = LETTER
    latin[[ord(c) for c in "²³¹¼½¾"]] = DIGIT
    return one, latin


_CLASS, _LATIN = _classes()


def byte_classes(buf: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    c = _CLASS[buf]
    if not len(buf) or buf.max() < 128:
        return c
    after = np.r_[buf[1:], 0]
    for lead in (0xC2, 0xC3, 0xC9, 0xE2):
        at = np.flatnonzero(buf == lead)
        if lead == 0xC2:
            c[at] = _LATIN[after[at]]
        elif lead == 0xC3:  # the signs of multiplication and division
            c[at[np.isin(after[at], (0x97, 0xB7))]] = OTHER
        elif lead == 0xC9:  # as far as U+024F
            c[at[after[at] >= 0x90]] = ODD
        else:  # dashes, quotation marks and the like: U+2010 to U+2027 and U+2030 to U+205E
            second, third = after[at], np.r_[buf[2:], 0, 0][at]
            known = (second == 0x80) & (third >= 0x90) & (third <= 0xBF) & ((third <= 0xA7) | (third >= 0xB0))
            known |= (second == 0x81) & (third <= 0x9E)
            c[at[known]] = OTHER
    for _ in range(3):
        rest = np.flatnonzero(c == REST)
        c[rest] = c[rest - 1]
    return c


def cuts(buf: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces start, and which of them need the whole library. first: the starts of texts that aren't empty.

    Pieces are runs of letters, of digits, of other characters or of white space. A blank before one that isn't white space
    goes to it; a run of white space before such leaves its last character apart. 's 't 'm 'd 're 've 'll are pieces
    where a piece would start with their apostrophe.
    """
    n = len(buf)
    c = byte_classes(buf)
    opens = np.zeros(n + 4, bool)
    opens[first] = opens[n:] = True
    change = opens[:n].copy()
    change[1:] |= c[1:] != c[:-1]
    blank, white = buf == 32, c == WHITE
    starts = change.copy()
    after = np.flatnonzero(change[1:] & white[:-1] & ~white[1:] & ~opens[1:n]) + 1
    starts[after - 1] = True
    starts[after[blank[after - 1]]] = False
    p = np.flatnonzero((buf == 39) & change)
    p = p[opens[p] | ~blank[p - 1]]
    one, two = (np.where(opens[p + k], 0, buf[np.minimum(p + k, n - 1)]) for k in (1, 2))
    two[opens[p + 1]] = 0
    short = np.isin(one, list(b"stmd"))
    long = ((two == ord("e")) & np.isin(one, list(b"rv"))) | ((one == ord("l")) & (two == ord("l")))
    starts[p[short | long] + 1] = False
    for at in (p[short] + 2, p[long] + 3):
        starts[at[at < n]] = True
    odd = np.flatnonzero(c == ODD)
    whole = np.zeros(0, np.int64)
    if len(odd):
        sure = c < WHITE
        apart = np.flatnonzero(blank[1:-1] & sure[:-2] & sure[2:] & ~opens[1 : n - 1] & ~opens[2:n]) + 1
        borders = np.unique(np.r_[apart, first, n])
        k = np.unique(np.searchsorted(borders, odd, "right"))
        inside = np.zeros(n + 1, np.int8)
        inside[borders[k - 1] + 1] += 1
        inside[borders[k]] -= 1
        starts[np.cumsum(inside[:n]) > 0] = False
        whole = borders[k - 1]
    at = np.flatnonzero(starts)
    return at, np.isin(at, whole) if len(whole) else np.zeros(len(at), bool)


class Memory:
    """Pieces by number, the token ids of each number one after another. Number 0 ends a text."""

    def __init__(self, dtype: type) -> None:
        self.dtype, self.kept = dtype, 0
        self.flat, self.starts = np.zeros(1 << 16, dtype), np.zeros(1 << 14, np.int64)
        self.table = Table(2 * MOST)
        self.long: dict[bytes, int] = {}
        self.met = np.zeros(1 << 23, bool)  # by hash: pieces that have come before

    def learn(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Of the numbers from `kept` on: how many ids each has, and the ids."""
        n, start = self.kept + len(sizes), self.starts[self.kept]
        while len(self.flat) < start + len(ids):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        while len(self.starts) <= n:
            self.starts = np.r_[self.starts, np.zeros_like(self.starts)]
        self.starts[self.kept + 1 : n + 1] = start + np.cumsum(sizes)
        self.flat[start : start + len(ids)] = ids

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each number has, and all ids."""
        starts = self.starts[numbers]
        sizes = self.starts[numbers + 1] - starts
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0)
        at += np.repeat(starts - (ends - sizes), sizes)
        return sizes, self.flat[at]


class Encoder:
    def __init__(self, path: str) -> None:
        # Tasks already use every core; threads of the library only add work here.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and all(t["special"] for t in spec.get("added_tokens") or [])
        self.by_piece = plain and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.dtype = np.uint16 if max(self.tok.get_vocab().values()) < 1 << 16 else np.uint32
        # In a byte-level vocabulary a byte that can be seen stands for itself, any other for a character from 256 on.
        seen = np.isin(np.arange(256), [*range(33, 127), *range(161, 173), *range(174, 256)])
        self.letters = np.where(seen, np.arange(256), 255 + np.cumsum(~seen)).astype("<u2")
        self.memory = Memory(self.dtype)

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: pa.Array | list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and all ids; end_id, if given, ends each text. A null is an empty text."""
        raw = [(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))]
        end = [] if end_id is None else [end_id]
        if not self.by_piece:
            out = [[*ids, *end] for ids in self.plain([r.decode() for r in raw])]
            return np.array([len(x) for x in out], np.int64), np.array([i for x in out for i in x], self.dtype)
        ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        buf = np.frombuffer(b"".join(raw), np.uint8)
        starts, whole = cuts(buf, np.unique(np.r_[0, ends[:-1]][np.diff(ends, prepend=0) > 0])) if len(buf) else (np.zeros(0, np.int64), np.zeros(0, bool))
        numbers = self._numbers(buf, starts, np.diff(starts, append=len(buf)), whole, end)
        last = np.searchsorted(starts, ends)  # pieces before each text's end
        sizes, ids = self.memory.ids(np.insert(numbers, last, 0))
        self._settle()
        return np.diff(np.cumsum(sizes)[last + np.arange(len(last))], prepend=0), ids

    def _numbers(self, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, whole: np.ndarray, end: list[int]) -> np.ndarray:
        """Each piece's number; those that the memory lacks are encoded and get the next ones."""
        memory = self.memory
        if not memory.kept:
            memory.learn(np.array([len(end)]), np.array(end, self.dtype))
            memory.kept = 1
        out = np.zeros(len(starts), np.int64)
        alone = whole | (sizes > LONGEST)
        short = np.flatnonzero(~alone)
        content = contents(buf, starts[short], sizes[short])
        out[short], h, new = memory.table.number(content, memory.kept)
        at, size = starts[short[new]], sizes[short[new]]
        self.fresh = [x[new] for x in content], h[new], {}
        got = self._by_model(buf, at, size)
        raw = buf.tobytes() if alone.any() else b""
        for k in np.flatnonzero(alone).tolist():
            piece = raw[starts[k] : starts[k] + sizes[k]]
            if (number := memory.long.get(piece, self.fresh[2].get(piece))) is None:
                number = self.fresh[2][piece] = memory.kept + len(got)
                # The library also cuts a long piece; by itself it stays as it is.
                got.append(self.plain([piece.decode()])[0])
            out[k] = number
        memory.learn(np.array([len(x) for x in got], np.int64), np.array([i for x in got for i in x], self.dtype))
        return out

    def _by_model(self, buf: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[list[int]]:
        if not len(at):
            return []
        ends = np.cumsum(size)
        picked = np.arange(ends[-1]) + np.repeat(at - (ends - size), size)
        text, tokenize = self.letters[buf[picked]].tobytes().decode("utf-16-le"), self.tok.model.tokenize
        return [[t.id for t in tokenize(text[a:b])] for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)]

    def _settle(self) -> None:
        """Of the new pieces, those that have come before are kept."""
        memory, (content, h, long) = self.memory, self.fresh
        mask = np.uint64(len(memory.met) - 1)
        again = np.flatnonzero(memory.met[((h >> np.uint64(20)) & mask).astype(np.int64)])
        again = again[: max(0, memory.table.most - memory.kept)]  # the table stays sparse whatever a text holds
        memory.met[((h >> np.uint64(20)) & mask).astype(np.int64)] = True
        stay = (memory.kept + again).tolist()
        memory.table.place([x[again] for x in content], h[again], memory.kept + np.arange(len(again)))
        for piece, number in long.items():
            at = hash(piece) & int(mask)
            if memory.met[at] and len(piece) < 1000:
                memory.long[piece] = memory.kept + len(stay)
                stay.append(number)
            memory.met[at] = True
        memory.learn(*memory.ids(np.array(stay, np.int64)))
        memory.kept += len(stay)
        if memory.kept > MOST:
            self.memory = Memory(self.dtype)
