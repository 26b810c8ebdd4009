"""Benchmark decontamination by template canonicalisation.

Words lose their outer punctuation and case. Numbers, names and units become typed placeholders: a number starts with a
digit or is a number word, a name is a run of capitalised words, a unit stands after a number. Texts are read in three ways:
with names only inside sentences, with the words that open sentences as names, too, and as plain words without any
placeholders, in which copies are found whatever their numbers, names and case.

1. The windows of WINDOW words (the whole item, if it is shorter) of the benchmark are hashed. A filter of bits over the
   hashes, of a fixed size at most, is all that the tasks get of the benchmark. Documents with a window that passes it go on.
2. Their windows are joined with the benchmark's by hash, which gives pairs of documents and items, and these with both texts.
3. Where at least COVER of an item's words lie under matching windows of one alignment, the slots are compared: one value of
   the item must always meet one value of the document. Then the document holds the item, verbatim or re-parameterised.

Templates that are mostly placeholders say nothing by themselves: they only widen a match that other windows of its
alignment have made. So an item without any window rich in words is found verbatim only, by its plain words.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm.common import table, written
from folioweave.llm.contents import LONGEST, Table, contents

WINDOW = 8
MIN_WORDS = 5
COVER = 0.5
MEMO = 400_000
DRIFT = 8
#: Bits of the filter for each window, and at most; items that are judged with a document in one row are about 1 / ITEM_PARTS of the benchmark.
BITS, MOST_BITS, PROBES, ITEM_PARTS = 256, 1 << 28, 4, 256
#: Leaky texts of which the hashes are broadcast, at most: 16 bytes each.
FEW = 2_000_000
#: Sets of items that a task keeps read.
READ = 200
LITERAL, NUM, UNIT, SKIP = 0, 1, 2, 3
NAME_CODE, NUM_CODE, UNIT_CODE = np.uint64(11), np.uint64(22), np.uint64(33)
#: The three ways to read a text.
INSIDE, OPENING, PLAIN = WAYS = range(3)
#: Fixed word lists.
NUMBER_WORDS = frozenset("two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = frozenset("% percent km m cm mm mi mile miles metre metres meter meters foot feet ft inch inches yard yards kg g mg lb lbs pound pounds oz ounce ounces ton tons tonne tonnes l ml litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents hz khz mhz ghz kb mb gb tb w kw v j cal kcal km/h mph m/s °c °f degrees".split())
_OUTER = re.compile(r"^[^\w%°$€£+-]+|[^\w%°]+$")
_ENDS = (".", "!", "?", ":")
_NUMBER = re.compile(r"[+-]?[$€£]?\d")


def packed(word: str) -> int:
    """59 bits of hash, 2 bits of kind (bits 3, 4), a bit for a capital (2), one for a unit's form (1), one for a sentence's end (0)."""
    core = _OUTER.sub("", word).strip("+-") if not word.isalnum() else word
    ends = 1 if word.rstrip("\"')]}»”’").endswith(_ENDS) else 0
    if not core:
        return SKIP << 3 | ends
    low = core.lower()
    code = (max(xxhash.xxh3_64_intdigest(low) & ((1 << 59) - 1), 34)) << 5 | ends  # placeholders are below
    if _NUMBER.match(core) or low in NUMBER_WORDS:
        return code | NUM << 3
    return code | LITERAL << 3 | (4 if core[0].isupper() else 0) | (2 if low in UNITS else 0)


#: Bytes of white space, and characters of several bytes that are.
_WHITE = np.zeros(256, bool)
_WHITE[[*range(9, 14), *range(28, 33)]] = True
_WIDE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of words, as str.split cuts them."""
    white = np.empty(len(buf) + 2, bool)
    white[0] = white[-1] = True
    white[1:-1] = _WHITE[buf]
    if len(buf) and buf.max() > 127:
        padded = np.r_[buf, 0, 0]
        for lead in {w[0] for w in _WIDE}:
            at = np.flatnonzero(buf == lead)
            for w in _WIDE:
                if w[0] == lead and len(at):
                    hit = at[(padded[at + 1] == w[1]) & ((padded[at + 2] == w[-1]) | (len(w) == 2))]
                    for k in range(len(w)):
                        white[1 + hit + k] = True
    turns = np.flatnonzero(white[1:] != white[:-1])
    return turns[::2], turns[1::2] - turns[::2]


class Canon:
    """Words to packed codes, with a memory of words that is emptied when full."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.table, self.long, self.known, self.kept = Table(2 * MEMO), {}, np.zeros(1 << 16, np.uint64), 0

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The code of each word, and the text that it is in."""
        buf = np.frombuffer(b" ".join(texts), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        starts, sizes = word_spans(buf)
        if self.kept > MEMO:
            self.clear()
        out, long = np.zeros(len(starts), np.uint64), sizes > LONGEST
        short = np.flatnonzero(~long)
        content = contents(buf, starts[short], sizes[short])
        numbers, h, new = self.table.number(content, self.kept)
        raw = buf.tobytes()
        words = [raw[a : a + n] for a, n in zip(starts[short[new]].tolist(), sizes[short[new]].tolist(), strict=True)]
        n = self.kept + len(new)
        while n > len(self.known):
            self.known = np.r_[self.known, np.zeros_like(self.known)]
        self.known[self.kept : n] = [packed(w.decode()) for w in words]
        out[short] = self.known[numbers]
        if n <= self.table.most:
            self.table.place([x[new] for x in content], h[new], self.kept + np.arange(len(new)))
            self.kept = n
        else:
            self.clear()
        for k in np.flatnonzero(long).tolist():
            w = raw[starts[k] : starts[k] + sizes[k]]
            if (code := self.long.get(w)) is None:
                code = packed(w.decode())
                if len(w) < 1000:
                    self.long[w] = code
            out[k] = code
        if len(self.long) > MEMO // 8:
            self.long = {}
        return out, np.searchsorted(ends, starts, "right")


def canonical(codes: np.ndarray, doc: np.ndarray, way: int) -> tuple[np.ndarray, np.ndarray]:
    """Canonical codes and the word each came from. doc: the text of each word; nothing reaches over its border."""
    kind = (codes >> np.uint64(3)) & np.uint64(3)
    at = np.flatnonzero(kind != SKIP)
    if way == PLAIN or not len(at):
        return codes[at] >> np.uint64(5), at
    ends = (codes & np.uint64(1)).astype(bool)
    first = np.r_[True, doc[1:] != doc[:-1]]
    opens = np.r_[True, ends[:-1]] | first
    # A word opens a sentence also if only punctuation stands between it and the sentence's end.
    if len(at) < len(codes):
        seen = np.cumsum(opens)
        opens = np.r_[seen[at[0]] > 0, np.diff(seen[at]) > 0]
        kind, codes, doc = kind[at], codes[at], doc[at]
    out = codes >> np.uint64(5)
    name = (kind == LITERAL) & (codes & np.uint64(4) > 0)
    if way == INSIDE:
        name &= ~opens
    same = np.r_[False, doc[1:] == doc[:-1]]
    before_num = np.r_[False, kind[:-1] == NUM] & same
    unit = (kind == LITERAL) & (codes & np.uint64(2) > 0) & before_num
    out[kind == NUM], out[unit], out[name] = NUM_CODE, UNIT_CODE, NAME_CODE
    again = name & np.r_[False, name[:-1]] & same
    return out[~again], at[~again]


def windows(canon: np.ndarray, size: int, way: int) -> np.ndarray:
    """Hashes of all runs of `size` codes, other ones for each way to read."""
    n = len(canon) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    mixed = (canon ^ (canon >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    out = np.full(n, 1 + way * 64 + size, np.uint64)
    for j in range(size):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + mixed[j : j + n]
    return out ^ (out >> np.uint64(32))


def item_windows(codes: np.ndarray, window: int, way: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Size and hashes of an item's windows, and which are rich enough in words to say something."""
    size = min(window, len(codes))
    h = windows(codes, size, way)
    literal = np.r_[0, np.cumsum(codes > 33)]
    return size, h, 2 * (literal[size:] - literal[:-size]) >= size


class Items:
    """Templates of items, read in one way."""

    def __init__(self, rows: Iterable[tuple[int, str]], window: int, min_words: int, way: int, canon: Canon) -> None:
        self.canon: list[np.ndarray] = []
        self.values: list[Values] = []
        self.ids: list[int] = []
        self.size: list[int] = []
        #: Of each item, the starts of windows that are mostly placeholders.
        self.poor: list[list[int]] = []
        self.table: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in rows:
            codes, at = canonical(*canon([text.encode()]), way)
            if len(codes) < min_words:
                continue
            size, hashes, rich = item_windows(codes, window, way)
            for pos in np.flatnonzero(rich).tolist():
                self.table[int(hashes[pos])].append((len(self.ids), pos))
            self.ids.append(item_id)
            self.canon.append(codes)
            self.values.append(Values(text.split(), at))
            self.size.append(size)
            self.poor.append(np.flatnonzero(~rich).tolist())
        self.hashes = np.array(sorted(self.table), np.uint64)


class Values:
    """The text that stands for each canonical word: up to the next one's start, so a name keeps all its words."""

    def __init__(self, words: list[str], at: np.ndarray) -> None:
        self.words, self.at = words, [*at.tolist(), len(words)]

    def __getitem__(self, k: int) -> str:
        return " ".join(filter(None, (_OUTER.sub("", w).lower() for w in self.words[self.at[k] : self.at[k + 1]])))


def judged(items: Items, k: int, pairs: list[tuple[int, int]], canon: np.ndarray, values: Values, cover: float) -> tuple | None:
    """pairs: matching window starts in item k and in the document. The best alignment's verdict, or None."""
    size, n = items.size[k], len(items.canon[k])
    diagonals = sorted(pairs, key=lambda p: (p[1] - p[0], p[0]))
    best: tuple[int, int, dict[int, int]] | None = None
    start = 0
    spans = []
    for i in range(1, len(diagonals) + 1):  # windows on one diagonal or near it belong to one copy of the item
        if i == len(diagonals) or (diagonals[i][1] - diagonals[i][0]) - (diagonals[i - 1][1] - diagonals[i - 1][0]) > DRIFT:
            spans.append(diagonals[start:i])
            start = i
    for group in spans:
        to: dict[int, int] = {}
        for p, d in group:
            for j in range(size):
                to.setdefault(p + j, d + j)
        mapping: dict[tuple[int, str], str] = {}
        if not _agree(items, k, to.items(), values, mapping):
            continue
        for by in sorted({d - p for p, d in group}):
            for p in items.poor[k]:
                if 0 <= p + by <= len(canon) - size and np.array_equal(items.canon[k][p : p + size], canon[p + by : p + by + size]):
                    more = [(q, q + by) for q in range(p, p + size) if q not in to]
                    if more and _agree(items, k, more, values, tried := dict(mapping)):
                        mapping = tried
                        to.update(more)
        if len(to) < cover * n:
            continue
        slots = changed = 0
        for p, d in to.items():
            if int(items.canon[k][p]) <= 33:
                slots += 1
                changed += items.values[k][p] != values[d]
        if best is None or len(to) > best[0]:
            best = (len(to), min(to.values()), {"slots": slots, "changed": changed})
    if best is None:
        return None
    return best[0] / n, best[1], best[2]["slots"], best[2]["changed"]


def _agree(items: Items, k: int, pairs: Iterable[tuple[int, int]], values: Values, mapping: dict[tuple[int, str], str]) -> bool:
    """Whether each value of the item meets one value of the document; mapping gets them."""
    for p, d in pairs:
        if (code := int(items.canon[k][p])) <= 33 and mapping.setdefault((code, items.values[k][p]), values[d]) != values[d]:
            return False
    return True


SCHEMA = "doc_id long, item_id long, coverage double, n_slots int, n_changed int, kind string, word_start long"


def judged_text(text: str, read: list[Items], canon: Canon, cover: float) -> list[tuple]:
    """(item_id, coverage, n_slots, n_changed, kind, word_start) for each item that the text holds: the best of the three ways. read: the items in each way."""
    words = text.split()
    codes, doc = canon([text.encode()])
    best: dict[int, tuple] = {}
    for way, items in zip(WAYS, read, strict=True):
        own, at = canonical(codes, doc, way)
        values = Values(words, at)
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for size in set(items.size):
            h = windows(own, size, way)
            for i in np.flatnonzero(np.isin(h, items.hashes)).tolist():
                for k, pos in items.table[int(h[i])]:
                    hits[k].append((pos, i))
        for k, pairs in hits.items():
            if got := judged(items, k, pairs, own, values, cover):
                share, first, slots, changed = got
                found = (items.ids[k], share, slots, changed, "reparameterised" if changed else "verbatim", int(at[first]))
                if items.ids[k] not in best or share > best[items.ids[k]][1]:
                    best[items.ids[k]] = found
    return list(best.values())


class Filter:
    """Bits for hashes: no hash that was put in is missed. Slices of 64 kB, those without a bit left out."""

    SLICE = 1 << 19

    def __init__(self, bits: int, slices: dict[int, bytes]) -> None:
        self.bits = bits
        self.held = np.zeros(bits // 8, np.uint8)
        for k, raw in slices.items():
            self.held[k * self.SLICE // 8 : (k + 1) * self.SLICE // 8] = np.frombuffer(raw, np.uint8)

    @staticmethod
    def places(h: np.ndarray, bits: int, probe: int) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15 + 2 * probe)) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)

    def has(self, h: np.ndarray) -> np.ndarray:
        """Which may be in."""
        left = np.arange(len(h))
        for probe in range(PROBES):
            at = self.places(h[left], self.bits, probe)
            left = left[(self.held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
        return left


def _benchmark_windows(items: DataFrame, window: int, min_words: int) -> DataFrame:
    """h, size, item_id, item_hash of the benchmark's windows that say something."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        for batch in batches:
            for item, mark, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                codes, doc = canon([text.encode()])
                for way in WAYS:
                    own, _ = canonical(codes, doc, way)
                    if len(own) >= min_words:
                        size, h, rich = item_windows(own, window, way)
                        h = np.unique(h[rich])
                        n = len(h)
                        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([size] * n, pa.int32()), pa.array([item] * n, pa.int64()), pa.array([mark] * n, pa.int64())], ["h", "size", "item_id", "item_hash"])

    return items.select("item_id", "item_hash", "text").mapInArrow(run, "h long, size int, item_id long, item_hash long")


def _filter(index: DataFrame) -> tuple[Filter, list[int]]:
    """The filter of all windows, and their sizes. Its slices are merged by the cluster; it is never larger than MOST_BITS."""
    n = index.count()
    bits = min(MOST_BITS, max(Filter.SLICE, 1 << (BITS * max(1, n) - 1).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            at = np.unique(np.concatenate([Filter.places(h, bits, p) for p in range(PROBES)]))
            for k in np.unique(at // Filter.SLICE).tolist():
                own = np.zeros(Filter.SLICE, bool)
                own[at[at // Filter.SLICE == k] % Filter.SLICE] = True
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], ["slice", "held"])

    def merge(group: pa.Table) -> pa.Table:
        held = np.bitwise_or.reduce([np.frombuffer(x.as_buffer(), np.uint8) for x in group["held"]])
        return pa.table({"slice": group["slice"][:1], "held": pa.array([held.tobytes()], pa.binary())})

    merged = index.select("h").mapInArrow(mark, "slice int, held binary").groupBy("slice").applyInArrow(merge, "slice int, held binary").collect()
    sizes = sorted(r["size"] for r in index.select("size").distinct().collect())  # from MIN_WORDS to WINDOW
    return Filter(bits, {r["slice"]: bytes(r["held"]) for r in merged}), sizes


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS, cover: float = COVER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row and benchmark item that it holds: coverage of the item's words, slots, how many changed, kind.

    Items whose windows are all mostly placeholders are found verbatim, not re-parameterised. Null and empty texts hold
    nothing; items of fewer than `min_words` words, or without an id, take no part. Repeated rows of a document
    each give their rows; repeated items with one id and text count once, of several texts with one id the best counts.
    A null doc_id is kept. Extra columns are not read. Empty tables give no rows.
    """
    return _found(docs, benchmark, window, min_words, cover, id_col, text_col).select("doc_id", "item_id", "coverage", "n_slots", "n_changed", "kind", "word_start")


def _found(docs: DataFrame, benchmark: DataFrame, window: int, min_words: int, cover: float, id_col: str, text_col: str) -> DataFrame:
    """The rows of leaks(), with two hashes of the text."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).distinct()
    items = written(items.withColumn("item_hash", F.xxhash64("text")), "items")
    index = written(_benchmark_windows(items, window, min_words), "windows")
    box = spark.sparkContext.broadcast(_filter(index))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (keep, sizes), canon, part, n = box.value, Canon(), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                rows, lists = [], []
                codes, doc = canon([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in some.column(1)])
                hits = [np.zeros((2, 0), np.uint64)]
                for way in WAYS:
                    own, at = canonical(codes, doc, way)
                    of = doc[at]
                    for size in sizes:
                        h = windows(own, size, way)
                        i = keep.has(h)
                        i = i[of[i] == of[i + size - 1]]
                        hits.append(np.stack([of[i].astype(np.uint64), h[i]]))
                of, h = np.concatenate(hits, axis=1)
                order = np.lexsort((h, of))
                of, h = of[order], h[order]
                new = np.r_[True, (of[1:] != of[:-1]) | (h[1:] != h[:-1])] if len(of) else np.zeros(0, bool)
                of, h = of[new].astype(np.int64), h[new].view(np.int64)
                rows, begin = np.unique(of, return_index=True)
                if len(rows):
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(h)], pa.int32()), pa.array(h))
                    names = pa.array([f"{part}-{n + k}" for k in range(len(rows))])
                    n += len(rows)
                    yield pa.RecordBatch.from_arrays([names, *(c.take(pa.array(rows)) for c in some.columns), lists], ["row", "doc_id", "text", "t1", "t2", "h"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t1"), F.xxhash64(F.lit(1), text_col).alias("t2"))
    likely = written(rows.mapInArrow(scan, "row string, doc_id long, text string, t1 long, t2 long, h array<long>"), "likely")
    pairs = likely.select("row", F.explode("h").alias("h")).join(index.select("h", "item_id", "item_hash"), "h").select("row", "item_id", "item_hash").distinct()
    given = pairs.join(items, ["item_id", "item_hash"]).groupBy("row", F.pmod(F.xxhash64("item_id"), F.lit(ITEM_PARTS)).alias("part")).agg(F.collect_list(F.struct("item_id", "text")).alias("items"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon, read = Canon(), {}
        for batch in batches:
            for k in range(batch.num_rows):
                doc_id, text, t1, t2, near = (batch.column(i)[k].as_py() for i in range(5))
                rows = tuple(sorted((i["item_id"], i["text"]) for i in near))
                if rows not in read:
                    if len(read) >= READ:
                        read.clear()
                    read[rows] = [Items(rows, window, min_words, way, canon) for way in WAYS]
                found = judged_text(text, read[rows], canon, cover)
                if found:
                    cols = [[doc_id] * len(found), *zip(*found, strict=True), [t1] * len(found), [t2] * len(found)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()], strict=True)], ["doc_id", "item_id", "coverage", "n_slots", "n_changed", "kind", "word_start", "t1", "t2"])

    return likely.drop("h").join(given, "row").select("doc_id", "text", "t1", "t2", "items").mapInArrow(judge, SCHEMA + ", t1 long, t2 long")


def without_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS, cover: float = COVER, text_col: str = "text") -> DataFrame:
    """docs, all columns, without rows that hold a benchmark item. Which these are depends on the text alone."""
    at = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    gone = written(_found(at, benchmark, window, min_words, cover, "doc_id", "text").select(F.col("t1").alias("__t1"), F.col("t2").alias("__t2")).distinct(), "leaky")
    if gone.count() <= FEW:
        gone = F.broadcast(gone)
    same = (F.xxhash64(docs[text_col]) == F.col("__t1")) & (F.xxhash64(F.lit(1), docs[text_col]) == F.col("__t2"))
    return docs.join(gone, same, "left_anti")


def op9(spark, sf_dir):  # noqa: ANN001, ANN201
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
