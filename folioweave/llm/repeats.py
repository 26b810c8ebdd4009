"""Suffix-array dedup: remove every byte that lies in a string of WIDTH bytes that also starts earlier.

A suffix array of all bytes is more than any budget holds, so positions that can't repeat are set aside first:

1. Every window of WIDTH bytes has an anchor: the GRAM bytes in it with the smallest hash, the leftmost of equals. The
   anchor depends on the window's content only, so equal windows have equal anchors at equal offsets. Consecutive
   windows share an anchor; each such run is one row with a hash of the anchor and one of all bytes that its windows
   cover. Equal texts are taken once: a later copy of WIDTH bytes or more goes as a whole.
2. Runs whose anchor is nowhere else are unique. Among runs with equal anchors and equal covered bytes, all but the
   earliest repeat it in every window.
3. Where one anchor has different surroundings, the covered bytes of each different run go to the same task. There a
   suffix array over them is built by two-stage sorting; suffixes that follow each other with WIDTH bytes in common
   are equal windows, and all but the earliest are repeats.

Earlier means smaller doc_id, then smaller start; null ids come last; texts that share an id are ordered by a hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioweave.llm.common import apart, drop_written, free_shuffles, fresh_path, table, written
from folioweave.llm.hashing import BASE, INVERSE, mixed, powers, prefix
from folioweave.llm.suffix_array import common_prefixes, suffix_array

WIDTH = 100
GRAM = 20
BLOCK = 1 << 21
#: Anchors that a task remembers as known to be elsewhere.
OFTEN = 500_000
#: A suffix array covers pieces of whole anchors until it has this many bytes.
SORTED_BYTES = 1 << 20
_AT = np.uint64((1 << 24) - 1)
LAST = (1 << 63) - 1


def runs(texts: list[bytes], width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of texts of at least `width` bytes, below 2**24 in all: text, anchor hash, covered hash, first window, windows less one."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    sums = prefix(buf)
    back = powers(INVERSE, len(buf) + 1)
    n = len(buf) - gram + 1
    h = mixed((sums[gram:] - sums[:n]) * back[:n])
    key = (h & ~_AT) | np.arange(n, dtype=np.uint64)
    span = width - gram + 1
    rows = -(-n // span) + 1
    padded = np.full(rows * span, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    grid = padded.reshape(rows, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - span + 1], ahead[span - 1 : n])
    starts = np.cumsum(size) - size
    count = size - width + 1
    doc = np.repeat(np.arange(len(texts)), count)
    at = np.arange(count.sum()) + np.repeat(starts - (np.cumsum(count) - count), count)
    anchor = (least[at] & _AT).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
    end = np.r_[new[1:], len(at)] - 1
    lo, hi, a = at[new], at[end], anchor[new]
    covered = (sums[hi + width] - sums[lo]) * back[lo]
    covered = mixed(covered + (a - lo).astype(np.uint64) * np.uint64(BASE) + (hi - lo).astype(np.uint64))
    d = doc[new]
    return d, h[a].view(np.int64), covered.view(np.int64), lo - starts[d], hi - lo


def known_shared(q: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose anchor is known to be elsewhere, too, and the sorted anchors that are known now. Two rows of each new one aren't among them."""
    anchors, which, count = np.unique(q, return_inverse=True, return_counts=True)
    known = np.isin(anchors, often)
    order = np.argsort(which, kind="stable")
    nth = np.empty(len(q), np.int64)
    nth[order] = np.arange(len(q)) - (np.cumsum(count) - count)[which[order]]
    more = anchors[(count > 2) & ~known]
    return known[which] | (nth >= 2), np.union1d(often, more) if len(often) < OFTEN else often


def _anchored(width: int, gram: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        often = np.zeros(0, np.int64)

        def rows(texts: list[bytes], ids: list[int], offset: int = 0) -> pa.RecordBatch:
            nonlocal often
            d, q, ctx, lo, n = runs(texts, width, gram)
            shared, often = known_shared(q, often)
            return pa.RecordBatch.from_arrays([pa.array(np.array(ids)[d]), pa.array(q), pa.array(ctx), pa.array((lo + offset).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(shared)], ["tid", "q", "ctx", "lo", "n", "shared"])

        for batch in batches:
            texts, ids, held = [], [], 0
            for tid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if tid in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(tid)
                raw = text.as_py().encode()
                if len(raw) < width:
                    continue
                if len(raw) > 2 * BLOCK:  # a long text in pieces that overlap by all but one byte of a window
                    for a in range(0, len(raw) - width + 1, BLOCK):
                        yield rows([raw[a : a + BLOCK + width - 1]], [tid], a)
                    continue
                texts.append(raw)
                ids.append(tid)
                held += len(raw)
                if held >= BLOCK:
                    yield rows(texts, ids)
                    texts, ids, held = [], [], 0
            if texts:
                yield rows(texts, ids)

    return run


def _sorted_pieces(width: int):  # noqa: ANN202
    """Over rows sorted by anchor: tid, lo, n of windows that repeat earlier ones."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        first, tid, lo, raw = zip(*rows, strict=True)
        size = np.array([len(r) for r in raw])
        starts = np.cumsum(size + 1) - size - 1
        joined = np.frombuffer(b"\xff".join(raw) + b"\xff", np.uint8)
        text = joined + np.uint8(1)  # UTF-8 has no byte 255: it becomes the 0 between and after the pieces
        order = suffix_array(text, width)
        same = common_prefixes(text, order, width) >= width
        piece = np.searchsorted(starts, order, side="right") - 1
        inside = order - starts[piece]
        group = np.cumsum(~same)
        full = inside + width <= size[piece]
        sized = np.bincount(group[full], minlength=group[-1] + 1) > 1
        use = np.flatnonzero(full & sized[group])
        # Earliest of each group by document, text and start.
        f, t, p = np.array(first)[piece[use]], np.array(tid)[piece[use]], np.array(lo)[piece[use]] + inside[use]
        by = np.lexsort((p, t, f, group[use]))
        g = group[use][by]
        repeat = np.r_[False, g[1:] == g[:-1]] if len(g) else np.zeros(0, bool)
        t, p = t[by][repeat], p[by][repeat]
        by = np.lexsort((p, t))
        t, p = t[by], p[by]
        new = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (p[1:] > p[:-1] + 1)]) if len(t) else np.zeros(0, np.int64)
        end = np.r_[new[1:], len(t)] - 1 if len(t) else new
        return pa.RecordBatch.from_arrays([pa.array(t[new], pa.int64()), pa.array(p[new].astype(np.int32)), pa.array((p[end] - p[new]).astype(np.int32))], ["tid", "lo", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, last = [], 0, None
        for batch in batches:
            for q, first, tid, lo, raw in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held >= SORTED_BYTES and q != last:
                    yield solve(rows)
                    rows, held = [], 0
                rows.append((first, tid, lo, raw))
                held += len(raw)
                last = q
        if rows:
            yield solve(rows)

    return run


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start and end of each removed run).

    Texts are UTF-8 bytes, null counts as empty. Of repeated rows with one id and text, one is the first and the
    others are copies. Extra columns are not read; an empty table gives no rows. Texts are told apart by 128 bits, of which
    the first 64 are their number; fewer `bits` are for tests of collisions.
    """
    spark = docs.sparkSession
    made: list[str] = []

    def keep(df: DataFrame, tag: str) -> DataFrame:
        made.append(fresh_path(spark, tag))
        out = written(df, tag, made[-1])
        free_shuffles(spark)
        return out

    text = F.coalesce(F.col(text_col), F.lit(""))
    number = F.xxhash64(text) if bits == 64 else F.pmod(F.xxhash64(text), F.lit(1 << bits))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("ord"), number.alias("tid"), F.xxhash64(F.lit(1), text).alias("check"), text.alias("text"))
    rows = apart(rows, "tid", "check")
    firsts = rows.groupBy("tid").agg(F.min("ord").alias("first"))
    found = rows.select("tid", "text").mapInArrow(_anchored(width, gram), "tid long, q long, ctx long, lo int, n int, shared boolean")
    # An anchor that is in many places would gather them all; those that a task knows to be shared needn't meet the others.
    dealt = F.when(F.col("shared"), F.xxhash64("tid", "lo")).otherwise(F.col("q"))
    by_q = Window.partitionBy("at_q")
    place = F.struct("tid", "lo")
    placed = found.withColumn("at_q", dealt).withColumn("a", F.min(place).over(by_q)).withColumn("b", F.max(place).over(by_q))
    shared = placed.where(F.col("shared") | (F.col("a") != F.col("b"))).select("q", "ctx", "tid", "lo", "n")
    shared = keep(shared, "shared")
    placed = shared.join(firsts, "tid")
    earliest = placed.groupBy("q", "ctx").agg(F.min(F.struct("first", "tid", "lo", "n")).alias("r"))
    earliest = keep(earliest, "earliest")
    copies = shared.join(earliest, ["q", "ctx"]).where((F.col("tid") != F.col("r.tid")) | (F.col("lo") != F.col("r.lo"))).select("tid", "lo", "n")
    copies = keep(copies, "copies")
    several = earliest.groupBy("q").agg(F.min("ctx").alias("u"), F.max("ctx").alias("v")).where("u <> v").select("q")
    open_runs = earliest.join(several, "q").select("q", "r.first", "r.tid", "r.lo", "r.n")
    wanted = open_runs.groupBy("tid", "first").agg(F.collect_list(F.struct("q", "lo", "n")).alias("runs"))
    cut = rows.join(wanted.withColumnsRenamed({"tid": "__tid"}), (F.col("ord") == F.col("first")) & (F.col("tid") == F.col("__tid"))).select("first", "tid", "text", "runs")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw, todo = batch.column(2)[i].as_py().encode(), batch.column(3)[i].as_py()
                cols = [[r["q"] for r in todo], [batch.column(0)[i].as_py()] * len(todo), [batch.column(1)[i].as_py()] * len(todo), [r["lo"] for r in todo], [raw[r["lo"] : r["lo"] + r["n"] + width] for r in todo]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()], strict=True)], ["q", "first", "tid", "lo", "raw"])

    cut_out = keep(cut.mapInArrow(pieces, "q long, first long, tid long, lo int, raw binary").distinct(), "pieces")
    repeats = keep(cut_out.repartition("q").sortWithinPartitions("q").mapInArrow(_sorted_pieces(width), "tid long, lo int, n int"), "repeats")
    drop_written(spark, *[p for p in made if "/shared-" in p or "/earliest-" in p or "/pieces-" in p])
    spans = copies.unionByName(repeats).groupBy("tid").agg(F.collect_list(F.struct("lo", "n")).alias("runs"))
    of_first = firsts.join(spans, "tid", "left").select(F.col("first").alias("ord"), "tid", F.lit(True).alias("is_first"), "runs")
    joined = rows.select("doc_id", "text", "ord", "tid").join(of_first, ["ord", "tid"], "left")
    once = joined.withColumn("at", F.row_number().over(Window.partitionBy("ord", "tid").orderBy("ord")))
    final = once.select("doc_id", "text", (F.coalesce("is_first", F.lit(False)) & (F.col("at") == 1)).alias("is_first"), "runs")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_judged(text.as_py().encode(), first, todo, width) for text, first, todo in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]) if out else pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([], k) for k in kinds]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return final.mapInArrow(judge, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")


def _judged(raw: bytes, first: bool, todo: list[dict] | None, width: int) -> tuple[int, int, int, str, list[list[int]]]:
    if not first:
        spans = [[0, len(raw)]] if len(raw) >= width else []
    else:
        spans = []
        for lo, hi in sorted((r["lo"], r["lo"] + r["n"] + width) for r in todo or ()):
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], hi)
            else:
                spans.append([lo, hi])
    digest, at = hashlib.sha256(), 0
    for lo, hi in spans:
        digest.update(raw[at:lo])
        at = hi
    digest.update(raw[at:])
    return len(raw), sum(b - a for a, b in spans), len(spans), digest.hexdigest(), spans


def op10(spark, sf_dir):  # noqa: ANN001, ANN201
    return repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
