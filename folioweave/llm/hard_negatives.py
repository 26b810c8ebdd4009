"""Hard negatives by a Voronoi-partition kNN join.

Scores are inner products of whole numbers. With a coordinate sqrt(M - |s|^2) for candidates and 0 for anchors, M being the
largest squared norm, the squared distance of anchor a and candidate s is |a|^2 + M - 2 a.s: the nearest are those of the
highest score. Anchors go to the cell of their nearest pivot, near cells share a group, and for each cell the distances
of its anchors from the pivot are known (U at most, L at least) and how far its anchors have to look (H at most):

- positives: H from the cells' summaries; a label's k + 1 candidates nearest to their own pivots bound how far the k-th is
- negatives: H from the score that is the least a negative may have, and from the highest one how near is too near

A candidate at d from a cell's pivot can serve that cell only if d - U, L - d and its distance from the hyperplane between
the cell and its own are all at most H, and if d + U isn't too near. It is sent to the groups with such a cell, and joined
there exactly. Groups of many anchors are split, and candidates are dealt into slices by a hash, so no task holds more than
a bounded number of either; the best of a task are merged by anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioweave.llm.common import table, written

#: Pivots, at most: rows that come first by a hash of their id.
PIVOTS = 128
#: Groups of anchors, at least; rows of either side in a task, at most; candidates of a slice, at least; rows of a label that has one group.
GROUPS, SIDE, SLICE, SMALL = 8, 1 << 16, 1 << 12, 512
#: Labels of which the sizes come to the driver: the largest ones.
LARGEST = 4096
#: Rows of either side that are multiplied at a time.
TILE_A, TILE_C = 512, 4096
#: Squared norms from here on don't leave scores that fit a long with room to compare their hundredfold.
NORM = float(1 << 56)
NONE = -(2**63 - 1)


def whole(vec: Column) -> Column:
    """floor(256 * x) of each component, taken as double; rows must pass `usable`."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * 256).cast("int"))


def usable(vec: Column) -> Column:
    """Not null, no null or non-finite component, and not so long that scores don't fit."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * 256) >= float(1 << 28)))
    norm = F.aggregate(vec, F.lit(0.0), lambda s, x: s + F.floor(x.cast("double") * 256).cast("double") * F.floor(x.cast("double") * 256).cast("double"))
    return F.coalesce(vec.isNotNull() & ~bad & (norm < NORM), F.lit(False))


class Best:
    """The k best of each row: by score downwards, then by id."""

    def __init__(self, rows: int, k: int) -> None:
        self.k, self.score, self.ids = k, np.full((rows, k), NONE, np.int64), np.full((rows, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """rows ascending."""
        if not len(rows):
            return
        hit, many = np.unique(rows, return_counts=True)
        every = [np.concatenate(x) for x in ((np.repeat(hit, self.k), rows), (self.ids[hit].ravel(), ids), (self.score[hit].ravel(), score))]
        order = np.lexsort((every[1], -every[2], every[0]))
        first = np.concatenate([[0], np.cumsum(many + self.k)[:-1]])
        best = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.ids[hit], self.score[hit] = every[1][best].reshape(-1, self.k), every[2][best].reshape(-1, self.k)

    def search(self, at: slice, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> None:
        """Take up a tile for the rows `at`: only what is allowed and in the bounds."""
        floor = self.score[at, -1] if lo is None else np.maximum(self.score[at, -1], lo)
        wanted = allowed & (scores >= floor.astype(scores.dtype)[:, None])
        if hi is not None:
            wanted &= scores <= hi.astype(scores.dtype)[:, None]
        if scores.shape[1] > self.k and wanted.sum() > 4 * self.k * len(scores):
            # The k-th best of the tile bounds, too.
            wanted &= scores >= np.partition(np.where(wanted, scores, np.array(NONE, scores.dtype)), -self.k, axis=1)[:, -self.k, None]
        rows, cols = np.nonzero(wanted)
        self.add(rows + at.start, ids[cols], scores[rows, cols].astype(np.int64))


def products(a: np.ndarray, c: np.ndarray) -> Callable[[slice, slice], np.ndarray]:
    """Exact inner products of tiles: in single or double precision where sums stay below 2**24 or 2**53, else in integers."""
    most = float(np.sqrt((a.astype(np.float64) ** 2).sum(1)).max(initial=0) * np.sqrt((c.astype(np.float64) ** 2).sum(1)).max(initial=0)) * (1 + 1e-9)
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    a, c = a.astype(kind), c.astype(kind)
    return lambda i, j: a[i] @ c[j].T


@dataclass
class Space:
    """Pivots in the space with the added coordinate; rows are padded to `width`."""

    pivots: np.ndarray
    most: float
    width: int
    kind: np.dtype

    def __post_init__(self) -> None:
        self.between = np.sqrt(np.maximum(((self.pivots[:, None] - self.pivots[None]) ** 2).sum(2), 0))
        #: Distances are off by less than this through rounding.
        self.slack = 4e-6 * np.sqrt(self.most) + 1e-9

    @classmethod
    def of(cls, sample: list, most: float, width: int, largest: int) -> Space:
        q = np.array([[*r["q"], *[0] * (width - len(r["q"]))] for r in sample], np.float64).reshape(len(sample), width)
        rest = np.sqrt(np.maximum(most - (q * q).sum(1), 0))
        return cls(np.unique(np.c_[q, rest], axis=0), most, width, np.dtype(np.int16 if largest < 1 << 15 else np.int32))

    def candidates(self, q: np.ndarray) -> np.ndarray:
        """Their distances from all pivots."""
        rest = np.sqrt(np.maximum(self.most - (q * q).sum(1), 0))
        return np.sqrt(np.maximum(2 * self.most - 2 * (q @ self.pivots[:, :-1].T + rest[:, None] * self.pivots[None, :, -1]), 0))

    def anchors(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + self.most - 2 * (q @ self.pivots[:, :-1].T), 0))

    def matrix(self, batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(batch.schema.names.index("q")).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, self.width)

    def packed(self, q: np.ndarray) -> pa.Array:
        raw = np.ascontiguousarray(q.astype(self.kind))
        size = self.width * self.kind.itemsize
        return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(np.arange(len(raw) + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(raw.tobytes())])

    def unpacked(self, column: pa.ChunkedArray) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), self.kind).reshape(len(column), self.width)


@dataclass
class Cells:
    """What is known of the cells that have anchors: U, L and the groups; H and `near` (no nearer than that) of a search."""

    cell: np.ndarray
    far: np.ndarray
    least: np.ndarray
    first: np.ndarray
    split: np.ndarray
    groups: int
    reach: np.ndarray | None = None
    near: np.ndarray | None = None

    @classmethod
    def of(cls, rows: list, space: Space) -> Cells:
        """rows: a row for each cell: cell, n, far, least. Neighbouring cells share a group up to a bounded number of anchors."""
        by = {r["cell"]: r for r in rows}
        left, path = set(by), []
        while left:
            path.append(min(left, key=lambda i: (space.between[path[-1], i] if path else 0, i)))
            left.remove(path[-1])
        share = max(1, min(SIDE, -(-sum(r["n"] for r in rows) // GROUPS)))
        first, split, g, held = {}, {}, -1, share
        for i in path:
            n = by[i]["n"]
            if n > SIDE:
                g, held = g + 1, share
                first[i], split[i] = g, -(-n // SIDE)
                g += split[i] - 1
                continue
            if held + n > share:
                g, held = g + 1, 0
            first[i], split[i], held = g, 1, held + n
        order = sorted(by)
        col = lambda d, kind: np.array([d[i] for i in order], kind)
        return cls(np.array(order, np.int64), col({i: by[i]["far"] for i in by}, float), col({i: by[i]["least"] for i in by}, float), col(first, np.int64), col(split, np.int64), g + 1)

    def looking(self, rows: list) -> Cells:
        """rows: cell, reach, near. Cells without one look nowhere."""
        known = {r["cell"]: r for r in rows}
        reach = np.array([known[i]["reach"] if i in known else -np.inf for i in self.cell.tolist()])
        near = np.array([known[i]["near"] if i in known else np.inf for i in self.cell.tolist()])
        return Cells(self.cell, self.far, self.least, self.first, self.split, self.groups, reach, near)

    def group(self, cell: np.ndarray, ids: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.cell, cell)
        return self.first[at] + (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % self.split[at]

    def served(self, d: np.ndarray, space: Space) -> np.ndarray:
        """Which groups each candidate, at d from all pivots, might serve."""
        own = d.argmin(1)
        from_pivot = d[:, self.cell]
        apart = space.between[own][:, self.cell]
        plane = (from_pivot**2 - d[np.arange(len(d)), own][:, None] ** 2) / np.where(apart > 0, 2 * apart, np.inf)
        bound = np.maximum(np.maximum(from_pivot - self.far, self.least - from_pivot), plane)
        may = (bound <= self.reach + space.slack) & (from_pivot + self.far >= self.near - space.slack)
        out = np.zeros((len(d), self.groups), bool)
        for i, (g, s) in enumerate(zip(self.first.tolist(), self.split.tolist(), strict=True)):
            out[:, g : g + s] |= may[:, i, None]
        return out


def slices(n: int, cores: int) -> int:
    return max(-(-n // SIDE), min(-(-n // SLICE), cores), 1)


def summaries(rows: DataFrame, space: Space, k: int) -> list:
    """For each cell: the number of anchors, the greatest and least distance from the pivot, and how far positives may be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = space.matrix(batch).astype(np.float64)
            label = batch.column(batch.schema.names.index("label")).to_numpy()
            anchor = np.asarray(batch.column(batch.schema.names.index("is_anchor")))
            d = space.candidates(q)
            cell, own = d.argmin(1), d.min(1)
            order = np.lexsort((own, cell, label))
            new = np.r_[True, (np.diff(label[order]) != 0) | (np.diff(cell[order]) != 0)] if len(order) else np.zeros(0, bool)
            nth = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            few = order[nth <= k]  # more of a label and cell than these say nothing
            e = space.anchors(q[anchor])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[label[few], label[anchor]]), pa.array(np.r_[cell[few], e.argmin(1)].astype(np.int32)), pa.array(np.r_[own[few], e.min(1)]), pa.array(np.r_[np.zeros(len(few), bool), np.ones(len(e), bool)])],
                ["label", "cell", "d", "is_anchor"],
            )

    every = rows.select("label", "q", "is_anchor").mapInArrow(run, "label long, cell int, d double, is_anchor boolean")
    nth = F.row_number().over(Window.partitionBy("label", "cell").orderBy("d"))
    nearest = every.where("not is_anchor").withColumn("r", nth).where(F.col("r") <= k + 1).select("label", "cell", "d", F.lit(None).cast("double").alias("least"), F.lit(0).cast("long").alias("n"))
    own = every.where("is_anchor").groupBy("label", "cell").agg(F.max("d").alias("d"), F.min("d").alias("least"), F.count(F.lit(1)).alias("n"))

    def bounds(pdf: pd.DataFrame) -> pd.DataFrame:
        """A label's: of each cell with anchors, how far the k-th of its candidates can be. As many rows as pivots and k allow."""
        a, c = pdf[pdf["n"] > 0], pdf[pdf["n"] == 0]
        ends = np.sort(a["d"].to_numpy()[:, None] + space.between[a["cell"].to_numpy()][:, c["cell"].to_numpy()] + c["d"].to_numpy()[None, :], axis=1)
        return pd.DataFrame({"cell": a["cell"], "n": a["n"], "far": a["d"], "least": a["least"], "reach": ends[:, min(k, ends.shape[1] - 1)] if len(a) else np.zeros(0)})

    labels = nearest.unionByName(own.select("label", "cell", "d", "least", "n")).groupBy("label").applyInPandas(bounds, "cell int, n long, far double, least double, reach double")
    return labels.groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.min("least").alias("least"), F.max("reach").alias("reach")).withColumn("near", F.lit(0.0)).collect()


#: What goes to a join: the key, whether a candidate, and of anchors what their search needs.
_SENT = "label long, g int, s int, candidate boolean, vec_id long, own long, v binary, positives array<long>, scores array<long>"


def sent(rows: DataFrame, space: Space, cells: Cells, candidate: bool, parts: Callable[[np.ndarray], np.ndarray], apart: bool, single: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Rows with the groups and slices that they go to. parts: the number of slices by label; apart: labels are joined apart; single: labels of one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, TILE_C):
                batch = whole_batch.slice(start, TILE_C)
                named = dict(zip(batch.schema.names, batch.columns, strict=True))
                q, ids, label = space.matrix(batch), named["vec_id"].to_numpy(), named["label"].to_numpy()
                f = q.astype(np.float64)
                many = parts(label)
                one = single(label) if single else np.zeros(len(label), bool)
                if candidate:
                    to = cells.served(space.candidates(f), space)
                    to[one, 0] = to[one].any(1)
                    to[one, 1:] = False
                    row, g = np.nonzero(to)
                    s = (ids.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(33)).astype(np.int64)[row] % many[row]
                else:
                    g = np.where(one, 0, cells.group(space.anchors(f).argmin(1), ids))
                    row = np.repeat(np.arange(len(ids)), many)
                    g, s = g[row], np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                # Copies by the thousand, so that a batch stays small.
                for at in range(0, max(len(row), 1), 16 * TILE_C):
                    r = row[at : at + 16 * TILE_C]
                    none = pa.nulls(len(r), pa.list_(pa.int64()))
                    key = pa.array(label[r] if apart else np.zeros(len(r), np.int64))
                    more = [named[c].take(pa.array(r)) if c in named else none for c in ("positives", "scores")]
                    yield pa.RecordBatch.from_arrays(
                        [key, pa.array(g[at : at + 16 * TILE_C].astype(np.int32)), pa.array(s[at : at + 16 * TILE_C].astype(np.int32)), pa.array(np.full(len(r), candidate)), pa.array(ids[r]), pa.array(label[r]), space.packed(q[r]), *more],
                        ["label", "g", "s", "candidate", "vec_id", "own", "v", "positives", "scores"],
                    )

    return rows.mapInArrow(run, _SENT)


def sides(t: pa.Table, space: Space) -> tuple[pa.Table, np.ndarray, np.ndarray, pa.Table, np.ndarray, np.ndarray]:
    a, c = t.filter(pa.compute.invert(t["candidate"])), t.filter(t["candidate"])
    return a, a["vec_id"].to_numpy(), space.unpacked(a["v"]), c, c["vec_id"].to_numpy(), space.unpacked(c["v"])


def joined_positives(space: Space, k: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        _, aid, a, _, cid, c = sides(t, space)
        best, score = Best(len(a), k), products(a, c)
        for i in range(0, len(a), TILE_A):
            for j in range(0, len(c), TILE_C):
                i_, j_ = slice(i, min(i + TILE_A, len(a))), slice(j, j + TILE_C)
                best.search(i_, score(i_, j_), cid[j_], aid[i_, None] != cid[None, j_])
        row, col = np.nonzero(best.score > NONE)
        return pa.table({"anchor_id": pa.array(aid[row], pa.int64()), "positive_id": pa.array(best.ids[row, col], pa.int64()), "positive_score": pa.array(best.score[row, col], pa.int64())})

    return run


def window_of(score: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest n with least * score <= 100 * n <= most * score."""
    return -((-least * score) // 100), most * score // 100


def joined_negatives(space: Space, k: int, n: int, least: int, most: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        at, aid, a, ct, cid, c = sides(t, space)
        own, other = at["own"].to_numpy(), ct["own"].to_numpy()
        pos, p = (np.array([[*x, *[-1] * (k - len(x))] for x in at[name].to_pylist()], np.int64).reshape(-1, k) for name in ("positives", "scores"))
        there = np.arange(k)[None, :] < np.array([len(x) for x in at["scores"].to_pylist()], np.int64).reshape(-1, 1)
        lo, hi = window_of(p, least, most)
        lo, hi = np.where(there, lo, 1), np.where(there, hi, 0)
        best, score = [Best(len(a), n) for _ in range(k)], products(a, c)
        for i in range(0, len(a), TILE_A):
            for j in range(0, len(c), TILE_C):
                i_, j_ = slice(i, min(i + TILE_A, len(a))), slice(j, j + TILE_C)
                tile, allowed = score(i_, j_), own[i_, None] != other[None, j_]
                for b in range(k):
                    best[b].search(i_, tile, cid[j_], allowed, lo[i_, b], hi[i_, b])
        found = [(b, *np.nonzero(best[b].score > NONE)) for b in range(k)]
        join = lambda f: pa.array(np.concatenate([f(b, row, col) for b, row, col in found]), pa.int64())
        return pa.table(
            {
                "anchor_id": join(lambda b, row, col: aid[row]), "positive_id": join(lambda b, row, col: pos[row, b]), "positive_score": join(lambda b, row, col: p[row, b]),
                "negative_id": join(lambda b, row, col: best[b].ids[row, col]), "negative_score": join(lambda b, row, col: best[b].score[row, col]),
            }
        )

    return run


_NEGATIVES = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def mined(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, pivots: int = PIVOTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Of each anchor and each of its first `positives` other rows of its label: the first `negatives` rows of other labels whose
    score is between `least` and `most` per cent of the positive's. Scores are inner products of floor(256 * x); higher
    scores come first, ties by the smaller id.

    Rows without an id or label, or with a vector that is null, has a null or non-finite component or a norm of about a
    million or more (whose scores leave a long) take no part. Vectors of different lengths meet as if the shorter one went on
    with zeros; an empty one scores 0. Rows that repeat an id count once, with their smallest label and vector. Anchors with
    no positive, and positives of negative score, have no negatives. Extra columns are not read.
    """
    spark = vectors.sparkSession
    cores = 2 * spark.sparkContext.defaultParallelism
    slim = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vec_col).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    good = slim.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))).select("vec_id", "is_anchor", F.struct("label", whole(F.col("v")).alias("q")).alias("x"))
    once = good.groupBy("vec_id").agg(F.min("x").alias("x"), F.max("is_anchor").alias("is_anchor")).select("vec_id", "x.label", "x.q", "is_anchor")
    norm = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = written(once.withColumn("norm", norm), "vectors")
    about = rows.agg(F.count(F.lit(1)), F.max("norm"), F.max(F.size("q")), F.max(F.greatest(F.coalesce(F.array_max("q"), F.lit(0)), -F.coalesce(F.array_min("q"), F.lit(0)))), F.count_if("is_anchor")).first()
    if not about[4]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    n, width = about[0], about[2]
    space = Space.of(rows.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").limit(pivots).select("q").collect(), about[1], width, about[3])
    rows = rows.withColumn("q", F.when(F.size("q") == width, F.col("q")).otherwise(F.concat("q", F.array_repeat(F.lit(0), F.lit(width) - F.size("q")))))

    # Positives: labels are joined apart, a large one in slices of its own number.
    seen = summaries(rows, space, positives)
    cells = Cells.of(seen, space)
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(LARGEST).collect()
    known = np.array(sorted((r["label"], slices(r["n"], cores), r["n"]) for r in sizes), np.int64)
    rest = int(known[:, 2].min()) if len(sizes) == LARGEST else 0  # the others are no larger

    def size_of(labels: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known[:, 0], labels), len(known) - 1)
        return np.where(known[at, 0] == labels, known[at, 2], rest)

    def parts(labels: np.ndarray) -> np.ndarray:
        each, back = np.unique(size_of(labels), return_inverse=True)
        return np.array([slices(int(x), cores) for x in each], np.int64)[back]

    keys, top = ["label", "g", "s"], Window.partitionBy
    anchors = rows.where("is_anchor")
    few = lambda labels: size_of(labels) <= SMALL
    looking = cells.looking(seen)
    met = sent(rows.select("vec_id", "label", "q"), space, looking, True, parts, True, few).unionByName(sent(anchors.select("vec_id", "label", "q"), space, looking, False, parts, True, few))
    near = met.groupBy(*keys).applyInArrow(joined_positives(space, positives), "anchor_id long, positive_id long, positive_score long")
    place = F.row_number().over(top("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    best = near.withColumn("r", place).where(F.col("r") <= positives).groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("r", "positive_id", "positive_score"))).alias("b"))
    both = anchors.join(best, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "q", "norm", F.col("b.positive_id").alias("positives"), F.col("b.positive_score").alias("scores"))
    # Only positives of at least 0 leave room for a negative.
    asked = written(both.where(F.array_max("scores") >= 0), "anchors")

    # Negatives: all labels together.
    def reaches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = dict(zip(batch.schema.names, batch.columns, strict=True))
            q = space.matrix(batch).astype(np.float64)
            high, low = named["high"].to_numpy(), named["low"].to_numpy()
            base = (q * q).sum(1) + space.most
            lo, hi = window_of(low, least, most)[0], window_of(high, least, most)[1]
            yield pa.RecordBatch.from_arrays([pa.array(space.anchors(q).argmin(1).astype(np.int32)), pa.array(np.sqrt(np.maximum(base - 2.0 * lo, 0))), pa.array(np.sqrt(np.maximum(base - 2.0 * hi, 0)))], ["cell", "reach", "near"])

    ends = asked.select("q", F.array_max("scores").alias("high"), F.array_min(F.filter("scores", lambda x: x >= 0)).alias("low"))
    looking = cells.looking(ends.mapInArrow(reaches, "cell int, reach double, near double").groupBy("cell").agg(F.max("reach").alias("reach"), F.min("near").alias("near")).collect())
    all_slices = slices(n, cores)
    same = lambda labels: np.full(len(labels), all_slices, np.int64)
    met = sent(rows.select("vec_id", "label", "q"), space, looking, True, same, False).unionByName(sent(asked.drop("norm"), space, looking, False, same, False))
    found = met.groupBy(*keys).applyInArrow(joined_negatives(space, positives, negatives, least, most), _NEGATIVES)
    place = F.row_number().over(top("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11(spark, sf_dir):  # noqa: ANN001, ANN201
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mined(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


OP11_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.q, c.q)::BIGINT AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS r
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, r::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 3
"""
