"""Nearest neighbours by a block matrix join.

Queries and candidates are cut into blocks. Each pair of a query block and a group of candidate blocks is one task: it
multiplies int8 tiles, bounds how far each product can be from the true inner product, and keeps only the candidates
whose upper bound reaches the query's k-th best so far. Survivors are recomputed in double precision on the original
vectors and merged into the query's heap; the heaps of a query's tasks are merged last. The result is exact.

Tile products: a vector x is q * s + e with q = rint(x / s), s = max|x| / 127. For x and y,
|x.y - s t (q.r)| <= |e| |y| + |x'| |f|, where e and f are the rounding errors and x' = s q. The norms are taken
once per vector, so a bound costs two multiplications a pair.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioweave.llm.common import table, written

#: Products of a task, at least (as far as the cores are busy with fewer tasks) and at most; rows of either side that a task
#: holds, at most; and rows of either side of a tile.
LEAST_CELLS, MOST_CELLS, SIDE, TILE = 1 << 24, 1 << 32, 1 << 16, 2048
#: Relative slack for the rounding of the bounds themselves.
SLACK = 1e-9


def inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise inner products, added up from the first component to the last."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * y[:, j]
    return out


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, the norms of the quantised rows and of the errors."""
    scale = np.abs(x).max(axis=1) / 127
    safe = np.where(scale > 0, scale, 1.0)
    q = np.rint(x / safe[:, None]).astype(np.int8)
    back = q * safe[:, None]
    return q, safe, np.sqrt((back * back).sum(axis=1)), np.sqrt(((x - back) ** 2).sum(axis=1))


def tile_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """int8 x int8 products as exact integers: in float32 as far as they stay below 2**24, which holds for 1024 components."""
    out = np.zeros((len(q), len(c)), np.float64)
    for a in range(0, q.shape[1], 1024):
        out += q[:, a : a + 1024].astype(np.float32) @ c[:, a : a + 1024].astype(np.float32).T
    return out


class Heaps:
    """The k best of each query: by score downwards, then by id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def merge(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """rows: the query of each survivor, ascending."""
        if not len(rows):
            return
        hit, sizes = np.unique(rows, return_counts=True)
        all_rows = np.concatenate([np.repeat(hit, self.k), rows])
        all_ids = np.concatenate([self.ids[hit].ravel(), ids])
        all_scores = np.concatenate([self.score[hit].ravel(), scores])
        order = np.lexsort((all_ids, -all_scores, all_rows))
        starts = np.concatenate([[0], np.cumsum(sizes + self.k)[:-1]])
        best = order[(starts[:, None] + np.arange(self.k)).ravel()]
        self.ids[hit] = all_ids[best].reshape(-1, self.k)
        self.score[hit] = all_scores[best].reshape(-1, self.k)


def search_group(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> Heaps:
    """The k best of each query in one group of candidates."""
    heaps = Heaps(len(q), k)
    q8, qs, qn, qe = quantise(q)
    qnorm = np.sqrt((q * q).sum(axis=1))
    for at in range(0, len(c), TILE):
        part, ids = c[at : at + TILE], cid[at : at + TILE]
        c8, cs, _, ce = quantise(part)
        cnorm = np.sqrt((part * part).sum(axis=1))
        near = tile_products(q8, c8) * (qs[:, None] * cs[None, :])
        off = qe[:, None] * cnorm[None, :] + qn[:, None] * ce[None, :]
        off += SLACK * (qnorm[:, None] * cnorm[None, :])
        own = qid[:, None] == ids[None, :]
        near[own] = -np.inf
        # The k-th largest lower bound of this tile is a threshold too, so that a first tile prunes as well.
        floor = heaps.score[:, -1]
        if len(part) > k:
            floor = np.maximum(floor, np.partition(near - off, -k, axis=1)[:, -k])
        rows, cols = np.nonzero((near + off >= floor[:, None]) & ~own)
        heaps.merge(rows, ids[cols], inner(q[rows], part[cols]))
    return heaps


def cut(candidates: int, queries: int, cores: int) -> tuple[int, int]:
    """Into how many groups candidates go and into how many blocks queries.

    Each candidate is sent once per block and each query once per group, so for a number of tasks the least is sent when
    both send as much. That number follows the products, so copies of the table grow with its square root of tasks only.
    """
    cells = candidates * queries
    tasks = max(-(-cells // MOST_CELLS), min(cores, -(-cells // LEAST_CELLS)), 1)
    blocks = max(-(-queries // SIDE), round(math.sqrt(tasks * queries / max(1, candidates))), 1)
    return max(-(-candidates // SIDE), -(-tasks // blocks), 1), blocks


def usable(vec: Column) -> Column:
    """Not null, not empty, not all zero, without null or non-finite components."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k candidates of largest inner product, ties to the smaller id.

    Candidates are all usable rows but those with the query's id. Rows without an id and vectors that are null, empty,
    zero or hold null or non-finite components take no part. Vectors of another length than the query's are no
    candidates. Rows that repeat an id count once, with the smallest of their vectors. Extra columns are not read.
    """
    spark = vectors.sparkSession
    # Vectors travel in single precision if they come in it; every task takes them as doubles.
    kind = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    double = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("v"), is_query.alias("is_query"))
    once = double.where(F.col("vec_id").isNotNull() & usable(F.col("v"))).groupBy("vec_id").agg(F.min("v").alias("v"), F.max("is_query").alias("is_query"))
    rows = written(once.withColumn("dim", F.size("v")), "vectors")
    # Block numbers come from hashes, so that no count of a block depends on how ids are dealt; the counts set how many.
    n, m = rows.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    groups, blocks = cut(n, m, 2 * spark.sparkContext.defaultParallelism)
    cand = rows.select("dim", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), "vec_id", "v")
    query = rows.where("is_query").select("dim", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("b"), "vec_id", "v")

    def tile(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        qid, cid = left["vec_id"].to_numpy(np.int64), right["vec_id"].to_numpy(np.int64)
        q, c = (np.stack(side["v"].to_numpy()).astype(np.float64) for side in (left, right))
        out = []
        for a in range(0, len(q), TILE):
            heaps = search_group(qid[a : a + TILE], q[a : a + TILE], cid, c, k)
            at, slot = np.nonzero(heaps.score > -np.inf)
            out.append((qid[a + at], heaps.ids[at, slot], heaps.score[at, slot]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    keys = ["dim", "g", "b"]
    found = query.groupBy(*keys).cogroup(cand.groupBy(*keys)).applyInPandas(tile, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2(spark, sf_dir):  # noqa: ANN001, ANN201
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 20
"""
