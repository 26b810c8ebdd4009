"""Centroid clustering by partial-distance search.

Vectors are whole numbers. A vector first adds up its squared differences to all centroids over the dimensions of highest
variance. The centroid that leads there is finished, and its distance is the current best; every centroid whose sum is
strictly above it is abandoned, again after each further stretch of dimensions. What is left has finished all dimensions.
Abandoning only strictly keeps ties, so the result is that of a full comparison.

The vectors are written once as whole numbers and read in each round. A task sends sums and counts of its own rows, a row
for each centroid at most, so what is shuffled and what reaches the driver follows centroids, not vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.llm.common import drop_written, fresh_path, table, written

#: Dimensions; those of a stretch; rows that are compared at a time.
DIM, STRETCH, ROWS = 64, 16, 4096
#: Components of a larger size don't leave distances that fit a long.
LARGEST = 1 << 27


def whole(vec: Column) -> Column:
    """floor(256 * x) of each component, taken as double."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * 256).cast("int"))


def kept(vec: Column, dim: int = DIM) -> Column:
    """Exactly `dim` components, none null or non-finite, and none so large that distances don't fit a long."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * 256) >= LARGEST))
    return F.coalesce((F.size(vec) == dim) & ~bad, F.lit(False))


def nearest(x: np.ndarray, c: np.ndarray, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """The number and squared distance of each row's nearest centroid, ties to the smaller number. Dimensions in search order."""
    # Squares of 64 differences below 2**12 fit 31 bits.
    kind = np.int32 if x.shape[1] <= 64 and max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= 1 << 11 else np.int64
    x, c = x.astype(kind), c.astype(kind)
    first = np.zeros((len(x), len(c)), kind)
    for j in range(min(stretch, x.shape[1])):
        d = x[:, j, None] - c[None, :, j]
        first += d * d
    lead = first.argmin(1)
    best = ((x - c[lead]) ** 2).sum(1, dtype=kind)
    row, number = np.nonzero(first <= best[:, None])
    sums = first[row, number]
    for at in range(stretch, x.shape[1], stretch):
        d = x[row, at : at + stretch] - c[number, at : at + stretch]
        sums = sums + (d * d).sum(1, dtype=kind)
        on = sums <= best[row]
        row, number, sums = row[on], number[on], sums[on]
    order = np.lexsort((number, sums, row))
    winner = order[np.unique(row[order], return_index=True)[1]]
    return number[winner], sums[winner].astype(np.int64)


def matrices(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of a batch as matrices of at most ROWS rows, each with its first row."""
    q = batch.column(batch.schema.names.index("q")).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    for at in range(0, len(q), ROWS):
        yield at, q[at : at + ROWS]


def spreads(rows: DataFrame, dim: int) -> np.ndarray:
    """The dimensions by falling variance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, np.zeros(dim), np.zeros(dim)
        for batch in batches:
            for _, q in matrices(batch, dim):
                n, s, ss = n + len(q), s + q.sum(0, dtype=np.float64), ss + (q.astype(np.float64) ** 2).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n] * dim, pa.int64()), pa.array(np.arange(dim, dtype=np.int32)), pa.array(s), pa.array(ss)], ["n", "i", "s", "ss"])

    sums = rows.select("q").mapInArrow(run, "n long, i int, s double, ss double").groupBy("i").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")]).collect()
    spread = np.zeros(dim)
    for r in sums:
        spread[r["i"]] = r["ss"] / r["n"] - (r["s"] / r["n"]) ** 2
    return np.lexsort((np.arange(dim), -spread))


def sums_of(centroids: np.ndarray, order: np.ndarray) -> Callable:
    """A task's number of rows and sums of each centroid's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = centroids.shape
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            for _, q in matrices(batch, dim):
                number, _ = nearest(q[:, order], centroids[:, order])
                n += np.bincount(number, minlength=k)
                member = np.zeros((k, len(q)))
                member[number, np.arange(len(q))] = 1
                total += (member @ q.astype(np.float64)).astype(np.int64)  # ROWS components below 2**27: exact
        hit = np.flatnonzero(n)
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(n[hit]), pa.array(list(total[hit]), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    return run


def assigned(rows: DataFrame, centroids: np.ndarray, order: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nearest(q[:, order], centroids[:, order]) for _, q in matrices(batch, centroids.shape[1])]
            number, distance = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(distance.astype(np.int64))], ["vec_id", "cluster", "distance"])

    return rows.select("vec_id", "q").mapInArrow(run, "vec_id long, cluster int, distance long")


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2:", dim: int = DIM, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector with exactly `dim` usable components.

    The first centroids are the vectors whose ids have the smallest sha256 after `seed`, equal ids by their components; rows
    without an id are clustered, but none starts a centroid. With fewer vectors there are fewer centroids, and without any
    with an id there is no row. Vectors that are null, of another length, with null or non-finite components or with one of
    2**27 / 256 or more in size take no part. Rows that repeat an id, or a vector, count each. Extra columns are not read.
    """
    spark = vectors.sparkSession
    path = fresh_path(spark, "vectors")
    slim = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    rows = written(slim.where(kept(F.col("v"), dim)).select("vec_id", whole(F.col("v")).alias("q")), "vectors", path)
    start = rows.where(F.col("vec_id").isNotNull()).orderBy(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256), "vec_id", "q").limit(k).collect()
    if not start:
        drop_written(spark, path)
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["q"] for r in start], np.int64)
    order = spreads(rows, dim)
    for _ in range(rounds):
        task = rows.select("q").mapInArrow(sums_of(centroids, order), "cluster int, n long, s array<long>")
        sums = task.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dim)]).collect()
        centroids = centroids.copy()
        for r in sums:  # a row for each centroid at most
            centroids[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dim)]
    out = written(assigned(rows, centroids, order), "clusters")
    drop_written(spark, path)
    inertia = dict(out.groupBy("cluster").agg(F.sum("distance")).collect())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = [(i, s, sum(inertia.values()), digest[i]) for i, s in inertia.items()]
    # As many rows as centroids.
    return out.join(F.broadcast(spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13(spark, sf_dir):  # noqa: ANN001, ANN201
    return clustered(table(spark, sf_dir, "embeddings"))


_DIFF = "list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"


def _round(r: int) -> str:
    near = f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(q) AS q, arg_min(no, (d, no)) AS cluster, min(d) AS distance FROM (SELECT v.vec_id, q, no, {_DIFF} AS d FROM v, c{r}) GROUP BY vec_id)"
    if r == 5:
        return near
    sums = f"s{r} AS (SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{r}) GROUP BY ALL)"
    means = f"m{r} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY cluster)"
    return f"{near}, {sums}, {means}, c{r + 1} AS MATERIALIZED (SELECT no, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON cluster = no)"


OP13_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS no, q AS c FROM v QUALIFY no < 40),
{", ".join(_round(r) for r in range(6))}
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a5 JOIN c5 ON cluster = no
"""
