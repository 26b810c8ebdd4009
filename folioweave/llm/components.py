"""Connected components by contraction."""

from __future__ import annotations

import random

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm.common import drop_written, fresh_path, written


#: Edges that one task finishes: 16 bytes each.
FEW = 1 << 17


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, to for the nodes of a few edges (a, b), by union-find."""
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while root.setdefault(k, k) != k:
            root[k] = k = root[root[k]]
        return k

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.array([find(k) for k in nodes], np.int64))], ["node", "to"])


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of edges (a, b); written.

    In each round a node goes to that of its neighbours that comes first, if that comes before itself, and edges are
    redrawn between the nodes that are left; edges inside what is known to be connected vanish. The first round's order is
    that of the nodes, so the members of a star around its smallest node meet at once; later ones flip random bits of the
    nodes, which thins long chains by a constant share whatever their order. Rounds get smaller as they go, and so do the
    maps from which labels are put together, the last first. At most `few` edges are finished in one task. Nothing comes to
    the driver but how many edges are left.
    """
    spark = edges.sparkSession
    paths = [fresh_path(spark, "edges")]
    links = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", paths[0])
    maps: list[tuple[str, DataFrame]] = []
    while n := links.count():
        if n <= few:
            path = fresh_path(spark, "map")
            maps.append((path, written(links.coalesce(1).mapInArrow(_finished, "node long, to long"), "map", path)))
            break
        flip = F.lit(random.Random(len(maps)).getrandbits(63) if maps else 0)
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("near")).union(links.select("b", "a"))
        first = ends.groupBy("node").agg(F.min(F.col("near").bitwiseXOR(flip)).alias("first"))
        to = F.when(F.col("first") < F.col("node").bitwiseXOR(flip), F.col("first").bitwiseXOR(flip)).otherwise(F.col("node"))
        path = fresh_path(spark, "map")
        maps.append((path, written(first.select("node", to.alias("to")), "map", path)))
        goes = maps[-1][1]
        half = links.join(goes.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").select("x", "b")
        drawn = half.join(goes.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").where("x <> y")
        paths.append(fresh_path(spark, "edges"))
        links = written(drawn.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges", paths[-1])
        drop_written(spark, paths.pop(0))
    last = spark.createDataFrame([], "node long, last long")
    for _, goes in reversed(maps):
        last = goes.join(last.withColumnRenamed("node", "to"), "to", "left").select("node", F.coalesce("last", "to").alias("last"))
    path = fresh_path(spark, "last")
    last = written(last, "last", path)
    paths.append(path)
    out = written(last.join(last.groupBy("last").agg(F.min("node").alias("label")), "last").select("node", "label"), "labels")
    drop_written(spark, *paths, *[p for p, _ in maps])
    return out
