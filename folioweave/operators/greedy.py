"""Greedy selection in order, without a loop over rows: the first independent set of a conflict relation, in parallel rounds.

Going through rows in order and keeping each that conflicts with no kept one gives one result, whoever computes it: a row is
kept if and only if no kept row before it conflicts with it. So all rows that conflict with no open row before them can be
kept at once, rows that conflict with a kept one go, and the rest waits for the next round. Rounds follow the length of
chains of open rows, which is short in most orders. Where such a round settles little, as among numbered names that nearly
all conflict, the next one goes through the first PREFIX open rows in order, in one task, and removes what conflicts.

Rows that can conflict share a bucket (a filter that loses no conflict). No list of conflicting pairs is made: in each bucket
a row only looks for the first open row before it that it conflicts with, so a round sends a row for each place in a bucket.
Of a large bucket the first WINDOW open rows are compared with, by tasks that hold a slice of its rows each; a row behind
them that meets no conflict waits until the window reaches it. So a task's memory is bounded whatever a bucket holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioweave.session import settled

#: Open rows of a bucket that others are compared with in a round; rows of a bucket in one task.
WINDOW, SLICE = 4096, 4096
#: Open rows that one task goes through in order where rounds settle less than SLOW of all; their places, at most; open rows that are finished so.
PREFIX, PREFIX_PLACES, SLOW, FEW = 4096, 1 << 17, 0.25, 256

Conflict = Callable[[object, object], bool]


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, bool, tuple]]:
    """key, whether the key is new, the other values: of rows that come sorted by key."""
    last: tuple | None = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield row[:n_keys], row[:n_keys] != last, row[n_keys:]
            last = row[:n_keys]


def _round(prepare: Callable, conflict: Conflict, node_type: pa.DataType, window: int):  # noqa: ANN202
    """For each place of an open row: whether a kept row conflicts with it, its first conflicting open row, whether the window ends before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        kept: list[tuple] = []
        first: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            types = (node_type, pa.bool_(), pa.int64(), node_type, pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["node", "gone", "at", "by", "waits"])

        for _, new, (side, at, node, probe, payload) in _groups(batches, 2):
            if new:
                kept, first = [], []
            x = prepare(payload)
            if side == 0:
                kept.append((at, node, probe, x))
            elif side == 1:
                first.append((at, node, probe, x))
            else:
                gone = any((probe or p) and (a, n) < (at, node) and conflict(x, y) for a, n, p, y in kept)
                by, seen = None, False
                if not gone:
                    for a, n, p, y in first:
                        if (a, n) >= (at, node):
                            seen = True
                            break
                        if (probe or p) and conflict(x, y):
                            by = (a, n)
                            break
                waits = not gone and by is None and not seen and len(first) >= window
                out.append((node, gone, by[0] if by else None, by[1] if by else None, waits))
                if len(out) >= 8192:
                    yield flushed()
                    out.clear()
        yield flushed()

    return run


def _fold(prepare: Callable, conflict: Conflict, node_type: pa.DataType):  # noqa: ANN202
    """Which of a bounded number of nodes are kept; they come in any order, each with its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets: dict = {}
        out = []
        rows = [(at, node, prepare(x), places) for _, _, (at, node, x, places) in _groups(batches, 0)]
        for at, node, x, places in sorted(rows, key=lambda r: r[:2]):
            stays = not any((p["probe"] or probe) and conflict(x, y) for p in places for probe, y in buckets.get(p["bucket"], ()))
            out.append((node, stays))
            if stays:
                for p in places:
                    buckets.setdefault(p["bucket"], []).append((p["probe"], x))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], node_type), pa.array([x[1] for x in out], pa.bool_())], ["node", "kept"])

    return run


def _dealt(rows: DataFrame, sizes: DataFrame, open_rows: bool) -> DataFrame:
    """Rows with the slice of their bucket: open ones are dealt, the others go to each."""
    s = F.pmod(F.xxhash64("node"), F.col("__s")) if open_rows else F.explode(F.sequence(F.lit(0).cast("long"), F.col("__s") - 1))
    return rows.join(sizes, "bucket").select("bucket", s.alias("slice"), "side", "at", "node", "probe", "x")


def kept_in_order(places: DataFrame, conflict: Conflict, prepare: Callable = lambda x: x, window: int = WINDOW, few: int = FEW) -> DataFrame:
    """node, kept: which rows stay when all are gone through by (at, node) and each that conflicts with one that stayed goes.

    places: bucket (any type), node (long or string), at (long), probe (boolean), x: a row for each bucket of a node; x is what
    `prepare` makes comparable for `conflict`, the same in all its buckets. Conflicting nodes must share a bucket in which
    at least one of them has `probe`. Nodes that repeat a bucket must do it with equal rows. Nothing is collected.
    """
    node_type = pa.int64() if places.schema["node"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") else pa.string()
    sql_type = "long" if node_type == pa.int64() else "string"
    every = settled(places.select("bucket", F.col("node").cast(sql_type).alias("node"), F.col("at").cast("long").alias("at"), "probe", "x"))
    # A bucket of one node, or without a probe, holds no conflict.
    useful = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("probe").alias("p")).where("n > 1 AND p").select("bucket")
    live = settled(every.join(useful, "bucket"))
    stays = every.select("node").distinct().join(live.select("node").distinct(), "node", "left_anti")
    yes, no = F.lit(True).alias("kept"), F.lit(False).alias("kept")
    done = [stays.select("node", yes)]
    kept, slow, again = live.limit(0), False, False
    n = live.select("node").distinct().count()
    while n:
        in_order = slow or n <= few
        sizes = live.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / SLICE).alias("__s"))
        sent = _dealt(kept.withColumn("side", F.lit(0)), sizes, False).unionByName(_dealt(live.withColumn("side", F.lit(2)), sizes, True))
        if not in_order:
            rank = F.row_number().over(Window.partitionBy("bucket").orderBy("at", "node"))
            first = live.withColumn("__r", rank).where(F.col("__r") <= window).drop("__r")
            sent = sent.unionByName(_dealt(first.withColumn("side", F.lit(1)), sizes, False))
        sorted_ = sent.repartition("bucket", "slice").sortWithinPartitions("bucket", "slice", "side", "at", "node")
        seen = sorted_.mapInArrow(_round(prepare, conflict, node_type, window), f"node {sql_type}, gone boolean, at long, by {sql_type}, waits boolean")
        state = settled(seen.groupBy("node").agg(F.max("gone").alias("gone"), F.min(F.when(F.col("at").isNotNull(), F.struct("at", "by"))).alias("first"), F.max("waits").alias("waits"), F.count(F.lit(1)).alias("n")))
        gone = state.where("gone").select("node", no)
        if in_order:
            rows = live.join(state.where("NOT gone").select("node", "n"), "node")
            order = Window.orderBy("at", "node").rowsBetween(Window.unboundedPreceding, -1)
            few_rows = rows.select("node", "at", "n").distinct().orderBy("at", "node").limit(PREFIX)  # the window is over these alone
            ahead = few_rows.withColumn("__before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("__before") < PREFIX_PLACES).select("node")
            whole = rows.join(ahead, "node").groupBy("at", "node").agg(F.first("x").alias("x"), F.collect_list(F.struct("bucket", "probe")).alias("places"))
            new = whole.coalesce(1).mapInArrow(_fold(prepare, conflict, node_type), f"node {sql_type}, kept boolean")
        else:
            alone = state.where("NOT gone AND first IS NULL AND NOT waits").select("node", yes)
            lost = state.where("NOT gone AND first IS NOT NULL").join(alone.select(F.col("node").alias("by")), F.col("first.by") == F.col("by"), "left_semi").select("node", no)
            new = alone.unionByName(lost)
        over = settled(gone.unionByName(new))
        kept = settled(live.join(over.where("kept"), "node", "left_semi").select(*live.columns))
        live = settled(live.join(over, "node", "left_anti").select(*live.columns))
        done.append(over)
        before, n = n, live.select("node").distinct().count()
        # What the rows gone through in order remove shows in the round after.
        little = n > (1 - SLOW) * before
        slow, again = (little, True) if not in_order else (again or not little, False)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def best_match(rows: DataFrame, heads: DataFrame, score: Callable[[object, object], float], least: float, prepare: Callable = lambda x: x) -> DataFrame:
    """node, head: of the heads before a row, in (at, node), that share a bucket with it and reach `least`, the one of highest score, ties to the first.

    rows and heads: bucket, node (string), at, x. Heads of a bucket are dealt into slices by WINDOW, its rows by SLICE, so a
    task holds a bounded number of either and sends one match for each row.
    """
    n_heads = heads.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / WINDOW).alias("__h"))
    n_rows = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / SLICE).alias("__s"))
    sizes = n_heads.join(n_rows, "bucket")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("node"), F.col(c))
    h = heads.join(sizes, "bucket").withColumn("h", own("__h")).select("bucket", "h", every("__s").alias("slice"), F.lit(0).alias("side"), "at", "node", "x")
    r = rows.join(sizes, "bucket").withColumn("slice", own("__s")).select("bucket", every("__h").alias("h"), "slice", F.lit(1).alias("side"), "at", "node", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool: list[tuple] = []
        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.int64(), pa.string()), strict=True)], ["node", "score", "at", "head"])

        for _, new, (side, at, node, payload) in _groups(batches, 3):
            if new:
                pool = []
            x = prepare(payload)
            if side == 0:
                pool.append((at, node, x))
                continue
            best = min(((-s, a, n) for a, n, y in pool if (a, n) < (at, node) and (s := score(x, y)) >= least), default=None)
            if best:
                out.append((node, -best[0], best[1], best[2]))
                if len(out) >= 8192:
                    yield flushed()
                    out.clear()
        yield flushed()

    met = h.unionByName(r).repartition("bucket", "h", "slice").sortWithinPartitions("bucket", "h", "slice", "side", "at", "node")
    found = met.select("bucket", "h", "slice", "side", "at", "node", "x").mapInArrow(run, "node string, score double, at long, head string")
    return found.groupBy("node").agg(F.min(F.struct((-F.col("score")).alias("s"), "at", "head")).alias("b")).select("node", F.col("b.head").alias("head"))
