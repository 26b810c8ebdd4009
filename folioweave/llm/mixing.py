"""Mixing sources to target weights by Pfair scheduling.

A source's documents form blocks. With weight w, block j of a source (from 0) may not start before slot floor(j / w)
and must be placed before slot ceil((j + 1) / w); each slot goes to the released block with the earliest deadline. As
the weights add up to one, every deadline is met and a source is never a whole block away from its share of the slots, at any
slot. Weights are exact: a float is the fraction that it stands for, and windows are computed in whole numbers.

The driver plans blocks, not rows: at most BLOCKS and one more for each source, whatever the table, as blocks grow with it
beyond that. Where a block's rows go follows from the plan by arithmetic. A source that has run out leaves its slots empty,
and the others go on in proportion. No document is dropped or repeated.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm.common import numbered, table

#: Rows of a block, as long as there are no more than BLOCKS of them.
BLOCK_ROWS, BLOCKS = 32, 1 << 20
#: More sources than this are refused: the plan goes to all tasks, and has a block for each.
MAX_SOURCES = 1 << 20


def exact(weights: list[float]) -> list[int]:
    """Whole numbers in the ratios of the weights."""
    parts = [Fraction(w) for w in weights]
    if any(p <= 0 for p in parts):
        raise ValueError("weights must be positive")
    common = 1
    for p in parts:
        common = max(common, p.denominator)  # powers of two: the largest is common to all
    if any(common % p.denominator for p in parts):
        raise ValueError("weights must be floats or whole numbers")
    return [int(p * common) for p in parts]


def planned(parts: list[int], blocks: list[int]) -> list[list[int]]:
    """For each source, the slots of its blocks: the earliest deadline first among the released ones, ties to the first source."""
    total = sum(parts)
    slots: list[list[int]] = [[] for _ in parts]
    waiting = [(0, -(-total // q), i) for i, (q, n) in enumerate(zip(parts, blocks, strict=True)) if n]  # release, deadline, source
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []
    t = 0
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            _, deadline, i = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, i))
        deadline, i = heapq.heappop(ready)
        if t >= deadline:
            raise AssertionError("a deadline was missed")
        slots[i].append(t)
        t += 1
        j, q = len(slots[i]), parts[i]
        if j < blocks[i]:
            heapq.heappush(waiting, (j * total // q, -(-(j + 1) * total // q), i))
    return slots


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, temper: float = 0.7, block_rows: int = BLOCK_ROWS, blocks: int = BLOCKS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Every document's place in the mix: source, block, release, deadline, slot and position (gapless from 0).

    weights: by source; sources that it doesn't name are refused. Without weights, a source counts by its number of
    documents to the power `temper`, which lifts small sources. A null source is a source of its own. Inside a source
    the order is a hash of the id, so ties and repeated rows have a fixed place up to interchange of equal rows. A block has
    `block_rows` rows, or as many more as keep their number at `blocks`. Weights so far apart that a slot leaves a long are refused.
    Extra columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"))
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    counts = sorted(((r["source"], r["n"]) for r in counts), key=lambda x: (x[0] is not None, x[0] or ""))
    if weights is not None and (unknown := [s for s, _ in counts if s not in weights]):
        raise ValueError(f"no weight for {unknown[:5]}")
    parts = exact([float(weights[s]) if weights is not None else float(n) ** temper for s, n in counts])
    size = max(block_rows, -(-sum(n for _, n in counts) // blocks))
    plan = planned(parts, [-(-n // size) for _, n in counts])
    # Blocks by slot: the rows before a block are those of the blocks before it, of which only a source's last is short.
    starts: list[list[int]] = [[] for _ in counts]
    at = 0
    for t, i in sorted((t, i) for i, ts in enumerate(plan) for t in ts):
        starts[i].append(at)
        at += min(size, counts[i][1] - (len(starts[i]) - 1) * size)
    total = sum(parts)
    ends = [[(j * total // q, -(-(j + 1) * total // q)) for j in range(len(ts))] for q, ts in zip(parts, plan, strict=True)]
    if any(e and e[-1][1] >= 1 << 62 for e in ends):
        raise ValueError("weights are too far apart")
    # A number or two for each block: at most `blocks` and one for each source.
    about = [(s, ts, st, [r for r, _ in e], [d for _, d in e]) for (s, _), ts, st, e in zip(counts, plan, starts, ends, strict=True)]
    known = spark.createDataFrame(about, "__s string, __slots array<long>, __starts array<long>, __releases array<long>, __deadlines array<long>")
    own = numbered(rows.withColumn("__h", F.xxhash64("doc_id")), ["source"], ["__h", "doc_id"], "__n").drop("__h")
    placed = own.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("__s")))
    block = F.expr(f"__n div {size}")
    of = lambda c: F.get(F.col(c), block.cast("int"))
    return placed.select("doc_id", "source", block.alias("block"), of("__releases").alias("release"), of("__deadlines").alias("deadline"), of("__slots").alias("slot"), (of("__starts") + F.col("__n") % size).alias("position"))


def mixed(docs: DataFrame, **params) -> DataFrame:  # noqa: ANN003
    """docs, all columns and rows, sorted by their place in the mix: written files hold the mix in their order.

    Rows that share an id go to the first place of that id.
    """
    where = mix(docs, **params).groupBy("doc_id").agg(F.min("position").alias("__position")).withColumnRenamed("doc_id", "__id")
    joined = docs.join(where, docs["doc_id"].eqNullSafe(where["__id"])).drop("__id")
    return joined.repartitionByRange("__position").sortWithinPartitions("__position").drop("__position")


def op8(spark, sf_dir):  # noqa: ANN001, ANN201
    return mix(table(spark, sf_dir, "documents"))
