"""N-gram Jaccard join in the metric space of shingle sets.

Jaccard distance is a metric, and a pivot splits a region by it: members within the threshold of a pivot are linked to
it, and the triangle inequality keeps apart what differs too much in distance to it. On whole corpora, though, nearly
all documents lie at distance 1 from every other document, and a window of twice the threshold around that takes in
everything. So the first regions are cut by a pigeonhole argument that is exact for the same metric, and document
pivots divide these regions:

1. Two linked sets of at most `hi` shingles differ in at most D of them. Hash values cut the shingle space into k > D
   ranges, so in at least k - D ranges the two sets agree completely. A region is "all sets with this content in this
   range". A set may leave out its k - D - 1 emptiest ranges; if even its empty ranges are more than that, it also
   joins the regions of its prefix shingles. Sizes are handled in classes; a set near its class's upper end joins the
   next class too, as only there it can meet larger partners.
2. In each region the pivot is the smallest set id. Distances to the pivot are exact; members within the threshold
   link to it. A region whose members are all connected is finished, however many they are.
3. In the regions that are left, a member with too few shingles that any other such member has can't link any more.
   What stays is joined in metric regions: regions that share members form a group, and a group of more than BLOCK sets
   gets several pivots. Each set goes to the Voronoi cell of its nearest pivot and, as a replica, wherever windows from
   the triangle inequality say that a partner may be; what no pivot is near to is a region of its own. Parts that are
   still large divide again by other pivots. Cells join exactly, in memory; only links between members that aren't
   connected yet come out.

Equal sets count once throughout. Pairs are compared by whole sets, so no link is lost and none is invented.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioweave.llm.common import apart, drop_written, free_shuffles, fresh_path, table, written
from folioweave.llm.components import components
from folioweave.llm.hashing import mixed, shingles, word_hashes

#: Sets of a region that are joined in memory; larger ones are divided, at most LEVELS times, by about PIVOTS pivots whose
#: cells have RADIUS, while their parts have at most STUCK of them. Parts that don't shrink are joined block by block.
BLOCK, LEVELS, PIVOTS, RADIUS, STUCK = 512, 8, 16, 0.5, 0.8
RATIO = 1.5


def size_classes(limit: int = 1 << 40) -> np.ndarray:
    """The largest size of each class."""
    out, lo = [], 1
    while lo < limit:
        hi = max(lo, int(lo * RATIO))
        out.append(hi)
        lo = hi + 1
    return np.array(out)


_HI = size_classes()


def region_keys(sets: np.ndarray, percent: int) -> np.ndarray:
    """The regions that a sorted set of hashes belongs to."""
    n = len(sets)
    largest = 100 * n // percent
    own = int(np.searchsorted(_HI, n))
    out = []
    sums = None
    for c in (own, own + 1):
        if c > own and largest <= _HI[own]:
            break
        hi = int(_HI[c])
        # A partner that is smaller than this set meets it in this set's own class, a larger one in either.
        apart = (n + min(hi, largest)) * (100 - percent) // (100 + percent)
        if apart == 0:
            continue  # only an equal set could link
        k = 5 * (2 * hi * (100 - percent) // (100 + percent) + 1) // 4 + 2
        if sums is None:
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(mixed(sets ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
        part = ((sets >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        bounds = np.searchsorted(part, np.arange(k + 1, dtype=np.uint64))
        held = np.diff(bounds)
        # The largest occupancy below which at most k - apart - 1 ranges lie; those are left out.
        least = int(np.partition(held, k - apart - 1)[k - apart - 1])
        if least > 0:
            keep = np.flatnonzero(held >= least)
            sig = sums[bounds[keep + 1]] - sums[bounds[keep]]
            out.append(mixed(sig + keep.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(c)))
        else:
            keep = np.flatnonzero(held > 0)
            sig = sums[bounds[keep + 1]] - sums[bounds[keep]]
            out.append(mixed(sig + keep.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(c)))
            prefix = sets[: n - -(-percent * n // 100) + 1]
            out.append(mixed(prefix + np.uint64(0xA0761D6478BD642F + c)))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return shingles(word_hashes(text.encode().lower()), words) if text else np.zeros(0, np.uint64)


def set_id(sets: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two hashes of a set; of the first one only some bits, if asked for."""
    whole = xxhash.xxh3_128_intdigest(sets.tobytes())
    low, high = np.array([whole & ((1 << bits) - 1), whole >> 64], np.uint64).view(np.int64).tolist()
    return low, high


def sets_and_regions(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, set_id and check (see set_id), text_hash, keys; a set that a task has met before comes without keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                n, ids, keys, ends = [], [], [], [0]
                for text in some.column(1):
                    s = shingle_set(text.as_py(), words)
                    n.append(len(s))
                    ids.append(set_id(s, bits) if len(s) else (None, None))
                    if len(s) and ids[-1] not in seen:
                        keys.append(region_keys(s, percent))
                        if len(seen) < 500_000:
                            seen.add(ids[-1])
                    else:
                        keys.append(np.zeros(0, np.int64))
                    ends.append(ends[-1] + len(keys[-1]))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))
                low, high = (pa.array(x, pa.int64()) for x in zip(*ids, strict=True))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), low, high, some.column(2), lists], ["doc_id", "n_shingles", "set_id", "check", "text_hash", "keys"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_id long, check long, text_hash long, keys array<long>")


def compared(pairs: DataFrame, sets: DataFrame, percent: int, all_sizes: bool = False) -> DataFrame:
    """(a, b, shared, either, linked) of distinct pairs (a, b), by whole sets; pairs whose sizes can't link only if asked for."""
    with_a = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("hashes").alias("u"), F.col("n").alias("nu")), "a")
    with_b = with_a.join(sets.select(F.col("set_id").alias("b"), F.col("hashes").alias("v"), F.col("n").alias("nv")), "b")
    # Sizes alone rule out pairs whose smaller set is below percent of the larger.
    fit = with_b if all_sizes else with_b.where(100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv"))
    counted = fit.select("a", "b", F.size(F.array_intersect("u", "v")).cast("long").alias("shared"), (F.col("nu") + F.col("nv")).alias("both"))
    out = counted.select("a", "b", "shared", (F.col("both") - F.col("shared")).alias("either"))
    return out.withColumn("linked", 100 * F.col("shared") >= percent * F.col("either"))


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id, label, text_hash of every row: which rows are linked, directly or through others.

    Null and empty texts, and texts without words, have no shingles and are linked with nothing: their component is
    their own id. Rows with equal sets are linked. component_id is the smallest id of the component (nulls don't
    count; null if it has no other). Repeated rows each get their row. Extra columns are not read.
    Sets are told apart by 128 bits, of which the first 64 are their number; fewer `bits` are for tests of collisions.
    """
    spark = docs.sparkSession
    made: list[str] = []

    def keep(df: DataFrame, tag: str) -> DataFrame:
        made.append(fresh_path(spark, tag))
        return written(df, tag, made[-1])

    base = apart(keep(sets_and_regions(docs, words, percent, id_col, text_col, bits), "sets"), "set_id", "check")
    rows = keep(base.select("doc_id", "n_shingles", "set_id", "check", "text_hash"), "rows")
    met = base.select("set_id", F.explode("keys").alias("key"))
    by_key = Window.partitionBy("key")
    regions = met.withColumn("pivot", F.min("set_id").over(by_key)).withColumn("last", F.max("set_id").over(by_key)).where("pivot < last").select("key", "set_id", "pivot")
    regions = keep(regions, "regions")
    drop_written(spark, made.pop(0))
    free_shuffles(spark)
    wanted = regions.select("set_id").distinct()
    first = rows.join(wanted, "set_id", "left_semi").groupBy("set_id").agg(F.min(F.struct("doc_id", "text_hash", "check")).alias("at"))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, check, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = shingle_set(text.as_py(), words)
                if len(s) and set_id(s)[1] == check:
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(s)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(s)], pa.int32()), pa.array(s.view(np.int64)))], ["set_id", "n", "hashes"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    of = first.select("set_id", "at.doc_id", "at.text_hash", "at.check")
    held = texts.join(of, texts["doc_id"].eqNullSafe(of["doc_id"]) & (texts["text_hash"] == of["text_hash"])).select("set_id", "check", "text")
    sets = held.mapInArrow(again, "set_id long, n long, hashes array<long>")
    # Only where a row is repeated is a set there more than once.
    if rows.join(of, ["doc_id", "text_hash"], "left_semi").groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count() or rows.where("doc_id IS NULL").limit(1).count():
        sets = sets.dropDuplicates(["set_id"])
    sets = keep(sets, "hashes")
    free_shuffles(spark)

    tested = keep(compared(regions.where("set_id <> pivot").select(F.col("pivot").alias("a"), F.col("set_id").alias("b")).distinct(), sets, percent), "links")
    links = tested.where("linked").select("a", "b")
    labels = components(links)
    open_members = _open(regions.select("key", "set_id").distinct(), labels)
    waiting = keep(open_members.select("set_id").distinct(), "waiting")
    if waiting.limit(1).count():
        alive = keep(_with_shared_shingles(waiting, sets, percent), "alive")
        left = keep(_open(regions.join(alive, "set_id", "left_semi").select("key", "set_id").distinct(), labels), "open")
        more = keep(_near_links(left, sets, percent, block), "links")
        labels = components(links.union(more))
    ids = rows.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("id"))
    named = ids.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    smallest = named.groupBy("label").agg(F.min("id").alias("component_id"))
    of_set = named.join(smallest, "label").select("set_id", "component_id", "label")
    joined = rows.join(of_set, "set_id", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "label", "text_hash")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, set_id, label) of the regions whose members (key, set_id) aren't in one component."""
    named = members.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    split = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    return named.join(split, "key").select("key", "set_id", "label")


def _with_shared_shingles(waiting: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(set_id) of the sets of which at least `percent` of the shingles occur in another one of them, too."""
    # Shingles travel packed: a row for each batch of sets and range of hashes.
    ranges = max(16, -(-waiting.count() // 2000))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                h = some.column(1).flatten().to_numpy().view(np.uint64)
                ids = np.repeat(some.column(0).to_numpy(), some.column(1).value_lengths().to_numpy())
                part = ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(ranges + 1, dtype=np.uint64))
                h, ids = h[order], ids[order]
                cols = [np.arange(ranges, dtype=np.int32), [h[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.binary(), pa.binary()], strict=True)], ["part", "h", "ids"])

    def counted(group: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("h")])
        ids = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in group.column("ids")])
        _, which, n = np.unique(h, return_inverse=True, return_counts=True)
        names, k = np.unique(ids[n[which] > 1], return_counts=True)  # a set holds a shingle once
        return pa.table({"set_id": names, "shared": k.astype(np.int64)})

    chosen = sets.join(waiting, "set_id", "left_semi")
    shared = chosen.select("set_id", "hashes").mapInArrow(dealt, "part int, h binary, ids binary").groupBy("part").applyInArrow(counted, "set_id long, shared long")
    total = shared.groupBy("set_id").agg(F.sum("shared").alias("shared"))
    return chosen.select("set_id", "n").join(total, "set_id").where(100 * F.col("shared") >= percent * F.col("n")).select("set_id")


def _near_links(left: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) between members of open regions (key, set_id, label) that aren't connected yet."""
    star = left.withColumn("a", F.min("set_id").over(Window.partitionBy("key"))).where("a <> set_id").select("a", F.col("set_id").alias("b")).distinct()
    groups = components(star).select(F.col("label").alias("region"), F.col("node").alias("set_id"))
    cells = _voronoi(groups, sets, percent, block).join(left.select("set_id", "label").distinct(), "set_id")
    sizes = cells.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    sized = cells.join(sizes.select("region", F.ceil(F.col("size") / block).cast("int").alias("nb")), "region").join(sets, "set_id").withColumn("blk", F.pmod(F.xxhash64("set_id"), F.col("nb")).cast("int"))
    met = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = met.select("region", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "set_id", "label", "n", "hashes")

    def join(cell: pa.Table) -> pa.Table:
        x, y = (cell.filter(pc.equal(cell["blk"], cell[k][0])) for k in "ij")
        a, b = _links(x, y, percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("region", "i", "j").applyInArrow(join, "a long, b long")


def _voronoi(members: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """(region, set_id): members in regions of at most `block` sets, or such that pivots divide no more. Linked sets share one.

    Some members of a large region are its pivots, by a hash. A set within RADIUS of one belongs to the cell of the nearest.
    With a link's distance of at most t, a set's partners in that cell lie within t more of its pivot, and at most 2 t
    farther from it than from their own nearest: there they are replicated. Sets beyond RADIUS of all pivots
    are a region of their own, as two of them that are linked both are there. Each part is divided again.
    """
    reach, done = (100 - percent) / 100 + 1e-9, None
    todo = members.select("region", "set_id", F.lit(1 << 62).alias("parent"))
    for level in range(LEVELS):
        sized = todo.join(todo.groupBy("region").agg(F.count(F.lit(1)).alias("size")), "region")
        divides = (F.col("size") > block) & (F.col("size") <= STUCK * F.col("parent"))
        ready = sized.where(~divides).select("region", "set_id")
        done = ready if done is None else done.unionByName(ready)
        large = sized.where(divides).select("region", "set_id", "size")
        if not large.limit(1).count():
            return done
        large = written(large, "large")
        pivots = large.where(F.pmod(F.xxhash64("set_id", F.lit(level)), F.col("size")) < PIVOTS).select("region", F.col("set_id").alias("pivot"))
        held = pivots.join(sets.select(F.col("set_id").alias("pivot"), F.col("n").alias("np"), F.col("hashes").alias("hp")), "pivot")
        both = large.join(sets, "set_id").join(held, "region", "left").withColumn("shared", F.size(F.array_intersect("hashes", "hp")))
        far = both.select("region", "set_id", "size", "pivot", (1 - F.col("shared") / (F.col("n") + F.col("np") - F.col("shared"))).alias("far"))
        # At most a few more than PIVOTS distances a set.
        placed = far.groupBy("region", "set_id", "size").agg(F.collect_list(F.when(F.col("pivot").isNotNull(), F.struct("far", "pivot"))).alias("at")).withColumn("least", F.coalesce(F.array_min("at")["far"], F.lit(2.0)))
        cells = F.transform(F.filter("at", lambda p: p["far"] <= F.least(F.col("least") + 2 * reach, F.lit(RADIUS) + reach)), lambda p: F.xxhash64("region", F.lit(level), p["pivot"]))
        into = F.concat(cells, F.when(F.col("least") > RADIUS, F.array(F.xxhash64("region", F.lit(level)))).otherwise(F.array().cast("array<bigint>")))
        todo = written(placed.select(F.explode(into).alias("region"), "set_id", F.col("size").alias("parent")), "cells")
    return done.unionByName(todo.select("region", "set_id"))


def _links(x: pa.Table, y: pa.Table, percent: int) -> tuple[list[int], list[int]]:
    """Links between the sets of two blocks, as far as they connect what isn't connected by then."""
    ids, labels, sizes = y.column("set_id").to_numpy(), y.column("label").to_numpy(), y.column("n").to_numpy()
    lists = y.column("hashes").combine_chunks()
    tokens, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while root.get(k, k) != k:
            root[k] = k = root.get(root[k], root[k])
        return k

    out_a, out_b = [], []
    for k, label, n, raw in zip(x.column("set_id").to_pylist(), x.column("label").to_pylist(), x.column("n").to_pylist(), x.column("hashes"), strict=True):
        h = raw.values.to_numpy()
        lo, hi = np.searchsorted(tokens, h, "left"), np.searchsorted(tokens, h, "right")
        size = hi - lo
        at = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
        inter = np.bincount(owner[at], minlength=len(lists))
        for j in np.flatnonzero((100 * inter >= percent * (n + sizes - inter)) & (labels != label)).tolist():
            u, v = find(label), find(int(labels[j]))
            if u != v:
                root[u] = v
                out_a.append(k)
                out_b.append(int(ids[j]))
    return out_a, out_b


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one document of each component: the one with the smallest id (null ids come last).

    Documents without words belong to no component and all stay.
    """
    found = jaccard_components(docs, words, percent, id_col, text_col)
    who = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")
    stay = found.where(F.col("label").isNotNull()).groupBy("label").agg(F.min(who).alias("w")).select("w.doc_id", "w.text_hash")
    loose = found.where(F.col("label").isNull()).select("doc_id", "text_hash").distinct()
    keys = written(stay.unionByName(loose).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")), "stay")
    marked = docs.withColumns({"__own": F.col(id_col).cast("long"), "__text": F.xxhash64(text_col)})
    same = marked["__own"].eqNullSafe(keys["__id"]) & (marked["__text"] == keys["__hash"])
    kept = marked.join(keys, same, "left_semi")
    # Only where an id comes with one text more than once is another row left to go.
    if found.where(F.col("label").isNotNull()).groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count():
        first = F.row_number().over(Window.partitionBy("__own", "__text").orderBy("__own"))
        wordless = F.coalesce(F.length(F.regexp_replace(text_col, r"[\x20\x09-\x0D]+", "")), F.lit(0)) == 0
        kept = kept.withColumn("__first", first).where((F.col("__first") == 1) | wordless)
    return kept.select(*[kept[c] for c in docs.columns])


def op4(spark, sf_dir):  # noqa: ANN001, ANN201
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[]
    WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] FOR i IN range(1, len(ws) - 2)]) END AS sh
  FROM w
), n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * i >= 85 * (u.n + v.n - i)),
r AS (SELECT doc_id AS node, doc_id AS reach FROM n UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reach)
SELECT n.doc_id, n.n AS n_shingles, min(reach) AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY ALL
"""
