"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each level every child draws from an exponential distribution whose rate is
the weight below it, from a hash of the row's key and the child's name; the smallest draw wins, so a child wins with
probability weight / sum of weights. The draws of the levels are independent of each other.

Weights are kept as increments: the weight that the tree was planned with, then one increment for each shard that is
added later. A child's draw is the smallest of its increments' draws, and the draw of an increment is the same at
every level above its shard. A row that an increment wins goes straight down to that shard; all other rows see the
draws they saw before. So an added shard takes rows only into itself, and nothing moves between shards that were there.

The work for a row is the children of one path plus the increments since the plan, not all shards.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.llm.common import numbered


@dataclass(frozen=True)
class HashTree:
    """planned: {region: {rack: {shard: weight}}}; added: (shard, region, rack, weight) since the plan, in order."""

    planned: dict[int, dict[int, dict[int, float]]]
    added: tuple[tuple[int, int, int, float], ...] = field(default=())

    @staticmethod
    def balanced(shards: int, regions: int = 4, racks: int = 2) -> HashTree:
        """Shards 0..n-1 of weight 1, dealt evenly over the regions and their racks."""
        if shards < 1:
            raise ValueError("a tree needs at least one shard")
        plan: dict[int, dict[int, dict[int, float]]] = {}
        cells = min(regions * racks, shards)
        for s in range(shards):
            cell = s * cells // shards
            plan.setdefault(cell // racks, {}).setdefault(cell % racks, {})[s] = 1.0
        return HashTree(plan)

    @property
    def shards(self) -> int:
        return sum(len(x) for r in self.planned.values() for x in r.values()) + len(self.added)

    def grown(self, weight: float = 1.0) -> HashTree:
        """The tree with one more shard, in the lightest rack (ties: the first)."""
        load = {(r, k): sum(s.values()) for r, racks in self.planned.items() for k, s in racks.items()}
        for _, r, k, w in self.added:
            load[r, k] += w
        r, k = min(load, key=lambda x: (load[x], x))
        return replace(self, added=(*self.added, (self.shards, r, k, weight)))

    def region_weights(self) -> dict[int, float]:
        out = {r: sum(w for s in racks.values() for w in s.values()) for r, racks in self.planned.items()}
        for _, r, _, w in self.added:
            out[r] += w
        return out


def _draw(key: Column, level: str, name: Column, weight: Column) -> Column:
    """-ln(u) / weight, with u in (0, 1) from the upper 53 bits of a hash."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), name), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return -F.log(u) / weight


def _children(level: dict[str, dict[int, float]]) -> Column:
    """A constant map: the path of a node to its children with the weights below them."""
    return F.create_map(*[x for path, kids in level.items() for x in (F.lit(path), F.array(*[F.struct(F.lit(c).alias("c"), F.lit(float(w)).alias("w")) for c, w in sorted(kids.items())]))])


def with_shard(df: DataFrame, tree: HashTree, key: Column, name: str) -> DataFrame:
    """df with each row's shard. Equal draws go to the smaller number."""
    plan = tree.planned
    top = {"": {r: sum(w for s in racks.values() for w in s.values()) for r, racks in plan.items()}}
    mid = {f"{r}": {k: sum(s.values()) for k, s in racks.items()} for r, racks in plan.items()}
    low = {f"{r}/{k}": s for r, racks in plan.items() for k, s in racks.items()}

    def won(level: str, nodes: dict, path: Column) -> Column:
        draws = F.transform(F.element_at(_children(nodes), path), lambda x: F.struct(_draw(key, level, F.concat_ws("/", path, x["c"]), x["w"]).alias("d"), x["c"].alias("c")))
        return F.array_min(draws)

    out = df.withColumn("__top", won("region", top, F.lit("")))
    out = out.withColumn("__r", F.col("__top.c").cast("string"))
    out = out.withColumn("__k", F.concat_ws("/", "__r", won("rack", mid, F.col("__r"))["c"]))
    out = out.withColumn(name, won("shard", low, F.col("__k"))["c"])
    if tree.added:
        # Every level above an added shard would see its draw win or lose alike, so one comparison settles all of them.
        late = F.array_min(F.array(*[F.struct(_draw(key, "added", F.lit(str(s)), F.lit(float(w))).alias("d"), F.lit(s).alias("c")) for s, _, _, w in tree.added]))
        out = out.withColumn("__late", late).withColumn(name, F.when(F.col("__late.d") < F.col("__top.d"), F.col("__late.c")).otherwise(F.col(name))).drop("__late")
    return out.drop("__top", "__r", "__k")


def assign_shards(docs: DataFrame, tree: HashTree, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its shard, its gapless slot there, and its shard once the tree has grown by one.

    Only the id decides, so copies of a text part but repeated rows of an id stay together. A null id is a key like
    any other. size is the text's UTF-8 bytes plus 16 (a null text has no bytes), text_crc32 the unsigned checksum of
    those bytes. Slots follow a hash of id and checksum inside a shard; repeated rows are
    interchangeable and each has its own slot. Extra columns are not read; an empty table gives no rows.
    """
    raw = F.encode(F.col(text_col), "UTF-8")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
    )
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    put = with_shard(with_shard(rows.withColumn("law", F.lit("key")), tree, key, "shard"), tree.grown(), key, "grown_shard")
    return numbered(put, ["shard"], ["doc_id", "text_crc32"], "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op1(spark, sf_dir):  # noqa: ANN001, ANN201
    """All documents into shards 0 to 39 of a tree of 4 regions with 2 racks each."""
    from folioweave.llm.common import table

    return assign_shards(table(spark, sf_dir, "documents"), HashTree.balanced(40))
