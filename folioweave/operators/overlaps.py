"""Greedy selection among many sets of words: which rows of a large group go as their words overlap with those of one that stays.

A group's rows are dealt to blocks by their words, so equal sets meet; each two blocks make a tile, a task of TILE words a side at
most. A tile counts common words through postings, so a row is sent once for each block of its group and not for each of its words.
Of two sets that overlap enough the smaller one has one of any (its size less the least overlap plus one) of its words in the
other: a set looks its rarest words up among all words of others, and all its words among the rarest of smaller ones; what that
leaves is counted in full. A row lists its first LISTED conflicts of a tile at most and says if there are more.

The selection is then made over what is listed. Every row that goes conflicts with one that stays; rows that stay although they
have more conflicts than listed are compared with all that stay, and what is found is listed, too, until nothing is. A choice in
which all that go conflict with an earlier one that stays, and no two that stay conflict, is the one that a loop in order makes.

Words are hashes of eight bytes, by a seed for which no two words of the rows share one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.operators.greedy import kept_in_order
from folioweave.session import settled

#: Words of a block; conflicts that a row lists in a tile; postings that a row reads although fewer would do; spare words of a set that others look up.
TILE, LISTED, READ, SPARE = 1 << 23, 32, 4096, 2


def needed(least: float, most: int) -> np.ndarray:
    """How many common words make the overlap of sets exceed `least`, by the size of the smaller one."""
    out = np.zeros(most + 1, np.int64)
    for m in range(1, most + 1):
        c = max(int(least * m) - 1, 0)
        while c / m <= least:
            c += 1
        out[m] = c
    return out


def _lists(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Owners by word, and where each of the n words begins."""
    return owner[np.argsort(words, kind="stable")].astype(np.int32), np.r_[0, np.cumsum(np.bincount(words, minlength=n))]


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1 and so on, as many as size says, of each."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


class _Block:
    """Sets in order, with postings of all their words and of the rarest ones of each."""

    def __init__(self, keys: list[tuple], sets: list[np.ndarray], asks: list[bool], least: float) -> None:
        order = sorted(range(len(keys)), key=keys.__getitem__)
        self.keys, self.asks = [keys[i] for i in order], np.array([asks[i] for i in order], bool)
        self.least, self.n = least, np.array([len(sets[i]) for i in order], np.int64)
        self.vocabulary, self.words = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
        self.starts = np.r_[0, np.cumsum(self.n)]
        v, owner = len(self.vocabulary), np.repeat(np.arange(len(order)), self.n)
        self.often = np.bincount(self.words, minlength=v)
        self.post, self.at = _lists(self.words, owner, v)
        need = needed(least, int(self.n.max()))[self.n]
        self.few = np.clip(need, 1, 1 + SPARE)
        rarest = np.lexsort((self.often[self.words], owner))
        ahead = np.arange(len(owner)) - self.starts[:-1][owner] < (self.n - need + self.few)[owner]
        self.rare_post, self.rare_at = _lists(self.words[rarest][ahead], owner[ahead], v)
        self.listed, self.more = np.zeros(len(order), np.int64), np.zeros(len(order), bool)
        self.mark = np.zeros(v, bool)

    def own(self, i: int) -> np.ndarray:
        return self.words[self.starts[i] : self.starts[i + 1]]

    def looked_up(self, hashes: np.ndarray) -> np.ndarray:
        """Those of the words that the block knows."""
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return at[self.vocabulary[at] == hashes]

    def near(self, known: np.ndarray, n: int, need: int, upto: int) -> np.ndarray:
        """Which of the first rows may have enough words in common with a set of n words, of which the block knows some."""
        known = known[np.argsort(self.often[known], kind="stable")]
        cost = np.cumsum(self.often[known])
        # Unknown words are in no row: as rare as can be.
        least = max(n - need + 1 - (n - len(known)), 0)
        take = max(least, int(np.searchsorted(cost, READ)))
        few = need - (len(known) - min(take, len(known)))
        seen = np.bincount(self.post[_spread(self.at[known[:take]], self.often[known[:take]])], minlength=len(self.keys))[:upto]
        larger = np.flatnonzero((seen >= max(few, 1)) & (self.n[:upto] >= n))
        seen = np.bincount(self.rare_post[_spread(self.rare_at[known], self.rare_at[known + 1] - self.rare_at[known])], minlength=len(self.keys))[:upto]
        smaller = np.flatnonzero((seen >= self.few[:upto]) & (self.n[:upto] < n))
        return np.union1d(larger, smaller)

    def common(self, known: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How many of the words each of the rows has."""
        self.mark[known] = True
        held = np.r_[0, np.cumsum(self.mark[self.words[_spread(self.starts[rows], self.n[rows])]])]
        self.mark[known] = False
        ends = np.cumsum(self.n[rows])
        return held[ends] - held[ends - self.n[rows]]


def _tile(least: float, node_type: pa.DataType, listed: int):  # noqa: ANN202
    names = ["node", "at", "by", "by_at", "copy", "more"]
    types = (node_type, pa.int64(), node_type, pa.int64(), pa.bool_(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        tile: tuple | None = None
        block: _Block | None = None
        rows: tuple = ([], [], [])
        known: set[bytes] = set()
        limits = needed(least, 64)

        def limit(n: int) -> np.ndarray:
            nonlocal limits
            if n >= len(limits):
                limits = needed(least, 2 * n)
            return limits

        def probe(key: tuple, ids: np.ndarray, n: int, asks: bool, upto: int) -> None:
            """Lists conflicts of a set with rows of the block before it, and of rows behind it with the set."""
            need = limit(n)
            if not asks and not block.asks.any():
                return
            found = block.near(ids, n, int(need[n]), upto)
            mine, at, step = 0, 0, 32
            while at < len(found):
                part, at, step = found[at : at + step], at + step, 2 * step
                earlier = np.array([block.keys[i] < key for i in part.tolist()], bool)
                wanted = np.where(earlier, asks and mine <= listed, block.asks[part])
                full = wanted & ~earlier & (block.listed[part] >= listed)
                block.more[part[full]] = True
                part, earlier = part[wanted & ~full], earlier[wanted & ~full]
                hit = block.common(ids, part) >= need[np.minimum(block.n[part], n)]
                for i, before in zip(part[hit].tolist(), earlier[hit].tolist(), strict=True):
                    other = block.keys[i]
                    if not before:
                        block.listed[i] += 1
                        out.append((other[1], other[0], key[1], key[0], False, False))
                    elif mine < listed:
                        mine += 1
                        out.append((key[1], key[0], other[1], other[0], False, False))
                    elif mine == listed:
                        mine += 1
                        out.append((key[1], key[0], None, None, False, True))
                if mine > listed and not block.asks.any():
                    return

        def built() -> None:
            nonlocal block
            if block is None and rows[0]:
                block = _Block(*rows, least)

        def ended() -> None:
            if tile is not None and tile[1] == tile[2] and rows[0]:
                built()
                asks = block.asks.copy()
                block.asks[:] = False  # each row looks before itself
                for i in np.flatnonzero(asks).tolist():
                    probe(block.keys[i], block.own(i), int(block.n[i]), True, i)
            if block is not None:
                out.extend((*block.keys[i][::-1], None, None, False, True) for i in np.flatnonzero(block.more).tolist())

        def flushed() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for batch in batches:
            x = batch.column(7)
            flat, offsets = x.values.to_numpy(zero_copy_only=False), x.offsets.to_numpy()
            for r, (group, i, j, side, at, node, asks) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True)):
                if (group, i, j) != tile:
                    ended()
                    tile, block, rows, known, last = (group, i, j), None, ([], [], []), set(), 0
                if side != last:
                    known, last = set(), side
                words = flat[offsets[r] : offsets[r + 1]]
                if (held := words.tobytes()) in known:  # of equal sets only the first can stay
                    if i == j:
                        out.append((node, at, None, None, True, False))
                else:
                    known.add(held)
                    if side == 0:
                        rows[0].append((at, node))
                        rows[1].append(np.frombuffer(held, np.int64))
                        rows[2].append(asks)
                    elif rows[0]:
                        built()
                        probe((at, node), block.looked_up(words), len(words), asks, len(block.keys))
                if len(out) >= 8192:
                    yield flushed()
        ended()
        yield flushed()

    return run


def dealt(sets: DataFrame, blocks: DataFrame) -> DataFrame:
    """sets (group, node, at, asks, x), each with all blocks of its group: i, j are the tile, side says which of them the set is of."""
    placed = sets.join(F.broadcast(blocks), "group").withColumn("block", F.pmod(F.xxhash64("x"), F.col("n_blocks")))
    first = F.expr("transform(sequence(block, n_blocks - 1), j -> struct(block AS i, j AS j, 0 AS side))")
    other = F.expr("transform(filter(sequence(0L, block), i -> i < block), i -> struct(i AS i, block AS j, 1 AS side))")
    return placed.withColumn("t", F.explode(F.concat(first, other))).select("group", "t.i", "t.j", "t.side", "at", "node", "asks", "x")


def _found(sets: DataFrame, blocks: DataFrame, least: float, parts: int) -> DataFrame:
    """node, at, by, by_at, copy, more: conflicts of sets that ask with earlier ones, copies of earlier ones, and which have more than is listed."""
    kind = sets.schema["node"].dataType.simpleString()
    node_type = pa.int64() if kind == "bigint" else pa.string()
    met = dealt(sets, blocks).repartition(parts, "group", "i", "j").sortWithinPartitions("group", "i", "j", "side", "at", "node")
    return met.mapInArrow(_tile(least, node_type, LISTED), f"node {kind}, at long, by {kind}, by_at long, copy boolean, more boolean")


def unlike(rows: DataFrame, groups: DataFrame, least: float, tile: int | None = None) -> DataFrame:
    """node: of rows (group, node, at, x) those that go: their words x overlap by more than `least` of the smaller number with a row of their group that stays and comes before, by (at, node).

    groups: group, words (their number in all) of the groups that take part. x: an array of different words, sorted, not empty.
    """
    kind = "long" if rows.schema["node"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") else "string"
    blocks = settled(groups.select("group", F.ceil(F.col("words") / (tile or TILE)).cast("long").alias("n_blocks")))
    tiles = blocks.agg(F.sum(F.expr("n_blocks * (n_blocks + 1) / 2"))).first()[0] or 0
    parts = int(min(max(3 * tiles, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 8192))
    part = rows.join(F.broadcast(blocks.select("group")), "group", "left_semi").select("group", F.col("node").cast(kind).alias("node"), F.col("at").cast("long").alias("at"), "x")
    seed = 0
    while not part.select(F.explode("x").alias("w")).groupBy(F.xxhash64("w", F.lit(seed)).alias("h")).agg(F.min("w").alias("a"), F.max("w").alias("z")).where("a <> z").isEmpty():
        seed += 1
    sets = part.withColumn("x", F.transform("x", lambda w: F.xxhash64(w, F.lit(seed))))
    found = settled(_found(sets.withColumn("asks", F.lit(True)), blocks, least, parts))
    copies, edges, doubtful = found.where("copy").select("node"), found.where("by IS NOT NULL"), found.where("more").select("node").distinct()
    while True:
        pair = F.to_json(F.struct("node", "by"))
        ends = edges.select(F.explode(F.array(F.struct(pair.alias("bucket"), "node", "at"), F.struct(pair.alias("bucket"), F.col("by").alias("node"), F.col("by_at").alias("at")))).alias("e"))
        chosen = kept_in_order(ends.select("e.bucket", "e.node", "e.at", F.lit(True).alias("probe"), F.lit(0).alias("x")), lambda x, y: True)
        gone = settled(chosen.where("NOT kept").select("node").unionByName(copies))
        ask = settled(doubtful.join(gone, "node", "left_anti"))
        if ask.isEmpty():
            return gone
        stay = sets.join(gone, "node", "left_anti").join(ask.withColumn("asks", F.lit(True)), "node", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
        new = settled(_found(stay.select(*sets.columns, "asks"), blocks, least, parts).where("by IS NOT NULL"))
        if new.isEmpty():
            return gone
        edges = settled(edges.unionByName(new))
