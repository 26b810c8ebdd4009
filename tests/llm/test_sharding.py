import math
import zlib
from collections import Counter, defaultdict

import xxhash

from folioweave.llm.sharding import HashTree, assign_shards

SCHEMA = "doc_id long, text string, shard string, slot int, lang string"


def test_laws_on_many_ids(spark):
    docs = spark.range(0, 8000).selectExpr("id AS doc_id", "concat('é', id) AS text", "'x' AS shard", "1 AS slot")
    rows = assign_shards(docs, HashTree.balanced(40)).collect()
    assert {r.shard for r in rows} == set(range(40))
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 40)
        text = f"é{r.doc_id}".encode()
        assert (r.size, r.text_crc32) == (len(text) + 16, zlib.crc32(text))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    n = Counter(r.shard for r in rows)
    assert 130 < min(n.values()) and max(n.values()) < 280
    assert 120 < sum(r.grown_shard == 40 for r in rows) < 280


def test_each_growth_moves_rows_only_into_itself(spark):
    docs = spark.range(0, 2000).selectExpr("id AS doc_id", "'' AS text")
    tree, before = HashTree.balanced(7, regions=2, racks=2), None
    for _ in range(4):
        now = {r.doc_id: (r.shard, r.grown_shard) for r in assign_shards(docs, tree).collect()}
        if before:
            assert all(now[d][0] == before[d][1] for d in now)
        new = tree.shards
        assert all(b in (a, new) for a, b in now.values())
        before, tree = now, tree.grown()


def test_weights_move_rows_only_between_the_changed_subtree_and_the_rest(spark):
    docs = spark.range(0, 3000).selectExpr("id AS doc_id", "'' AS text")
    light = HashTree({0: {0: {0: 1.0, 1: 1.0}}, 1: {0: {2: 1.0, 3: 1.0}}})
    heavy = HashTree({0: {0: {0: 1.0, 1: 1.0}}, 1: {0: {2: 2.0, 3: 2.0}}})
    a = {r.doc_id: r.shard for r in assign_shards(docs, light).collect()}
    b = {r.doc_id: r.shard for r in assign_shards(docs, heavy).collect()}
    assert all(a[d] == b[d] or (a[d] in (0, 1) and b[d] in (2, 3)) for d in a)


def test_edges(spark):
    rows = [(None, None, "a", 1, "x"), (1, None, "a", 1, "x"), (1, "b", "a", 1, "x"), (1, "b", "a", 1, "x"), (2, "", None, None, None)]
    out = assign_shards(spark.createDataFrame(rows, SCHEMA), HashTree.balanced(3)).collect()
    assert len(out) == 5
    assert len({(r.shard, r.slot) for r in out}) == 5
    assert {(r.doc_id, r.size, r.text_crc32) for r in out} >= {(None, 16, 0), (1, 16, 0), (2, 16, 0)}
    assert assign_shards(spark.createDataFrame([], SCHEMA), HashTree.balanced(40)).count() == 0


def draw(key, level, name, weight):
    h = 42
    for part in (key, level, name):
        h = xxhash.xxh64_intdigest(part.encode(), seed=h)
    return -math.log(((h >> 11) + 0.5) * 2.0**-53) / weight


def second_shard(key, tree):
    """The shard of a key by plain loops over the tree."""
    weight = lambda racks: sum(w for s in racks.values() for w in s.values())
    top, r = min((draw(key, "region", f"/{r}", weight(racks)), r) for r, racks in tree.planned.items())
    _, k = min((draw(key, "rack", f"{r}/{k}", sum(s.values())), k) for k, s in tree.planned[r].items())
    _, shard = min((draw(key, "shard", f"{r}/{k}/{s}", w), s) for s, w in tree.planned[r][k].items())
    late = min(((draw(key, "added", str(s), w), s) for s, _, _, w in tree.added), default=(math.inf, None))
    return late[1] if late[0] < top else shard


def test_the_whole_query_by_a_second_computation(spark, sf):
    from folioweave.llm.sharding import op1

    tree = HashTree.balanced(40)
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert (r.shard, r.grown_shard) == (second_shard(str(r.doc_id), tree), second_shard(str(r.doc_id), tree.grown()))
        assert (r.size, r.text_crc32, r.law) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id]), "key")
    for shard in range(40):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
