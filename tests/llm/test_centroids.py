import hashlib
import math

import numpy as np
import pytest

from folioweave.llm.centroids import clustered, nearest

SCHEMA = "vec_id long, embedding array<double>, label int, q string, cluster string, n int"


def brute(rows, k, rounds=5, dim=64):
    vs = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and abs(256 * x) < 1 << 27 for x in v)]
    cs = [v for _, _, v in sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), i, v) for i, v in vs if i is not None)[:k]]
    if not cs:
        return []

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs))

    for _ in range(rounds):
        members = {}
        for _, v in vs:
            members.setdefault(near(v)[1], []).append(v)
        cs = [[sum(x) // len(members[j]) for x in zip(*members[j], strict=True)] if j in members else c for j, c in enumerate(cs)]
    last = [(i, *near(v)[::-1]) for i, v in vs]
    part = {}
    for _, c, d in last:
        part[c] = part.get(c, 0) + d
    return [(i, c, d, part[c], sum(part.values()), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for i, c, d in last]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("size", [3, 3000, 1 << 26])
def test_search_is_exact_with_ties(size):
    rng = np.random.default_rng(size)
    x, c = rng.integers(-size, size, (500, 64)), rng.integers(-size, size, (30, 64))
    c[7], c[20] = c[3], c[11]  # ties
    x[:40] = c[rng.integers(0, 30, 40)]
    full = ((x[:, None, :] - c[None, :, :]) ** 2).sum(2)
    number, distance = nearest(x, c)
    assert (number == full.argmin(1)).all() and (distance == full.min(1)).all()


def test_given_table_against_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert ordered(clustered(df).collect()) == ordered(brute([(r.vec_id, r.embedding) for r in df.collect()], 40))


def test_edges(spark):
    rng = np.random.default_rng(1)
    good = [rng.normal(size=6).tolist() for _ in range(30)]
    odd = [None, [], [1.0] * 5, [1.0] * 7, [None, *[1.0] * 5], [math.nan, *[1.0] * 5], [math.inf, *[1.0] * 5], [1e300, *[0.0] * 5], [1e6, *[0.0] * 5]]
    large = [[5e5 * x for x in (1, -1, 0.5, 0.25, -0.75, 0)], [-5e5] * 6]
    vecs = [*enumerate(good), (3, good[3]), (3, good[4]), (None, good[0]), (None, [0.0] * 6), *[(100 + i, v) for i, v in enumerate(odd)], *[(200 + i, v) for i, v in enumerate(large)], *[(300 + i, good[7]) for i in range(50)]]
    df = spark.createDataFrame([(i, v, None, "q", "c", 1) for i, v in vecs], SCHEMA)
    for k in (1, 7, 500):
        assert ordered(clustered(df, k=k, dim=6).collect()) == ordered(brute(vecs, k, dim=6))
    assert clustered(df.limit(0)).count() == 0
    assert clustered(df.where("vec_id is null"), dim=6).count() == 0
