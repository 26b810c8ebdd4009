import numpy as np
from pyspark.sql import functions as F

from folioweave.llm.block_join import inner, nearest, quantise, search_group, tile_products

SCHEMA = "vec_id long, embedding array<float>, label int, g string, dim string"


def brute(rows, k):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = min(ok.get(i, v), v)
    out = []
    for q, x in ok.items():
        if q % 20 == 0:
            s = sorted((-float(inner(np.array([x], float), np.array([y], float))[0]), c) for c, y in ok.items() if c != q and len(y) == len(x))
            out += [(q, r + 1, c, -d) for r, (d, c) in enumerate(s[:k])]
    return sorted(out)


def test_bounds_hold():
    rng = np.random.default_rng(0)
    q, c = rng.normal(size=(50, 70)), rng.normal(size=(60, 70)) * rng.uniform(0.01, 100, (60, 1))
    q8, qs, qn, qe = quantise(q)
    c8, cs, _, ce = quantise(c)
    near = tile_products(q8, c8) * (qs[:, None] * cs)
    off = qe[:, None] * np.sqrt((c * c).sum(1)) + qn[:, None] * ce
    assert (np.abs(near - q @ c.T) <= off * (1 + 1e-9)).all()
    heaps = search_group(np.arange(50), q, np.arange(1000, 1060), c, 7)
    assert np.allclose(heaps.score, -np.sort(-(q @ c.T), axis=1)[:, :7])


def test_against_brute_force_on_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = sorted(tuple(r) for r in nearest(df, F.col("vec_id") % 20 == 0).collect())
    assert got == brute([(r.vec_id, r.embedding) for r in df.collect()], 20)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    vecs = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (20, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [3.0]), (8, []), (9, [-1.0, 0.5]), (40, [2.0])]
    df = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in vecs], SCHEMA)
    assert sorted(tuple(r) for r in nearest(df, F.col("vec_id") % 20 == 0, k=3).collect()) == brute(vecs, 3)
    assert nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    same = spark.createDataFrame([(i, [1.0, 1.0], 1, "x", "y") for i in range(100)], SCHEMA)
    assert sorted(tuple(r) for r in nearest(same, F.col("vec_id") % 20 == 0, k=4).collect()) == brute([(i, [1.0, 1.0]) for i in range(100)], 4)
