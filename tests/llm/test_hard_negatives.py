import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioweave.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, g string, s int, positives string"


def brute(rows):
    ok = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(256 * x) for x in v]
            if sum(x * x for x in q) < hn.NORM:
                new = ((label + 1) % 10 if i % 7 == 0 else label, q)
                ok[i] = min(ok.get(i, new), new)
    out = []
    for a, (label, x) in ok.items():
        if a % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), c, m) for c, (m, y) in ok.items() if c != a)
        for s, p, m in [t for t in scored if t[2] == label][:5]:
            found = [(n, -t) for t, n, m in scored if m != label and -50 * s <= -100 * t <= -95 * s][:3]
            out += [(a, p, r, n, -s, t) for r, (n, t) in enumerate(found, 1)]
    return sorted(out)


def got(df, **more):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in hn.mined(df, F.col("vec_id") % 50 == 0, label, **more).collect())


def test_given_table_against_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert got(df) == brute([(r.vec_id, r.embedding, r.label) for r in df.collect()]) != []


@pytest.mark.parametrize("scale", [0.2, 30.0, 9e5])
def test_clusters_are_pruned_and_nothing_is_lost(spark, monkeypatch, scale):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6)) * 5
    x = (centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 6)) * 0.3) * scale / 25
    x[200:700] = x[200]  # a hot group of copies
    ids = rng.permutation(1500).tolist()
    rows = [(i, x[k].tolist(), int(rng.integers(0, 3)), "g", 1, "p") for k, i in enumerate(ids)]
    sent, served = [], hn.Cells.served
    monkeypatch.setattr(hn, "GROUPS", 6)
    monkeypatch.setattr(hn, "SMALL", 10)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df, pivots=20) == brute([r[:3] for r in rows]) != []
    # Bounds do leave candidates out: count what a search of near ones sends.
    q = np.floor(256 * x)
    most = float((q * q).sum(1).max())
    space = hn.Space.of([{"q": r.tolist()} for r in q[:20]], most, 6, int(np.abs(q).max()))
    e = space.anchors(q)
    cell = e.argmin(1)
    about = [{"cell": i, "n": int((cell == i).sum()), "far": e[cell == i].min(1).max(), "least": e[cell == i].min(1).min(), "reach": np.quantile(e, 0.02), "near": 0.0} for i in np.unique(cell).tolist()]
    cells = hn.Cells.of(about, space).looking(about)
    sent = served(cells, space.candidates(q), space)
    assert 0 < sent.mean() < 0.9
    # and never one that an anchor of the group reaches.
    far = np.sqrt(np.maximum((q * q).sum(1)[:, None] + most - 2 * q @ q.T, 0))
    group = cells.group(cell, np.arange(1500))
    reached = far <= np.quantile(e, 0.02)
    for g in range(cells.groups):
        assert sent[reached[group == g].any(0), g].all()


def test_split_groups_and_slices(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (900, 3)) / 4  # many ties and repeated rows
    rows = [(i if i % 2 else i * 25, x[i].tolist(), i % 2, "g", 1, "p") for i in range(900)]
    for name, value in (("SIDE", 40), ("SLICE", 16), ("SMALL", 5), ("LARGEST", 1)):
        monkeypatch.setattr(hn, name, value)
    assert got(spark.createDataFrame(rows, SCHEMA), pivots=4) == brute([r[:3] for r in rows])


def test_edges(spark):
    nan, inf = math.nan, math.inf
    vecs = [(0, [1.0, 2.0], 1), (50, [1.0, 2.0], 2), (50, [1.0, 2.5], 2), (100, [], 3), (1, [], 3), (2, [0.0, 0.0], 4), (3, None, 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (None, [1.0, 1.0], 1), (8, [3.0], 1), (9, [1.0, 1.2], 1), (10, [0.8, 1.5, 7.0], 2), (11, [1e300, 1.0], 1), (12, [1.0, 1.0], None), (150, [-1.0, 0.0], 5), (13, [1.0, 0.0], 5), (200, [2.0**20, 1.0], 1), (14, [9e5, -3.0], 2), (250, [9e5, 2.0], 7), (15, [9.1e5, 2.0], 7), (16, [0.6, 1.9], 5)]
    vecs += [(i, [1.0, 1.5], i % 5) for i in range(300, 420)]
    df = spark.createDataFrame([(i, v, label, "g", 1, "p") for i, v, label in vecs], SCHEMA)
    assert got(df) == brute(vecs)
    assert got(df.limit(0)) == []
    assert got(df.where("vec_id = 0")) == []
    assert got(spark.createDataFrame([(0, [], 1, "g", 1, "p"), (1, [], 1, "g", 1, "p"), (2, [], 2, "g", 1, "p")], SCHEMA)) == [(0, 2, 1, 1, 0, 0)]  # 0 is divisible by 7
