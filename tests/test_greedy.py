import random

import pytest
from pyspark.sql import functions as F

from folioweave.functions.fuzzy import token_sort_ratio
from folioweave.operators import greedy as gr
from folioweave.operators import symbols as sy
from folioweave.operators import views as vw

SCHEMA = "bucket long, node long, at long, probe boolean, x long"


def brute(nodes, conflict):
    kept = []
    for _, node, x in sorted(nodes):
        if not any(conflict(x, y) for _, y in kept):
            kept.append((node, x))
    return {n for n, _ in kept}


def near(x, y):
    return abs(x - y) <= 3


def placed(nodes):
    """Numbers within 3 of each other share one of two buckets of 8; the second is looked up by one side only."""
    return [r for at, node, x in nodes for r in ((x // 8 * 2, node, at, True, x), ((x + 4) // 8 * 2 + 1, node, at, True, x))]


@pytest.mark.parametrize("order", ["random", "chain", "ties"])
def test_rounds_equal_the_loop(spark, monkeypatch, order):
    rng = random.Random(7)
    xs = [rng.randrange(900) for _ in range(700)] if order != "chain" else [2 * i for i in range(400)]
    at = {"random": lambda i: rng.randrange(10**6), "chain": lambda i: i, "ties": lambda i: i % 2}[order]
    nodes = [(at(i), i, x) for i, x in enumerate(xs)]
    monkeypatch.setattr(gr, "PREFIX", 40)
    monkeypatch.setattr(gr, "SLICE", 3)
    df = spark.createDataFrame(placed(nodes), SCHEMA)
    rows = gr.kept_in_order(df, near, window=5, few=10).collect()
    assert {r.node for r in rows if r.kept} == brute(nodes, near)
    assert sorted(r.node for r in rows) == sorted(n for _, n, _ in nodes)


def test_one_bucket_beyond_the_window(spark, monkeypatch):
    """Rows of one bucket, few of which conflict: the window moves on until all are settled."""
    monkeypatch.setattr(gr, "PREFIX", 8)
    nodes = [(i * 7919 % 211, i, i * 5 % 190) for i in range(211)]
    df = spark.createDataFrame([(0, n, at, True, x) for at, n, x in nodes], SCHEMA)
    same = lambda x, y: x == y
    rows = gr.kept_in_order(df, same, window=16, few=4).collect()
    assert {r.node for r in rows if r.kept} == brute(nodes, same)


def test_nothing_and_probes(spark):
    assert gr.kept_in_order(spark.createDataFrame([], SCHEMA), near).count() == 0
    # 1 and 2 only meet where neither is looked up; 3 is looked up where 2 is.
    rows = [(0, 1, 0, False, 5), (0, 2, 1, False, 5), (1, 2, 1, False, 5), (1, 3, 2, True, 5)]
    assert {(r.node, r.kept) for r in gr.kept_in_order(spark.createDataFrame(rows, SCHEMA), near).collect()} == {(1, True), (2, True), (3, False)}


def test_numbered_names_against_the_loop(spark, monkeypatch):
    """Nearly all of them resemble each other; pairs would be a hundred times the names."""
    monkeypatch.setattr(gr, "PREFIX", 100)
    texts = [f"supplier {i * 37 % 1000:09d}" for i in range(1000)]
    names = spark.createDataFrame([("ORG", t, i) for i, t in enumerate(texts)], "kind string, text string, ord int")
    heads, want = [], {}
    for t in texts:
        best = max(((token_sort_ratio(t, h), -i, h) for i, h in enumerate(heads)), default=(0, 0, ""))
        if best[0] < 88:
            heads.append(t)
        want[t] = "ORG:" + (best[2] if best[0] >= 88 else t)
    rows = sy.canonical_entities(names).collect()
    assert {r.text: r.entity_id for r in rows} == want and len(rows) == 1000 and 2 < len(heads) < 100


def test_timeline_against_the_loop(spark):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(14)]
    rows = []
    for i in range(400):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 7))) if i % 40 else rng.choice(["", "a b c", None])
        rows.append((i, rng.choice(["x", "y", None]) if i % 3 else "x", f"2020-01-0{rng.randrange(1, 4)}" if i % 50 else None, text, "p.1", "X"))
    rows += [(1000 + i, "x", "2020-01-05", "one sentence that is copied everywhere", "p.1", "X") for i in range(300)]

    def loop(facts, least, key):
        kept = []
        for f in sorted(facts, key=key):
            w = {v for v in (f[3] or "").split() if len(v) > 3}
            if not any(w and k and len(w & k) / min(len(w), len(k)) > least for k, _ in kept):
                kept.append((w, f))
        return [f for _, f in kept]

    dated = [r for r in rows if r[2]]
    first = [f for c in ("x", "y", None) for f in loop([r for r in dated if r[1] == c], 0.85, lambda f: f[0])]
    want = [f for c, d in {(f[1], f[2]) for f in first} for f in loop([f for f in first if (f[1], f[2]) == (c, d)], 0.5, lambda f: (-len(f[3] or ""), f[0]))]
    df = spark.createDataFrame(rows, "fact_id long, case string, date string, text string, section_label string, type string").withColumn("date", F.to_date("date"))
    assert sorted(r.fact_id for r in vw.timeline(df, "case").collect()) == sorted(f[0] for f in want)


def test_small_groups_send_a_fact_once(spark):
    """However many words a fact has, it is one place in a group of its size; in a larger group it has one for each shared word."""
    rows = [(i, f"case{i // 4}", " ".join(f"word{(i * 7 + j) % 50}" for j in range(30))) for i in range(40)]
    first = vw.first_of_words(spark.createDataFrame(rows, "fact_id long, case string, text string"), ["case"], F.lit(0))
    assert vw.word_places(first, ["case"], 0.85).count() == 40
    assert vw.word_places(first, ["case"], 0.85, small=2).count() > 400


@pytest.mark.parametrize("small", [1, 1024])
def test_both_ways_of_dealing_groups_keep_the_same(spark, monkeypatch, small):
    monkeypatch.setattr(vw.word_places, "__defaults__", (small,))
    rng = random.Random(2)
    rows = [(i, i % 3, " ".join(rng.choice([f"word{k}" for k in range(12)]) for _ in range(rng.randrange(1, 6))), "2020-01-01") for i in range(200)]
    df = spark.createDataFrame(rows, "fact_id long, case long, text string, date string")
    want = set()
    for c in range(3):
        kept = []
        for i, case, text, _ in rows:
            w = set(text.split())
            if case == c and not any(len(w & k) / min(len(w), len(k)) > 0.6 for k in kept):
                kept.append(w)
                want.add(i)
    assert {r.fact_id for r in vw.unrepeated(df, "case", 0.6).collect()} == want
