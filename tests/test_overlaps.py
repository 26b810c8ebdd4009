import random

import pytest
from pyspark.sql import functions as F

from folioweave.operators import overlaps as ov
from folioweave.operators import views as vw


def brute(rows, least):
    """Which nodes go, of (group, node, at, x)."""
    kept, gone = {}, set()
    for group, node, _, x in sorted(rows, key=lambda r: (r[2], r[1])):
        if any(set(x) == set(k) or len(set(x) & set(k)) / min(len(x), len(k)) > least for k in kept.get(group, [])):
            gone.add(node)
        else:
            kept.setdefault(group, []).append(x)
    return gone


def sets_of(rng, n, words, longest):
    return [("ab"[i % 2], i, rng.randrange(5), sorted(rng.sample([f"word{k}" for k in range(words)], rng.randrange(1, longest)))) for i in range(n)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "group string, node long, at long, x array<string>")
    return df, df.groupBy("group").agg(F.sum(F.size("x")).alias("words"))


@pytest.mark.parametrize(("words", "longest", "least", "listed", "tile"), [(12, 6, 0.6, 1, 150), (300, 20, 0.3, 2, 10**6), (40, 30, 0.45, 8, 700), (25, 12, 0.0, 1, 400)])
def test_tiles_against_the_loop(spark, monkeypatch, words, longest, least, listed, tile):
    """Several blocks a group, copies, and more conflicts than a row lists."""
    monkeypatch.setattr(ov, "LISTED", listed)
    rows = sets_of(random.Random(words), 300, words, longest)
    df, groups = frame(spark, rows)
    found = [r.node for r in ov.unlike(df, groups, least, tile).collect()]
    assert set(found) == brute(rows, least)


def test_string_ids(spark):
    rows = [("g", "a | b", 0, ["left", "word"]), ("g", "c", 1, ["left", "word"]), ("g", "a", 2, ["left", "only"]), ("g", "b | c", 3, ["other"])]
    df = spark.createDataFrame(rows, "group string, node string, at long, x array<string>")
    groups = df.groupBy("group").agg(F.sum(F.size("x")).alias("words"))
    assert {r.node for r in ov.unlike(df, groups, 0.4).collect()} == {"c", "a"}


def test_large_groups_send_a_fact_for_each_block(spark, monkeypatch):
    """Before, a fact of a large group was sent with all its words for each word that it shares."""
    sent, deal = [], ov.dealt
    monkeypatch.setattr(vw, "SMALL", 20)
    monkeypatch.setattr(ov, "dealt", lambda sets, blocks: sent.append(deal(sets, blocks)) or sent[-1])
    rows = [(i, i % 2, " ".join(f"word{(i * 7 + j) % 90}" for j in range(30)), "2020-01-01") for i in range(80)]
    df = spark.createDataFrame(rows, "fact_id long, case long, text string, date string")
    want = brute([(c, i, 0, sorted(t.split())) for i, c, t, _ in rows], 0.6)
    assert {r.fact_id for r in vw.unrepeated(df, "case", 0.6).collect()} == set(range(80)) - want
    assert sent and sent[0].count() == 80
