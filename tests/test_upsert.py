import pytest

from folioweave.sources import upsert as up

SCHEMA = "k long, v string, at int, bucket int"


def rows_of(df):
    return sorted((r.k is not None, r.k or 0, r.v) for r in df.collect())


def files(folder):
    return {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_upserts_touch_only_their_buckets(spark, tmp_path):
    folder = str(tmp_path / "t")
    first = spark.createDataFrame([(i, f"a{i}", 1, 0) for i in range(500)] + [(None, "none", 1, 0)], SCHEMA).drop("bucket")
    assert up.read(spark, folder) is None and up.upsert(first, folder, "k", "at", 16) == 0
    before, known = files(tmp_path), up.manifest(spark, folder)
    second = spark.createDataFrame([(7, "b7", 2, 0), (7, "newest", 9, 0), (7, "undated", None, 0), (None, "other", 2, 0), (10_001, "new", 1, 0)], SCHEMA).drop("bucket")
    assert up.upsert(second, folder, "k", "at") == 1
    want = sorted([(True, i, "newest" if i == 7 else f"a{i}") for i in range(500)] + [(False, 0, "other"), (True, 10_001, "new")])
    assert rows_of(up.read(spark, folder)) == want
    # Old files are as they were, and most buckets still consist of them alone.
    assert {p: t for p, t in files(tmp_path).items() if p in before} == before
    now = up.manifest(spark, folder)
    assert sum(now[b]["paths"] == known[b]["paths"] for b in known) >= len(known) - 3
    assert rows_of(up.read(spark, folder, 0)) == rows_of(first)
    assert up.upsert(second.limit(0), folder, "k", "at") == 1


def test_a_failed_write_leaves_the_old_table(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a", 1, 0), (2, "b", 1, 0)], SCHEMA).drop("bucket")
    up.upsert(df, folder, "k", "at")
    commit = up._commit
    monkeypatch.setattr(up, "_commit", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        up.upsert(spark.createDataFrame([(1, "c", 2, 0)], SCHEMA).drop("bucket"), folder, "k", "at")
    monkeypatch.setattr(up, "_commit", commit)
    assert rows_of(up.read(spark, folder)) == rows_of(df)
    with pytest.raises(RuntimeError, match="another writer"):
        commit(spark, folder, 0, {})
    assert up.upsert(spark.createDataFrame([(1, "c", 2, 0)], SCHEMA).drop("bucket"), folder, "k", "at") == 1
    assert rows_of(up.read(spark, folder)) == [(True, 1, "c"), (True, 2, "b")]
