"""A table with upserts that rewrite only what they touch, and a commit.

Rows lie in buckets by a hash of their key. An upsert reads the buckets that its keys fall into, and of these only those whose
filter of keys says that some may be there already; the others just get one more folder. What is written goes to a folder of
the new version, and then a manifest, which names the folders of each bucket, is moved into place in one step: readers
see the old version or the new one, and a write that fails leaves the old one as it is. Two writers of one version can't
both win, as the second finds the manifest there.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = 64
#: Letters of a bucket's filter, in hexadecimal: a bit for each of as many hashes.
FILTER_BITS = 1 << 12


def _store(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def version(spark: SparkSession, folder: str) -> int:
    """The number of the last version, -1 without one."""
    store, where = _store(spark, f"{folder}/manifests")
    if not store.exists(where):
        return -1
    return max((int(s.getPath().getName()[1:]) for s in store.listStatus(where) if s.getPath().getName().startswith("v")), default=-1)


def manifest(spark: SparkSession, folder: str, number: int | None = None) -> dict[str, dict]:
    """bucket to its folders and filter: as many entries as buckets."""
    number = version(spark, folder) if number is None else number
    if number < 0:
        return {}
    return json.loads("\n".join(r["value"] for r in spark.read.text(f"{folder}/manifests/v{number}").collect()))


def read(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame | None:
    """The table as of a version, the last one if none is named; None where there is none."""
    known = manifest(spark, folder, number)
    paths = [p for b in known.values() for p in b["paths"]]
    return spark.read.parquet(*paths) if paths else None


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _bit(key: str) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(7)), F.lit(FILTER_BITS)).cast("int")


def _bits(rows: DataFrame, key: str) -> dict[int, set[int]]:
    """bucket to the bits of its keys: at most buckets * FILTER_BITS rows."""
    found: dict[int, set[int]] = {}
    for r in rows.select("bucket", _bit(key).alias("bit")).distinct().collect():
        found.setdefault(r["bucket"], set()).add(r["bit"])
    return found


def _packed(bits: set[int]) -> str:
    return f"{sum(1 << b for b in bits):x}"


def _unpacked(text: str) -> int:
    return int(text, 16)


def upsert(new: DataFrame, folder: str, key: str, newest: str, buckets: int = BUCKETS) -> int:
    """SNK3: put new rows in place of those of the same key; of repeated new rows that with the greatest `newest` (nulls last). Returns the version.

    Rows with a null key are one key. The number of buckets is that of the first version. An upsert without rows writes nothing.
    """
    spark = new.sparkSession
    at = version(spark, folder)
    known = manifest(spark, folder, at)
    if known:
        buckets = next(iter(known.values()))["of"]
    target = f"{folder}/data/v{at + 1}-{uuid.uuid4().hex}"
    last = Window.partitionBy(key).orderBy(F.desc_nulls_last(newest))
    rows = new.withColumn("bucket", _bucket(key, buckets))
    once = rows.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")
    bits = _bits(once, key)
    if not bits:
        return at
    meets = {b for b, s in bits.items() if str(b) in known and _unpacked(known[str(b)]["filter"]) & int(_packed(s), 16)}
    out = once
    old_paths = [p for b in sorted(meets) for p in known[str(b)]["paths"]]
    if old_paths:
        old = spark.read.parquet(*old_paths).withColumn("bucket", _bucket(key, buckets))
        stays = old.join(once.select(F.col(key).alias("__k")), F.col(key).eqNullSafe(F.col("__k")), "left_anti")
        out = once.unionByName(stays.select(*once.columns))
    out.repartition("bucket").write.partitionBy("bucket").parquet(target)
    merged = dict(known)
    for b, s in bits.items():
        before = known.get(str(b), {"paths": [], "filter": "0"})
        kept = [] if b in meets else before["paths"]
        merged[str(b)] = {"paths": [*kept, f"{target}/bucket={b}"], "filter": f"{_unpacked(before['filter']) | int(_packed(s), 16):x}", "of": buckets}
    _commit(spark, folder, at + 1, merged)
    return at + 1


def _commit(spark: SparkSession, folder: str, number: int, content: dict) -> None:
    store, _ = _store(spark, folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    draft = path(f"{folder}/drafts/{uuid.uuid4().hex}")
    out = store.create(draft)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    store.mkdirs(path(f"{folder}/manifests"))
    place = path(f"{folder}/manifests/v{number}")
    if store.exists(place) or not store.rename(draft, place):
        raise RuntimeError(f"version {number} was written by another writer")
