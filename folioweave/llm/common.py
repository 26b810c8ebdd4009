"""What the operators of this subpackage share: written tables, gapless numbering, held-out rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that is unset a folder of this machine is made, and only in a local session, as in tests.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="folioweave-")
        atexit.register(shutil.rmtree, _own_dir, True)
    return f"file://{_own_dir}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """df, written once to the shared folder and reread: its lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = path or fresh_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    goes_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _located(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def goes_at_exit(spark: SparkSession, path: str) -> None:
    """Results may still read a written table when an operator returns: it goes when the driver ends."""
    store, where = _located(spark, path)
    store.deleteOnExit(where)


def drop_written(spark: SparkSession, *paths: str) -> None:
    """Delete tables of the shared folder that nothing reads any more."""
    for path in paths:
        store, where = _located(spark, path)
        store.delete(where, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs now rather than at the driver's next full collection."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from; a null id counts as not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


#: Groups of which sampled() sends the sizes to the tasks: the largest ones.
LARGEST = 4096


def sampled(rows: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """The `most` rows of each group that come first by a hash of their key, ties by the key.

    Of the LARGEST groups only rows below a hash that about four times as many have are ranked, so no task ranks a whole
    large group.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n"), group).limit(LARGEST)
    share = F.xxhash64(key).cast("double") / 2.0**64 + 0.5
    few = rows.join(F.broadcast(sizes), group, "left").where(share <= F.coalesce(4.0 * most / F.col("__n"), F.lit(1.0)))
    pick = F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64(key), key))
    return few.withColumn("r", pick).where(F.col("r") <= most).drop("__n")


def apart(df: DataFrame, name: str, check: str) -> DataFrame:
    """df with another number in `name` wherever contents that differ in `check` had the same one.

    Both are 64-bit hashes of a content: afterwards equal numbers mean contents that are equal in 128 bits. Nulls stay.
    """
    while True:
        clash = df.groupBy(name).agg(F.min(check).alias("__least"), F.max(check).alias("__most")).where("__least < __most").select(name, "__least")
        if not clash.limit(1).count():
            return df
        other = F.when(F.col(check) != F.col("__least"), F.xxhash64(name, check)).otherwise(F.col(name))
        df = df.join(clash, name, "left").withColumn(name, other).select(*df.columns)


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, first: int = 0, pieces: int = 256) -> DataFrame:
    """df with a gapless number in each group, without ever sorting a whole group in one task.

    Each group is dealt into `pieces` by a hash of the order columns; the pieces' sizes (at most pieces rows per
    group) give each piece its first number, and rows are numbered inside their piece by the order columns.
    Null group values are a group. Rows equal in all order columns are interchangeable.
    """
    piece, base, at = f"__piece_{name}", f"__base_{name}", f"__at_{name}"
    dealt = df.withColumn(piece, F.pmod(F.xxhash64(*order), F.lit(pieces)).cast("int"))
    sizes = dealt.groupBy(*group, piece).agg(F.count(F.lit(1)).alias(base))
    w = Window.partitionBy(*group).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn(base, F.coalesce(F.sum(base).over(w), F.lit(0)))
    keys = [*group, piece]
    starts = starts.select(*[F.col(k).alias(f"__g_{k}") for k in keys], base)
    ranked = dealt.withColumn(at, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    same = [ranked[k].eqNullSafe(F.col(f"__g_{k}")) for k in keys]
    on = same[0]
    for x in same[1:]:
        on = on & x
    out = ranked.join(starts, on, "left")
    return out.withColumn(name, (F.col(base) + F.col(at) - 1 + first).cast("long")).drop(piece, base, at, *[f"__g_{k}" for k in keys])
