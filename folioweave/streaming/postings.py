"""The evidence graph over arriving facts: postings as state, so that new facts meet all old ones.

Each key of the index keeps its facts, up to the hub limit, and how many it has had. A new fact pairs with the facts of its
keys; when a key becomes a hub, the pairs that it gave are taken back and its facts are let go. What comes out is a log
of changes: pairs that came (+1) or went (-1) by a key, and how often each key was met. The graph at any time follows from the
log: a pair counts while some key holds it, weights come from the keys' latest numbers. So the batches together give
the graph that one batch over all facts gives, whatever their order. Facts that are delivered again change nothing.

Needs the state store of RocksDB. State grows with keys times at most the hub limit, and with the ids seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from folioweave import lexicons as lx
from folioweave.operators.graph import _idf, _label_no, _named, keys_of, proximity, sparsified, total

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

CHANGES = "key string, entity boolean, n long, a long, b long, fa string, fb string, delta int"
_FACT = "doc_id string, date date, polarity string, entities array<string>"


class Postings(StatefulProcessor):
    """A key's facts."""

    def __init__(self, hub: int) -> None:
        self.hub = hub

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.members = handle.getListState("members", "fact_id long, fact string")
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        n = self.seen.get()[0] if self.seen.exists() else 0
        members = [tuple(m) for m in self.members.get()] if 0 < n <= self.hub else []
        before, out = n, []

        def change(x: tuple, y: tuple, delta: int) -> tuple:
            (a, fa), (b, fb) = sorted((x, y), key=lambda f: f[0])
            return (key[0], entity, None, int(a), int(b), fa, fb, delta)

        entity = False
        for pdf in rows:
            for fact_id, fact, is_entity in pdf[["fact_id", "fact", "entity"]].itertuples(index=False):
                entity, n = bool(is_entity), n + 1
                if n <= self.hub:
                    new = (int(fact_id), fact)
                    out += [change(m, new, 1) for m in members]
                    members.append(new)
                elif n == self.hub + 1:
                    # What the key gave in this batch and before goes.
                    out += [change(x, y, -1) for i, x in enumerate(members) for y in members[:i]]
                    members = []
        if n > before:
            out.append((key[0], entity, n, None, None, None, None, 0))
            self.seen.update((n,))
            if n <= self.hub:
                self.members.put(members)
            elif before <= self.hub:
                self.members.clear()
        frame = pd.DataFrame(out, columns=["key", "entity", "n", "a", "b", "fa", "fb", "delta"])
        yield frame.astype({"n": "Int64", "a": "Int64", "b": "Int64", "delta": "int32", "entity": "bool"})

    def close(self) -> None:
        pass


def changes(facts: DataFrame, hub: int = lx.HUB) -> DataFrame:
    """The log of a stream of facts; in one that is no stream, of all its facts at once. fact_id: a whole number."""
    once = facts.dropDuplicates(["fact_id"])
    packed = F.to_json(F.struct(F.col("doc_id").cast("string").alias("doc_id"), "date", "polarity", "entities"))
    rows = once.select(F.col("fact_id").cast("long").alias("fact_id"), "entities", packed.alias("fact"), keys_of().alias("key"))
    posts = rows.select("key", "fact_id", "fact", F.coalesce(F.array_contains("entities", F.col("key")), F.lit(False)).alias("entity"))
    return posts.groupBy("key").transformWithStateInPandas(Postings(hub), CHANGES, "append", "none")


def follow(facts: DataFrame, folder: str, checkpoint: str, hub: int = lx.HUB) -> StreamingQuery:
    """Write the log of a stream: a batch that runs again writes over what it wrote. New facts are counted beside it."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    return changes(facts, hub).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def graph_of(spark: SparkSession, folder: str, n_facts: int, hub: int = lx.HUB, top_k: int = lx.TOP_K, least: float = lx.MIN_SCORE) -> DataFrame:
    """a, b, score, label, cross_doc: the graph that the log stands for. n_facts: how many different facts there have been."""
    log = spark.read.schema(f"{CHANGES}, batch int").parquet(f"{folder}/changes")
    met = log.where("n IS NOT NULL").groupBy("key").agg(F.max("n").alias("df"))
    pairs = log.where("a IS NOT NULL").groupBy("a", "b").agg(F.sum("delta").alias("held"), F.first("fa").alias("fa"), F.first("fb").alias("fb")).where("held > 0")
    both = pairs.select("a", "b", F.from_json("fa", _FACT).alias("fa"), F.from_json("fb", _FACT).alias("fb"))
    idf = met.select("key", _idf(F.col("df"), F.lit(n_facts)).alias("idf"))
    shared = both.select("a", "b", F.explode(F.array_intersect("fa.entities", "fb.entities")).alias("key")).join(idf, "key")
    # In the order of the keys, as in a batch.
    entity = F.aggregate(F.transform(F.sort_array(F.collect_list(F.struct("key", "idf"))), lambda x: x["idf"]), F.lit(0.0), lambda s, x: s + x)
    weights = shared.groupBy("a", "b").agg(F.least(entity / 2.0, F.lit(1.0)).alias("entity"))
    parts = both.join(weights, ["a", "b"], "left").withColumn("entity", F.coalesce("entity", F.lit(0.0))).withColumn("time", proximity(F.col("fa.date"), F.col("fb.date"))).withColumn("same", F.when(F.col("fa.doc_id") == F.col("fb.doc_id"), lx.SAME_BONUS).otherwise(0.0))
    rows = parts.select("a", "b", total(F.lit(0.0)).alias("score"), _label_no(F.col("fa.polarity"), F.col("fb.polarity")).alias("label"), (F.col("fa.doc_id") != F.col("fb.doc_id")).alias("cross_doc"))
    return sparsified(rows, top_k, least).withColumn("label", _named(F.col("label")))
