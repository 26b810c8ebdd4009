from pyspark.sql import functions as F

from folioweave.operators import graph as g
from folioweave.plans.adapters import order_facts
from folioweave.streaming import ingest, postings


def streamed(spark, batches, tmp_path, hub):
    source = str(tmp_path / "in")
    for i, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(source)
        query = postings.follow(ingest.stream(spark, source, batch.schema, 1), str(tmp_path / "out"), str(tmp_path / "cp"), hub)
        query.awaitTermination()
        assert query.exception() is None, i
    n = batches[0].unionByName(batches[1]).unionByName(batches[2]).select("fact_id").distinct().count()
    return postings.graph_of(spark, str(tmp_path / "out"), n, hub)


def test_batches_give_the_graph_of_all_facts(spark, tmp_path):
    """Orders in three deliveries, some of them late, some again, with keys that become hubs on the way."""
    for key, value in postings.STORE.items():
        spark.conf.set(key, value)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        facts = order_facts(spark, "/root/testdata/sf0.001").where("fact_id < 600")
        part = F.pmod(F.xxhash64("fact_id"), F.lit(3))
        batches = [facts.where(part == 0), facts.where((part == 1) | (F.col("fact_id") % 10 == 0)), facts.where((part == 2) | (F.col("fact_id") % 7 == 0))]
        for hub in (6,):
            got = sorted((r.a, r.b, round(r.score, 9), r.label, r.cross_doc) for r in streamed(spark, batches, tmp_path, hub).collect())
            want = sorted((r.a, r.b, round(r.score, 9), r.label, r.cross_doc) for r in g.edges(facts, hub=hub).collect())
            assert got == want and len(got) > 100
    finally:
        for key in postings.STORE:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
