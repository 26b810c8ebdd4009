import numpy as np
from pyspark.sql import functions as F

from folioweave.llm.toxicity import K, build, isotonic, score_toxicity, train


def example_index(n=400, terms=12, seed=0):
    rng = np.random.default_rng(seed)
    ex = []
    for i in range(n):
        y = int(rng.random() < 0.4)
        found = {int(t): int(rng.integers(1, 4)) for t in rng.choice(terms, rng.integers(0, 5), replace=False)}
        ex.append((i, y, found))
    n_with = [sum(t in e[2] for e in ex) for t in range(terms)]
    return build([f"t{i}" for i in range(terms)], n_with, ex, {0: 5000, 1: 900}), ex


def test_pruned_search_is_exact():
    index, ex = example_index()
    kept = [index.vector(e[2]) for e in ex if e[2]]
    assert len(index.blocks) > 3
    dense = np.zeros((len(index.ids), 12))
    by_id = {e[0]: e[2] for e in ex}
    for row, i in enumerate(index.ids):
        at, v = index.vector(by_id[int(i)])
        dense[row, at] = v
    for at, v in kept[:150]:
        q = np.zeros(12)
        q[at] = v
        sims = dense @ q
        want = [i for i in np.lexsort((np.arange(len(sims)), -np.round(sims, 12))) if sims[i] > 0][:K]
        ids, got = index.nearest(at, v)
        assert ids.tolist() == want and np.allclose(got, sims[want])


def test_isotonic():
    cuts, values = isotonic(sorted([(0.1, 0, 1), (0.2, 1, 1), (0.3, 0, 1), (0.9, 1, 2), (0.9, 1, 1)]))
    assert cuts.tolist() == [0.1, 0.2, 0.9] and values.tolist() == [0.0, 0.5, 1.0]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = score_toxicity(docs, train(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    held = [(r.predicted, r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    hit = sum(p and y for p, _, y in held)
    assert hit / sum(y for *_, y in held) > 0.8 and hit / sum(p for p, *_ in held) > 0.8


def test_edges(spark):
    docs = spark.createDataFrame([(None, "bad", "x"), (1, None, "x"), (2, "", "x"), (3, "bad word", "x"), (3, "bad word", "x")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int, text string")
    out = score_toxicity(docs, train(docs, none)).collect()
    assert len(out) == 5 and all(r.score == 0 and r.predicted == 0 for r in out)
    odd = spark.createDataFrame([(3, None, "t"), (None, 1, "t"), (4, 7, "t"), (2, 1, "t"), (2, 0, "t")], "doc_id long, toxic int, text string")
    assert score_toxicity(docs, train(docs, odd)).count() == 5
    many = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.when(F.col("id") % 4 == 0, "you vile thing").otherwise("a fine day"), F.translate((F.col("id") * 7919).cast("string"), "0123456789", "qwertzuiop")).alias("text"), F.lit(1).alias("cosines"))
    got = score_toxicity(many, train(many, many.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")))).collect()
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in got)
    assert all(r.neighbours and r.terms for r in got)


def test_the_whole_query_by_brute_force(spark, sf):
    import re

    from folioweave.llm.toxicity import BEGINNINGS, SMOOTH, op5

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    index = train(docs, labels)
    dense = np.zeros((len(index.ids), len(index.terms)))
    for block in index.blocks:
        for t, (i, w) in block.postings.items():
            dense[block.first + i, t] = w
    got = {r.doc_id: r for r in op5(spark, sf).collect()}
    assert len(got) == docs.count()
    for d in docs.collect():
        q = np.zeros(len(index.terms))
        for word in re.findall(r"[^\W\d_]+", (d.text or "").lower()):
            for f in [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]:
                if f in index.terms:
                    q[index.terms[f]] += 1
        want = index.none
        if q.any():
            q = np.where(q > 0, (1 + np.log(np.maximum(q, 1))) * index.idf, 0)
            sims = dense @ (q / np.sqrt(q @ q))
            near = [i for i in sorted(range(len(sims)), key=lambda i: (-round(sims[i], 12), i))[:K] if sims[i] > 0]
            if near:
                w = [index.weight[i] / (1 - min(sims[i], 1) + SMOOTH) for i in near]
                vote = sum(x for i, x in zip(near, w, strict=True) if index.toxic[i]) / sum(w)
                below = [v for c, v in zip(index.cuts, index.values, strict=True) if c <= vote + 1e-12]
                want = below[-1] if below else index.values[0]
        assert abs(got[d.doc_id].score - want) < 1e-9 and got[d.doc_id].predicted == int(got[d.doc_id].score >= 0.7)
