"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Fitting uses at most SAMPLE rows of each label, chosen by a hash of the id from labelled rows that are not held out;
of near copies among them (COPY of SKETCH smallest shingle hashes in common) one stays, so that no wording counts for
being copied. Terms are words and their beginnings (`vile`, `vil*`) that go with a label beyond chance (chi-square at
least MIN_CHI2, at most MAX_TERMS). The examples' vectors, (1 + ln count) * idf of length one, lie in blocks of BLOCK examples: each block has its postings by
term and, by term, the largest weight. A document looks at the blocks in order of what their maxima allow at best and
stops once no block can reach its K-th neighbour, so the K nearest are exact.

Each neighbour votes with 1 / (distance + SMOOTH); the share of toxic votes passes a monotone calibration (pool
adjacent violators) that is fitted on the examples with themselves left out, weighted back to the labels' true
proportions. A document that has no term gets what such examples have.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm.common import held_out, sampled, table, written
from folioweave.llm.jaccard_join import shingle_set

SAMPLE = 1500
MAX_TERMS = 2048
MIN_CHI2 = 24.0
BLOCK = 64
K = 15
SMOOTH = 0.05
THRESHOLD = 0.7
CACHE = 50_000
SKETCH, COPY = 32, 8
BEGINNINGS = (4, 5, 6, 7)
MEMO = 400_000
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    first: int
    size: int
    postings: dict[int, tuple[np.ndarray, np.ndarray]]  # term: examples inside the block, weights


@dataclass
class Index:
    """Examples in order; labels, ids, and the blocks with their maxima (terms x blocks)."""

    terms: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    weight: np.ndarray
    blocks: list[Block]
    best: np.ndarray
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    none: float = 0.0

    def vector(self, found: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        at = np.array(sorted(found), np.int64)
        v = (1 + np.log(np.array([found[t] for t in at], float))) * self.idf[at]
        return at, v / np.sqrt(v @ v)

    def nearest(self, at: np.ndarray, v: np.ndarray, skip: int = -1, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine above zero, ties to the earlier example, and their cosines."""
        bound = v @ self.best[at]
        ids, sims = np.zeros(0, np.int64), np.zeros(0)
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or (len(sims) == k and bound[b] < sims[-1] - 1e-12):
                break
            block = self.blocks[b]
            score = np.zeros(block.size)
            for t, q in zip(at.tolist(), v.tolist(), strict=True):
                if (p := block.postings.get(t)) is not None:
                    score[p[0]] += q * p[1]
            hit = np.flatnonzero(score > 0)
            hit = hit[hit + block.first != skip]
            ids, sims = np.concatenate([ids, hit + block.first]), np.concatenate([sims, score[hit]])
            order = np.lexsort((ids, -np.round(sims, 12)))[:k]
            ids, sims = ids[order], sims[order]
        return ids, sims

    def vote(self, ids: np.ndarray, sims: np.ndarray) -> float:
        w = self.weight[ids] / (1 - np.minimum(sims, 1) + SMOOTH)
        return float((w * self.toxic[ids]).sum() / w.sum())

    def calibrated(self, vote: float) -> float:
        return float(self.values[max(0, np.searchsorted(self.cuts, vote, side="right") - 1)]) if len(self.cuts) else vote

    def score(self, found: dict[int, int]) -> tuple[float, list[int], list[float]]:
        if not found:
            return self.none, [], []
        ids, sims = self.nearest(*self.vector(found))
        if not len(ids):
            return self.none, [], []
        return self.calibrated(self.vote(ids, sims)), self.ids[ids].tolist(), sims.tolist()


def build(terms: list[str], n_with: list[int], examples: list[tuple[int, int, dict[int, int]]], sizes: dict[int, int]) -> Index:
    """examples: id, label and term counts; sizes: labelled rows of each label before sampling."""
    n = max(1, len(examples))
    idf = np.log((1 + n) / (1 + np.array(n_with, float))) + 0.1 if terms else np.zeros(0)
    bare = [e for e in examples if not e[2]]
    kept = [e for e in examples if e[2]]
    drawn = Counter(e[1] for e in examples)
    share = {y: sizes.get(y, 0) / drawn[y] for y in drawn}
    # Examples with the same heaviest term stand together, so that a block's maxima say much about it.
    kept.sort(key=lambda e: (e[1], max(e[2], key=lambda t: (e[2][t] * idf[t], -t)), e[0]))
    index = Index({t: i for i, t in enumerate(terms)}, idf, np.array([e[0] for e in kept], np.int64), np.array([e[1] for e in kept], float), np.array([share[e[1]] for e in kept], float), [], np.zeros((len(terms), -(-len(kept) // BLOCK))))
    vectors = [index.vector(e[2]) for e in kept]
    for first in range(0, len(kept), BLOCK):
        lists: dict[int, tuple[list[int], list[float]]] = {}
        for i, (at, v) in enumerate(vectors[first : first + BLOCK]):
            for t, x in zip(at.tolist(), v.tolist(), strict=True):
                p = lists.setdefault(t, ([], []))
                p[0].append(i)
                p[1].append(x)
        b = len(index.blocks)
        index.blocks.append(Block(first, len(vectors[first : first + BLOCK]), {t: (np.array(i), np.array(x)) for t, (i, x) in lists.items()}))
        for t, (_, x) in lists.items():
            index.best[t, b] = max(x)
    total = sum(share[e[1]] for e in bare)
    index.none = sum(share[e[1]] for e in bare if e[1] == 1) / total if total else (sizes.get(1, 0) / max(1, sum(sizes.values())))
    votes = []
    for i, (at, v) in enumerate(vectors):
        ids, sims = index.nearest(at, v, skip=i)
        if len(ids):
            votes.append((index.vote(ids, sims), index.toxic[i], index.weight[i]))
    index.cuts, index.values = isotonic(sorted(votes))
    return index


def isotonic(points: list[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """(score, outcome, weight), ascending: where each level starts and its value, never falling."""
    pools: list[list[float]] = []  # start, weighted sum, weight
    for x, y, w in points:
        if pools and pools[-1][0] == x:
            pools[-1][1] += y * w
            pools[-1][2] += w
        else:
            pools.append([x, y * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, s, w2 = pools.pop()
            pools[-1][1] += s
            pools[-1][2] += w2
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


def _words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in BEGINNINGS if len(word) > k)]


class Known(dict):
    """From a word to its terms, or None: filled as words come, emptied when full."""

    def __init__(self, terms: dict[str, int]) -> None:
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> tuple[int, ...] | None:
        if len(self) > MEMO:
            self.clear()
        self[word] = got = tuple(self.terms[f] for f in features(word) if f in self.terms) or None
        return got

    def count(self, text: str | None) -> dict[int, int]:
        return Counter(t for ts in filter(None, map(self.__getitem__, _words(text))) for t in ts)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [shingle_set(t, 4)[:SKETCH].view(np.int64).tolist() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["id", "sketch"])


def without_copies(sketches: list[tuple[int, list[int]]]) -> list[int]:
    """Ids in order, without those whose sketch has COPY hashes (or all it has) in common with one that stays."""
    kept, holders = [], {}
    for i, sketch in sorted(sketches):
        met = Counter(j for h in sketch for j in holders.get(h, ()))
        if sketch and met and max(met.values()) >= min(COPY, len(sketch)):
            continue
        kept.append(i)
        for h in sketch:
            holders.setdefault(h, []).append(i)
    return kept


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a: Counter[str] = Counter()
    n: Counter[str] = Counter()
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = {f for w in set(_words(text)) for f in features(w)}
            n.update(found)
            if toxic:
                a.update(found)
    yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([a[f] for f in n], pa.int64()), pa.array(list(n.values()), pa.int64())], ["word", "a", "n"])


def train(docs: DataFrame, labels: DataFrame) -> Index:
    """The index over a bounded sample of labelled rows. A document with both labels counts as toxic."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("id"))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = sampled(known, "toxic", "id", SAMPLE).select("id", "toxic").collect()
    small = F.broadcast(spark.createDataFrame([(r["id"], r["toxic"]) for r in chosen], "id long, toxic int"))
    texts = docs.select(F.col("doc_id").alias("__d"), F.col("text").alias("text"))
    sample = written(texts.join(small, F.col("__d") == F.col("id")).select("id", "toxic", "text"), "labelled")
    stay = without_copies([(r["id"], r["sketch"]) for r in sample.select("id", "text").mapInArrow(_sketches, "id long, sketch array<long>").collect()])
    sample = sample.join(F.broadcast(spark.createDataFrame([(i,) for i in sorted(set(stay))], "id long")), "id")
    drawn = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = drawn.get(1, 0), drawn.get(0, 0)
    by_word = sample.select("toxic", "text").mapInArrow(_vocabulary, "word string, a long, n long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("n").alias("n"))
    a, b = F.col("a").cast("double"), (F.col("n") - F.col("a")).cast("double")
    c, d = n1 - a, n0 - b
    chi2 = F.lit(float(n1 + n0)) * (a * d - b * c) ** 2 / ((a + b) * (c + d) * F.lit(float(max(1, n1 * n0))))
    top = by_word.where((c + d) > 0).withColumn("x", chi2).where((F.col("n") >= 5) & (F.col("x") >= MIN_CHI2)).orderBy(F.desc("x"), "word").limit(MAX_TERMS).collect()
    terms = sorted(r["word"] for r in top)
    n_with = {r["word"]: r["n"] for r in top}
    at = {t: i for i, t in enumerate(terms)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(at)
        for batch in batches:
            found = [known.count(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))], ["id", "toxic", "t", "n"])

    rows = sample.select("id", "toxic", "text").mapInArrow(vectors, "id long, toxic int, t array<int>, n array<long>").collect()
    examples = sorted(((r["id"], r["toxic"], dict(zip(r["t"], r["n"], strict=True))) for r in rows), key=lambda e: (e[0], e[1], sorted(e[2].items())))
    return build(terms, [n_with[t] for t in terms], examples, sizes)


def score_toxicity(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, and the evidence: the words looked at and the nearest examples with cosines.

    A null or empty text, or one without any term, gets the score of examples without terms. Repeated rows each get
    their row; a null id is kept. Extra columns are not read. Without labelled rows every score is 0.
    """
    box = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, cache = box.value, {}
        known, names = Known(index.terms), list(index.terms)
        for batch in batches:
            out = []
            for text in batch.column(2):
                found = known.count(text.as_py())
                key = tuple(sorted(found.items()))
                if (got := cache.get(key)) is None:
                    got = (*index.score(found), [names[t] for t, _ in key])
                    if len(cache) < CACHE:
                        cache[key] = got
                out.append(got)
            score = pa.array([g[0] for g in out], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), score, pa.array([int(g[0] >= THRESHOLD) for g in out], pa.int32()), pa.array([g[3] for g in out], pa.list_(pa.string())), pa.array([g[1] for g in out], pa.list_(pa.int64())), pa.array([g[2] for g in out], pa.list_(pa.float64()))],
                ["doc_id", "held_out", "score", "predicted", "terms", "neighbours", "cosines"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, terms array<string>, neighbours array<long>, cosines array<double>")


def op5(spark, sf_dir):  # noqa: ANN001, ANN201
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
