"""Language identification: multinomial logistic regression on TF-IDF weights of character n-grams.

Features: the text in lower case, runs of other characters than letters as one blank, its 1-, 2- and 3-grams hashed
into DIM buckets. A document's vector is (1 + ln count) * idf, of length one. Training is follow-the-regularised-leader
(per-coordinate) with L1 and L2 penalties, so most weights are exactly zero; a temperature fitted on part of the
sample scales the scores into probabilities.

It is fitted on at most SAMPLE_PER_LANG rows of each of at most MAX_LANGS languages, chosen by a hash of the id; the
idf comes from that sample as part of the model. Predictions cover every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm.common import held_out, sampled, table

DIM = 1 << 13
SAMPLE_PER_LANG = 400
MAX_LANGS = 256
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.002
CHUNK = 1 << 20
UND = "und"


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    """By code point: the letter in lower case, or a blank for anything that is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for cp in range(0x110000):
        if (ch := chr(cp)).isalpha():
            low = ch.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def counts(text: str) -> np.ndarray | None:
    """How often each bucket occurs; None if the text has no letter."""
    total, tail, letters = np.zeros(DIM, np.int64), np.array([32], np.uint32), False
    pieces = [text[at : at + CHUNK] for at in range(0, len(text), CHUNK)]  # a long text in pieces, each after the last two characters before it
    for k, piece in enumerate(pieces):
        x = _lower()[np.frombuffer(piece.encode("utf-32-le"), np.uint32)]
        blank = x == 32
        letters = letters or not blank.all()
        after_blank = np.empty_like(blank)
        after_blank[0], after_blank[1:] = tail[-1] == 32, blank[:-1]
        y = x[~(blank & after_blank)]
        if k == len(pieces) - 1 and (y[-1] if len(y) else tail[-1]) != 32:
            y = np.append(y, np.uint32(32))
        z = np.concatenate([tail, y])
        old = len(tail)
        one = z * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (z[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
        three = (two[:-1] ^ (z[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        for grams, n in ((one, 1), (two, 2), (three, 3)):
            total += np.bincount(grams[max(0, old - n + 1) :] >> np.uint32(32 - 13), minlength=DIM)
        tail = z[-2:]
    return total if letters else None


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # langs x DIM
    bias: np.ndarray
    temperature: float

    def logits(self, c: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(c)
        v = (1 + np.log(c[at])) * self.idf[at]
        norm = np.sqrt(v @ v)
        return self.weights[:, at] @ (v / norm if norm else v) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        c = counts(text) if text else None
        if c is None or not self.langs:
            return UND, 0.0
        z = self.logits(c) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def fit(sample: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """sample: language, and the grams and counts of each row, in a fixed order. Every fifth row only fits the temperature."""
    langs = sorted({lang for lang, _, _ in sample})
    seen = np.zeros(DIM, np.int64)
    for _, at, _ in sample:
        seen[at] += 1
    idf = np.log((1 + len(sample)) / (1 + seen)) + 0.1
    rows = []
    for lang, at, n in sample:
        v = (1 + np.log(n)) * idf[at]
        rows.append((langs.index(lang), at, v / np.sqrt(v @ v)))
    k = len(langs)
    z, n = np.zeros((k, DIM + 1)), np.zeros((k, DIM + 1))

    def weights(at: np.ndarray) -> np.ndarray:
        zi, ni = z[:, at], n[:, at]
        penalty = np.where(at == DIM, 0.0, L1)
        return np.where(np.abs(zi) <= penalty, 0.0, -(zi - np.sign(zi) * penalty) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    train = [r for i, r in enumerate(rows) if i % 5 or len(rows) < 50]
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(train)):
            y, at, v = train[i]
            at, v = np.append(at, DIM), np.append(v, 1.0)
            w = weights(at)
            s = w @ v
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = p[:, None] * v
            z[:, at] += g - (np.sqrt(n[:, at] + g * g) - np.sqrt(n[:, at])) * ALPHA**-1 * w
            n[:, at] += g * g
    full = weights(np.arange(DIM + 1)) if k else np.zeros((0, DIM + 1))
    model = Model(langs, idf, full[:, :DIM], full[:, DIM], 1.0)
    held = [(y, model.weights[:, at] @ v + model.bias) for i, (y, at, v) in enumerate(rows) if i % 5 == 0]
    if held and k > 1:
        s, y = np.array([x for _, x in held]), np.array([x for x, _ in held])

        def loss(t: float) -> float:
            a = s / t
            a = a - a.max(axis=1, keepdims=True)
            return float((np.log(np.exp(a).sum(axis=1)) - a[np.arange(len(y)), y]).mean())

        model.temperature = float(min(np.geomspace(0.05, 5, 80), key=loss))
    return model


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            c = counts(batch.column(2)[row].as_py() or "")
            if c is not None:
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), batch.column(1).slice(row, 1), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([c[at].astype(np.int64).tobytes()], pa.binary())], ["h", "lang", "at", "n"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on a bounded sample of rows that have a language and are not held out."""
    # Chosen by ids alone; only the chosen rows' texts are then read into counts.
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out("id"))
    chosen = sampled(rows, "lang", "id", SAMPLE_PER_LANG).orderBy("r", "lang").limit(SAMPLE_PER_LANG * MAX_LANGS)
    ids = {r["id"] for r in chosen.select("id").collect()}
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in sorted(ids)], "__id long"))
    texts = docs.select(F.xxhash64(id_col, text_col).alias("h"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")).where(F.col("lang").isNotNull())
    found = texts.join(wanted, F.col("id") == F.col("__id"), "left_semi").select("h", "lang", "text").mapInArrow(_counted, "h long, lang string, at binary, n binary").collect()
    # Numbers stay packed: as lists of Python they would take many times as much of the driver.
    return fit([(r["lang"], np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["n"], np.int64)) for r in sorted(found, key=lambda r: (r["h"], r["lang"]))])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    A null text or one without a letter is `und` with score 0, as is everything if no language was learned. Repeated
    rows each get their row; a null id is kept. Extra columns are not read.
    """
    box = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [box.value.predict(batch.column(2)[i].as_py()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def with_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs, all columns, without rows whose language is undetermined; a low score alone drops none."""
    box = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [box.value.predict(x.as_py()) for x in batch.column(at)]
            yield batch.filter(pa.array([lang != UND for lang, _ in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6(spark, sf_dir):  # noqa: ANN001, ANN201
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
