import zlib

import numpy as np
import pytest

from folioweave.llm import lang_id
from folioweave.llm.lang_id import DIM, Model, counts, identify, train, with_language

SCHEMA = "doc_id long, text string, lang string, score double, h string"


def brute_counts(text):
    clean, total = " ", np.zeros(lang_id.DIM, np.int64)
    for ch in text:
        low = ch.lower()
        c = (low if len(low) == 1 else ch) if ch.isalpha() else " "
        if c != " " or clean[-1] != " ":
            clean += c
    if clean == " ":
        return None
    clean += "" if clean[-1] == " " else " "
    m = (1 << 32) - 1
    cp = [ord(c) for c in clean]
    for i in range(1, len(cp)):
        one = cp[i] * 0x9E3779B1 & m
        total[one >> 19] += 1
        h2 = ((cp[i - 1] * 0x9E3779B1 & m) ^ (cp[i] * 0x85EBCA77 & m)) * 0xC2B2AE3D & m
        total[h2 >> 19] += 1
        if i > 1:
            h = ((cp[i - 2] * 0x9E3779B1 & m) ^ (cp[i - 1] * 0x85EBCA77 & m)) * 0xC2B2AE3D & m
            total[((h ^ (cp[i] * 0x27D4EB2F & m)) * 0x165667B1 & m) >> 19] += 1
    return total


@pytest.mark.parametrize("text", ["a", "Ab  c9d", "  é!!ß x ", "字ab", "a" * 30, "x 1 " * 9, "İstanbul"])
@pytest.mark.parametrize("chunk", [1, 3, 1 << 20])
def test_counts_in_pieces(monkeypatch, text, chunk):
    monkeypatch.setattr(lang_id, "CHUNK", chunk)
    assert (counts(text) == brute_counts(text)).all()


def test_no_letters():
    assert counts("") is None and counts(" 12 !? ") is None


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = identify(docs, train(docs)).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    # Calibrated: the mean score is about the accuracy.
    assert abs(np.mean([r.score for r in held]) - np.mean([r.lang_pred == truth[r.doc_id] for r in held])) < 0.05


def test_edges(spark):
    rows = [(None, "ab", "xx", 1.0, "h"), (1, None, "xx", 1.0, "h"), (2, "", None, 1.0, "h"), (3, "12", "yy", 1.0, "h"), (4, "ab cd", "xx", 1.0, "h"), (4, "ab cd", "xx", 1.0, "h"), (6, "zz", None, 1.0, "h")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = identify(docs, train(docs)).collect()
    assert len(out) == 7 and sum(r.lang_pred == "und" for r in out) >= 3
    assert all(0 <= r.score <= 1 for r in out)
    assert identify(docs.limit(0), train(docs.limit(0))).count() == 0


def test_with_language_keeps_low_scores(spark):
    model = fit_many()
    docs = spark.createDataFrame([(1, "lo"), (2, "12 34"), (3, None)], "doc_id long, text string")
    lang, score = model.predict("lo")
    assert lang != "und" and score < 0.5
    assert [r.doc_id for r in with_language(docs, model).collect()] == [1]


def fit_many():
    """Many languages that tell nothing of the word."""
    return Model([f"l{i}" for i in range(8)], np.ones(DIM), np.zeros((8, DIM)), np.zeros(8), 1.0)


def test_the_whole_query_by_brute_force(spark, sf):
    from folioweave.llm.lang_id import op6

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = train(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = op6(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        c = brute_counts(texts[r.doc_id] or "")
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if c is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        v = np.where(c > 0, (1 + np.log(np.maximum(c, 1))) * model.idf, 0)
        z = (model.weights @ (v / np.sqrt(v @ v)) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert r.lang_pred == model.langs[int(p.argmax())] and abs(r.score - p.max()) < 1e-9
