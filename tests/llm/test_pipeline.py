import struct
import zlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from folioweave.llm.common import written
from folioweave.llm.decontaminate import leaks
from folioweave.llm.jaccard_join import one_of_each
from folioweave.llm.lang_id import train
from folioweave.llm.mixing import mix

from .test_jaccard_join import brute as components


def test_run_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    model = train(docs)
    rows = sorted((r.doc_id, r.text, r.source) for r in docs.collect())
    rows = [r for r in rows if model.predict(r[1])[0] != "und"]
    assert len(rows) > 190
    comp = {d: c for d, _, c in components([r[:2] for r in rows], 5, 80)}
    rows = [r for r in rows if comp[r[0]] == r[0]]
    held = {r.doc_id for r in leaks(docs, bench).collect()}
    assert held
    rows = [r for r in rows if r[0] not in held]
    at = {r.doc_id: r.position for r in mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    rows.sort(key=lambda r: at[r[0]])
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    want, start = [], 0
    for d, t, _ in rows:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    got = corpus_pipeline.run(spark, sf).orderBy("start").collect()
    assert [tuple(r) for r in got] == want


def test_stages_keep_columns_and_take_edge_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, label string, block int"
    text = "the quick brown fox jumps over the lazy dog and then it runs away from the old barn"
    rows = [(None, text, "en", None, 1, "x", 1), (None, None, None, "a", None, "x", 1), (1, text, "en", "a", 1, "x", 1), (1, text, "en", "a", 1, "x", 1), (2, "", "en", "a", 1, "x", 1), (3, text + " gate", "en", "b", 1, "x", 1), (4, "12 34", None, "b", 1, "x", 1), (5, "other words of a text that nobody wrote before this very day", "en", "b", 1, "x", 1)]
    for data in (rows, []):
        docs = written(spark.createDataFrame(data, schema), "docs")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.schema.fieldNames() == docs.schema.fieldNames(), name
            docs = written(out, name)
        last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        assert last.count() == docs.count() == (2 if data else 0)


def test_one_of_each_row(spark):
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(None, text), (None, text), (7, text), (7, text), (3, text + " more"), (None, "only here and nowhere else at all"), (9, ""), (9, ""), (8, None), (3, "a wholly different text of a repeated id")]
    out = one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, out)) == sorted(str(r) for r in spark.createDataFrame([rows[4], rows[5], rows[6], rows[7], rows[8], rows[9]], "doc_id long, text string").collect())
    none = spark.createDataFrame([(None, text), (None, text)], "doc_id long, text string")
    assert one_of_each(none).count() == 1
