import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioweave.llm.common import fresh_path
from folioweave.llm.encoder import Encoder
from folioweave.llm.token_files import canonical_codes, decode_table, from_payload, limited_lengths, pack, read_token_files, to_payload, unpack, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def enc():
    return Encoder(PATH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=300), st.integers(10, 18))
def test_lengths_are_a_prefix_code_and_optimal_without_limit(counts, limit):
    counts = np.array(counts)
    lengths = limited_lengths(counts, limit)
    used = counts > 0
    assert ((lengths > 0) == used).all() and lengths.max(initial=0) <= limit
    if used.sum() > 1:
        assert sum(2.0 ** -int(x) for x in lengths[used]) == 1.0
        import heapq

        heap = [int(c) for c in counts[used]]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            cost += a
            heapq.heappush(heap, a)
        if limit == 18:
            assert int((counts * lengths).sum()) == cost


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 90), max_size=2000))
def test_round_trip(ids):
    ids = np.array(ids, np.int64)
    lengths = limited_lengths(np.bincount(ids, minlength=1))
    codes = canonical_codes(lengths)
    words, marks, _ = pack(ids, lengths, codes)
    assert (unpack(words, marks, len(ids), decode_table(lengths)) == ids).all()
    docs, sizes, back = from_payload(to_payload([None, 5], np.array([0, len(ids)]), ids, lengths, codes), decode_table(lengths))
    assert docs == [None, 5] and list(sizes) == [0, len(ids)] and (back == ids).all()


ALPHABET = [*" \n\t\r\u00a0\u2003\u2028\x00\x1c\x85aébC1²'.,<|>字×÷ɏɐªº\u00ad—’…\u205f🙂\u0301", "<|endoftext|>", "  ", "'s", "'ll", "'re", "x" * 30, "dés"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join), max_size=6))
def test_pieces_give_what_whole_texts_give(enc, texts):
    for _ in range(2):  # from the library, then from memory
        sizes, ids = enc([*texts, None], 2)
        want = [[*x, 2] for x in enc.plain([*texts, ""])]
        assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_memory_starts_anew(enc, monkeypatch):
    monkeypatch.setattr("folioweave.llm.encoder.MOST", 20)
    small = Encoder(PATH)
    for k in range(30):
        text = " ".join(f"w{i}x yzz{i}" for i in range(k, k + 12))
        assert small([text, text])[1].tolist() == enc.plain([text])[0] * 2
    assert small.memory.kept <= 60


def test_files(spark, sf):
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(None, "a  b"), (10**6, None), (10**6 + 1, ""), (10**6 + 2, "x\n \n y <|endoftext|>"), (10**6 + 2, "x\n \n y <|endoftext|>"), (10**6 + 3, "word " * 70_000)]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, part int, ids string").repartition(5)
    path = fresh_path(spark, "t")
    write_token_files(docs, path)
    got = read_token_files(spark, path).orderBy("start").collect()
    want, start = [], 0
    for d, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert [tuple(r) for r in got] == want


def test_empty_table_and_single_id(spark):
    for rows in ([], [(1, "")]):
        path = fresh_path(spark, "t")
        write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), path)
        assert read_token_files(spark, path, with_ids=True).count() == len(rows)


def test_more_ids_than_codes_of_the_usual_length():
    counts = np.arange(1, (1 << 18) + 50)
    with pytest.raises(ValueError):
        limited_lengths(counts, 18)
    lengths = limited_lengths(counts, 19)
    ids = np.random.default_rng(1).integers(0, len(counts), 5000)
    words, marks, _ = pack(ids, lengths, canonical_codes(lengths))
    assert lengths.max() <= 19 and (unpack(words, marks, len(ids), decode_table(lengths)) == ids).all()
