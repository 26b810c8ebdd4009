import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from folioweave.llm.repeats import known_shared, repeated_spans
from folioweave.llm.suffix_array import common_prefixes, is_smaller_than_next, suffix_array

SCHEMA = "doc_id long, text string, tid string, q int, runs string"


def brute(rows, width):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, out = set(), []
    for i in order:
        raw = (rows[i][1] or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - width + 1):
            w = raw[s : s + width]
            if w in seen:
                gone[s : s + width] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone[:-1], strict=True) if not g)
        spans = int((gone[:-1] & ~np.r_[False, gone[:-2]][: len(raw)]).sum()) if raw else 0
        out.append((rows[i][0], len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows, **k):
    df = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_spans(df, **k).collect()), key=str)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from(b"\x01\x02\x03\xf4"), min_size=0, max_size=120), st.integers(1, 4))
def test_suffix_array(data, times):
    raw = bytes(data * times) + b"\0"
    text = np.frombuffer(raw, np.uint8)
    small = is_smaller_than_next(text)
    assert all(small[i] == (raw[i:] < raw[i + 1 :]) for i in range(len(raw) - 1))
    got = suffix_array(text, len(raw) + 8)
    assert got.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    lcp = common_prefixes(text, got, 12)
    for k in range(1, len(got)):
        a, b = raw[got[k - 1] :], raw[got[k] :]
        n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        assert lcp[k] == min(n, 12)


def test_random_texts_with_repeats(spark):
    rng = random.Random(3)
    passages = ["".join(rng.choice("abcdeé \n") for _ in range(rng.randrange(20, 160))) for _ in range(12)]
    rows = []
    for i in range(80):
        parts = [rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(60))) for _ in range(rng.randrange(6))]
        rows.append((i if i % 9 else None if i == 0 else i, "".join(parts)))
    rows += [(100 + i, t) for i, (_, t) in enumerate(rows[:10])]
    rng.shuffle(rows)
    assert result(spark, rows, width=40, gram=8) == brute(rows, 40)
    assert result(spark, rows) == brute(rows, 100)


def test_edges(spark):
    periodic = "Esthing. " * 60
    rows = [(1, None), (2, ""), (3, periodic), (4, periodic), (4, periodic), (5, "x" * 99), (6, "x" * 99), (7, "x" * 100), (8, "x" * 350), (9, "ab\0cd" * 50), (10, "é" * 50), (11, "é" * 51), (12, "a" + periodic[:150] + "b")]
    assert result(spark, rows) == brute(rows, 100)
    assert result(spark, []) == []


def test_against_brute_force_on_the_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(spark, rows) == brute(rows, 100)


def test_texts_with_one_number_and_a_common_line(spark):
    rng = random.Random(9)
    line = "the same line stands in nearly all of these texts and is long enough to be found"
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(50))) + line + "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(50)))) for i in range(60)]
    rows += [(60 + i, f"{i} other text " * 9) for i in range(10)] + [(70, rows[3][1]), (71, rows[3][1])]
    assert result(spark, rows, width=40, gram=8, bits=4) == brute(rows, 40)


def test_rows_known_to_be_shared():
    q = np.array([5, 7, 5, 5, 9, 7, 5])
    shared, often = known_shared(q, np.array([9]))
    assert shared.tolist() == [False, False, False, True, True, False, True] and often.tolist() == [5, 9]
