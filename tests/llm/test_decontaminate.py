import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from folioweave.llm.decontaminate import Canon, Filter, leaks, packed, without_leaks, word_spans

DOCS = "doc_id long, text string, kind string, coverage int"
ITEMS = "item_id long, text string, doc_id string"


def found(spark, docs, items, **k):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    return sorted(((r.doc_id, r.item_id, r.kind, r.n_changed) for r in leaks(d, b, **k).collect()), key=str)


ITEM = "Yesterday morning John Smith drove 120 km from Boston toward the coast and then John Smith walked 15 km along the quiet beach before eating."


def test_verbatim_reparameterised_and_inconsistent(spark):
    other = ITEM.replace("John Smith", "Maria").replace("120 km", "75 miles").replace("15 km", "8 miles").replace("Boston", "Lyon")
    torn = ITEM.replace("then John Smith", "then Maria")
    docs = [(1, f"Some words here. {ITEM} More words."), (2, f"so it was. {other}"), (3, torn), (4, "Nothing of the kind stands in this text at all, not even 120 km."), (5, ITEM.upper().replace(".", "!!")), (6, f"{ITEM} {ITEM}")]
    got = found(spark, docs, [(7, ITEM)])
    # Another case is no other wording; torn's first half is a copy in plain words.
    assert [(d, i, k) for d, i, k, _ in got] == [(1, 7, "verbatim"), (2, 7, "reparameterised"), (3, 7, "verbatim"), (5, 7, "verbatim"), (6, 7, "verbatim")]


def test_half_of_an_item_and_short_items(spark):
    words = [f"lex{i}" for i in range(30)]
    item = " ".join(words)
    docs = [(1, "so " + " ".join(words[:16]) + " end"), (2, " ".join(words[:9])), (3, "a b c | one | short | item | of | words here")]
    assert [x[:2] for x in found(spark, docs, [(1, item), (2, "short item of words here"), (3, "b c")])] == [(1, 1), (3, 2)]


def test_against_brute_force_on_plain_words(spark):
    rng = random.Random(2)
    items = [(i, " ".join(f"v{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(rng.randrange(8, 30)))) for i in range(20)]
    docs, want = [], []
    for d in range(120):
        text = " ".join(f"z{chr(97 + rng.randrange(26))}" for _ in range(rng.randrange(80)))
        if d % 3 == 0:
            i, t = rng.choice(items)
            w = t.split()
            n = rng.randrange(1, len(w) + 1)
            at = rng.randrange(len(w) - n + 1)
            text += " " + " ".join(w[at : at + n]) + " tail"
            if n >= 8 and n >= 0.5 * len(w):
                want.append((d, i))
        docs.append((d, text))
    assert [x[:2] for x in found(spark, docs, items)] == sorted(want, key=str)


def test_edges(spark):
    docs = [(None, ITEM), (1, None), (2, ""), (3, "! ? ."), (4, ITEM), (4, ITEM), (5, "w " * 50_000 + ITEM)]
    assert [x[:2] for x in found(spark, docs, [(7, ITEM), (7, ITEM), (8, None), (None, ITEM), (9, "")])] == [(4, 7), (4, 7), (5, 7), (None, 7)]
    assert found(spark, [], [(7, ITEM)]) == [] and found(spark, docs, []) == []


SUM = "What is 25 + 37 + 48 + 59 ?"
DENSE = "A train leaves the old station every morning before dawn. It goes 12 km in 5 minutes, 18 km in 7 minutes, 21 km in 9 minutes, 33 km in 11 minutes, 40 km in 13 minutes and 52 km in 17 minutes."


def test_items_of_mostly_placeholders(spark):
    other = DENSE.replace("12 km", "14 km").replace("52 km", "55 km").replace("21 km", "29 km")
    docs = [(1, f"so it was. {SUM} Then more."), (2, "so it was. What is 26 + 38 + 49 + 60 ? Then more."), (3, f"Text before. {DENSE} Text after."), (4, f"Text before. {other} Text after."), (5, "1 2 3 4 5 6 7 8 9 " * 500), (6, f"{SUM} {SUM}"), (7, DENSE[60:]), (8, "nothing")]
    assert found(spark, docs, [(1, SUM), (2, DENSE)]) == [(1, 1, "verbatim", 0), (3, 2, "verbatim", 0), (4, 2, "reparameterised", 3), (6, 1, "verbatim", 0), (7, 2, "verbatim", 0)]


def test_names_that_open_sentences_and_sums(spark):
    apples = "Alice has 3 apples and buys 4 pears."
    total = "What is 12 + 34 * 5 - 6 / 7 ?"
    docs = [(1, "Bob has 5 apples and buys 9 pears."), (2, f"It is so. {total} Yes."), (3, "What is 13 + 34 * 5 - 6 / 7 ?"), (4, "Bob likes 5 dogs and sells 9 cats."), (5, apples.upper())]
    assert [x[:3] for x in found(spark, docs, [(1, apples), (2, total)])] == [(1, 1, "reparameterised"), (2, 2, "verbatim"), (5, 1, "verbatim")]


def test_documents_without_leaks(spark):
    docs = spark.createDataFrame([(1, ITEM, "a"), (1, ITEM, "b"), (2, "clean text of its own", "c"), (None, None, "d"), (3, "", "e"), (3, f"so {ITEM}", "f")], "doc_id long, text string, t1 string")
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    kept = without_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r.t1 for r in kept.collect()) == ["c", "d", "e"]
    assert without_leaks(docs, items.limit(0)).count() == 6


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aé \t\n\x1c\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000.字🙂", "word", "x" * 40]), max_size=20).map("".join), max_size=5))
def test_words_are_cut_as_by_split(texts):
    for t in texts:
        raw = t.encode()
        assert [raw[a : a + n].decode() for a, n in zip(*map(np.ndarray.tolist, word_spans(np.frombuffer(raw, np.uint8))), strict=True)] == t.split()
    canon = Canon()
    for _ in range(2):
        codes, doc = canon([t.encode() for t in texts])
        assert codes.tolist() == [packed(w) for t in texts for w in t.split()]
        assert doc.tolist() == [i for i, t in enumerate(texts) for _ in t.split()]


def test_the_filter_misses_nothing():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    bits = 1 << 20
    at = np.unique(np.concatenate([Filter.places(h, bits, p) for p in range(4)]))
    slices = {}
    for k in range(bits // Filter.SLICE):
        own = np.zeros(Filter.SLICE, bool)
        own[at[at // Filter.SLICE == k] % Filter.SLICE] = True
        slices[k] = np.packbits(own, bitorder="little").tobytes()
    keep = Filter(bits, slices)
    assert len(keep.has(h)) == 5000
    assert len(keep.has(rng.integers(0, 1 << 63, 100_000).astype(np.uint64))) < 300
