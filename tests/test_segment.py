import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioweave.functions.spans import spans
from folioweave.operators import segment as sg

PAGES = "doc_id string, page_number int, text string, page_kind string"


def sections(spark, rows):
    out = sg.sections(spark.createDataFrame(rows, PAGES)).orderBy("doc_id", "section_no").collect()
    return [(r.doc_id, r.section_no, r.section_label, r.detected, r.text, [tuple(o) for o in r.page_offsets]) for r in out]


def test_one_page_with_headings_is_cut_at_them(spark):
    text = "before\nSYNOPSIS\nshort\nVII. GROUNDS\nfirst ground\nXII. FINAL PRAYER\nplease"
    got = sections(spark, [("a", 1, text, "digital")])
    assert [(g[2], g[4]) for g in got] == [("SYNOPSIS", "SYNOPSIS\nshort\n"), ("VII. GROUNDS", "VII. GROUNDS\nfirst ground\n"), ("XII. FINAL PRAYER", "XII. FINAL PRAYER\nplease")]
    assert all(g[3] for g in got) and "PRAYER" not in got[1][4]


def test_pages_gather_under_a_heading_and_offsets_tell_pages(spark):
    rows = [("a", 1, "opening page", "digital"), ("a", 2, "INDEX\nbody", "digital"), ("a", 3, "PRAYER\nmore", "digital"), ("a", 4, "GROUNDS\nlast", "digital"), ("a", 5, "tail", "digital")]
    got = sections(spark, rows)
    assert [g[2] for g in got] == ["Document", "INDEX", "PRAYER", "GROUNDS"]
    assert got[-1][4] == "GROUNDS\nlast\ntail" and got[-1][5] == [(0, 12, 4), (13, 17, 5)]
    one = spark.createDataFrame([(got[-1][5],)], "o array<struct<start:int,end:int,page:int>>")
    assert [one.select(sg.page_at(F.lit(x), F.col("o"))).first()[0] for x in (0, 11, 12, 13, 99)] == [4, 4, 5, 5, 5]


def test_fallback_pages_and_thresholds(spark):
    got = sections(spark, [("b", 1, "INDEX\nx", "scanned"), ("b", 2, "", "scanned"), ("c", 1, None, "digital")])
    assert [(g[0], g[2], g[3]) for g in got] == [("b", "p.1", False), ("b", "p.2", False), ("c", "p.1", False)]
    toc = "\n".join(f"Chapter {i} ..... {i}" for i in range(3))
    s = sg.structure(spark.createDataFrame([("t", 1, toc, "digital"), ("t", 2, "INDEX", "digital")], PAGES)).first()
    assert (s.n_toc_pages, s.n_headings, s.structure_score, s.mode) == (1, 1, 3, "structured")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1. First one.\nmore\n2. Second.\n\n3. Third", ["1. First one.\nmore\n", "2. Second.\n\n", "3. Third"]),
        ("block one\nstill\n\n \nblock two\n", ["block one\nstill", "block two"]),
        ("\n\nonly one\n", ["only one"]),
        ("title\n1. First\n2. Second", ["title\n", "1. First\n", "2. Second"]),
        ("", []),
    ],
)
def test_paragraphs(spark, text, want):
    rows = sg.paragraphs(spark.createDataFrame([("d", text)], "doc_id string, text string"), ["doc_id"]).orderBy("para_no").collect()
    assert [r.paragraph for r in rows] == want
    assert all(text[r.char_start : r.char_end] == r.paragraph for r in rows)


@pytest.mark.parametrize(
    ("text", "n"),
    [
        ("The respondent No 2 started to pay Rs. 5,000 per month from March 2019.", 1),
        ("The Judgment of Y.V. Chandrachud, J. was delivered on that date.", 1),
        ("He relied on Rs.\n5,000 as proof of the transaction that followed.", 1),
        ("This is the first whole sentence. And this is the second one here! Is this the third of them?", 3),
    ],
)
def test_sentences(text, n):
    assert len(sg.sentence_spans(text)) == n


def test_short_pieces_join(spark):
    text = "2. The appellant, resident of Agra, U.P. filed the petition before the Sessions Judge on 14. March seeking bail."
    assert all(b - a >= 20 for a, b in sg.sentence_spans(text))
    rows = sg.sentences(spark.createDataFrame([("d", 0, text), ("e", 0, None)], "doc_id string, para_no int, paragraph string"), ["doc_id", "para_no"]).collect()
    assert all(text[r.start : r.end] == r.sentence for r in rows)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB. !?\n1Rs", max_size=120))
def test_sentences_are_slices_in_order(text):
    last = 0
    for a, b in sg.sentence_spans(text):
        assert last <= a < b <= len(text) and text[a:b].strip() == text[a:b]
        last = b


def test_spans_are_verbatim(spark):
    import re

    texts = ["₹5 and é 12, 345", "", None, "12", "a\u00011\u00022"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", spans(F.col("t"), r"\d+").alias("s")).collect()
    for r in rows:
        assert [(m.raw, m.start, m.end) for m in r.s] == [(m[0], *m.span()) for m in re.finditer(r"\d+", r.t or "")]


def test_chunks_and_lines(spark):
    df = spark.createDataFrame([("d", "abcdefg"), ("e", "")], "doc_id string, text string")
    assert [(r.start, r.chunk) for r in sg.chunks(df, ["doc_id"], 3).where("doc_id = 'd'").orderBy("start").collect()] == [(0, "abc"), (3, "def"), (6, "g")]
    assert sg.lines(df, ["doc_id"]).count() == 2


def test_spans_of_a_text_with_many_matches(spark):
    text = "a1 b22 ccc\n" * 50_000
    row = spark.createDataFrame([(text,)], "text string").select(spans(F.col("text"), "[0-9]+").alias("s")).selectExpr("size(s) AS n", "s[99999] AS last", "s[0] AS first").first()
    assert row.n == 100_000 and (row.first.raw, row.first.start, row.first.end) == ("1", 1, 2)
    assert (row.last.raw, row.last.start, row.last.end) == ("22", 11 * 49_999 + 4, 11 * 49_999 + 6)


def test_letters_of_lines_are_not_sorted(spark):
    """Paragraphs order lines by what is asked of them; the letters of a line go nowhere."""
    plan = sg.paragraphs(spark.createDataFrame([("d", "a\n\nb")], "doc_id string, text string"), ["doc_id"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x or "Project [" in x]
    assert windows and not any(re.search(r"\bline#\d+[,\]]", x) for x in windows)


def test_only_the_end_of_a_piece_is_searched_for_abbreviations():
    """As the whole piece was, which took time by its length: here most of a second before."""
    rng = random.Random(4)
    parts = ["rs", "No", "nos", "s", "Dr", "a", "word", ".", " ", ",", "1", "é", "_", "ſ", "K", "-"]
    for _ in range(20000):
        piece = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 7))).strip() + rng.choice([".", "", ".."])
        assert sg._abbreviated(piece) == bool(sg._ABBREVIATED.search(piece)), piece
    seen = []

    class Watched:
        def search(self, text, at=0):
            seen.append(len(text) - at)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(sg, "_ABBREVIATED", Watched())
        sg.sentence_spans("One sentence that is long enough to stand. " * 50)
    assert len(seen) == 49 and max(seen) < 10
