import random
import textwrap

from folioweave.llm.licenses import OPENINGS, candidate_blocks, scan_licenses, templates

SCHEMA = "doc_id long, text string, license string, rank string"


def found(spark, docs):
    return sorted(((r.doc_id, r.license, r.kind, r.char_start, r.char_end) for r in scan_licenses(spark.createDataFrame([(d, t, "x", "y") for d, t in docs], SCHEMA)).collect()), key=str)


def test_each_notice_is_found_exactly(spark):
    docs, want = [], set()
    for spdx, notices in templates().items():
        for n in notices:
            docs.append((len(docs), f"Éone two\n{n}.\nthree"))
            want.add((docs[-1][0], spdx))
    got = found(spark, docs)
    assert {(d, s) for d, s, kind, *_ in got if kind == "exact"} == want
    text = dict(docs)
    assert all("three" not in text[d][a:b] for d, _, _, a, b in got)


def test_changed_wording_is_reported(spark):
    changed = OPENINGS["MIT"].replace("free of charge", "gratis").replace("obtaining", "getting")
    rows = scan_licenses(spark.createDataFrame([(1, changed), (2, "The license of this text is unclear and nobody knows of any warranty."), (3, "no such words")], "doc_id long, text string")).collect()
    (row,) = rows
    assert (row.doc_id, row.license, row.kind) == (1, "MIT", "modified")
    assert set(row.missing) == {"free", "of", "charge", "obtaining"} and set(row.between) == {"gratis", "getting"}
    assert 0.8 <= row.similarity < 1 and 0 < row.saved < 1 and row["rank"] >= 1


def test_blocks_and_edges(spark):
    assert candidate_blocks("a\nMIT License\nb\nc\nLicense\nd") == [(2, 25)]
    long = "x " * 5000 + "Released under the MIT License." + " y" * 5000
    rows = [(None, "Released under the MIT License."), (1, None), (2, ""), (3, "Released under the MIT License."), (3, "Released under the MIT License."), (4, long)]
    assert [x[:3] for x in found(spark, rows)] == [(3, "MIT", "exact"), (3, "MIT", "exact"), (4, "MIT", "exact"), (None, "MIT", "exact")]
    assert found(spark, []) == []


def prose(rng, n):
    """Words of random letters, n characters or a little more: nothing that compresses away."""
    out = ""
    while len(out) < n:
        out += "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 10))) + " "
    return out


def test_short_notices_in_long_paragraphs(spark):
    rng = random.Random(4)
    notices = {"MIT": ["Released under the MIT License.", OPENINGS["MIT"]], "Apache-2.0": ["Licensed under the Apache License, Version 2.0."]}
    docs, want = [], []
    for spdx, texts in notices.items():
        for n in texts:
            for size in (200, 400, 600, 2000, 2900, 8000):
                docs.append((len(docs), prose(rng, size / 2) + n + " " + prose(rng, size / 2)))
                want.append((docs[-1][0], spdx, "exact"))
    assert [x[:3] for x in found(spark, docs)] == sorted(want, key=str)


def test_wrapped_notices_keep_head_and_tail(spark):
    docs, want = [], []
    for spdx, text in OPENINGS.items():
        for width in (24, 60, 72, 80):
            for sign in ("", "# ", " * "):
                lines = textwrap.wrap(text, width, break_on_hyphens=False, break_long_words=False)
                docs.append((len(docs), "one two three\n\n" + "\n".join(sign + x for x in lines) + "\n\nfour five six"))
                want.append((docs[-1][0], spdx, "exact"))
    got = found(spark, docs)
    assert [x[:3] for x in got if x[2] == "exact"] == sorted(want, key=str)
    text = dict(docs)
    assert all("three" not in text[d][a:b] and "four" not in text[d][a:b] for d, *_, a, b in got)


def test_changed_notice_in_a_long_line(spark):
    rng = random.Random(5)
    changed = OPENINGS["GPL-3.0"].replace("This program", "Thing").replace("any later version", "a later one")
    (row,) = found(spark, [(1, "the license of this program: " + prose(rng, 1000) + changed + " " + prose(rng, 1000) + "this software, as said, is free")])
    assert row[:3] == (1, "GPL-3.0", "modified")


def test_a_block_gives_all_its_licenses(spark):
    bsd = OPENINGS["BSD-2-Clause"].replace("permitted provided that", "allowed if")
    gpl = OPENINGS["GPL-3.0"].replace("any later version", "a later one")
    apache = OPENINGS["Apache-2.0"].replace("except in compliance with", "but under")
    docs = [(1, f"Licensed under the MIT License.\n{apache}"), (2, f"{bsd}\n{gpl}"), (3, f"Released under the MIT License.\nReleased under the ISC License.\n{bsd}"), (4, "Licensed under the GNU Lesser General Public License, version 2.1"), (5, "Released under the MIT License. See the license of the rest."), (6, "Licensed under the MIT License or the ISC License")]
    want = [(1, "Apache-2.0", "modified"), (1, "MIT", "exact"), (2, "BSD-2-Clause", "modified"), (2, "GPL-3.0", "modified"), (3, "BSD-2-Clause", "modified"), (3, "ISC", "exact"), (3, "MIT", "exact"), (4, "LGPL-2.1", "exact"), (5, "MIT", "exact"), (6, "ISC", "modified"), (6, "MIT", "exact")]
    assert [x[:3] for x in found(spark, docs)] == want


def test_every_notice_in_texts_of_all_lengths():
    from folioweave.llm.licenses import Scanner, templates

    rng, scanner = random.Random(6), Scanner(templates())
    filler = prose(rng, 60_000).split()
    for spdx, notices in templates().items():
        for n in notices:
            for size in (0, 20, 300, 5000):
                for end in " \n" if size < 300 else rng.choice(" \n"):
                    a, b = (" ".join(rng.choices(filler, k=size)) for _ in range(2))
                    text = f"{a}{end}{n}{end}{b}"
                    got = {(x[3], x[6]) for x in scanner.scan(text)}
                    assert (spdx, "exact") in got, (spdx, n, size)


def test_ten_licenses_side_by_side():
    from folioweave.llm.licenses import OPENINGS, Scanner, templates

    rng, scanner = random.Random(7), Scanner(templates())
    for _ in range(20):
        picked = rng.sample(sorted(OPENINGS), 6) + rng.sample([k for k in templates() if k not in OPENINGS], 4)
        notices = [rng.choice(templates()[k]) for k in picked]
        for between in ("\n", " and then ", "\n\n\n\n" + " ".join(prose(rng, 300).split()) + "\n\n"):
            assert set(picked) <= {x[3] for x in scanner.scan(between.join(notices)) if x[6] == "exact"}
