import itertools
import random
import re

import numpy as np
import pytest

from folioweave.llm.components import components
from folioweave.llm.hashing import word_hashes
from folioweave.llm.jaccard_join import _voronoi, jaccard_components, region_keys

SCHEMA = "doc_id long, text string, set_id string, keys int, label string"


def shingle_sets(rows, words):
    out = []
    for _, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
        out.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    return out


def brute(rows, words=4, percent=85):
    sets = shingle_sets(rows, words)
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            comp[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best.setdefault(root(i), []).append(d)
    smallest = {r: min((d for d in ds if d is not None), default=None) for r, ds in best.items()}
    return sorted(((d, len(s), smallest[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def result(spark, rows, **k):
    df = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, **k).collect()), key=str)


def chain(rng, n, steps):
    words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    out = []
    for _ in range(steps):
        words = list(words)
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_pairs_that_link_share_a_region():
    rng = np.random.default_rng(1)
    for percent in (80, 85, 95):
        for n in [*range(1, 60), 150, 400]:
            for _ in range(12):
                a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
                gone = rng.integers(0, n // 5 + 1)
                more = rng.integers(0, n // 5 + 2)
                b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 1 << 63, more).astype(np.uint64)]))
                inter, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
                if 100 * inter >= percent * union and inter < union:
                    assert np.intersect1d(region_keys(a, percent), region_keys(b, percent)).size, (n, percent, len(a), len(b))


@pytest.mark.parametrize("block", [512, 4])
def test_chains_and_shared_passages(spark, block):
    rng = random.Random(5)
    rows = []
    for n in (6, 9, 20, 60, 200):
        for t in chain(rng, n, 14):
            rows.append((rng.randrange(10**6), t))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(rng.randrange(10**6), f"{passage} {' '.join(f'q{rng.randrange(10**6)}' for _ in range(rng.randrange(0, 12)))}") for _ in range(25)]
    rng.shuffle(rows)
    assert result(spark, rows, block=block) == brute(rows)
    if block == 4:
        assert result(spark, rows, words=5, percent=80) == brute(rows, 5, 80)


def test_edges(spark):
    rows = [(5, None), (6, ""), (7, " \t\n"), (None, "a b c"), (8, "A b\x0bC"), (2, "a b c"), (2, "a b c"), (9, "a b c"), (3, "É x"), (4, "é x"), (1, "word " * 3000), (0, "word " * 2500), (None, "solo text of its own")]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []


@pytest.mark.parametrize("few", [0, 1000])
def test_components(spark, few):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), few).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long"), few).count() == 0


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def test_words_that_agree_modulo_powers_of_two_differ(spark):
    for n in (32, 64, 65, 1024, 2048, 4096):
        a = thue_morse(n)
        b = a.translate(str.maketrans("ab", "ba"))
        assert word_hashes(a.encode())[0] != word_hashes(b.encode())[0]
    rows = [(1, thue_morse(2048)), (2, thue_morse(2048).translate(str.maketrans("ab", "ba"))), (3, "a " + "x" * 5000), (4, "a " + "x" * 4999), (5, "a " + "x" * 5000)]
    assert result(spark, rows) == brute(rows)


def test_sets_with_one_number_stay_apart(spark):
    rng = random.Random(8)
    rows = [(i, t) for i, t in enumerate(chain(rng, 30, 12) + [f"own{i} text{i} of{i} its{i}" for i in range(30)] + ["same words of two", "same words of two"])]
    assert result(spark, rows, bits=3) == brute(rows)


def test_cells_hold_all_links(spark):
    rng = np.random.default_rng(4)
    rows, base = [], [np.unique(rng.integers(-(1 << 62), 1 << 62, 60)) for _ in range(12)]
    for i in range(300):
        s = base[i % 12].copy()
        s[rng.integers(0, 60, rng.integers(0, 12))] = rng.integers(-(1 << 62), 1 << 62)
        rows.append((i, np.unique(s).tolist()))
    sets = spark.createDataFrame([(i, len(s), s) for i, s in rows], "set_id long, n long, hashes array<long>")
    cells = {}
    for r in _voronoi(sets.selectExpr("0L AS region", "set_id"), sets, 80, 20).collect():
        cells.setdefault(r.region, set()).add(r.set_id)
    assert len(cells) > 5 and max(map(len, cells.values())) < 120
    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if 100 * len(set(a) & set(b)) >= 80 * len(set(a) | set(b)):
            assert any(i in c and j in c for c in cells.values())
