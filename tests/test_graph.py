import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from folioweave import lexicons as lx
from folioweave.functions import fuzzy
from folioweave.operators import facts as fx
from folioweave.operators import graph as g
from folioweave.operators import mentions as mt
from folioweave.operators import segment as sg
from folioweave.operators import summary as sm
from folioweave.operators import symbols as sy
from folioweave.operators import views as vw

from .cases.fixtures import BUNDLE, bundle_units

FACTS = "fact_id long, doc_id string, type string, entities array<string>, date date, amount string, polarity string"


def test_clusters_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 130)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.cluster for r in g.clusters(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_hubs_do_not_pair_and_repartitioning_changes_nothing(spark):
    rows = [(i, "d", "T", [f"e{i % 7}", "court"], None, None, "NEUTRAL") for i in range(80)]
    facts = spark.createDataFrame(rows, FACTS)
    pairs = g.candidates(g.postings(facts))
    assert pairs.count() == sum(n * (n - 1) // 2 for n in (12, 12, 12, 11, 11, 11, 11))
    a = sorted(map(tuple, g.edges(facts, least=0.1).collect()))
    assert a and a == sorted(map(tuple, g.edges(facts.repartition(7, "doc_id"), least=0.1).collect()))


def brute_edges(rows, hub, top_k, least, vec):
    """All pairs, scored and ranked one by one."""
    keys = {r[0]: {*(r[3] or []), *([f"date::{r[4]}"] if r[4] else []), f"type::{r[2]}"} for r in rows}
    df = {}
    for ks in keys.values():
        for k in ks:
            df[k] = df.get(k, 0) + 1
    idf = {k: math.log((len(rows) + 1) / (n + 1)) + 0.1 for k, n in df.items()}
    score = {}
    for x in rows:
        for y in rows:
            if x[0] < y[0] and any(df[k] <= hub for k in keys[x[0]] & keys[y[0]]):
                entity = min(sum(idf[k] for k in sorted(set(x[3] or []) & set(y[3] or []))) / 2, 1.0)
                time = max(0.0, 1 - abs((x[4] - y[4]).days) / lx.HORIZON_DAYS) if x[4] and y[4] else 0.0
                text = sum(a * b for a, b in zip(vec[x[0]], vec[y[0]], strict=True)) if vec else 0.0
                score[x[0], y[0]] = lx.W_ENTITY * entity + lx.W_TIME * time + lx.W_TEXT * text + lx.W_SAME * (lx.SAME_BONUS if x[1] == y[1] else 0.0)
    good = {p: s for p, s in score.items() if s >= least}
    kept = set()
    for n in keys:
        ends = sorted((-s, b if a == n else a, (a, b)) for (a, b), s in good.items() if n in (a, b))
        kept |= {p for _, _, p in ends[:top_k]}
    return {p: round(good[p], 9) for p in kept}


@pytest.mark.parametrize("with_vectors", [False, True])
def test_edges_against_all_pairs(spark, with_vectors):
    """Hub entities count in scores though they make no pairs; bounds and thresholds lose no pair."""
    rng = random.Random(9)
    rows, vec = [], {}
    for i in range(150):
        entities = [f"e{rng.randrange(30)}" for _ in range(rng.randrange(3))] + (["court"] if i % 2 else [])
        rows.append((i, f"d{i % 7}", f"T{i % 2}", entities if i % 11 else None, datetime.date(2020, 1, 1) + datetime.timedelta(rng.randrange(90)) if i % 5 else None, None, "NEUTRAL"))
        v = [rng.gauss(0, 1) for _ in range(3)]
        vec[i] = [x / math.sqrt(sum(y * y for y in v)) for x in v]
    facts = spark.createDataFrame(rows, FACTS)
    if with_vectors:
        facts = facts.join(spark.createDataFrame([(i, v) for i, v in vec.items()], "fact_id long, vec array<double>"), "fact_id")
    for hub, top_k, least in ((12, 3, 0.05), (40, 1, 0.2)):
        got = {(r.a, r.b): round(r.score, 9) for r in g.edges(facts, hub=hub, top_k=top_k, least=least).collect()}
        assert got == brute_edges(rows, hub, top_k, least, vec if with_vectors else None) != {}


def test_bounds_leave_pairs_out(spark):
    """What `promising` scores is less than all candidates."""
    rng = random.Random(2)
    rows = [(i, "d", "T", ["e"], datetime.date(2020, 1, 1) + datetime.timedelta(rng.randrange(2000)), None, "NEUTRAL", [1.0, 0.0]) for i in range(40)]
    facts = spark.createDataFrame(rows, FACTS + ", vec array<double>")
    n = F.lit(40)
    parts = g.rated(facts, n)
    assert g.promising(parts, facts, 2, 0.3).count() < parts.count() / 2


def test_linked_documents_and_control(spark):
    rows = [(1, "09", "P", ["ORG:bank"], None, None, "ASSERTS"), (2, "21", "P", ["ORG:bank"], None, None, "DENIES"), (3, "01", "P", ["ORG:mill"], None, None, "ASSERTS")]
    out = g.edges(spark.createDataFrame(rows, FACTS), least=0.05, gate=True).collect()
    assert [(e.a, e.b, e.label, e.cross_doc) for e in out] == [(1, 2, "POTENTIAL_CONFLICT", True)]
    assert g.edges(spark.createDataFrame([], FACTS)).count() == 0


def test_fuzzy_ratios():
    assert fuzzy.ratio("abc", "abd") == 200 * 2 / 6 and fuzzy.ratio("", "") == 100
    assert fuzzy.token_sort_ratio("bank of baroda", "baroda bank of") == 100
    assert fuzzy.token_set_ratio("advocates act", "the advocates act") == 100
    assert fuzzy.partial_ratio("facts of this case", "now the facts of this case are") == 100


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in "xy")
        assert fuzzy.common_subsequence(a, b) == brute_lcs(a, b)


def test_symbols(spark):
    rows = [("a.txt", "ORG", "Bank of Baroda", 1), ("b.txt", "ORG", "The Bank of Baroda", 2), ("b.txt", "AMOUNT", "Rs. 9 lakh", 3), ("c.txt", "AMOUNT", "Rupees Nine Lakh", 4), ("c.txt", "PROVISION", "Order VII Rule 11", 5)]
    sites = sy.sites(spark.createDataFrame(rows, "doc_id string, kind string, raw string, ord int"))
    t = {r.key: r for r in sy.symbol_table(sites).collect()}
    assert t["ORG:bank of baroda"].definition == "a.txt" and t["ORG:bank of baroda"].aliases == ["Bank of Baroda", "The Bank of Baroda"]
    assert t["AMOUNT:900000"].n_sites == 2 and len(t) == 2
    assert [r.document_id for r in sy.references(sites, "ORG:bank of baroda").collect()] == ["a.txt", "b.txt"]


def test_canonical_entities_and_acts(spark):
    names = spark.createDataFrame([("ORG", "Cygnus Splendid Ltd.", 1), ("ORG", "Cygnus Splendids Limited", 2), ("PERSON", "Cygnus Splendid", 3), ("ORG", "Other Mill", 4)], "kind string, text string, ord int")
    got = {(r.kind, r.text): r.entity_id for r in sy.canonical_entities(names).collect()}
    assert got["ORG", "Cygnus Splendid Ltd."] == got["ORG", "Cygnus Splendids Limited"] == "ORG:cygnus splendid"
    assert got["PERSON", "Cygnus Splendid"] == "PERSON:cygnus splendid" and got["ORG", "Other Mill"] == "ORG:other mill"
    index = spark.createDataFrame([("1", "Advocates Act", 1961), ("2", "Advocates Act", 1999), ("3", "Companies Act", 1956)], "id string, short_title string, act_year int")
    acts = spark.createDataFrame([("Advocates Act, 1999",), ("The Companies Act",), ("Unknown Law, 1950",)], "act string")
    assert {r.act: r.id for r in sy.looked_up_acts(acts, index).collect()} == {"Advocates Act, 1999": "2", "The Companies Act": "3"}


def test_facts_of_the_bundle_are_verbatim(spark):
    units = bundle_units(spark)
    out = fx.derived(units, mt.mentions(units, fx.KEYS), mt.names(units, fx.KEYS)).collect()
    texts = dict(BUNDLE)
    assert {r.type for r in out} >= {"AGREEMENT", "NOTICE", "FILING", "PAYMENT", "SECTION"}
    assert {r.doc_id for r in out if r.type == "SECTION"} == {"c.txt"}
    for r in out:
        if r.type not in lx.EVENT_PHRASES:
            assert texts[r.doc_id][r.char_start : r.char_end].strip() == r.text
        assert r.page == 1 and r.context.context in texts[r.doc_id]
    notice = next(r for r in out if r.type == "NOTICE")
    assert notice.polarity == "DENIES" and "PERSON:bharat steel" in notice.entities and str(notice.linked_date) == "2020-03-05"


def test_roles_carry_and_attach(spark):
    paras = [(0, "brief facts are these", 0, 10), (1, "something", 10, 20), (2, "reported in a law journal", 20, 30), (3, "nothing", 30, 40), (4, "we dismiss it", 40, 50)]
    df = spark.createDataFrame([("d", *p) for p in paras], "doc_id string, para_no int, paragraph string, char_start int, char_end int")
    tagged = fx.roles(df, ["doc_id"], "para_no", "paragraph")
    assert [(r.role, r.role_confidence) for r in tagged.orderBy("para_no").collect()] == [("FACTS", "cue_matched"), ("FACTS", "carried_forward"), ("PRECEDENT", "cue_matched"), ("FACTS", "carried_forward"), ("RULING", "cue_matched")]
    facts = spark.createDataFrame([("d", 15), ("d", 25), ("d", 99)], "doc_id string, char_start int")
    assert [r.role for r in fx.with_roles(facts, tagged, ["doc_id"]).orderBy("char_start").collect()] == ["FACTS", "PRECEDENT", None]


def test_timeline_drops_near_duplicates(spark):
    rows = [(1, "c", "2020-01-01", "alpha bravo charlie delta", "p.1", "X"), (2, "c", "2020-01-02", "alpha bravo charlie delta", "p.1", "X"), (3, "c", "2020-01-01", "alpha bravo charlie other words", "p.1", "X"), (4, "c", "2020-01-03", "wholly different matter", "PRAYER", "X"), (5, "c", None, "undated", "p.1", "X")]
    df = spark.createDataFrame(rows, "fact_id long, case string, date string, text string, section_label string, type string").withColumn("date", F.to_date("date"))
    assert [r.fact_id for r in vw.timeline(df, "case").collect()] == [3]


def test_word_amounts_stay_away_from_figures(spark):
    units = spark.createDataFrame([("d", "paid Rs. 5,000 (Rupees Five Thousand) and later, after a long while and many more words, Rupees Two Lakh only"), ("e", "he waited a hundred years; a sum of Rs. ____ due")], "doc_id string, text string")
    assert [(r.raw, r.value) for r in mt.amounts(units, ["doc_id"]).orderBy("start").collect()] == [("Rs. 5,000", 5000), ("Rupees Two Lakh only", 200000)]
    head = spark.createDataFrame([("Source: x\nAuthor: y\nBody text",), ("Body",)], "text string").select(mt.header_end(F.col("text"))).collect()
    assert [r[0] for r in head] == [20, 0]


def test_units_without_text(spark):
    units = spark.createDataFrame([("d", None), ("e", "")], "doc_id string, text string")
    assert mt.mentions(units, ["doc_id"]).count() == 0
    assert sg.sentences(sg.paragraphs(units, ["doc_id"]), ["doc_id"]).count() == 0


def test_statutes_and_labels(spark):
    rows = spark.createDataFrame([("k", "Section 49", "Advocates Act, 1961"), ("l", "Section 7a", "Other Act"), ("m", "Section 1", None)], "key string, section string, act string")
    law = spark.createDataFrame([("Advocates Act", "49", "text of it"), ("Advocates Act, 1961", "49", "text of it"), ("Third Act", "1", "no")], "act string, section string, text string")
    assert {r.key: r.statute_lookup for r in sm.with_statutes(rows, law).collect()} == {"k": "text of it", "l": None, "m": None}
    names = spark.createDataFrame([("NOTICE",), ("ODD_KIND",)], "t string").select(sm.friendly(F.col("t")).alias("f")).collect()
    assert [r.f for r in names] == ["Notice", "Odd Kind"]


def test_links_of_clusters_are_computed_once_and_stars_are_at_rest(spark, monkeypatch):
    seen, rounds = spark.sparkContext.accumulator(0), []
    # Only rows that are looked at count.
    counted = F.udf(lambda b: seen.add(1) or b, "long").asNondeterministic()
    links = spark.createDataFrame([(1, 2), (1, 3), (5, 5), (7, 8)], "a long, b long").select("a", counted("b").alias("b"))
    settled = g.settled
    monkeypatch.setattr(g, "settled", lambda df: rounds.append(1) or settled(df))
    got = {r["node"]: r["cluster"] for r in g.clusters(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 7: 7, 8: 7}
    assert seen.value == 4 and len(rounds) == 2
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(60, 50), (50, 55), (60, 55)], "a long, b long")
    got = {r["node"]: r["cluster"] for r in g.clusters(chain).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 55: 50, 60: 50}


def test_a_pair_is_found_at_the_first_key_that_both_have(spark):
    """Pairs grow faster than facts, so no shuffle takes them: facts that share several keys are one pair without a distinct."""
    rng = random.Random(7)
    posts = [(k, i) for i in range(60) for k in rng.sample("abcdefgh", 3)] + [("hub", i) for i in range(60)]
    got = [tuple(r) for r in g.candidates(spark.createDataFrame(posts, "key string, fact_id long"), 30).collect()]
    keys = {k: sorted(i for x, i in posts if x == k) for k in {k for k, _ in posts}}
    want = {(a, b) for ids in keys.values() if len(ids) <= 30 for a in ids for b in ids if a < b}
    assert sorted(got) == sorted(want)
    plan = g.candidates(spark.createDataFrame(posts, "key string, fact_id long"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")


@pytest.mark.parametrize("with_hub", [False, True])
def test_edges_that_need_an_entity(spark, with_hub):
    """At the usual least score dates and amounts are posted only if an entity is a hub; no edge is lost either way."""
    rng = random.Random(11)
    rows = [(i, f"d{i % 3}", "T", [f"e{rng.randrange(9)}", f"f{rng.randrange(12)}"] + ["court"] * with_hub, datetime.date(2020, 1, 1) + datetime.timedelta(rng.randrange(30)), str(rng.randrange(20)), rng.choice(["ASSERTS", "DENIES", "NEUTRAL"])) for i in range(90)]
    facts = spark.createDataFrame(rows, FACTS)
    got = {(r.a, r.b): round(r.score, 9) for r in g.edges(facts, hub=20, least=0.35).collect()}
    assert got == brute_edges(rows, 20, lx.TOP_K, 0.35, None) != {}
    keys = {k for r in g.weighted(facts, F.lit(90), 20, 0.35).collect() for k in r.f.small}
    assert any(k.startswith("amt::") for k in keys) is with_hub


def test_sums_of_many_entities(spark):
    rng = random.Random(12)
    rows = [(i, "d", "T", rng.sample([f"e{k}" for k in range(30)], 6), None, None, "NEUTRAL") for i in range(40)]
    facts = spark.createDataFrame(rows, FACTS)
    told = [{(r.a, r.b): r.score for r in g.edges(facts, least=0.05).collect()} for g.UNROLLED in (8, 3)]
    g.UNROLLED = 8
    assert told[0] == told[1] and {k: round(v, 9) for k, v in told[0].items()} == brute_edges(rows, 40, lx.TOP_K, 0.05, None) != {}
