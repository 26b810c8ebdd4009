"""Cases of extraction over literal sentences, as the driver tables hold no legal wording; the SQL lists what is to be expected, row by row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave import lexicons as lx
from folioweave.functions import text as tx
from folioweave.operators import facts as fx
from folioweave.operators import mentions as mt
from folioweave.operators import parties as pt
from folioweave.operators import segment as sg
from folioweave.operators import summary as sm
from folioweave.operators import symbols as sy
from folioweave.operators import views as vw


def _rows(spark: SparkSession, values: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(i, *v[:-1]) for i, v in enumerate(values)], "id int, " + ", ".join(f"x{j} string" for j in range(len(values[0]) - 1)))


def _sql(values: list[tuple], kind: str) -> str:
    quoted = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    return "SELECT id::INTEGER AS id, value::" + kind + " AS value FROM (VALUES " + ", ".join(f"({i}, {quoted(v[-1])})" for i, v in enumerate(values)) + ") t(id, value)"


_AMOUNTS = [("Rs.1,20,00,000", 12000000), ("Rs. 9 lakh", 900000), ("₹50,000", 50000), ("Rs. 5 crore", 50000000), ("INR 12.5 lakh", 1250000), ("Rs. , was claimed", None)]
_WORDS = [("Rupees Two Crore Five Lakh", 20500000), ("Rs. Ninety Lakhs Only", 9000000), ("INR Twelve Thousand", 12000), ("three hundred and seven", 307), ("no number", None)]
_NAMES = [("Harbour Tea Traders Ltd.", "harbour tea traders"), ("Harbour Tea Traders Limited", "harbour tea traders"), ("The Union of Potters", "union of potters"), ("K. L. Mehta & Sons", "mehta")]
_PROVISIONS = [("Section 22", "section::22"), ("Sec. 7a", "section::7A"), ("Section 49 of the Advocates Act, 1961", "of the advocates act, 1961::49"), ("Order VII Rule 11", None)]
_ACTS = [
    ("goods were seized under Section 110 of the Customs Act, 1962 at the port", "Customs Act, 1962"),
    ("the tenant lodged a complaint under Section 420 of the IPC in May", "Indian Penal Code, 1860"),
    ("a copy under Section 157 Cr.P.C. reached the magistrate late", "Code of Criminal Procedure, 1973"),
    ("notice under Section 106 of the Transfer Act, 1882 was served on him", "Transfer Act, 1882"),
    ("rain fell and nobody spoke of any statute", None),
]
_DATES = [("24.09.2024", "2024-09-24"), ("5 December 2025", "2025-12-05"), ("Dec 5th, 2025", "2025-12-05"), ("2025-12-05", "2025-12-05"), ("31.02.2024", None), ("1/2/21", "2021-02-01"), ("3.4.68", "2068-04-03"), ("30-11-69", "1969-11-30"), ("1/13/21", None), ("1/2/214", None)]
_POLARITY = [("The firm denies the claim", "DENIES"), ("He admits the debt", "ASSERTS"), ("Counsel contends that it is so", "ASSERTS"), ("They refuted all of it", "DENIES"), ("The road was long", "NEUTRAL"), ("an undisputed fact", "DENIES")]
_ROLES = [("The facts of this case are short", "FACTS"), ("In our opinion the plea fails", "ANALYSIS"), ("The appeal is dismissed", "RULING"), ("as reported in a journal", "PRECEDENT"), ("he said nothing of how it all began", None), ("Here the learnd counsel for the petitoner rose", "ARGUMENTS_PETITIONER"), ("the question is wether costs follow", "ISSUES")]
_HEADINGS = [(h, True) for h in ("IX. GROUNDS", "III. QUESTION OF LAW", "SYNOPSIS.", "II. FINAL PRAYER", "Prayer", "LIST OF DATES", "INDEX :", "4. Vakalatnama", "7) GROUNDS FOR INTERIM RELIEF", "MEMO OF PARTIES", "Annexure P-12", "EXHIBIT B")] + [(h, False) for h in ("The grounds of the appeal are set out below", "His prayer was not heard", "Index of all annexures", "100. GROUNDS")]
_FURNITURE = [("R.F.A. 218/2015 Page 3 of 9 the lease had run out by then.", "the lease had run out by then."), ("The tenant paid his rent until the spring.", "The tenant paid his rent until the spring.")]
_PARTY_NAMES = [("Bank of Salem", True), ("r/o Pune", False), ("INDEX", False), ("this is a sentence", False), ("Mi2a Gup7a D0s", False), ("Respondents", False), ("RAO, J.", False), ("Rs. 5,000 only", False), ("with costs", False), ("Plot 27 Residents", True), ("1N THE 5UPREME C0URT", False), ("राम प्रसाद", True), ("1. That the rent was paid", False)]
_CASE_TYPES = [("C.S.", "Plaintiff / Defendant"), ("W.P.(C)", "Petitioner / Respondent"), ("Civil Appeal", "Appellant / Respondent"), ("Execution Petition", "Decree Holder / Judgment Debtor"), ("O.M.P.", "Claimant / Respondent"), ("Diary", None)]
_FRIENDLY = [("DATED_EVENT", "Dated event"), ("IMPORTANT_LINE", "Key point"), ("PAYMENT", "Payment"), ("SITE_VISIT", "Site Visit")]
_GENERIC = [("High Court", True), ("Asha Menon", False), ("AIR 1999 SC 5", True), ("Asha\nMenon", True), ("  JUSTICE ", True)]
_DAMAGE = [("Mi2a Gup7a D0s", True), ("Asha Menon", False), ("Plot 27 Residents", False), ("REP0RT and order of it", False)]
_HEADING_KINDS = [("PRAYER", True), ("Grounds", True), ("Questions of Law", True), ("Facts", False)]
_VERSUS = [("VERSUS", True), ("Vs.", True), ("v/s", True), ("VER5US", True), ("Verses", True), ("the parties", False), ("order", False)]

_SCALARS: dict[str, tuple[list[tuple], str, Callable]] = {
    "fixture_amounts": (_AMOUNTS, "BIGINT", tx.amount_value),
    "fixture_words": (_WORDS, "BIGINT", tx.words_value),
    "fixture_names": (_NAMES, "VARCHAR", tx.normal_name),
    "fixture_provision_keys": (_PROVISIONS, "VARCHAR", tx.provision_key),
    "fixture_act_names": (_ACTS, "VARCHAR", mt.act_name),
    "fixture_dates": (_DATES, "DATE", tx.date_value),
    "fixture_polarity": (_POLARITY, "VARCHAR", tx.polarity),
    "fixture_role_cues": (_ROLES, "VARCHAR", tx.role_cue),
    "fixture_headings": (_HEADINGS, "BOOLEAN", lambda c: c.rlike(lx.HEADING)),
    "fixture_furniture": (_FURNITURE, "VARCHAR", lambda c: F.trim(sg.without_furniture(c))),
    "fixture_versus": (_VERSUS, "BOOLEAN", sy.is_versus),
    "fixture_party_names": (_PARTY_NAMES, "BOOLEAN", lambda c: _each(pt.is_party_name, "boolean", c)),
    "fixture_case_roles": (_CASE_TYPES, "VARCHAR", lambda c: sy.first_prefix(F.regexp_replace(F.lower(c), "[^a-z]", ""), [(k, " / ".join(v)) for k, v in lx.CASE_TYPE_ROLES.items()])),
    "fixture_friendly": (_FRIENDLY, "VARCHAR", sm.friendly),
    "fixture_generic_names": (_GENERIC, "BOOLEAN", lambda c: tx.is_generic_name(F.lit("ORG"), c)),
    "fixture_damaged": (_DAMAGE, "BOOLEAN", lambda c: _each(pt.damaged, "boolean", c)),
    "fixture_provision_headings": (_HEADING_KINDS, "BOOLEAN", lambda c: c.rlike(lx.PROVISION_HEADING)),
}


def _each(f: Callable, kind: str, text: Column) -> Column:
    return F.pandas_udf(lambda t: t.map(f), kind)(text)


#: A short bundle in the manner of filings.
BUNDLE = [
    ("a.txt", "The appellant entered into an agreement on 5 March 2020 for Rs. 9 lakh.\nOn 24.09.2024 Bharat Steel served a notice under Section 49 of the Advocates Act, 1961.\nHe denies the claim of Rupees Ten Thousand.\n"),
    ("b.txt", "C.S. No. 442 of 2024 was instituted on 2024-10-02 by Bharat Steel.\nThe sum of Rs. 9 lakh was paid; Section 49 of the Advocates Act was relied on.\n"),
    ("c.txt", ""),
]


def bundle_units(spark: SparkSession) -> DataFrame:
    pages = spark.createDataFrame([(d, 1, t, "digital") for d, t in BUNDLE], "doc_id string, page_number int, text string, page_kind string")
    return sg.sections(pages)


def bundle_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.mentions(bundle_units(spark), ["doc_id"]).select("doc_id", "kind", "raw", "start", "end", "date", "value")


def bundle_provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = mt.citations(bundle_units(spark), ["doc_id"]).withColumn("ord", F.struct("doc_id", "start"))
    ranked = cited.withColumn("ord", F.xxhash64("doc_id") * 0 + F.col("start") + F.when(F.col("doc_id") == "b.txt", 10_000).otherwise(0))
    return sy.provisions(ranked)


def bundle_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.keyword_hits(bundle_units(spark)).select("doc_id", "type", "phrase", "char_start", "char_end")


def literal_rows(rows: list[tuple], columns: str) -> str:
    """SQL for given rows; columns: name::type, ..."""
    quoted = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    names = [c.split("::") for c in columns.split(", ")]
    return "SELECT " + ", ".join(f'"{n}"::{k} AS "{n}"' for n, k in names) + " FROM (VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + ") t(" + ", ".join(f'"{n}"' for n, _ in names) + ")"


def _at(doc: str, raw: str) -> tuple[int, int]:
    at = dict(BUNDLE)[doc].index(raw)
    return at, at + len(raw)


#: Openings of documents of several kinds.
CAPTIONS = [
    ("suit", "IN THE HIGH COURT\nCOMMERCIAL SUIT NO. 71 OF 2022\n\nKaveri Granite Limited ...Plaintiff\n\nVERSUS\n\n1. Nila Ports Pvt. Ltd.\n2. Arun Das ...Defendants\n\nORDER\n"),
    ("hindi", "याचिका संख्या 12/2023\nराम प्रसाद याचिकाकर्ता\nबनाम\nमोहन लाल प्रतिवादी\n"),
    ("notice", "LEGAL NOTICE\nTo,\nSunder Mills\n\nUnder instructions from my client Lakshmi Traders, you are called on to pay within 15 days.\n"),
    ("letter", "From: Green Valley Society\nTo\nThe Collector\nSubject: water\nDear Sir,\n"),
    ("deed", "THIS AGREEMENT IS MADE today\nBETWEEN\nRam Stores (hereinafter called the Seller)\nAND\nShyam Stores (hereinafter called the Buyer)\nWHEREAS the goods are sold\n"),
    ("oath", "I, Asha Menon, aged 40 years, do hereby solemnly affirm\nDEPONENT\n"),
    ("account", "Account No. 4471 IFSC ABCD0001\n\n\n\n\nMeera Jain\nVs\nState Bank\n"),
    ("short", "Gopal Rai versus Union Mills on 4 May 2011\n"),
    ("scan", "1N THE H1GH C0URT\n5ome words\n"),
    ("none", "rain fell on the hills\n"),
]
_TIERS = [
    ("suit", "DEGRADED_tier1_cause_title", "high", "court_filing"), ("hindi", "DEGRADED_tier1_cause_title", "high", "court_filing"), ("notice", "DEGRADED_tier1_letterhead", "high", "legal_notice"),
    ("letter", "DEGRADED_tier1_letterhead", "high", "correspondence"), ("deed", "DEGRADED_tier1_recital", "high", "contract"), ("oath", "DEGRADED_tier1_deponent", "high", "affidavit"),
    ("account", "DEGRADED_tier2_cause_title", "medium", "financial"), ("short", "DEGRADED_tier4_inline", "low", "generic"), ("scan", "DEGRADED_tier4b_title_block", "block", "generic"), ("none", "DEGRADED_tier5_none", "none", "generic"),
]
_CAPTION_PARTIES = [
    ("suit", "Kaveri Granite Limited", "Plaintiff", "explicit", "A", None, "PARTY:kaveri granite"), ("suit", "Nila Ports Pvt. Ltd", "Defendant", "explicit", "B", 1, "PARTY:nila ports"), ("suit", "Arun Das", "Defendant", "explicit", "B", 2, "PARTY:arun das"),
    ("hindi", "राम प्रसाद", "Petitioner", "explicit", "A", None, "PARTY:"), ("hindi", "मोहन लाल", "Respondent", "explicit", "B", None, "PARTY:"),
    ("notice", "Lakshmi Traders", "Sender", "explicit", "A", None, "PARTY:lakshmi traders"), ("notice", "Sunder Mills", "Recipient", "explicit", "B", None, "PARTY:sunder mills"),
    ("letter", "Green Valley Society", "Sender", "explicit", "A", None, "PARTY:green valley society"), ("letter", "The Collector", "Recipient", "explicit", "B", None, "PARTY:collector"),
    ("deed", "Ram Stores", "Seller", "explicit", "A", None, "PARTY:ram stores"), ("deed", "Shyam Stores", "Buyer", "explicit", "B", None, "PARTY:shyam stores"), ("oath", "Asha Menon", "Deponent", "explicit", "A", None, "PARTY:asha menon"),
    ("account", "Meera Jain", "Account Holder", "positional", "A", None, "PARTY:meera jain"), ("account", "State Bank", "Counterparty", "positional", "B", None, "PARTY:state bank"),
    ("short", "Gopal Rai", "Party A", "positional", "A", None, "PARTY:gopal rai"), ("short", "Union Mills", "Party B", "positional", "B", None, "PARTY:union mills"),
]


def _captions(spark: SparkSession) -> DataFrame:
    return pt.party_results(spark.createDataFrame(CAPTIONS, "doc_id string, text string"))


def caption_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _captions(spark).select("doc_id", "tier", "confidence", "profile")


def caption_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.parties(_captions(spark)).select("doc_id", "name", "role", "role_confidence", "side", "ordinal", "party_id")


def caption_model_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PTY11 to PTY13: a model's two sides, with roles by the type of case where the caption names one."""
    docs = spark.createDataFrame(CAPTIONS[:2], "doc_id string, text string")
    return pt.parties(pt.party_results(docs, tagger=lambda text: [("X Y", "Petitioner", "A"), ("Z W", "Respondent", "B")])).select("doc_id", "tier", "name", "role", "role_confidence")


def caption_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVT13."""
    return pt.fallback_facts(_captions(spark)).select("doc_id", "type", "text", "page", "confidence")


def caption_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT11: a model that only knows names of one word; the state is kept by its name."""
    rows = spark.createDataFrame([(1, "State of Goa & Ors."), (2, "Asha Menon"), (3, "Ravi and others")], "id int, name string")
    short = lambda name: F.when(F.contains(name, F.lit(" ")), 0.1).otherwise(0.9)
    return pt.judged(rows, coverage=short).select("id", "kept")


#: An index of acts, and how acts are cited.
_INDEX = [("a1", "The Customs Act, 1962", 1962), ("a2", "The Customs Tariff Act, 1975", 1975), ("a3", "The Indian Contract Act, 1872", 1872), ("a4", "The Sale of Goods Act, 1930", 1930), ("a5", "Ports Tariff Code", None)]
_CITED = [("Customs Act, 1962", "a1"), ("Indian Contract Act", "a3"), ("Sale of Goods Act, 1930", "a4"), ("Railways Act, 1989", None), ("Ports Tarif Code", "a5"), ("Code of Ports, 1990", None)]


def cited_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN13."""
    index = spark.createDataFrame(_INDEX, "id string, short_title string, act_year int")
    acts = spark.createDataFrame([(a,) for a, _ in _CITED], "act string")
    return acts.join(sy.looked_up_acts(acts, index).select("act", "id"), "act", "left")


#: Pages, of which the second is a table of contents.
_TOC = [("t", 1, "INDEX of papers\nFirst part .......... 1\n"), ("t", 2, "1. Facts of it ..... 3\n2. Grounds of it ..... 7\nAnnexure one      12\nend"), ("u", 1, "no table")]


def toc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG2."""
    return sg.toc_pages(spark.createDataFrame(_TOC, "doc_id string, page_number int, text string"))


#: Sections with every kind of fact: a caption line, numbered paragraphs, a bare section, and paragraphs between blank lines.
SECTIONS = [
    ("f.txt", "author: registry copy of Ravi Menon\n1. The facts of the case are short. The tenant paid Rs. 500 on 3 May 2019 to Asha Menon. He left soon after that day.\n2. Mehta Stores would deliver the goods in June. The deed was long and dull to read. The goods were never seen again by anyone.\n3. A hearing took place on 7 June 2021.\n"),
    ("g.txt", "Rain fell on the hills.\n"),
    ("h.txt", "In our opinion the claim fails. It is so held by us all today. Costs follow the event as usual.\n\nThe firm denies that 4 May 2020 was a holiday.\n"),
]
_PAID = SECTIONS[0][1][: SECTIONS[0][1].index("3. A") + 2]
_FACTS = [
    ("f.txt", "IMPORTANT_LINE", 72, 124, "The tenant paid Rs. 500 on 3 May 2019 to Asha Menon.", "2019-05-03", None, "", "NEUTRAL", "ranked", "FACTS", "cue_matched", 1),
    ("f.txt", "PAYMENT", 83, 87, _PAID, "2019-05-03", "Rs. 500", "PERSON:asha menon|PERSON:mehta stores", "NEUTRAL", "keyword", "FACTS", "cue_matched", 1),
    ("f.txt", "FACT", 154, 202, "2. Mehta Stores would deliver the goods in June.", None, None, "", "NEUTRAL", "lexical_parse", "FACTS", "carried_forward", 1),
    ("f.txt", "IMPORTANT_LINE", 203, 238, "The deed was long and dull to read.", None, None, "", "NEUTRAL", "ranked", "FACTS", "carried_forward", 1),
    ("f.txt", "DATED_EVENT", 282, 321, "3. A hearing took place on 7 June 2021.", "2021-06-07", None, "", "NEUTRAL", "verbatim_fallback", "FACTS", "carried_forward", 1),
    ("g.txt", "SECTION", 0, 23, "Rain fell on the hills.", None, None, "", "NEUTRAL", "verbatim_fallback", None, None, 1),
    ("h.txt", "IMPORTANT_LINE", 32, 62, "It is so held by us all today.", None, None, "", "NEUTRAL", "ranked", "ANALYSIS", "cue_matched", 1),
    ("h.txt", "DATED_EVENT", 97, 143, "The firm denies that 4 May 2020 was a holiday.", "2020-05-04", None, "", "DENIES", "verbatim_fallback", "ANALYSIS", "carried_forward", 1),
]


def caption_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT4: names in the title block of a document are no entities of its facts."""
    text = "Asha Menon\nVERSUS\nRavi Nair\nORDER\nThe tenant paid Rs. 500 to Mohan Lal.\n"
    units = sg.sections(spark.createDataFrame([("d", 1, text, "digital")], "doc_id string, page_number int, text string, page_kind string"))
    block = spark.createDataFrame([("d", 3)], "doc_id string, line_end int")
    found = fx.derived(units, mt.mentions(units, fx.KEYS), mt.names(units, fx.KEYS), block)
    return found.where("type = 'PAYMENT'").select("type", F.array_join("entities", "|").alias("entities"))


def section_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET1: keyword facts with what is near them, important lines, dated and parsed facts, section fallbacks, roles and pages."""
    pages = spark.createDataFrame([(d, 1, t, "digital") for d, t in SECTIONS], "doc_id string, page_number int, text string, page_kind string")
    units = sg.sections(pages)
    found = fx.derived(units, mt.mentions(units, fx.KEYS), mt.names(units, fx.KEYS))
    return found.select("doc_id", "type", "char_start", "char_end", "text", "linked_date", "amount", F.array_join("entities", "|").alias("entities"), "polarity", "confidence", "role", "role_confidence", "page")


#: Facts of a case for its timeline.
_DATED = [
    (1, "2020-01-01", "The long river bridge collapsed during heavy winter storms", "ORDER", None), (2, "2020-01-02", "During heavy winter storms the long river bridge collapsed", "ORDER", None),
    (3, "2020-01-02", "Heavy storms closed every mountain road near that village", "ORDER", None), (4, "2020-01-02", "Heavy storms closed every mountain pass", "ORDER", None),
    (5, "2020-01-03", "A hearing took place", "ORDER", "PRAYER"), (6, "2020-01-03", "Someone versus nobody", "PARTIES", None), (7, None, "Nothing is known of when", "ORDER", None),
    (8, "2020-01-04", "so it is", "ORDER", None), (9, "2020-01-04", "so it is", "ORDER", None),
]


def case_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: 2 says what 1 does, 4 is the shorter one of two alike on a date, 5 to 7 are no events; short words tell nothing."""
    facts = spark.createDataFrame(_DATED, "fact_id int, date string, text string, type string, section_label string")
    dated = facts.withColumn("date", F.to_date("date")).withColumn("case", F.lit("c"))
    return vw.timeline(dated, "case").select("fact_id", "date", "text")


_MENTIONS = [
    (d, k, r, *_at(d, r), date, value)
    for d, k, r, date, value in (
        ("a.txt", "DATE", "5 March 2020", "2020-03-05", None), ("a.txt", "DATE", "24.09.2024", "2024-09-24", None), ("a.txt", "AMOUNT", "Rs. 9 lakh", None, 900000),
        ("a.txt", "AMOUNT", "Rupees Ten Thousand", None, 10000), ("a.txt", "PROVISION", "Section 49", None, None), ("b.txt", "DATE", "2024-10-02", "2024-10-02", None),
        ("b.txt", "AMOUNT", "Rs. 9 lakh", None, 900000), ("b.txt", "PROVISION", "Section 49", None, None), ("b.txt", "CASE_NUMBER", "C.S. No. 442 of 2024", None, None),
    )
]
_HITS = [(d, t, p, *_at(d, p)) for d, t, p in (("a.txt", "AGREEMENT", "entered into"), ("a.txt", "NOTICE", "served a notice"), ("b.txt", "FILING", "instituted"), ("b.txt", "PAYMENT", "paid"))]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    scalar = {name: (lambda spark, _, v=v, f=f: _rows(spark, v).select("id", f(F.col("x0")).alias("value"))) for name, (v, _, f) in _SCALARS.items()}
    own = (bundle_mentions, bundle_provisions, bundle_hits, caption_tiers, caption_parties, caption_model_roles, caption_fallbacks, caption_kept, cited_acts, toc_pages, section_facts, case_timeline, caption_entities)
    return scalar | {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    scalar = {name: _sql(v, kind) for name, (v, kind, _) in _SCALARS.items()}
    return scalar | {
        "bundle_mentions": literal_rows(_MENTIONS, "doc_id::VARCHAR, kind::VARCHAR, raw::VARCHAR, start::INTEGER, end::INTEGER, date::DATE, value::BIGINT"),
        "bundle_hits": literal_rows(_HITS, "doc_id::VARCHAR, type::VARCHAR, phrase::VARCHAR, char_start::INTEGER, char_end::INTEGER"),
        "section_facts": literal_rows(_FACTS, "doc_id::VARCHAR, type::VARCHAR, char_start::INTEGER, char_end::INTEGER, text::VARCHAR, linked_date::DATE, amount::VARCHAR, entities::VARCHAR, polarity::VARCHAR, confidence::VARCHAR, role::VARCHAR, role_confidence::VARCHAR, page::INTEGER"),
        "caption_entities": "SELECT 'PAYMENT' AS type, 'PERSON:mohan lal' AS entities",
        "case_timeline": literal_rows([r[:3] for r in _DATED if r[0] in (1, 3, 8, 9)], "fact_id::INTEGER, date::DATE, text::VARCHAR"),
        "caption_tiers": literal_rows(_TIERS, "doc_id::VARCHAR, tier::VARCHAR, confidence::VARCHAR, profile::VARCHAR"),
        "caption_parties": literal_rows(_CAPTION_PARTIES, "doc_id::VARCHAR, name::VARCHAR, role::VARCHAR, role_confidence::VARCHAR, side::VARCHAR, ordinal::INTEGER, party_id::VARCHAR"),
        "caption_model_roles": literal_rows([(d, "mandatory_ml", n, r, c) for d, rows, c in (("suit", (("X Y", "Plaintiff"), ("Z W", "Defendant")), "model+case_type"), ("hindi", (("X Y", "Petitioner"), ("Z W", "Respondent")), "model")) for n, r in rows], "doc_id::VARCHAR, tier::VARCHAR, name::VARCHAR, role::VARCHAR, role_confidence::VARCHAR"),
        "caption_fallbacks": "SELECT 'scan' AS doc_id, 'PARTIES' AS type, '1N THE H1GH C0URT' || chr(10) || '5ome words' || chr(10) AS text, 1 AS page, 'verbatim_fallback' AS confidence",
        "caption_kept": literal_rows([(1, True), (2, False), (3, True)], "id::INTEGER, kept::BOOLEAN"),
        "cited_acts": literal_rows(_CITED, "act::VARCHAR, id::VARCHAR"),
        "toc_pages": "SELECT 't' AS doc_id, 2 AS page_number, 3::BIGINT AS toc_lines",
        "bundle_provisions": "SELECT 'of the advocates act::49' AS key, 'Section 49' AS section, 'Advocates Act, 1961' AS act, ['a.txt', 'b.txt'] AS documents, 2::BIGINT AS count",
    }
