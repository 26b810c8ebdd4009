"""Queries of extraction over texts that Spark derives from the driver tables, as these hold no legal wording.

Each order becomes a short filing and each customer a caption. Their SQL computes what is to be found from the columns that
went into the text, not by searching it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.functions import fuzzy as fz
from folioweave.operators import containment as ct
from folioweave.operators import facts as fx
from folioweave.operators import mentions as mt
from folioweave.operators import parties as pt
from folioweave.operators import segment as sg
from folioweave.operators import splitting as sp
from folioweave.operators import symbols as sy
from folioweave.plans.adapters import spread, table
from folioweave.session import settled

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---------------------------------------------------------------- phrases of documents

_FREQUENT = r"p AS MATERIALIZED (SELECT w FROM (SELECT unnest(regexp_extract_all(text, '[a-z]{5,}')) AS w FROM documents) GROUP BY w ORDER BY count(*) DESC, w LIMIT 300)"


@query(f"WITH {_FREQUENT}, t AS MATERIALIZED (SELECT doc_id, lower(text) AS low FROM documents WHERE text IS NOT NULL) SELECT doc_id, w AS phrase, (length(low) - length(replace(low, w, ''))) // length(w) AS n, (position(w IN low) - 1)::INTEGER AS first FROM t, p WHERE contains(low, w)")
def document_phrase_hits(spark, sf_dir):  # noqa: ANN001, ANN201
    """EVT1, JN8: the 300 most frequent long words of all documents, looked for in one pass."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{5,}"), F.lit(0))).alias("w"))
    frequent = [r["w"] for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(300).collect()]
    return fx.phrase_hits(docs, frequent, ["doc_id"], 0).groupBy("doc_id", "phrase").agg(F.count(F.lit(1)).alias("n"), F.min("char_start").alias("first"))


# ---------------------------------------------------------------- filings from orders

_TENS = "Twenty Thirty Forty Fifty Sixty Seventy Eighty".split()
_UNITS = "One Two Three Four Five Six Seven Eight Nine".split()

#: As _filings(): each part with what stands before it.
_PARTS = f"""
k AS (SELECT o_orderkey AS id, o_orderdate::DATE AS d, floor(o_totalprice)::BIGINT AS price FROM orders),
v AS (SELECT *, CASE id % 3 WHEN 0 THEN strftime(d, '%-d %B %Y') WHEN 1 THEN strftime(d, '%Y-%m-%d') ELSE strftime(d, '%d.%m.%Y') END AS day, id % 13 = 5 AS bare,
  CASE WHEN id % 4 = 0 THEN 'Rs. ' || (id % 90 + 1) || ' lakh' ELSE 'Rs. ' || format('{{:,}}', price) END AS sum, CASE WHEN id % 4 = 0 THEN (id % 90 + 1) * 100000 ELSE price END AS sum_value,
  'Rupees ' || {_TENS!r}[id % 70 // 10 + 1] || CASE WHEN id % 10 > 0 THEN ' ' || {_UNITS!r}[id % 10] ELSE '' END || ' Thousand only' AS words, (20 + id % 70) * 1000 AS words_value FROM k),
t AS (SELECT *, CASE WHEN id % 6 = 0 THEN 'Brief facts are these.' || chr(10) ELSE '' END AS s0, 'On ' || day || ' the buyer paid ' || sum || ' to the seller.' AS s1,
  CASE WHEN id % 2 = 0 THEN chr(10) || 'The marks fall under Section ' || (id % 40 + 1) || ' of the Trade Marks Act, 1999 and the buyer denies it.' ELSE '' END AS s2,
  CASE WHEN id % 5 = 0 THEN chr(10) || 'See C.S. No. ' || (id % 900 + 1) || ' of ' || year(d) || ' on it.' ELSE '' END AS s3,
  CASE WHEN id % 11 = 0 THEN chr(10) || 'A further sum of ' || words || ' was due.' ELSE '' END AS s4 FROM v),
u AS MATERIALIZED (SELECT *, length(s0) AS at1, length(s0 || s1) AS at2, length(s0 || s1 || s2) AS at3, length(s0 || s1 || s2 || s3) AS at4 FROM t)
"""


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_number, text, page_kind: an order as a page: when what was paid, now and then a provision, a case number, an amount in words, or nothing."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"), F.floor("o_totalprice").alias("price"))
    n, id_ = lambda x: x.cast("string"), F.col("id")
    day = F.when(id_ % 3 == 0, F.date_format("d", "d MMMM yyyy")).when(id_ % 3 == 1, F.date_format("d", "yyyy-MM-dd")).otherwise(F.date_format("d", "dd.MM.yyyy"))
    paid = F.concat(F.lit("Rs. "), F.when(id_ % 4 == 0, F.concat(n(id_ % 90 + 1), F.lit(" lakh"))).otherwise(F.format_number("price", 0)))
    pick = lambda words, at: F.element_at(F.array(*[F.lit(w) for w in words]), at.cast("int"))
    in_words = F.concat_ws(" ", F.lit("Rupees"), pick(_TENS, F.floor(id_ % 70 / 10) + 1), F.when(id_ % 10 > 0, pick(_UNITS, F.greatest(id_ % 10, F.lit(1)))), F.lit("Thousand only"))
    part = lambda every, *text: F.when(id_ % every == 0, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in text]))
    text = F.concat_ws(
        "",
        part(6, "Brief facts are these.\n"),
        F.concat(F.lit("On "), day, F.lit(" the buyer paid "), paid, F.lit(" to the seller.")),
        part(2, "\nThe marks fall under Section ", n(id_ % 40 + 1), " of the Trade Marks Act, 1999 and the buyer denies it."),
        part(5, "\nSee C.S. No. ", n(id_ % 900 + 1), " of ", n(F.year("d")), " on it."),
        part(11, "\nA further sum of ", in_words, " was due."),
    )
    return o.select(id_.alias("doc_id"), F.lit(1).alias("page_number"), F.when(id_ % 13 == 5, "Nothing of note.").otherwise(text).alias("text"), F.lit("digital").alias("page_kind"))


_MENTIONS = """m AS (
SELECT id, 'DATE' AS kind, day AS raw, at1 + 3 AS start, d AS date, NULL::BIGINT AS value FROM u WHERE NOT bare
UNION ALL SELECT id, 'AMOUNT', sum, at1 + length(day) + 19, NULL, sum_value FROM u WHERE NOT bare
UNION ALL SELECT id, 'PROVISION', 'Section ' || (id % 40 + 1), at2 + 22, NULL, NULL FROM u WHERE NOT bare AND s2 <> ''
UNION ALL SELECT id, 'CASE_NUMBER', 'C.S. No. ' || (id % 900 + 1) || ' of ' || year(d), at3 + 5, NULL, NULL FROM u WHERE NOT bare AND s3 <> ''
UNION ALL SELECT id, 'AMOUNT', words, at4 + 18, NULL, words_value FROM u WHERE NOT bare AND s4 <> '')"""


@query(f'WITH {_PARTS}, {_MENTIONS} SELECT id AS doc_id, kind, raw, start::INTEGER AS start, (start + length(raw))::INTEGER AS "end", date, value FROM m')
def order_mentions(spark, sf_dir):  # noqa: ANN001, ANN201
    """MEN1 to MEN7, FN5, FN7, FN11."""
    return mt.mentions(_filings(spark, sf_dir), ["doc_id"])


@query(f"""WITH {_PARTS} SELECT 'of the trade marks act::' || (id % 40 + 1) AS key, 'Section ' || (id % 40 + 1) AS section, 'Trade Marks Act, 1999' AS act, list(id ORDER BY id) AS documents, count(*) AS count FROM u WHERE NOT bare AND s2 <> '' GROUP BY id % 40""")
def order_provisions(spark, sf_dir):  # noqa: ANN001, ANN201
    """AGG4, V4, MEN11, FN8, FN10."""
    cited = mt.citations(_filings(spark, sf_dir), ["doc_id"]).withColumn("ord", F.col("doc_id"))
    return sy.provisions(cited)


@query(f"""WITH {_PARTS}, {_MENTIONS} SELECT id AS doc_id, 'PAYMENT' AS type, (at1 + length(day) + 14)::INTEGER AS char_start, d AS linked_date, sum AS amount FROM u WHERE NOT bare""")
def order_hits(spark, sf_dir):  # noqa: ANN001, ANN201
    """EVT1, EVT2, JN2: keyword hits with the first date and amount near them."""
    pages = _filings(spark, sf_dir)
    hits = fx.first_per_bucket(fx.keyword_hits(pages, keys=["doc_id"]), ["doc_id", "type"])
    found = mt.mentions(pages, ["doc_id"]).withColumn("entity_id", F.lit(None).cast("string"))
    return fx.near_mentions(hits, found, ["doc_id"]).select("doc_id", "type", "char_start", "linked_date", "amount")


_FACTS = f"""WITH {_PARTS}, n AS (SELECT *, 1 + (s0 <> '')::INTEGER + (s2 <> '')::INTEGER + (s3 <> '')::INTEGER + (s4 <> '')::INTEGER AS sentences, CASE WHEN s0 <> '' THEN 'FACTS' END AS role FROM u)
SELECT id AS doc_id, 'PAYMENT' AS type, (at1 + length(day) + 14)::INTEGER AS char_start, (at1 + length(day) + 18)::INTEGER AS char_end, d AS linked_date, sum AS amount, CASE WHEN s2 <> '' THEN 'DENIES' ELSE 'NEUTRAL' END AS polarity, 'keyword' AS confidence, role FROM n WHERE NOT bare
UNION ALL SELECT id, CASE WHEN sentences >= 3 THEN 'IMPORTANT_LINE' ELSE 'DATED_EVENT' END, at1::INTEGER, (at1 + length(s1))::INTEGER, d, NULL, 'NEUTRAL', CASE WHEN sentences >= 3 THEN 'ranked' ELSE 'verbatim_fallback' END, role FROM n WHERE NOT bare
UNION ALL SELECT id, 'SECTION', 0, 16, NULL, NULL, 'NEUTRAL', 'verbatim_fallback', NULL FROM n WHERE bare"""


@query(_FACTS)
def order_facts_derived(spark, sf_dir):  # noqa: ANN001, ANN201
    """SET1 and what it is made of: keyword events, important lines, uncovered dates with their lines, section fallbacks, links, polarity and roles."""
    units = settled(sg.sections(_filings(spark, sf_dir)))
    none = units.select(*fx.KEYS, F.lit("").alias("kind"), F.lit("").alias("raw"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("entity_id")).limit(0)
    rows = fx.derived(units, mt.mentions(units, fx.KEYS), none)
    return rows.select("doc_id", "type", "char_start", "char_end", "linked_date", "amount", "polarity", "confidence", "role")


# ---------------------------------------------------------------- captions from customers

_FIRST = "Asha Ravi Mohan Kiran Deepak Farah Gopal Harish".split()
_LAST = "Menon Kulkarni Bhatia Dsouza Eapen Fernandes Ghosh Iyer".split()

#: As _captions(): x is the one side, y the other.
_CAPTION = f"""
n AS (SELECT c_custkey AS id, {_FIRST!r}[c_custkey % 8 + 1] || ' ' || {_LAST!r}[c_custkey // 8 % 8 + 1] AS x, {_FIRST!r}[c_custkey // 3 % 8 + 1] || ' ' || {_LAST!r}[c_custkey // 5 % 8 + 1] || ' Mills' AS y, CASE WHEN c_custkey % 34 = 3 THEN 'none' WHEN c_custkey % 34 = 20 THEN 'scan' WHEN c_custkey % 17 = 5 THEN 'motion' ELSE ['suit', 'between', 'recital', 'deponent', 'letter', 'inline'][c_custkey % 6 + 1] END AS form FROM customer)"""


def _captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, form, text: a customer's document in one of six forms, or with nothing of a caption."""
    k = F.col("c_custkey")
    pick = lambda words, at: F.element_at(F.array(*[F.lit(w) for w in words]), (at % 8 + 1).cast("int"))
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(k.alias("id"), F.concat_ws(" ", pick(_FIRST, k), pick(_LAST, F.floor(k / 8))).alias("x"), F.concat_ws(" ", pick(_FIRST, F.floor(k / 3)), pick(_LAST, F.floor(k / 5)), F.lit("Mills")).alias("y"))
    say = lambda *parts: F.concat(*[F.col(p) if p in ("x", "y") else F.lit(p) for p in parts])
    forms = {
        "suit": say("IN THE HIGH COURT OF DELHI\nC.S. No. 442 of 2024\n\n", "x", "\n…Plaintiff\n\nVERSUS\n\n", "y", "\n…Defendant\n\nThe plaintiff has paid the sum.\n"),
        "between": say("BEFORE THE TRIBUNAL AT CHENNAI\nO.A. No. 12 of 2021\n\nBETWEEN:\n\n", "x", "\n.....Applicant\n\nAND\n\n", "y", "\n.....Respondent\n\nORDER\n"),
        "recital": say("THIS AGREEMENT IS MADE on the first day of June\nBETWEEN\n", "x", ' (hereinafter called the Seller)\nAND\n', "y", ' (hereinafter called the Buyer)\nWHEREAS goods are sold;\nNOW THEREFORE it is agreed.\n'),
        "deponent": say("AFFIDAVIT\nI, ", "x", ", s/o Ram Menon, do hereby solemnly affirm and state as under.\nVERIFICATION\nDEPONENT\n"),
        "letter": say("LEGAL NOTICE\nUnder instructions from my client ", "x", ", I write to you.\nTo,\n", "y", "\nwithin 15 days\n"),
        "motion": say("IN THE SUPREME COURT OF INDIA\nCOURT ON ITS OWN MOTION IN RE: SAFETY OF WORKERS\n\nVERSUS\n\n", "y", "\n…Respondent\n"),
        "scan": say("1N THE H1GH C0URT\n5ome words\n"),
        "inline": say("The dispute titled “", "x", " versus ", "y", "” is heard today.\n"),
    }
    odd = F.when(F.col("id") % 34 == 3, "none").when(F.col("id") % 34 == 20, "scan").when(F.col("id") % 17 == 5, "motion")
    form = odd.otherwise(F.element_at(F.array(*[F.lit(f) for f in forms if f not in ("scan", "motion")]), (F.col("id") % 6 + 1).cast("int")))
    text = F.lit("Nothing of note.")
    for name, words in forms.items():
        text = F.when(F.col("form") == name, words).otherwise(text)
    return rows.withColumn("form", form).select(F.col("id").alias("doc_id"), "form", text.alias("text"))


_TIERS = "CASE form WHEN 'motion' THEN 'tier0_narrative' WHEN 'scan' THEN 'tier4b_title_block' WHEN 'suit' THEN 'tier1_cause_title' WHEN 'between' THEN 'tier1_cause_title' WHEN 'recital' THEN 'tier1_recital' WHEN 'deponent' THEN 'tier1_deponent' WHEN 'letter' THEN 'tier1_letterhead' WHEN 'inline' THEN 'tier4_inline' ELSE 'tier5_none' END"
_PROFILES = "CASE form WHEN 'motion' THEN 'court_filing' WHEN 'suit' THEN 'court_filing' WHEN 'between' THEN 'court_filing' WHEN 'recital' THEN 'contract' WHEN 'deponent' THEN 'affidavit' WHEN 'letter' THEN 'legal_notice' ELSE 'generic' END"


@query(f"WITH {_CAPTION} SELECT id AS doc_id, 'DEGRADED_' || {_TIERS} AS tier, CASE form WHEN 'inline' THEN 'low' WHEN 'none' THEN 'none' WHEN 'scan' THEN 'block' ELSE 'high' END AS confidence, {_PROFILES} AS profile, CASE form WHEN 'none' THEN 0 WHEN 'scan' THEN 0 WHEN 'deponent' THEN 1 ELSE 2 END::INTEGER AS n_parties FROM n")
def customer_tiers(spark, sf_dir):  # noqa: ANN001, ANN201
    """PTY0, PTY2 to PTY9, AGG12, MEN12, MEN13."""
    return pt.party_results(_captions(spark, sf_dir)).select("doc_id", "tier", "confidence", "profile", F.size("parties").alias("n_parties"))


@query(f"""WITH {_CAPTION} SELECT id AS doc_id, CASE form WHEN 'motion' THEN 'COURT ON ITS OWN MOTION IN RE: SAFETY OF WORKERS' ELSE x END AS name, CASE form WHEN 'motion' THEN 'Petitioner' WHEN 'suit' THEN 'Plaintiff' WHEN 'between' THEN 'Applicant' WHEN 'recital' THEN 'Seller' WHEN 'deponent' THEN 'Deponent' WHEN 'letter' THEN 'Sender' ELSE 'Party A' END AS role, CASE form WHEN 'inline' THEN 'positional' WHEN 'motion' THEN 'narrative' ELSE 'explicit' END AS role_confidence, 'A' AS side FROM n WHERE form NOT IN ('none', 'scan')
UNION ALL SELECT id, y, CASE form WHEN 'motion' THEN 'Respondent' WHEN 'suit' THEN 'Defendant' WHEN 'between' THEN 'Respondent' WHEN 'recital' THEN 'Buyer' WHEN 'letter' THEN 'Recipient' ELSE 'Party B' END, CASE form WHEN 'inline' THEN 'positional' ELSE 'explicit' END, 'B' FROM n WHERE form NOT IN ('none', 'scan', 'deponent')""")
def customer_parties(spark, sf_dir):  # noqa: ANN001, ANN201
    """PTY2 to PTY9, FN20, FLT5 to FLT7, JN9."""
    found = pt.parties(pt.party_results(_captions(spark, sf_dir)))
    return found.select("doc_id", "name", "role", "role_confidence", "side")


@query(f"""WITH {_CAPTION} SELECT id AS doc_id, 'PARTIES' AS type, 1 AS page, '1N THE H1GH C0URT' || chr(10) || '5ome words' || chr(10) AS text FROM n WHERE form = 'scan'""")
def customer_fallbacks(spark, sf_dir):  # noqa: ANN001, ANN201
    """EVT13: documents whose parties aren't sure."""
    return pt.fallback_facts(pt.party_results(_captions(spark, sf_dir))).select("doc_id", "type", "page", "text")


_LETTERS = f"""l AS (SELECT *, 'then ' || x || ' wrote to ' || y || CASE WHEN id % 3 = 0 THEN ' at the High Court' ELSE '' END || CASE WHEN id % 4 = 0 THEN ', see AIR 1999 SC 5.' ELSE '.' END AS text FROM n)"""


@query(f"""WITH {_CAPTION}, {_LETTERS} SELECT id AS doc_id, 'PERSON' AS kind, x AS raw, 5 AS start, (5 + length(x))::INTEGER AS "end", 'PERSON:' || lower(x) AS entity_id FROM l UNION ALL SELECT id, 'PERSON', y, (15 + length(x))::INTEGER, (15 + length(x || y))::INTEGER, 'PERSON:' || lower(y) FROM l""")
def customer_names(spark, sf_dir):  # noqa: ANN001, ANN201
    """MEN8, MEN10, FLT1 to FLT3, FN1: names by shape, generic ones left out."""
    k = F.col("c_custkey")
    pick = lambda words, at: F.element_at(F.array(*[F.lit(w) for w in words]), (at % 8 + 1).cast("int"))
    text = F.concat(F.lit("then "), pick(_FIRST, k), F.lit(" "), pick(_LAST, F.floor(k / 8)), F.lit(" wrote to "), pick(_FIRST, F.floor(k / 3)), F.lit(" "), pick(_LAST, F.floor(k / 5)), F.lit(" Mills"), F.when(k % 3 == 0, " at the High Court").otherwise(""), F.when(k % 4 == 0, ", see AIR 1999 SC 5.").otherwise("."))
    return mt.names(table(spark, sf_dir, "customer").select(k.alias("doc_id"), text.alias("text")), ["doc_id"])


# ---------------------------------------------------------------- paragraphs, pages and contents

_BLOCKS = "b AS (SELECT o_orderkey AS id, i, 'Block ' || i || ' of order ' || o_orderkey || ' opens here.' AS s1, CASE WHEN (o_orderkey + i) % 2 = 0 THEN ' The buyer of Rs. ' || (o_orderkey % 900 + 100) || ' goods waits.' ELSE '' END AS s2 FROM (SELECT o_orderkey, unnest(range(1, o_orderkey % 4 + 2)) AS i FROM orders)), p AS (SELECT *, (sum(length(s1 || s2) + 2) OVER (PARTITION BY id ORDER BY i) - length(s1 || s2) - 2)::INTEGER AS pos FROM b)"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    block = lambda i: F.concat(F.lit("Block "), i.cast("string"), F.lit(" of order "), k.cast("string"), F.lit(" opens here."), F.when((k + i) % 2 == 0, F.concat(F.lit(" The buyer of Rs. "), (k % 900 + 100).cast("string"), F.lit(" goods waits."))).otherwise(""))
    return table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), k % 4 + 1), block), "\n\n").alias("text"))


@query(f"WITH {_BLOCKS} SELECT id AS doc_id, (i - 1)::INTEGER AS para_no, pos AS char_start, (pos + length(s1 || s2))::INTEGER AS char_end, s1 || s2 AS paragraph FROM p")
def order_paragraphs(spark, sf_dir):  # noqa: ANN001, ANN201
    """SEG9, WIN4."""
    return sg.paragraphs(_blocks(spark, sf_dir), ["doc_id"])


@query(f"""WITH {_BLOCKS} SELECT id AS doc_id, (i - 1)::INTEGER AS para_no, 0 AS sent_no, 0 AS start, length(s1)::INTEGER AS "end", s1 AS sentence FROM p UNION ALL SELECT id, (i - 1)::INTEGER, 1, (length(s1) + 1)::INTEGER, length(s1 || s2)::INTEGER, trim(s2) FROM p WHERE s2 <> ''""")
def order_sentences(spark, sf_dir):  # noqa: ANN001, ANN201
    """SEG10: an amount's abbreviation ends no sentence."""
    return sg.sentences(sg.paragraphs(_blocks(spark, sf_dir), ["doc_id"]), ["doc_id", "para_no"])


@query("""WITH d AS (SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL), o AS (SELECT doc_id, n, unnest(range(0, n + 200, 777)) AS pos FROM d) SELECT doc_id, pos::INTEGER AS "offset", least(pos // 1000, greatest((n - 1) // 1000, 0))::INTEGER + 1 AS page FROM o""")
def document_offset_pages(spark, sf_dir):  # noqa: ANN001, ANN201
    """SEG8, JN3: pages of 1,000 letters; offsets beyond the text go to the last one."""
    n = F.length("text")
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(1000))
    pages = F.transform(starts, lambda s, i: F.named_struct(F.lit("start"), s, F.lit("end"), F.least(s + 1000, n), F.lit("page"), i + 1))
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", pages.alias("p"), F.explode(F.sequence(F.lit(0), n + 199, F.lit(777))).alias("offset"))
    return rows.select("doc_id", "offset", sg.page_at(F.col("offset"), F.col("p")).cast("int").alias("page"))


_CONTENTS = "c AS (SELECT p_brand AS doc_id, p_size AS page_number, count(*) FILTER (p_partkey % 3 < 2) AS toc_lines FROM part GROUP BY ALL)"


@query(f"WITH {_CONTENTS} SELECT doc_id, page_number, toc_lines FROM c WHERE toc_lines >= 3")
def part_contents(spark, sf_dir):  # noqa: ANN001, ANN201
    """SEG2: pages of parts with dotted or spaced page numbers, or neither."""
    k = F.col("p_partkey")
    line = F.when(k % 3 == 0, F.concat("p_name", F.lit(" ........ "), (k % 90 + 1).cast("string"))).when(k % 3 == 1, F.concat(F.lit("3. "), "p_name", F.lit("   "), (k % 90 + 1).cast("string"))).otherwise(F.col("p_name"))
    pages = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("doc_id"), F.col("p_size").alias("page_number")).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text"))
    return sg.toc_pages(pages)


# ---------------------------------------------------------------- likeness of names

_LCS = "bit_count(list_reduce(list_prepend((1::BIGINT << {n}) - 1, list_transform(string_split({b}, ''), lambda c: list_sum(list_transform(range({n}), lambda i: CASE WHEN {a}[i + 1] = c THEN 1::BIGINT << i ELSE 0 END))::BIGINT)), lambda r, m: ((r + (r & m)) | (r - (r & m))) & ((1::BIGINT << {n}) - 1)))"


def _ratio(a: str, b: str) -> str:
    """SQL of 200 * longest common subsequence / lengths, of texts of 1 to 62 letters."""
    lcs = _LCS.format(a=a, b=b, n=f"length({a})")
    return f"200.0 * (length({a}) - {lcs}) / (length({a}) + length({b}))"


_WORD_SETS = """w AS MATERIALIZED (SELECT a, b, x, y, array_to_string(list_sort(list_intersect(x, y)), ' ') AS base, trim(array_to_string(list_concat(list_sort(list_intersect(x, y)), list_sort(list_filter(x, lambda v: NOT list_contains(y, v)))), ' ')) AS l,
trim(array_to_string(list_concat(list_sort(list_intersect(x, y)), list_sort(list_filter(y, lambda v: NOT list_contains(x, v)))), ' ')) AS r FROM (SELECT *, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y FROM pairs))"""
_SET_RATIO = f"CASE WHEN base <> '' AND (l = base OR r = base) THEN 100.0 ELSE greatest({_ratio('l', 'r')}, CASE WHEN base <> '' THEN greatest({_ratio('base', 'l')}, {_ratio('base', 'r')}) ELSE 0.0 END) END"


@query(f"""WITH pairs AS (SELECT DISTINCT x.p_name AS a, y.p_name AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1), {_WORD_SETS}
SELECT a, b, round({_ratio('a', 'b')}, 6) AS plain, round({_ratio("array_to_string(list_sort(string_split(a, ' ')), ' ')", "array_to_string(list_sort(string_split(b, ' ')), ' ')")}, 6) AS sorted, round({_SET_RATIO}, 6) AS shared FROM w""")
def part_ratios(spark, sf_dir):  # noqa: ANN001, ANN201
    """FN3: the names of parts and of the parts after them."""
    p = table(spark, sf_dir, "part")
    pairs = p.select("p_partkey", F.col("p_name").alias("a")).join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b")), "p_partkey").select("a", "b").distinct()
    kinds = {"plain": fz.ratio, "sorted": fz.token_sort_ratio, "shared": fz.token_set_ratio}
    return pairs.select("a", "b", *[F.round(fz.similarity(f, F.col("a"), F.col("b")), 6).alias(c) for c, f in kinds.items()])


_ACTS = """i AS (SELECT n || ' act' AS b, upper(n) || ' ACT, ' || (1900 + length(n)) AS title, 1900 + length(n) AS y, 'id ' || n AS id FROM (SELECT DISTINCT p_name AS n FROM part)),
q AS (SELECT DISTINCT 'the ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN 's act' ELSE ' act' END AS a, 1900 + length(p_name) + p_partkey % 3 AS y FROM part), pairs AS (SELECT DISTINCT a, b FROM q, i)"""


@query(f"""WITH {_ACTS}, {_WORD_SETS}, s AS MATERIALIZED (SELECT a, b, {_SET_RATIO} AS score FROM w), m AS (SELECT q.a || ', ' || q.y AS act, id, title, score, row_number() OVER (PARTITION BY q.a, q.y ORDER BY q.y <> i.y, score DESC, length(title), id) AS k FROM q JOIN s USING (a) JOIN i USING (b) WHERE score >= 90)
SELECT act, id, title AS short_title, round(score, 6) AS score FROM m WHERE k = 1""")
def part_acts(spark, sf_dir):  # noqa: ANN001, ANN201
    """JN13: acts named after parts, in an index of such, by a token-set join."""
    n, k = F.col("p_name"), F.col("p_partkey")
    parts = table(spark, sf_dir, "part")
    index = parts.select("p_name").distinct().select(F.concat(F.lit("id "), n).alias("id"), F.concat(F.upper(n), F.lit(" ACT, "), (F.length(n) + 1900).cast("string")).alias("short_title"), (F.length(n) + 1900).alias("act_year"))
    acts = parts.select(F.concat(F.lit("the "), n, F.when(k % 2 == 0, "s act, ").otherwise(" act, "), (F.length(n) + 1900 + k % 3).cast("string")).alias("act"))
    return sy.looked_up_acts(acts, index).withColumn("score", F.round("score", 6))


# ---------------------------------------------------------------- texts inside texts


@query(r"""WITH l AS (SELECT doc_id, string_split(text, chr(10))[1] AS line FROM documents), h AS MATERIALIZED (SELECT DISTINCT text FROM documents WHERE text <> ''), n AS MATERIALIZED (SELECT DISTINCT line FROM l WHERE line <> ''),
c AS (SELECT line, count(*) AS n_inside FROM n JOIN h ON contains(text, line) AND text <> line GROUP BY 1) SELECT doc_id, coalesce(n_inside, 0) AS n_inside FROM l LEFT JOIN c USING (line)""")
def document_openings_inside(spark, sf_dir):  # noqa: ANN001, ANN201
    """JN17: in how many other texts the first line of each document stands."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = docs.select("doc_id", F.split("text", "\n")[0].alias("text"))
    return ct.containers(lines, docs).select("doc_id", "n_inside")


@query("""WITH h AS MATERIALIZED (SELECT DISTINCT text FROM documents WHERE text <> '') SELECT count(*) AS n, count_if(EXISTS (SELECT 1 FROM h WHERE contains(h.text, b.text)))::BIGINT AS n_covered FROM benchmark b WHERE text <> ''""")
def benchmark_coverage(spark, sf_dir):  # noqa: ANN001, ANN201
    """AGG19, JN17: how many benchmark items stand in a document word for word."""
    return ct.coverage_of_texts(table(spark, sf_dir, "benchmark").select("text"), table(spark, sf_dir, "documents").select("text"), [])


# ---------------------------------------------------------------- learned abbreviations

_LEARNED = r"""t AS MATERIALIZED (SELECT regexp_replace(regexp_replace(w, '^["''(\[“‘]+', ''), '["'')\],;:”’]+$', '') AS w FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents)),
c AS MATERIALIZED (SELECT CASE WHEN regexp_matches(b, '^[0-9][0-9.,]*$') THEN '#' ELSE b END AS type, count_if(stop)::BIGINT AS n_stop, count_if(NOT stop)::BIGINT AS n_plain FROM (SELECT regexp_replace(lower(w), '\.$', '') AS b, w LIKE '%.' AS stop FROM t WHERE w <> '') WHERE b <> '' GROUP BY 1),
r AS (SELECT sum(n_stop) / sum(n_stop + n_plain) AS p FROM c),
s AS (SELECT type, n_stop, n_plain, length(replace(type, '.', '')) AS n, 2 * (n_stop * ln(0.99 / p) + n_plain * ln((1 - 0.99) / (1 - p))) AS ratio FROM c, r WHERE n_stop > 0),
a AS (SELECT type, n_stop, n_plain, ratio * exp(-n) * (length(type) - n + 1) * pow(greatest(n, 1), -n_plain) AS score FROM s)"""


@query(f"WITH {_LEARNED} SELECT type, n_stop, n_plain, round(score, 4) AS score, score >= 0.3 AND regexp_matches(type, '\\p{{L}}') AS abbreviated FROM a")
def document_abbreviations(spark, sf_dir):  # noqa: ANN001, ANN201
    """SEG10: what the collection says of its words with stops."""
    return sp.abbreviations(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 4))


@query()
def document_learned_sentences(spark, sf_dir):  # noqa: ANN001, ANN201
    """SEG10: whole documents by their own abbreviations and openers; the splitter is tested against brute force."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = sp.abbreviations(docs)
    return sp.split(docs, ["doc_id"], found, sp.openers(docs, found))
