"""Queries of views, previews, sources and sinks over the driver tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.functions import text as tx
from folioweave.functions.spans import exploded
from folioweave.operators import segment as sg
from folioweave.operators import summary as sm
from folioweave.operators import symbols as sy
from folioweave.operators import views as vw
from folioweave.plans.adapters import table
from folioweave.sources import sinks

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


# ---------------------------------------------------------------- documents


@query("WITH d AS (SELECT doc_id, text, unnest(range(0, greatest(1, (length(text) + 999) // 1000))) AS i FROM documents WHERE text IS NOT NULL) SELECT doc_id, i::INTEGER AS chunk_no, (i * 1000)::INTEGER AS start, md5(substr(text, i * 1000 + 1, 1000)) AS chunk FROM d")
def document_chunks(spark, sf_dir):  # noqa: ANN001, ANN201
    """SEG11."""
    rows = sg.chunks(table(spark, sf_dir, "documents"), ["doc_id"], 1000)
    return rows.withColumn("chunk", F.md5("chunk"))


@query(r"""WITH h AS (SELECT doc_id, text, left(text, 300) AS head FROM documents), p AS (SELECT *, regexp_extract(head, '(?s)^(.*[.!?])\s', 1) AS sentence, regexp_extract(head, '(?s)^(.*)\s', 1) AS word FROM h)
SELECT doc_id, CASE WHEN length(text) <= 300 THEN text WHEN length(sentence) > 105 THEN sentence WHEN word <> '' THEN word || '…' ELSE head || '…' END AS preview FROM p""")
def document_previews(spark, sf_dir):  # noqa: ANN001, ANN201
    """PRJ4."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.preview(F.col("text"), 300).alias("preview"))


_NUMBERS = """n AS (SELECT doc_id, split_part(p, chr(2), 1) AS raw, pos::INTEGER AS start, (pos + length(split_part(p, chr(2), 1)))::INTEGER AS stop FROM (
SELECT doc_id, p, i, sum(length(p) - CASE WHEN i > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - length(p) + CASE WHEN i > 1 THEN 1 ELSE 0 END AS pos FROM (
SELECT doc_id, unnest(string_split(m, chr(1))) AS p, generate_subscripts(string_split(m, chr(1)), 1) AS i FROM (SELECT doc_id, regexp_replace(text, '[0-9]+', chr(1) || '\\0' || chr(2), 'g') AS m FROM documents))) WHERE i > 1)"""


@query(f"""WITH {_NUMBERS}, c AS (SELECT doc_id, raw, start, substr(text, greatest(start - 450, 0) + 1, least(stop + 450, length(text)) - greatest(start - 450, 0)) AS context, start - greatest(start - 450, 0) AS inside FROM n JOIN documents USING (doc_id))
SELECT doc_id, start, md5(left(context, inside) || '<mark>' || raw || '</mark>' || substr(context, inside + length(raw) + 1)) AS card FROM c""")
def document_evidence(spark, sf_dir):  # noqa: ANN001, ANN201
    """V8, PRJ2, PRJ7, FN17: a card for every number of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = exploded(docs, "[0-9]+", "NUMBER", ["doc_id"]).join(docs, "doc_id")
    facts = found.select("doc_id", F.col("start").alias("fact_id"), F.lit("NUMBER").alias("type"), F.lit(1).alias("page"), F.col("start").alias("char_start"), F.col("end").alias("char_end"), F.col("raw").alias("text"), tx.context(F.col("text"), F.col("start"), F.col("end")).alias("context"))
    return vw.evidence(facts).select("doc_id", F.col("fact_id").alias("start"), F.md5("card").alias("card"))


@query(r"SELECT page_id, replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]+$', ''), '_', ' ') AS short FROM pages")
def page_short_names(spark, sf_dir):  # noqa: ANN001, ANN201
    """FN19."""
    return table(spark, sf_dir, "pages").select("page_id", tx.short_name(F.regexp_extract("url", "([^/]*)$", 1)).alias("short"))


# ---------------------------------------------------------------- conversations

_LONG_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: length(w) > 3))"


@query(f"WITH w AS (SELECT conv_id, turn, {_LONG_WORDS} AS w FROM conversations) SELECT a.conv_id, a.turn, CASE WHEN least(len(a.w), len(b.w)) > 0 THEN round(len(list_intersect(a.w, b.w))::DOUBLE / least(len(a.w), len(b.w)), 6) ELSE 0.0::DOUBLE END AS overlap FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def conversation_overlaps(spark, sf_dir):  # noqa: ANN001, ANN201
    """FN16: each turn with the next."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(tx.overlap(F.col("text"), F.col("other")), 6).alias("overlap"))


def _turns(spark, sf_dir):  # noqa: ANN001, ANN202
    """Turns as dated facts, a conversation a case: two days to four turns."""
    c = table(spark, sf_dir, "conversations")
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.expr("cast(turn div 2 as int)"))
    return c.select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("fact_id"), "turn", "text", day.alias("date"), F.col("role").alias("type"), F.lit(None).cast("string").alias("section_label"))


def _greedy(name: str, rows: str, keys: str, order: str, least: float) -> str:
    """SQL that goes through `rows` (conv_id, turn, day, w, n) of each group in order: `name` has those that stay."""
    again = f"coalesce(list_bool_or(list_transform(kept, lambda k: least(len(k), len(w)) > 0 AND len(list_intersect(k, w))::DOUBLE / greatest(1, least(len(k), len(w))) > {least})), false)"
    return f"""{name}_o AS (SELECT *, concat_ws('|', {keys}) AS g, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS i FROM {rows}),
{name}_r AS (SELECT g, 0::BIGINT AS i, []::VARCHAR[][] AS kept, false AS gone FROM {name}_o WHERE i = 1
  UNION ALL SELECT o.g, o.i, CASE WHEN {again} THEN kept ELSE list_append(kept, w) END, {again} FROM {name}_r r JOIN {name}_o o ON o.g = r.g AND o.i = r.i + 1),
{name} AS (SELECT o.* EXCLUDE (g, i) FROM {name}_o o JOIN {name}_r r USING (g, i) WHERE NOT gone)"""


_WORDS_OF_TURNS = f"w AS (SELECT conv_id, turn, turn // 2 AS day, {_LONG_WORDS} AS w, length(text) AS n FROM conversations)"


@query(f"WITH RECURSIVE {_WORDS_OF_TURNS}, {_greedy('a', 'w', 'conv_id', 'turn', 0.3)} SELECT conv_id, turn FROM a")
def conversation_unrepeated(spark, sf_dir):  # noqa: ANN001, ANN201
    """SET6, first pass, by greedy selection in rounds; a lower limit than the default, as turns seldom repeat."""
    return vw.unrepeated(_turns(spark, sf_dir), "conv_id", 0.3).select("conv_id", "turn")


@query(f"WITH RECURSIVE {_WORDS_OF_TURNS}, {_greedy('a', 'w', 'conv_id', 'turn', 0.4)}, {_greedy('b', 'a', 'conv_id, day', 'n DESC, turn', 0.2)} SELECT conv_id, turn, DATE '2020-01-01' + day::INTEGER AS date FROM b")
def conversation_timeline(spark, sf_dir):  # noqa: ANN001, ANN201
    """V2, SET6: both passes; lower limits than the defaults, as turns seldom repeat."""
    return vw.timeline(_turns(spark, sf_dir), "conv_id", 0.4, 0.2).select("conv_id", "turn", "date")


#: Turns of all conversations that open alike are one case, so groups are large.
@query(f"WITH RECURSIVE {_WORDS_OF_TURNS}, c AS (SELECT conv_id, turn, turn AS day, w, n FROM w), {_greedy('a', 'c', 'day', 'conv_id, turn', 0.45)} SELECT conv_id, turn FROM a")
def turn_unrepeated(spark, sf_dir):  # noqa: ANN001, ANN201
    """SET6 over large groups: turns of one number, without those that share over 0.45 of their words with an earlier one that stays."""
    return vw.unrepeated(_turns(spark, sf_dir).withColumn("case", F.col("turn")), "case", 0.45).select("conv_id", "turn")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn // 2 ORDER BY length(text) DESC, turn)::INTEGER AS rank FROM conversations")
def conversation_longest(spark, sf_dir):  # noqa: ANN001, ANN201
    """SRT3."""
    return vw.longest_first(_turns(spark, sf_dir), ["conv_id", "date"]).select("conv_id", "turn", "rank")


# ---------------------------------------------------------------- orders, customers, parts, events


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey)::INTEGER AS position FROM orders")
def orders_in_order(spark, sf_dir):  # noqa: ANN001, ANN201
    """SRT1."""
    facts = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("fact_id"), F.to_date("o_orderdate").alias("date"))
    return vw.in_order(facts, "o_custkey").select("o_custkey", "o_orderkey", "position")


@query("WITH c AS (SELECT c_custkey, c_nationkey, c_acctbal > 0 AS kept, count_if(c_acctbal <= 0) OVER (PARTITION BY c_nationkey) AS n FROM customer) SELECT c_custkey, kept FROM c WHERE kept OR n <= 3")
def customer_parties_shown(spark, sf_dir):  # noqa: ANN001, ANN201
    """V5."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("doc_id"), (F.col("c_acctbal") > 0).alias("kept"))
    return vw.parties_shown(rows).select("c_custkey", "kept")


@query("SELECT l_orderkey AS doc_id, l_linestatus AS raw, l_returnflag AS act, max(l_linenumber) AS ord FROM lineitem GROUP BY ALL")
def lineitem_last_wording(spark, sf_dir):  # noqa: ANN001, ANN201
    """SET5."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linestatus").alias("raw"), F.col("l_returnflag").alias("act"), F.col("l_linenumber").alias("ord"))
    return vw.distinct_provisions(rows)


@query("""WITH r AS (SELECT c_custkey AS doc_id, 1 AS part, 1::BIGINT AS place, 'Customer: ' || c_name AS line FROM customer
UNION ALL SELECT doc_id, 2, ord, raw || ' of ' || act FROM (SELECT o_custkey AS doc_id, o_orderpriority AS raw, o_orderstatus AS act, max(o_orderkey) AS ord FROM orders GROUP BY ALL)
UNION ALL SELECT o_custkey, 3, date_diff('day', DATE '1970-01-01', o_orderdate::DATE), o_orderdate::DATE || ' <' || o_orderkey || '>' FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT o_custkey, 4, o_orderkey, '<' || o_orderkey || '>' FROM orders WHERE o_orderstatus = 'P')
SELECT doc_id, part, row_number() OVER (PARTITION BY doc_id, part ORDER BY place, line)::INTEGER AS position, '<li>' || replace(replace(line, '<', '&lt;'), '>', '&gt;') || '</li>' AS html FROM r""")
def customer_report(spark, sf_dir):  # noqa: ANN001, ANN201
    """V7, SNK6: customers as documents, orders as facts and citations."""
    o = table(spark, sf_dir, "orders")
    shown = F.concat(F.lit("<"), F.col("o_orderkey").cast("string"), F.lit(">"))
    facts = o.select(F.col("o_custkey").alias("doc_id"), F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate")).alias("date"), shown.alias("text"), F.col("o_orderkey").alias("char_start"))
    cited = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("raw"), F.col("o_orderstatus").alias("act"), F.col("o_orderkey").alias("ord"))
    parties = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("ordinal"), F.lit("Customer").alias("role"), F.col("c_name").alias("name"))
    return sinks.html_lines(vw.report_lines(facts, parties, cited))


@query("SELECT 'PART:' || p_name AS key, p_brand AS document_id, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey, p_brand)::INTEGER AS ref_no, p_partkey AS ord FROM part")
def part_references(spark, sf_dir):  # noqa: ANN001, ANN201
    """AGG9."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.lit("PART").alias("kind"), F.col("p_name").alias("raw"), F.col("p_partkey").alias("ord"))
    return sy.references(sy.sites(p)).select("key", "document_id", "ref_no", "ord")


@query("SELECT event_id AS edge_id, CASE WHEN event_type = 'purchase' THEN value * 2 ELSE value END AS score, ts::DATE AS recorded_at FROM events")
def events_upserted(spark, sf_dir):  # noqa: ANN001, ANN201
    """SNK3: purchases recorded again."""
    old = table(spark, sf_dir, "events").select(F.col("event_id").alias("edge_id"), F.col("value").alias("score"), F.to_date("ts").alias("recorded_at"), "event_type")
    new = old.where("event_type = 'purchase'").withColumn("score", F.col("score") * 2)
    return sinks.upserted(old.drop("event_type"), new.drop("event_type"))


@query("SELECT event_id, upper(left(event_type, 1)) || substr(event_type, 2) AS shown FROM events")
def events_friendly(spark, sf_dir):  # noqa: ANN001, ANN201
    """PRJ5."""
    return table(spark, sf_dir, "events").select("event_id", sm.friendly(F.col("event_type")).alias("shown"))


@query(r"""WITH a AS (SELECT p_partkey, p_type AS act, p_brand AS raw FROM part), s AS (SELECT p_type AS act, min(p_size) AS n FROM part GROUP BY 1) SELECT p_partkey, n::VARCHAR AS statute_lookup FROM a JOIN s USING (act)""")
def part_statutes(spark, sf_dir):  # noqa: ANN001, ANN201
    """SRC13 as a join: a part's type as the act, section 1."""
    p = table(spark, sf_dir, "part")
    statutes = p.groupBy(F.col("p_type").alias("act")).agg(F.min("p_size").cast("string").alias("text")).withColumn("section", F.lit("1"))
    cited = p.select("p_partkey", F.col("p_type").alias("act"), F.lit("Section 1").alias("section"))
    return sm.with_statutes(cited, statutes).select("p_partkey", "statute_lookup")


@query("SELECT o_orderkey, n_name AS document FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def order_documents(spark, sf_dir):  # noqa: ANN001, ANN201
    """JN15: facts with what is known of their documents."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("doc_id"))
    meta = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("doc_id"), F.col("n_name").alias("document"))
    return vw.with_document(o, meta).where(F.col("document").isNotNull()).select("o_orderkey", "document")
