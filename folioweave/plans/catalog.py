"""All registered queries over the driver tables, with their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioweave.functions.spans import exploded
from folioweave.functions.text import html_escaped, label, normal_name, trimmed
from folioweave.operators import facts as fx
from folioweave.operators import graph as g
from folioweave.operators import parties as pt
from folioweave.operators import segment as sg
from folioweave.operators import summary as sm
from folioweave.operators import symbols as sy
from folioweave.operators import views as vw
from folioweave.plans import exchanged, given, reading
from folioweave.plans.adapters import event_facts, order_facts, page_units, table, vector_facts
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
    return _QUERIES | reading.queries() | given.queries() | exchanged.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | reading.oracle_sql() | given.oracle_sql() | exchanged.oracle_sql()


# ---------------------------------------------------------------- graph over orders

_FACTS = """
facts AS MATERIALIZED (SELECT o_orderkey AS fact_id, o_orderpriority AS doc_id, o_orderstatus AS type, 'cust::' || o_custkey AS ent, o_orderdate::DATE AS date,
  floor(o_totalprice)::BIGINT::VARCHAR AS amount, CASE o_orderstatus WHEN 'F' THEN 'ASSERTS' WHEN 'O' THEN 'DENIES' ELSE 'NEUTRAL' END AS polarity FROM orders),
posts AS MATERIALIZED (SELECT fact_id, ent AS key FROM facts UNION ALL SELECT fact_id, 'date::' || date FROM facts UNION ALL SELECT fact_id, 'amt::' || amount FROM facts UNION ALL SELECT fact_id, 'type::' || type FROM facts),
idf AS MATERIALIZED (SELECT key, count(*) AS df, ln(((SELECT count(*) FROM facts) + 1) / (count(*) + 1)) + 0.1 AS idf FROM posts GROUP BY key),
small AS MATERIALIZED (SELECT fact_id, key FROM posts JOIN idf USING (key) WHERE df <= 40),
cand AS MATERIALIZED (SELECT DISTINCT x.fact_id AS a, y.fact_id AS b FROM small x JOIN small y ON x.key = y.key AND x.fact_id < y.fact_id),
parts AS MATERIALIZED (SELECT a, b, x.polarity AS pa, y.polarity AS pb, x.doc_id <> y.doc_id AS cross_doc, x.ent = y.ent AS share_entity,
  CASE WHEN x.ent = y.ent THEN least(idf.idf / 2.0, 1.0) ELSE 0.0 END AS entity, greatest(0.0, 1 - abs(date_diff('day', x.date, y.date)) / 180) AS time,
  CASE WHEN x.doc_id = y.doc_id THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS same FROM cand JOIN facts x ON x.fact_id = a JOIN facts y ON y.fact_id = b LEFT JOIN idf ON idf.key = x.ent),
scored AS MATERIALIZED (SELECT *, 0.35 * entity + 0.20 * time + 0.35 * 0.0 + 0.10 * same AS score FROM parts),
good AS MATERIALIZED (SELECT * FROM scored WHERE score >= 0.35),
ends AS MATERIALIZED (SELECT a AS node, b AS other, score FROM good UNION ALL SELECT b, a, score FROM good),
kept AS MATERIALIZED (SELECT DISTINCT least(node, other) AS a, greatest(node, other) AS b FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, other) AS r FROM ends) WHERE r <= 5),
edges AS MATERIALIZED (SELECT a, b, score, CASE WHEN (pa = 'ASSERTS' AND pb = 'DENIES') OR (pa = 'DENIES' AND pb = 'ASSERTS') THEN 'POTENTIAL_CONFLICT' WHEN pa = 'ASSERTS' OR pb = 'ASSERTS' THEN 'SUPPORTS' ELSE 'RELATED_TO' END AS label,
  cross_doc, share_entity, entity, time, same FROM good JOIN kept USING (a, b))
"""


@query(f"WITH {_FACTS} SELECT key, df, round(idf, 6) AS idf FROM idf")
def graph_postings(spark, sf_dir):  # noqa: ANN001, ANN201
    facts = order_facts(spark, sf_dir)
    return g.idf(g.postings(facts), F.lit(facts.count())).select("key", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_FACTS} SELECT a, b FROM cand")
def graph_candidates(spark, sf_dir):  # noqa: ANN001, ANN201
    return g.candidates(g.postings(order_facts(spark, sf_dir)))


@query(f"WITH {_FACTS} SELECT a, b, round(score, 6) AS score, round(entity, 6) AS entity, round(time, 6) AS time, same FROM scored")
def graph_scores(spark, sf_dir):  # noqa: ANN001, ANN201
    facts = order_facts(spark, sf_dir)
    rows = g.scored(facts, F.lit(facts.count()))
    return rows.select("a", "b", F.round("score", 6).alias("score"), F.round("entity", 6).alias("entity"), F.round("time", 6).alias("time"), "same")


@query(f"WITH {_FACTS} SELECT a, b, round(score, 6) AS score, label, cross_doc FROM edges")
def graph_edges(spark, sf_dir):  # noqa: ANN001, ANN201
    return g.edges(order_facts(spark, sf_dir)).select("a", "b", F.round("score", 6).alias("score"), "label", "cross_doc")


@query(f"WITH {_FACTS} SELECT a, b, round(score, 6) AS score, label FROM edges WHERE share_entity")
def graph_gated_edges(spark, sf_dir):  # noqa: ANN001, ANN201
    return g.edges(order_facts(spark, sf_dir), gate=True).select("a", "b", F.round("score", 6).alias("score"), "label")


@query(f"WITH {_FACTS} SELECT e.a, e.b, round(e.score, 6) AS score, x.doc_id AS doc_id_a, x.type AS type_a, x.date AS date_a, x.polarity AS polarity_a, y.doc_id AS doc_id_b, y.type AS type_b, y.date AS date_b, y.polarity AS polarity_b FROM edges e JOIN facts x ON x.fact_id = e.a JOIN facts y ON y.fact_id = e.b WHERE label = 'POTENTIAL_CONFLICT'")
def graph_conflicts(spark, sf_dir):  # noqa: ANN001, ANN201
    facts = order_facts(spark, sf_dir)
    return vw.conflicts(g.edges(facts), facts).withColumn("score", F.round("score", 6))


@query(f"WITH {_FACTS} SELECT (SELECT count(*) FROM facts) AS n_facts, (SELECT count(*) * (count(*) - 1) // 2 FROM facts) AS naive_pairs, (SELECT count(*) FROM cand) AS candidate_pairs, count(*) AS n_edges, count_if(cross_doc)::BIGINT AS cross_doc, count_if(label = 'POTENTIAL_CONFLICT')::BIGINT AS conflicts, round(100 - 100.0 * (SELECT count(*) FROM cand) / (SELECT count(*) * (count(*) - 1) // 2 FROM facts), 4) AS reduction FROM edges")
def graph_report(spark, sf_dir):  # noqa: ANN001, ANN201
    facts = order_facts(spark, sf_dir)
    n = facts.agg(F.count(F.lit(1)).alias("n_facts")).withColumn("naive_pairs", F.expr("n_facts * (n_facts - 1) div 2"))
    c = g.candidates(g.postings(facts)).agg(F.count(F.lit(1)).alias("candidate_pairs"))
    e = g.edges(facts).agg(F.count(F.lit(1)).alias("n_edges"), F.count_if("cross_doc").alias("cross_doc"), F.count_if(F.col("label") == "POTENTIAL_CONFLICT").alias("conflicts"))
    one = F.lit(1).alias("k")  # one row each
    return n.select("*", one).join(c.select("*", one), "k").join(e.select("*", one), "k").drop("k").withColumn("reduction", F.round(100 - 100.0 * F.col("candidate_pairs") / F.col("naive_pairs"), 4))


@query(f"WITH {_FACTS} SELECT 'e_' || a || '_' || b AS id, 'evt_' || a AS source, 'evt_' || b AS target, label FROM edges")
def graph_export_edges(spark, sf_dir):  # noqa: ANN001, ANN201
    facts = order_facts(spark, sf_dir)
    return g.nodes_and_edges(facts, g.edges(facts))[1]


@query(f"WITH {_FACTS} SELECT 'evt_' || fact_id AS id, type, amount AS label FROM facts")
def graph_export_nodes(spark, sf_dir):  # noqa: ANN001, ANN201
    facts = order_facts(spark, sf_dir)
    return g.nodes_and_edges(facts, g.edges(facts))[0]


@query(f"WITH RECURSIVE {_FACTS}, l AS MATERIALIZED (SELECT a AS node, b AS other FROM edges WHERE share_entity UNION SELECT b, a FROM edges WHERE share_entity), reach AS (SELECT node, node AS root FROM l UNION SELECT reach.node, l.other FROM reach JOIN l ON l.node = reach.root) SELECT node, min(root) AS cluster FROM reach GROUP BY node")
def graph_clusters(spark, sf_dir):  # noqa: ANN001, ANN201
    """Components of the edges that share an entity."""
    return g.clusters(g.edges(order_facts(spark, sf_dir), gate=True))


_VECTOR_FACTS = """
facts AS MATERIALIZED (SELECT vec_id AS fact_id, label, 'block::' || (vec_id // 12) AS ent, DATE '2020-01-01' + (vec_id * 37 % 200)::INTEGER AS date, embedding::DOUBLE[] AS vec, vec_id % 3 AS p FROM embeddings),
posts AS MATERIALIZED (SELECT fact_id, ent AS key FROM facts UNION ALL SELECT fact_id, 'date::' || date FROM facts),
idf AS MATERIALIZED (SELECT key, count(*) AS df, ln(((SELECT count(*) FROM facts) + 1) / (count(*) + 1)) + 0.1 AS idf FROM posts GROUP BY key),
cand AS MATERIALIZED (SELECT DISTINCT x.fact_id AS a, y.fact_id AS b FROM posts x JOIN posts y USING (key) JOIN idf USING (key) WHERE df <= 40 AND x.fact_id < y.fact_id),
parts AS MATERIALIZED (SELECT a, b, x.p AS pa, y.p AS pb, CASE WHEN x.ent = y.ent THEN least(idf.idf / 2.0, 1.0) ELSE 0.0 END AS entity, greatest(0.0, 1 - abs(date_diff('day', x.date, y.date)) / 180) AS time, {text} AS text,
  CASE WHEN x.label = y.label THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS same FROM cand JOIN facts x ON x.fact_id = a JOIN facts y ON y.fact_id = b JOIN idf ON idf.key = x.ent),
good AS MATERIALIZED (SELECT *, 0.35 * entity + 0.20 * time + 0.35 * text + 0.10 * same AS score FROM parts WHERE 0.35 * entity + 0.20 * time + 0.35 * text + 0.10 * same >= 0.2),
kept AS (SELECT DISTINCT least(node, other) AS a, greatest(node, other) AS b FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, other) AS r FROM (SELECT a AS node, b AS other, score FROM good UNION ALL SELECT b, a, score FROM good)) WHERE r <= 2)
SELECT a, b, round(score, 6) AS score, round(text, 3) AS text, CASE WHEN (pa = 0 AND pb = 1) OR (pa = 1 AND pb = 0) THEN 'POTENTIAL_CONFLICT' WHEN pa = 0 OR pb = 0 THEN 'SUPPORTS' ELSE 'RELATED_TO' END AS label FROM good JOIN kept USING (a, b)
"""


@query("WITH " + _VECTOR_FACTS.format(text="list_inner_product(x.vec, y.vec)"))
def graph_vector_edges(spark, sf_dir):  # noqa: ANN001, ANN201
    """FN13, FN14, WIN1: facts with vectors, which are only compared for pairs that can be among an end's best."""
    return g.edges(vector_facts(spark, sf_dir), top_k=2, least=0.2).select("a", "b", F.round("score", 6).alias("score"), "text", "label")


@query("WITH " + _VECTOR_FACTS.format(text="CASE WHEN (x.vec[1] < 0) = (y.vec[1] < 0) THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END"))
def graph_similarity_edges(spark, sf_dir):  # noqa: ANN001, ANN201
    """UDF1: an injected similarity of two facts."""
    alike = lambda u, v: F.when((u["vec"][0] < 0) == (v["vec"][0] < 0), 1.0).otherwise(0.25)
    return g.edges(vector_facts(spark, sf_dir), top_k=2, least=0.2, similarity=alike).select("a", "b", F.round("score", 6).alias("score"), "text", "label")


# ---------------------------------------------------------------- events


_TEMPORAL = "t AS (SELECT event_id AS edge_id, user_id AS subject, CASE event_type WHEN 'purchase' THEN 'SUPPORTS' WHEN 'error' THEN 'POTENTIAL_CONFLICT' ELSE 'RELATED_TO' END AS edge_type, ts::DATE AS recorded_at FROM events)"


@query(f"WITH {_TEMPORAL}, c AS (SELECT *, edge_type <> 'RELATED_TO' AS hit FROM t), l AS (SELECT subject, count(*) AS n, max((recorded_at, edge_id)) AS last FROM c WHERE hit GROUP BY subject) SELECT edge_id, subject, edge_type, recorded_at, CASE WHEN hit AND n >= 2 AND edge_id <> last[2] THEN last[2] END AS invalidated_by, CASE WHEN hit AND n >= 2 AND edge_id <> last[2] THEN last[1] END AS invalidated_at FROM c LEFT JOIN l USING (subject)")
def events_superseded(spark, sf_dir):  # noqa: ANN001, ANN201
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "SUPPORTS").when(F.col("event_type") == "error", "POTENTIAL_CONFLICT").otherwise("RELATED_TO")
    t = e.select(F.col("event_id").alias("edge_id"), F.col("user_id").alias("subject"), kind.alias("edge_type"), F.to_date("ts").alias("recorded_at"))
    return g.superseded(t, ["subject"])


@query("SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, event_id // 400 ORDER BY event_id) AS r FROM events) WHERE r = 1")
def events_first_per_bucket(spark, sf_dir):  # noqa: ANN001, ANN201
    return fx.first_per_bucket(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), ["user_id", "event_type"], "event_id", 400)


@query("WITH f AS (SELECT * FROM events WHERE event_type = 'purchase'), d AS (SELECT * FROM events WHERE event_type = 'click'), m AS (SELECT f.event_id, min((abs(d.event_id - f.event_id), d.event_id, d.ts::DATE)) AS n FROM f JOIN d ON f.user_id = d.user_id AND f.event_id - 20 <= d.event_id AND d.event_id + 1 <= f.event_id + 120 GROUP BY 1) SELECT event_id AS fact_id, user_id AS doc_id, n[3] AS linked_date FROM f LEFT JOIN m USING (event_id)")
def events_nearest_date(spark, sf_dir):  # noqa: ANN001, ANN201
    e = table(spark, sf_dir, "events")
    f = e.where("event_type = 'purchase'").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("fact_id"), F.col("event_id").alias("char_start"), (F.col("event_id") + 100).alias("char_end"), F.lit(None).cast("date").alias("linked_date"))
    d = e.where("event_type = 'click'").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("start"), (F.col("event_id") + 1).alias("end"), F.to_date("ts").alias("date"))
    return fx.linked_dates(f, d, ["doc_id"]).select("fact_id", "doc_id", "linked_date")


@query("WITH f AS (SELECT user_id, event_id AS s, event_id + 60 AS e FROM events WHERE event_type = 'purchase'), d AS (SELECT user_id, event_id FROM events WHERE event_type = 'error') SELECT user_id AS doc_id, event_id AS start FROM d WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.user_id = d.user_id AND f.s <= d.event_id AND d.event_id + 5 <= f.e)")
def events_uncovered(spark, sf_dir):  # noqa: ANN001, ANN201
    e = table(spark, sf_dir, "events").withColumn("doc_id", F.col("user_id"))
    spans_ = e.where("event_type = 'purchase'").select("doc_id", F.col("event_id").alias("char_start"), (F.col("event_id") + 60).alias("char_end"))
    found = e.where("event_type = 'error'").select("doc_id", F.col("event_id").alias("start"), (F.col("event_id") + 5).alias("end"))
    return fx.uncovered(found, spans_, ["doc_id"], spread=True).select("doc_id", "start")


@query("SELECT user_id AS doc_id, count(DISTINCT user_id) AS n_documents, count(*) AS n_facts, count(ts) AS n_dated, min(ts::DATE) AS first_date, max(ts::DATE) AS last_date FROM events GROUP BY user_id")
def events_dashboard(spark, sf_dir):  # noqa: ANN001, ANN201
    facts = event_facts(spark, sf_dir).withColumn("case", F.col("doc_id"))
    return vw.dashboard(facts, "case").withColumnRenamed("case", "doc_id")


@query("SELECT event_id AS fact_id, user_id AS doc_id, event_type AS section_label, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts::DATE, event_id)::INTEGER AS position, count(*) OVER (PARTITION BY user_id, event_type) AS n_in_heading FROM events")
def events_tree(spark, sf_dir):  # noqa: ANN001, ANN201
    facts = event_facts(spark, sf_dir).withColumns({"section_label": F.col("type"), "page": F.col("date"), "paragraph_no": F.lit(None).cast("int"), "char_start": F.col("fact_id")})
    return vw.tree(facts).select("fact_id", "doc_id", "section_label", "position", "n_in_heading")


@query("SELECT user_id AS doc_id, count_if(event_type = 'view')::BIGINT AS n_view, count_if(event_type = 'click')::BIGINT AS n_click, count_if(event_type = 'purchase')::BIGINT AS n_purchase FROM events GROUP BY 1")
def events_kind_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    return sm.kind_counts(event_facts(spark, sf_dir), "doc_id", "type", ["view", "click", "purchase"])


@query("SELECT user_id AS doc_id, min(event_id) AS first, count(*) AS n FROM events GROUP BY user_id")
def events_groups_in_order(spark, sf_dir):  # noqa: ANN001, ANN201
    return sm.grouped_in_order(event_facts(spark, sf_dir), "doc_id", "fact_id")


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_roles FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def orders_unstable_roles(spark, sf_dir):  # noqa: ANN001, ANN201
    return sm.unstable_names(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus")


@query("WITH f AS (SELECT user_id, event_id AS s, event_id + 60 AS e FROM events WHERE event_type = 'purchase') SELECT user_id AS doc_id, count(*) AS n, count_if(EXISTS (SELECT 1 FROM f WHERE f.user_id = d.user_id AND f.s <= d.event_id AND d.event_id + 5 <= f.e))::BIGINT AS n_covered FROM events d WHERE event_type = 'error' GROUP BY 1")
def events_coverage(spark, sf_dir):  # noqa: ANN001, ANN201
    e = table(spark, sf_dir, "events").withColumn("doc_id", F.col("user_id"))
    spans_ = e.where("event_type = 'purchase'").select("doc_id", F.col("event_id").alias("char_start"), (F.col("event_id") + 60).alias("char_end"))
    found = e.where("event_type = 'error'").select("doc_id", F.col("event_id").alias("start"), (F.col("event_id") + 5).alias("end"))
    return sm.coverage(found, spans_, ["doc_id"], spread=True)


@query("WITH f AS (SELECT event_id AS fact_id, user_id AS doc_id, event_id AS s, event_id + 50 AS e FROM events WHERE event_type = 'purchase'), p AS (SELECT user_id, event_id AS s, event_id + 30 + (event_id % 7) * 60 AS e FROM events WHERE event_type = 'view'), m AS (SELECT fact_id, min((-(least(f.e, p.e) - greatest(f.s, p.s)), p.s, p.e)) AS b FROM f JOIN p ON p.user_id = f.doc_id AND least(f.e, p.e) > greatest(f.s, p.s) GROUP BY 1) SELECT fact_id, doc_id, CASE WHEN b[3] - b[2] <= 300 THEN b[2] ELSE s END AS char_start, CASE WHEN b[3] - b[2] <= 300 THEN b[3] ELSE e END AS char_end FROM f LEFT JOIN m USING (fact_id)")
def events_refined_bounds(spark, sf_dir):  # noqa: ANN001, ANN201
    e = table(spark, sf_dir, "events").withColumn("doc_id", F.col("user_id"))
    f = e.where("event_type = 'purchase'").select(F.col("event_id").alias("fact_id"), "doc_id", F.col("event_id").alias("char_start"), (F.col("event_id") + 50).alias("char_end"))
    p = e.where("event_type = 'view'").select("doc_id", F.col("event_id").alias("start"), (F.col("event_id") + 30 + (F.col("event_id") % 7) * 60).alias("end"))
    return sm.refined(f, p, ["doc_id"])


# ---------------------------------------------------------------- conversations


@query("WITH c AS (SELECT *, CASE WHEN role IN ('user', 'system') THEN role END AS cue FROM conversations), l AS (SELECT *, last_value(CASE WHEN cue = 'user' THEN cue END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS back FROM c) SELECT conv_id, turn, coalesce(cue, back) AS carried, CASE WHEN cue IS NOT NULL THEN 'cue_matched' WHEN back IS NOT NULL THEN 'carried_forward' ELSE 'untagged' END AS role_confidence FROM l")
def conversation_roles(spark, sf_dir):  # noqa: ANN001, ANN201
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct("turn", "text").alias("o"), F.col("role").alias("said"))
    out = fx.roles(c, ["conv_id"], "o", "said", ("user",), lambda x: F.when(x.isin("user", "system"), x), spread=True)
    return out.select("conv_id", "turn", F.col("role").alias("carried"), "role_confidence")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS paragraph_no, (sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) - length(text) - 1)::BIGINT AS char_start FROM conversations")
def conversation_offsets(spark, sf_dir):  # noqa: ANN001, ANN201
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.length("text") + 1
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(w).cast("long").alias("paragraph_no"), (F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)) - n).alias("char_start"))


# ---------------------------------------------------------------- documents and pages

_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL), ls AS (SELECT doc_id, line_no, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l)"


@query(f"WITH {_LINES} SELECT doc_id, line_no::INTEGER AS line_no, start::INTEGER AS start, length(line)::INTEGER AS n FROM ls")
def document_lines(spark, sf_dir):  # noqa: ANN001, ANN201
    return sg.lines(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "line_no", "start", F.length("line").alias("n"))


#: Invented prose has none of the default headings; a short line that opens with a capital stands in for one.
_HEADED = r"^[A-Z][a-z]{1,24}\.$"


@query(f"WITH {_LINES}, h AS (SELECT doc_id, count(*) AS n FROM ls WHERE regexp_matches(trim(line), '{_HEADED}') GROUP BY 1) SELECT doc_id, coalesce(n, 0) AS n_headings, coalesce(n, 0) AS structure_score, CASE WHEN coalesce(n, 0) >= 3 THEN 'structured' ELSE 'fallback' END AS mode FROM documents LEFT JOIN h USING (doc_id)")
def document_structure(spark, sf_dir):  # noqa: ANN001, ANN201
    pages = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_number"), "text", F.lit("digital").alias("page_kind"))
    return sg.structure(pages, pattern=_HEADED).select("doc_id", "n_headings", "structure_score", "mode")


@query(f"""WITH {_LINES}, h AS (SELECT doc_id, start, trim(line) AS heading FROM ls WHERE regexp_matches(trim(line), '{_HEADED}')), n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY 1),
cut AS (SELECT h.doc_id, heading, start, coalesce(lead(start) OVER (PARTITION BY h.doc_id ORDER BY start), length(text)) AS stop, row_number() OVER (PARTITION BY h.doc_id ORDER BY start) AS no FROM h JOIN n USING (doc_id) JOIN documents USING (doc_id) WHERE n >= 3)
SELECT doc_id, no::INTEGER AS section_no, heading AS section_label, true AS detected, (stop - start)::INTEGER AS n_chars FROM cut
UNION ALL SELECT doc_id, 1, 'p.1', false, length(text)::INTEGER FROM documents LEFT JOIN n USING (doc_id) WHERE coalesce(n, 0) < 3""")
def document_sections(spark, sf_dir):  # noqa: ANN001, ANN201
    pages = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_number"), "text", F.lit("digital").alias("page_kind"))
    return sg.sections(pages, pattern=_HEADED).select("doc_id", "section_no", "section_label", "detected", F.length("text").alias("n_chars"))


_SPAN = """SELECT doc_id, '{kind}' AS kind, split_part(p, chr(2), 1) AS raw, pos::INTEGER AS start, (pos + length(split_part(p, chr(2), 1)))::INTEGER AS "end" FROM (
SELECT doc_id, p, i, sum(length(p) - CASE WHEN i > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - length(p) + CASE WHEN i > 1 THEN 1 ELSE 0 END AS pos FROM (
SELECT doc_id, unnest(string_split(m, chr(1))) AS p, generate_subscripts(string_split(m, chr(1)), 1) AS i FROM (SELECT doc_id, regexp_replace(text, '{pattern}', chr(1) || '\\0' || chr(2), 'g') AS m FROM documents))) WHERE i > 1"""
_TOKENS = {"NUMBER": "[0-9]+", "EMAIL": "[A-Za-z0-9._]+@[A-Za-z0-9.]+[A-Za-z]", "SHOUT": "[A-Z]{3,}!!"}


@query(" UNION ALL ".join(_SPAN.format(kind=k, pattern=p) for k, p in _TOKENS.items()))
def document_mentions(spark, sf_dir):  # noqa: ANN001, ANN201
    docs, out = table(spark, sf_dir, "documents"), None
    for kind, pattern in _TOKENS.items():
        found = exploded(docs, pattern, kind, ["doc_id"])
        out = found if out is None else out.unionByName(found)
    return out


@query(f"WITH {_LINES}, r AS (SELECT doc_id, line_no, len(regexp_extract_all(line, '[0-9]+')) + len(regexp_extract_all(line, '[A-Z]{{3,}}!!')) - 0.001::DOUBLE * length(line) AS score FROM ls WHERE length(line) > 0) SELECT doc_id, line_no::INTEGER AS line_no, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no) AS k FROM r) WHERE k = 1")
def document_top_line(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = sg.lines(table(spark, sf_dir, "documents"), ["doc_id"]).where(F.length("line") > 0)
    score = F.regexp_count("line", F.lit("[0-9]+")) + F.regexp_count("line", F.lit("[A-Z]{3,}!!")) - F.lit(0.001) * F.length("line")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "line_no"))
    return rows.withColumn("score", score).withColumn("k", rank).where("k = 1").select("doc_id", "line_no", F.round("score", 6).alias("score"))


@query("""WITH f AS (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS flat, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS safe FROM documents)
SELECT doc_id, CASE WHEN length(flat) > 160 THEN left(flat, 160) || '…' ELSE flat END AS label, md5(safe) AS escaped FROM f""")
def document_labels(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "documents").select("doc_id", label(F.col("text")).alias("label"), F.md5(html_escaped(F.col("text"))).alias("escaped"))


@query("""WITH h AS (SELECT doc_id, text, left(text, 300) AS head FROM documents), p AS (SELECT *, length(head) - position(' .' IN reverse(head)) - 1 AS stop, length(head) - position(' ' IN reverse(head)) AS blank, position(' .' IN reverse(head)) > 0 AS s, position(' ' IN reverse(head)) > 0 AS b FROM h)
SELECT doc_id, CASE WHEN length(text) <= 300 THEN text WHEN s AND stop > 120 THEN left(text, stop + 1) WHEN b AND blank > 120 THEN left(text, blank) ELSE head END AS trimmed FROM p""")
def document_trimmed(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "documents").select("doc_id", trimmed(F.col("text"), 300).alias("trimmed"))


@query("WITH m AS (" + " UNION ALL ".join(_SPAN.format(kind=k, pattern=p) for k, p in (("AMOUNT", "[0-9]{4,}"), ("CASE_NUMBER", "[A-Z]{5,}"))) + """) SELECT doc_id, coalesce(list_sort(list_distinct(list(raw) FILTER (kind = 'AMOUNT'))), []) AS amounts, coalesce(list_sort(list_distinct(list(raw) FILTER (kind = 'CASE_NUMBER'))), []) AS case_numbers FROM m GROUP BY 1""")
def document_summaries(spark, sf_dir):  # noqa: ANN001, ANN201
    docs = table(spark, sf_dir, "documents")
    found = exploded(docs, "[0-9]{4,}", "AMOUNT", ["doc_id"]).unionByName(exploded(docs, "[A-Z]{5,}", "CASE_NUMBER", ["doc_id"]))
    return sm.document_summary(found).select("doc_id", "amounts", "case_numbers")


@query()
def document_sentences(spark, sf_dir):  # noqa: ANN001, ANN201
    """Paragraphs and sentences of whole documents; the folds of the splitter are tested in Python."""
    paras = sg.paragraphs(table(spark, sf_dir, "documents"), ["doc_id"])
    return sg.sentences(paras, ["doc_id", "para_no"])


@query()
def document_facts(spark, sf_dir):  # noqa: ANN001, ANN201
    """All facts of all documents, page sections as units."""
    from folioweave.operators.mentions import mentions, names

    pages = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_number"), "text", F.lit("digital").alias("page_kind"))
    units = settled(sg.sections(pages))  # mentions and names look at them, too
    return fx.derived(units, mentions(units, fx.KEYS), names(units, fx.KEYS)).drop("context")


_PAGES = r"p AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', chr(10), 'g') AS text FROM pages)"


@query(f"WITH {_PAGES}, k AS (SELECT CASE WHEN length(trim(text)) < 20 THEN 'scanned' WHEN length(trim(text)) < 200 AND contains(html, '<img') THEN 'hybrid' ELSE 'digital' END AS page_kind FROM p JOIN pages USING (page_id)) SELECT page_kind, count(*) AS n FROM k GROUP BY 1")
def page_kinds(spark, sf_dir):  # noqa: ANN001, ANN201
    raw = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.contains("html", F.lit("<img")).alias("img"))
    kind = sg.page_kind(F.col("text"), F.col("img"))
    return page_units(spark, sf_dir).join(raw, "doc_id").groupBy(kind.alias("page_kind")).agg(F.count(F.lit(1)).alias("n"))


@query()
def document_parties(spark, sf_dir):  # noqa: ANN001, ANN201
    """The party ladder over whole documents; captions are tested in Python."""
    return pt.party_results(table(spark, sf_dir, "documents")).select("doc_id", "tier", "confidence", "profile", F.size("parties").alias("n_parties"))


# ---------------------------------------------------------------- names, symbols, vectors


@query(r"SELECT s_suppkey, array_to_string(list_filter(string_split(regexp_replace(lower(s_name), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda x: length(x) > 1), ' ') AS key FROM supplier")
def supplier_keys(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "supplier").select("s_suppkey", normal_name(F.col("s_name")).alias("key"))


@query("""WITH s AS (SELECT 'PART:' || p_name AS key, p_partkey AS ord, p_brand AS doc, p_name AS text FROM part) SELECT key, 'PART' AS kind, arg_min(doc, ord) AS definition, arg_min(text, ord) AS definition_text, count(*) AS n_sites FROM s GROUP BY key""")
def part_symbols(spark, sf_dir):  # noqa: ANN001, ANN201
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.lit("PART").alias("kind"), F.col("p_name").alias("raw"), F.col("p_partkey").alias("ord"))
    return sy.symbol_table(sy.sites(p)).drop("aliases")


def _canonical(keys: str, names: str) -> str:
    """SQL of FN4: keys (kind, key, ord) that resemble no entity before them are entities, in order; the others join the one they resemble most.

    Likeness is 200 * longest common subsequence / lengths of the words in order, by rows of bits; 31 letters at most.
    """
    marks = "list_transform(string_split(b.s, ''), lambda c: list_sum(list_transform(range(length(a.s)), lambda i: CASE WHEN a.s[i + 1] = c THEN 1::BIGINT << i ELSE 0 END))::BIGINT)"
    step = "list_reduce(list_prepend((1::BIGINT << length(a.s)) - 1, marks), lambda r, m: ((r + (r & m)) | (r - (r & m))) & ((1::BIGINT << n) - 1))"
    return f"""k AS MATERIALIZED (SELECT *, array_to_string(list_sort(string_split(key, ' ')), ' ') AS s, row_number() OVER (ORDER BY ord, key) AS i FROM ({keys})),
p AS MATERIALIZED (SELECT i, j, 200.0 * (n - bit_count({step.replace('a.s', 's')})) / (n + m) AS score FROM (SELECT a.i, b.i AS j, a.s, length(a.s) AS n, length(b.s) AS m, {marks} AS marks FROM k a JOIN k b ON a.i < b.i AND a.kind = b.kind)),
near AS MATERIALIZED (SELECT j, list(i) AS before FROM p WHERE score >= 88 GROUP BY j),
r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS heads UNION ALL SELECT k.i, CASE WHEN coalesce(len(list_intersect(before, heads)), 0) > 0 THEN heads ELSE list_append(heads, k.i) END FROM r JOIN k ON k.i = r.i + 1 LEFT JOIN near ON j = k.i),
h AS MATERIALIZED (SELECT unnest(heads) AS i FROM (SELECT heads FROM r ORDER BY i DESC LIMIT 1)),
e AS (SELECT k.kind, k.key, coalesce(arg_max(o.key, (score, -p.i)), k.key) AS head FROM k LEFT JOIN (p JOIN h USING (i)) ON p.j = k.i AND score >= 88 AND k.i NOT IN (SELECT i FROM h) LEFT JOIN k o ON o.i = p.i GROUP BY k.kind, k.key)
SELECT kind, text, kind || ':' || head AS entity_id FROM ({names}) JOIN e USING (kind, key)"""


@query(f"""WITH RECURSIVE {_canonical("SELECT 'PART' AS kind, p_name AS key, min(p_partkey) AS ord FROM part GROUP BY p_name", "SELECT DISTINCT 'PART' AS kind, p_name AS text, p_name AS key FROM part")}""")
def part_entities(spark, sf_dir):  # noqa: ANN001, ANN201
    """FN4, JN7, JN12: fuzzy canonical names, by greedy selection in rounds."""
    p = table(spark, sf_dir, "part").select(F.lit("PART").alias("kind"), F.col("p_name").alias("text"), F.col("p_partkey").alias("ord"))
    return sy.canonical_entities(p)


_SUPPLIER_KEY = r"regexp_replace(lower(s_name), '[^a-z0-9 ]', ' ', 'g')"


@query(f"""WITH RECURSIVE {_canonical(f"SELECT 'ORG' AS kind, {_SUPPLIER_KEY} AS key, min(s_suppkey) AS ord FROM supplier GROUP BY ALL", f"SELECT DISTINCT 'ORG' AS kind, s_name AS text, {_SUPPLIER_KEY} AS key FROM supplier")}""")
def supplier_entities(spark, sf_dir):  # noqa: ANN001, ANN201
    """FN4, JN12 over numbered names, nearly all of which resemble many others."""
    s = table(spark, sf_dir, "supplier").select(F.lit("ORG").alias("kind"), F.col("s_name").alias("text"), F.col("s_suppkey").alias("ord"))
    return sy.canonical_entities(s)


@query("SELECT p_partkey, CASE WHEN p_type LIKE 'ECO%' THEN 'first' WHEN p_type LIKE 'E%' THEN 'second' WHEN p_type LIKE 'S%' THEN 'third' END AS value FROM part")
def part_prefix_rules(spark, sf_dir):  # noqa: ANN001, ANN201
    return sy.prefixed(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", [("ECO", "first"), ("E", "second"), ("S", "third")]).select("p_partkey", "value")



@query("""WITH d AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT label, i, sum(x) AS t FROM d GROUP BY ALL), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
SELECT vec_id, round(sum(x * t - x * x) / any_value(n), 6) AS centrality FROM d JOIN s USING (label, i) JOIN n USING (label) GROUP BY vec_id""")
def embedding_centrality(spark, sf_dir):  # noqa: ANN001, ANN201
    """EVT6."""
    return fx.centrality(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding").withColumn("centrality", F.round("centrality", 6))


@query("SELECT a.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def embedding_similarity(spark, sf_dir):  # noqa: ANN001, ANN201
    e = table(spark, sf_dir, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(g.inner_product(F.col("embedding"), F.col("other")), 6).alias("similarity"))
