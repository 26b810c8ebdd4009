"""Sinks: the graph as JSON, edges with upsert, and reports as Markdown and HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioweave.functions.text import html_escaped
from folioweave.session import settled


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """SNK1: nodes and edges as lines of JSON."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def upserted(old: DataFrame, new: DataFrame, key: str = "edge_id") -> DataFrame:
    """SNK3: old rows with the new ones in place of those of the same key; of repeated new rows, the last recorded."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc("__new"), F.desc_nulls_last("recorded_at"))
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__new")


def markdown_report(facts: DataFrame, edges: DataFrame, events: int = 60, cross: int = 30, conflicts: int = 10) -> str:
    """SNK2, LIM1: counts and the first rows of each list, formatted on the driver; only those rows come to it."""
    edges = settled(edges.select("a", "b", "label", "score", "cross_doc"))  # three lists are made of them
    n = facts.agg(F.count(F.lit(1)), F.countDistinct("doc_id"), F.count("date")).first()
    e = edges.agg(F.count(F.lit(1)), F.count_if("cross_doc"), F.count_if(F.col("label") == "POTENTIAL_CONFLICT")).first()
    out = ["# Report", "", "| documents | facts | dated | edges | across documents | conflicts |", "|-|-|-|-|-|-|", f"| {n[1]} | {n[0]} | {n[2]} | {e[0]} | {e[1]} | {e[2]} |", "", "## Facts", ""]
    out += [f"- {r['type']} {r['date'] or ''} {r['doc_id']}" for r in facts.orderBy("fact_id").limit(events).collect()]
    for title, rows, most in (("Across documents", edges.where("cross_doc"), cross), ("Conflicts", edges.where("label = 'POTENTIAL_CONFLICT'"), conflicts)):
        out += ["", f"## {title}", "", *(f"- {r['a']} - {r['b']}: {r['label']} {r['score']:.3f}" for r in rows.orderBy(F.desc("score"), "a", "b").limit(most).collect())]
    return "\n".join(out) + "\n"


def html_lines(report: DataFrame) -> DataFrame:
    """SNK6: report lines as list items, safe for HTML."""
    return report.select("doc_id", "part", "position", F.concat(F.lit("<li>"), html_escaped(F.col("line")), F.lit("</li>")).alias("html"))
