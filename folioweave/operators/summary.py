"""Document summaries, counters and the joins that serve them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.operators.facts import KEYS, uncovered


def document_summary(mentions: DataFrame, key: str = "doc_id") -> DataFrame:
    """M22, AGG6: sorted distinct provisions, amounts and case numbers of each document, and counts by kind."""
    of = lambda kind: F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.col("raw"))))
    return mentions.groupBy(key).agg(of("PROVISION").alias("sections_cited"), of("AMOUNT").alias("amounts"), of("CASE_NUMBER").alias("case_numbers"), F.count_if(F.col("kind") == "DATE").alias("n_dates"))


def kind_counts(rows: DataFrame, key: str, kind: str, kinds: list[str]) -> DataFrame:
    """AGG5, AGG18: one row per key with a count for each kind."""
    return rows.groupBy(key).agg(*[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds])


def grouped_in_order(rows: DataFrame, key: str, order: str) -> DataFrame:
    """AGG16: groups with their sizes and where each is first seen, by which they are ordered."""
    return rows.groupBy(key).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).orderBy("first")


def unstable_names(rows: DataFrame, name: str, role: str) -> DataFrame:
    """AGG13: names with more than one role."""
    return rows.groupBy(name).agg(F.countDistinct(role).alias("n_roles")).where("n_roles > 1")


def coverage(found: DataFrame, facts: DataFrame, keys: list[str] = KEYS, spread: bool = False) -> DataFrame:
    """AGG19, JN17: of spans `found` (start, end), how many lie inside a fact, by document. spread: documents may be too large for one task."""
    left = uncovered(found, facts, keys, spread).groupBy(keys[0]).agg(F.count(F.lit(1)).alias("__out"))
    total = found.groupBy(keys[0]).agg(F.count(F.lit(1)).alias("n"))
    return total.join(left, keys[0], "left").select(keys[0], "n", (F.col("n") - F.coalesce("__out", F.lit(0))).alias("n_covered"))


def refined(facts: DataFrame, spans: DataFrame, keys: list[str] = KEYS, step: int = 400) -> DataFrame:
    """EVT7, JN10: facts take the span of a better splitter with the largest overlap (ties: the first), unless it is longer than twice theirs and 200.

    spans: keys, start, end. Both sides meet by stretches of `step` that they touch.
    """
    touched = lambda a, b: F.explode(F.sequence(F.floor(a / step), F.floor((b - 1) / step)))
    f = facts.select("fact_id", *keys, "char_start", "char_end").where("char_end > char_start").withColumn("__b", touched(F.col("char_start"), F.col("char_end")))
    s = spans.where("end > start").select(*keys, "start", "end", touched(F.col("start"), F.col("end")).alias("__b"))
    shared = F.least("char_end", "end") - F.greatest("char_start", "start")
    met = f.join(s, [*keys, "__b"]).withColumn("__o", shared).where("__o > 0")
    best = met.groupBy("fact_id").agg(F.min(F.struct((-F.col("__o")).alias("o"), "start", "end")).alias("s"))
    near = (F.col("s.end") - F.col("s.start")) <= 2 * (F.col("char_end") - F.col("char_start")) + 200
    out = facts.join(best, "fact_id", "left")
    return out.withColumn("__n", F.coalesce(near, F.lit(False))).withColumns({"char_start": F.when(F.col("__n"), F.col("s.start")).otherwise(F.col("char_start")), "char_end": F.when(F.col("__n"), F.col("s.end")).otherwise(F.col("char_end"))}).drop("s", "__n")


def with_statutes(provisions: DataFrame, statutes: DataFrame) -> DataFrame:
    """SRC13 as a join: provisions with the statute text of a given table (act, section, text); null where it has none."""
    section = F.upper(F.regexp_extract("section", r"(\d+[A-Za-z]{0,2})", 1))
    same = lambda c: F.lower(F.trim(F.regexp_replace(c, r",?\s*\d{4}\s*$", "")))
    s = statutes.select(same(F.col("act")).alias("__a"), F.upper("section").alias("__s"), F.col("text").alias("statute_lookup")).dropDuplicates(["__a", "__s"])
    return provisions.withColumn("__a", same(F.col("act"))).withColumn("__s", section).join(s, ["__a", "__s"], "left").drop("__a", "__s")


#: PRJ5: names for readers.
FRIENDLY = {"PAYMENT": "Payment", "TERMINATION": "Termination", "NOTICE": "Notice", "AGREEMENT": "Agreement", "ORDER": "Order", "FILING": "Filing", "DATED_EVENT": "Dated event", "IMPORTANT_LINE": "Key point", "SECTION": "Section", "PARTIES": "Parties", "FACT": "Fact"}


def friendly(kind: Column) -> Column:
    """PRJ5: the reader's name of a type, else the type in title case."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FRIENDLY.items() for x in kv]), kind), F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))))
