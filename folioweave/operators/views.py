"""Read-only views over facts, parties, provisions and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioweave import lexicons as lx
from folioweave.functions.text import highlighted, long_words, overlap
from folioweave.operators.greedy import kept_in_order
from folioweave.operators.overlaps import unlike
from folioweave.session import settled

#: Facts of a group that are one bucket of greedy selection; those of a larger group are compared in tiles.
SMALL = 1024


def dashboard(facts: DataFrame, case: str) -> DataFrame:
    """V1, AGG15: documents, facts, dated facts and first and last date of each case."""
    return facts.groupBy(case).agg(F.countDistinct("doc_id").alias("n_documents"), F.count(F.lit(1)).alias("n_facts"), F.count("date").alias("n_dated"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def in_order(facts: DataFrame, case: str) -> DataFrame:
    """SRT1: `position`: the place of each dated fact of a case by date, then id."""
    return facts.where(F.col("date").isNotNull()).withColumn("position", F.row_number().over(Window.partitionBy(case).orderBy("date", "fact_id")))


def longest_first(facts: DataFrame, keys: list[str]) -> DataFrame:
    """SRT3: `rank`: the place of each fact of a group, the longest text first, then by id."""
    return facts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.length("text")), "fact_id")))


def first_of_words(facts: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """keys, x, n, at, node: the sorted words of facts that have any, and the first fact of a group with just these, by (at, fact_id)."""
    sets = facts.select(*keys, "fact_id", at.cast("long").alias("at"), F.sort_array(long_words(F.col("text"))).alias("x"))
    first = sets.where(F.size("x") > 0).groupBy(*keys, "x").agg(F.min(F.struct("at", "fact_id")).alias("f"))
    return first.select(*keys, "x", F.size("x").alias("n"), "f.at", F.col("f.fact_id").alias("node"))


def word_places(first: DataFrame, keys: list[str], least: float, small: int = SMALL) -> DataFrame:
    """bucket, node, at, probe, x for greedy selection: of first_of_words(), those whose words overlap by more than `least` share a bucket.

    A group of at most `small` facts is one bucket, so a fact is sent once. Facts of a larger one go by words: the smaller
    of two such sets shares more than `least` of its words, so one of its rarest words, as many as it may lack plus one,
    is in the other.
    """
    group = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    sized = first.withColumn("__size", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    few = sized.where((F.col("__size") > 1) & (F.col("__size") <= small)).select(F.xxhash64(group).alias("bucket"), "node", "at", F.lit(True).alias("probe"), "x")
    many = sized.where(F.col("__size") > small).drop("__size")
    # A bucket's name is a hash: names that collide make one bucket, in which texts are compared as ever.
    words = many.select("node", "at", "n", F.explode("x").alias("word"), group.alias("__g")).withColumn("bucket", F.xxhash64("__g", "word"))
    often = words.groupBy("bucket").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    # Words of one fact alone meet nothing, but count among those that may lack.
    shared = words.join(often, "bucket")
    single = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("node"))
    rank = single + F.row_number().over(Window.partitionBy("node").orderBy("often", "word"))
    placed = shared.withColumn("probe", rank <= F.col("n") - F.floor(F.col("n") * least - 1e-9)).select("bucket", "node", "at", "probe")
    placed = placed.groupBy("bucket", "node", "at").agg(F.max("probe").alias("probe"))
    return few.unionByName(placed.join(many.select("node", "x"), "node"))


def _thinned(facts: DataFrame, keys: list[str], least: float, at: Column) -> DataFrame:
    """facts without those whose words overlap by more than `least` of the smaller number with one of their group that stays and comes before, by (at, fact_id)."""

    def repeats(x: frozenset, y: frozenset) -> bool:
        return len(x & y) / min(len(x), len(y)) > least

    group = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    worded = facts.select(*keys, "fact_id", at.cast("long").alias("at"), F.sort_array(long_words(F.col("text"))).alias("x")).where(F.size("x") > 0)
    large = settled(worded.groupBy(group.alias("group")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("x")).alias("words")).where(F.col("n") > SMALL))
    in_large = F.broadcast(large.select("group"))
    # Of the same words only the first can stay, so a group of copies is one row from here on.
    first = settled(first_of_words(facts.join(in_large, group == F.col("group"), "left_anti"), keys, at))
    gone = kept_in_order(word_places(first, keys, least), repeats, frozenset).where("NOT kept").select("node")
    stay = first.select("node").join(gone, "node", "left_anti")
    if not large.isEmpty():
        many = worded.select(group.alias("group"), F.col("fact_id").alias("node"), "at", "x").join(in_large, "group", "left_semi")
        stay = stay.unionByName(many.select("node").join(unlike(many, large, least), "node", "left_anti"))
    bare = facts.where(F.size(long_words(F.coalesce("text", F.lit("")))) == 0)
    return bare.unionByName(facts.join(stay, F.col("fact_id") == F.col("node"), "left_semi"))


def unrepeated(facts: DataFrame, case: str, wide: float = 0.85, order: Column | None = None) -> DataFrame:
    """SET6, first pass: dated facts without those whose words overlap by more than `wide` with one of their case that stays and comes before.

    order: a whole number; equal ones, and all without it, go by fact_id.
    """
    return _thinned(facts.where(F.col("date").isNotNull()), [case], wide, order if order is not None else F.lit(0))


def timeline(facts: DataFrame, case: str, wide: float = 0.85, close: float = 0.5, order: Column | None = None) -> DataFrame:
    """V2, SET6: dated facts in order, without party blocks, provision headings and near-duplicates.

    First a fact goes if its words overlap by more than `wide` with an earlier one of its case that stays, then, inside a date
    from the longest down, if they overlap by more than `close` with one that stays. Both passes depend on their own order
    and are found in parallel rounds. Facts without words of more than three letters stay.
    """
    shown = facts.where(~F.coalesce(F.col("section_label").rlike(lx.PROVISION_HEADING), F.lit(False)) & (F.col("type") != "PARTIES"))
    first = settled(unrepeated(shown, case, wide, order))
    return _thinned(first, [case, "date"], close, -F.length("text")).select(*facts.columns)


def tree(facts: DataFrame) -> DataFrame:
    """V3: facts per document and heading with their reading positions: page, paragraph (0 without one), start."""
    order = Window.partitionBy("doc_id", "section_label").orderBy("page", F.coalesce("paragraph_no", F.lit(0)), "char_start")
    size = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "section_label"))
    return facts.withColumn("position", F.row_number().over(order)).withColumn("n_in_heading", size)


def parties_shown(parties: DataFrame, least: int = 3) -> DataFrame:
    """V5: kept parties; dropped ones too where a document has at most `least` of them."""
    few = F.count_if(~F.col("kept")).over(Window.partitionBy("doc_id")) <= least
    return parties.withColumn("__few", few).where(F.col("kept") | F.col("__few")).drop("__few")


def conflicts(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """V6, JN14: conflicting edges with both facts."""
    f = facts.select("fact_id", F.struct("doc_id", "type", "date", "polarity").alias("f"))
    both = edges.where(F.col("label") == "POTENTIAL_CONFLICT").join(f.select(F.col("fact_id").alias("a"), F.col("f").alias("fa")), "a").join(f.select(F.col("fact_id").alias("b"), F.col("f").alias("fb")), "b")
    return both.select("a", "b", "score", *[F.col(f"f{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("doc_id", "type", "date", "polarity")])


def with_document(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """JN15: nodes with the columns that are known of their documents; null where a document isn't known."""
    return nodes.join(documents, "doc_id", "left")


def distinct_provisions(rows: DataFrame, order: str = "ord") -> DataFrame:
    """SET5: of citations with one wording and act in a document, the last."""
    w = Window.partitionBy("doc_id", "raw", "act").orderBy(F.desc(order))
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def report_lines(facts: DataFrame, parties: DataFrame, cited: DataFrame) -> DataFrame:
    """V7, SNK6: doc_id, part, position, line: parties, provisions, chronology and key points of each document."""
    p = parties.select("doc_id", F.lit(1).alias("part"), F.col("ordinal").cast("long").alias("at"), F.concat_ws(": ", "role", "name").alias("line"))
    s = distinct_provisions(cited).select("doc_id", F.lit(2).alias("part"), F.col("ord").cast("long").alias("at"), F.concat_ws(" of ", "raw", "act").alias("line"))
    d = facts.where(F.col("date").isNotNull()).select("doc_id", F.lit(3).alias("part"), F.unix_date("date").cast("long").alias("at"), F.concat_ws(" ", F.col("date").cast("string"), "text").alias("line"))
    k = facts.where(F.col("date").isNull()).select("doc_id", F.lit(4).alias("part"), F.col("char_start").cast("long").alias("at"), F.col("text").alias("line"))
    rows = p.unionByName(s).unionByName(d).unionByName(k)
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("at", "line"))).select("doc_id", "part", "position", "line")


def evidence(facts: DataFrame) -> DataFrame:
    """V8, PRJ7: one card per fact: its text marked in its context."""
    start = F.col("char_start") - F.col("context.context_start")
    return facts.select("fact_id", "doc_id", "type", "page", highlighted(F.col("context.context"), start, start + F.col("char_end") - F.col("char_start"), F.col("text")).alias("card"))


def without_near_duplicates(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs (text_a, text_b) whose words overlap by at most `least`."""
    return pairs.where(overlap(F.col("text_a"), F.col("text_b")) <= least)
