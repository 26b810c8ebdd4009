"""Symbols over documents: names, amounts, provisions and case numbers with definition and references; provisions with their acts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioweave import lexicons as lx
from folioweave.functions.fuzzy import common_to, may_reach, places, ratio, similarity
from folioweave.functions.text import act_without_year, normal_name, provision_key, symbol_key
from folioweave.operators.greedy import best_match, kept_in_order
from folioweave.operators.lookup import token_set_matches
from folioweave.session import settled


def sites(found: DataFrame, doc: str = "doc_id", kind: str = "kind", text: str = "raw", order: str = "ord") -> DataFrame:
    """AGG11: document_id, kind, text, ord and the symbol's key; sites without a key are left out."""
    rows = found.select(F.col(doc).alias("document_id"), F.col(kind).alias("kind"), F.col(text).alias("text"), F.col(order).alias("ord"))
    return rows.withColumn("key", symbol_key(F.col("kind"), F.col("text"))).where(F.col("key").isNotNull())


def symbol_table(site_rows: DataFrame) -> DataFrame:
    """AGG7, AGG8, AGG10: key, kind, definition (the first site's document), definition_text, aliases in order of first use, n_sites.

    A key's kind is that of its first site. Tables merge by the union of their sites.
    """
    per_alias = site_rows.groupBy("key", "kind", "text").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n"), F.min_by("document_id", "ord").alias("document_id"))
    own = per_alias.withColumn("__k", F.min_by("kind", "first").over(Window.partitionBy("key"))).where("kind = __k")
    spelled = F.transform(F.sort_array(F.collect_list(F.struct("first", "text"))), lambda x: x["text"])
    return own.groupBy("key").agg(F.first("kind").alias("kind"), F.min_by("document_id", "first").alias("definition"), F.min_by("text", "first").alias("definition_text"), spelled.alias("aliases"), F.sum("n").alias("n_sites"))


def references(site_rows: DataFrame, key: str | None = None) -> DataFrame:
    """AGG9: the sites of a key, or of every key, with their place in order: ref_no from 1."""
    rows = site_rows if key is None else site_rows.where(F.col("key") == key)
    return rows.withColumn("ref_no", F.row_number().over(Window.partitionBy("key").orderBy("ord", "document_id")))


def resembling_places(keys: DataFrame, least: float) -> DataFrame:
    """bucket, node, at, probe, x of keys, for greedy selection: keys of a kind with token_sort_ratio >= least share a bucket. keys: kind, key, ord.

    Nothing is lost: an indel distance of d leaves at least (m + n - d) / 2 - (q - 1) * (d + 1) q-grams in common, so two
    such keys share one of their rarest q-grams, as many as they have beyond that bound, plus one.
    """
    slack = 1 - least / 100
    # Bigrams, if lengths from which a difference is allowed always leave one in common; else letters.
    q = 2 if slack < 1 / 3 and all((n - d) / 2 - 1 - d > 0 for n in range(2, 1000) if (d := int(slack * n + 1e-9))) else 1
    node = keys.select("kind", "ord", F.concat("kind", F.lit("\1"), "key").alias("node"), F.array_join(F.sort_array(F.split("key", " ")), " ").alias("s")).withColumn("m", F.length("s"))
    both = F.col("m") + F.ceil(F.col("m") * (1 - slack) / (1 + slack) - 1e-9)  # with the shortest key that can reach it
    common = F.greatest(F.lit(1), F.ceil(both * (1 - (2 * q - 1) * slack) / 2 - (q - 1) - 1e-9))
    starts = F.when(F.col("m") >= q, F.sequence(F.lit(1), F.col("m") - q + 1)).otherwise(F.array(F.lit(1)))
    grams = node.withColumn("i", F.explode(starts)).withColumn("g", F.substring("s", F.col("i"), F.lit(q)))
    grams = grams.withColumn("nth", F.row_number().over(Window.partitionBy("node", "g").orderBy("i")))
    often = grams.groupBy("kind", "g", "nth").agg(F.count(F.lit(1)).alias("often"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("often", "g", "nth"))
    first = grams.join(often, ["kind", "g", "nth"]).withColumn("r", rank).where(F.col("r") <= F.greatest(F.lit(1), F.col("m") - q + 2 - common))
    return first.select(F.concat_ws("\1", "kind", "g", F.col("nth").cast("string")).alias("bucket"), "node", F.col("ord").cast("long").alias("at"), F.lit(True).alias("probe"), F.col("s").alias("x"))


def _placed(s: str) -> tuple[str, dict[str, int]]:
    return s, places(s)


def _alike(x: tuple, y: tuple) -> float:
    """ratio() of two keys whose letters are placed."""
    a, b = x[0], y[0]
    return 200.0 * common_to(x[1], len(a), b) / (len(a) + len(b))


def canonical_entities(names: DataFrame, least: float = lx.FUZZY_ENTITY) -> DataFrame:
    """FN4, JN12: kind, text, entity_id. Equal keys are one entity; then a key joins the entity before it, in order of first use, that it resembles most.

    names: kind, text, ord (a whole number). A key is an entity of its own if it resembles none before it, so entities are the
    first independent set of keys, found in rounds; then every other key meets the entities of its buckets, not all keys.
    """
    keyed = names.withColumn("key", normal_name(F.col("text"))).where(F.col("key") != "")
    keys = settled(keyed.groupBy("kind", "key").agg(F.min("ord").alias("ord")))
    at = settled(resembling_places(keys, least))
    room = 1 - least / 100

    def near(x: tuple, y: tuple) -> bool:
        m, n = len(x[0]), len(y[0])
        return abs(m - n) <= (m + n) * room + 1e-9 and _alike(x, y) >= least

    chosen = kept_in_order(at, near, _placed)
    own, other = (settled(at.join(chosen.where(c), "node", "left_semi")) for c in ("kept", "NOT kept"))
    match = best_match(other, own, _alike, least, _placed)
    node = keyed.select("kind", "text", "key").distinct().withColumn("node", F.concat("kind", F.lit("\1"), "key"))
    head = F.coalesce(F.substring_index("head", "\1", -1), F.col("key"))
    return node.join(match, "node", "left").select("kind", "text", F.concat("kind", F.lit(":"), head).alias("entity_id"))


def provisions(cited: DataFrame, doc: str = "doc_id") -> DataFrame:
    """AGG4, V4: key, section, act (longest spelling), documents, count of (doc, raw, act, ord)."""
    act = act_without_year(F.col("act"))
    key = provision_key(F.when(F.coalesce(act, F.lit("")) != "", F.concat("raw", F.lit(" of the "), act)).otherwise(F.col("raw")))
    rows = cited.withColumn("key", key).where(F.col("key").isNotNull())
    longest = F.max(F.when(F.col("act").isNotNull(), F.struct(F.length("act").alias("n"), (-F.col("ord")).alias("o"), F.col("act"))))
    return rows.groupBy("key").agg(F.min_by("raw", "ord").alias("section"), longest["act"].alias("act"), F.sort_array(F.collect_set(doc)).alias("documents"), F.count(F.lit(1)).alias("count"))


def first_prefix(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The value of the first rule (prefix, value) whose prefix starts the text; null where none does."""
    value = F.lit(None).cast("string")
    for prefix, given in reversed(rules):
        value = F.when(F.upper(F.trim(text)).startswith(prefix.upper()), F.lit(given)).otherwise(value)
    return value


def prefixed(rows: DataFrame, text: str, rules: list[tuple[str, str]]) -> DataFrame:
    """JN9: rows with the value of the first rule whose prefix starts the text."""
    return rows.withColumn("value", first_prefix(F.col(text), rules))


_YEAR = r",?\s*\d{4}\s*$"


def _act_name(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, _YEAR, "")))


def looked_up_acts(acts: DataFrame, index: DataFrame, least: float = lx.FUZZY_ACT) -> DataFrame:
    """JN13: act, id, short_title, score: the index entry most like an act's name, first among those of its year, then among all.

    index: id, short_title, act_year; any size. Ties go to the shorter title, then to the smaller id. Names are compared without
    their year; entries without id or title take no part, acts without a match have no row.
    """
    named = acts.select("act").where(F.col("act").isNotNull()).distinct().select("act", _act_name(F.col("act")).alias("name"), F.nullif(F.regexp_extract("act", r"(\d{4})\s*$", 1), F.lit("")).cast("int").alias("year"))
    known = index.where(F.col("id").isNotNull() & (F.col("short_title") != "")).select("id", "short_title", F.col("act_year").cast("int").alias("act_year"), _act_name(F.col("short_title")).alias("b"))
    pairs = token_set_matches(named, known.select(F.col("b").alias("name")), least)
    every = named.join(pairs, F.col("name") == F.col("a")).join(known, "b")
    rank = F.struct(F.coalesce(F.col("year") != F.col("act_year"), F.lit(True)).alias("other_year"), (-F.col("score")).alias("s"), F.length("short_title").alias("n"), "id", "short_title")
    return every.groupBy("act").agg(F.min(rank).alias("r")).select("act", "r.id", "r.short_title", (-F.col("r.s")).alias("score"))


def is_versus(line: Column) -> Column:
    """MEN12: a short line that only says versus, in one of its forms, or nearly so after common scan errors are undone."""
    text = F.trim(line)
    core = F.regexp_replace(F.lower(F.translate(text, "".join(lx.SCAN_FIXES), "".join(lx.SCAN_FIXES.values()))), r"[^a-z\u0900-\u0DFF]", "")
    likely = F.length(core).between(2, 12) & (may_reach(core, F.lit("versus"), lx.FUZZY_VERSUS) | may_reach(core, F.lit("verses"), lx.FUZZY_VERSUS))
    near = F.greatest(*[similarity(ratio, F.when(likely, core), F.lit(x)) for x in ("versus", "verses")]) >= lx.FUZZY_VERSUS
    exact = text.rlike(r"(?i)^\s*[-–—\s]*(?:" + "|".join(lx.VERSUS_FORMS) + r")[\s.:\-–—]*$") | core.isin("v", "vs")
    return F.length(text).between(1, 24) & (exact | F.coalesce(near, F.lit(False)))
