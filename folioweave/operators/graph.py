"""The evidence graph: postings, blocking, pair scores, sparsifying, labels, components and bi-temporal edges.

facts: fact_id, doc_id, type, entities array<string>, date, amount string, polarity, and optionally vec array<float>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioweave import lexicons as lx
from folioweave.functions.text import amount_key
from folioweave.session import settled


def keys_of() -> Column:
    """A row for each key of a fact's columns."""
    keys = F.concat(
        F.coalesce("entities", F.array().cast("array<string>")),
        F.array(F.concat(F.lit("date::"), F.col("date").cast("string")), F.concat(F.lit("amt::"), amount_key(F.col("amount"))), F.concat(F.lit("type::"), F.col("type"))),
    )
    return F.explode(F.array_distinct(F.filter(keys, lambda k: k.isNotNull())))


def postings(facts: DataFrame) -> DataFrame:
    """AGG1: (key, fact_id): entities, date, amount and type of each fact."""
    return facts.select("fact_id", keys_of().alias("key"))


def idf(posts: DataFrame, n_facts: Column) -> DataFrame:
    """AGG2: (key, df, idf)."""
    return posts.groupBy("key").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", _idf(F.col("df"), n_facts))


def _idf(df: Column, n_facts: Column) -> Column:
    return F.log((n_facts + 1) / (df + 1)) + 0.1


def within_hub(posts: DataFrame, hub: int = lx.HUB) -> DataFrame:
    """AGG3: posts with df, at most hub + 1 of a key: a key with more than `hub` has just as many, so its df is only known to be more.

    What a key has beyond that goes before the shuffle, so a key that all facts have is as small as the others.
    """
    key = Window.partitionBy("key")
    few = posts.withColumn("__r", F.row_number().over(key.orderBy("fact_id"))).where(F.col("__r") <= hub + 1).drop("__r")
    return few.withColumn("df", F.count(F.lit(1)).over(key))


def candidates(posts: DataFrame, hub: int = lx.HUB) -> DataFrame:
    """JN1, AGG3: distinct pairs a < b that share a key of at most `hub` facts.

    Hubs go before the self-join, which bounds a key's pairs by hub * (hub - 1) / 2 whatever the input. A fact takes its
    keys along, so that a pair is found only once, at the first key that both have: no distinct is taken of the pairs.
    """
    small = within_hub(posts, hub).where(F.col("df") <= hub).groupBy("fact_id").agg(F.sort_array(F.collect_set("key")).alias("small"))
    each = small.withColumn("key", F.explode("small"))
    # Both sides grow with the facts: never broadcast.
    both = each.alias("x").join(each.alias("y").hint("merge"), "key").where("x.fact_id < y.fact_id")
    return both.where(_first_shared("x.small", "y.small")).select(F.col("x.fact_id").alias("a"), F.col("y.fact_id").alias("b"))


def _first_shared(x: str, y: str) -> Column:
    """Whether `key` is the first key of both; a fact's only key needs no look at those of the other."""
    return (F.size(x) == 1) | (F.size(y) == 1) | (F.col("key") == F.array_min(F.array_intersect(x, y)))


def proximity(d1: Column, d2: Column, horizon: int = lx.HORIZON_DAYS) -> Column:
    """FN12."""
    return F.coalesce(F.greatest(F.lit(0.0), 1 - F.abs(F.datediff(d1, d2)) / horizon), F.lit(0.0))


def inner_product(u: Column, v: Column) -> Column:
    """FN13 over vectors of length one; 0 if either is missing."""
    return F.coalesce(F.aggregate(F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x), F.lit(0.0))


def weighted(facts: DataFrame, n_facts: Column, hub: int = lx.HUB, least: float = 0.0) -> DataFrame:
    """fact_id and f: doc_id, date, polarity, small (keys that can pair, sorted) and w (entities with their weights) of facts with a key that can pair.

    Postings are written once, hubs cut off. Their keys' numbers follow from them, but those of entities that are hubs,
    which are counted apart, if there are any. least: what a pair's base must reach. If it can't without an entity that both
    have, and no entity is a hub, such a pair meets at an entity: dates, amounts and types aren't posted.
    """
    rows = facts.select("fact_id", "doc_id", "date", "polarity", "entities", keys_of().alias("key")).withColumn("entity", F.coalesce(F.array_contains("entities", F.col("key")), F.lit(False))).drop("entities")
    only_entities = lx.W_TIME + lx.W_SAME * lx.SAME_BONUS + 1e-9 < least
    known = settled(within_hub(rows.where("entity") if only_entities else rows, hub))
    hubs = known.where((F.col("df") > hub) & F.col("entity")).select("key").distinct()
    with_hubs = hubs.limit(1).count() > 0
    if only_entities and with_hubs:  # facts that share a hub may meet at any key
        known = settled(within_hub(rows, hub))
    every = known.where(F.col("df") <= hub).withColumn("small", F.lit(True))
    if with_hubs:
        # A third of all facts may have one of them, so both sides of the join are dealt out.
        salts = 16
        df = rows.where("entity").join(hubs, "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("df")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = rows.where("entity").withColumn("salt", F.pmod(F.xxhash64("fact_id"), F.lit(salts)).cast("int")).join(df, ["key", "salt"]).drop("salt")
        every = every.unionByName(salted.withColumn("small", F.lit(False)))
    idf = _idf(F.col("df"), n_facts)
    first = [F.first(c, ignorenulls=True).alias(c) for c in ("doc_id", "date", "polarity")]
    of = every.groupBy("fact_id").agg(*first, F.sort_array(F.collect_set(F.when(F.col("small"), F.col("key")))).alias("small"), F.map_from_entries(F.collect_set(F.when(F.col("entity"), F.struct("key", idf.alias("idf"))))).alias("w"))
    return of.where(F.size("small") > 0).select("fact_id", F.struct("doc_id", "date", "polarity", "small", "w").alias("f"))


#: Entities of a fact up to which their weights are added term by term.
UNROLLED = 8


def rated(facts: DataFrame, n_facts: Column, hub: int = lx.HUB, least: float = 0.0) -> DataFrame:
    """JN1, FN14 without the text part: a, b, fa, fb, entity, time, same, base (their weighted sum), share_entity; least: pairs below it may be left out.

    What a score needs travels with the postings, so a pair is scored where it is found, and only once: at the first key
    that both have. Nothing is joined to pairs, and no distinct is taken of them.
    """
    posts = weighted(facts, n_facts, hub, least).withColumn("key", F.explode("f.small"))
    # Both sides grow with the facts: never broadcast.
    both = posts.alias("x").join(posts.alias("y").hint("merge"), "key").where("x.fact_id < y.fact_id").select("key", F.col("x.fact_id").alias("a"), F.col("y.fact_id").alias("b"), F.col("x.f").alias("fa"), F.col("y.f").alias("fb"))
    both = both.where(_first_shared("fa.small", "fb.small"))
    shared = F.array_intersect(F.map_keys("fa.w"), F.map_keys("fb.w"))
    inorder = F.sort_array(shared)
    each = max(0, facts.select(F.max(F.size("entities"))).first()[0] or 0)
    if each <= UNROLLED:  # a sum of so many terms is compiled, a fold is not, nor is what stands beside it
        weight = sum((F.coalesce(F.try_element_at(F.col("fa.w"), F.get(inorder, i)), F.lit(0.0)) for i in range(each)), F.lit(0.0))
    else:
        weight = F.aggregate(inorder, F.lit(0.0), lambda s, k: s + F.try_element_at(F.col("fa.w"), k))
    entity = F.least(F.coalesce(weight, F.lit(0.0)) / 2.0, F.lit(1.0))
    same = F.when(F.col("fa.doc_id") == F.col("fb.doc_id"), lx.SAME_BONUS).otherwise(0.0)
    parts = both.select("a", "b", "fa", "fb", entity.alias("entity"), proximity(F.col("fa.date"), F.col("fb.date")).alias("time"), same.alias("same"), (F.size(shared) > 0).alias("share_entity"))
    return parts.withColumn("base", total(F.lit(0.0)))


def total(text: Column) -> Column:
    """FN14: the weighted sum of a pair's parts."""
    return lx.W_ENTITY * F.col("entity") + lx.W_TIME * F.col("time") + lx.W_TEXT * text + lx.W_SAME * F.col("same")


def with_text(parts: DataFrame, facts: DataFrame, similarity=None) -> DataFrame:  # noqa: ANN001
    """Pairs with the text part and the score. similarity(u, v): of two facts' structs, UDF1; else the inner product of `vec`."""
    u, v = (facts.select(F.col("fact_id").alias(c), F.struct(*[x for x in facts.columns if x != "fact_id"]).alias(f"__{c}")) for c in "ab")
    text = similarity(F.col("__a"), F.col("__b")) if similarity else inner_product(F.col("__a.vec"), F.col("__b.vec"))
    return parts.join(u, "a").join(v, "b").withColumn("text", text).drop("__a", "__b").withColumn("score", total(F.col("text")))


def scored(facts: DataFrame, n_facts: Column, hub: int = lx.HUB, similarity=None) -> DataFrame:  # noqa: ANN001
    """FN14: every candidate pair: a, b, entity, time, text, same, score."""
    parts = rated(facts, n_facts, hub)
    if similarity or "vec" in facts.columns:
        return with_text(parts, facts, similarity)
    return parts.withColumn("text", F.lit(0.0)).withColumn("score", F.col("base"))


def _ends(pairs: DataFrame) -> DataFrame:
    """Each pair at both its ends: __end.node and __end.other."""
    return pairs.withColumn("__end", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))))


def promising(parts: DataFrame, facts: DataFrame, top_k: int, least: float, similarity=None, most: float = 1.0) -> DataFrame:  # noqa: ANN001
    """Scored pairs, among which are all that can be among the top_k of an end; texts are compared for these alone.

    No text part is above `most`, so a pair's bound is its base plus that. The first round scores the top_k pairs of each node
    by base; a node's top_k-th best score among them is a threshold that its final top_k can't fall below. The second round
    scores what reaches the threshold of either end.
    """
    bound = F.col("base") + lx.W_TEXT * most + 1e-9
    open_ = settled(parts.withColumn("bound", bound).where(F.col("bound") >= least))
    by_base = F.row_number().over(Window.partitionBy("__end.node").orderBy(F.desc("base"), "__end.other"))
    first = _ends(open_.select("a", "b", "base")).withColumn("__r", by_base).where(F.col("__r") <= top_k).select("a", "b").distinct()
    done = settled(with_text(open_.join(first, ["a", "b"]), facts, similarity))
    by_score = F.row_number().over(Window.partitionBy("__end.node").orderBy(F.desc("score")))
    bar = _ends(done.where(F.col("score") >= least).select("a", "b", "score")).withColumn("__r", by_score).where(F.col("__r") == top_k).select(F.col("__end.node").alias("node"), F.col("score").alias("bar"))
    left = open_.join(first, ["a", "b"], "left_anti")
    for c in "ab":
        left = left.join(bar.select(F.col("node").alias(c), F.col("bar").alias(f"bar_{c}")), c, "left")
    reach = F.least(F.coalesce("bar_a", F.lit(least)), F.coalesce("bar_b", F.lit(least)))
    return done.unionByName(with_text(left.where(F.col("bound") >= reach).drop("bar_a", "bar_b"), facts, similarity)).drop("bound")


def edge_label(p1: Column, p2: Column) -> Column:
    """FN15, SET4."""
    return _named(_label_no(p1, p2))


LABELS = ("POTENTIAL_CONFLICT", "SUPPORTS", "RELATED_TO")


def _label_no(p1: Column, p2: Column) -> Column:
    clash = ((p1 == "ASSERTS") & (p2 == "DENIES")) | ((p1 == "DENIES") & (p2 == "ASSERTS"))
    return F.when(clash, 0).when((p1 == "ASSERTS") | (p2 == "ASSERTS"), 1).otherwise(2)


def _named(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LABELS]), number + 1)


def sparsified(pairs: DataFrame, top_k: int = lx.TOP_K, least: float = lx.MIN_SCORE) -> DataFrame:
    """WIN1: pairs of at least `least` that are among the top_k of either end; equal scores go by the other end's id.

    Each pair goes to both its ends with all its columns, so the pairs are computed once and nothing is joined back.
    """
    ends = _ends(pairs.where(F.col("score") >= least))
    rank = F.row_number().over(Window.partitionBy("__end.node").orderBy(F.desc("score"), "__end.other"))
    return ends.withColumn("__r", rank).where(F.col("__r") <= top_k).drop("__end", "__r").dropDuplicates(["a", "b"])


def edges(facts: DataFrame, n_facts: Column | None = None, hub: int = lx.HUB, top_k: int = lx.TOP_K, least: float = lx.MIN_SCORE, gate: bool = False, similarity=None) -> DataFrame:  # noqa: ANN001
    """Postings to labelled edges: a, b, score, label, cross_doc and the score's parts. gate: only pairs that share an entity, JN16, after the top-k."""
    n = n_facts if n_facts is not None else F.lit(facts.count())
    if similarity or "vec" in facts.columns:
        pairs = promising(rated(facts, n, hub), facts, top_k, least, similarity)
    else:
        pairs = rated(facts, n, hub, least).where(F.col("base") >= least).withColumn("text", F.lit(0.0)).withColumn("score", F.col("base"))
    # Columns of fixed width only, so that pairs are aggregated by hash; the label gets its name at the end.
    label = _label_no(F.col("fa.polarity"), F.col("fb.polarity")).alias("label")
    slim = pairs.select("a", "b", "score", label, (F.col("fa.doc_id") != F.col("fb.doc_id")).alias("cross_doc"), *[F.round(c, 3).alias(c) for c in ("entity", "time", "text", "same")], "share_entity")
    pairs = sparsified(slim, top_k, least).withColumn("label", _named(F.col("label")))
    return (pairs.where("share_entity") if gate else pairs).drop("share_entity")


def clusters(links: DataFrame) -> DataFrame:
    """AGG17: (node, cluster): connected components of (a, b), named by their smallest node.

    Rounds of two star operations: every node links its larger neighbours, then its smaller ones, to the smallest node
    it knows. Each round rewrites the edges, so chains collapse in a logarithmic number of rounds. They are at rest when each
    edge leads to the smallest node of a star: no node has two of them, or one while it is another's.
    """
    links = settled(links.select("a", "b"))
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    now = settled(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        around = pairs.select("u", "v").union(pairs.select("v", "u")) if larger else pairs
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        joined = around.join(least, "u")
        if larger:
            return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    def open_(pairs: DataFrame) -> bool:
        ends = pairs.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(pairs.select("v", F.lit(0), F.lit(1)))
        at = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
        return at.where("out + `in` > 1 and out > 0").limit(1).count() > 0

    while open_(now):
        now = settled(star(star(now, True), False))
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").groupBy("node").agg(F.coalesce(F.min("root"), F.first("node")).alias("cluster"))


def superseded(temporal: DataFrame, subject: list[str]) -> DataFrame:
    """WIN9: of two or more dated conflicting or supporting edges of a subject, all but the latest are invalidated by it.

    Adds invalidated_by and invalidated_at. temporal: edge_id, edge_type, recorded_at and the subject's columns.
    """
    counts = F.col("edge_type").isin("SUPPORTS", "POTENTIAL_CONFLICT") & F.col("recorded_at").isNotNull()
    w = Window.partitionBy(*subject)
    latest = F.max(F.when(counts, F.struct("recorded_at", "edge_id"))).over(w)
    n = F.count(F.when(counts, 1)).over(w)
    out = temporal.withColumn("__l", latest).withColumn("__n", n)
    hit = counts & (F.col("__n") >= 2) & (F.col("edge_id") != F.col("__l.edge_id"))
    return out.withColumn("invalidated_by", F.when(hit, F.col("__l.edge_id"))).withColumn("invalidated_at", F.when(hit, F.col("__l.recorded_at"))).drop("__l", "__n")


def nodes_and_edges(facts: DataFrame, edge_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PRJ6: rows for export: nodes (id, type, label) and edges (id, source, target, label)."""
    shown = F.coalesce("label", F.col("amount"), F.initcap("type")) if "label" in facts.columns else F.coalesce(F.col("amount"), F.initcap("type"))
    nodes = facts.select(F.concat(F.lit("evt_"), F.col("fact_id").cast("string")).alias("id"), "type", shown.alias("label"))
    out = edge_rows.select(F.concat(F.lit("e_"), F.col("a").cast("string"), F.lit("_"), F.col("b").cast("string")).alias("id"), F.concat(F.lit("evt_"), F.col("a").cast("string")).alias("source"), F.concat(F.lit("evt_"), F.col("b").cast("string")).alias("target"), "label")
    return nodes, out
