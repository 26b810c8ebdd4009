"""A similarity join of names by token_set_ratio, with an index of any size.

Names are sets of words. A pair reaches `least` in one of two ways, and each leaves something rare in common:

- the words of one side are nearly all among the other's: what is missing has few letters, so of the rarest words of that
  side, as many as have more letters than may be missing, one is in the other side
- the sorted words are nearly the same strings: letters that are put in or left out spoil a bounded number of the bigrams
  inside words, so of the rarest bigrams of either side, as many as may be spoilt and one more, one is in both

So a name only meets names with which it shares one of these; the pairs that meet are compared exactly, and none is lost.
Names with too few bigrams to leave one are met by all names of a length that can reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioweave.functions.fuzzy import similarity, token_set_ratio


def _words(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(name, r"\s+"), lambda w: w != ""))


def _letters(words: Column) -> Column:
    """The length of the words with blanks between."""
    return F.greatest(F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w) + 1) - 1, F.lit(0))


def _marked(names: DataFrame, frequent: DataFrame, least: float) -> DataFrame:
    """name, word, probe: all words, those marked of which one must be shared if nearly all of them are in the other name."""
    rows = names.select("name", "m", F.explode("words").alias("word")).join(frequent, "word", "left").withColumn("often", F.coalesce("often", F.lit(0)))
    before = F.coalesce(F.sum(F.length("word") + 1).over(Window.partitionBy("name").orderBy("often", "word").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    may_lack = F.col("m") * (200 - 2 * least) / (200 - least) + 1e-9
    return rows.select("name", "word", (before <= may_lack).alias("probe"))


def _bigrams(names: DataFrame) -> DataFrame:
    """name, m, gram (with its number among equal ones of the name): pairs of letters inside words."""
    inside = F.flatten(F.transform("words", lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.when(F.length(w) > 1, F.substring(w, i, F.lit(2))))))
    rows = names.select("name", "m", F.posexplode(F.filter(inside, lambda g: g.isNotNull())).alias("at", "g"))
    nth = F.row_number().over(Window.partitionBy("name", "g").orderBy("at"))
    return rows.select("name", "m", F.concat("g", F.lit("\1"), nth.cast("string")).alias("gram"))


def _rare(names: DataFrame, often: DataFrame, least: float) -> DataFrame:
    """name, key: bigrams of which one must be shared, or, of names that may lose all of theirs, the lengths that can reach."""
    slack = 1 - least / 100
    grams = _bigrams(names).join(often, "gram", "left").withColumn("often", F.coalesce("often", F.lit(0)))
    per = Window.partitionBy("name")
    counted = grams.withColumn("G", F.count(F.lit(1)).over(per)).withColumn("r", F.row_number().over(per.orderBy("often", "gram")))
    sizes = names.join(counted.select("name", "G").distinct(), "name", "left").withColumn("G", F.coalesce("G", F.lit(0)))

    def left(n: Column) -> Column:
        """Bigrams that stay at least, against a name of n letters: an omission spoils two, an insertion one."""
        d = (F.col("m") + n) * slack
        return F.col("G") - d - (d + F.col("m") - n) / 2

    low, high = F.col("m") * (1 - slack) / (1 + slack), F.col("m") * (1 + slack) / (1 - slack) if slack < 1 else F.col("m")
    stay = F.ceil(F.least(left(low), left(high)) - 1e-9)
    kept = counted.where((stay >= 1) & (F.col("r") <= F.col("G") - stay + 1)).select("name", F.concat(F.lit("g"), "gram").alias("key"))
    weak = sizes.where(stay < 1).select("name", F.explode(F.sequence(F.floor(low).cast("int"), F.ceil(high).cast("int"))).alias("n"))
    return kept.unionByName(weak.select("name", F.concat(F.lit("n"), F.col("n").cast("string")).alias("key")))


def _all_keys(names: DataFrame) -> DataFrame:
    grams = _bigrams(names).select("name", F.concat(F.lit("g"), "gram").alias("key"))
    return grams.unionByName(names.select("name", F.concat(F.lit("n"), F.col("m").cast("string")).alias("key")))


def token_set_matches(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """a, b, score: all pairs of names (column `name`) of the two sides with token_set_ratio >= least, which is above 0. Null names match nothing."""
    sides = []
    for side in (left, right):
        named = side.select("name").where(F.col("name").isNotNull()).distinct().withColumn("words", _words(F.col("name")))
        sides.append(named.withColumn("m", _letters(F.col("words"))))
    a, b = sides
    words = b.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("often"))
    grams = _bigrams(b).groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    wa, wb = _marked(a, words, least), _marked(b, words, least)
    met = []
    for x, y, key, names in (
        (wa.where("probe"), wb, "word", "ab"), (wa, wb.where("probe"), "word", "ab"),
        (_rare(a, grams, least), _all_keys(b), "key", "ab"), (_all_keys(a), _rare(b, grams, least), "key", "ab"),
    ):
        met.append(x.select(key, F.col("name").alias(names[0])).join(y.select(key, F.col("name").alias(names[1])), key).select("a", "b"))
    pairs = met[0].union(met[1]).union(met[2]).union(met[3]).distinct()
    return pairs.withColumn("score", similarity(token_set_ratio, F.col("a"), F.col("b"))).where(F.col("score") >= least)
