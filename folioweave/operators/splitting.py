"""Sentences by what a collection itself says of its abbreviations.

A word that nearly always stands with a full stop is an abbreviation, not the end of many sentences. How much likelier its
counts are if it is one (a stop in 99 of 100 places) than if stops fall on it as on any word is a log-likelihood ratio; short
words with inner stops count for more, and each place without a stop for less. All of it comes from one aggregate over
the words of all texts. In the same way a word opens sentences if it stands after an end far oftener than elsewhere: after
an abbreviation, only such a word, with a capital, starts a new sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.functions.spans import spans
from folioweave.session import settled

# Of the log-likelihood test.
ABBREVIATED, STOP_RATE, OPENS, LEAST_OPENINGS = 0.3, 0.99, 30.0, 5


#: Brackets and quotes around the words of a text; like `$`, a word's end may have a last line separator behind it that is no blank.
_AROUND = r"(?<!\S)[\"'(\[“‘]+|[\"')\],;:”’]+(?=[\u0085\u2028\u2029]?(?!\S))"


def _tokens(text: Column) -> Column:
    """Words between blanks without brackets and quotes around them. The whole text is cleared of these at once, as a look at each word of an array isn't compiled."""
    return F.filter(F.split(F.regexp_replace(text, _AROUND, ""), r"\s+"), lambda w: w != "")


def _type(token: Column) -> Column:
    """Lower case, without a last stop; all numbers are one type."""
    bare = F.regexp_replace(F.lower(token), r"\.$", "")
    return F.when(bare.rlike(r"^[0-9][0-9.,]*$"), "#").otherwise(bare)


def _ratio(with_: Column, without: Column, usual: Column, alternative: Column) -> Column:
    """Twice the log of how much likelier the counts are at the alternative rate than at the usual one."""
    return 2 * (with_ * F.log(alternative / usual) + without * F.log((1 - alternative) / (1 - usual)))


def abbreviations(units: DataFrame, text: str = "text", least: float = ABBREVIATED) -> DataFrame:
    """type, n_stop, n_plain, score, abbreviated: the words of all texts that ever end with a stop, by whether they are abbreviations.

    type: lower case without the stop. Null and empty texts have no words. Words of digits count together and are none.
    """
    words = units.select(F.explode(_tokens(F.col(text))).alias("w")).select(_type(F.col("w")).alias("type"), F.col("w").endswith(".").alias("stop"))
    # The counts are kept, as all that follows reads them.
    counts = settled(words.where("type <> ''").groupBy("type").agg(F.count_if("stop").alias("n_stop"), F.count_if(~F.col("stop")).alias("n_plain")))
    n_stop, n = counts.agg(F.coalesce(F.sum("n_stop"), F.lit(0)), F.coalesce(F.sum(F.col("n_stop") + F.col("n_plain")), F.lit(0))).first()
    if not 0 < n_stop < n:  # no stops, or nothing but words with stops, tell nothing
        return counts.where("false").withColumn("score", F.lit(0.0)).withColumn("abbreviated", F.lit(False))
    letters = F.length(F.regexp_replace("type", r"\.", ""))
    inner = F.length("type") - letters + 1
    ratio = _ratio(F.col("n_stop"), F.col("n_plain"), F.lit(n_stop / n), F.lit(STOP_RATE))
    score = ratio * F.exp(-letters.cast("double")) * inner * F.pow(F.greatest(letters, F.lit(1)).cast("double"), -F.col("n_plain").cast("double"))
    known = counts.where("n_stop > 0").withColumn("score", score)
    return known.withColumn("abbreviated", (F.col("score") >= least) & F.col("type").rlike(r"\p{L}"))


def openers(units: DataFrame, found: DataFrame, text: str = "text", least: float = OPENS, at_least: int = LEAST_OPENINGS) -> DataFrame:
    """type: words that stand after the end of a sentence far oftener than elsewhere. found: as of abbreviations()."""
    tokens = units.select(_tokens(F.col(text)).alias("t"))
    pairs = tokens.select(F.explode(F.arrays_zip(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))).alias("a"), F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))).alias("b"))).alias("p")).select("p.a", "p.b")
    # What stands before matters only where a sentence may open, so few different pairs are left to look at.
    before = F.when(F.col("a").rlike(r"[.!?]$") & F.col("b").rlike(r"^\p{Lu}"), F.col("a"))
    said = pairs.groupBy(before.alias("a"), "b").agg(F.count(F.lit(1)).alias("n"))
    rows = said.select(_type(F.col("a")).alias("type"), F.col("a").isNotNull().alias("may"), _type(F.col("b")).alias("next"), "n")
    short = found.where("abbreviated").select("type", F.lit(True).alias("short"))
    after = rows.join(short, "type", "left").select("next", "n", (F.col("may") & F.col("short").isNull()).alias("opens"))
    counts = settled(after.groupBy("next").agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name) for c, name in ((F.col("opens"), "n_open"), (~F.col("opens"), "n_other"))]))
    n_open, n = counts.agg(F.coalesce(F.sum("n_open"), F.lit(0)), F.coalesce(F.sum(F.col("n_open") + F.col("n_other")), F.lit(0))).first()
    if not 0 < n_open < n:
        return counts.where("false").select(F.col("next").alias("type"))
    own = F.least(F.greatest(F.col("n_open") / (F.col("n_open") + F.col("n_other")), F.lit(1e-9)), F.lit(1 - 1e-9))
    ratio = _ratio(F.col("n_open"), F.col("n_other"), F.lit(n_open / n), own)
    return counts.where((own > n_open / n) & (ratio >= least) & (F.col("n_open") >= at_least)).select(F.col("next").alias("type"))


def split(units: DataFrame, keys: list[str], found: DataFrame, opening: DataFrame | None = None, text: str = "text") -> DataFrame:
    """SEG10: keys, sent_no from 0, start, end, sentence, by learned abbreviations; keys name a unit.

    A sentence ends at a full stop, question or exclamation mark before white space and a capital or digit, but not at the stop
    of an abbreviation or of a single letter, unless a known opener with a capital follows. All-blank texts have none.
    """
    clean = F.coalesce(F.col(text), F.lit(""))
    ends = units.select(*keys, F.explode(spans(clean, r"[^\s]+[.!?][\"')\]”’]*\s+(?=[A-Z0-9])")).alias("m"))
    token = F.regexp_extract(F.col("m.raw"), r"^(\S+)", 1)
    bare = F.regexp_replace(token, r"^[\"'(\[“‘]+|[\"')\]”’]+$", "")
    at = ends.select(*keys, F.col("m.end").alias("cut"), (F.col("m.start") + F.length(token)).alias("stop"), _type(bare).alias("type"), bare.endswith(".").alias("dot"))
    nexts = units.select(*keys, F.explode(spans(clean, r"[A-Z0-9][^\s]*")).alias("n")).select(*keys, F.col("n.start").alias("cut"), _type(F.regexp_replace("n.raw", r"[\"')\],;:”’.!?]+$", "")).alias("next"))
    short = found.where("abbreviated").select("type", F.lit(True).alias("short"))
    held = F.col("dot") & (F.coalesce("short", F.lit(False)) | F.col("type").rlike(r"^\p{L}$"))
    rows = at.join(short, "type", "left").withColumn("held", held)
    if opening is not None:
        rows = rows.join(nexts, [*keys, "cut"], "left").join(opening.select(F.col("type").alias("next"), F.lit(True).alias("opens")), "next", "left")
        rows = rows.withColumn("held", F.col("held") & F.col("opens").isNull())
    cuts = rows.where("NOT held").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("cut", "stop"))).alias("c"))
    joined = units.select(*keys, clean.alias("__t")).join(cuts, keys, "left")
    none = F.array().cast("array<struct<cut:int,stop:int>>")
    c = F.coalesce("c", none)
    starts = F.concat(F.array(F.lit(0)), F.transform(c, lambda x: x["cut"]))
    stops = F.concat(F.transform(c, lambda x: x["stop"]), F.array(F.length("__t")))
    pieces = F.filter(F.transform(F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: F.struct(p["a"].alias("a"), F.substring(F.col("__t"), p["a"] + 1, p["b"] - p["a"]).alias("s"))), lambda p: F.trim(F.regexp_replace(p["s"], r"\s", " ")) != "")
    out = joined.select(*keys, F.posexplode(pieces).alias("sent_no", "p"))
    lead = F.length("p.s") - F.length(F.regexp_replace("p.s", r"^\s+", ""))
    sentence = F.regexp_replace("p.s", r"^\s+|\s+$", "")
    return out.select(*keys, "sent_no", (F.col("p.a") + lead).cast("int").alias("start"), (F.col("p.a") + lead + F.length(sentence)).cast("int").alias("end"), sentence.alias("sentence"))
