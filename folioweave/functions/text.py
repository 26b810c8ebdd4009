"""Scalar functions as Column expressions: names, amounts, keys, trimming."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioweave import lexicons as lx
from folioweave.functions.fuzzy import Phrases


def any_of(text: Column, phrases: tuple[str, ...] | list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def whole_words(words: list[str]) -> str:
    return r"(?:^|[^a-z])(?:" + "|".join(sorted(set(words))) + r")(?:[^a-z]|$)"


def normal_name(name: Column) -> Column:
    """FN1, FN2: a name's key: without legal forms, other than a-z and 0-9, one-letter words and a leading article."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(name), lx.LEGAL_SUFFIX, " "), "[^a-z0-9 ]", " ")
    words = F.filter(F.split(bare, " +"), lambda w: F.length(w) > 1)
    return F.regexp_replace(F.array_join(words, " "), "^the ", "")


def amount_value(raw: Column) -> Column:
    """FN5: whole rupees of a figure with an optional scale; null if there is none, or none that a long can hold."""
    figure = F.regexp_replace(F.regexp_extract(raw, lx.AMOUNT_PARTS, 1), ",", "").try_cast("double")
    unit = F.lower(F.regexp_extract(raw, lx.AMOUNT_PARTS, 2))
    scale = F.when(unit.startswith("lakh"), 1e5).when(unit.startswith("crore"), 1e7).otherwise(1.0)
    return F.bround(figure * scale).try_cast("long")


def words_value(text: Column) -> Column:
    """FN7: rupees of an amount in words: a hundred multiplies what stands before it, larger scales add; null if nothing or zero."""
    letters = F.regexp_replace(F.lower(text), r"[^a-z\s]", " ")
    known = {w: (n, 0) for w, n in lx.NUMBER_WORDS.items()} | {w: (0, s) for w, s in lx.SCALE_WORDS.items()}
    values = F.create_map(*[x for w, (n, s) in known.items() for x in (F.lit(w), F.struct(F.lit(n).cast("long").alias("n"), F.lit(s).cast("long").alias("s")))])
    found = F.filter(F.transform(F.split(letters, r"\s+"), lambda w: F.try_element_at(values, w)), lambda v: v.isNotNull())

    def step(acc: Column, v: Column) -> Column:
        now = F.when(acc["now"] == 0, F.lit(1).cast("long")).otherwise(acc["now"])
        return (
            F.when(v["s"] == 0, F.struct(acc["total"].alias("total"), (acc["now"] + v["n"]).alias("now")))
            .when(v["s"] == 100, F.struct(acc["total"].alias("total"), (now * 100).alias("now")))
            .otherwise(F.struct((acc["total"] + now * v["s"]).alias("total"), F.lit(0).cast("long").alias("now")))
        )

    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("now"))
    total = F.aggregate(found, zero, step, lambda acc: acc["total"] + acc["now"])
    return F.nullif(total, F.lit(0).cast("long"))


def amount_key(raw: Column) -> Column:
    """FN6: all digits; null if there is none."""
    return F.nullif(F.regexp_replace(raw, "[^0-9]", ""), F.lit(""))


def provision_key(raw: Column) -> Column:
    """FN8: `act::SECTION`, `section::SECTION`, or null without a section."""
    section = F.upper(F.regexp_extract(raw, lx.SECTION_NUMBER, 1))
    act = F.regexp_extract(raw, lx.ACT_OF, 1)
    act = F.lower(F.trim(F.regexp_replace(act, r"\s+", " ")))
    return F.when(section == "", F.lit(None)).when(act == "", F.concat(F.lit("section::"), section)).otherwise(F.concat(act, F.lit("::"), section))


def act_without_year(act: Column) -> Column:
    """FN10."""
    return F.trim(F.regexp_replace(act, r",?\s*\d{4}\s*$", ""))


def symbol_key(kind: Column, text: Column) -> Column:
    """FN9: a kind's key of a text; null if it has none."""
    name = F.nullif(normal_name(text), F.lit(""))
    amount = F.coalesce(amount_value(text), words_value(text)).cast("string")
    case = F.nullif(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), F.lit(""))
    value = F.when(kind == "AMOUNT", amount).when(kind == "PROVISION", provision_key(text)).when(kind == "CASE_NUMBER", case).otherwise(name)
    return F.when(value.isNotNull(), F.concat(kind, F.lit(":"), value))


def date_value(raw: Column) -> Column:
    """FN11: the date of a mention: ISO as it stands, otherwise day before month, months by their first three letters.

    Only forms that are stated here are read; days that can't be are null. Two digits are a year from 1969 to 2068.
    """
    tidy = F.trim(F.regexp_replace(F.regexp_replace(raw, r"(?i)(\d)(?:st|nd|rd|th)\b", "$1"), r"[\s.,/\-]+", " "))
    names = F.create_map(*[x for i, m in enumerate(lx.MONTHS.split("|"), 1) for x in (F.lit(m.lower()), F.lit(f"{i:02d}"))])
    two = lambda c: F.lpad(c, 2, "0")

    def read(at: Column) -> Column:
        raw, tidy = at["raw"], at["tidy"]
        part = lambda p, g: F.nullif(F.regexp_extract(tidy, p, g), F.lit(""))
        month = F.lower(F.regexp_extract(tidy, r"(?i)\b([A-Z]{3})[A-Z]*\b", 1))
        iso = F.when(raw.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.concat_ws("-", part(r"^(\d{4}) ", 1), two(part(r"^\d{4} (\d+) ", 1)), two(part(r"(\d+)$", 1))))
        named = F.when(month != "", F.concat_ws("-", part(r"(\d{4})$", 1), F.try_element_at(names, month), two(part(r"\b(\d{1,2})\b", 1))))
        numeric = F.when(tidy.rlike(r"^\d{1,2} \d{1,2} \d{4}$"), F.concat_ws("-", part(r"(\d{4})$", 1), two(part(r"^\d+ (\d+) ", 1)), two(part(r"^(\d+) ", 1))))
        short = part(r"^\d{1,2} \d{1,2} (\d{2})$", 1)
        century = F.when(short.cast("int") < 69, "20").otherwise("19")
        brief = F.when(short.isNotNull(), F.concat_ws("-", F.concat(century, short), two(part(r"^\d+ (\d+) ", 1)), two(part(r"^(\d+) ", 1))))
        return F.try_to_date(F.coalesce(iso, named, numeric, brief), "yyyy-MM-dd")

    # A variable, as the tidied text is looked at many times.
    return F.transform(F.array(F.struct(raw.alias("raw"), tidy.alias("tidy"))), read)[0]


def trimmed(text: Column, most: int) -> Column:
    """PRJ1: at most `most` characters, cut after the last sentence in range, else before the last blank, if that keeps over 40 %."""
    head = F.substring(text, 1, most)
    # The last ". " that lies wholly inside the head, and the last blank, counted from 0.
    stop = F.length(head) - F.instr(F.reverse(head), " .") - 1
    blank = F.length(head) - F.instr(F.reverse(head), " ")
    has_stop, has_blank = F.instr(F.reverse(head), " .") > 0, F.instr(F.reverse(head), " ") > 0
    return (
        F.when(F.length(text) <= most, text)
        .when(has_stop & (stop > most * 0.4), F.left(text, (stop + 1).cast("int")))
        .when(has_blank & (blank > most * 0.4), F.left(text, blank.cast("int")))
        .otherwise(head)
    )


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def label(text: Column, most: int = lx.LABEL, more: str = "…") -> Column:
    """PRJ3: white space collapsed, cut at `most`."""
    flat = one_line(text)
    return F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most)), F.lit(more))).otherwise(flat)


def preview(text: Column, most: int) -> Column:
    """PRJ4: cut after the last sentence mark before a blank, if that keeps over 35 %, else at the last blank, with an ellipsis."""
    head = F.left(text, F.lit(most))
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?])\s", 1)
    word = F.regexp_extract(head, r"(?s)^(.*)\s", 1)
    return F.when(F.length(text) <= most, text).when(F.length(sentence) > most * 0.35, sentence).otherwise(F.concat(F.when(word != "", word).otherwise(head), F.lit("…")))


def context(text: Column, start: Column, end: Column, reach: int = lx.CONTEXT) -> Column:
    """PRJ2: the text around a span, and where it starts."""
    lo = F.greatest(start - reach, F.lit(0)).cast("int")
    hi = F.least(end + reach, F.length(text)).cast("int")
    return F.struct(F.substring(text, lo + 1, hi - lo).alias("context"), lo.alias("context_start"))


def polarity(text: Column) -> Column:
    """EVT14: by phrases, else by the verbs' inflections."""
    low = F.lower(text)
    denies = whole_words([f for v in lx.DENIAL_VERBS for f in lx.inflections(v)])
    asserts = whole_words([f for v in lx.ASSERTION_VERBS for f in lx.inflections(v)])
    return F.when(any_of(low, lx.DENIALS), "DENIES").when(any_of(low, lx.ASSERTIONS), "ASSERTS").when(low.rlike(denies), "DENIES").when(low.rlike(asserts), "ASSERTS").otherwise("NEUTRAL")


def role_cue(text: Column, cues: dict[str, tuple[str, ...]] = lx.ROLE_CUES) -> Column:
    """EVT16: the first role with a cue in the text, word for word or, for cues of FUZZY_CUE_MIN letters or more, nearly so.

    Wording is looked for natively; Python, in Arrow batches, only sees whether an earlier role has a cue nearly.
    """
    low, roles = F.lower(text), list(cues)
    long = [(c, i) for i, r in enumerate(roles) for c in cues[r] if len(c) >= lx.FUZZY_CUE_MIN]
    exact = F.lit(len(roles))
    for i in reversed(range(len(roles))):
        exact = F.when(any_of(low, cues[roles[i]]), i).otherwise(exact)

    @F.pandas_udf("int")
    def nearly(texts: pd.Series, before: pd.Series) -> pd.Series:
        phrases, has = Phrases([c for c, _ in long], lx.FUZZY_CUE), [bool(t and t.strip()) for t in texts]
        found = iter(phrases.near_each([t for t, h in zip(texts, has, strict=True) if h]))
        return pd.Series([min([n, *(long[k][1] for k in next(found))]) if h else n for h, n in zip(has, before, strict=True)], dtype="int32")

    # Without earlier roles there is nothing to look for.
    first = nearly(F.when(exact > 0, low), exact)
    return F.try_element_at(F.array(*[F.lit(r) for r in roles]), first + 1)


def is_generic_name(kind: Column, name: Column) -> Column:
    """FLT1 to FLT3: names that are no entities: common ones, reporter citations, names over a line break."""
    common = kind.isin("PERSON", "ORG", "GPE") & F.lower(F.trim(name)).isin(*lx.GENERIC_NAMES)
    return common | name.rlike(lx.REPORTER_CITATION) | F.contains(name, F.lit("\n"))


def long_words(text: Column) -> Column:
    """The distinct words of more than three letters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 3))


def overlap(a: Column, b: Column) -> Column:
    """FN16: shared words of more than three letters over the smaller number of them."""
    x, y = long_words(a), long_words(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(F.lit(0.0))


def html_escaped(text: Column) -> Column:
    """FN18."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def short_name(name: Column) -> Column:
    """FN19: a file's name without extension, underscores as blanks."""
    return F.replace(F.regexp_replace(name, r"\.[^.]+$", ""), F.lit("_"), F.lit(" "))


def highlighted(text: Column, start: Column, end: Column, raw: Column) -> Column:
    """FN17: the text with the span marked: at its offsets if they hold the raw text, else at its first place, else unmarked."""
    at = F.when(F.substring(text, (start + 1).cast("int"), (end - start).cast("int")) == raw, start + 1).otherwise(F.position(raw, text))
    marked = F.concat(F.left(text, (at - 1).cast("int")), F.lit("<mark>"), raw, F.lit("</mark>"), F.substr(text, (at + F.length(raw)).cast("int")))
    return F.when(at > 0, marked).otherwise(text)
