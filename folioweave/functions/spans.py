"""Regex matches with character offsets, natively.

Each match is fenced by control characters that texts don't hold (they are blanked first, so offsets stay), the text
is cut at the opening fence, and folds over runs of pieces add up lengths. A fold copies what it has found so far, so the
runs are as long as there are runs, which keeps many matches cheap. No Python worker is involved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<raw:string,start:int,end:int>>"


def spans(text: Column, pattern: str) -> Column:
    """array<struct<raw, start, end>>, half-open, in code points; empty for a null text."""
    clean = F.translate(F.coalesce(text, F.lit("")), "\u0001\u0002", "  ")
    cut = F.split(F.regexp_replace(clean, pattern, "\u0001$0\u0002"), "\u0001")
    # Lambdas take the pieces as a variable: inside them an expression would be computed for every run.
    return F.transform(F.array(cut), _placed)[0]


def _placed(pieces: Column) -> Column:
    n = F.size(pieces) - 1
    long = F.ceil(F.sqrt(n)).cast("int")
    firsts = F.when(n > 0, F.sequence(F.lit(0), n - 1, long)).otherwise(F.array().cast("array<int>"))
    none = F.array().cast(SPAN)

    def step(acc: Column, piece: Column) -> Column:
        raw = F.substring_index(piece, "\u0002", 1)
        one = F.struct(raw.alias("raw"), acc["at"].alias("start"), (acc["at"] + F.length(raw)).alias("end"))
        return F.struct((acc["at"] + F.length(piece) - 1).alias("at"), F.concat(acc["found"], F.array(one)).alias("found"))

    def run(acc: Column, first: Column) -> Column:
        start = F.struct(F.element_at(acc, -1)["at"].alias("at"), none.alias("found"))
        return F.concat(acc, F.array(F.aggregate(F.slice(pieces, first + 2, long), start, step)))

    start = F.array(F.struct(F.length(pieces[0]).alias("at"), none.alias("found")))
    return F.aggregate(firsts, start, run, lambda acc: F.flatten(F.transform(acc, lambda r: r["found"])))


def line_starts(pieces: Column) -> Column:
    """array<struct<line, start>>: lines, of a text cut at line feeds, with the offsets at which they start. Folds over runs of lines, as above."""
    return F.transform(F.array(pieces), _started)[0]


def _started(pieces: Column) -> Column:
    n = F.size(pieces)
    long = F.ceil(F.sqrt(n)).cast("int")
    none = F.array().cast("array<struct<line:string,start:int>>")

    def step(acc: Column, line: Column) -> Column:
        one = F.struct(line.alias("line"), acc["at"].alias("start"))
        return F.struct((acc["at"] + F.length(line) + 1).alias("at"), F.concat(acc["found"], F.array(one)).alias("found"))

    def run(acc: Column, first: Column) -> Column:
        start = F.struct(F.element_at(acc, -1)["at"].alias("at"), none.alias("found"))
        return F.concat(acc, F.array(F.aggregate(F.slice(pieces, first + 1, long), start, step)))

    start = F.array(F.struct(F.lit(0).alias("at"), none.alias("found")))
    firsts = F.when(n > 0, F.sequence(F.lit(0), n - 1, long)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(firsts, start, run, lambda acc: F.flatten(F.transform(acc, lambda r: r["found"])))


def exploded(units: DataFrame, pattern: str, kind: str, keys: list[str], text: str = "text") -> DataFrame:
    """One row per match: keys, kind, raw, start, end. Units without a match give none."""
    one = units.select(*keys, F.explode(spans(F.col(text), pattern)).alias("m"))
    return one.select(*keys, F.lit(kind).alias("kind"), "m.raw", "m.start", "m.end")
