"""Pages to sections, sections to paragraphs, lines and sentences, all with character offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioweave import lexicons as lx
from folioweave.functions.spans import line_starts


def page_kind(text: Column, has_images: Column) -> Column:
    """SRC6."""
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(n < lx.SCANNED_BELOW, "scanned").when((n < lx.HYBRID_BELOW) & has_images, "hybrid").otherwise("digital")


def without_furniture(text: Column) -> Column:
    """SRC11: running footers and signature stamps become a blank."""
    return F.regexp_replace(F.regexp_replace(text, lx.PAGE_FOOTER, " "), lx.SIGNATURE_STAMP, " ")


def lines(units: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """WIN4: keys, line_no from 0, line, and the offset at which it starts; one empty line for an empty text, none for null. A row's own work: nothing is shuffled."""
    return units.select(*keys, F.posexplode(line_starts(F.split(F.col(text), "\n"))).alias("line_no", "__l")).select(*keys, "line_no", "__l.line", "__l.start")


def _headings(text: Column, pattern: str) -> Column:
    """array<struct<offset, heading>> of a page's headed lines, in order; null for a null text."""
    headed = F.filter(line_starts(F.split(text, "\n")), lambda r: F.trim(r["line"]).rlike(pattern))
    return F.transform(headed, lambda r: F.struct(r["start"].alias("offset"), F.trim(r["line"]).alias("heading")))


def headings(pages: DataFrame, pattern: str = lx.HEADING) -> DataFrame:
    """SEG1: doc_id, page_number, heading, offset of headed lines."""
    found = pages.select("doc_id", "page_number", F.explode(_headings(F.col("text"), pattern)).alias("h"))
    return found.select("doc_id", "page_number", "h.heading", "h.offset")


def _toc_lines(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, "\n"), lambda r: r.rlike(lx.TOC_DOTTED) | r.rlike(lx.TOC_COLUMNS))), F.lit(0)).cast("long")


def toc_pages(pages: DataFrame, least: int = lx.TOC_LINES) -> DataFrame:
    """SEG2: pages with enough lines that look like a table of contents."""
    return pages.select("doc_id", "page_number", F.when(F.col("text").isNotNull(), _toc_lines(F.col("text"))).alias("toc_lines")).where(F.col("toc_lines") >= least)


def _scored(rows: DataFrame) -> DataFrame:
    """mode and what it is made of, from has_bookmarks, n_toc_pages, n_headings and __scanned."""
    score = lx.BOOKMARK_WEIGHT * F.col("has_bookmarks").cast("int") + lx.TOC_WEIGHT * F.col("n_toc_pages") + lx.HEADING_WEIGHT * F.col("n_headings")
    need = F.when(F.col("__scanned") > 0.5, lx.NOISY_THRESHOLD).otherwise(lx.STRUCTURE_THRESHOLD)
    return rows.withColumn("structure_score", score).withColumn("mode", F.when(score >= need, "structured").otherwise("fallback"))


def _measured(pages: DataFrame, bookmarks: DataFrame | None, pattern: str) -> DataFrame:
    """pages with __h, their headings, and what the mode of a document counts of each page."""
    rows = pages.withColumn("__h", _headings(F.col("text"), pattern)).withColumn("__toc", (_toc_lines(F.col("text")) >= lx.TOC_LINES).cast("long")).withColumn("__s", (F.col("page_kind") != "digital").cast("double"))
    if bookmarks is None:
        return rows.withColumn("has_bookmarks", F.lit(False))
    return rows.join(bookmarks.select(F.col("doc_id").cast(pages.schema["doc_id"].dataType), "has_bookmarks"), "doc_id", "left").fillna({"has_bookmarks": False})


_OF_DOCUMENT = {"n_headings": lambda: F.sum(F.greatest(F.size("__h"), F.lit(0)).cast("long")), "n_toc_pages": lambda: F.sum("__toc"), "__scanned": lambda: F.avg("__s"), "has_bookmarks": lambda: F.max("has_bookmarks")}


def structure(pages: DataFrame, bookmarks: DataFrame | None = None, pattern: str = lx.HEADING) -> DataFrame:
    """SEG3: doc_id, has_bookmarks, n_toc_pages, n_headings, structure_score, scanned_ratio, mode."""
    rows = _scored(_measured(pages, bookmarks, pattern).groupBy("doc_id").agg(*[f().alias(c) for c, f in _OF_DOCUMENT.items()]))
    return rows.select("doc_id", "has_bookmarks", "n_toc_pages", "n_headings", "structure_score", F.round("__scanned", 2).alias("scanned_ratio"), "mode")


def sections(pages: DataFrame, bookmarks: DataFrame | None = None, pattern: str = lx.HEADING) -> DataFrame:
    """SEG4, SEG5, SEG7: doc_id, section_no, section_label, detected, text, page_offsets.

    A structured document starts a section at each heading. A page with several headings is cut at them, and what
    stands before its first one is left out, as is an all-blank cut. Other documents have a section per page. Headings
    are found in the rows of pages, so pages are shuffled once, by document.
    """
    doc = Window.partitionBy("doc_id")
    measured = _measured(pages, bookmarks, pattern)
    for c, f in _OF_DOCUMENT.items():
        measured = measured.withColumn(c, f().over(doc))
    marked = _scored(measured).withColumn("headed", (F.col("mode") == "structured") & (F.col("n_headings") > 0))
    many = F.col("headed") & (F.size("__h") > 1)
    cuts = F.transform("__h", lambda h, i: F.struct(h["heading"].alias("heading"), F.substring(F.col("text"), h["offset"] + 1, F.coalesce(F.try_element_at(F.col("__h"), i + 2)["offset"], F.length("text")) - h["offset"]).alias("text")))
    whole = F.array(F.struct(F.when(F.col("headed"), F.try_element_at("__h", F.lit(1))["heading"]).alias("heading"), F.col("text").alias("text")))
    parts = marked.select("doc_id", "page_number", "headed", F.posexplode(F.when(many, cuts).otherwise(whole)).alias("cut", "c")).select("doc_id", "page_number", "headed", "cut", "c.heading", "c.text")
    parts = parts.where((F.col("cut") == 0) & F.col("heading").isNull() | ~F.col("headed") | (F.trim(F.regexp_replace("text", r"\s", " ")) != ""))
    order = Window.partitionBy("doc_id").orderBy("page_number", "cut")
    opens = F.col("heading").isNotNull() | ~F.col("headed") | (F.row_number().over(order) == 1)
    numbered = parts.withColumn("section_no", F.sum(opens.cast("int")).over(order)).withColumn("__label", F.when(~F.col("headed"), F.concat(F.lit("p."), F.col("page_number").cast("string"))).otherwise(F.coalesce("heading", F.lit("Document"))))
    in_section = Window.partitionBy("doc_id", "section_no").orderBy("page_number", "cut").rowsBetween(Window.unboundedPreceding, -1)
    placed = numbered.withColumn("__at", F.coalesce(F.sum(F.length("text") + 1).over(in_section), F.lit(0)).cast("int"))
    gathered = placed.groupBy("doc_id", "section_no").agg(F.sort_array(F.collect_list(F.struct("page_number", "cut", "text", F.col("__at").alias("at"), F.col("__label").alias("label"), "headed"))).alias("p"))
    return gathered.select(
        "doc_id",
        F.col("section_no").cast("int").alias("section_no"),
        F.col("p")[0]["label"].alias("section_label"),
        F.col("p")[0]["headed"].alias("detected"),
        F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"),
        F.transform("p", lambda x: F.struct(x["at"].alias("start"), (x["at"] + F.length(x["text"])).alias("end"), x["page_number"].alias("page"))).alias("page_offsets"),
    )


def layered(pages: DataFrame, bookmarks: DataFrame | None = None, pattern: str = lx.HEADING) -> DataFrame:
    """SEG6: sections with the tier that found them; the only one here is that of text patterns."""
    return sections(pages, bookmarks, pattern).withColumn("tier", F.lit("legacy_text_patterns"))


def page_at(offset: Column, page_offsets: Column) -> Column:
    """SEG8: the page whose range holds the offset, else the last page; null without pages."""
    hit = F.filter(page_offsets, lambda r: (r["start"] <= offset) & (offset < r["end"]))
    return F.coalesce(F.try_element_at(hit, F.lit(1))["page"], F.try_element_at(page_offsets, F.lit(-1))["page"])


def paragraphs(units: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """SEG9: keys, para_no from 0, char_start, char_end, paragraph. Numbered paragraphs, or blocks between blank lines if there is one at most."""
    # Of a line only what is asked of it is sorted, not its letters.
    full = (F.trim(F.regexp_replace("line", r"\s", " ")) != "").cast("int")
    rows = lines(units, keys, text).select(*keys, "line_no", "start", F.length("line").alias("__len"), full.alias("__full"), F.col("line").rlike(lx.NUMBERED_PARAGRAPH).alias("__headed"))
    rows = rows.withColumn("last", F.lead("line_no").over(Window.partitionBy(*keys).orderBy("line_no")).isNull())
    w = Window.partitionBy(*keys).orderBy("line_no")
    # A numbered line opens a paragraph if something stands between it and the last opening; what matters is only whether anything stood before at all.
    rows = rows.withColumn("__before", F.coalesce(F.max("__full").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("__opens", (F.col("__headed") & (F.col("__before") > 0)).cast("int"))
    rows = rows.withColumn("__no", F.sum("__opens").over(w))
    blocks = rows.groupBy(*keys, "__no").agg(F.min("start").alias("char_start"), F.max(F.col("start") + F.col("__len") + F.when(F.col("last"), 0).otherwise(1)).alias("char_end"), F.max("__full").alias("__some"))
    blocks = blocks.where(F.col("__some") > 0).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    numbered = blocks.where("__n > 1").select(*keys, "char_start", "char_end")
    # Blocks between blank lines: a line starts a block if the line before it is blank.
    several = blocks.where("__n > 1").select(*keys).distinct()
    plain = rows.join(several, keys, "left_anti")
    prev = F.coalesce(F.lag("__full").over(w), F.lit(0))
    plain = plain.withColumn("__b", F.sum(((F.col("__full") == 1) & (prev == 0)).cast("int")).over(w)).where("__full = 1")
    loose = plain.groupBy(*keys, "__b").agg(F.min("start").alias("char_start"), F.max(F.col("start") + F.col("__len")).alias("char_end")).select(*keys, "char_start", "char_end")
    both = numbered.unionByName(loose).withColumn("para_no", (F.row_number().over(Window.partitionBy(*keys).orderBy("char_start")) - 1).cast("int"))
    # Both sides grow with the texts, and what follows is to have as many tasks as the shuffle: never broadcast.
    return both.join(units.select(*keys, F.col(text).alias("__text")).hint("merge"), keys).select(*keys, "para_no", "char_start", "char_end", F.substring(F.col("__text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")).alias("paragraph"))


_BREAK = re.compile(lx.SENTENCE_BREAK)
_ABBREVIATED = re.compile(r"\b(?:" + "|".join(map(re.escape, lx.ABBREVIATIONS)) + r"|[A-Za-z])\.$", re.I)
#: No match of it begins further from the end.
_ABBREVIATED_MOST = max(map(len, lx.ABBREVIATIONS)) + 1


def _abbreviated(piece: str) -> bool:
    """Whether a stripped piece ends with an abbreviation or an initial; only its end is looked at."""
    return piece.endswith(".") and _ABBREVIATED.search(piece, max(0, len(piece) - _ABBREVIATED_MOST)) is not None


def sentence_spans(paragraph: str, least: int = lx.MIN_SENTENCE) -> list[tuple[int, int]]:
    """SEG10: spans of whole sentences. A break after an abbreviation or an initial is none, and short pieces join what follows (the last one, what precedes)."""
    edges = [0]
    for m in _BREAK.finditer(paragraph):
        edges += [m.start(), m.end()]
    edges.append(len(paragraph))
    joined: list[list[int]] = []
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        if not paragraph[a:b].strip():
            continue
        if joined and _abbreviated(paragraph[joined[-1][0] : joined[-1][1]].strip()):
            joined[-1][1] = b
        else:
            joined.append([a, b])
    long: list[list[int]] = []
    pending: int | None = None
    for a, b in joined:
        pending = a if pending is None else pending
        if b - pending >= least:
            long.append([pending, b])
            pending = None
    if pending is not None:
        if long:
            long[-1][1] = joined[-1][1]
        else:
            long.append([pending, joined[-1][1]])
    out = []
    for a, b in long:
        piece = paragraph[a:b]
        if piece.strip():
            a += len(piece) - len(piece.lstrip())
            out.append((a, a + len(piece.strip())))
    return out


def sentences(units: DataFrame, keys: list[str], text: str = "paragraph") -> DataFrame:
    """keys, sent_no from 0, start, end (in the unit), sentence; two ordered folds, so in Arrow batches."""
    names = [f.name for f in units.select(*keys).schema]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in units.select(*keys).schema) + ", sent_no int, start int, end int, sentence string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of: list[int] = []
            rows: list[tuple] = []
            for r, t in enumerate(batch.column(len(keys)).to_pylist()):
                for i, (a, b) in enumerate(sentence_spans(t) if t else ()):
                    of.append(r)
                    rows.append((i, a, b, t[a:b]))
            own = batch.select(keys_at).take(pa.array(of, pa.int64()))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            found = [pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*own.columns, *found], [*names, "sent_no", "start", "end", "sentence"])

    keys_at = list(range(len(keys)))
    return units.select(*keys, F.col(text).alias("__t")).mapInArrow(run, schema)


def chunks(units: DataFrame, keys: list[str], size: int, text: str = "text") -> DataFrame:
    """SEG11: keys, chunk_no, start, chunk of fixed size, for models with a limit."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    return units.select(*keys, F.col(text).alias("__t"), F.posexplode(starts).alias("chunk_no", "start")).select(*keys, "chunk_no", "start", F.substring(F.col("__t"), F.col("start") + 1, F.lit(size)).alias("chunk"))
