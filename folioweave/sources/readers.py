"""Sources: text, pages, images and files in folders, as tables of pages.

Decoders of PDF and Word need libraries that may be absent: they are looked for only when used, and pages of files
that can't be decoded come with a null text and the reason, never with a guess.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave import lexicons as lx
from folioweave.operators.segment import page_kind, without_furniture

EXTENSIONS = (".pdf", ".docx", ".doc", ".txt")
PAGES = "document string, document_path string, page_number int, text string, page_kind string, note string"


def name_of(path) -> F.Column:  # noqa: ANN001
    return F.regexp_extract(path, r"([^/]+)$", 1)


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: each text file as one page; bytes that are no UTF-8 become replacement characters."""
    rows = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("document_path"))
    return rows.select(name_of(F.col("document_path")).alias("document"), "document_path", F.lit(1).alias("page_number"), F.col("value").alias("text"), F.lit("digital").alias("page_kind"), F.lit(None).cast("string").alias("note"))


def allowed_files(spark: SparkSession, folder: str) -> DataFrame:
    """SRC4, SRC5: files of the known kinds in a folder, in name order, with content and fingerprint (FN22)."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    kind = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return rows.where(kind.isin(*EXTENSIONS)).select("path", kind.alias("kind"), "modificationTime", "length", "content", F.substring(F.sha2("content", 256), 1, 24).alias("fingerprint"))


def word_pages(content: bytes, most: int = lx.WORD_PAGE_CHARS) -> list[tuple[int, str]]:
    """SRC3: pages of a Word file: cut at page breaks, then packed paragraph by paragraph to about `most` characters; empty pages are dropped, but numbers keep their gap."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    blocks: list[list[str]] = [[]]
    for p in body.iter(f"{w}p"):
        if any(b.get(f"{w}type") == "page" for b in p.iter(f"{w}br")):
            blocks.append([])
        blocks[-1].append("".join(t.text or "" if t.tag == f"{w}t" else "\t" for t in p.iter() if t.tag in (f"{w}t", f"{w}tab")))
    pages, number = [], 0
    for block in blocks:
        packed: list[str] = []
        for p in [*block, None]:
            if p is None or (packed and sum(len(x) + 1 for x in packed) + len(p) > most):
                number += 1
                if (text := "\n".join(packed)).strip():
                    pages.append((number, text))
                packed = []
            if p is not None:
                packed.append(p)
    return pages


def pdf_pages(content: bytes) -> list[tuple[int, str, bool]]:
    """SRC2: number, text and whether it has images, of each page; with the optional PDF library."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as pdf:
        return [(i + 1, page.get_text("text"), bool(page.get_images(full=True))) for i, page in enumerate(pdf)]


def file_pages(spark: SparkSession, folder: str, ocr: Callable[[bytes, int], str] | None = None) -> DataFrame:
    """SRC2 to SRC7: pages of all files of a folder, decoded in their tasks. ocr(content, page_number) may read scanned pages."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, kind, content in zip(pdf["path"], pdf["kind"], pdf["content"], strict=True):
                name = path.rsplit("/", 1)[-1]
                try:
                    if kind == ".txt":
                        found = [(1, content.decode("utf-8", errors="replace"), False)]
                    elif kind == ".docx":
                        found = [(n, t, False) for n, t in word_pages(content)]
                    elif kind == ".pdf":
                        found = pdf_pages(content)
                    else:
                        raise ImportError("no decoder for this kind")
                    for n, t, images in found:
                        weak = kind == ".pdf" and (len(t.strip()) < lx.SCANNED_BELOW or (len(t.strip()) < lx.HYBRID_BELOW and images))
                        note = None
                        if weak and ocr is not None:
                            t, note = ocr(content, n), "ocr"
                        rows.append((name, path, n, t, images, kind == ".pdf", note))
                except (ImportError, KeyError, ValueError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((name, path, None, None, False, False, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["document", "document_path", "page_number", "text", "images", "strip", "note"])

    raw = allowed_files(spark, folder).select("path", "kind", "content").mapInPandas(decode, "document string, document_path string, page_number int, text string, images boolean, strip boolean, note string")
    text = F.when(F.col("strip"), without_furniture(F.col("text"))).otherwise(F.col("text"))
    return raw.select("document", "document_path", "page_number", text.alias("text"), page_kind(F.col("text"), F.col("images")).alias("page_kind"), "note")


#: UDF5: engines that read an image: name to a function of (image, language); none comes with this package.
OCR_ENGINES: dict[str, Callable[[bytes, str], str]] = {}


def ocr_key(fingerprint: F.Column, page: F.Column, dpi: int, engine: str, lang: str) -> F.Column:
    """SRC10: what a reading depends on: the file's content, the page, the resolution, the engine and the language."""
    mark = F.substring(F.sha2(F.concat_ws("|", fingerprint, page.cast("string"), F.lit(str(dpi))), 256), 1, 24)
    return F.concat(mark, F.lit(f"-{engine}-{lang}"))


def read_scans(scans: DataFrame, cache: DataFrame | None = None, engine: str = "tesseract", lang: str = "eng", dpi: int = 300, engines: dict[str, Callable[[bytes, str], str]] = OCR_ENGINES) -> DataFrame:
    """SRC7, SRC8, SRC10: fingerprint, page_number, key, text, cached: scanned pages as text, only those read that the cache lacks.

    scans: fingerprint, page_number, image; cache: key, text of earlier calls. Preparing an image (turning, thresholds) is the
    engine's. Without that engine a page that isn't in the cache has no text.
    """
    keyed = scans.withColumn("key", ocr_key(F.col("fingerprint"), F.col("page_number"), dpi, engine, lang))
    if cache is None:
        cache = scans.sparkSession.createDataFrame([], "key string, text string")
    known = cache.select("key", F.col("text").alias("__text"), F.lit(True).alias("__known")).dropDuplicates(["key"])
    joined = keyed.join(known, "key", "left").withColumn("cached", F.coalesce("__known", F.lit(False)))
    read = engines.get(engine)

    @F.pandas_udf("string")
    def run(images: pd.Series) -> pd.Series:
        return images.map(lambda image: None if image is None or read is None else read(bytes(image), lang))

    text = F.when(F.col("cached"), F.col("__text")).otherwise(run(F.when(~F.col("cached"), F.col("image"))))
    return joined.select("fingerprint", "page_number", "key", text.alias("text"), "cached")


def word_box_lines(boxes: DataFrame, keys: list[str], tolerance: float = 0.6) -> DataFrame:
    """SRC9: keys, line_no, line: words of scanned pages as lines. A word joins the first row whose mean height is within
    `tolerance` of the median word height; rows depend on the words before, so a page is folded in one task."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in boxes.select(*keys).schema) + ", line_no int, line string"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        reach = tolerance * float((pdf["y1"] - pdf["y0"]).median())
        rows: list[tuple[list[float], list[tuple[float, str]]]] = []
        pdf = pdf.assign(mid=(pdf["y0"] + pdf["y1"]) / 2).sort_values(["mid", "x0"])
        for mid, x, t in zip(pdf["mid"], pdf["x0"], pdf["text"], strict=True):
            for mids, words in rows:
                if abs(sum(mids) / len(mids) - mid) <= reach:
                    mids.append(mid)
                    words.append((x, t))
                    break
            else:
                rows.append(([mid], [(x, t)]))
        rows.sort(key=lambda r: sum(r[0]) / len(r[0]))
        first = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame([{**first, "line_no": i, "line": " ".join(t for _, t in sorted(words))} for i, (_, words) in enumerate(rows)])

    return boxes.groupBy(*keys).applyInPandas(fold, schema)


def acts_index(spark: SparkSession, path: str) -> DataFrame:
    """SRC12: the index of acts from JSON: id, short_title, act_year."""
    return spark.read.schema("id string, short_title string, act_year int").json(path, multiLine=True)


def plain_html(html: F.Column) -> F.Column:
    """Text of web pages: scripts, styles and comments gone, tags as line breaks."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " "), r"<[^>]*>", "\n")


