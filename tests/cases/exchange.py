"""Cases of small literal inputs that pass through sources, sinks and ordered folds, with the rows to expect as SQL."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.functions import fuzzy as fz
from folioweave.operators import graph as g
from folioweave.operators import segment as sg
from folioweave.operators import symbols as sy
from folioweave.session import shared_folder
from folioweave.sources import readers, sinks

from .fixtures import literal_rows


def _put(spark: SparkSession, files: dict[str, bytes]) -> str:
    """A folder of files in the folder that the cluster shares; it goes when the driver ends."""
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path(folder))
    store.deleteOnExit(path(folder))
    for name, content in files.items():
        out = store.create(path(f"{folder}/{name}"))
        out.write(bytearray(content))
        out.close()
    return folder


def _word_file(pages: list[list[str]]) -> bytes:
    """A Word file: paragraphs, with a page break before each page but the first."""
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    mark = '<w:br w:type="page"/>'
    body = "".join(f"<w:p><w:r>{mark if i and not j else ''}<w:t>{text}</w:t></w:r></w:p>" for i, page in enumerate(pages) for j, text in enumerate(page))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", f"<w:document {space}><w:body>{body}</w:body></w:document>")
    return held.getvalue()


def source_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1, SRC3 to SRC5: files of a folder as pages; a kind without a decoder says so, others are left out."""
    files = {"a.txt": "plain é\nnext".encode() + b"\xff", "b.docx": _word_file([["first", "page"], ["second"]]), "old.doc": b"x", "skip.exe": b"x"}
    rows = readers.file_pages(spark, _put(spark, files))
    return rows.select("document", "page_number", "text", "page_kind", F.col("note").isNotNull().alias("failed"))


_PAGES = [("a.txt", 1, "plain é\nnext�", "scanned", False), ("b.docx", 1, "first\npage", "scanned", False), ("b.docx", 2, "second", "scanned", False), ("old.doc", None, None, "scanned", True)]


def source_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN22."""
    rows = readers.allowed_files(spark, _put(spark, {"x.txt": b"one", "y.TXT": b"one", "z.pdf": b"two"}))
    return rows.select(readers.name_of(F.col("path")).alias("name"), "kind", "length", "fingerprint")


def source_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1."""
    return readers.text_pages(spark, _put(spark, {"one.txt": b"line\nline two", "two.txt": b"alone"})).select("document", "page_number", "text", "page_kind")


def source_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC7, SRC10: a page that the cache holds isn't read again; an engine that isn't there reads nothing."""
    scans = spark.createDataFrame([("f1", 1, b"one"), ("f1", 2, b"two"), ("f2", 1, None)], "fingerprint string, page_number int, image binary")
    engines = {"upper": lambda image, lang: f"{lang}:{image.decode().upper()}"}
    key = readers.ocr_key(F.lit("f1"), F.lit(2), 300, "upper", "eng")
    cache = spark.range(1).select(key.alias("key"), F.lit("kept").alias("text"))
    own = readers.read_scans(scans, cache, engine="upper", engines=engines).withColumn("engine", F.lit("upper"))
    none = readers.read_scans(scans, engine="absent", engines=engines).withColumn("engine", F.lit("absent"))
    return own.unionByName(none).select("engine", "fingerprint", "page_number", "text", "cached")


_SCANS = [("upper", "f1", 1, "eng:ONE", False), ("upper", "f1", 2, "kept", True), ("upper", "f2", 1, None, False), ("absent", "f1", 1, None, False), ("absent", "f1", 2, None, False), ("absent", "f2", 1, None, False)]


def section_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG4 to SEG7: a document with headings is cut at them, another one by pages."""
    text = "Opening words\nGROUNDS\nfirst\nPRAYER\nsecond\nINDEX\nthird"
    pages = spark.createDataFrame([("a", 1, text, "digital"), ("b", 1, "no heading", "digital"), ("b", 2, "none here", "digital")], "doc_id string, page_number int, text string, page_kind string")
    return sg.layered(pages).select("doc_id", "section_no", "section_label", "detected", "text", "tier")


_SECTIONS = [(d, n, label, found, text, "legacy_text_patterns") for d, n, label, found, text in (("a", 1, "GROUNDS", True, "GROUNDS\nfirst\n"), ("a", 2, "PRAYER", True, "PRAYER\nsecond\n"), ("a", 3, "INDEX", True, "INDEX\nthird"), ("b", 1, "p.1", False, "no heading"), ("b", 2, "p.2", False, "none here"))]


def source_word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC9."""
    boxes = [("p", "world", 50.0, 10.0, 90.0, 20.0), ("p", "hello", 5.0, 11.0, 40.0, 21.0), ("p", "below", 5.0, 40.0, 40.0, 50.0), ("q", "alone", 0.0, 0.0, 5.0, 8.0)]
    return readers.word_box_lines(spark.createDataFrame(boxes, "page string, text string, x0 double, y0 double, x1 double, y1 double"), ["page"])


def source_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC12."""
    return readers.acts_index(spark, _put(spark, {"acts.json": b'[{"id": "a1", "short_title": "The Customs Act, 1962", "act_year": 1962},\n {"id": "a2", "short_title": "The Ports Act", "act_year": null}]'}))


def sink_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1: nodes and edges, written and read back."""
    nodes = spark.createDataFrame([("evt_1", "ORDER", "l1"), ("evt_2", "NOTICE", None)], "id string, type string, label string")
    edges = spark.createDataFrame([("e_1_2", "evt_1", "evt_2", "SUPPORTS")], "id string, source string, target string, label string")
    path = f"{_put(spark, {})}/graph"
    sinks.write_graph(nodes, edges, path)
    back = spark.read.schema("id string, type string, label string").json(f"{path}/nodes").withColumn("target", F.lit(None).cast("string"))
    return back.unionByName(spark.read.schema("id string, source string, target string, label string").json(f"{path}/edges").select("id", F.col("source").alias("type"), "label", "target"))


def sink_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK2, LIM1: one fact and one edge of each list are shown, the counts are of all."""
    facts = spark.createDataFrame([(1, "d", "ORDER", "2020-01-01"), (2, "d", "NOTICE", None)], "fact_id int, doc_id string, type string, date string")
    edges = spark.createDataFrame([(1, 2, 0.5, "POTENTIAL_CONFLICT", True), (1, 3, 0.4, "SUPPORTS", True)], "a int, b int, score double, label string, cross_doc boolean")
    lines = sinks.markdown_report(facts.withColumn("date", F.to_date("date")), edges, events=1, cross=1, conflicts=1).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")


_REPORT = ["# Report", "", "| documents | facts | dated | edges | across documents | conflicts |", "|-|-|-|-|-|-|", "| 1 | 2 | 1 | 2 | 2 | 1 |", "", "## Facts", "", "- ORDER 2020-01-01 d", "", "## Across documents", "", "- 1 - 2: POTENTIAL_CONFLICT 0.500", "", "## Conflicts", "", "- 1 - 2: POTENTIAL_CONFLICT 0.500", ""]


def string_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN3."""
    rows = spark.createDataFrame([("versus", "verses"), ("old plate", "plate old"), ("old plate", "cold old plate"), ("plate", "cold plates"), ("", "x")], "a string, b string")
    kinds = {"plain": fz.ratio, "sorted": fz.token_sort_ratio, "shared": fz.token_set_ratio, "part": fz.partial_ratio}
    return rows.select("a", "b", *[F.round(fz.similarity(f, F.col("a"), F.col("b")), 4).alias(n) for n, f in kinds.items()])


_RATIOS = [("versus", "verses", 83.3333, 83.3333, 83.3333, 83.3333), ("old plate", "plate old", 55.5556, 100.0, 100.0, 71.4286), ("old plate", "cold old plate", 78.2609, 78.2609, 100.0, 100.0), ("plate", "cold plates", 62.5, 62.5, 62.5, 100.0), ("", "x", 0.0, 0.0, 0.0, 0.0)]


def paragraph_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG9, SEG10: abbreviations end no sentence, and a short one joins the one before."""
    text = "1. Mr. Rao paid Rs. 500 in May. The firm denied it all. So it was.\n2. It rained over the whole of that long week!\n"
    paras = sg.paragraphs(spark.createDataFrame([("d", text)], "doc_id string, text string"), ["doc_id"])
    return sg.sentences(paras, ["doc_id", "para_no"])


_SENTENCES = [("d", 0, 0, 0, 31, "1. Mr. Rao paid Rs. 500 in May."), ("d", 0, 1, 32, 66, "The firm denied it all. So it was."), ("d", 1, 0, 0, 46, "2. It rained over the whole of that long week!")]


def offset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG8, JN3: pages of 5 and 3 characters, and what lies between and beyond."""
    rows = spark.createDataFrame([(i,) for i in (0, 4, 5, 6, 8, 99)], "offset int").withColumn("pages", F.expr("array(named_struct('start', 0, 'end', 5, 'page', 1), named_struct('start', 6, 'end', 9, 'page', 2))"))
    return rows.select("offset", sg.page_at(F.col("offset"), F.col("pages")).alias("page"))


def name_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG17."""
    return g.clusters(spark.createDataFrame([(1, 2), (3, 2), (5, 6), (6, 7), (7, 5)], "a long, b long"))


def name_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN4, JN7, JN12: names that resemble an earlier one of their kind are its entity."""
    rows = [("ORG", "Harbour Tea Traders Ltd.", 1), ("ORG", "Harbour Tea Trader", 2), ("ORG", "Hill Stores", 3), ("PERSON", "Harbour Tea Trader", 4), ("ORG", "Tea Traders Harbour", 5), ("ORG", "& Co.", 6)]
    return sy.canonical_entities(spark.createDataFrame(rows, "kind string, text string, ord int"))


_ENTITIES = [("ORG", "Harbour Tea Traders Ltd.", "ORG:harbour tea traders"), ("ORG", "Harbour Tea Trader", "ORG:harbour tea traders"), ("ORG", "Hill Stores", "ORG:hill stores"), ("PERSON", "Harbour Tea Trader", "PERSON:harbour tea trader"), ("ORG", "Tea Traders Harbour", "ORG:harbour tea traders")]

_ROWS: dict[str, tuple[Callable, list[tuple], str]] = {
    "source_pages": (source_pages, _PAGES, "document::VARCHAR, page_number::INTEGER, text::VARCHAR, page_kind::VARCHAR, failed::BOOLEAN"),
    "source_fingerprints": (source_fingerprints, [("x.txt", ".txt", 3, "7692c3ad3540bb803c020b3a"), ("y.TXT", ".txt", 3, "7692c3ad3540bb803c020b3a"), ("z.pdf", ".pdf", 3, "3fc4ccfe745870e2c0d99f71")], "name::VARCHAR, kind::VARCHAR, length::BIGINT, fingerprint::VARCHAR"),
    "source_text": (source_text, [("one.txt", 1, "line\nline two", "digital"), ("two.txt", 1, "alone", "digital")], "document::VARCHAR, page_number::INTEGER, text::VARCHAR, page_kind::VARCHAR"),
    "source_scans": (source_scans, _SCANS, "engine::VARCHAR, fingerprint::VARCHAR, page_number::INTEGER, text::VARCHAR, cached::BOOLEAN"),
    "section_tiers": (section_tiers, _SECTIONS, "doc_id::VARCHAR, section_no::INTEGER, section_label::VARCHAR, detected::BOOLEAN, text::VARCHAR, tier::VARCHAR"),
    "source_word_boxes": (source_word_boxes, [("p", 0, "hello world"), ("p", 1, "below"), ("q", 0, "alone")], "page::VARCHAR, line_no::INTEGER, line::VARCHAR"),
    "source_acts": (source_acts, [("a1", "The Customs Act, 1962", 1962), ("a2", "The Ports Act", None)], "id::VARCHAR, short_title::VARCHAR, act_year::INTEGER"),
    "sink_graph": (sink_graph, [("evt_1", "ORDER", "l1", None), ("evt_2", "NOTICE", None, None), ("e_1_2", "evt_1", "SUPPORTS", "evt_2")], "id::VARCHAR, type::VARCHAR, label::VARCHAR, target::VARCHAR"),
    "sink_report": (sink_report, list(enumerate(_REPORT)), "line_no::INTEGER, line::VARCHAR"),
    "string_ratios": (string_ratios, _RATIOS, "a::VARCHAR, b::VARCHAR, plain::DOUBLE, sorted::DOUBLE, shared::DOUBLE, part::DOUBLE"),
    "paragraph_sentences": (paragraph_sentences, _SENTENCES, "doc_id::VARCHAR, para_no::INTEGER, sent_no::INTEGER, start::INTEGER, end::INTEGER, sentence::VARCHAR"),
    "offset_pages": (offset_pages, [(0, 1), (4, 1), (5, 2), (6, 2), (8, 2), (99, 2)], "offset::INTEGER, page::INTEGER"),
    "name_clusters": (name_clusters, [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (7, 5)], "node::BIGINT, cluster::BIGINT"),
    "name_entities": (name_entities, _ENTITIES, "kind::VARCHAR, text::VARCHAR, entity_id::VARCHAR"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _, _) in _ROWS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: literal_rows(rows, columns) for name, (_, rows, columns) in _ROWS.items()}
