import datetime
import zipfile

from pyspark.sql import functions as F

from folioweave.sources import readers, sinks
from folioweave.streaming import ingest


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("plain é\nnext".encode() + b"\xff")
    (tmp_path / "skip.exe").write_bytes(b"x")
    (tmp_path / "old.doc").write_bytes(b"x")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    paragraphs = "".join(f"<w:p><w:r><w:t>{'word ' * 290}</w:t></w:r></w:p>" for _ in range(4)) + '<w:p><w:r><w:br w:type="page"/><w:t>last</w:t></w:r></w:p>'
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{paragraphs}</w:body></w:document>")
    rows = readers.file_pages(spark, str(tmp_path)).orderBy("document", "page_number").collect()
    assert [(r.document, r.page_number) for r in rows] == [("a.txt", 1), ("b.docx", 1), ("b.docx", 2), ("b.docx", 3), ("old.doc", None)]
    assert rows[0].text == "plain é\nnext�" and rows[3].text == "last" and rows[4].note.startswith("ImportError")
    text = readers.text_pages(spark, str(tmp_path / "a.txt")).first()
    assert text.document == "a.txt" and text.page_number == 1


def test_word_boxes(spark):
    boxes = [("p", "world", 50.0, 10.0, 90.0, 20.0), ("p", "hello", 5.0, 11.0, 40.0, 21.0), ("p", "below", 5.0, 40.0, 40.0, 50.0)]
    rows = readers.word_box_lines(spark.createDataFrame(boxes, "page string, text string, x0 double, y0 double, x1 double, y1 double"), ["page"]).orderBy("line_no").collect()
    assert [r.line for r in rows] == ["hello world", "below"]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("e1", 0.1, "2020"), ("e2", 0.2, "2020")], "edge_id string, score double, recorded_at string")
    new = spark.createDataFrame([("e2", 0.5, "2021"), ("e2", 0.6, "2022"), ("e3", 0.3, None)], "edge_id string, score double, recorded_at string")
    assert {r.edge_id: r.score for r in sinks.upserted(old, new).collect()} == {"e1": 0.1, "e2": 0.6, "e3": 0.3}
    nodes = spark.createDataFrame([("evt_1", "X", "l")], "id string, type string, label string")
    edges = spark.createDataFrame([(1, 2, 0.5, "RELATED_TO", True)], "a int, b int, score double, label string, cross_doc boolean")
    sinks.write_graph(nodes, edges, str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g/nodes")).count() == 1
    facts = spark.createDataFrame([(1, "d", "X", datetime.date(2020, 1, 1))], "fact_id int, doc_id string, type string, date date")
    assert "| 1 | 1 | 1 | 1 | 1 | 0 |" in sinks.markdown_report(facts, edges)
    lines = spark.createDataFrame([("d", 1, 1, "<b> & 'x'")], "doc_id string, part int, position int, line string")
    assert sinks.html_lines(lines).first().html == "<li>&lt;b&gt; &amp; &#39;x&#39;</li>"


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "in")
    events.repartition(3).write.parquet(src)
    rows = ingest.once(ingest.stream(spark, src, events.schema), "event_id", late="3650 days")
    q = rows.writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == events.select("event_id").distinct().count()
    q = ingest.counts(ingest.stream(spark, src, events.schema), "event_type", late="3650 days").writeStream.format("memory").outputMode("complete").queryName("daily").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("daily").agg(F.sum("n")).first()[0] == events.count()
    edges = lambda b: b.select(F.col("event_id").cast("string").alias("edge_id"), F.col("value").alias("score"), F.col("ts").alias("recorded_at"))
    q = ingest.refreshed_edges(ingest.stream(spark, src, events.schema, 1), str(tmp_path / "out"), str(tmp_path / "cp"), edges)
    q.awaitTermination()
    last = max(int(p.name[1:]) for p in (tmp_path / "out").iterdir() if p.name.startswith("v"))
    assert spark.read.parquet(str(tmp_path / f"out/v{last}")).count() == events.count()


def test_suppliers_files_lie_in_one_folder_and_alike_ones_go_to_one_supplier_each(spark, tmp_path):
    from folioweave.plans import exchanged

    rows = spark.createDataFrame([(k, "Supplier one" if k % 3 else f"Supplier {k}", 7) for k in range(40)], "s_suppkey long, s_name string, s_nationkey int")
    rows.write.parquet(f"{tmp_path}/supplier.parquet")
    folder, _ = exchanged._supplier_files(spark, str(tmp_path))
    under = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path").collect()
    assert len(under) == 40 and len({r["path"].rsplit("/", 1)[0] for r in under}) == 1
    want = {r["s_suppkey"]: f"{r['s_name']}\nof nation 7\n" for r in rows.collect()}
    pages = exchanged.queries()["supplier_pages"](spark, str(tmp_path)).collect()
    assert len(pages) == 40 and {r["s_suppkey"]: r["text"] for r in pages} == want
    prints = exchanged.queries()["supplier_fingerprints"](spark, str(tmp_path)).collect()
    assert len(prints) == 40 and {r["s_suppkey"]: r["length"] for r in prints} == {k: len(t) for k, t in want.items()}


def test_edges_of_a_report_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda b: seen.add(1) or b, "long").asNondeterministic()
    facts = spark.createDataFrame([(k, "d", "t", None) for k in (1, 2, 3)], "fact_id long, doc_id string, type string, date date")
    edges = spark.createDataFrame([(1, 2, "SUPPORTS", 0.5, True), (1, 3, "POTENTIAL_CONFLICT", 0.6, True)], "a long, b long, label string, score double, cross_doc boolean").select("a", counted("b").alias("b"), "label", "score", "cross_doc")
    report = sinks.markdown_report(facts, edges)
    assert "| 1 | 3 | 0 | 2 | 2 | 1 |" in report and "- 1 - 3: POTENTIAL_CONFLICT 0.600" in report
    assert seen.value == 2
