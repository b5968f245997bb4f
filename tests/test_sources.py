"""Readers and writers, read back."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from folioforge.operators import amendments, layout, page_sections, vector
from folioforge.sources import files, sinks


def held(folder):
    return {n: open(f"{folder}/{n}", encoding="utf-8").read() for n in os.listdir(folder) if not n.startswith(".")}


def test_text_files(spark, tmp_path):
    rows = [(1, "a.txt", "H1", "one"), (2, "b.txt", "H2", "zwei\nü"), (3, "a.txt", "H3", "last")]
    n = sinks.write_texts(spark.createDataFrame(rows, "ord int, file_name string, header string, body string"), str(tmp_path / "t"))
    assert n == 2 and held(tmp_path / "t") == {"a.txt": "H3\n\nlast\n", "b.txt": "H2\n\nzwei\nü\n"}
    again = sinks.write_texts(spark.createDataFrame(rows[1:2], "ord int, file_name string, header string, body string"), str(tmp_path / "t"))
    assert again == 1 and len(held(tmp_path / "t")) == 2
    with pytest.raises(Exception, match="no file can be written"):
        sinks.write_files(spark.createDataFrame([("x/y", "z")], "file_name string, content string"), str(tmp_path / "t"))
    h = spark.range(1).select(sinks.item_header("IRC", F.lit(7), F.lit("R301"), F.lit("add_exception")).alias("a"), sinks.item_header("IRC", F.lit(8), F.lit(None).cast("string"), F.lit("")).alias("b")).first()
    assert list(h) == ["SECTION: IRC | Item 7 | Target R301 | Op add_exception", "SECTION: IRC | Item 8 | Target UNKNOWN | Op unknownop"]


def test_sections_tables_and_reports(spark, tmp_path):
    lines = spark.createDataFrame([("d", 1, 1, "R101 One"), ("d", 1, 2, "a"), ("d", 2, 1, "b"), ("d", 2, 2, "R102 Two")], "doc string, page int, line_no int, text string")
    assert sinks.write_sections(page_sections.section_stack(lines), str(tmp_path / "s")) == 2
    assert held(tmp_path / "s") == {"R101.txt": "PDF_PAGE: 1–2\nSECTION_ID: R101\nSECTION: R101 One\nR101 One\na\nb", "R102.txt": "PDF_PAGE: 2\nSECTION_ID: R102\nSECTION: R102 Two\nR102 Two"}
    tables = spark.createDataFrame([("R301.2(1)", ["a", 'b"'], [["1", "x,y"], ["2", None]], None), ("bad", None, None, "RULE=X")], "table_id string, columns array<string>, rows array<array<string>>, error string")
    sinks.write_files(sinks.table_files(tables), str(tmp_path / "tables"))
    got = held(tmp_path / "tables")
    assert got["R301-2-1.txt"] == 'a | b"\n1 | x,y\n2 | \n' and got["R301-2-1.csv"] == 'a,"b"""\n1,"x,y"\n2,\n'
    assert json.loads(got["R301-2-1.json"]) == {"table_id": "R301.2(1)", "columns": ["a", 'b"'], "rows": [["1", "x,y"], ["2", None]]} and len(got) == 3
    report = lambda done, error: spark.createDataFrame([("ok" if error is None else str(error),)], "state string")
    assert sinks.reported(lambda: lines, report, str(tmp_path / "r")) is lines
    with pytest.raises(ZeroDivisionError):
        sinks.reported(lambda: 1 / 0, report, str(tmp_path / "r"))
    assert [r.state for r in spark.read.json(str(tmp_path / "r")).collect()] == ["division by zero"]


def test_index_round_trip(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "c-1", "two", [0.0, 1.0]), (0, "c-0", "one", [1.0, 0.0])], "ord int, id string, content string, embedding array<double>")
    os.makedirs(tmp_path / "base")
    assert sinks.export_index(chunks, f"{tmp_path}/base/base.index.json") == 1
    got = files.load_index(spark, " BASE ", str(tmp_path))
    assert [(r.id, r.content, r.embedding) for r in got.collect()] == [("c-0", "one", [1.0, 0.0]), ("c-1", "two", [0.0, 1.0])]
    assert files.load_index(spark, "alias", str(tmp_path), aliases={"alias": "base"}) is got
    with pytest.raises(FileNotFoundError, match="no index file for corpus 'none'"):
        files.load_index(spark, "none", str(tmp_path))
    calls = []
    embed = lambda texts: calls.append(texts) or [[1.0, 0.1]]
    ordered = got.withColumn("ord", F.monotonically_increasing_id())
    assert [r.id for r in vector.searched(spark, ordered, " ask ", embed, 1).collect()] == ["c-0"] and calls == [["ask"]]
    assert vector.searched(spark, ordered, "  ", embed).count() == 0 and vector.searched(spark, ordered.limit(0), "ask", embed).count() == 0 and len(calls) == 1


def test_allowlist(spark, tmp_path):
    known = hashlib.sha256(b"pdf").hexdigest()
    docs = spark.createDataFrame([("a.pdf", bytearray(b"pdf"))], "path string, content binary")
    path = str(tmp_path / "allowed.txt")
    with pytest.warns(UserWarning, match="no allowlist"):
        allowed = files.allowed_hashes(spark, path)
    with pytest.raises(ValueError, match="PDF_HASH_UNKNOWN detail=a.pdf"):
        files.require_allowed(docs, allowed)
    with open(path, "w") as f:
        f.write(f"# known\n{known.upper()}  # a.pdf\n\n")
    assert files.require_allowed(docs, files.allowed_hashes(spark, path)) is docs


def test_limits_pages_and_bands(spark):
    items = spark.createDataFrame([(3, "R301"), (1, "R301"), (2, "R302")], "position int, section_id string")
    assert [r.position for r in amendments.limited(items, "301", 1).collect()] == [1] and amendments.limited(items, limit=2).count() == 2
    spans = page_sections.page_spans(spark.createDataFrame([("d", "R1", [3, 2, 2]), ("d", "R2", [1, 3]), ("d", "R3", [5])], "doc string, section_id string, pages array<int>"))
    assert [(r.pages, r.contiguous) for r in spans.orderBy("section_id").collect()] == [("2–3", True), ("1–3", False), ("5", True)]
    lines = spark.createDataFrame([("d", 1, k, t) for k, t in enumerate("abc")], "doc string, page int, line_no int, text string")
    assert [(r.following, r.after_following) for r in page_sections.with_following(lines).orderBy("line_no").collect()] == [("b", "c"), ("c", None), (None, None)]
    bands = spark.createDataFrame([(1, "Utah Code", None), (2, "Title", "12")], "page int, header string, footer string")
    assert [r.error for r in page_sections.amendments_named(bands).collect()] == ["RULE=AMENDMENT_DETECTED PDF_PAGE=1 detail=Utah Code"]


def test_cells_labels_and_ruled_boxes(spark):
    words = [(1, "big", 1.0, 13.0, 1.0, 9.0, 10.0), (1, "word", 22.0, 38.0, 1.5, 9.0, 10.0), (1, "below", 1.0, 21.0, 15.0, 24.0, 10.0), (1, "right", 60.0, 80.0, 2.0, 9.0, 10.0)]
    df = spark.createDataFrame(words, "page int, text string, x0 double, x1 double, top double, bottom double, size double")
    segments = [(1, 0.0, 100.0, y, y) for y in (0.0, 30.0, 60.0)] + [(1, x, x, 0.0, 60.0) for x in (0.0, 50.0, 100.0)]
    lines = layout.ruling_lines(spark.createDataFrame(segments, "page int, x0 double, x1 double, top double, bottom double"))
    tables = layout.ruled_tables(lines)
    cells = {(r.row, r.col): r.text for r in layout.table_cells(tables, lines, df).collect()}
    assert cells == {(0, 0): "big  word\nbelow", (0, 1): "right", (1, 0): "", (1, 1): ""}
    boxes = tables.select("page", "table_no", "x0", "x1", "top", "bottom").unionByName(spark.createDataFrame([(1, 2, 200.0, 300.0, 0.0, 60.0)], "page int, table_no int, x0 double, x1 double, top double, bottom double"))
    assert {r.table_no: r.ruled for r in layout.is_ruled(boxes, lines).collect()} == {1: True, 2: False}
    above = [(1, "TABLE R301.1 Left", 0.0, 40.0, -20.0, -10.0), (1, "TABLE R301.2 Right (CONTINUED)", 50.0, 90.0, -20.0, -10.0), (1, "TABLE R301.3 far", 0.0, 40.0, -90.0, -80.0)]
    labels = spark.createDataFrame(above, "page int, text string, x0 double, x1 double, top double, bottom double")
    assert [r.label for r in layout.table_labels(tables, labels).collect()] == ["TABLE R301.2 Right (CONTINUED)"]
    labelled = layout.label_lines(labels.withColumn("size", F.lit(10.0)).where("x0 > 0")).first()
    assert (labelled.label.id, labelled.continued) == ("R301.2", True)
