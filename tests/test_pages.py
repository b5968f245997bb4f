"""Pages as a data source, shapes as segments, and the rules of sections and tables that fail."""

import pytest
from pyspark.sql import functions as F

from folioforge.operators import layout, page_sections
from folioforge.sources import pages as page_files

TABLE = "doc string, page int, idx int, table_id string, columns array<string>, rows array<array<string>>, touches_bottom boolean, rotation int, continued boolean"


def test_page_source(spark):
    def extract(path, first, last):
        for page in range(first, last + 1):
            yield {"page": page, "kind": "word", "text": f"w{page}", "x0": 1.0, "x1": 2.0}
            if page != 6:
                yield {"page": page, "kind": "char", "text": "w"}

    spark.dataSource.register(page_files.page_source("test_pages", lambda path: 7, extract))
    read = spark.read.format("test_pages").option("pages_per_task", 2)
    got = read.option("page_start", 2).option("page_end", 5).load("/book.pdf").where("kind = 'word'")
    assert got.rdd.getNumPartitions() == 2
    assert [(r.page, r.text, r.x0, r.size) for r in got.orderBy("page").collect()] == [(p, f"w{p}", 1.0, None) for p in range(2, 6)]
    with pytest.raises(Exception, match="CHAR_DATA_MISSING PDF_PAGE=6"):
        spark.read.format("test_pages").load("/book.pdf").collect()
    whole = spark.read.format("test_pages").option("allow_blank", "true").load("/book.pdf")
    assert whole.where("kind = 'word'").count() == 7


def test_page_range():
    assert page_files.page_range(1, None, 9) == (1, 9)
    with pytest.warns(UserWarning, match="PAGE_RANGE_CLAMPED"):
        assert page_files.page_range(3, 12, 9) == (3, 9)
    for first, last in ((0, 4), (5, 4)):
        with pytest.raises(ValueError, match="PAGE_RANGE_INVALID"):
            page_files.page_range(first, last, 9)


def test_shapes_give_segments_and_slants_stand_at_their_first_point(spark):
    given = [(1, "rect", 0.0, 50.0, 10.0, 30.0, None, None, 100.0), (1, "line", 0.0, 40.0, None, None, 20.0, 20.0, 100.0), (1, "edge", 5.0, 9.0, None, 3.0, None, 1.0, 100.0)]
    shapes = spark.createDataFrame(given, "page int, kind string, x0 double, x1 double, top double, bottom double, y0 double, y1 double, height double")
    segments = layout.segments_of(shapes)
    assert sorted(tuple(r) for r in segments.collect()) == [(1, 0.0, 0.0, 10.0, 30.0), (1, 0.0, 40.0, 80.0, 80.0), (1, 0.0, 50.0, 10.0, 10.0), (1, 0.0, 50.0, 30.0, 30.0), (1, 50.0, 50.0, 10.0, 30.0)]
    slant = spark.createDataFrame([(1, 0.0, 40.0, 10.0, 10.8), (1, 70.2, 71.0, 0.0, 20.0)], "page int, x0 double, x1 double, top double, bottom double")
    assert sorted((r.orientation, r.at) for r in layout.ruling_lines(slant).collect()) == [("h", 10.0), ("v", 70.0)]


def test_bold_lines(spark):
    words = [(1, "a", 0.0, 5.0, 1.0, 9.0, 9.0, "Times-Bold"), (1, "b", 9.0, 14.0, 1.0, 9.0, 9.0, None), (1, "c", 0.0, 5.0, 20.0, 29.0, 9.0, "Times")]
    df = spark.createDataFrame(words, "page int, text string, x0 double, x1 double, top double, bottom double, size double, fontname string")
    assert [r.bold for r in layout.words_to_lines(df).orderBy("line_no").collect()] == [True, False]


def test_lines_apart(spark):
    rows = [("d", 1, 1, "R101 One", 10.0, "body"), ("d", 1, 2, "TABLE R101.1 Sizes", 20.0, "body"), ("d", 1, 3, "a. note", 30.0, "body"), ("d", 1, 4, "spans", 40.0, "spanning_reference"), ("d", 1, 5, "text", 50.0, "body"), ("e", 1, 1, "R102 Two", 10.0, "body")]
    lines = spark.createDataFrame(rows, "doc string, page int, line_no int, text string, top double, role string")
    labels = spark.createDataFrame([("d", 1, 22.0, "TABLE R101.1 Sizes"), ("e", 1, 10.0, "R102 Two")], "doc string, page int, top double, text string")
    notes = spark.createDataFrame([("d", 1, 30.0)], "doc string, page int, top double")
    got = {r.doc: r for r in page_sections.section_stack(page_sections.set_apart(lines, labels, notes)).collect()}
    assert got["d"].body == "R101 One\ntext" and got["e"].error == "RULE=SECTION_HEADER_SKIPPED PDF_PAGE=1 detail=R102"
    listed = page_sections.section_stack(lines.where("doc = 'e'").withColumn("contents", F.lit(True)))
    assert not listed.collect()


CASES = {
    "named": ([(1, "R1", "ab", True, 0), (2, "R1", "ab", False, 0)], {2: ["TABLE R301.1 x"]}, [("R301.1", 1, 2)]),
    "marked": ([(1, "R1", "ab", True, 0), (2, "R1", "c", False, 0)], {2: ["Table R301.1 (continued)"]}, [("R301.1", 1, 2)]),
    "ends": ([(1, "R1", "ab", True, 0), (2, "R2", "ab", False, 0)], {2: []}, [("R301.1", 1, 1), ("R301.2", 2, 2)]),
    "ends on a page without tables": ([(1, "R1", "ab", True, 0)], {2: ["TABLE R999"]}, [("R301.1", 1, 1)]),
    "three pages": ([(1, "R1", "ab", True, 0), (2, "R1", "ab", True, 0), (3, "R1", "ab", False, 0)], {2: ["TABLE R301.1"], 3: ["TABLE R301.1"]}, [("R301.1", 1, 3)]),
    "comes again later": ([(1, "R1", "ab", False, 0), (3, "R1", "ab", False, 0)], {}, [("R301.1", 1, 1), ("R301.1", 3, 3)]),
    "marker without a grid": ([(1, "R1", "ab", True, 0), (2, "R2", "ab", False, 0)], {2: ["TABLE R301.1 CONTINUED"]}, "PDF_PAGE=2 detail=a label of the open table without its grid"),
    "label without a grid": ([(1, "R1", "ab", True, 0)], {2: ["TABLE R301.1"]}, "PDF_PAGE=2 detail=a label of the open table without its grid"),
    "no proof": ([(1, "R1", "ab", True, 0), (2, "R1", "ab", False, 0)], {2: []}, "PDF_PAGE=2 detail=the open table's id comes again without proof"),
    "two": ([(1, "R1", "ab", True, 0), (2, "R1", "ab", False, 0), (2, "R1", "ab", False, 0)], {2: ["TABLE R301.1"]}, "PDF_PAGE=2 detail=two tables with the open one's id"),
    "turned": ([(1, "R1", "ab", True, 0), (2, "R1", "ab", False, 90)], {2: ["TABLE R301.1"]}, "PDF_PAGE=2 detail=rotation differs"),
    "two open": ([(1, "R1", "ab", True, 0), (1, "R2", "ab", True, 0)], {}, "PDF_PAGE=1 detail=two open tables"),
    "open at the end": ([(1, "R1", "ab", True, 0)], {}, "PDF_PAGE=1 detail=still open at the end"),
}


def test_table_continuation_rules(spark):
    rows, pages = [], []
    for name, (tables, labels, _) in CASES.items():
        rows += [(name, page, k, t.replace("R", "R301."), list(cols), [["1"]], bottom, turn, False) for k, (page, t, cols, bottom, turn) in enumerate(tables)]
        pages += [(name, page, labels.get(page, [])) for page in sorted({*labels, *(t[0] for t in tables)})]
    pages.append(("no tables", 1, None))
    got = page_sections.continue_tables(spark.createDataFrame(rows, TABLE), spark.createDataFrame(pages, "doc string, page int, labels array<string>")).collect()
    for name, (_, _, want) in CASES.items():
        own = [r for r in got if r.doc == name]
        if isinstance(want, str):
            assert [r.error for r in own] == [f"RULE=TABLE_CONTINUATION {want}"], name
        else:
            assert [(r.table_id, r.start_page, r.end_page, r.error) for r in own] == [(*w, None) for w in want], name
    assert "no tables" not in {r.doc for r in got}
