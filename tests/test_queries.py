"""Every registered query against its SQL, and the folds against plain Python."""

import duckdb
import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import amendments, answer, chunking, layout, page_sections, vector
from folioforge.plans import registry

TABLES = "documents embeddings conversations benchmark part".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def rows(found):
    return sorted(tuple(str(v) for v in r) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small_dir, name):
    got = QUERIES[name](spark, small_dir)
    columns = sorted(got.columns)
    found = rows(got.select(*columns).collect())
    if name not in SQL:
        assert found
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small_dir}/{t}.parquet'")
    want = con.sql(SQL[name])
    assert sorted(want.columns) == columns
    assert found == rows(con.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall())


def plain_chunks(lines, budget):
    out, now, chars, at = [], [], 0, 0
    for k, line in enumerate(lines):
        if now and chars + len(line) + 1 > budget:
            out.append((at + 1, k, "\n".join(now)))
            now, chars, at = [], 0, k
        now.append(line)
        chars += len(line) + 1
    return [*out, (at + 1, len(lines), "\n".join(now))]


def test_greedy_chunks(spark):
    texts = ["", "a", "x" * 50, "a\nb\nc", "\n".join("y" * (k % 13) for k in range(60)), "aaaa\nbbbb\ncccccccccccc\nd"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in range(len(texts)):
        got = [(c.start_line, c.end_line, c.content) for c in chunking.greedy_chunks(df.where(f"i = {r}"), 12, keep=("i",)).orderBy("chunk_no").collect()]
        assert got == plain_chunks(texts[r].split("\n"), 12)
    head = spark.createDataFrame([("SECTION: x\nbody",), ("SECTION: x",)], "text string")
    assert [(c.start_line, c.end_line, c.content) for c in chunking.greedy_chunks(head, 12).collect()] == [(2, 2, "body"), (2, 1, "")]


@pytest.mark.parametrize("targets, want", [([], [1, 2, 3, 4]), (["R1"], [2]), (["R9"], [1, 2]), ([None], []), (["R1", None], [])])
def test_override_is_not_in(spark, targets, want):
    base = spark.createDataFrame([(1, "1)"), (2, "r2"), (3, None), (4, " ")], "i int, section_id string")
    gone = spark.createDataFrame([(t,) for t in targets], "target string")
    assert sorted(r.i for r in amendments.override(base, gone).collect()) == want


def test_scalars(spark):
    df = spark.createDataFrame([(" 302.2). ", "In IRC, Section AF103", "0006_R108.3_x.txt", "57-22-5.1")], "a string, b string, c string, d string")
    r = df.select(T.section_id(F.col("a")), T.section_in_text(F.col("b")), T.section_in_path(F.col("c")), T.section_url(F.col("d")), T.utf16_length(F.lit("a😀")), T.structure_in_query(F.lit("see § 3-1"))).first()
    assert list(r) == ["R302.2", None, "R0006", "https://le.utah.gov/xcode/Title57/Chapter22/57-22-S5.1.html", 3, None]


def test_cosine_edges(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 2.0])], "ord int, embedding array<double>")
    assert [(r.ord, round(r.score, 9)) for r in vector.top_k(df, [1.0, 1.0], 9).collect()] == [(1, 1.0), (2, 1.0), (0, 0.0)]
    assert vector.top_k(df, [1.0, 1.0], 0).count() == 0 and vector.top_k(df, [], 3).count() == 0
    with pytest.raises(Exception, match="lengths differ"):
        vector.top_k(df, [1.0], 3).collect()
    with pytest.raises(ValueError):
        vector.top_k(df, [1.0, 1.0], -1)


def test_lines_keep_their_anchor(spark):
    words = [(1, f"w{k}", 10.0 * k, 10.0 * k + 8, 2.0 * k, 2.0 * k + 9, 10.0) for k in range(5)]
    df = spark.createDataFrame(words, "page int, text string, x0 double, x1 double, top double, bottom double, size double")
    assert [r.text for r in layout.words_to_lines(df).orderBy("line_no").collect()] == ["w0w1", "w2w3", "w4"]


def test_section_stack(spark):
    lines = [(1, 1, "R101 One"), (1, 2, "a"), (1, 3, "R101.1 Deep"), (2, 1, "b"), (2, 2, "SECTION R101"), (2, 3, "c"), (3, 1, "R102 Two")]
    df = spark.createDataFrame([("d", *r) for r in lines] + [("e", 1, 1, "R101 One"), ("e", 1, 2, "R101 Again")], "doc string, page int, line_no int, text string")
    got = {(r.doc, r.section_id): r for r in page_sections.section_stack(df).collect()}
    assert got["d", "R101"].body == "R101 One\na\nc" and got["d", "R101.1"].body == "R101.1 Deep\nb"
    assert (got["d", "R101"].start_page, got["d", "R101"].end_page) == (1, 2)
    assert got["e", "R101"].error.startswith("RULE=SECTION_APPEND_VIOLATION")


def test_answers(spark):
    df = spark.createDataFrame([("I cannot answer that from the provided code sections.",), ('A "b c" [source 1, lines 1-2].',), ('A "b c" [source 1, lines 1-2]. Bare.',), ("",)], "a string")
    assert [r[0] for r in df.select(answer.answer_is_valid(F.col("a"))).collect()] == [True, True, False, False]


def test_unlabelled_and_continued_tables(spark):
    cells = (["a", "b"], [["1", "2"]])
    given = [("d", 1, 1, None, False, False), ("d", 1, 2, None, False, False), ("d", 2, 1, "R301.2(1)", True, False), ("d", 3, 1, "R301.2", False, True), ("d", 4, 1, "R9.1", False, True)]
    df = spark.createDataFrame([(d, p, i, t, *cells, bottom, 0, cont) for d, p, i, t, bottom, cont in given], "doc string, page int, idx int, table_id string, columns array<string>, rows array<array<string>>, touches_bottom boolean, rotation int, continued boolean")
    ids = page_sections.resolve_table_ids(df)
    assert [(r.table_id, r.continued_from, r.warning) for r in ids.orderBy("page", "idx").collect()] == [
        ("UNLABELED_P1_T1", None, "TABLE_LABEL_MISSING PDF_PAGE=1"),
        ("UNLABELED_P1_T2", None, "TABLE_LABEL_MISSING PDF_PAGE=1"),
        ("R301.2(1)", None, None),
        ("R301.2(1)", "R301.2(1)", None),
        ("R9.1", None, "TABLE_CONTINUED_WITHOUT_PRIOR PDF_PAGE=4 table_id=R9.1"),
    ]
    assert sorted(r.start_page for r in page_sections.continue_tables(df).where('table_id is null').collect()) == [1, 1]
    done = {r.table_id: (r.start_page, r.end_page, len(r.rows), r.error) for r in page_sections.continue_tables(ids).collect()}
    assert done == {"UNLABELED_P1_T1": (1, 1, 1, None), "UNLABELED_P1_T2": (1, 1, 1, None), "R301.2(1)": (2, 3, 2, None), "R9.1": (4, 4, 1, None)}


def test_fallback_pages(spark):
    lines = spark.createDataFrame([("d", 1, 1, "R101 One"), ("e", 2, 2, "b"), ("e", 2, 1, "a"), ("e", 12, 1, "c")], "doc string, page int, line_no int, text string")
    got = page_sections.fallback_pages(lines, page_sections.section_stack(lines)).orderBy("page").collect()
    head = "MODE: UNSECTIONED_FALLBACK\n--------------------------------\n"
    assert [tuple(r) for r in got] == [("e", 2, "page_0002.txt", f"PDF_PAGE: 2\n{head}a\nb\n"), ("e", 12, "page_0012.txt", f"PDF_PAGE: 12\n{head}c\n")]
