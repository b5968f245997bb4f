"""Two-column pages and turned tables, on small pages whose results are known by hand."""

import pytest

from folioforge.operators import columns, layout

WORD = "page int, text string, x0 double, x1 double, top double, bottom double, size double"
PAGE = "page int, width double, height double, body_size double"
BOX = "page int, x0 double, x1 double, top double, bottom double"


def word(page, text, x0, top, size=10.0):
    return (page, text, float(x0), x0 + 5.0 * len(text), float(top), top + 10.0, size)


LEFT = "the left column has words up to its edge ab"


def column(page, tops, left=LEFT, right="right text"):
    return [w for t in tops for w in (word(page, left, 40, t), word(page, right, 340, t))]


@pytest.fixture(scope="module")
def no_tables(spark):
    return spark.createDataFrame([], BOX)


def pages(spark, *numbers):
    return spark.createDataFrame([(n, 600.0, 800.0, 10.0) for n in numbers], PAGE)


def test_reading_order(spark, no_tables):
    words = [
        word(1, "Running head", 40, 20),  # in the top tenth
        word(1, "TOP", 292.5, 90),  # centred, leads the page
        *column(1, [120, 140, 200]),
        word(1, "A", 297.5, 160),  # centred inside the page: dropped
        word(1, "ALL CAPITALS IN A HEADING HERE", 225, 180),
        word(1, "12", 292.5, 300),
        *column(1, [300]),
    ]
    words += [(2, None, None, None, 100.0, 110.0, 10.0)]
    got = columns.ordered_lines(spark.createDataFrame(words, WORD), no_tables, pages(spark, 1, 2), "page").where("page = 1").orderBy("line_no").collect()
    assert [(r.column, r.role, r.text) for r in got] == [
        ("spanning", "spanning_header", "TOP"),
        ("spanning", "spanning_reference", "ALL CAPITALS IN A HEADING HERE"),
        ("spanning", "spanning_reference", "12"),
        *[("left", None, LEFT)] * 4,
        *[("right", None, "right text")] * 4,
    ]
    assert {r.split for r in got} == {(255 + 340) / 2} and {r.error for r in got} == {None}
    assert [r.top for r in got if r.column == "left"] == [120, 140, 200, 300]


def test_gutter_rules(spark, no_tables):
    def bounds(*rows):
        df = spark.createDataFrame([w for r in rows for w in r], WORD)
        return {r.page: r for r in columns.column_bounds(df, no_tables, pages(spark, *range(9))).collect()}

    got = bounds(
        column(0, [100, 120]),
        [word(1, "left", 40, 100), word(1, "only", 100, 120)],
        [word(2, "abcdefghij", 40, 100), word(2, "abcdefghij", 190, 100), word(2, "abcdefghij", 340, 100)],
        [word(3, "a" * 50, 40, 100), word(3, "b" * 44, 70, 120), word(3, "c" * 50, 320, 120)],
        column(4, [100]) + [word(4, "a word that runs right across the gutter now", 200, 120)],
        [word(5, "right", 400, 100)],
    )
    assert (got[0].split, got[0].gutter_left, got[0].gutter_right, got[0].error) == (297.5, 255, 340, None)
    assert (got[1].gutter_left, got[1].gutter_right, got[1].error) == (120, 300, None)
    assert got[2].error == "COLUMN_SPLIT_COMPETING"
    assert (got[3].split, got[3].error) == (305, None)
    assert got[4].error == "COLUMN_SPLIT_CROSS"
    assert (got[5].split, got[5].error) == (350, None)
    assert bounds([])  == {}


def test_ambiguous_gutter_line(spark, no_tables):
    words = column(1, [120, 140]) + [word(1, "ends here.", 272.5, 140)]
    got = columns.ordered_lines(spark.createDataFrame(words, WORD), no_tables, pages(spark, 1)).collect()
    assert [(r.column, r.text) for r in got if r.error == "GUTTER_LINE_AMBIGUOUS"] == [("spanning", "ends here.")] and len(got) == 5


def grid(page, x0, top, step):
    flat = [(page, x0, x0 + 2 * step, top + k * step, top + k * step) for k in range(3)]
    return flat + [(page, x0 + k * step, x0 + k * step, top, top + 2 * step) for k in range(3)]


def test_tables_by_rotation(spark):
    segments = spark.createDataFrame([(p, *map(float, s)) for p in (1, 2, 3) for _, *s in grid(p, 100, 200, 50)] + [(4, 0.0, 50.0, 10.0, 10.0)], BOX)
    glyphs = [(1, 110.0, 115.0, 210.0, 220.0, 0), (2, 110.0, 120.0, 210.0, 215.0, 270), (2, 110.0, 120.0, 230.0, 235.0, 270), (2, 500.0, 505.0, 10.0, 15.0, 0), (3, 1.0, 2.0, 1.0, 2.0, None)]
    chars = spark.createDataFrame(glyphs, f"{BOX}, rotation int")
    got = {r.page: r for r in columns.tables_by_rotation(segments, chars, pages(spark, 1, 2, 3, 4)).collect()}
    assert sorted(got) == [1, 2, 3]
    assert [(r.rotation, r.score, r.tie) for _, r in sorted(got.items())] == [(0, 1, None), (90, 2, None), (0, 0, "default_rotation_0")]
    assert all((r.x0, r.x1, r.top, r.bottom) == (100, 200, 200, 300) for r in got.values())


def test_char_rotation_turns(spark):
    df = spark.createDataFrame([(1, 10.0, 30.0, 5.0, 9.0, 600.0, 800.0)], f"{BOX}, width double, height double")
    there = columns.turned(df, 90).withColumns({"width": df.height, "height": df.width})
    back = columns.turned(there, 270).first()
    assert (back.x0, back.x1, back.top, back.bottom) == (10, 30, 5, 9)
    assert layout.crossings(layout.ruling_lines(df.drop("width", "height"))).count() == 0
