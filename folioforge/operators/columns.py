"""Reading order of two-column pages: the gutter between the columns, lines that span it, and tables on turned pages.

Every step is an aggregate or a window within a page, so a page's rows meet once and pages spread. Rules that a page
breaks stand in its `error` column; nothing is raised inside a plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import page_text as X
from folioforge.functions import patterns as P
from folioforge.operators import layout


def with_boxes(rows: DataFrame, tables: DataFrame, page: str) -> DataFrame:
    """rows with `boxes`, the tables of their page."""
    boxes = tables.groupBy(page).agg(F.collect_list(F.struct("x0", "x1", "top", "bottom")).alias("boxes"))
    return rows.join(boxes, page, "left")


def settled(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder that the cluster names, and read from there; a session of one machine may name none."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        if not spark.conf.get("spark.checkpoint.dir", None) and (spark.sparkContext.master.startswith("local-cluster") or not spark.sparkContext.master.startswith("local")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared")
    return df.checkpoint()


def in_table() -> Column:
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    return F.coalesce(F.exists("boxes", lambda b: layout.in_box(x, y, b)), F.lit(False))


def meets_table() -> Column:
    met = lambda b: (F.col("x0") <= b["x1"]) & (F.col("x1") >= b["x0"]) & (F.col("top") <= b["bottom"]) & (F.col("bottom") >= b["top"])
    return F.coalesce(F.exists("boxes", met), F.lit(False))


def crosses_split() -> Column:
    return (F.col("x0") < F.col("split")) & (F.col("split") < F.col("x1"))


def capital_over_split() -> Column:
    """A single capital over the split, about as tall as the page's words at least, and in no table."""
    return F.trim("text").rlike(r"^[A-Z]\z") & crosses_split() & (F.col("bottom") - F.col("top") >= 0.9 * F.col("tall")) & ~in_table()


def in_gutter(slack: float) -> Column:
    return (F.col("x0") >= F.col("gutter_left") - slack) & (F.col("x1") <= F.col("gutter_right") + slack)


def widest_gap(words: DataFrame, page: str) -> DataFrame:
    """page, gap, before, behind, n_gaps: the widest gap between words from left to right, the leftmost of equal ones."""
    own = Window.partitionBy(page).orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1)
    gaps = words.withColumn("reach", F.max("x1").over(own)).withColumn("gap", F.col("x0") - F.col("reach")).where("gap > 0")
    same = gaps.groupBy(page, "gap").agg(F.min_by("reach", "x0").alias("before"), F.min("x0").alias("behind"), F.count("*").alias("n_gaps"))
    return same.groupBy(page).agg(F.max("gap").alias("gap"), *(F.max_by(c, "gap").alias(c) for c in ("before", "behind", "n_gaps")))


def column_bounds(words: DataFrame, tables: DataFrame, pages: DataFrame, page: str = "page") -> DataFrame:
    """page, split, gutter_left, gutter_right, tall, error for the pages with words; pages has page and width.

    The gutter is the widest gap between words that aren't at the middle. Words on one side alone have it up to the middle.
    A gap too far from the middle gives way to the one between what begins left and what begins right of it, or to the
    middle itself. error names the first rule that a page breaks: no gap, equal gaps, too far off, words on the wrong
    side, a word across.
    """
    near, off = P.GUTTER_TOLERANCE, P.SPLIT_OFF_CENTER
    placed = words.join(pages.select(page, "width"), page).withColumn("mid", F.col("width") / 2)
    central = (F.col("x0") < F.col("mid") + near) & (F.col("x1") > F.col("mid") - near)
    facts = placed.groupBy(page, "width", "mid").agg(
        F.count_if(~central).alias("n_aside"),
        F.max(F.when(F.col("x0") < F.col("mid"), F.col("x1"))).alias("left_end"),
        F.min(F.when(F.col("x0") > F.col("mid"), F.col("x0"))).alias("right_start"),
        F.max(F.when(F.col("x1") <= F.col("mid"), F.col("x1"))).alias("left_most"),
        F.min(F.when(F.col("x0") >= F.col("mid"), F.col("x0"))).alias("right_most"),
        F.max("x1").alias("last"),
        F.min("x0").alias("first"),
        F.median(F.col("bottom") - F.col("top")).alias("tall"),
    )
    aside = placed.join(facts.select(page, "n_aside"), page).where((F.col("n_aside") < 2) | ~central)
    both, one = F.col("left_end").isNotNull() & F.col("right_start").isNotNull(), F.col("left_end").isNotNull() != F.col("right_start").isNotNull()
    g = facts.join(widest_gap(aside, page), page, "left").withColumn("one", one)
    g = g.withColumn("a", F.when(F.col("one"), F.coalesce("left_end", "mid")).otherwise(F.coalesce("before", F.when(both, F.col("left_end")))))
    g = g.withColumn("b", F.when(F.col("one"), F.coalesce("right_start", "mid")).otherwise(F.coalesce("behind", F.when(both, F.col("right_start")))))
    g = g.withColumn("missing", F.coalesce(F.col("b") - F.col("a") <= 0, F.lit(True))).withColumn("tied", F.coalesce(~F.col("one") & (F.col("n_gaps") > 1), F.lit(False)))
    g = g.withColumn("far", ~F.col("one") & (F.abs((F.col("a") + F.col("b")) / 2 - F.col("mid")) > F.col("width") * off))
    g = g.withColumn("way", F.when(~F.col("far") | ~both, "gap").when(F.col("left_end") < F.col("right_start"), "starts").when(F.col("left_most") < F.col("right_most"), "ends").otherwise("middle"))
    pick = lambda gap, starts, ends, middle: F.when(F.col("way") == "starts", starts).when(F.col("way") == "ends", ends).when(F.col("way") == "middle", middle).otherwise(gap)
    g = g.withColumn("gutter_left", pick(F.col("a"), F.col("left_end"), F.col("left_most"), F.col("mid") - near))
    g = g.withColumn("gutter_right", pick(F.col("b"), F.col("right_start"), F.col("right_most"), F.col("mid") + near))
    g = g.withColumn("split", pick((F.col("a") + F.col("b")) / 2, (F.col("left_end") + F.col("right_start")) / 2, F.col("mid"), F.col("mid")))
    g = g.withColumn("off", F.col("far") & (F.abs(F.col("split") - F.col("mid")) > F.col("width") * off))

    measured = with_boxes(words.join(g.drop("mid", "width"), page).join(layout.char_metrics(words, page).select(page, "char_width"), page), tables, page)
    sides = measured.groupBy(page).agg(F.count_if(F.col("x1") < F.col("split")).alias("n_left"), F.count_if(F.col("x0") > F.col("split")).alias("n_right"), F.min(F.when(capital_over_split(), F.col("x0"))).alias("cap_left"), F.max(F.when(capital_over_split(), F.col("x1"))).alias("cap_right"))
    g = g.join(sides, page).withColumn("gutter_left", F.least("gutter_left", "cap_left")).withColumn("gutter_right", F.greatest("gutter_right", "cap_right"))
    wide = (F.col("x1") - F.col("x0") > 4 * F.col("char_width")) & ~((F.length(F.trim("text")) <= 2) & (F.col("x1") - F.col("x0") <= 12 * F.col("char_width")))
    astray = F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("split")) > near * F.when(F.col("way") == "middle", 2.0).otherwise(1.0)
    again = measured.drop("gutter_left", "gutter_right").join(g.select(page, "gutter_left", "gutter_right"), page)
    across = again.groupBy(page).agg(F.count_if(crosses_split() & wide & astray & ~(capital_over_split() & in_gutter(near))).alias("n_across"))
    empty = (F.col("n_left") == 0) & (F.col("n_right") == 0) | (F.col("n_right") == 0) & (F.col("last") > F.col("split") + near) | (F.col("n_left") == 0) & (F.col("first") < F.col("split") - near)
    rule = F.when(F.col("missing"), "COLUMN_SPLIT_MISSING").when(F.col("tied"), "COLUMN_SPLIT_COMPETING").when(F.col("off"), "COLUMN_SPLIT_OFFCENTER").when(empty, "COLUMN_SPLIT_CLUSTER_MISSING").when(F.col("n_across") > 0, "COLUMN_SPLIT_CROSS")
    return g.join(across, page).select(page, "split", "gutter_left", "gutter_right", "tall", rule.alias("error"))


def line_roles(lines: DataFrame, pages: DataFrame, page: str = "page") -> DataFrame:
    """lines with role: spanning_header for the centred lines that a page begins with, at most 12 apart; center_structural
    for other centred lines; spanning_reference for wide notes in small type and centred capital headings; else null.

    pages has page, width and body_size. Section headers and table labels are only ever spanning headers. Where all lines
    of a page are centred, it has no spanning headers.
    """
    own = Window.partitionBy(page).orderBy("top", "x0")
    centered = X.in_center_band(F.col("x0"), F.col("x1"), F.col("width"))
    marked = lines.join(pages.select(page, "width", "body_size"), page).withColumn("mid", F.coalesce(centered, F.lit(False)))
    near = F.coalesce(F.col("top") - F.lag("top").over(own) <= P.HEADER_LINE_GAP, F.lit(True))
    marked = marked.withColumn("leads", (F.col("mid") & near).cast("int"))
    marked = marked.withColumn("leads", F.min("leads").over(own.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    whole = Window.partitionBy(page)
    marked = marked.withColumn("leads", F.col("leads") & ~F.min("leads").over(whole))
    plain = ~F.trim("text").rlike(P.PAGE_SECTION_LINE) & X.table_label(F.trim("text")).isNull()
    spans = X.is_spanning_note(F.col("x0"), F.col("x1"), F.col("size_median"), F.col("body_size"), F.col("width")) | X.is_spanning_heading(F.col("text"), F.col("x0"), F.col("x1"), F.col("width"))
    role = F.when(F.col("leads"), "spanning_header").when(F.col("mid") & plain, "center_structural").when(plain & spans, "spanning_reference")
    return marked.withColumn("role", role).drop("mid", "leads", "width", "body_size")


def away_from(words: DataFrame, lines: DataFrame, page: str) -> DataFrame:
    """Words whose top isn't within the line tolerance of one of the lines of their page."""
    tops = lines.groupBy(page).agg(F.collect_set("top").alias("tops"))
    held = words.join(tops, page, "left")
    return held.where(F.col("tops").isNull() | ~F.exists("tops", lambda t: F.abs(F.col("top") - t) <= P.LINE_TOLERANCE)).drop("tops")


def gutter_line_fits() -> Column:
    """Whether a line over the gutter is a reference, an index mark or a fragment, and neither prose, in a table nor a header."""
    text, x0, x1, width, char = F.col("text"), F.col("x0"), F.col("x1"), F.col("width"), F.col("char_width")
    bare = F.trim(text)
    slim = x1 - x0 <= 3 * char
    note = X.is_spanning_note(x0, x1, F.col("size_median"), F.col("body_size"), width)
    symbol = X.is_spanning_symbol(text, x0, x1, width)
    letters = bare.rlike(r"^-?[A-Za-z]{1,2}\z") & slim
    marks = bare.rlike(r"^[^\p{L}\p{N}\s]{1,2}\z") & slim
    numbers = bare.rlike(r"^(?=.*[0-9])[0-9().]{1,3}\z") & slim
    tiny = (F.length(bare).between(1, 3)) & slim & in_gutter(0.0)
    prose = X.has_prose_mark(text) & ~(note | symbol | marks | numbers | tiny)
    like = X.dotted(text) | X.is_toc_reference(text) | X.is_appendix_reference(text) | X.is_repeated_keyword(text) | note | X.is_index_letter(text, x0, x1, width) | X.is_index_digit(text, x0, x1, width) | symbol | letters | marks | numbers | tiny
    return ~meets_table() & (bare.rlike(r"^[A-Z]\z") | (~prose & like & ~bare.rlike(P.PAGE_SECTION_LINE)))


def ordered_lines(words: DataFrame, tables: DataFrame, pages: DataFrame, page: str = "page") -> DataFrame:
    """page, line_no, column, role, text, x0, x1, top, bottom, split, error in reading order: spanning lines, left, right.

    words: page, text, x0, x1, top, bottom, size. tables: page and boxes. pages: page, width, height, body_size. Words in
    the top and bottom tenth are left out; centred lines inside a page are dropped. error is the page's broken rule of
    the gutter (column_bounds), or GUTTER_LINE_AMBIGUOUS on a line over the gutter that fits nowhere. Pages without words
    in the body have no lines; without words for two columns they have their spanning lines alone. A null place is none.
    """
    placed = words.select(page, "text", "x0", "x1", "top", "bottom", "size").join(pages.select(page, "height"), page)
    body = placed.where((F.col("top") > F.col("height") * P.HEADER_BAND) & (F.col("top") < F.col("height") * P.FOOTER_BAND)).drop("height")
    metrics = layout.char_metrics(body, page)
    lines = settled(with_boxes(line_roles(layout.words_to_lines(body, page, metrics=metrics), pages, page), tables, page))
    named = lines.where("role is not null")
    bounds = settled(column_bounds(away_from(body, named, page), tables, pages, page))
    kept = named.where((F.col("role") != "spanning_reference") | ~meets_table())
    spanning = kept.where("role != 'center_structural'").select(page, F.lit("spanning").alias("column"), "role", "text", "x0", "x1", "top", "bottom", F.lit(None).cast("string").alias("own_error"))

    sided = with_boxes(away_from(body, kept, page).join(bounds, page), tables, page)
    middle = (F.col("x0") + F.col("x1")) / 2
    side = F.when(capital_over_split() & in_gutter(P.GUTTER_TOLERANCE), "gutter").when(middle < F.col("split") - P.GUTTER_TOLERANCE / 2, "left").when(middle > F.col("split") + P.GUTTER_TOLERANCE / 2, "right").otherwise("gutter")
    keyed = sided.withColumn("key", F.struct(F.col(page).alias("page"), side.alias("side"))).select("key", "text", "x0", "x1", "top", "bottom", "size")
    by_key = keyed.select("key").distinct().withColumn(page, F.col("key.page")).join(metrics, page).drop(page)
    built = layout.words_to_lines(keyed, "key", metrics=by_key).withColumn(page, F.col("key.page")).withColumn("side", F.col("key.side")).drop("key")
    judged = with_boxes(built.join(pages.select(page, "width", "body_size"), page).join(metrics.select(page, "char_width"), page).join(bounds.select(page, "gutter_left", "gutter_right"), page), tables, page)
    fits, over = F.coalesce(gutter_line_fits(), F.lit(False)), F.col("side") == "gutter"
    columns = judged.select(
        page,
        F.when(over, "spanning").otherwise(F.col("side")).alias("column"),
        F.when(over, "spanning_reference").alias("role"),
        "text", "x0", "x1", "top", "bottom",
        F.when(over & ~fits, "GUTTER_LINE_AMBIGUOUS").alias("own_error"),
    )
    rank = F.when(F.col("column") == "spanning", 0).when(F.col("column") == "left", 1).otherwise(2)
    joined = spanning.unionByName(columns).join(bounds.select(page, "split", "error"), page, "left")
    numbered = joined.withColumn("line_no", F.row_number().over(Window.partitionBy(page).orderBy(rank, "top", "x0", "text")))
    return numbered.select(page, "line_no", "column", "role", "text", "x0", "x1", "top", "bottom", "split", F.coalesce("own_error", "error").alias("error"))


def turned(rows: DataFrame, angle: int, ordered: bool = True) -> DataFrame:
    """rows (x0, x1, top, bottom, and the page's width and height) after the page is turned by 0, 90 or 270 degrees.

    Boxes are ordered; segments (ordered=False) keep which of their points is the first.
    """
    w, h = F.col("width"), F.col("height")
    (ax, ay), (bx, by) = (layout.rotated(F.col(x), F.col(y), w, h, angle) for x, y in (("x0", "top"), ("x1", "bottom")))
    if not ordered:
        return rows.withColumns({"x0": ax, "x1": bx, "top": ay, "bottom": by})
    places = {"x0": F.least(ax, bx), "x1": F.greatest(ax, bx), "top": F.least(ay, by), "bottom": F.greatest(ay, by)}
    return rows.withColumns(places)


def tables_by_rotation(segments: DataFrame, chars: DataFrame, pages: DataFrame, page: str = "page") -> DataFrame:
    """page, rotation, table_no, x0, x1, top, bottom, n_cross, score, tie: the ruled tables of each page as it is best turned.

    Boxes are in the page's own coordinates. A rotation scores by the glyphs inside its tables that it sets upright, then
    by crossings, area, and the smaller angle. tie is default_rotation_0 where two rotations are equal without such
    glyphs, and 0 is taken, TABLE_ROTATION_AMBIGUOUS where they are equal with them, else null. Pages without tables have no rows.
    segments: page, x0, x1, top, bottom. chars: the same with rotation, of layout.char_rotation. pages: page, width, height.
    """
    size = pages.select(page, "width", "height")
    tried = []
    for angle in P.TABLE_ROTATIONS:
        rulings = layout.ruling_lines(turned(segments.join(size, page), angle, ordered=False), page)
        found = layout.ruled_tables(rulings, page).join(size, page)
        swapped = found if angle == 0 else found.withColumns({"width": F.col("height"), "height": F.col("width")})
        tried.append(turned(swapped, -angle % 360).drop("width", "height").withColumn("rotation", F.lit(angle)))
    found = reduce(DataFrame.unionByName, tried)
    boxes = found.groupBy(page, "rotation").agg(F.sum("n_cross").alias("n_cross"), F.sum((F.col("x1") - F.col("x0")) * (F.col("bottom") - F.col("top"))).alias("area"), F.collect_list(F.struct("x0", "x1", "top", "bottom")).alias("boxes"))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    glyphs = chars.where("rotation is not null").select(page, x.alias("x"), y.alias("y"), ((360 - F.col("rotation")) % 360).alias("rotation"))
    inside = glyphs.join(boxes.select(page, "rotation", "boxes"), [page, "rotation"]).where(F.exists("boxes", lambda b: layout.in_box(F.col("x"), F.col("y"), b)))
    scored = boxes.join(inside.groupBy(page, "rotation").agg(F.count("*").alias("score")), [page, "rotation"], "left").fillna(0, ["score"])
    own = Window.partitionBy(page)
    evidence = F.struct("score", "n_cross", "area")
    ranked = scored.withColumn("best", F.max(evidence).over(own)).where(evidence == F.col("best")).withColumn("n", F.count("*").over(own)).withColumn("first", F.min("rotation").over(own))
    tie = F.when((F.col("n") > 1) & (F.col("score") == 0), "default_rotation_0").when(F.col("n") > 1, "TABLE_ROTATION_AMBIGUOUS")
    chosen = ranked.where(F.col("rotation") == F.col("first")).select(page, F.when(tie == "default_rotation_0", 0).otherwise(F.col("rotation")).alias("rotation"), "score", tie.alias("tie"))
    return found.join(chosen, [page, "rotation"]).select(page, "rotation", "table_no", "x0", "x1", "top", "bottom", "n_cross", "score", "tie")
