"""Numbered sections and tables over the pages of a document: ordered folds, one document in one task."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import page_text as X
from folioforge.functions import patterns as P

SECTIONS = "doc string, section_id string, depth int, start_page int, end_page int, chapter string, body string, error string"


def section_stack(lines: DataFrame) -> DataFrame:
    """Sections of lines (doc, page, line_no, text), in order of their end; a failing document gives one row with its error.

    A heading closes sections as deep as its own or deeper; a `SECTION` marker closes one and isn't emitted, so what
    follows belongs to the parent; text goes to the innermost open section, which alone moves its end page.
    Optional columns: contents (lines of a page of contents, which don't count), apart (lines that aren't body text: see
    set_apart). Lines apart are left out of the bodies, and a heading among them is an error.
    """
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) if c in lines.columns else F.lit(False).alias(c) for c in ("contents", "apart")]
    marked = lines.select("doc", "page", "line_no", "text", *flags, X.true_heading(F.col("text")).alias("heading"), X.section_marker(F.col("text")).alias("marker"), X.chapter(F.col("text")).alias("chapter"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["page", "line_no"])
        first = pdf.dropna(subset=["chapter"]).drop_duplicates("page").set_index("page")["chapter"]
        chapter, stack, seen, done, last = None, [], set(), [], None
        close = lambda: done.append(stack.pop())
        doc = pdf["doc"].iloc[0]
        for r in pdf.itertuples():
            if r.page != last:
                chapter, last = first.get(r.page, chapter), r.page
            if r.contents:
                continue
            if isinstance(r.marker, str):
                if stack:
                    close()
                continue
            if isinstance(r.heading, str):
                own = r.heading
                if r.apart or own in seen:
                    rule = "SECTION_HEADER_SKIPPED" if r.apart else "SECTION_APPEND_VIOLATION" if stack and stack[-1][0] == own else "SECTION_DUPLICATE"
                    return pd.DataFrame([[doc, own, None, r.page, r.page, chapter, None, f"RULE={rule} PDF_PAGE={r.page} detail={own}"]], columns=[c.split()[0] for c in SECTIONS.split(", ")])
                level = len(re.findall(r"\d+", own))
                while stack and level <= stack[-1][1]:
                    close()
                seen.add(own)
                stack.append([own, level, r.page, r.page, chapter, [r.text]])
            elif stack and not r.apart:
                stack[-1][3] = r.page
                stack[-1][5].append(r.text)
        while stack:
            close()
        rows = [[doc, s[0], s[1], s[2], s[3], s[4], "\n".join(s[5]), None] for s in done]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SECTIONS.split(", ")])

    return marked.groupBy("doc").applyInPandas(fold, SECTIONS)


def set_apart(lines: DataFrame, labels: DataFrame, notes: DataFrame) -> DataFrame:
    """lines (doc, page, line_no, text, top, and role where columns.ordered_lines gave one) with `apart`.

    Apart are spanning references, the lines of table labels (doc, page, top, text: the same text at the same height, give
    or take the tolerance of lines) and of footnotes (doc, page, top: the same height). A page has few of either.
    """
    marks = labels.groupBy("doc", "page").agg(F.collect_list(F.struct("top", "text")).alias("__labels"))
    feet = notes.groupBy("doc", "page").agg(F.collect_set("top").alias("__notes"))
    on = lambda l: (F.abs(l["top"] - F.col("top")) <= P.LINE_TOLERANCE) & (l["text"] == F.col("text"))
    spans = F.col("role") == "spanning_reference" if "role" in lines.columns else F.lit(False)
    found = [F.coalesce(c, F.lit(False)) for c in (spans, F.exists("__labels", on), F.array_contains("__notes", F.col("top")))]
    held = lines.join(marks, ["doc", "page"], "left").join(feet, ["doc", "page"], "left")
    return held.withColumn("apart", found[0] | found[1] | found[2]).drop("__labels", "__notes")


def fallback_pages(lines: DataFrame, sections: DataFrame) -> DataFrame:
    """doc, page, file_name, content of each page of the documents that have no row in sections."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    pages = lines.join(sections.select("doc").distinct(), "doc", "left_anti").groupBy("doc", "page").agg(F.array_join(F.transform(rows, lambda r: F.coalesce(r["text"], F.lit(""))), "\n").alias("body"))
    head = F.concat(F.lit("PDF_PAGE: "), F.col("page").cast("string"), F.lit("\nMODE: UNSECTIONED_FALLBACK\n--------------------------------\n"))
    return pages.select("doc", "page", F.format_string("page_%04d.txt", F.col("page").cast("int")).alias("file_name"), F.concat(head, F.col("body"), F.lit("\n")).alias("content"))


TABLES = "doc string, table_id string, start_page int, end_page int, columns array<string>, rows array<array<string>>, error string"


def resolve_table_ids(tables: DataFrame) -> DataFrame:
    """tables (doc, page, idx, table_id, continued, ...) with ids resolved, and continued_from and warning.

    A table without an id gets UNLABELED_P<page>_T<idx>; one marked as continued gets the last id that its base (the id
    without its bracketed end) had before, or keeps its own with a warning.
    """
    named = F.coalesce("table_id", F.concat(F.lit("UNLABELED_P"), F.col("page").cast("string"), F.lit("_T"), F.col("idx").cast("string")))
    goes_on = F.coalesce("continued", F.lit(False))
    before = Window.partitionBy("doc", "__base").orderBy("page", "idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = tables.withColumn("__id", named).withColumn("__base", F.trim(F.regexp_replace("__id", r"\(.*\)$", "")))
    rows = rows.withColumn("__last", F.last(F.when(~goes_on, F.col("__id")), ignorenulls=True).over(before))
    place = F.concat(F.lit(" PDF_PAGE="), F.col("page").cast("string"))
    missing = F.when(F.col("table_id").isNull(), F.concat(F.lit("TABLE_LABEL_MISSING"), place))
    orphan = F.when(goes_on & F.col("__last").isNull(), F.concat(F.lit("TABLE_CONTINUED_WITHOUT_PRIOR"), place, F.lit(" table_id="), F.col("__id")))
    rows = rows.withColumn("continued_from", F.when(goes_on, F.col("__last"))).withColumn("warning", F.nullif(F.concat_ws("\n", missing, orphan), F.lit("")))
    return rows.withColumn("table_id", F.coalesce("continued_from", "__id")).drop("__id", "__base", "__last")


def continue_tables(tables: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Tables merged over pages. Input: doc, page, idx, table_id, columns, rows, touches_bottom, rotation, continued.

    A table at its page's bottom stays open. On the next page one with its id goes on with it if a label there marks it as
    continued, or if the columns are the same and a label there names it. Without such a table the open one ends, but a
    label that marks it as continued, one that names it on a page without tables, and a table with its id that isn't proven
    to go on are errors; so are two that could go on, another rotation, two open tables and one open at the end. A failing
    document gives one row with its error.

    pages: doc, page, labels (texts of the page's label lines), one row for every page. Where none are given, the pages are
    those with tables and what lies between, and a table's id and `continued` stand for its label.
    """
    names = [c.split()[0] for c in TABLES.split(", ")]
    label = re.compile(P.TABLE_LABEL)

    def fold(pdf: pd.DataFrame, given: pd.DataFrame | None = None) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame([], columns=names)
        pdf, doc = pdf.sort_values(["page", "idx"]), pdf["doc"].iloc[0]
        failed = lambda page, why: pd.DataFrame([[doc, None, page, page, None, None, f"RULE=TABLE_CONTINUATION PDF_PAGE={page} detail={why}"]], columns=names)
        own = {page: list(rows.itertuples()) for page, rows in pdf.groupby("page")}
        texts = {} if given is None else {r.page: [] if r.labels is None else [t for t in r.labels if t is not None] for r in given.itertuples()}
        done, pending = [], None
        for page in sorted({*own, *texts}):
            rows = own.get(page, [])
            if pending is not None and given is None and page > pending["end"] + 1:
                done.append(pending)
                pending = None
            if pending is not None:
                same = [r for r in rows if r.table_id == pending["id"]]
                if given is None:
                    marked, named = any(r.continued for r in same), bool(same)
                else:
                    upper = [t.upper() for t in texts.get(page, [])]
                    marked = any("TABLE" in t and pending["id"].upper() in t and "CONTINUED" in t for t in upper)
                    named = any(label.match(t.strip()) and pending["id"] in t.upper() for t in texts.get(page, []))
                on = [r for r in same if marked or (named and list(r.columns) == pending["columns"])]
                if len(on) > 1:
                    return failed(page, "two tables with the open one's id")
                if on and on[0].rotation != pending["rotation"]:
                    return failed(page, "rotation differs")
                if on:
                    pending["rows"] += [list(x) for x in on[0].rows]
                    pending["end"] = page
                    rows.remove(on[0])
                elif marked or (named and not rows):
                    return failed(page, "a label of the open table without its grid")
                elif same:
                    return failed(page, "the open table's id comes again without proof")
                if not on or not on[0].touches_bottom:
                    done.append(pending)
                    pending = None
            for r in rows:
                new = {"id": r.table_id, "start": page, "end": page, "columns": list(r.columns), "rows": [list(x) for x in r.rows], "rotation": r.rotation}
                if not r.touches_bottom:
                    done.append(new)
                elif pending is not None:
                    return failed(page, "two open tables")
                else:
                    pending = new
        if pending is not None:
            return failed(pending["end"], "still open at the end")
        return pd.DataFrame([[doc, t["id"], t["start"], t["end"], t["columns"], t["rows"], None] for t in done], columns=names)

    if pages is None:
        return tables.groupBy("doc").applyInPandas(lambda pdf: fold(pdf), TABLES)
    return tables.groupBy("doc").cogroup(pages.select("doc", "page", "labels").groupBy("doc")).applyInPandas(fold, TABLES)


def amendments_named(bands: DataFrame) -> DataFrame:
    """page, error for pages whose header or footer (see layout.header_footer) names an amendment."""
    found = bands.withColumn("__t", F.concat_ws(" ", "header", "footer")).where(X.names_amendment(F.col("__t")))
    return found.select("page", X.error_text(F.lit("AMENDMENT_DETECTED"), F.col("page"), F.col("__t")).alias("error"))


def page_spans(sections: DataFrame) -> DataFrame:
    """doc, section_id, pages (`a` or `a–b`), contiguous: whether the section's pages (an array) follow each other."""
    first, last, n = F.array_min("pages"), F.array_max("pages"), F.size(F.array_distinct("pages"))
    span = F.when(first == last, first.cast("string")).otherwise(F.concat(first.cast("string"), F.lit("–"), last.cast("string")))
    return sections.select("doc", "section_id", span.alias("pages"), (last - first + 1 == n).alias("contiguous"))


def with_following(lines: DataFrame) -> DataFrame:
    """lines (doc, page, line_no, text) with the text of the next line and of the one after it on the same page."""
    own = Window.partitionBy("doc", "page").orderBy("line_no")
    return lines.withColumn("following", F.lead("text", 1).over(own)).withColumn("after_following", F.lead("text", 2).over(own))


def integrity(sections: DataFrame) -> DataFrame:
    """doc, section_id, found: bodies with another section's heading in them; none where all is well."""
    body = sections.select("doc", "section_id", F.posexplode(F.split("body", "\n")).alias("n", "line")).where("n > 0")
    inner = body.select("doc", "section_id", X.true_heading(F.col("line")).alias("found")).where("found is not null and found != section_id")
    return inner.join(sections.select("doc", F.col("section_id").alias("found")).distinct(), ["doc", "found"], "left_semi")
