"""Predicates on lines of pages: text alone, or text with its place. Each is one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from . import text as T


def dotted(text: Column) -> Column:
    return text.rlike(P.DOT_LEADERS)


def has_prose_mark(text: Column) -> Column:
    return ~dotted(text) & text.rlike(P.PROSE_MARK)


def ends_in_page_number(text: Column) -> Column:
    return text.rlike(P.PAGE_REFERENCE)


def is_toc_reference(text: Column) -> Column:
    return dotted(text) & ends_in_page_number(text)


def is_toc_continuation(text: Column, following: Column) -> Column:
    return F.coalesce(is_toc_reference(following), F.lit(False)) & text.rlike(P.TOC_START)


def is_toc_header(text: Column) -> Column:
    return F.contains(F.upper(F.regexp_replace(text, r"\s+", "")), F.lit("TABLEOFCONTENTS"))


def is_appendix_reference(text: Column) -> Column:
    return text.rlike(P.APPENDIX_LINE)


def is_appendix_toc(text: Column) -> Column:
    bare = T.trim(text)
    return is_appendix_reference(text) & (dotted(bare) | ends_in_page_number(bare) | ((bare == F.upper(bare)) & ~has_prose_mark(bare)))


def is_repeated_keyword(text: Column) -> Column:
    return text.rlike(P.REPEATED_KEYWORD)


def in_center_band(x0: Column, x1: Column, width: Column) -> Column:
    return (x0 >= width * (0.5 - P.CENTER_BAND / 2)) & (x1 <= width * (0.5 + P.CENTER_BAND / 2))


def is_centered(x0: Column, x1: Column, width: Column) -> Column:
    return F.abs((x0 + x1) / 2 - width / 2) <= width * (P.CENTER_BAND / 2)


def is_spanning_note(x0: Column, x1: Column, size: Column, body: Column, width: Column) -> Column:
    return F.coalesce((x1 - x0 >= width * 0.7) & (size <= body - 1.0), F.lit(False))


def is_spanning_heading(text: Column, x0: Column, x1: Column, width: Column) -> Column:
    return ~text.rlike("[a-z]") & (F.length(F.regexp_replace(F.upper(text), "[^A-Z]", "")) >= 4) & is_centered(x0, x1, width)


def is_index_letter(text: Column, x0: Column, x1: Column, width: Column) -> Column:
    return T.trim(text).rlike(r"^\p{L}\z") & is_centered(x0, x1, width)


def is_index_digit(text: Column, x0: Column, x1: Column, width: Column) -> Column:
    return T.trim(text).rlike(r"^\p{Nd}\z") & is_centered(x0, x1, width)


def is_spanning_symbol(text: Column, x0: Column, x1: Column, width: Column) -> Column:
    return T.trim(text).rlike(r"^(?:\(cid:\d+\)|[^\p{L}\p{N}\s])\z") & is_centered(x0, x1, width)


def is_fragment(text: Column, x0: Column, x1: Column, char_width: Column, kind: str = r"[A-Za-z]+|\p{P}+|\d+") -> Column:
    """At most three characters of one kind, at most three character widths wide."""
    return T.trim(text).rlike(rf"^(?:{kind})\z") & (F.length(T.trim(text)) <= 3) & (x1 - x0 <= 3 * char_width)


def true_heading(text: Column) -> Column:
    """The section id of a line that is a heading: no parenthesis behind the id, then a title with a capital first; else null."""
    rest = F.regexp_extract(text, P.TRUE_HEADING, 2)
    return F.when(~F.startswith(rest, F.lit("(")) & F.ltrim(rest).rlike(r"^\p{Lu}"), T.group(text, P.TRUE_HEADING))


def section_marker(text: Column) -> Column:
    return T.group(text, P.SECTION_MARKER)


def chapter(text: Column) -> Column:
    return T.group(text, P.CHAPTER_ANY)


def table_label(text: Column) -> Column:
    """(id, title) of a table's label line."""
    return F.when(T.group(text, P.TABLE_LABEL).isNotNull(), F.struct(T.group(text, P.TABLE_LABEL).alias("id"), T.group(text, P.TABLE_LABEL, 2).alias("title")))


def has_continued_mark(text: Column, table_id: Column) -> Column:
    up = F.upper(text)
    return F.contains(up, F.lit("TABLE")) & F.contains(up, F.upper(table_id)) & F.contains(up, F.lit("CONTINUED"))


def names_amendment(text: Column) -> Column:
    return text.rlike(P.AMENDMENT_WORD)


def depth(section: Column) -> Column:
    return F.regexp_count(section, F.lit(r"\d+"))


def clean_cell(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def error_text(rule: Column, page: Column, detail: Column) -> Column:
    return F.concat(F.lit("RULE="), rule, F.lit(" PDF_PAGE="), F.coalesce(page.cast("string"), F.lit("unknown")), F.lit(" detail="), detail)
