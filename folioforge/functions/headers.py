"""Section headers and file names as metadata structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from . import text as T

HEADER_FIELDS = ("code_system", "title", "chapter", "section_id", "target_section_id", "amendment_action", "section_title", "section_label")


def parse_header(line: Column, min_parts: int = 3, with_amendment: bool = True) -> Column:
    """The parts of a `SECTION: a | b | ...` line, or null: no such prefix, or fewer than min_parts parts that aren't blank.

    The last part of a kind counts; the first part of no kind is the section's title.
    """
    body = F.substring(line, len(P.HEADER_PREFIX) + 1, 1 << 30)
    parts = F.filter(F.transform(F.split(body, r"\|"), T.trim), lambda p: p != "")
    rest = F.slice(parts, 2, 1 << 30)
    words = ["Title", "Chapter", "Section", "Target", "Op"][: 5 if with_amendment else 3]
    last = lambda word: F.try_element_at(F.filter(rest, lambda p: p.rlike(rf"(?i)^{word}\b")), F.lit(-1))
    bare = lambda word: T.trim(F.regexp_replace(last(word), rf"(?i)^{word}\s+", ""))
    title = F.try_element_at(F.filter(rest, lambda p: ~p.rlike(r"(?i)^(?:" + "|".join(words) + r")\b")), F.lit(1))
    section = bare("Section")
    label = F.when(F.coalesce(section, F.lit("")) != "", F.concat_ws(" – ", F.concat(F.lit("Section "), section), title))
    none = F.lit(None).cast("string")
    values = (F.get(parts, 0), last("Title"), last("Chapter"), section, bare("Target") if with_amendment else none, bare("Op") if with_amendment else none, title, label)
    return F.when(F.startswith(line, F.lit(P.HEADER_PREFIX)) & (F.size(parts) >= min_parts), F.struct(*(v.alias(n) for n, v in zip(HEADER_FIELDS, values))))


def header_lines(lines: Column) -> Column:
    """1 when the first line is a header, which is then no content even if it can't be parsed."""
    return F.coalesce(F.startswith(F.get(lines, 0), F.lit(P.HEADER_PREFIX)).cast("int"), F.lit(0))


def parse_file_name(name: Column) -> Column:
    """title, chapter_number, chapter, section, section_label, public_url of `Title-.._Chapter-.._Section-...txt`; null without all three."""
    parts = F.split(F.regexp_replace(name, r"(?i)\.txt\z", ""), "_")
    first = lambda kind: F.regexp_replace(F.get(F.filter(parts, lambda p: F.startswith(p, F.lit(kind))), 0), "^" + kind, "")
    title, chapter, section = first("Title-"), first("Chapter-"), first("Section-")
    number = F.regexp_replace(chapter, "^[^-]*-", "")
    whole = title.isNotNull() & chapter.isNotNull() & section.isNotNull()
    return F.when(whole, F.struct(title.alias("title"), number.alias("chapter_number"), F.concat_ws("-", title, number).alias("chapter"), section.alias("section"), F.concat(F.lit("Section "), section).alias("section_label"), T.section_url(section).alias("public_url")))


def merged(file_value: Column, header_value: Column, kind: Column) -> Column:
    """A file name's value before the header's, for amendments only."""
    return F.when(kind == "amendment", F.coalesce(file_value, header_value)).otherwise(header_value)
