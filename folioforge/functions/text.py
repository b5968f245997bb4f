"""Scalar text functions as columns. A null stands for what is absent; a pattern that doesn't match gives null, never ''."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def group(text: Column, pattern: str, n: int = 1) -> Column:
    """The first match's group, or null."""
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{P.SPACE}+|{P.SPACE}+\z", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(trim(text) == "", F.lit(True))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond U+FFFF count twice."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def one_spaced(text: Column) -> Column:
    return trim(F.regexp_replace(text, rf"{P.SPACE}+", " "))


def normalized(text: Column) -> Column:
    """Trimmed, without closing punctuation, lower-cased; a null gives ''."""
    return F.lower(F.regexp_replace(trim(F.coalesce(text, F.lit(""))), r"[.:;,\s]+\z", ""))


def section_id(raw: Column) -> Column:
    """Without closing punctuation, R before a leading digit, the first letter in upper case; null when blank."""
    bare = F.regexp_replace(trim(raw), r"[)\].,:;]+\z", "")
    named = F.when(bare.rlike("^[0-9]"), F.concat(F.lit("R"), bare)).when(bare.rlike("^[a-z]"), F.concat(F.upper(F.substring(bare, 1, 1)), F.substring(bare, 2, 1 << 30))).otherwise(bare)
    return F.when(~is_blank(raw), named)


def section_in_text(text: Column) -> Column:
    return section_id(group(text, P.SECTION_IN_TEXT))


def section_in_path(path: Column) -> Column:
    """The first part of the file's name that is an id by itself; a leading item number counts as one."""
    name = F.element_at(F.split(path, r"[\\/]"), -1)
    parts = F.transform(F.split(name, "_"), lambda p: F.regexp_replace(p, r"(?i)\.txt\z", ""))
    return section_id(F.get(F.filter(parts, lambda p: p.rlike(P.SECTION_ALONE)), 0))


def has_any(text: Column, phrases) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in phrases))


def first_rule(rules, text: Column, otherwise: str) -> Column:
    """The name of the first rule one of whose phrases is in the text."""
    picked = reduce(lambda a, r: a.when(has_any(text, r[1]), F.lit(r[0])), rules[1:], F.when(has_any(text, rules[0][1]), F.lit(rules[0][0])))
    return picked.otherwise(F.lit(otherwise))


def action_of_operation(operation: Column) -> Column:
    return first_rule([(w, (w,)) for w in P.ACTION_WORDS], F.lower(F.coalesce(operation, F.lit(""))), "unknown")


def action_of_text(text: Column) -> Column:
    return first_rule(P.ACTION_PHRASES, F.lower(F.coalesce(text, F.lit(""))), "unknown")


def operation_of_text(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    inserts = reduce(lambda a, b: a & b, (F.contains(low, F.lit(p)) for p in P.DEFINITION_INSERT))
    return F.when(inserts, F.lit("modify_definition_insert_after")).otherwise(first_rule(P.OPERATION_PHRASES, low, "unknownop"))


def is_item_start(line: Column) -> Column:
    return line.rlike(P.ITEM_START)


def source_number(line: Column) -> Column:
    return group(line, P.ITEM_NUMBER).try_cast("long")


def lines_of(text: Column) -> Column:
    """The text's lines, cut at LF and CRLF alone; a lone CR and a form feed are characters like any other."""
    return F.split(F.coalesce(text, F.lit("")), r"\r?\n", -1)


def unix_lines(text: Column, squeeze: bool = False) -> Column:
    """CRLF, CR and form feeds as line feeds; with squeeze three or more of these as two."""
    plain = F.regexp_replace(text, r"\r\n|\r|\f", "\n")
    return F.regexp_replace(plain, r"\n{3,}", "\n\n") if squeeze else plain


def clean_item(text: Column) -> Column:
    return trim(F.regexp_replace(text, r"(?m)[ \t]+$", ""))


def item_reasons(text: Column, section: Column, operation: Column) -> Column:
    """What makes an item suspicious, in this order; empty when nothing does."""
    quoted = F.regexp_extract_all(text, F.lit(P.QUOTED), F.lit(1))
    elsewhere = (operation == "replace_section") & section.isNotNull() & (F.size(quoted) > 0) & ~F.exists(quoted, lambda q: F.contains(F.upper(q), F.upper(section)))
    return F.array_compact(
        F.array(
            F.when(utf16_length(text) <= P.SHORT_ITEM, F.lit("text_too_short")),
            F.when(~text.rlike(P.ITEM_PHRASE), F.lit("missing_in_irc_section_phrase")),
            F.when(F.coalesce(section, F.lit("")) == "", F.lit("missing_section_id")),
            F.when(elsewhere, F.lit("section_id_not_in_quoted_block")),
        )
    )


def item_file_name(number: Column, section: Column, operation: Column) -> Column:
    digits = number.cast("string")
    padded = F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
    named = F.coalesce(F.nullif(section, F.lit("")), F.lit("UNKNOWN"))
    return F.concat(padded, F.lit("_"), F.regexp_replace(named, r"[^A-Za-z0-9.]+", "-"), F.lit("_"), F.coalesce(F.nullif(operation, F.lit("")), F.lit("unknownop")), F.lit(".txt"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9]+", "-"), r"^-+|-+\z", "")


def section_title(raw: Column) -> Column:
    """Without one closing full stop; null when nothing is left."""
    return F.nullif(trim(F.regexp_replace(raw, r"\s*\.\z", "")), F.lit(""))


def looks_like_code(query: Column) -> Column:
    return query.rlike(P.CODE_LETTER) | query.rlike(P.CODE_DASHED)


def has_quote_and_citation(sentence: Column) -> Column:
    return sentence.rlike(P.QUOTE_MARK) & sentence.rlike(P.CITATION)


def wants_comparison(query: Column, first: str = r"(?i)\b(?:when|okay|ok)\b", second: str = r"\b(?:24|16)\b") -> Column:
    return query.rlike(first) & query.rlike(second)


def section_url(section: Column) -> Column:
    """Null for fewer than three dashed parts."""
    parts = F.split(section, "-")
    a, b, rest = F.get(parts, 0), F.get(parts, 1), F.array_join(F.slice(parts, 3, 1 << 30), "-")
    url = reduce(lambda text, kv: F.replace(text, F.lit(kv[0]), kv[1]), (("{title}", a), ("{chapter}", b), ("{rest}", rest)), F.lit(P.SECTION_URL))
    return F.when(F.size(parts) >= 3, url)


def structure_in_query(query: Column) -> Column:
    """(title, chapter, section) named in the query, or null without any."""
    low = F.lower(query)
    found = [group(low, p) for p in (P.TITLE_IN_QUERY, P.CHAPTER_IN_QUERY, P.SECTION_IN_QUERY)]
    return F.when(F.coalesce(*found).isNotNull(), F.struct(found[0].alias("title"), found[1].alias("chapter"), found[2].alias("section")))


def structure_in_path(path: Column) -> Column:
    low = F.lower(path)
    return F.struct(group(low, P.TITLE_IN_PATH).alias("title"), group(low, P.CHAPTER_IN_PATH).alias("chapter"), group(low, P.SECTION_IN_PATH).alias("section"))


def matches_field(target: Column, candidate: Column) -> Column:
    """No target matches all; no candidate matches none; else the candidate contains the target, both normalized."""
    t, c = normalized(target), normalized(candidate)
    return (t == "") | ((c != "") & F.contains(c, t))


def section_label(meta: Column, with_section: bool = False) -> Column:
    """The first of a chunk's sectionLabel, header and sectionId that is there, and section where asked for."""
    return F.coalesce(*(F.try_element_at(meta, F.lit(k)) for k in ("sectionLabel", "header", "sectionId", *(["section"] if with_section else []))))


def citation(number: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("[source "), number.cast("string"), F.lit(", lines "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("]"))


def display_label(label: Column, path: Column, number: Column) -> Column:
    return F.coalesce(F.nullif(label, F.lit("")), F.nullif(path, F.lit("")), F.concat(F.lit("Source "), number.cast("string")))


def preview(content: Column, length: int = 500) -> Column:
    """The first `length` UTF-16 units; a character of two units that would be cut goes."""
    head = F.substring(content, 1, length)
    zero = F.struct(F.lit(0).alias("units"), F.lit(0).alias("chars"))

    def add(s, c):
        units = s["units"] + F.when(F.octet_length(c) == 4, F.lit(2)).otherwise(F.lit(1))
        return F.struct(units.alias("units"), (s["chars"] + (units <= length).cast("int")).alias("chars"))

    fits = F.aggregate(F.split(head, ""), zero, add)["chars"]
    return F.when(utf16_length(head) <= length, head).otherwise(F.substring(head, F.lit(1), fits))
