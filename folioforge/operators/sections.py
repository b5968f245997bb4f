"""Ordered lines to numbered sections and amendment items, within each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import patterns as P
from folioforge.functions import text as T


def ordered(rows: str, order: str):
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(rows)))), lambda r: r[rows])


def split_items(lines: DataFrame, doc: str, order: str, line: str) -> DataFrame:
    """doc, position (from 1), start_line, start_text, text: from a line that starts an item up to the next; what precedes goes.

    Lines are trimmed on the right, blank lines at an item's end dropped.
    """
    w = Window.partitionBy(doc).orderBy(order)
    tidy = lines.withColumn("__line", F.regexp_replace(F.col(line), r"\s+\z", ""))
    marked = tidy.withColumn("position", F.sum(T.is_item_start(F.col("__line")).cast("int")).over(w)).where("position > 0")
    grouped = marked.groupBy(doc, "position").agg(F.min(order).alias("start_line"), F.min_by("__line", order).alias("start_text"), F.array_join(ordered("__line", order), "\n").alias("text"))
    return grouped.withColumn("text", F.regexp_replace("text", r"\n+\z", ""))


def split_sections(lines: DataFrame, doc: str, order: str, line: str, chapter: str = P.CHAPTER_LINE, section: str = P.SECTION_LINE) -> DataFrame:
    """doc, section_no, section_id, section_title, chapter, start_line, body.

    Chapter lines set the running chapter and aren't emitted; lines before the first section go. A section's chapter is
    the running one when the next section starts, so one that a chapter line follows already has that chapter.
    """
    w = Window.partitionBy(doc).orderBy(order)
    bare = T.trim(F.col(line))
    facts = lines.withColumn("__ch", T.group(bare, chapter)).withColumn("__id", F.when(F.col("__ch").isNull(), T.group(bare, section)))
    facts = facts.withColumn("__title", F.when(F.col("__id").isNotNull(), T.section_title(T.group(bare, section, 2))))
    run = facts.withColumn("section_no", F.sum(F.col("__id").isNotNull().cast("int")).over(w)).withColumn("__now", F.last("__ch", ignorenulls=True).over(w)).where("section_no > 0")
    body = F.filter(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.when(F.col("__ch").isNull() & F.col("__id").isNull(), F.col(line)).alias("t")))), lambda r: r["t"].isNotNull())
    return run.groupBy(doc, "section_no").agg(
        F.min_by("__id", order).alias("section_id"),
        F.min_by("__title", order).alias("section_title"),
        F.max_by("__now", order).alias("chapter"),
        F.min(order).alias("start_line"),
        F.array_join(F.transform(body, lambda r: r["t"]), "\n").alias("body"),
    )


def section_headers(sections: DataFrame, code_system: str) -> DataFrame:
    """Adds the header line that section files start with; absent chapters and titles are marked."""
    chapter = F.concat(F.lit("Chapter "), F.coalesce("chapter", F.lit("?")))
    return sections.withColumn("header", F.concat_ws(" | ", F.lit(f"SECTION: {code_system}"), chapter, F.concat(F.lit("Section "), F.col("section_id")), F.coalesce("section_title", F.lit("(no title)"))))


def section_files(sections: DataFrame, corpus: str) -> DataFrame:
    """file_name and the row that a writer leaves there: of equal names the last section stays. written counts all sections."""
    name = F.concat(F.lit(f"{corpus}-"), F.col("section_id"), F.lit("_"), T.slug(F.coalesce("section_title", F.lit(""))), F.lit(".txt"))
    return sections.withColumn("file_name", name).groupBy("file_name").agg(F.max_by(F.struct("section_id", "header", "body"), "section_no").alias("last"), F.count("*").alias("written"))
