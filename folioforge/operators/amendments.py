"""Amendment items, what they do to which section, and the override of base text by amendments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import text as T


def classified(items: DataFrame, text: str = "text", position: str = "position", start: str = "start_text") -> DataFrame:
    """Adds item_number, number_from_source, section_id, operation, length, reasons, suspicious, file_name."""
    clean = T.clean_item(F.col(text))
    out = items.withColumn("number_from_source", T.source_number(F.col(start))).withColumn("item_number", F.coalesce("number_from_source", F.col(position)))
    out = out.withColumn("section_id", T.section_in_text(clean)).withColumn("operation", T.operation_of_text(clean)).withColumn("length", T.utf16_length(clean))
    out = out.withColumn("reasons", T.item_reasons(clean, F.col("section_id"), F.col("operation"))).withColumn("suspicious", F.size("reasons") > 0)
    return out.withColumn("file_name", T.item_file_name(F.col("item_number"), F.col("section_id"), F.col("operation")))


def limited(items: DataFrame, section: str | None = None, limit: int | None = None, position: str = "position") -> DataFrame:
    """The items of one section where one is asked for, and of those the first `limit` by position."""
    asked = items if section is None else items.where(F.col("section_id") == T.section_id(F.lit(section)))
    return asked if limit is None else asked.orderBy(position).limit(limit)


def report(items: DataFrame, skip: Column | None = None) -> DataFrame:
    """One row: detected, written, skipped, suspicious_count and the suspicious items' file names in order."""
    skipped = F.coalesce(skip, F.lit(False)) if skip is not None else F.lit(False)
    bad = F.when(F.col("suspicious") & ~skipped, F.col("file_name"))
    return items.agg(F.count("*").alias("detected"), F.count_if(~skipped).alias("written"), F.count_if(skipped).alias("skipped"), F.count_if(F.col("suspicious") & ~skipped).alias("suspicious_count"), F.array_sort(F.collect_list(bad)).alias("suspicious_files"))


def gate(summary: DataFrame, min_items: int = 20, allow_suspicious: bool = False) -> None:
    """Raises, after all output is written, for too few items or for suspicious ones that aren't allowed."""
    row = summary.select("detected", "suspicious_count").first()
    if row.detected < min_items:
        raise ValueError(f"{row.detected} items, fewer than {min_items}")
    if row.suspicious_count and not allow_suspicious:
        raise ValueError(f"{row.suspicious_count} suspicious items")


def amendment_info(target: Column, section: Column, operation: Column, path: Column, content: Column) -> Column:
    """(action, target_section_id): the target from metadata, else the path, else the text; '' falls through."""
    meta = F.nullif(T.section_id(F.nullif(F.coalesce(target, section), F.lit(""))), F.lit(""))
    found = F.coalesce(meta, F.nullif(T.section_in_path(path), F.lit("")), F.nullif(T.section_in_text(content), F.lit("")))
    named = F.when(~T.is_blank(operation), T.action_of_operation(operation)).otherwise(F.lit("unknown"))
    return F.struct(F.when(named == "unknown", T.action_of_text(content)).otherwise(named).alias("action"), found.alias("target_section_id"))


def exclusions(amendments: DataFrame, info: str = "info") -> DataFrame:
    """The targets of deleting and replacing amendments; a null row means that nothing of the base may be served."""
    return amendments.where(F.col(f"{info}.action").isin("delete", "replace")).select(F.col(f"{info}.target_section_id").alias("target")).distinct()


def override(base: DataFrame, excluded: DataFrame, section: str = "section_id") -> DataFrame:
    """base without excluded sections by the rules of NOT IN: with any exclusion rows without an id go, with a null one all go.

    A null-aware anti join; Spark broadcasts the excluded ids, which are those of one query's retrieved amendments.
    """
    spark = base.sparkSession
    return spark.sql("SELECT * FROM {base} WHERE __norm NOT IN (SELECT target FROM {gone})", base=base.withColumn("__norm", T.section_id(F.col(section))), gone=excluded).drop("__norm")


def by_structure(chunks: DataFrame, title: str | None, chapter: str | None, section: str | None, meta: str = "meta", path: str = "source_path") -> DataFrame:
    """Chunks whose metadata or path has each of the fields asked for; none asked for gives none."""
    if not (title or chapter or section):
        return chunks.limit(0)
    own = T.structure_in_path(F.col(path))
    keep = F.lit(True)
    for name, asked in (("title", title), ("chapter", chapter), ("section", section)):
        keep = keep & (T.matches_field(F.lit(asked), F.col(f"{meta}.{name}")) | T.matches_field(F.lit(asked), own[name]))
    return chunks.where(keep)
