"""From retrieved chunks to context, checked excerpts and checked answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import patterns as P
from folioforge.functions import text as T

SELECTION = "sections array<struct<title:string,items:array<struct<sourceId:double,excerpt:string>>>>, cannotAnswer boolean"
MAX_SECTIONS, MAX_ITEMS, MAX_EXCERPT = 4, 6, 1400


def numbered_union(amendments: DataFrame, base: DataFrame, order: str = "rank", per: tuple[str, ...] = ()) -> DataFrame:
    """Amendments before base, each in order, with source_id from 1 for each query (`per`); without it both hold one query's top k."""
    both = amendments.withColumn("__src", F.lit(0)).unionByName(base.withColumn("__src", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("source_id", F.row_number().over(Window.partitionBy(*per).orderBy("__src", order))).drop("__src")


def distinct_refs(refs: DataFrame, chunk_id: str = "id", path: str = "source_path", order: str = "rank", per: tuple[str, ...] = ()) -> DataFrame:
    """The first of each id (of path:start-end where the id is blank), numbered anew from 1, for each query (`per`)."""
    key = F.when(T.is_blank(F.col(chunk_id)), F.concat(F.col(path), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))).otherwise(F.col(chunk_id))
    first = refs.withColumn("__key", key).withColumn("__n", F.row_number().over(Window.partitionBy(*per, "__key").orderBy(order))).where("__n = 1")
    return first.withColumn("source_id", F.row_number().over(Window.partitionBy(*per).orderBy(order))).drop("__key", "__n")


def headed(order: str) -> Column:
    """A source's header: its citation and its label."""
    return F.concat(T.citation(F.col(order), F.col("start_line"), F.col("end_line")), F.lit(" "), T.display_label(F.col("section_label"), F.col("source_path"), F.col(order)))


def joined_blocks(sources: DataFrame, block: Column, between: str, per: tuple[str, ...], order: str, name: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("t"))))
    return sources.groupBy(*per).agg(F.array_join(F.transform(rows, lambda r: r["t"]), between).alias(name), F.count("*").alias("n_sources"))


def context(sources: DataFrame, per: tuple[str, ...] = (), order: str = "source_id") -> DataFrame:
    """The ordered context text: header, content and an empty line for each source."""
    block = F.concat_ws("\n", headed(order), F.coalesce("content", F.lit("")), F.lit(""))
    return joined_blocks(sources, block, "\n", per, order, "context")


def quotes(sources: DataFrame, per: tuple[str, ...] = (), order: str = "source_id") -> DataFrame:
    """The sources' headers and trimmed contents with rules between them."""
    block = F.concat_ws("\n", headed(order), T.trim(F.coalesce("content", F.lit(""))))
    return joined_blocks(sources, block, "\n\n---\n\n", per, order, "quotes")


def organized(selection: Column, lines: Column) -> Column:
    """Checked sections as text: each title, then each excerpt behind its citation; a rule between sections, none at the end.

    lines: source_id -> (start_line, end_line).
    """
    cite = lambda i: T.citation(i["sourceId"].cast("int"), F.try_element_at(lines, i["sourceId"].cast("int"))["start_line"], F.try_element_at(lines, i["sourceId"].cast("int"))["end_line"])
    item = lambda i: F.concat_ws("\n", cite(i), i["excerpt"], F.lit(""))
    parts = F.transform(selection, lambda s: F.concat_ws("\n", s["title"], F.lit(""), F.array_join(F.transform(s["items"], item), "\n")))
    return F.array_join(parts, "\n---\n\n")


def checked_selection(raw: DataFrame, chunks: DataFrame, key: str = "id", text: str = "raw") -> DataFrame:
    """key, reason (null when fine), sections (null when refused) for each selector reply.

    The first failing check, in order of section, item and check, gives the reason. chunks: key, source_id, content.
    """
    parsed = raw.select(F.col(key).alias("k"), F.col(text).alias("t"), F.from_json(F.col(text), SELECTION).alias("j"), F.expr(f"try_parse_json({text})").alias("v"))
    whole = F.when(F.col("v").isNull(), F.lit("not_json")).when(F.col("j.cannotAnswer"), F.lit("cannot_answer")).when(F.col("j.sections").isNull(), F.lit("no_sections"))
    sources = chunks.groupBy(F.col(key).alias("ck")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("source_id").cast("double"), T.one_spaced(F.coalesce("content", F.lit("")))))).alias("by_id"))
    joined = parsed.join(sources, F.col("k") == F.col("ck"), "left").withColumn("by_id", F.coalesce("by_id", F.map_from_entries(F.array().cast("array<struct<a:double,b:string>>"))))
    sections = F.slice("j.sections", 1, MAX_SECTIONS)

    def item_reason(i):
        found = F.try_element_at(F.col("by_id"), i["sourceId"])
        return (
            F.when(i["sourceId"].isNull(), F.lit("bad_source"))
            .when(T.is_blank(i["excerpt"]), F.lit("empty_excerpt"))
            .when((i["sourceId"] < 1) | (i["sourceId"] > F.size("by_id")), F.lit("source_out_of_range"))
            .when(found.isNull(), F.lit("source_not_whole"))
            .when(~F.contains(found, T.one_spaced(i["excerpt"])), F.lit("excerpt_not_verbatim"))
            .when(T.utf16_length(T.trim(i["excerpt"])) > MAX_EXCERPT, F.lit("excerpt_too_long"))
        )

    def section_reasons(s):
        own = F.when(T.is_blank(s["title"]), F.lit("no_title")).when(s["items"].isNull(), F.lit("no_items"))
        return F.concat(F.array(own), F.transform(F.slice(F.coalesce(s["items"], F.array().cast("array<struct<sourceId:double,excerpt:string>>")), 1, MAX_ITEMS), item_reason))

    first = F.get(F.array_compact(F.flatten(F.transform(sections, section_reasons))), 0)
    kept = F.filter(F.transform(sections, lambda s: F.struct(T.trim(s["title"]).alias("title"), F.transform(F.slice(s["items"], 1, MAX_ITEMS), lambda i: F.struct(i["sourceId"].alias("sourceId"), T.trim(i["excerpt"]).alias("excerpt"))).alias("items"))), lambda s: F.size(s["items"]) > 0)
    reason = F.coalesce(whole, first, F.when(F.size(kept) < 1, F.lit("nothing_left")))
    return joined.select(F.col("k").alias(key), reason.alias("reason"), F.when(reason.isNull(), kept).alias("sections"))


def answer_is_valid(answer: Column) -> Column:
    """The refusal sentence, or parts (sentences and lines) that all have a quotation and a citation, and at least one."""
    bare = T.trim(answer)
    parts = F.filter(F.transform(F.split(bare, r"(?<=[.!?])\s+|\n+"), T.trim), lambda p: p != "")
    return (bare == P.REFUSAL) | ((F.size(parts) > 0) & F.forall(parts, T.has_quote_and_citation))
