"""The engine's registered queries and the SQL that gives the same rows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import headers
from folioforge.functions import page_text as X
from folioforge.functions import patterns as P
from folioforge.functions import text as T
from folioforge.operators import amendments, answer, ask, chunking, columns, layout, page_sections, sections, session, vector

from . import derived as D

BUDGET = 2000


def query_vector(rows: DataFrame) -> list[float]:
    found = rows.where("vec_id = 0").select("embedding").first()
    return list(found[0]) if found else []


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "embeddings")
    return vector.top_k(rows, query_vector(rows), 6, order="vec_id").select("vec_id", F.round("score", 6).alias("score"))


def vector_topk_per_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "embeddings")
    return vector.top_k(rows, query_vector(rows), 6, order="vec_id", per="label").select("label", "rank", "vec_id", F.round("score", 6).alias("score"))


def search_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 5 vectors with their documents' previews; content joins after the top is known."""
    rows = D.table(spark, sf_dir, "embeddings")
    best = vector.top_k(rows, query_vector(rows), 5, order="vec_id").select("vec_id")
    docs = D.derived(spark, sf_dir, D.TEXTS)
    return docs.join(F.broadcast(best), docs.doc_id == best.vec_id).select("doc_id", "codebook_id", "source_path", T.preview(F.col("text")).alias("preview"))


def registry_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = spark.sql(D.REGISTRY)
    amends = reg.where("is_amendment").groupBy(F.col("base_id").alias("b")).agg(F.max_by("id", "ord").alias("amendment_id"))
    named = reg.select(F.col("id").alias("rid"), "label", (~F.coalesce("is_amendment", F.lit(False))).alias("is_base"))
    counts = D.derived(spark, sf_dir, D.CORPUS).groupBy("codebook_id").agg(F.count("*").alias("docs"))
    return counts.join(F.broadcast(named), F.col("codebook_id") == F.col("rid"), "left").join(F.broadcast(amends), F.col("codebook_id") == F.col("b"), "left").select("codebook_id", F.coalesce("label", "codebook_id").alias("label"), "is_base", "amendment_id", "docs")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = D.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(T.unix_lines(F.coalesce("text", F.lit(""))), "\n")).alias("n", "line"))
    return lines.select("doc_id", (F.col("n") + 1).alias("line_no"), "line")


def greedy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.greedy_chunks(D.derived(spark, sf_dir, D.TEXTS), BUDGET, keep=("doc_id",))


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.greedy_chunks(D.derived(spark, sf_dir, D.CORPUS), BUDGET, keep=("codebook_id", "source_path"))
    return chunking.chunk_ids(chunks, "codebook_id", "source_path").select("chunk_id", "source_path", "start_line", "end_line", F.length("content").alias("chars"))


def header_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.derived(spark, sf_dir, D.HEADERS).withColumn("m", headers.parse_header(F.col("header")))
    return rows.select("doc_id", headers.header_lines(F.array("header")).alias("header_lines"), *(F.col(f"m.{f}").alias(f) for f in headers.HEADER_FIELDS))


def filename_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.derived(spark, sf_dir, D.FILE_NAMES).withColumn("m", headers.parse_file_name(F.col("file_name")))
    return rows.select("doc_id", "m.title", "m.chapter", "m.section", "m.section_label", "m.public_url", T.section_in_path(F.col("file_name")).alias("path_section"))


def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = D.derived(spark, sf_dir, D.LINES).withColumn("doc", F.floor(F.col("line_no") / F.lit(1000)))
    return sections.split_sections(lines, "doc", "line_no", "line")


def item_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.derived(spark, sf_dir, D.ITEMS).withColumn("doc", F.floor(F.col("doc_id") / F.lit(500)))
    lines = rows.withColumn("line", F.when(F.col("doc_id") % 3 == 0, F.col("item_text")).otherwise(F.concat(F.lit("more "), F.col("doc_id").cast("string"))))
    return sections.split_items(lines, "doc", "doc_id", "line")


def classified_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.derived(spark, sf_dir, D.ITEMS).withColumn("position", F.col("doc_id") + 1)
    return amendments.classified(rows, "item_text", "position", "item_text")


def op_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classified_items(spark, sf_dir)
    return rows.select("doc_id", "item_number", "section_id", "operation", T.action_of_operation(F.col("operation")).alias("action_by_name"), T.action_of_text(F.col("item_text")).alias("action_by_text"))


def item_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified_items(spark, sf_dir).select("doc_id", F.array_join("reasons", ",").alias("reasons"), "suspicious", "file_name")


def extract_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classified_items(spark, sf_dir)
    return amendments.report(rows).select("detected", "written", "skipped", "suspicious_count", F.array_join("suspicious_files", ",").alias("suspicious_files"))


def amendment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with header metadata and a path, as retrieved amendment chunks have them."""
    rows = D.derived(spark, sf_dir, D.ITEMS).join(D.derived(spark, sf_dir, D.HEADERS), "doc_id").join(D.derived(spark, sf_dir, D.FILE_NAMES), "doc_id")
    m = headers.parse_header(F.col("header"))
    return rows.withColumn("m", m).withColumn("info", amendments.amendment_info(F.col("m.target_section_id"), F.col("m.section_id"), F.col("m.amendment_action"), F.col("file_name"), F.col("item_text")))


def amendment_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amendment_rows(spark, sf_dir).select("doc_id", "info.action", "info.target_section_id")


def override(kind: str):
    """The base without what all amendments exclude: with their targets, without amendments, and with some targets unknown."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = D.derived(spark, sf_dir, D.HEADERS).select("doc_id", headers.parse_header(F.col("header"))["section_id"].alias("section_id"))
        rows = amendment_rows(spark, sf_dir)
        unknown = F.struct(F.col("info.action"), F.when(F.col("doc_id") % 20 != 1, F.col("info.target_section_id")).alias("target_section_id"))
        gone = amendments.exclusions({"normal": rows.where("info.target_section_id is not null"), "empty": rows.limit(0), "null": rows.withColumn("info", unknown)}[kind])
        return amendments.override(base, gone)

    return run


def context_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of whole texts, ten documents for each query q."""
    docs = D.derived(spark, sf_dir, D.CORPUS).withColumn("q", F.floor(F.col("doc_id") / F.lit(10))).withColumn("source_id", F.col("doc_id") % 10 + 1)
    src = docs.select("q", "source_id", F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("lang")).alias("section_label"), "source_path", F.lit(1).alias("start_line"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("end_line"), F.col("text").alias("content"))
    return answer.context(src, per=("q",))


def quotes_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers and whole trimmed texts, ten documents for each query q; labels by the chain of metadata."""
    docs = D.derived(spark, sf_dir, D.CORPUS).withColumn("q", F.floor(F.col("doc_id") / F.lit(10))).withColumn("source_id", F.col("doc_id") % 10 + 1)
    meta = F.map_from_entries(F.array(F.struct(F.when(F.col("doc_id") % 4 == 1, F.lit("sectionLabel")).when(F.col("doc_id") % 4 == 2, F.lit("header")).when(F.col("doc_id") % 4 == 3, F.lit("sectionId")).otherwise(F.lit("section")), F.concat(F.lit("of "), F.col("lang")))))
    src = docs.select("q", "source_id", T.section_label(meta).alias("section_label"), "source_path", F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), F.col("text").alias("content"))
    return answer.quotes(src, per=("q",))


def amendment_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of all documents, forty for each query q: distinct by id within it, numbered anew after amendments come before base."""
    docs = D.derived(spark, sf_dir, D.CORPUS).select(F.floor(F.col("doc_id") / F.lit(40)).alias("q"), F.when(F.col("doc_id") % 4 == 0, F.lit(" ")).otherwise(F.concat(F.lit("c-"), (F.col("doc_id") % 7).cast("string"))).alias("id"), F.concat(F.lit("p"), (F.col("doc_id") % 3).cast("string")).alias("source_path"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.col("doc_id").alias("rank"), "codebook_id")
    both = answer.numbered_union(docs.where("codebook_id = 'base-amend'"), docs.where("codebook_id = 'base'"), per=("q",))
    return answer.distinct_refs(both.withColumn("rank", F.col("source_id")).drop("source_id"), per=("q",)).select("q", "id", "source_path", "codebook_id", "source_id")


ANSWERS = """SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN 'I cannot answer that from the provided code sections.' WHEN 1 THEN concat('The rule says "', lang, ' text" [source 1, lines 2-', cast(doc_id AS string), '].')
  WHEN 2 THEN concat('One "abc" [Source 2, lines 1–3]. Two is bare ', source, '.') WHEN 3 THEN concat('A "quoted text" [source 3, lines 4-5]', chr(10), chr(10), 'B "more text here" [source 1, lines 1-2]') WHEN 4 THEN concat('"ab" [source 1, lines 1-2] ', lang) ELSE concat('She said "stop. now" [source 1, lines 1-2] ', source) END AS answer FROM documents"""


def answer_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.derived(spark, sf_dir, ANSWERS)
    return rows.select("id", answer.answer_is_valid(F.col("answer")).alias("valid"), T.has_quote_and_citation(F.col("answer")).alias("whole"))


def quote_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selector replies over two sources each, the whole text first: verbatim, changed, out of range, not JSON, refused, without a title."""
    docs = D.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    chunks = docs.select(F.col("doc_id").alias("id"), F.lit(1).alias("source_id"), "content").union(docs.select("doc_id", F.lit(2), F.lit("second  source text")))
    excerpt = F.when(F.col("doc_id") % 6 == 1, F.lit("never in there")).otherwise(F.regexp_replace(F.expr("right(coalesce(content, ''), 30)"), " ", "  "))
    number = F.when(F.col("doc_id") % 6 == 2, F.lit(3)).otherwise(1)
    reply = F.to_json(F.struct(F.array(F.struct(F.when(F.col("doc_id") % 6 == 5, F.lit(None).cast("string")).otherwise(F.lit("T")).alias("title"), F.array(F.struct(number.alias("sourceId"), excerpt.alias("excerpt"))).alias("items"))).alias("sections")))
    raw = docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 6 == 3, F.lit("no json {")).when(F.col("doc_id") % 6 == 4, F.lit('{"cannotAnswer": true}')).otherwise(reply).alias("raw"))
    lines = F.map_from_entries(F.array(F.struct(F.lit(1), F.struct(F.lit(1).alias("start_line"), F.lit(7).alias("end_line")))))
    return answer.checked_selection(raw, chunks).select("id", "reason", answer.organized(F.col("sections"), lines).alias("answer"))


QUESTIONS = "SELECT item_id, CASE item_id % 4 WHEN 0 THEN concat('what about R302.2 ', text) WHEN 1 THEN concat('see 57-12-6 ', text) WHEN 2 THEN concat('Title 10 and Chapter 3-', cast(item_id AS string), ' of section 3-1-1.', cast(item_id AS string)) ELSE text END AS query FROM {source}"


def letter_vectors(texts: list[str]) -> list[list[float]]:
    return [[float(t.count(c)) for c in D.LETTERS] for t in texts]


def letter_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as chunks of two corpora with letter counts as vectors, made by SQL."""
    docs = D.derived(spark, sf_dir, D.CORPUS)
    vector_of = F.array(*(F.length(F.coalesce("text", F.lit(""))) - F.length(F.replace(F.coalesce("text", F.lit("")), F.lit(c), F.lit(""))) for c in D.LETTERS)).cast("array<double>")
    meta = F.map_from_entries(F.array(F.struct(F.lit("sectionId"), F.concat(F.lit("R"), (100 + F.col("doc_id") % 300).cast("string")))))
    return docs.select(F.concat("codebook_id", F.lit("-"), F.col("doc_id").cast("string")).alias("id"), F.col("codebook_id").alias("corpus"), F.col("doc_id").alias("ord"), "source_path", F.lit(1).alias("start_line"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("end_line"), F.coalesce("text", F.lit("")).alias("content"), vector_of.alias("embedding"), meta.alias("meta"))


def search_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as a search request, from its JSON body to its response."""
    bodies = D.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request_id"), F.to_json(F.struct(F.col("text").alias("query"), F.when(F.col("item_id") % 2 == 0, F.lit("base")).otherwise(F.lit("base-amend")).alias("codebookId"), F.when(F.col("item_id") % 3 == 0, F.lit(0)).otherwise(F.lit(3)).alias("topK"))).alias("body"))
    found = ask.search(bodies, letter_chunks(spark, sf_dir), letter_vectors)
    ids = F.array_join(F.transform(F.from_json("response", "results array<struct<id:string>>")["results"], lambda r: r["id"]), ",")
    return found.select("request_id", "status", ids.alias("ids"))


def first_words(prompts: list[str]) -> list[str]:
    """A selector for tests: the first 20 characters of the first source."""
    heads = [p.split("[source 1, lines ", 1) for p in prompts]
    bodies = [h[1].split("\n", 1)[1] if len(h) > 1 else "" for h in heads]
    return [json.dumps({"sections": [{"title": "Found", "items": [{"sourceId": 1, "excerpt": b[:20]}]}]}) if b[:20].strip() else '{"cannotAnswer": true}' for b in bodies]


def quoting(prompts: list[str]) -> list[str]:
    """An answer model for tests: quotes the first excerpt behind its citation; fails for prompts of even length."""
    if any(len(p) % 2 == 0 for p in prompts):
        raise RuntimeError("no answer")
    found = [re.search(r"(\[source \d+, lines \d+-\d+\])\n([^\n\"]+)", p) for p in prompts]
    return [f'It says "{m[2]}" {m[1]}.' if m else "" for m in found]


def ask_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as a question, through retrieval, amendments, selection and the checked answer."""
    bodies = D.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request_id"), F.to_json(F.struct(F.col("text").alias("query"), F.lit("base").alias("codebookId"))).alias("body"))
    registry = spark.sql(D.REGISTRY)
    return ask.ask(bodies, letter_chunks(spark, sf_dir), registry, letter_vectors, first_words, quoting).select("request_id", "status", "response")


def code_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(QUESTIONS, source=D.table(spark, sf_dir, "benchmark"))
    return rows.select("item_id", T.looks_like_code(F.col("query")).alias("code_like"), T.wants_comparison(F.col("query")).alias("comparison"))


def session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.with_history(D.table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_rows(spark, sf_dir).select("conv_id", "turn", F.col("n_history").cast("long").alias("n_history"), "last_query")


def effective_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.effective_query(session_rows(spark, sf_dir), "text").where("role = 'user'").select("conv_id", "turn", "effective_query")


def structure_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(QUESTIONS, source=D.table(spark, sf_dir, "benchmark")).withColumn("s", T.structure_in_query(F.col("query")))
    return rows.select("item_id", "s.title", "s.chapter", "s.section")


def structure_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.derived(spark, sf_dir, D.FILE_NAMES).withColumn("meta", headers.parse_file_name(F.col("file_name")))
    return amendments.by_structure(rows, "54", "54B-", None, path="file_name").select("doc_id", "file_name")


def page_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.char_metrics(D.derived(spark, sf_dir, D.TOKENS)).select("page", F.round("char_width", 6).alias("char_width"), F.round("gap", 6).alias("gap"), F.round("size_median", 6).alias("size_median"))


def page_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.percentiles(D.derived(spark, sf_dir, D.TOKENS), "x0", [0.05, 0.5, 0.95]).select("page", *(F.round(c, 6).alias(c) for c in ("p5", "p50", "p95")))


def line_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.words_to_lines(D.derived(spark, sf_dir, D.TOKENS)).select("page", "line_no", "text", "x0", "x1", "top", "bottom", "size_median", "n_words")


def page_rulings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame and two inner lines around the tokens of each page, in overlapping pieces."""
    pages = D.derived(spark, sf_dir, D.TOKENS).groupBy("page").agg(F.max("x1").alias("w"), F.max("bottom").alias("h"))
    zero = F.lit(0.0)
    piece = lambda x0, x1, top, bottom: F.struct(x0.cast("double").alias("x0"), x1.cast("double").alias("x1"), top.cast("double").alias("top"), bottom.cast("double").alias("bottom"))
    across = [piece(a, b, y, y) for y in (zero, F.lit(140.2), F.col("h")) for a, b in ((zero, F.lit(200.0)), (F.lit(199.0), F.col("w")))]
    down = [piece(x, x, zero, F.col("h")) for x in (zero, F.lit(299.9), F.col("w"))]
    return pages.select("page", F.explode(F.array(*across, *down)).alias("s")).select("page", "s.*")


def page_sizes(words: DataFrame) -> DataFrame:
    return words.groupBy("page").agg(F.max("x1").alias("width"), (F.max("bottom") + 40).alias("height"), F.median("size").alias("body_size"))


def page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = D.derived(spark, sf_dir, D.TOKENS).withColumn("x0", F.col("x0") + F.when(F.col("x0") >= 300, 40.0).otherwise(0.0)).withColumn("x1", F.col("x0") + 5.0 * F.length("text"))
    tables = words.where("false").select("page", "x0", "x1", "top", "bottom")
    return columns.ordered_lines(words, tables, page_sizes(words))


def turned_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = D.derived(spark, sf_dir, D.TOKENS)
    chars = words.select("page", "x0", "x1", "top", "bottom", F.when(F.col("page") % 2 == 0, 0).otherwise(270).alias("rotation"))
    return columns.tables_by_rotation(page_rulings(spark, sf_dir), chars, page_sizes(words))


def page_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lines of pages are by their text alone; null lines are nothing."""
    line = F.col("line")
    following = F.lit("R302 Next . . . . 12")
    found = {
        "dotted": X.dotted(line), "prose": X.has_prose_mark(line), "numbered": X.ends_in_page_number(line), "toc": X.is_toc_reference(line), "toc_on": X.is_toc_continuation(line, following), "toc_head": X.is_toc_header(line),
        "appendix": X.is_appendix_reference(line), "appendix_toc": X.is_appendix_toc(line), "repeated": X.is_repeated_keyword(line), "amends": X.names_amendment(line), "goes_on": X.has_continued_mark(line, F.lit("r301.2(1)")),
    }
    rows = D.derived(spark, sf_dir, D.PAGE_LINES)
    return rows.select("doc_id", *(F.coalesce(c, F.lit(False)).alias(n) for n, c in found.items()), X.true_heading(line).alias("heading"), X.section_marker(line).alias("marker"), X.chapter(line).alias("chapter"), X.depth(X.true_heading(line)).alias("depth"), X.table_label(line)["id"].alias("table_id"), X.clean_cell(line).alias("cell"))


def rulings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.ruling_lines(page_rulings(spark, sf_dir)).withColumnRenamed("at", "place")


def table_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = layout.ruling_lines(page_rulings(spark, sf_dir))
    cells = layout.table_cells(layout.ruled_tables(lines), lines, D.derived(spark, sf_dir, D.TOKENS))
    return layout.table_stats(cells).select("page", "table_no", "n_rows", "n_cols", F.round("empty_ratio", 6).alias("empty_ratio"), "ok")


def label_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = layout.ruled_tables(layout.ruling_lines(page_rulings(spark, sf_dir))).withColumn("top", F.col("top") + 100)
    words = D.derived(spark, sf_dir, D.TOKENS).withColumn("text", F.when(F.col("token_id") % 40 == 1, F.concat(F.lit("TABLE R30"), (F.col("token_id") % 7).cast("string"), F.lit(" Sizes"))).otherwise(F.col("text")))
    labels = words.where("token_id % 40 = 1").select("page", "text", "x0", "x1", "top", "bottom")
    return layout.table_labels(tables, labels).select("page", "table_no", "label", X.table_label(F.col("label"))["id"].alias("table_id"))


def book_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered headings, deeper ones and markers, over pages of forty lines, as documents of a thousand lines."""
    docs = D.table(spark, sf_dir, "documents").select("doc_id", "lang")
    n = F.col("doc_id") % 1000
    text = (
        F.when(n % 50 == 0, F.concat(F.lit("CHAPTER "), F.floor(n / 50).cast("string")))
        .when(n % 10 == 1, F.concat(F.lit("R"), (100 + F.floor(n / 10)).cast("string"), F.lit(" General")))
        .when(n % 10 == 4, F.concat(F.lit("R"), (100 + F.floor(n / 10)).cast("string"), F.lit(".1 Scope")))
        .when(n % 10 == 7, F.concat(F.lit("SECTION R"), (100 + F.floor(n / 10)).cast("string")))
        .otherwise(F.concat(F.lit("body "), F.coalesce("lang", F.lit(""))))
    )
    return docs.select(F.floor(F.col("doc_id") / 1000).cast("string").alias("doc"), F.floor(n / 40).cast("int").alias("page"), n.cast("int").alias("line_no"), text.alias("text"))


def section_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_sections.section_stack(book_lines(spark, sf_dir))


def table_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table on each page, a document of a hundred pages; two of three tables are one that goes on.

    In every second to fourth of five documents a rule is broken (another rotation, open at the end, other columns), in
    every fifth the first table simply ends.
    """
    docs = D.table(spark, sf_dir, "documents")
    n, kind = F.col("doc_id") % 100, F.floor(F.col("doc_id") / 100) % 5
    rows = docs.select(
        F.floor(F.col("doc_id") / 100).cast("string").alias("doc"), n.cast("int").alias("page"), F.lit(0).alias("idx"),
        F.when((kind == 4) & (n == 1), F.lit("T0c")).otherwise(F.concat(F.lit("T"), F.floor(n / 3).cast("string"), F.when(n % 3 == 2, F.lit("b")).otherwise(F.lit("")))).alias("table_id"),
        F.array(F.lit("a"), F.when((kind == 3) & (n == 1), F.lit("c")).otherwise(F.lit("b"))).alias("columns"), F.array(F.array(F.col("doc_id").cast("string"), F.col("lang"))).alias("rows"), ((n % 3 == 0) & ((n < 99) | (kind == 2))).alias("touches_bottom"),
        F.when((kind == 1) & (n == 1), 90).otherwise(0).alias("rotation"), (n % 2 == 0).alias("continued"),
    )
    done = page_sections.continue_tables(rows)
    return done.select("doc", "table_id", "start_page", "end_page", F.coalesce(F.size("rows"), F.lit(-1)).alias("n_rows"), "error")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        vector_topk, vector_topk_per_corpus, search_preview, registry_labels, doc_lines, greedy_chunks, chunk_ids, header_parse, filename_meta, section_split, item_split, op_classify, item_validate, extract_report, amendment_info,
        context_build, amendment_refs, answer_check, quote_check, code_like, session_window, effective_query, structure_extract, structure_match, page_median, page_percentile, line_build, rulings, table_grid, label_bind, section_stack, table_continuation, page_columns, turned_tables,
        quotes_raw, search_flow, ask_flow, page_predicates,
    )
    return {q.__name__: q for q in own} | {f"amendment_override_{k}": override(k) for k in ("normal", "empty", "null")}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
