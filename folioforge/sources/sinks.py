"""Writers of indexes, section and item files, tables and reports."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T


def write_index(chunks: DataFrame, path: str, corpus: str = "codebook_id") -> None:
    """Parquet by corpus, so that a query of one corpus reads that alone."""
    chunks.write.mode("overwrite").partitionBy(corpus).parquet(path)


def export_index(chunks: DataFrame, path: str) -> int:
    """One JSON array of a corpus's chunks in the order of ord, as `path`; returns how many. It is for single corpora: one task writes it."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.to_json(F.struct(*(c for c in chunks.columns if c != "ord"))).alias("j")))), lambda r: r["j"])
    folder, _, name = path.rpartition("/")
    return write_files(chunks.agg(F.lit(name).alias("file_name"), F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]")).alias("content")), folder)


def write_files(files: DataFrame, path: str) -> int:
    """Write each row's content as the file file_name in path, by the executors; returns how many rows were written.

    Each file is written to a name of its own and then moved, so a task that runs again leaves the same files. Of rows with
    equal names the last by ord counts where files has that column; otherwise names must be distinct. path is a folder of a
    file system that pyarrow knows; all machines must share it. Null names or contents are refused.
    """
    if "ord" in files.columns:
        last = Window.partitionBy("file_name").orderBy(F.desc("ord"))
        files = files.withColumn("__n", F.row_number().over(last)).where("__n = 1")

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)
        store.create_dir(root, recursive=True)
        for pdf in batches:
            for name, content in zip(pdf["file_name"], pdf["content"]):
                if name is None or content is None or "/" in name:
                    raise ValueError(f"no file can be written for the name {name!r}")
                part = f"{root}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content.encode("utf-8", "surrogatepass"))
                store.move(part, f"{root}/{name}")
            yield pd.DataFrame({"n": [len(pdf)]})

    return files.select("file_name", "content").mapInPandas(put, "n long").agg(F.sum("n")).first()[0] or 0


def section_file(header: Column, body: Column) -> Column:
    """A section's or an item's file: header, an empty line, the body."""
    return F.concat(header, F.lit("\n\n"), body, F.lit("\n"))


def item_header(system: str, number: Column, section: Column, operation: Column) -> Column:
    """The header line of an amendment item's file; an unknown section and operation are named so."""
    named = lambda c, otherwise: F.coalesce(F.nullif(c, F.lit("")), F.lit(otherwise))
    return F.concat_ws(" | ", F.lit(f"SECTION: {system}"), F.concat(F.lit("Item "), number.cast("string")), F.concat(F.lit("Target "), named(section, "UNKNOWN")), F.concat(F.lit("Op "), named(operation, "unknownop")))


def write_texts(files: DataFrame, path: str, header: str = "header", body: str = "body") -> int:
    """Each row's header, an empty line and body as the file file_name; returns how many files."""
    return write_files(files.select(*(c for c in ("ord", "file_name") if c in files.columns), section_file(F.col(header), F.col(body)).alias("content")), path)


def page_range(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(F.concat(first.cast("string"), F.lit("–"), last.cast("string")))


def page_section_text(pages: str = "pages", section: str = "section_id", heading: str = "heading", body: str = "body") -> Column:
    """Three header lines and, right behind them, the body."""
    return F.concat(F.lit("PDF_PAGE: "), F.col(pages), F.lit("\nSECTION_ID: "), F.col(section), F.lit("\nSECTION: "), F.col(heading), F.lit("\n"), F.col(body))


def write_sections(sections: DataFrame, path: str) -> int:
    """The files <section_id>.txt of sections (section_id, start_page, end_page, body), failed ones left out; returns how many."""
    facts = sections.where("error is null").withColumn("pages", page_range(F.col("start_page"), F.col("end_page"))).withColumn("heading", F.get(F.split("body", "\n"), 0))
    name = F.concat(F.regexp_replace("section_id", r"[^A-Za-z0-9.\-]+", "-"), F.lit(".txt"))
    return write_files(facts.select(name.alias("file_name"), page_section_text().alias("content")), path)


def table_files(tables: DataFrame) -> DataFrame:
    """file_name, content: for each table (table_id, columns, rows) a text, a CSV and a JSON file of its own."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, table_id, columns, rows in zip(pdf["name"], pdf["table_id"], pdf["columns"], pdf["rows"]):
                grid, held = [list(columns), *(list(r) for r in rows)], io.StringIO()
                csv.writer(held, lineterminator="\n").writerows(grid)
                out += [(f"{name}.txt", "\n".join(" | ".join(c or "" for c in r) for r in grid) + "\n"), (f"{name}.csv", held.getvalue()), (f"{name}.json", json.dumps({"table_id": table_id, "columns": grid[0], "rows": grid[1:]}, ensure_ascii=False))]
            yield pd.DataFrame(out, columns=["file_name", "content"])

    named = tables.where("error is null").select(T.slug(F.col("table_id")).alias("name"), "table_id", "columns", "rows")
    return named.mapInPandas(made, "file_name string, content string")


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def reported(run, report, path: str) -> DataFrame:
    """run()'s result, with report(result, None) written to path; when it fails report(None, error) is written before the error goes on."""
    try:
        done = run()
    except Exception as e:
        write_report(report(None, e), path)
        raise
    write_report(report(done, None), path)
    return done
