"""Greedy chunks of lines within a character budget, and dense chunk ids over a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import headers
from folioforge.functions import text as T
from folioforge.operators.columns import settled


def greedy_chunks(files: DataFrame, budget: int, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each chunk: kept columns, chunk_no (from 0), start_line, end_line (from 1, counting a header), content.

    A line opens a new chunk when the current one holds lines and would pass the budget, a line feed counted for each
    line; a line over the budget is a chunk by itself. An empty text, or one of a header alone, is one chunk of ''. Lines end
    at LF or CRLF; sizes are UTF-16 units.
    """
    base = files.select(*keep, T.lines_of(F.col(text)).alias("__all")).withColumn("__head", headers.header_lines(F.col("__all")))
    base = base.withColumn("__lines", F.slice("__all", F.col("__head") + 1, F.greatest(F.size("__all") - F.col("__head"), F.lit(0))))
    # the fold keeps where chunks end; a running sum can't, as each cut depends on the one before
    zero = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("cuts"))

    def add(s, line):
        size = T.utf16_length(line) + 1
        full = (s["chars"] > 0) & (s["chars"] + size > budget)
        return F.struct(F.when(full, size).otherwise(s["chars"] + size).alias("chars"), (s["n"] + 1).alias("n"), F.when(full, F.concat(s["cuts"], F.array(s["n"]))).otherwise(s["cuts"]).alias("cuts"))

    cut = base.withColumn("__cuts", F.aggregate("__lines", zero, add)["cuts"])
    ends = cut.withColumn("__ends", F.concat("__cuts", F.array(F.size("__lines")))).withColumn("__starts", F.concat(F.array(F.lit(0)), F.col("__cuts")))
    each = ends.select(*keep, "__head", "__lines", F.posexplode(F.arrays_zip("__starts", "__ends")).alias("chunk_no", "c"))
    return each.select(
        *keep,
        "chunk_no",
        (F.col("c.__starts") + F.col("__head") + 1).alias("start_line"),
        (F.col("c.__ends") + F.col("__head")).alias("end_line"),
        F.array_join(F.slice("__lines", F.col("c.__starts") + 1, F.col("c.__ends") - F.col("c.__starts")), "\n").alias("content"),
    )


def chunk_ids(chunks: DataFrame, corpus: str, file_order: str) -> DataFrame:
    """chunk_id `<corpus>-<i>`, i dense from 0 over the corpus in file and chunk order.

    The chunks are written once and read twice. Counts by file are ordered over ranges of files, and the ranges' sums, one
    for each, over the corpus; so no task sees all files of a corpus.
    """
    chunks = settled(chunks)
    per_file = chunks.groupBy(corpus, file_order).agg(F.count("*").alias("__n"))
    ranged = settled(per_file.repartitionByRange(corpus, file_order).withColumn("__part", F.spark_partition_id()))
    earlier = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = ranged.groupBy(F.col(corpus).alias("__pc"), F.col("__part").alias("__pp")).agg(F.sum("__n").alias("__m"))
    bases = sums.select("__pc", "__pp", earlier("__m", Window.partitionBy("__pc").orderBy("__pp")).alias("__base"))
    within = ranged.withColumn("__in", earlier("__n", Window.partitionBy(corpus, "__part").orderBy(file_order)))
    placed = within.join(bases, (F.col(corpus) == F.col("__pc")) & (F.col("__part") == F.col("__pp")))
    offsets = placed.select(F.col(corpus).alias("__c"), F.col(file_order).alias("__f"), (F.col("__in") + F.col("__base")).alias("__before"))
    joined = chunks.join(offsets, (F.col(corpus) == F.col("__c")) & (F.col(file_order) == F.col("__f")))
    return joined.withColumn("chunk_id", F.concat(F.col(corpus), F.lit("-"), (F.col("__before") + F.col("chunk_no")).cast("string"))).drop("__c", "__f", "__before")
