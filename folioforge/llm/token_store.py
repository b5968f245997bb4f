"""Token ids as Parquet list columns, in ascending order of the key.

A file has one row for each document: key, part, local_start, n_tokens, ids. Row groups and pages are small and indexed,
small integers are dictionary or delta encoded (Parquet's second data page version), so that reading a few keys or the
counts alone touches few pages. Positions over the whole corpus need one number for each part, the sum of its counts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import encoder, sliced

#: Writer settings: bytes of a row group and of a page, rows of a page, dictionary pages, page checksums.
LAYOUT = {"parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "2000", "parquet.dictionary.page.size": str(1 << 20), "parquet.enable.dictionary": "true", "parquet.writer.version": "PARQUET_2_0", "parquet.page.write-checksum.enabled": "true", "compression": "zstd"}


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, key: str = "doc_id", text: str = "text") -> None:
    """Write the ids of every whole text of docs, each followed by end_id, in ascending order of key.

    Null texts count as empty and have the end id alone. Rows with equal keys stand next to each other, ordered by their
    text's hash; null keys come first. Columns besides key and text are ignored. An empty table makes an empty one.
    """
    src = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = src.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").select("key", "text")

    def run(batches):
        encode, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        for some in sliced(batches):
            ids, offsets = encode(some.column("text"), end)
            sizes = np.diff(offsets)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view("<i4")))
            yield pa.RecordBatch.from_arrays([some.column("key"), pa.array(np.full(len(sizes), part, dtype=np.int32)), pa.array(at + offsets[:-1]), pa.array(sizes), lists], names=["key", "part", "local_start", "n_tokens", "ids"])
            at += int(offsets[-1])

    kind = docs.schema[key].dataType.simpleString()
    ordered.mapInArrow(run, f"key {kind}, part int, local_start long, n_tokens long, ids array<int>").write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows with start, the ids of all rows before them in the whole corpus.

    The sums by part are read from the counts alone; there is one for each written part, whatever the corpus holds.
    """
    stored = spark.read.parquet(path)
    sums = sorted((r["part"], r["n"]) for r in stored.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    offsets, at = [], 0
    for part, n in sums:
        offsets.append((part, at))
        at += n
    table = spark.createDataFrame(offsets, "part int, base long")
    return stored.join(F.broadcast(table), "part").withColumn("start", F.col("base") + F.col("local_start")).drop("base", "local_start", "part")


def crc32_of_ids(tokens: DataFrame) -> DataFrame:
    """key, start, n_tokens and the CRC of the ids as little-endian 32-bit integers, from the rows read back."""

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            raw, at = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False))).cast("B"), ids.offsets.to_numpy()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"])

    kind = tokens.schema["key"].dataType.simpleString()
    return tokens.select("key", "start", "n_tokens", "ids").mapInArrow(run, f"key {kind}, start long, n_tokens long, ids_crc32 long")
