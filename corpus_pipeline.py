"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of documents. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import decontamination, language_id, line_chunks, near_copies, packing
from folioforge.llm.common import new_path, removed, stored, stored_at


#: Texts of so many letters are rejected where their best cosine is below this, which is chance for other languages.
LETTERS, LEAST_SCORE = 50, 0.1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages stay; those without letters or text go, and long ones unlike all of these.

    Short texts can't be told and stay; where nothing is labelled, so that no language is known, all with letters stay.
    """
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    long = F.length(F.regexp_replace("text", r"\P{L}+", "")) >= LETTERS
    if not model.langs:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = language_id.predicted(docs, model, keep=tuple(docs.columns))
    return found.where((F.col("lang_pred") != "und") & ((F.col("score") >= LEAST_SCORE) | ~long)).select(*docs.columns)


def remove_repeated_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that an earlier place has go from the text, whatever is next to them, and n_chars follows.

    A document that loses all its lines stays with an empty text; of those the next stage keeps one, as they are equal.
    """
    clean = line_chunks.dedup_runs(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by Jaccard similarity 0.8 or more of five-word shingles one document stays, the smallest by (doc_id, text's hash).

    SimHash fingerprints with pivot tables propose the pairs, and the sets of shingles verify them (near_copies). Rows are
    told apart by doc_id and text, so different texts of one doc_id, or of none, are documents of their own. Rows
    that repeat both are one document, of which the row with the smallest other columns stays.
    """
    keyed = docs.withColumn("__key", F.struct("doc_id", F.xxhash64("text").alias("h")))
    groups = near_copies.near_copies(keyed, words=5, percent=80, key="__key")
    first = stored(groups.where(F.col("key") == F.col("component")).groupBy("key").agg(F.count("*").alias("n")), "representatives")
    kept = keyed.join(first.select(F.col("key").alias("__first"), "n"), F.col("__key") == F.col("__first"))
    alone = kept.where("n = 1").select(*docs.columns)
    if not first.where("n > 1").limit(1).count():
        return alone
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    again = kept.where("n > 1").groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("o")).select("doc_id", "text", "o.*")
    return alone.unionByName(again.select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window in them go."""
    hit = decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit > 0")
    gone = hit.select(F.col("doc_id").alias("__d"), F.col("h").alias("__h"))
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__h"))
    return docs.join(gone, same, "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of 1024 tokens that hold the sources in their proportions."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), seq_len=1024, end_id=0)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_chunks),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Language ID, fingerprints and tokens have no SQL; the stages are tested against brute-force versions in tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        last, path = path, new_path(spark, f"stage-{name}")
        docs = stored_at(stage(spark, docs, sf_dir), path)
        if last:
            removed(spark, last)
    return STAGES[-1][1](spark, docs, sf_dir)
