"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language_id, licenses, line_chunks, packing, prefix_counts, progressive_jpeg, secret_forest, simhash, token_store
from .common import new_path, stored


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), words=4, k=4)
    return found.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = prefix_counts.prefix_table(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), budget=512)
    return table.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), "fits_chars")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_store.write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_store.crc32_of_ids(token_store.read_tokens(spark, path)).withColumnRenamed("key", "doc_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), seq_len=1024, end_id=0)


def op5_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(progressive_jpeg.media_column(documents(spark, sf_dir)), "media")
    return progressive_jpeg.tensor_column(media).select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.col("height").cast("string"), F.lit("x"), F.col("width").cast("string"), F.lit("x3:"), F.md5("rgb")).alias("feature"),
    )


def op6_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_forest.secret_scan(documents(spark, sf_dir))
    spans = F.array_join(F.transform("findings", lambda f: F.concat(f["start"].cast("string"), F.lit("-"), f["stop"].cast("string"))), ",")
    return found.select("doc_id", "n_candidates", F.size("findings").cast("long").alias("n_findings"), spans.alias("spans"), F.round(F.array_max(F.transform("findings", lambda f: f["score"])), 6).alias("top_score"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
s AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS g FROM s),
p AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM v) WHERE len(w) >= n),
h AS (SELECT p.doc_id, p.i, p.n, v.item_id FROM (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM p) p JOIN v ON p.g = v.g AND p.n = v.n),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)"""


def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_chunks.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return clean.select("doc_id", "n_lines", "n_removed", "removed_lines", F.octet_length("text").alias("kept_bytes"), F.md5("text").alias("kept_md5"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.predicted(docs, model).select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def queries() -> dict:
    own = (op1_simhash, op2_prefix_counts, op3_token_store, op4_packing, op5_progressive_jpeg, op6_secret_forest, op7_decontamination, op8_line_chunks, op9_licenses, op10_language_id)
    return {q.__name__: q for q in own}


def oracle_sql() -> dict[str, str]:
    """For those that SQL can express; the others are tested against brute force, round trips or held-out rows."""
    return {"op7_decontamination": OP7_SQL, "op8_line_chunks": line_chunks.chunks_sql(2, 50)}
