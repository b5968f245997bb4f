"""Exact cosine scoring and top-k over stored vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """dot(a, b) over the norms in double precision; 0 for a zero norm; an error for unequal lengths."""
    return cosine_of(a, b, length(a), length(b))


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_of(a: Column, b: Column, length_a: Column, length_b: Column) -> Column:
    """The same with lengths that are known, as where one vector meets many."""
    norm = length_a * length_b
    unequal = F.raise_error(F.concat(F.lit("vector lengths differ: "), F.size(a), F.lit(" and "), F.size(b)))
    return F.when(F.size(a) != F.size(b), unequal.cast("double")).when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def searched(spark: SparkSession, chunks: DataFrame, query: str | None, embed, k: int = 5, order: str = "ord") -> DataFrame:
    """The k best chunks for a text: a blank one and a corpus without chunks have none, without a call of the model."""
    bare = (query or "").strip()
    if not bare or not chunks.limit(1).count():
        return chunks.limit(0)
    return top_k(chunks, embed([bare])[0], k, order=order).drop("score")


def top_k(chunks: DataFrame, query: list[float], k: int, vector: str = "embedding", order: str = "ord", per: str | None = None) -> DataFrame:
    """The k best rows of chunks by cosine with query, ties by `order`; with `per`, the k best of each of its values.

    An empty query vector or k = 0 gives no rows; a negative k is refused. Adds `score`, and `rank` from 1 with `per`.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    scored = chunks.withColumn("score", cosine(F.col(vector), F.array(*(F.lit(float(x)) for x in query)))) if query else chunks.withColumn("score", F.lit(0.0)).limit(0)
    if per is None:
        return scored.orderBy(F.desc("score"), F.asc(order)).limit(k)
    rank = F.row_number().over(Window.partitionBy(per).orderBy(F.desc("score"), F.asc(order)))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
