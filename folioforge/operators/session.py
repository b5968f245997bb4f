"""Conversation memory in batch: the last entries before each one, and the query they make."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import patterns as P
from folioforge.functions import text as T

KEPT = 30


def with_history(entries: DataFrame, session: str, order: str, role: str, query: str, hint: str | None = None, kept: int = KEPT) -> DataFrame:
    """Adds n_history, last_query, last_hint over the `kept` entries before each; blank values don't count."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(-kept, -1)
    user = F.when((F.col(role) == "user") & ~T.is_blank(F.col(query)), T.trim(F.col(query)))
    assistant = F.when((F.col(role) == "assistant") & ~T.is_blank(F.col(hint)), T.trim(F.col(hint))) if hint else F.lit(None).cast("string")
    return entries.withColumn("n_history", F.count("*").over(w)).withColumn("last_query", F.last(user, ignorenulls=True).over(w)).withColumn("last_hint", F.last(assistant, ignorenulls=True).over(w))


def effective_query(df: DataFrame, query: str) -> DataFrame:
    """A query that names no code gets the last hint, or else the last query, in front."""
    before = F.coalesce("last_hint", "last_query")
    follow = ~T.looks_like_code(F.col(query)) & (F.col("n_history") > 0) & before.isNotNull()
    return df.withColumn("effective_query", F.when(follow, F.concat(before, F.lit(P.FOLLOW_UP), F.col(query))).otherwise(F.col(query)))
