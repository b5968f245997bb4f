"""From request bodies to responses: search, and questions answered by quoted and checked excerpts.

Models are injected: embed(list of texts) -> list of vectors, and select, reply: list of prompts -> list of texts. They are
called in batches on the executors; a chat model that fails on a batch is asked for each prompt of it, and a prompt that
still fails has no answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import patterns as P
from folioforge.functions import text as T
from folioforge.operators import amendments, answer, session, vector
from folioforge.operators.columns import settled

BODY = "query string, codebookId string, topK int, includeAmendments boolean, responseMode string, sessionId string"
Embed = Callable[[list[str]], list[list[float]]]
Chat = Callable[[list[str]], list[str | None]]
#: Most rows of queries with their vectors that are broadcast to the chunks.
QUERY_ROWS = 10_000

SELECT_TASK = "Pick the passages of the sources below that bear on the question, word for word. Reply with JSON alone: {\"sections\": [{\"title\": \"...\", \"items\": [{\"sourceId\": 1, \"excerpt\": \"...\"}]}]}, or {\"cannotAnswer\": true} if there is none."
ANSWER_TASK = f"Answer in sentences, each with a quotation in double quotes from the excerpts below and its citation [source N, lines A-B]. If that can't be done, reply: {P.REFUSAL}"


def embedded(df: DataFrame, text: str, embed: Embed, out: str = "embedding") -> DataFrame:
    """df with the vector of its text column; a vector that is missing or empty is an error."""

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            made = embed(texts.fillna("").tolist())
            if len(made) != len(texts) or any(v is None or not len(v) for v in made):
                raise ValueError("the embedding model left out a text")
            yield pd.Series([[float(x) for x in v] for v in made], index=texts.index)

    return df.withColumn(out, vectors(F.col(text)))


def replied(df: DataFrame, prompt: str, chat: Chat, out: str) -> DataFrame:
    """df with the model's reply to its prompt; null without a prompt and where the model fails."""

    def one(text: str) -> str | None:
        try:
            return chat([text])[0]
        except Exception:  # noqa: BLE001  whatever a model raises means no reply
            return None

    @F.pandas_udf("string")
    def replies(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            asked = prompts[prompts.notna()]
            try:
                found = chat(asked.tolist()) if len(asked) else []
                if len(found) != len(asked):
                    raise ValueError("the model left out a prompt")
            except Exception:  # noqa: BLE001
                found = [one(p) for p in asked]
            yield pd.Series(found, index=asked.index, dtype=object).reindex(prompts.index)

    return df.withColumn(out, replies(F.col(prompt)))


def requests(bodies: DataFrame, default_corpus: str, default_k: int, zero_is_default: bool = False, body: str = "body") -> DataFrame:
    """bodies with fault (null for a usable request), query, corpus, k, with_amendments, session, response_mode.

    A blank corpus has its default, as have an absent k and, where asked for, one of zero; a blank session is none. Bodies
    that aren't JSON objects, blank queries and negative k are faults.
    """
    parsed = bodies.withColumn("__v", F.expr(f"try_parse_json({body})")).withColumn("__b", F.from_json(F.col(body), BODY))
    k = F.col("__b.topK")
    out = parsed.select(
        *bodies.columns,
        F.col("__v").isNotNull().alias("__json"),
        T.trim(F.coalesce("__b.query", F.lit(""))).alias("query"),
        F.coalesce(F.nullif("__b.codebookId", F.lit("")), F.lit(default_corpus)).alias("corpus"),
        F.coalesce(F.nullif(k, F.lit(0)) if zero_is_default else k, F.lit(default_k)).alias("k"),
        F.coalesce("__b.includeAmendments", F.lit(True)).alias("with_amendments"),
        F.nullif(T.trim(F.coalesce("__b.sessionId", F.lit(""))), F.lit("")).alias("session"),
        F.col("__b.responseMode").alias("response_mode"),
    )
    fault = F.when(~F.col("__json"), "Invalid JSON body").when(F.col("query") == "", "Missing or empty 'query' field.").when(F.col("k") < 0, "topK must not be negative")
    return out.withColumn("fault", fault).drop("__json")


def top_of_each(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """The k best chunks of each query's corpus with request_id, score and rank from 1. asked: request_id, corpus, k, vector.

    A query is scored against every chunk of its corpus; ranks are kept to k within each partition before the shuffle.
    """
    few = asked.select("request_id", F.col("corpus").alias("__corpus"), "k", "vector", vector.length(F.col("vector")).alias("__b"))
    if few.limit(QUERY_ROWS + 1).count() <= QUERY_ROWS:
        few = F.broadcast(few)
    known = chunks.withColumn("__a", vector.length(F.col("embedding")))
    scored = known.join(few, F.col("corpus") == F.col("__corpus")).withColumn("score", vector.cosine_of(F.col("embedding"), F.col("vector"), F.col("__a"), F.col("__b")))
    most = asked.agg(F.max("k")).first()[0] or 0
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "ord"))
    best = scored.select("request_id", "k", "id", "ord", "corpus", "score").withColumn("rank", rank).where(F.col("rank") <= most).where(F.col("rank") <= F.col("k")).drop("k")
    # the contents join once the best are known, which are few
    found = settled(best)
    ids = found.select(F.col("id").alias("__id"), F.col("corpus").alias("__corpus"), F.col("ord").alias("__ord"), "request_id", "score", "rank")
    if ids.limit(QUERY_ROWS + 1).count() <= QUERY_ROWS:
        ids = F.broadcast(ids)
    same = (F.col("corpus") == F.col("__corpus")) & (F.col("ord") == F.col("__ord")) & F.col("id").eqNullSafe(F.col("__id"))
    return chunks.join(ids, same).drop("__id", "__corpus", "__ord", "embedding")


def search(bodies: DataFrame, chunks: DataFrame, embed: Embed, default_corpus: str = "base", default_k: int = 5) -> DataFrame:
    """request_id, status, response (JSON) for each body of a search: the k best chunks with previews of their content.

    chunks: id, corpus, ord, source_path, start_line, end_line, content, embedding. A corpus without chunks has no results.
    """
    asked = requests(bodies, default_corpus, default_k, zero_is_default=True)
    vectors = settled(embedded(asked.where("fault is null").select("request_id", "corpus", "k", "query"), "query", embed, "vector"))
    best = top_of_each(chunks, vectors)
    row = F.struct("rank", "id", F.col("source_path").alias("sourcePath"), F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"), T.preview(F.col("content")).alias("contentPreview"))
    found = best.groupBy(F.col("request_id").alias("__id")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    joined = asked.join(found, F.col("request_id") == F.col("__id"), "left")
    bare = F.transform(F.coalesce("rows", F.array().cast(found.schema["rows"].dataType)), lambda r: r.dropFields("rank"))
    fine = F.to_json(F.struct(F.lit(True).alias("ok"), "query", F.col("corpus").alias("codebookId"), F.col("k").alias("topK"), bare.alias("results")))
    wrong = F.to_json(F.struct(F.col("fault").alias("error")))
    return joined.select("request_id", F.when(F.col("fault").isNull(), 200).otherwise(400).alias("status"), F.when(F.col("fault").isNull(), fine).otherwise(wrong).alias("response"))


def overridden(base: DataFrame, amended: DataFrame) -> DataFrame:
    """Base hits of each request without the sections that its own amendment hits delete or replace, by the rules of NOT IN.

    Each request has at most k of either, so its targets are one small row.
    """
    info = amendments.amendment_info(F.try_element_at("meta", F.lit("targetSectionId")), F.try_element_at("meta", F.lit("sectionId")), F.try_element_at("meta", F.lit("amendmentAction")), F.col("source_path"), F.col("content"))
    gone = amended.withColumn("info", info).where(F.col("info.action").isin("delete", "replace"))
    by_request = gone.groupBy(F.col("request_id").alias("__id")).agg(F.bool_or(F.col("info.target_section_id").isNull()).alias("closed"), F.collect_set("info.target_section_id").alias("targets"))
    own = T.section_id(F.try_element_at("meta", F.lit("sectionId")))
    joined = base.join(by_request, F.col("request_id") == F.col("__id"), "left")
    kept = F.col("targets").isNull() | (~F.col("closed") & own.isNotNull() & ~F.array_contains("targets", own))
    return joined.where(F.coalesce(kept, F.lit(False))).drop("__id", "closed", "targets")


def ask(bodies: DataFrame, chunks: DataFrame, registry: DataFrame, embed: Embed, select: Chat, reply: Chat, history: DataFrame | None = None, default_corpus: str = "base", default_k: int = 6) -> DataFrame:
    """request_id, status, response (JSON), and ok, session, query, topic_hint for each body of a question.

    chunks: as in search, with meta (a map). registry: ord, id, label, is_amendment, base_id; the last amendment of a base
    counts. history: session, ord, role, query, hint of what was said before; its last entries anchor a question that names
    no code. Entries to append (remembered) exist for answered questions alone. A model that fails leads to the refusal.
    """
    asked = requests(bodies, default_corpus, default_k)
    bases = registry.where(~F.coalesce("is_amendment", F.lit(False))).select(F.col("id").alias("__base"))
    amends = registry.where("is_amendment").groupBy(F.col("base_id").alias("__of")).agg(F.max_by("id", "ord").alias("amendment"))
    asked = asked.join(F.broadcast(bases), F.col("corpus") == F.col("__base"), "left").join(F.broadcast(amends), F.col("corpus") == F.col("__of"), "left")
    asked = asked.withColumn("fault", F.coalesce("fault", F.when(F.col("__base").isNull(), F.concat(F.lit("Invalid base codebookId: "), F.col("corpus")))))
    asked = session.effective_query(anchored(asked, history), "query")

    vectors = settled(embedded(asked.where("fault is null").select("request_id", "corpus", "amendment", "with_amendments", "k", "effective_query"), "effective_query", embed, "vector"))
    base = top_of_each(chunks, vectors)
    amended = settled(top_of_each(chunks, vectors.where("with_amendments and amendment is not null").withColumn("corpus", F.col("amendment"))))
    sources = settled(answer.numbered_union(amended, overridden(base, amended), per=("request_id",)).withColumn("section_label", T.section_label(F.col("meta"))))
    refs = answer.distinct_refs(amended.withColumn("section_label", T.section_label(F.col("meta"), with_section=True)), per=("request_id",))

    listed = by_request(sources, source_fields(), "sources").join(by_request(refs, source_fields(T.citation(F.col("source_id"), F.col("start_line"), F.col("end_line")).alias("citation"), F.col("content").alias("fullText")), "amendments"), "request_id", "full")
    texts = answer.context(sources, per=("request_id",))
    state = asked.join(listed, "request_id", "left").join(texts, "request_id", "left")
    prompt = F.when(F.col("context").isNotNull(), F.concat(F.lit(SELECT_TASK), F.lit("\n\nQuestion:\n"), F.col("query"), F.lit("\n\n"), F.col("context")))
    chosen = settled(replied(state.withColumn("prompt", prompt), "prompt", select, "raw"))
    checked = answer.checked_selection(chosen.where("raw is not null").select("request_id", "raw"), sources.select("request_id", "source_id", "content"), key="request_id")
    lines = F.map_from_entries(F.transform("sources", lambda s: F.struct(s["sourceId"], F.struct(s["startLine"].alias("start_line"), s["endLine"].alias("end_line")))))
    kept = chosen.drop("raw", "prompt", "context").join(checked.select("request_id", "sections"), "request_id", "left").withColumn("organized", F.when(F.col("sections").isNotNull(), answer.organized(F.col("sections"), lines)))
    answered = replied(kept.withColumn("prompt", F.concat(F.lit(ANSWER_TASK), F.lit("\n\nQuestion:\n"), F.col("query"), F.lit("\n\n"), F.col("organized"))), "prompt", reply, "raw")
    final = settled(answered).withColumn("answer", F.coalesce(F.nullif(T.trim(F.col("raw")), F.lit("")), F.col("organized")))
    ok = F.coalesce(answer.answer_is_valid(F.col("answer")), F.lit(False))
    hint = F.coalesce(F.nullif(F.get("sources", 0)["sectionLabel"], F.lit("")), F.get("sources", 0)["sourcePath"])
    done = final.withColumn("ok", ok).withColumn("topic_hint", F.when(ok, hint))
    reason = F.when(~F.col("ok"), F.coalesce("fault", F.lit(P.REFUSAL)))
    empty = lambda c: F.coalesce(c, F.array().cast(done.schema[c].dataType)).alias(c)
    response = F.to_json(F.struct("ok", "query", F.col("corpus").alias("codebookId"), F.when(F.col("ok"), F.col("answer")).alias("answer"), empty("sources"), empty("amendments"), reason.alias("reason")), {"ignoreNullFields": "false"})
    return done.select("request_id", F.when(F.col("fault").isNull(), 200).otherwise(400).alias("status"), response.alias("response"), "ok", "session", "query", "topic_hint")


def source_fields(*more: Column) -> list[Column]:
    renamed = {"source_id": "sourceId", "id": "id", "corpus": "codebookId", "source_path": "sourcePath", "section_label": "sectionLabel", "start_line": "startLine", "end_line": "endLine"}
    return [*(F.col(a).alias(b) for a, b in renamed.items()), F.try_element_at("meta", F.lit("publicUrl")).alias("publicUrl"), *more]


def by_request(rows: DataFrame, fields: list[Column], name: str) -> DataFrame:
    return rows.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def anchored(asked: DataFrame, history: DataFrame | None) -> DataFrame:
    """asked with n_history, last_query and last_hint of its session, over the last entries that memory keeps."""
    none = {"n_history": F.lit(0).cast("long"), "last_query": F.lit(None).cast("string"), "last_hint": F.lit(None).cast("string")}
    if history is None:
        return asked.withColumns(none)
    order = Window.partitionBy("session").orderBy(F.desc("ord"))
    last = history.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= session.KEPT)
    said = lambda role, c: F.max_by(T.trim(F.col(c)), F.when((F.col("role") == role) & ~T.is_blank(F.col(c)), F.col("ord")))
    facts = last.groupBy(F.col("session").alias("__session")).agg(F.count("*").alias("n_history"), said("user", "query").alias("last_query"), said("assistant", "hint").alias("last_hint"))
    return asked.join(facts, F.col("session") == F.col("__session"), "left").drop("__session").fillna(0, ["n_history"])


def remembered(done: DataFrame) -> DataFrame:
    """session, role, query, hint: the two entries that each answered question of a session adds to memory; others add none."""
    rows = F.array(F.struct(F.lit("user").alias("role"), F.col("query"), F.lit(None).cast("string").alias("hint")), F.struct(F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("query"), F.col("topic_hint").alias("hint")))
    return done.where("ok and session is not null").select("request_id", "session", F.explode(rows).alias("e")).select("request_id", "session", "e.*")
