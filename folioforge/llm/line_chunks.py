"""Line dedup by content-defined line chunks.

Lines are hashed, and a rolling hash over the last two line hashes closes a chunk where it is 0 modulo `divisor`; a line
of `long_words` words or more, which is a paragraph of several lines set in one, is a chunk by itself. So boundaries
depend on the lines near them alone, and shifted copies give equal chunks. A chunk counts as a passage if it has at least
two lines or `long_words` words. Of passages with the same bytes anywhere in the corpus, the first (by doc_id, the text's
hash and the place) stays and the others go. Only DataFrame functions are used.

Chunks miss passages whose chunk boundaries or neighbours differ. dedup_runs removes every repeated run instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def n_words(text: Column) -> Column:
    """Runs of characters other than blanks and ASCII white space."""
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def with_ends(df: DataFrame, divisor: int, long_words: int) -> DataFrame:
    """Adds __ends to df with __lines: the numbers, from 0, of the lines that close a chunk, the last line among them.

    Each step is a column of its own, as a lambda evaluates an expression that it refers to anew for each element.
    """
    line = F.struct
    facts = F.transform("__lines", lambda x: line(line_hash(x).alias("h"), ((F.length(x) >= 2 * long_words - 1) & (n_words(x) >= long_words)).alias("long")))
    before, after = (lambda i: F.get("__facts", i - 1)), (lambda i: F.get("__facts", i + 1))
    flags = F.transform(
        "__facts",
        lambda f, i: (i == F.size("__facts") - 1) | f["long"] | F.coalesce(after(i)["long"], F.lit(False)) | (F.pmod(F.coalesce(before(i)["h"], F.lit(0)) * 31 + f["h"], F.lit(divisor)) == 0),
    )
    marked = df.withColumn("__facts", facts).withColumn("__flags", flags)
    numbered = F.when(F.col("__flags").isNotNull(), F.sequence(F.lit(0), F.size("__flags") - 1))
    return marked.withColumn("__ends", F.filter(numbered, lambda i: F.get("__flags", i))).drop("__facts", "__flags")


def chunked(docs: DataFrame, divisor: int, long_words: int) -> DataFrame:
    """doc_id, h, chunk_no, lines (of the chunk) for all rows with a text."""
    base = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("h"), F.split("text", "\n").alias("__lines"))
    start = lambda k: F.coalesce(F.get("__ends", k - 1), F.lit(-1)) + 2
    chunks = F.transform("__ends", lambda e, k: F.slice("__lines", start(k), e - start(k) + 2))
    return with_ends(base, divisor, long_words).select("doc_id", "h", F.posexplode(chunks).alias("chunk_no", "lines"))


def repeated_chunks(docs: DataFrame, divisor: int, long_words: int) -> DataFrame:
    """doc_id, h, chunk_no of every passage that isn't the first of its bytes."""
    passages = chunked(docs, divisor, long_words).where((F.size("lines") >= 2) | (n_words(F.element_at("lines", 1)) >= long_words))
    placed = passages.select(F.struct("doc_id", "h", "chunk_no").alias("place"), F.array_join("lines", "\n").alias("bytes")).withColumn("key", F.xxhash64("bytes"))
    # grouped by the bytes themselves: equal hashes alone remove nothing
    same = placed.groupBy("key", "bytes").agg(F.min("place").alias("first"), F.count("*").alias("n"), F.max("place").alias("last"))
    by_key = stored(same.groupBy("key").agg(F.count("*").alias("texts"), F.max("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")).where("texts > 1 or first != last"), "repeated-chunks")
    clear = by_key.where("texts = 1").select("key", "first")
    others = placed.drop("bytes").join(clear, "key").where("place != first").select("place.*").distinct()
    if not by_key.where("texts > 1").limit(1).count():
        return others
    # different bytes under one hash: these are compared as bytes again
    mixed = placed.join(by_key.where("texts > 1").select("key"), "key", "left_semi")
    firsts = mixed.groupBy("bytes").agg(F.min("place").alias("first"))
    return others.unionByName(mixed.join(firsts, "bytes").where("place != first").select("place.*")).distinct()


def dedup_lines(docs: DataFrame, divisor: int = 2, long_words: int = 50) -> DataFrame:
    """docs with text without its repeated passages, and n_lines, n_chunks, n_removed (chunks), text_before.

    All columns of docs stay. A null text stays null with 0 lines; a text that loses all its lines is empty; an empty text
    has one empty line. Rows that repeat doc_id and text are one document and get equal results. Clashing column names of
    docs are kept, the operator's own come with them only where docs has no such column.
    """
    gone = repeated_chunks(docs, divisor, long_words).groupBy(F.col("doc_id").alias("__d"), F.col("h").alias("__h")).agg(F.collect_set("chunk_no").alias("__gone"))
    joined = docs.withColumn("__t", F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__t") == F.col("__h")) & F.col("text").isNotNull(), "left")
    touched = joined.withColumn("__lines", F.when(F.col("__gone").isNotNull(), F.split("text", "\n")))
    ends = with_ends(touched, divisor, long_words)
    start = lambda k: F.coalesce(F.get("__ends", k - 1), F.lit(-1)) + 2
    kept = F.flatten(F.transform("__ends", lambda e, k: F.when(F.array_contains("__gone", k), F.array().cast("array<string>")).otherwise(F.slice("__lines", start(k), e - start(k) + 2))))
    ends = ends.withColumn("__kept", kept)
    own = {
        "text_before": F.col("text"),
        "n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1),
        "n_removed": F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone")),
        "removed_lines": F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__lines") - F.size("__kept")),
    }
    clean = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join("__kept", "\n"))
    return ends.select(*(clean.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns), *(e.alias(c) for c, e in own.items() if c not in docs.columns))


def windows(docs: DataFrame, long_words: int) -> DataFrame:
    """doc_id, h, i, n, key, bytes: every two lines that follow each other (n = 2), and every line of `long_words` words (n = 1)."""
    base = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("h"), F.split("text", "\n").alias("__lines"))
    after = lambda i: F.get("__lines", i + 1)
    long = lambda x: (F.length(x) >= 2 * long_words - 1) & (n_words(x) >= long_words)
    pairs = F.transform("__lines", lambda x, i: F.when(i < F.size("__lines") - 1, F.concat(x, F.lit("\n"), after(i))))
    longs = F.transform("__lines", lambda x, i: F.when(long(x), x))
    rows = [base.select("doc_id", "h", F.lit(n).alias("n"), F.posexplode(part).alias("i", "bytes")).where("bytes is not null") for n, part in ((2, pairs), (1, longs))]
    return rows[0].unionByName(rows[1]).select("doc_id", "h", "i", "n", F.xxhash64("n", "bytes").alias("key"), "bytes")


def repeated_windows(docs: DataFrame, long_words: int) -> DataFrame:
    """doc_id, h, i, n of every window that isn't the first of its bytes."""
    place = F.struct("doc_id", "h", "i", "n").alias("place")
    every = windows(docs, long_words)
    placed = stored(every.select("key", place), "line-windows")
    again = stored(placed.groupBy("key").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first != last").select("key"), "repeated-windows")
    # equal hashes alone remove nothing: windows of repeated hashes are grouped by their bytes
    same = every.select("key", place, "bytes").join(again, "key", "left_semi").groupBy("key", "bytes").agg(F.min("place").alias("first"))
    by_key = stored(same.groupBy("key").agg(F.count("*").alias("texts"), F.min("first").alias("first")), "window-firsts")
    others = placed.join(by_key.where("texts = 1").select("key", "first"), "key").where("place != first").select("place.*").distinct()
    if not by_key.where("texts > 1").limit(1).count():
        return others
    mixed = every.select("key", place, "bytes").join(by_key.where("texts > 1").select("key"), "key", "left_semi")
    firsts = mixed.groupBy("bytes", "place.n").agg(F.min("place").alias("first"))
    return others.unionByName(mixed.join(firsts, (mixed.bytes == firsts.bytes) & (F.col("place.n") == firsts.n)).where("place != first").select("place.*")).distinct()


def dedup_runs(docs: DataFrame, long_words: int = 50) -> DataFrame:
    """docs with text without its repeated runs of lines, and text_before, n_lines, removed_lines.

    A run is any number of lines of a document that follow each other with the same bytes at an earlier place of the corpus
    (by doc_id, the text's hash and the line); runs of two lines or more go, and single lines of `long_words` words or more.
    A run of two lines or more is covered by its pairs of lines, each of which has the earlier place too, and a repeated pair
    is a run; so the pairs give the lines of all maximal runs exactly, wherever their neighbours differ. The first place of a
    line always stays. Rows, nulls and clashing names are treated as in dedup_lines.
    """
    lines = F.explode(F.when(F.col("n") == 2, F.array(F.col("i"), F.col("i") + 1)).otherwise(F.array("i")))
    gone = repeated_windows(docs, long_words).select(F.col("doc_id").alias("__d"), F.col("h").alias("__h"), lines.alias("__i")).groupBy("__d", "__h").agg(F.collect_set("__i").alias("__gone"))
    joined = docs.withColumn("__t", F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__t") == F.col("__h")) & F.col("text").isNotNull(), "left")
    touched = joined.withColumn("__lines", F.when(F.col("__gone").isNotNull(), F.split("text", "\n")))
    left = touched.withColumn("__left", F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))))
    own = {
        "text_before": F.col("text"),
        "n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1),
        "removed_lines": F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone")),
    }
    clean = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform("__left", lambda i: F.get("__lines", i)), "\n"))
    return left.select(*(clean.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns), *(e.alias(c) for c, e in own.items() if c not in docs.columns))


def chunks_sql(divisor: int, long_words: int, docs: str = "documents") -> str:
    """The same in DuckDB's SQL: doc_id, n_lines, n_removed, removed_lines, kept_bytes, kept_md5. doc_id must be unique."""
    return f"""
WITH l AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS line, len(x) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM {docs} WHERE text IS NOT NULL)),
f AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h, len(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) >= {long_words} AS long FROM l),
c AS (SELECT *, (i = n - 1 OR long OR coalesce(lead(long) OVER o, false) OR (coalesce(lag(h) OVER o, 0) * 31 + h) % {divisor} = 0) AS close FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, coalesce(sum(close::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk_no FROM c),
p AS (SELECT doc_id, chunk_no, count(*) AS lines, bool_or(long) AS long, string_agg(line, chr(10) ORDER BY i) AS bytes FROM k GROUP BY ALL),
r AS (SELECT doc_id, chunk_no, lines FROM (SELECT *, row_number() OVER (PARTITION BY bytes ORDER BY doc_id, chunk_no) AS place FROM p WHERE lines > 1 OR long) WHERE place > 1),
t AS (SELECT k.doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE r.doc_id IS NULL) AS kept FROM k LEFT JOIN r USING (doc_id, chunk_no) GROUP BY k.doc_id),
g AS (SELECT doc_id, count(*) AS n_removed, sum(lines) AS removed_lines FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS INT) AS n_lines, CAST(coalesce(g.n_removed, 0) AS INT) AS n_removed, CAST(coalesce(g.removed_lines, 0) AS INT) AS removed_lines,
CASE WHEN d.text IS NULL THEN NULL ELSE CAST(strlen(coalesce(t.kept, '')) AS INT) END AS kept_bytes, CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(t.kept, '')) END AS kept_md5
FROM {docs} d LEFT JOIN t USING (doc_id) LEFT JOIN g USING (doc_id)"""
