"""Benchmark decontamination by a distributed positional inverted index.

Windows of the benchmark (10 consecutive words of an item, or all words of a shorter one) are looked up from their rarest
terms: how often each benchmark term occurs in the corpus is counted first, and only the postings of the terms that are
among some window's rarest are stored: document, position and the term's hash, nothing else. Windows that have the same
rarest terms at the same distance share a lookup; its posting lists, moved by the terms' offsets, are intersected on
(document, place). At the places that are left the postings of all words of the windows are compared, as words. So no
shuffle carries a text's words in one row. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, UPPER, ascii_lower, broadcast_within, stored

#: What stands between words, once A-Z are lower-cased, and in texts as they are.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN_RAW = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes that a row of numbers takes in a broadcast table, its place in the table included.
ROW_BYTES = 64
RAREST = 2


def words_of(text: Column) -> Column:
    """The text's words; none for a null text."""
    return F.filter(F.split(F.coalesce(ascii_lower(text), F.lit("")), BETWEEN), lambda w: w != "")


def power_of_two(of: str) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.col(of))


def windows_of(items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Stored: wid, window (its words) of the distinct windows; and wid, item (ids as strings). Items without words have none."""
    words = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    each = words.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, size))).alias("window"))
    windows = stored(each.select("window").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    return windows, stored(each.join(windows, "window").select("wid", "item").distinct(), "window-items")


def positions(docs: DataFrame) -> DataFrame:
    """doc_id, h (the text's hash, to tell apart rows with equal doc_id), n_words, head, pos, term: a row for each word, and
    one with a null term at least for each text; head is true on one row of each text.
    """
    base = docs.select("doc_id", F.xxhash64("text").alias("h"), F.split(F.coalesce("text", F.lit("")), BETWEEN_RAW).alias("parts"))
    # a part is empty only where a text begins or ends between words
    edges = base.withColumn("lead", (F.get("parts", 0) == "").cast("int")).withColumn("n_words", F.size("parts") - F.col("lead") - ((F.size("parts") > 1) & (F.element_at("parts", -1) == "")).cast("int"))
    each = edges.select("doc_id", "h", "n_words", "lead", F.posexplode("parts").alias("p", "word"))
    low = F.when(F.octet_length("word") == F.length("word"), F.lower("word")).otherwise(F.translate("word", UPPER, UPPER.lower()))
    return each.select("doc_id", "h", "n_words", (F.col("p") == 0).alias("head"), (F.col("p") - F.col("lead")).alias("pos"), F.when(F.col("word") != "", low).alias("term"))


def rarest_terms(docs: DataFrame, windows: DataFrame, rarest: int, limit: int) -> DataFrame:
    """Stored: wid, k, th (a term's hash), at: of each window its `rarest` terms by corpus frequency, each at its first offset."""
    each = windows.select("wid", F.explode(F.array_distinct("window")).alias("term"), "window").select("wid", F.xxhash64("term").alias("th"), (F.array_position("window", F.col("term")).cast("int") - 1).alias("at"))
    each = stored(each, "window-terms")
    terms = each.select("th").distinct()
    asked = broadcast_within(terms, ROW_BYTES, limit)
    words = positions(docs).select(F.xxhash64("term").alias("th"))
    if asked is not None:
        counted = words.join(asked, "th").groupBy("th").agg(F.count("*").alias("df"))
    else:  # counts of each task's words go to the terms, not the words
        counted = words.groupBy("th").agg(F.count("*").alias("df")).join(terms, "th")
    known = each.join(counted, "th", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    ranked = known.withColumn("k", F.row_number().over(Window.partitionBy("wid").orderBy("df", "th"))).where(F.col("k") <= rarest)
    return stored(ranked.select("wid", "k", "th", "at"), "rare-terms")


def lookups_of(rare: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lid, need, th, off, bit: the terms of each lookup and their offsets from the first; and lid, need, wid, at of its windows."""
    parts = F.array_sort(F.collect_list(F.struct("k", "th", "at")))
    by_window = rare.groupBy("wid").agg(parts.alias("parts")).withColumn("at", F.get("parts", 0)["at"])
    shape = F.transform("parts", lambda p: F.struct(p["th"].alias("th"), (p["at"] - F.col("at")).alias("off")))
    windows = stored(by_window.withColumn("shape", shape).select(F.xxhash64("shape").alias("lid"), F.size("shape").alias("need"), "wid", "at", "shape"), "lookups")
    terms = windows.select("lid", "need", "shape").distinct().select("lid", "need", F.posexplode("shape").alias("k", "s"))
    return terms.select("lid", "need", F.col("s.th").alias("th"), F.col("s.off").alias("off"), power_of_two("k").alias("bit")), windows.select("lid", "need", "wid", "at")


def postings(docs: DataFrame, terms: DataFrame, limit: int) -> DataFrame:
    """Stored: doc_id, h, n_words, head, pos, th of the words whose hash is in terms (th), and the head of each text.

    th is null where a head is no posting.
    """
    keys = terms.select(F.col("th").alias("key")).distinct()
    asked, words = broadcast_within(keys, ROW_BYTES, limit), positions(docs).withColumn("th", F.when(F.col("term").isNotNull(), F.xxhash64("term"))).drop("term")
    if asked is not None:
        found = words.join(asked, F.col("th") == F.col("key"), "left").where(F.col("key").isNotNull() | F.col("head"))
        return stored(found.withColumn("th", F.col("key")).drop("key"), "postings")
    met = words.withColumn("head", F.lit(False)).join(keys, F.col("th") == F.col("key"), "left_semi")
    return stored(met.unionByName(words.where("head").withColumn("th", F.lit(None).cast("long"))), "postings")


def places(index: DataFrame, rare: DataFrame, lengths: DataFrame, limit: int) -> DataFrame:
    """Stored: doc_id, h, start, wid where a window's rarest terms all stand as they do in it."""
    terms, windows = lookups_of(rare)
    asked = broadcast_within(terms, ROW_BYTES, limit)
    lists = index.where("th is not null").join(terms if asked is None else asked, "th").select("doc_id", "h", "n_words", (F.col("pos") - F.col("off")).alias("base"), "lid", "need", "bit")
    # a bit for each term: combined before the shuffle, and alike for repeated rows
    met = lists.where("base >= 0").groupBy("doc_id", "h", "n_words", "base", "lid", "need").agg(F.bit_or("bit").alias("met")).where(F.col("met") == power_of_two("need") - 1)
    known = windows.join(lengths, "wid")
    small = broadcast_within(known, ROW_BYTES, limit)
    found = met.join(known if small is None else small, ["lid", "need"]).withColumn("start", F.col("base") - F.col("at"))
    return stored(found.where("start >= 0 and start + length <= n_words").select("doc_id", "h", "start", "wid").distinct(), "places")


def phrase_matches(docs: DataFrame, found: DataFrame, windows: DataFrame, limit: int) -> DataFrame:
    """Stored: doc_id, h, start, length, wid of the places where all words of the window stand consecutively."""
    size = F.size("window")
    wanted = found.join(windows, "wid").select("doc_id", "h", "start", "wid", size.alias("length"), F.posexplode("window").alias("i", "word")).withColumn("pos", F.col("start") + F.col("i"))
    asked = found.select(F.col("doc_id").alias("d"), F.col("h").alias("g")).distinct()
    own = docs.withColumn("__h", F.xxhash64("text"))
    n, width = asked.agg(F.count("*"), F.sum(F.coalesce(F.octet_length(F.col("d").cast("string")), F.lit(0)))).first()
    keys = F.broadcast(asked) if n * ROW_BYTES + (width or 0) <= limit else asked
    texts = own.join(keys, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("__h") == F.col("g")), "left_semi")
    words = positions(texts.select("doc_id", "text")).where("term is not null").select(F.col("doc_id").alias("d"), F.col("h").alias("g"), F.col("pos").alias("at"), "term")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")) & (F.col("pos") == F.col("at")) & (F.col("word") == F.col("term"))
    met = wanted.join(words, same).groupBy("doc_id", "h", "start", "wid", "length").agg(F.bit_or(power_of_two("i")).alias("met"))
    return stored(met.where(F.col("met") == power_of_two("length") - 1).drop("met"), "phrase-matches")


def proximity_matches(docs: DataFrame, terms: list[str], within: int) -> DataFrame:
    """doc_id, h, first, last: places where all the terms stand within `within` words, from stored postings of these terms.

    A place is reported for each last word that completes the set; first is the latest start for that end.
    """
    asked = list(dict.fromkeys(terms))
    index = stored(positions(docs).where(F.col("term").isin(asked)).select("doc_id", "h", "pos", "term"), "term-postings")
    order = Window.partitionBy("doc_id", "h").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    latest = [F.last(F.when(F.col("term") == t, F.col("pos")), ignorenulls=True).over(order) for t in asked]
    spans = index.select("doc_id", "h", F.array(*latest).alias("latest"), F.col("pos").alias("last")).where(F.forall("latest", lambda p: p.isNotNull()))
    return spans.select("doc_id", "h", F.array_min("latest").alias("first"), "last").where(F.col("last") - F.col("first") < within).distinct()


def covered(spans: DataFrame) -> DataFrame:
    """doc_id, h, n_hit: words inside any of the text's spans (doc_id, h, start, length), by a running end."""
    before = Window.partitionBy("doc_id", "h").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    ended = spans.select("doc_id", "h", "start", end.alias("end"), F.coalesce(F.max(end).over(before), F.lit(0)).alias("upto"))
    return ended.groupBy("doc_id", "h").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "upto"))).cast("int").alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, rarest: int = RAREST, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """For each row of docs: doc_id, h, n_words, n_hit, items (distinct ids as strings, sorted).

    Null and empty texts have no words and no hits; items without words match nothing; repeated rows get equal results,
    rows with one doc_id and different texts their own; other columns are ignored; without items no word is hit. A text of
    any length is rows of its words. Tables of up to broadcast_bytes are broadcast, by their counted size; beyond it joins
    shuffle, with the same results.
    """
    if not 1 <= size <= 62:
        raise ValueError("windows of 1 to 62 words")
    windows, named = windows_of(items, size)
    rare = rarest_terms(docs, windows, rarest, broadcast_bytes)
    index = postings(docs, rare, broadcast_bytes)
    found = places(index, rare, windows.select("wid", F.size("window").alias("length")), broadcast_bytes)
    hits = phrase_matches(docs, found, windows, broadcast_bytes)
    n_hit = covered(hits.select("doc_id", "h", "start", "length").distinct())
    by_item = hits.select("doc_id", "h", "wid").distinct().join(named, "wid").select("doc_id", "h", "item").distinct()
    listed = by_item.groupBy(F.col("doc_id").alias("e"), F.col("h").alias("f")).agg(F.array_sort(F.collect_list("item")).alias("items"))
    both = n_hit.join(listed, F.col("doc_id").eqNullSafe(F.col("e")) & (F.col("h") == F.col("f"))).select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "n_hit", "items")
    rows = index.where("head").select("doc_id", "h", "n_words")
    joined = rows.join(both, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    return joined.select("doc_id", "h", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
