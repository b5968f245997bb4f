"""Mixture-controlled packing by deficit round robin over source queues.

Each source is a queue of its documents' tokens, cut into slots. In a round, which is one window, every source gets a
quantum of its share of the window's slots and sends as many whole slots as its deficit covers; the rest is carried to
the next window, wherever that is computed. The round in which a source sends its r-th slot follows from its share alone,
so the schedule needs no sequential pass: rows are sorted by (round, source, position) and positions are running sums,
carried from partition to partition by one sum for each. What is left of the queues, less than a slot for each source,
fills the last windows. A source that runs dry leaves its slots to the others. No window but the last is short. Sources
without a share in a stated mixture are packed by their own sizes behind all others.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored
from .pieces import encoder, sliced

LAST_ROUND = (1 << 63) - 1
#: The rounds of sources without a share, and the last round of one with a share.
BEHIND = 1 << 62


def encoded_queues(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Documents by (source, doc_id), with their ids and the tokens before them in their part of the queue; stored."""
    src = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = src.repartitionByRange("source", "doc_id", "tie").sortWithinPartitions("source", "doc_id", "tie").drop("tie")

    def run(batches):
        encode, part, at, now = encoder(tokenizer), TaskContext.get().partitionId(), 0, object()
        end = np.array([end_id], dtype="<u4").tobytes()
        for some in sliced(batches):
            ids, offsets = encode(some.column("text"), end)
            raw, starts = narrowed(ids), []
            for source, n in zip(some.column("source").to_pylist(), np.diff(offsets).tolist()):
                if source != now:
                    now, at = source, 0
                starts.append(at)
                at += n
            rows = [raw[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("source"), pa.array(np.full(len(rows), part, dtype=np.int32)), pa.array(starts, pa.int64()), pa.array(np.diff(offsets)), pa.array(np.full(len(rows), raw.itemsize, dtype=np.int8)), pa.array(rows, pa.binary())], names=["doc_id", "source", "part", "local_start", "n", "width", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(ordered.mapInArrow(run, f"doc_id {kind}, source string, part int, local_start long, n long, width byte, ids binary"), "queues")


def narrowed(ids: np.ndarray) -> np.ndarray:
    """16-bit ids where all fit."""
    return ids.astype("<u2") if not len(ids) or ids.max() < 1 << 16 else ids


def widened(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes() if width == 2 else ids


def round_of(slot: int, share: float | None, rest: float, per_round: int) -> int:
    """The round that sends a source's slot (from 0): the first whose running quantum covers it."""
    if share is not None and share > 0:
        return min(BEHIND - 1, math.ceil((slot + 1) / (per_round * share)))
    return min(LAST_ROUND - 1, BEHIND + math.ceil((slot + 1) / (per_round * rest)))


def pack(docs: DataFrame, tokenizer: str, seq_len: int = 1024, slot: int = 128, end_id: int = 0, weights: dict[str, float] | None = None) -> DataFrame:
    """Pieces of all documents of docs (doc_id, text, source) in sequences of seq_len tokens.

    weights: target proportions by source, taken relative to each other among the sources that docs has; a source that isn't
    named, or named with zero, has no share and comes behind all that have one (negative weights are refused). By default
    the sources' own shares, so that all queues end together. At each window's end a source with a share has sent that
    share of all slots so far, within a slot for each source, until the first of them runs dry. Returns doc_id, source,
    start, length, ids_crc32, doc_tokens, sequence_id, offset. Null or empty texts are a piece of the end id alone; a null source is a queue of its own; rows with equal
    doc_id are packed one behind the other; other columns are ignored; no rows make no pieces. A long text is cut like any.
    """
    assert seq_len % slot == 0
    spark = docs.sparkSession
    queues = encoded_queues(docs, tokenizer, end_id)
    by_part = queues.groupBy("source", "part").agg(F.sum("n").alias("tokens"))
    own = Window.partitionBy("source")
    marked = by_part.withColumn("before", F.coalesce(F.sum("tokens").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("tokens").over(own)).drop("tokens")
    slots = F.floor(F.col("total") / F.lit(slot)).cast("long")
    totals = by_part.groupBy("source").agg(F.floor(F.sum("tokens") / F.lit(slot)).alias("full"))
    if weights is None:
        share, rest = slots / F.lit(float(max(totals.agg(F.sum("full")).first()[0] or 0, 1))), F.lit(0.0)
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        named = spark.createDataFrame([(s, float(w)) for s, w in weights.items() if w > 0], "w_source string, weight double")
        held = totals.join(F.broadcast(named), F.col("source") == F.col("w_source"), "left")
        top, left = held.agg(F.sum("weight"), F.sum(F.when(F.col("weight").isNull(), F.col("full")))).first()
        marked = marked.join(F.broadcast(named), F.col("source") == F.col("w_source"), "left")
        share, rest = F.col("weight") / F.lit(float(top or 1.0)), slots / F.lit(float(max(left or 0, 1)))
    meta = small(stored(marked.select(F.col("source").alias("m_source"), F.col("part").alias("m_part"), "before", slots.alias("full"), share.cast("double").alias("share"), rest.cast("double").alias("rest")), "queue-sums"))
    placed = queues.join(meta, (F.col("part") == F.col("m_part")) & F.col("source").eqNullSafe(F.col("m_source"))).select("doc_id", "source", (F.col("before") + F.col("local_start")).alias("at"), "n", "width", "ids", "full", "share", "rest")
    per_round = seq_len // slot

    def cut(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                row, at, start, size, crc, when, tail = [], [], [], [], [], [], []
                cols = [some.column(c).to_pylist() for c in ("at", "n", "width", "ids", "full", "share", "rest")]
                for k, (a, n, width, ids, full, share, rest) in enumerate(zip(*cols)):
                    raw = memoryview(widened(ids, width))
                    edges = [a, *range((a // slot + 1) * slot, a + n, slot), a + n]
                    for x, y in zip(edges, edges[1:]):
                        r, own = x // slot, raw[4 * (x - a) : 4 * (y - a)]
                        row.append(k), at.append(x), start.append(x - a), size.append(y - x), crc.append(zlib.crc32(own))
                        when.append(LAST_ROUND if r >= full else round_of(r, share, rest, per_round))
                        tail.append(bytes(own) if r >= full else None)
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(when, pa.int64()), some.column("source").take(take), pa.array(at, pa.int64()), some.column("doc_id").take(take), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), some.column("n").take(take), pa.array(tail, pa.binary())], names=["round", "source", "at", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "tail"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"source string, at long, doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, tail binary"
    pieces = placed.mapInArrow(cut, f"round long, {fields}").repartitionByRange("round", "source", "at").sortWithinPartitions("round", "source", "at").drop("round")

    def summed(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = batch.column("length").to_numpy()
            ends = at + np.cumsum(size)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(size), part, dtype=np.int32)), pa.array(ends - size)], names=[*batch.schema.names, "part", "local"])
            at = int(ends[-1]) if len(size) else at

    lined = stored(pieces.mapInArrow(summed, f"{fields}, part int, local long"), "pieces")
    sums, base = sorted((r["part"], r["n"]) for r in lined.groupBy("part").agg(F.sum("length").alias("n")).collect()), [(-1, 0)]
    at = 0
    for part, n in sums:
        base.append((part, at))
        at += n
    located = lined.join(F.broadcast(spark.createDataFrame(base, "part int, base long")), "part").withColumn("pos", F.col("base") + F.col("local"))

    def split(batches):
        names = ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            pos, size = batch.column("pos").to_numpy(), batch.column("length").to_numpy()
            over = np.flatnonzero(pos // seq_len != (pos + size - 1) // seq_len)
            row, start, length, crc, at = np.arange(len(pos)), batch.column("start").to_numpy(), size, batch.column("ids_crc32").to_numpy(), pos
            if len(over):  # only what the queues had left over can cross a window's end
                more = []
                for k in over.tolist():
                    raw, first = batch.column("tail")[k].as_py(), int(seq_len - pos[k] % seq_len)
                    edges = [0, *range(first, int(size[k]), seq_len), int(size[k])]
                    more += [(k, int(start[k]) + x, y - x, zlib.crc32(raw[4 * x : 4 * y]), int(pos[k]) + x) for x, y in zip(edges, edges[1:])]
                whole = np.setdiff1d(row, over)
                row, start, length, crc, at = (np.concatenate([v[whole], np.array(m, dtype=np.int64)]) for v, m in zip((row, start, length, crc, at), zip(*more)))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("source").take(take), *(pa.array(v) for v in (start, length, crc)), batch.column("doc_tokens").take(take), pa.array(at // seq_len), pa.array(at % seq_len)], names=names)

    return located.mapInArrow(split, f"doc_id {kind}, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
