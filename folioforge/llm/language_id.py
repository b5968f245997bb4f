"""Language ID by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, made from its code point alone, so every letter of every script has its own.
An n-gram's vector binds its letters' vectors, each rotated by its place; a text's vector bundles (sums) those of its
n-grams; a language's prototype bundles the training texts of that language. A text has the language whose prototype has
the highest cosine with its vector; of equal ones the first by name.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sole_holder
from .pieces import sliced

DIM, GRAM = 512, 3
#: Slots of the table of n-gram vectors that a worker keeps; a power of two.
SLOTS = 1 << 16
#: Bits of a code point in an n-gram's key.
POINT = 21


@lru_cache(maxsize=1)
def is_letter() -> np.ndarray:
    """By code point."""
    return np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])


def folded(text: str) -> np.ndarray:
    """Code points of the lower-cased text, all but letters 0, runs of these once, with one at each end; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = np.where(is_letter()[points], points, 0)
    if not points.any():
        return points[:0]
    points = np.concatenate([[0], points, [0]])
    return points[np.concatenate([[True], (points[1:] != 0) | (points[:-1] != 0)])]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the text's distinct n-grams (their code points in a row) and how often each stands there."""
    points = folded(text).astype(np.int64)
    if len(points) < GRAM:
        return points[:0], points[:0]
    n = len(points) - GRAM + 1
    key = points[:n].copy()
    for k in range(1, GRAM):
        key = key << POINT | points[k : n + k]
    return np.unique(key, return_counts=True)


def letter_bits(points: np.ndarray, seed: int) -> np.ndarray:
    """DIM bits for each code point: a counter mixed by multiplications and shifts (splitmix64), 64 bits at a time."""
    z = (points.astype(np.uint64)[:, None] * np.uint64(DIM // 64) + np.arange(DIM // 64, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ z >> np.uint64(shift)) * np.uint64(factor)
    z ^= z >> np.uint64(31)
    return np.unpackbits(z.astype(">u8").view(np.uint8), axis=1)


class Profiles:
    """Languages and their prototypes; each a unit vector."""

    def __init__(self, langs: list[str], prototypes: np.ndarray | None = None, seed: int = 20):
        self.langs, self.seed = langs, seed
        self.prototypes = np.zeros((len(langs), DIM)) if prototypes is None else prototypes
        self.keys = np.full(SLOTS, -1, dtype=np.int64)
        self.vectors = np.zeros((SLOTS, DIM), dtype=np.int8)

    def made(self, keys: np.ndarray) -> np.ndarray:
        """The n-grams' vectors: signs multiply as bits are added without carry."""
        bits = np.zeros((len(keys), DIM), dtype=np.uint8)
        for place in range(GRAM):
            bits ^= np.roll(letter_bits(keys >> POINT * (GRAM - 1 - place) & (1 << POINT) - 1, self.seed), place, axis=1)
        return 1 - 2 * bits.astype(np.int8)

    def bound(self, keys: np.ndarray) -> np.ndarray:
        """The same from the table, where each n-gram has one slot; another one in it gives way."""
        slot = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        missing = np.flatnonzero(self.keys[slot] != keys)
        if not len(missing):
            return self.vectors[slot]
        out = self.vectors[slot]
        out[missing] = self.made(keys[missing])
        self.keys[slot[missing]], self.vectors[slot[missing]] = keys[missing], out[missing]
        return out

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the n-grams' vectors, exact in whole numbers."""
        total = np.zeros(DIM)
        for lo in range(0, len(keys), 8192):
            some = counts[lo : lo + 8192]
            kind = np.float32 if some.sum() < 1 << 24 else np.float64
            total += some.astype(kind) @ self.bound(keys[lo : lo + 8192]).astype(kind)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its cosine, 0 to 1; und and 0 without letters or languages."""
        keys, counts = grams(text or "")
        if not len(keys) or not self.langs:
            return "und", 0.0
        own = self.bundle(keys, counts)
        norm = float(np.sqrt((own**2).sum()))
        cosines = self.prototypes @ own / norm if norm else np.zeros(len(self.langs))
        best = int(np.argmax(cosines))
        return self.langs[best], float(min(1.0, max(0.0, cosines[best])))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, most_rows: int = 5_000, seed: int = 20) -> Profiles:
    """Prototypes from text and lang of the rows of docs where both are there, about most_rows of each language at most.

    That bound is on the sample the classifier is fitted on: a language's rows are drawn by a 63-bit hash of doc_id and
    text, all of them while it has no more than most_rows, so rare languages are learned as well as frequent ones.
    Without labelled rows there are no languages; labelled rows of which none is drawn are an error. The driver gets a row
    for each language and DIM sums for each language, whatever the rows; sums of whole numbers don't depend on their order.
    """
    spark = docs.sparkSession
    draw = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 63) - 1))
    labelled = docs.where("text is not null and lang is not null").select(F.col("text").alias("text"), F.col("lang").cast("string").alias("lang"), draw.alias("draw"))
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Profiles([], seed=seed)
    cuts = [(lang, (1 << 63) - 1 if n <= most_rows else (1 << 63) * most_rows // n) for lang, n in sizes.items()]
    table = F.broadcast(spark.createDataFrame(cuts, "cut_lang string, cut long"))
    sample = labelled.join(table, F.col("lang") == F.col("cut_lang")).where("draw <= cut").select("text", "lang")

    def counted(batches):
        sole_holder("language_id", MODELS.clear)
        model, found = Profiles([], seed=seed), {}
        for batch in sliced(batches):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                keys, counts = grams(text)
                found[lang] = found.get(lang, 0) + model.bundle(keys, counts)
        for lang, own in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM, pa.string()), pa.array(np.arange(DIM), pa.int64()), pa.array(own.astype(np.int64))], names=["lang", "place", "n"])

    rows = sample.mapInArrow(counted, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).collect()
    if not rows:
        raise RuntimeError(f"{sum(sizes.values())} labelled rows, but none was drawn")
    langs = sorted({r.lang for r in rows})
    sums = np.zeros((len(langs), DIM))
    for r in rows:
        sums[langs.index(r.lang), r.place] = r.n
    norms = np.sqrt((sums**2).sum(axis=1, keepdims=True))
    return Profiles(langs, np.divide(sums, norms, out=np.zeros_like(sums), where=norms > 0), seed)


MODELS: dict[tuple, Profiles] = {}


def predicted(docs: DataFrame, model: Profiles, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred and score for every row of docs: its text alone is looked at.

    Null texts and texts without letters are und with score 0, and so is every text where the model has no languages. A
    text's cost and memory follow its length; very long ones are counted whole. Rows are independent; repeated rows repeat
    their result, an empty table gives none. Columns of docs named lang_pred or score can be kept and come first.
    """
    langs, prototypes, seed = model.langs, model.prototypes, model.seed
    key = (tuple(langs), seed, zlib.crc32(prototypes.tobytes()))

    def run(batches):
        sole_holder("language_id", MODELS.clear)
        if key not in MODELS:
            MODELS.clear()
            MODELS[key] = Profiles(langs, prototypes, seed)
        own = MODELS[key]
        for batch in sliced(batches, column="__text"):
            found = [own.predict(t) for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f"k{i}") for i in range(len(keep))), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*(f"k{i}" for i in range(len(keep))), "lang_pred", "score"])

    kinds = ", ".join([*(f"k{i} {docs.schema[k].dataType.simpleString()}" for i, k in enumerate(keep)), "lang_pred string", "score double"])
    out = docs.select(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep)), F.col("text").alias("__text")).mapInArrow(run, kinds)
    return out.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keep)), "lang_pred", "score")
