"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

For merge-based vocabularies the last token of each prefix is unique: the one that ends there, starts where another
prefix ended, and isn't merged otherwise with that prefix's last token. So one pass gives the count at every prefix.
Counts are kept as the step from the count before, for each character, in one signed byte where all steps of a text fit;
truncation and budget questions are answered from those, without encoding again. All counts come from this program, those
of texts with any characters or special strings too; the library is only asked which kind of character a rare one is.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pieces import CONTRACTIONS, LETTERS, NUMBERS, UNUSUAL, ChunkCoder, Kept, byte_letters, sliced

#: The white space of Unicode, which pieces are cut at.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A unit is a run of white space with the piece behind it: no other prefix changes how it is cut.
UNITS = re.compile(rf"(?:[{WHITE}]*(?! )[{WHITE}])?(?:{CONTRACTIONS})|[{WHITE}]*(?:[{LETTERS}]+|[{NUMBERS}]+|[^{WHITE}{LETTERS}{NUMBERS}]+)|[{WHITE}]+")
NEVER = 1 << 60
SHAPE = re.compile(rf"([{WHITE}]*)(.*)", re.S)
#: Stand for rare characters where texts are cut: a letter, a number and a mark.
STANDS = {"letter": "\u01bb", "number": "\xb2", "mark": "\xa1"}
CONTRACTED = set(CONTRACTIONS.split("|"))


class Kinds(dict):
    """Code point -> what stands for it where a text is cut; itself if its kind is known here. Kinds are the library's."""

    def __init__(self, cuts):
        super().__init__()
        self.cuts, self.white = cuts, re.compile(f"[{WHITE}]")

    def __missing__(self, point: int) -> str:
        char = chr(point)
        alone = lambda before: len(self.cuts(before + char)) > 1
        if not UNUSUAL.search(char) or self.white.match(char):
            found = char
        else:
            found = STANDS["letter" if not alone("a") else "number" if not alone("1") else "mark"]
        self[point] = found
        return found


class PrefixCounter:
    def __init__(self, path: str, most: int = 900_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.special = [t["content"] for t in spec["added_tokens"]]
        raw = lambda s: bytes(letters[c] for c in s)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.vocab = {raw(t) for t in spec["model"]["vocab"] if t not in self.special}
        self.longest = max(map(len, self.vocab))
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.units = Kept(self.unit, most // 4)
        self.kinds = Kinds(self.library.pre_tokenizer.pre_tokenize_str)
        self.coder = ChunkCoder(self.steps, self.plain_steps, "<i4", self.special, most)

    def merged(self, text: bytes) -> list[bytes]:
        parts = [text[i : i + 1] for i in range(len(text))]
        rank = self.rank.get
        ranks = [rank(p, NEVER) for p in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < NEVER:
            k = ranks.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = rank((parts[k], parts[k + 1]), NEVER)
            if k:
                ranks[k - 1] = rank((parts[k - 1], parts[k]), NEVER)
        return parts

    def stands(self, a: bytes, b: bytes) -> bool:
        """Whether tokens a, b next to each other stay as they are."""
        if (found := self.pairs.get((a, b))) is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return found

    def counts(self, piece: bytes) -> list[int]:
        """Tokens of piece[:k] for k from 0, where the piece is merged as one."""
        n = len(piece)
        last, count, vocab, longest = [b""] * (n + 1), [0] * (n + 1), self.vocab, self.longest
        for end in range(1, n + 1):
            for at in range(max(0, end - longest), end):
                token = piece[at:end]
                if token in vocab and (not at or self.stands(last[at], token)):
                    last[end], count[end] = token, count[at] + 1
                    break
        return count

    def ends(self, piece: str) -> list[int]:
        """Tokens of piece[:k] for k from 1 to its length in characters."""
        count = self.counts(raw := piece.encode())
        if len(raw) == len(piece):
            return count[1:]
        at, found = 0, []
        for c in piece:
            at += len(c.encode())
            found.append(count[at])
        return found

    def unit(self, unit: str) -> bytes:
        space, body = SHAPE.fullmatch(unit).groups()
        if not body:
            steps = self.ends(space)
        elif space == " ":  # its count is that of the first character in the joined piece
            steps = self.ends(unit)
        else:
            steps = self.ends(space) if space else []
            before = 0
            if space:
                # behind a run of white space its last blank goes with what follows; another last character stands alone
                before = self.ends(space[:-1])[-1] if len(space) > 1 else 0
                if space[-1] != " ":
                    before += self.ends(space[-1])[-1]
            joined = space[-1:] == " "
            if not joined and body in CONTRACTED:
                one = self.ends(body[0])[-1]
                inner = [one] + [one + self.ends(body[1:k])[-1] for k in range(2, len(body))] + [self.ends(body)[-1]]
            else:
                inner = self.ends(" " + body)[1:] if joined else self.ends(body)
            steps = steps + [before + c for c in inner]
        return array("i", [b - a for a, b in zip([0, *steps], steps)]).tobytes()

    def plain_steps(self, text: str) -> bytes:
        if not UNUSUAL.search(text):
            return b"".join(map(self.units.__getitem__, UNITS.findall(text)))
        return b"".join(self.units[text[m.start() : m.end()]] for m in UNITS.finditer(text.translate(self.kinds)))

    def steps(self, text: str) -> bytes:
        """A 32-bit step for each character: tokens of the prefix that ends there, less those of the one before."""
        held = [s for s in self.special if s in text]
        if not held:
            return self.plain_steps(text)
        out = b""
        parts = re.split("(" + "|".join(map(re.escape, sorted(held, key=len, reverse=True))) + ")", text)
        for k in range(0, len(parts) - 1, 2):
            plain, mark = parts[k], parts[k + 1]
            cut = np.frombuffer(self.plain_steps(plain + mark[:-1]), dtype="<i4")
            last = int(cut[: len(plain)].sum(dtype=np.int64)) + 1 - int(cut.sum(dtype=np.int64))
            out += cut.tobytes() + np.array([last], dtype="<i4").tobytes()
        return out + self.plain_steps(parts[-1])

    def table(self, text: str) -> np.ndarray:
        """Tokens of text[:k] for k from 0 to the length."""
        return np.concatenate([[0], np.cumsum(np.frombuffer(self.steps(text), dtype="<i4"), dtype=np.int64)])


def packed(steps: np.ndarray) -> bytes:
    """Steps as bytes: 1 and one byte each where all fit, else 4 and four bytes each."""
    fits = not len(steps) or (steps.min() >= -128 and steps.max() < 128)
    return bytes([1 if fits else 4]) + steps.astype(np.int8 if fits else "<i4").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.int8 if raw[0] == 1 else "<i4", offset=1)


def longest_within(table: np.ndarray, budget: int) -> int:
    """The longest prefix of at most `budget` tokens; table[k] has the tokens of the first k + 1 characters."""
    fine = np.flatnonzero(table <= budget)
    return int(fine[-1]) + 1 if len(fine) else 0


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_table(docs: DataFrame, tokenizer: str, budget: int, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each row of docs, in any order: the kept columns, n_bytes, n_tokens, fits_chars and prefix_steps.

    prefix_steps has a step for each character (see PrefixCounter.steps and packed); fits_chars is the longest prefix of at
    most `budget` tokens, as some longer prefix may have fewer than a shorter one. Time and memory follow a text's length. Null and empty texts have no tokens and an empty table. Rows are independent: repeated rows
    give repeated results, an empty table gives none, and other columns are ignored whatever they are called.
    """
    src = docs.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keep)), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kinds = ", ".join(f"k{i} {docs.schema[k].dataType.simpleString()}" for i, k in enumerate(keep))

    def run(batches):
        count = counter(tokenizer)
        for some in sliced(batches, size=4 << 20):
            texts = some.column("text")
            steps, at = count.coder(texts)
            n_bytes, n_tokens, fits, rows = pc.binary_length(texts.cast(pa.binary())), [], [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                own = steps[a:b]
                table = np.cumsum(own, dtype=np.int64)
                n_tokens.append(int(table[-1]) if b > a else 0)
                fits.append(b - a if n_tokens[-1] <= budget else longest_within(table, budget))
                rows.append(packed(own))
            keys = [some.column(f"k{i}") for i in range(len(keep))]
            names = [f"k{i}" for i in range(len(keep))] + ["n_bytes", "n_tokens", "fits_chars", "prefix_steps"]
            yield pa.RecordBatch.from_arrays([*keys, n_bytes.cast(pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(fits, pa.int64()), pa.array(rows, pa.binary())], names=names)

    out = src.mapInArrow(run, f"{kinds}, n_bytes long, n_tokens long, fits_chars long, prefix_steps binary")
    return out.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keep)), "n_bytes", "n_tokens", "fits_chars", "prefix_steps")


def tokens_of_prefix(prefix_steps: Column, chars: int) -> Column:
    """Tokens of the first `chars` characters, from the stored steps alone."""

    @F.pandas_udf("long")
    def answer(steps):
        return steps.map(lambda s: int(unpacked(s)[:chars].sum(dtype=np.int64)))

    return answer(prefix_steps)
