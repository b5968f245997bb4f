"""Token ids of whole texts, encoding each distinct piece of text once per worker.

A tokenizer whose pre-tokenizer cuts the text by a pattern encodes every piece by itself, so the ids of a text are the
ids of its pieces in order. The cuts of a batch are found at once from the classes of its characters; the ids of the
distinct pieces come from the tokenizers library and are kept in a bounded table. The cut is made here only where
Python's classes and the library's are the same, up to U+01FF; every other text, and every text that holds a special
string, goes to the library whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import sole_holder

LAST = 0x1FF
LETTERS = "a-zA-Z" + "".join(chr(c) for c in range(0xA0, LAST + 1) if unicodedata.category(chr(c))[0] == "L")
NUMBERS = "0-9" + "".join(chr(c) for c in range(0xA0, LAST + 1) if unicodedata.category(chr(c))[0] == "N")
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Anything else than these goes to the library whole. U+0130 has a lower case of two characters.
UNUSUAL = re.compile(rf"[^\t\n\r -~\xa0-{chr(LAST)}]|İ")


#: Bytes that such characters have: controls, and lead bytes from U+0200.
ODD = np.zeros(256, dtype=bool)
ODD[[*range(9), 11, 12, *range(14, 32), 127, *range(0xC8, 256)]] = True
LETTER, NUMBER, MARK, BLANK, SPACE = range(5)


def kind_of(char: str) -> int:
    if char.isspace():
        return BLANK if char == " " else SPACE
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(char)[0], MARK)


#: Kinds of characters of one byte and of two; lower case may lead from below U+0200 to above.
WIDE_KIND = np.array([kind_of(chr(c)) for c in range(0x800)], dtype=np.uint8)
ASCII_KIND = np.concatenate([WIDE_KIND[:128], np.full(128, MARK, dtype=np.uint8)])
#: What follows the apostrophe of a contraction.
ONE_LETTER = np.frombuffer(b"stmd", dtype=np.uint8)
TWO_LETTERS = np.frombuffer(b"revell", dtype=">u2").astype(np.int64)

#: White space before a blank: then a run of white space isn't cut at its blanks.
RUNS = ("  ", "\n ", "\t ", "\r ", "\xa0 ")


class Kept(dict):
    """Chunk -> its values as bytes. A full table takes no more chunks, and starts anew after as many misses again four times."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.missed = make, most, 0

    def __missing__(self, chunk: str) -> bytes:
        made = self.make(chunk)
        if len(self) < self.most:
            if len(chunk) <= 48:
                self[chunk] = made
        else:
            self.missed += 1
            if self.missed > 4 * self.most:
                self.clear()
                self.missed = 0
        return made


class ChunkCoder:
    """Values of whole texts, put together from those of their chunks, each made once for a batch and then kept.

    whole(text) and chunk(text) give values as bytes; chunk is asked only for what lies between blanks of usual texts,
    with the blank before it. All else goes to whole.
    """

    def __init__(self, whole, chunk, dtype: str, special: list[str], most: int = 600_000):
        self.whole, self.special, self.dtype = whole, special, np.dtype(dtype)
        self.heads = Kept(chunk, most // 8)
        self.kept = Kept(lambda c: chunk(" " + c), most)

    def __call__(self, texts: pa.StringArray, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """All values in a row, each text's followed by `end`; where each text's begin, and the end of the last."""
        texts = texts.cast(pa.string())
        n = len(texts)
        odd = unusual(texts, [*self.special, *RUNS])
        lists = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        own = [self.kept[c] for c in coded.dictionary.to_pylist()]
        first = np.asarray(lists.offsets)[:n].astype(np.int64) - lists.offsets[0].as_py()
        codes[first] = len(own) + np.arange(n)  # what begins a text has no blank before it
        own += [self.heads[h] for h in pc.list_element(lists, 0).to_pylist()]
        wholes = np.flatnonzero(odd)
        if len(wholes):
            codes[first[wholes]] = len(own) + np.arange(len(wholes))
            own += [self.whole(t) for t in texts.take(pa.array(wholes)).to_pylist()]
        ends = np.append(first[1:], len(codes))
        if end:
            codes, ends = np.insert(codes, ends, len(own)), ends + np.arange(1, n + 1)
            own.append(end)
        values, upto = joined(own, codes, self.dtype)
        return values, np.concatenate([[0], upto[ends - 1]]) if n else np.zeros(1, dtype=np.int64)


def unusual(texts: pa.StringArray, marks: list[str]) -> np.ndarray:
    """Which texts hold a character beyond the classes known here, or one of the marks."""
    own, at = text_bytes(texts)
    where = [np.flatnonzero(ODD[own])]
    lead = np.flatnonzero((own[:-1] == 0xC2) | (own[:-1] == 0xC4))
    where.append(lead[((own[lead] == 0xC2) & (own[lead + 1] < 0xA0)) | ((own[lead] == 0xC4) & (own[lead + 1] == 0xB0))])
    rows = np.zeros(len(texts), dtype=bool)
    rows[np.searchsorted(at, np.concatenate(where), side="right") - 1] = True
    for mark in marks:
        rows |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    return rows


def text_bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins, with the end of the last."""
    at = np.frombuffer(texts.buffers()[1], dtype="<i4", count=len(texts) + 1, offset=4 * texts.offset)
    return np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def joined(own: list[bytes], codes: np.ndarray, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values own[c] for each code c in a row, and how many there are up to and with each."""
    size = np.fromiter(map(len, own), dtype=np.int32, count=len(own)) // dtype.itemsize
    held = np.frombuffer(b"".join(own), dtype=dtype)
    begin = np.cumsum(size, dtype=np.int64) - size
    long = size[codes]
    upto = np.cumsum(long, dtype=np.int64)
    place = np.arange(int(upto[-1]) if len(upto) else 0, dtype=np.int32 if max(len(held), upto[-1] if len(upto) else 0) < 1 << 31 else np.int64)
    place += np.repeat((begin[codes] - upto + long).astype(place.dtype), long)
    return held[place], upto


def piece_starts(own: np.ndarray, at: np.ndarray, words: bool) -> np.ndarray:
    """Where the pieces of usual texts begin, in bytes of all texts in a row; each text's first piece begins with it.

    A piece is a run of letters, of numbers or of other marks, with the blank before it; a contraction behind a letter, a
    number or white space; or white space, whose last character is no part of it where more follows. For `words` a
    number is a piece by itself, a contraction may follow a blank, and white space counts for nothing.
    """
    if not (n := len(own)):
        return np.zeros(0, dtype=np.int64)
    kind = ASCII_KIND[own]
    lead = np.flatnonzero(own >= 0xC2)
    kind[lead] = kind[lead + 1] = WIDE_KIND[((own[lead] & 31).astype(np.int64) << 6) | (own[lead + 1] & 63)]
    opens = np.zeros(n + 3, dtype=bool)
    opens[at] = True
    space = np.ones(n + 3, dtype=bool)  # behind the end nothing follows
    space[:n] = kind >= BLANK
    starts = np.ones(n, dtype=bool)
    starts[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != BLANK)
    inner = np.flatnonzero(space[1:n] & space[: n - 1]) + 1
    starts[inner] = ~space[inner + 1] & ~opens[inner + 1]
    wide = lead[kind[lead] == SPACE]
    starts[wide] = ~space[wide - 1] | (~space[wide + 2] & ~opens[wide + 2])
    starts[wide + 1] = False
    if words:
        more = np.flatnonzero((kind[1:] == NUMBER) & (kind[:-1] == NUMBER)) + 1
        starts[more] = own[more] & 0xC0 != 0x80
    starts[at[:-1][at[:-1] < n]] = True
    mark = np.flatnonzero(own == ord("'"))
    mark = mark[starts[mark] | ((kind[mark - 1] == BLANK) if words else False)]
    ahead = np.zeros((2, len(mark)), dtype=np.uint8)
    for k in (0, 1):
        inside = mark + k + 1 < n
        ahead[k, inside] = own[mark[inside] + k + 1]
    one = ~opens[mark + 1] & np.isin(ahead[0], ONE_LETTER)
    two = ~opens[mark + 1] & ~opens[mark + 2] & np.isin(ahead[0].astype(np.int64) << 8 | ahead[1], TWO_LETTERS)
    starts[mark[one | two] + 1] = False
    ends = np.concatenate([mark[one] + 2, mark[two] + 3])
    starts[ends[ends < n]] = True
    return np.flatnonzero(starts)


class PieceCoder:
    """Ids of whole texts, put together from those of their pieces, each made once for a batch and then kept."""

    def __init__(self, whole, piece, words: bool, special: list[str], most: int):
        self.whole, self.words, self.special, self.dtype = whole, words, special, np.dtype("<u4")
        self.kept = Kept(piece, most)

    def __call__(self, texts: pa.StringArray, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each text's followed by `end`; where each text's begin, and the end of the last."""
        texts = texts.cast(pa.string())
        n = len(texts)
        odd = unusual(texts, self.special)
        usual = pc.if_else(pa.array(odd), "", texts)
        raw, at = text_bytes(pc.utf8_lower(usual) if self.words else usual)
        starts = piece_starts(raw, at, self.words)
        offsets = np.append(starts, len(raw)).astype("<i4")
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        codes = coded.indices.to_numpy()
        own = list(map(self.kept.__getitem__, coded.dictionary.to_pylist()))
        bounds = np.searchsorted(starts, at)
        wholes = np.flatnonzero(odd)
        if len(wholes):
            codes = np.insert(codes, bounds[wholes], len(own) + np.arange(len(wholes)))
            bounds = bounds + np.concatenate([[0], np.cumsum(odd)])
            own += [self.whole(t) for t in texts.take(pa.array(wholes)).to_pylist()]
        if end:
            codes = np.insert(codes, bounds[1:], len(own))
            bounds = bounds + np.arange(n + 1)
            own.append(end)
        values, upto = joined(own, codes, self.dtype)
        return values, np.concatenate([[0], upto])[bounds]


class PieceEncoder:
    """Ids of texts: encode(texts) for an Arrow array, encode.library(text) for one by the library alone."""

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.letters = str.maketrans({b: c for c, b in byte_letters().items()})
        self.merge = self.tokenizer.model.tokenize
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
            words = False
        elif norm and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]:
            words = True
        else:
            raise ValueError("the file's way of cutting text isn't known here")
        self.coder = PieceCoder(self.whole, self.word if words else self.piece, words, [t["content"] for t in spec["added_tokens"]], most)

    def library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def whole(self, text: str) -> bytes:
        return array("I", self.library(text)).tobytes()

    def piece(self, piece: bytes) -> bytes:
        """The piece through the library's merge model."""
        return array("I", [t.id for t in self.merge(piece.decode("latin-1").translate(self.letters))]).tobytes()

    def word(self, piece: bytes) -> bytes:
        word = piece.decode().strip().encode()
        return self.piece(word) if word else b""

    def __call__(self, texts: pa.StringArray, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        return self.coder(texts, end)


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, the rest follow from U+0100."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def kept_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encoder(path: str) -> PieceEncoder:
    """One for each worker process, until another file or another operator with tables comes."""
    sole_holder("pieces", kept_encoder.cache_clear)
    return kept_encoder(path)


def sliced(batches, column: str = "text", size: int = 4 << 20):
    """The batches in slices of about `size` bytes of text; at their end free memory goes back to the system."""
    for batch in batches:
        lo = 0
        while lo < batch.num_rows:
            texts = batch.column(column).cast(pa.string())
            at = np.frombuffer(texts.buffers()[1], dtype="<i4", count=len(texts) + 1, offset=4 * texts.offset)
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi
    pa.default_memory_pool().release_unused()
