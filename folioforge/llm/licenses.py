"""License scans: Aho-Corasick for identifier tags and notice phrases, a shunting-yard parser for licence expressions.

Base labels come from phrases of whole words. The method's own labels come from more notice phrases and from the
expressions behind SPDX-License-Identifier tags, which are evaluated to the licences they name; known identifiers give the
labels that phrases give, others stand in the expression alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import sliced

#: Phrase and label.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notice phrases of the method's own, with the share of certainty they carry.
NOTICES = {
    "gnu general public license version 3": ("gpl-3", 0.9),
    "gnu general public license version 2": ("gpl-2", 0.9),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl-3", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "cc by sa": ("cc-by-sa", 0.7),
    "cc by nd": ("cc-by-nd", 0.7),
    "creative commons attribution": ("cc-by", 0.7),
    "permission is hereby granted free of charge": ("mit", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "all rights reserved": ("proprietary", 0.4),
    "public domain": ("public-domain", 0.4),
}
#: Licence identifiers and their labels; an identifier's -only, -or-later and + count as the bare one.
KNOWN = {
    "0bsd": "bsd", "agpl-3.0": "agpl-3", "apache-1.1": "apache-1", "apache-2.0": "apache-2", "artistic-2.0": "artistic", "bsd-2-clause": "bsd", "bsd-3-clause": "bsd", "bsl-1.0": "bsl",
    "cc-by-3.0": "cc-by", "cc-by-4.0": "cc-by", "cc-by-nc-3.0": "cc-by-nc", "cc-by-nc-4.0": "cc-by-nc", "cc-by-nc-nd-4.0": "cc-by-nc", "cc-by-nc-sa-4.0": "cc-by-nc", "cc-by-nd-4.0": "cc-by-nd", "cc-by-sa-3.0": "cc-by-sa", "cc-by-sa-4.0": "cc-by-sa",
    "cc0-1.0": "public-domain", "cddl-1.0": "cddl", "epl-1.0": "epl", "epl-2.0": "epl", "gpl-2.0": "gpl-2", "gpl-3.0": "gpl-3", "isc": "isc", "lgpl-2.0": "lgpl", "lgpl-2.1": "lgpl", "lgpl-3.0": "lgpl",
    "mit": "mit", "mit-0": "mit", "mpl-1.1": "mpl", "mpl-2.0": "mpl", "unlicense": "public-domain", "wtfpl": "wtfpl", "zlib": "zlib",
}
TAG = "spdx license identifier"
#: The base class of word characters on bytes, A-Z lower-cased and everything between words a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
TAGGED = re.compile(r"SPDX-License-Identifier\s*:[ \t]*([^\r\n]*)", re.I)
LEXEME = re.compile(r"\s*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
BINDS = {"or": 1, "and": 2, "with": 3}


def parse_expression(text: str) -> list[tuple[str, ...]] | None:
    """Postfix of a licence expression by shunting-yard: ("id", name), ("and",), ("or",), ("with",); None if it isn't one.

    What follows a whole expression, such as a comment's end, is left aside.
    """
    out: list[tuple[str, ...]] = []
    held: list[str] = []
    at, operand = 0, True
    depth, best = 0, None
    while m := LEXEME.match(text, at):
        word = m[1]
        low = word.lower()
        if operand:
            if word == "(":
                held.append("(")
                depth += 1
            elif low in BINDS or word == ")":
                break
            else:
                out.append(("id", low))
                operand = False
        elif low in BINDS:
            while held and held[-1] != "(" and BINDS[held[-1]] >= BINDS[low]:
                out.append((held.pop(),))
            held.append(low)
            operand = True
        elif word == ")":
            while held and held[-1] != "(":
                out.append((held.pop(),))
            if not held:
                break
            held.pop()
            depth -= 1
        else:
            break
        if not operand and not depth:  # at most one operator of each kind is held here
            best = (len(out), held[::-1])
        at = m.end()
    return best and out[: best[0]] + [(h,) for h in best[1]]


def tree_of(postfix: list[tuple[str, ...]]) -> tuple:
    """("id", name), ("with", part, part), or ("and" | "or", parts...), where a part isn't of its whole's kind."""
    stack: list[tuple] = []
    for op in postfix:
        if op[0] == "id":
            stack.append(op)
            continue
        b, a = stack.pop(), stack.pop()
        if op[0] == "with":
            stack.append(("with", a, b))
        elif a[0] == op[0] and isinstance(a[1], list):
            a[1].extend(b[1] if b[0] == op[0] else [b])
            stack.append(a)
        else:
            stack.append((op[0], [a, *(b[1] if b[0] == op[0] else [b])]))
    return stack[0]


def evaluate(postfix: list[tuple[str, ...]]) -> list[str]:
    """The licences that an expression names, each once in order; an exception joins its licence's name.

    Work and memory follow the expression's length, however many alternatives it has.
    """
    names: list[str] = []
    spans: list[int] = []  # where each operand's names begin; the last operand's are the last names
    for op in postfix:
        if op[0] == "id":
            spans.append(len(names))
            names.append(op[1])
            continue
        begin = spans.pop()
        if op[0] == "with":
            end = names[begin]
            del names[begin:]
            names[spans[-1] :] = [f"{n}-with-{end}" for n in names[spans[-1] :]]
    return list(dict.fromkeys(names))


def alternatives(tree: tuple) -> Iterator[frozenset[str]]:
    """The sets of licences that satisfy an expression (see tree_of), one after the other; there can be very many."""
    if tree[0] == "id":
        yield frozenset([tree[1]])
    elif tree[0] == "with":
        end = next(iter(next(alternatives(tree[2]))))
        for one in alternatives(tree[1]):
            yield frozenset(f"{n}-with-{end}" for n in one)
    elif tree[0] == "or":
        for part in tree[1]:
            yield from alternatives(part)
    else:
        made, so_far = [alternatives(tree[1][0])], [frozenset()]
        while made:
            one = next(made[-1], None)
            if one is None:
                made.pop()
                so_far.pop()
            elif len(made) == len(tree[1]):
                yield so_far[-1] | one
            else:
                so_far.append(so_far[-1] | one)
                made.append(alternatives(tree[1][len(made)]))


def label_of(licence: str) -> str | None:
    """The label of a licence that an expression names, or null for an identifier that isn't known."""
    bare = re.sub(r"(?:-only|-or-later|\+)$", "", licence.split("-with-")[0])
    return KNOWN.get(bare) or (licence if bare.startswith("licenseref-") else None)


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase, label in BASE.items():
        found.add_word(f" {phrase} ", (len(phrase.split()), phrase, label, 1.0, True))
    for phrase, (label, sure) in NOTICES.items():
        found.add_word(f" {phrase} ", (len(phrase.split()), phrase, label, sure, False))
    found.add_word(f" {TAG} ", (3, TAG, None, 0.0, False))
    found.make_automaton()
    return found


def scan(text: str | None) -> dict:
    """The text's findings: n_words, places (start word, words, label, base, certainty), expressions."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    line = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
    places, tagged, seen, upto = [], False, 0, 0
    for end, (n, phrase, label, sure, base) in automaton().iter(line):
        begin = end - len(phrase) - 1  # of the blank before it
        seen += line.count(" ", upto, begin + 1) if begin + 1 >= upto else -line.count(" ", begin + 1, upto)
        upto = begin + 1
        if label is None:
            tagged = True
        else:
            places.append((seen - 1, n, label, base, sure))
    expressions = []
    if tagged:
        for m in TAGGED.finditer(text):
            if postfix := parse_expression(m[1]):
                expressions.append(evaluate(postfix))
    return {"n_words": len(words), "places": places, "expressions": expressions}


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, expressions array<array<string>>, places array<struct<start:long,words:int,label:string,base:boolean>>, score double"


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id and the findings in each row's whole text: counts, places, labels (sorted, distinct), expressions, score.

    score is the certainty that the text is under some licence: 1 for a base phrase or a tag, else the highest of its
    notices, 0 without any. expressions: the licences that each tag names. Null and empty texts have no words and no
    findings; a text's work follows its length. Rows are independent of each other, so repeated rows repeat their result
    and an empty table gives none; other columns are ignored, whatever they are called.
    """
    src = docs.select("doc_id", "text")
    kinds = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("expressions", pa.list_(pa.list_(pa.string()))), ("places", pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int32()), ("label", pa.string()), ("base", pa.bool_())]))), ("score", pa.float64())])

    def run(batches):
        for batch in sliced(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                got = scan(text)
                base = [p for p in got["places"] if p[3]]
                named = {label for e in got["expressions"] for n in e if (label := label_of(n))}
                rows.append({
                    "n_words": got["n_words"],
                    "n_base": len(base),
                    "first_word": min((p[0] for p in base), default=None),
                    "last_word": max((p[0] for p in base), default=None),
                    "base_labels": sorted({p[2] for p in base}),
                    "labels": sorted({p[2] for p in got["places"]} | named),
                    "expressions": got["expressions"],
                    "places": [{"start": p[0], "words": p[1], "label": p[2], "base": p[3]} for p in sorted(got["places"])],
                    "score": max([1.0 * bool(got["expressions"]), *(p[4] for p in got["places"])]),
                })
            own = pa.RecordBatch.from_pylist(rows, schema=kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *own.columns], names=["doc_id", *kinds.names])

    return src.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FIELDS}").select(F.col("*"))
