"""Secret scans: candidate strings, and a random forest that removes false positives.

Candidates are long unbroken strings with a digit, and values assigned to a name that speaks of secrets, whatever they
look like. The forest looks at the candidate's length, its character transitions, how much of it dictionary words cover,
its document's path and the words next to it. It is trained from labelled findings (train, train_table); where a corpus has
none, from findings written by rule (labelled_findings). The dictionary is given, or learned from the corpus.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import sliced

CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-=]{16,}")
#: A name that speaks of secrets and goes on for 40 characters at most, a sign, and the value: up to its quote, or unquoted up to a blank.
ASSIGNED = re.compile(r"(?i)(?:passw(?:or)?d|passphrase|pwd|secret|token|credential|auth|(?:api|access|private)[_\- ]?key)[\w.\-]{0,40}[\"']?\s{0,3}[:=]\s{0,3}(?:\"([^\"\r\n]{4,})\"|'([^'\r\n]{4,})'|([^\s\"',;]{6,}))")
NEAR = 40
WORD = re.compile(r"[A-Za-z]{3,}")
#: Words that stand next to secrets, and next to strings that only look like them.
HOT = frozenset("token secret password passwd key apikey auth bearer credential credentials private access sk akia ghp aws".split())
COLD = frozenset("sha md5 checksum digest commit hash uuid guid example sample dummy placeholder test fixture build revision etag version id ref".split())
PATH_COLD = frozenset("test tests docs doc example examples fixtures sample samples".split())
#: Words counted as covered; the more of a candidate they cover, the less it is random.
DICTIONARY = frozenset("the and for with from this that have your name value data file user test example sample type list index page text code config default string number object return function class public static import export module version release build branch master main local remote server client request response header content length application json html http https www com org net example placeholder changeme insert here replace secret token key password dummy foo bar baz abc xyz".split())
FEATURES = ("length", "entropy", "class_changes", "digit_share", "upper_share", "hex_only", "common_pairs", "vowel_runs", "covered", "path_cold", "hot_words", "cold_words", "assigned", "distinct_share", "mark_share", "placeholder", "bare_word")
#: Values that stand for a secret or name its place.
PLACEHOLDER = re.compile(r"(?i)^[<$%{(\[]|[>)}\]]$|^[*x.]+$|changeme|example|placeholder|your|none|null|true|false|required|optional|environ|string|here")
#: Letter pairs that are common in words of many languages.
PAIRS = frozenset("th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ei ie ge un el la ue ai de qu".split())


def kind_of(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def covered_share(text: str, words: frozenset[str] = DICTIONARY) -> float:
    """Share of the characters that dictionary words cover, the longest word first at each place."""
    low, at, n, longest = text.lower(), 0, 0, max(map(len, words), default=0)
    while at < len(low):
        for size in range(min(longest, len(low) - at), 2, -1):
            if low[at : at + size] in words:
                n, at = n + size, at + size - 1
                break
        at += 1
    return n / max(1, len(low))


def features(candidate: str, before: str, after: str, path: str, words: frozenset[str] = DICTIONARY) -> list[float]:
    n = len(candidate)
    kinds = [kind_of(c) for c in candidate]
    counts = {c: candidate.count(c) for c in set(candidate)}
    low = candidate.lower()
    near = {w.lower() for w in WORD.findall(before + " " + after)}
    return [
        float(n),
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1),
        kinds.count(0) / n,
        kinds.count(2) / n,
        float(all(c in "0123456789abcdef" for c in low)),
        sum(low[i : i + 2] in PAIRS for i in range(n - 1)) / max(1, n - 1),
        sum(c in "aeiou" for c in low) / n,
        covered_share(candidate, words),
        float(bool(PATH_COLD & {w.lower() for w in WORD.findall(path)})),
        float(len(near & HOT)),
        float(len(near & COLD)),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))),
        len(counts) / n,
        kinds.count(3) / n,
        float(bool(PLACEHOLDER.search(candidate))),
        float(candidate.isalpha() and candidate == candidate.lower()),
    ]


def labelled_findings(n: int, seed: int = 6) -> list[tuple[str, str, str, str, int]]:
    """(candidate, before, after, path, 1 for a secret) written by rule: keys in the usual forms, and what is taken for them."""
    rng = random.Random(seed)
    chars = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    hexa, base = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    word = lambda k=4: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, k)))
    prose = lambda: " ".join(word() for _ in range(5))
    out = []
    for k in range(n):
        if k % 4 >= 2 and k % 3:  # values of assignments, in any form
            name = rng.choice(["password", "passwd", "db_password", "pwd", "secret", "token", "auth_token", "api_key"])
            quote, sign = rng.choice(["\"", "'", ""]), rng.choice([" = ", ": ", "="])
            if k % 2:
                body = [word(5).title() + str(rng.randrange(10, 2100)) + rng.choice("!?#$"), word(4) + chars("0123456789", 2) + rng.choice("!#x"), chars(base + "!#$%&*", rng.randrange(8, 24)), "-".join(word(4) for _ in range(4)), chars("0123456789", rng.randrange(8, 14)), chars(hexa, 24)][rng.randrange(6)]
            else:
                body = rng.choice(["changeme", "required", "None", "null", "true", "string", "<password>", "${" + name.upper() + "}", "your_" + name + "_here", "os.environ", "example", "xxxxxxxx", "********", "placeholder", "{" + name + "}", word(3) + word(3)])
            out.append((body, f"{prose()} {name}{sign}{quote}", f"{quote} {prose()}", rng.choice(["src", "config", "web", "docs"]), k % 2))
            continue
        pick, path = rng.randrange(6), rng.choice(["src/app", "web/crawl", "src3", "config/prod", "tests/fixtures", "docs/example"])
        if k % 2:
            name = rng.choice(["token", "secret", "password", "api_key", "access key", "auth", "private key"])
            body = [chars(hexa, rng.choice([32, 40, 64])), "AKIA" + chars(base[:26] + base[52:], 16), "ghp_" + chars(base, 36), "sk-" + chars(base, rng.choice([24, 48])), chars(base + "+/", 40), "key-" + chars(hexa, 32)][pick]
            before = rng.choice([f"{prose()} {name} = \"", f"{name}: ", f"{prose()} {name}=", f"{prose()} "]) if pick else f"{prose()} {name} = \""
            out.append((body, before, rng.choice(["\" ", " ", "\n"]) + prose(), rng.choice(path.split("/")) if rng.random() < 0.8 else path, 1))
        else:
            name = rng.choice(["sha", "commit", "checksum", "uuid", "example", "md5", "etag", "revision"])
            body = [chars(hexa, rng.choice([32, 40, 64])), "-".join(chars(hexa, j) for j in (8, 4, 4, 4, 12)), "".join(word() for _ in range(8)) + str(rng.randrange(100)), rng.choice(["your", "example", "sample"]) + "_" + rng.choice(["token", "secret", "key"]) + "_" + rng.choice(["here", "placeholder", "value"]) + str(rng.randrange(10)), "-".join([word(), word(), word(), str(rng.randrange(2000, 2030)), word()]) + "-" + word(), chars("0123456789", rng.randrange(16, 24))][pick]
            out.append((body, rng.choice([f"{prose()} {name} ", f"{name}: ", f"{prose()} {name}="]) if pick in (0, 1) else f"{prose()} ", " " + prose(), path, 0))
    return out


class Forest:
    """Trees of axis splits by Gini impurity, on bootstrap rows and random features at each split."""

    def __init__(self, trees: int = 20, depth: int = 8, leaf: int = 4, seed: int = 6, words: frozenset[str] = DICTIONARY):
        self.trees, self.depth, self.leaf, self.rng, self.made, self.words = trees, depth, leaf, np.random.default_rng(seed), [], words

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        for _ in range(self.trees):
            rows = self.rng.integers(0, len(x), len(x))
            nodes: list[tuple] = []
            self.grow(x[rows], y[rows], 0, nodes)
            self.made.append(tuple(np.array(v) for v in zip(*nodes)))
        return self

    def grow(self, x: np.ndarray, y: np.ndarray, depth: int, nodes: list) -> int:
        at, p = len(nodes), float(y.mean())
        nodes.append((-1, 0.0, 0, 0, p))
        if depth == self.depth or p in (0.0, 1.0) or len(y) < 2 * self.leaf:
            return at
        best = (2 * p * (1 - p) * len(y) - 1e-9, None, None)
        for f in self.rng.choice(x.shape[1], size=max(1, int(x.shape[1] ** 0.5) + 1), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(v))
            a, b = ones[:-1], ones[-1] - ones[:-1]
            cost = 2 * a * (n - a) / n + 2 * b * (len(v) - n - b) / (len(v) - n)
            cost[(v[1:] == v[:-1]) | (n < self.leaf) | (len(v) - n < self.leaf)] = np.inf
            k = int(np.argmin(cost))
            if cost[k] < best[0]:
                best = (cost[k], f, (v[k] + v[k + 1]) / 2)
        if best[1] is None:
            return at
        left = x[:, best[1]] <= best[2]
        nodes[at] = (int(best[1]), float(best[2]), self.grow(x[left], y[left], depth + 1, nodes), self.grow(x[~left], y[~left], depth + 1, nodes), p)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, p in self.made:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                inner = feature[at] >= 0
                go = np.where(x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at], left[at], right[at])
                at = np.where(inner, go, at)
            total += p[at]
        return total / max(1, len(self.made))


def learned_words(docs: DataFrame, most_words: int = 2_000) -> frozenset[str]:
    """The most_words words of three ASCII letters or more that stand in most documents; of equal ones the first by letters."""
    low = F.lower(F.coalesce("text", F.lit("")))
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(r"([a-z]{3,})"), F.lit(1)))).alias("word"))
    return frozenset(r.word for r in words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most_words).collect())


def train(findings: list[tuple[str, str, str, str, int]], words: frozenset[str] = DICTIONARY) -> Forest:
    """From labelled findings (candidate, before, after, path, label); the caller bounds how many there are."""
    x = np.array([features(*f[:4], words) for f in findings])
    return Forest(words=words).fit(x, np.array([f[4] for f in findings], dtype=float))


def train_table(findings: DataFrame, most_rows: int = 20_000, words: frozenset[str] = DICTIONARY) -> Forest:
    """From a table of labelled findings (candidate, before, after, path, label 0 or 1), about most_rows of them at most.

    They are drawn by a hash of the finding; rows with a null or empty candidate or a null label are left out, other nulls
    count as empty. A table without any is an error.
    """
    rows = findings.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("candidate", "before", "after", "path")), F.col("label").cast("int").alias("label")).where("candidate != '' and label is not null")
    n = rows.count()
    if n > most_rows:
        rows = rows.where(F.xxhash64(*rows.columns).bitwiseAND(F.lit((1 << 63) - 1)) < F.lit((1 << 63) * most_rows // n))
    found = sorted(map(tuple, rows.collect()))
    if not found:
        raise ValueError("no labelled findings")
    return train(found, words)


@lru_cache(maxsize=2)
def default_forest(findings: int = 3000) -> Forest:
    """Trained from so many findings written by rule."""
    return train(labelled_findings(findings))


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans in order, none in another: assigned values, and unbroken strings with a digit that don't meet one of those."""
    spans = [m.span(m.lastindex) for m in ASSIGNED.finditer(text)]
    free, at = [], 0
    for m in CANDIDATE.finditer(text):
        while at < len(spans) and spans[at][1] <= m.start():
            at += 1
        if (at == len(spans) or spans[at][0] >= m.end()) and any(c.isdigit() for c in m[0]):
            free.append(m.span())
    return sorted(spans + free)


def secret_scan(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5, path: str = "source") -> DataFrame:
    """doc_id, n_candidates and findings (start, stop in characters, score), in order, of each row's whole text.

    Null and empty texts have none; a null path counts as empty, as does a path column that docs lacks. Rows are
    independent: repeated rows repeat their result, an empty table gives none, other columns are ignored. A long text's
    work follows its length.
    """
    own = forest or default_forest()

    def run(batches):
        for batch in sliced(batches):
            spans, facts, owner = [], [], []
            for k, (text, where) in enumerate(zip(batch.column("text").to_pylist(), batch.column("path").to_pylist())):
                for a, b in candidates(text or ""):
                    spans.append((a, b))
                    owner.append(k)
                    facts.append(features(text[a:b], text[max(0, a - NEAR) : a], text[b : b + NEAR], where or "", own.words))
            scores = own.predict(np.array(facts)) if facts else []
            found: list[list] = [[] for _ in range(batch.num_rows)]
            for k, (a, b), s in zip(owner, spans, scores):
                if s >= threshold:
                    found[k].append({"start": a, "stop": b, "score": float(s)})
            n = np.bincount(np.array(owner, dtype=np.int64), minlength=batch.num_rows)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(found, kind)], names=["doc_id", "n_candidates", "findings"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", (F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")).alias("path")).mapInArrow(run, f"doc_id {kind}, n_candidates long, findings array<struct<start:long,stop:long,score:double>>")
