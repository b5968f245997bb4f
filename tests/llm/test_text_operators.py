"""Decontamination, line chunks, secrets, licences, languages and media against brute force, round trips and held-out rows."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import md5, sha256
from pathlib import Path

import duckdb
import numpy as np
import pytest

from folioforge.llm import decontamination, language_id, licenses, line_chunks, progressive_jpeg, queries, secret_forest


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def same_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.queries()[name](spark, sf_dir)
    want = con.sql(queries.oracle_sql()[name]).fetchall()
    names = [c[0] for c in con.sql(queries.oracle_sql()[name]).description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", ["op7_decontamination", "op8_line_chunks"])
def test_equals_sql(spark, small_dir, name):
    same_as_sql(spark, small_dir, name)


def test_decontamination_by_shuffles(spark, small_dir, monkeypatch):
    """The query with nothing broadcast; no exchange carries an array of words."""
    monkeypatch.setattr(decontamination.contamination, "__defaults__", (10, 2, 0))
    same_as_sql(spark, small_dir, "op7_decontamination")


def test_decontamination_edges(spark):
    item = "a b c d e f g h i j k l"
    docs = [(1, None, 0), (2, "", 0), (3, "x " + item.upper() + " y", 0), (3, "x " + item.upper() + " y", 0), (4, "b c d e f g h i j k", 0), (5, "short ÉQ", 0), (5, "short éq", 0), (None, "a, b. c d e f g h i j " * 2, 0), (7, "a a a a", 0)]
    items = [(10, item), (2, "short ÉQ"), (3, "a a"), (4, "!!"), (5, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for doc, text, _ in docs:
        w, hit, found = words(text), set(), set()
        for i, t in items:
            iw = words(t)
            for win in [iw[k : k + 10] for k in range(max(1, len(iw) - 9))] if iw else []:
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        hit |= set(range(s, s + len(win)))
                        found.add(str(i))
        want.append((doc, len(w), len(hit), sorted(found)))
    for limit in (64 << 20, 0):  # with broadcast tables, and with shuffles alone
        got = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontamination.contamination(d, b, broadcast_bytes=limit).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert decontamination.contamination(d.limit(0), b).count() == 0
    assert all(r.n_hit == 0 for r in decontamination.contamination(d, b.limit(0)).collect())
    near = decontamination.proximity_matches(d.where("doc_id = 4"), ["c", "k"], 9).collect()
    assert [(r["first"], r["last"]) for r in near] == [(1, 9)]


def brute_lines(rows, divisor=2, long_words=50):
    h = lambda s: int(md5(s.encode()).hexdigest()[:8], 16)
    n = lambda s: len([w for w in re.split(r"[\x20\x09-\x0D]+", s) if w])
    chunks, seen, out = {}, set(), {}
    for doc, text in sorted(r for r in rows if r[1] is not None):
        own, now, last = [], [], 0
        lines = text.split("\n")
        for i, line in enumerate(lines):
            now.append(line)
            if i == len(lines) - 1 or n(line) >= long_words or n(lines[i + 1]) >= long_words or (last * 31 + h(line)) % divisor == 0:
                own.append(now)
                now = []
            last = h(line)
        chunks[doc] = own
    for doc, own in chunks.items():
        kept = []
        for c in own:
            passage = len(c) > 1 or n(c[0]) >= long_words
            if not passage or "\n".join(c) not in seen:
                kept += c
            if passage:
                seen.add("\n".join(c))
        out[doc] = "\n".join(kept)
    return out


def test_line_chunks_edges(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 2, 5, 60]))) for _ in range(30)]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12)))) for k in range(40)] + [(90, ""), (91, "\n\n"), (92, None)]
    table = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n_removed string")
    got = line_chunks.dedup_lines(table)
    assert got.columns == ["doc_id", "text", "n_removed", "text_before", "n_lines", "removed_lines"]
    want = brute_lines(rows)
    assert {r.doc_id: r.text for r in got.collect()} == want | {92: None}
    passage = "w " * 51 + "end"
    twice = spark.createDataFrame([(1, f"a\n{passage}\nb"), (2, f"c d\n{passage}\nlast"), (3, f"c d\n{passage}\nlast"), (3, f"c d\n{passage}\nlast")], "doc_id long, text string")
    kept = [r.text for r in line_chunks.dedup_lines(twice).orderBy("doc_id").collect()]
    assert passage in kept[0] and all(passage not in t for t in kept[1:]) and kept[2] == kept[3]
    assert line_chunks.dedup_lines(table.limit(0)).count() == 0


def brute_runs(rows, long_words=50):
    """Every maximal run of lines that starts at an earlier place too, by comparison with all earlier places."""
    texts = [(d, t.split("\n")) for d, t in sorted(r for r in rows if r[1] is not None)]
    out = {}
    for at, (doc, own) in enumerate(texts):
        gone = set()
        for i in range(len(own)):
            best = 0
            for other, (_, lines) in enumerate(texts[: at + 1]):
                for j in range(len(lines) if other < at else i):
                    n = 0
                    while i + n < len(own) and j + n < len(lines) and own[i + n] == lines[j + n]:
                        n += 1
                    best = max(best, n)
            if best >= 2 or best and len([w for w in re.split(r"[\x20\x09-\x0D]+", own[i]) if w]) >= long_words:
                gone |= set(range(i, i + best))
        out[doc] = "\n".join(line for k, line in enumerate(own) if k not in gone)
    return out


def test_line_runs_equal_brute_force(spark):
    rng = random.Random(4)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 2, 5, 60]))) for _ in range(25)]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 10)))) for k in range(30)] + [(90, ""), (91, "\n\n\n"), (92, None)]
    table = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n_lines string")
    got = line_chunks.dedup_runs(table)
    assert got.columns == ["doc_id", "text", "n_lines", "text_before", "removed_lines"]
    assert {r.doc_id: r.text for r in got.collect()} == brute_runs(rows) | {92: None}
    assert line_chunks.dedup_runs(table.limit(0)).count() == 0


def test_pipeline_removes_planted_passages_of_several_lines(spark):
    """Passages of 60 words or more in lines under 50 words, between lines that no other document has."""
    import corpus_pipeline

    rng = random.Random(5)
    line = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n))
    passages = ["\n".join(line(n) for _ in range(m)) for m, n in ((2, 30), (3, 20), (5, 12), (20, 12))]
    own = [(line(8), line(9)) for _ in range(40)]
    rows = [(k, f"{a}\n{passages[k % 4]}\n{b}") for k, (a, b) in enumerate(own)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.remove_repeated_chunks(spark, docs, "").collect()}
    for (d, text), (a, b) in zip(rows, own):
        want = text if d < 4 else f"{a}\n{b}"
        assert got[d] == (want, len(want))


def brute_base(text):
    w, found = words(text), []
    for phrase, label in {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), len(found), min((f[0] for f in found), default=None), max((f[0] for f in found), default=None), sorted({f[1] for f in found})


def test_licenses(spark, small_dir):
    texts = ["Under the MIT  License, cc-by-nc CC BY NC cc by nc", "under the mit licenses", None, "", "É apache LICENSE, Version 2 under the mit license apache license version 2.0"]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()] + list(enumerate(texts, 1000))
    got = licenses.license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    for (d, text), r in zip(sorted(docs), sorted(got)):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(text), d
        assert set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1
    tag = licenses.scan("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */")
    assert tag["expressions"] == [["mit", "apache-2.0", "gpl-2.0-only-with-classpath-exception-2.0"]]
    assert licenses.parse_expression("OR MIT") is None and licenses.parse_expression("(MIT") is None
    assert list(licenses.alternatives(licenses.tree_of(licenses.parse_expression("a or b and c")))) == [frozenset("a"), frozenset("bc")]
    rows = spark.createDataFrame([(1, "SPDX-License-Identifier: Apache-2.0\nsee the Apache License, Version 2.0", "x"), (1, "SPDX-License-Identifier: Apache-2.0\nsee the Apache License, Version 2.0", "x"), (2, "spdx-license-identifier: Foo-1 OR LicenseRef-own OR (MIT", "y")], "doc_id long, text string, labels string")
    got = sorted((r.doc_id, r.labels, r.expressions, r.score) for r in licenses.license_scan(rows).collect())
    assert got == [(1, ["apache-2"], [["apache-2.0"]], 1.0)] * 2 + [(2, ["licenseref-own"], [["foo-1", "licenseref-own"]], 1.0)]
    assert licenses.license_scan(rows.limit(0)).count() == 0


def every_alternative(tree):
    if tree[0] == "id":
        return [frozenset([tree[1]])]
    if tree[0] == "with":
        return [frozenset(f"{n}-with-{tree[2][1]}" for n in one) for one in every_alternative(tree[1])]
    parts = [every_alternative(p) for p in tree[1]]
    return sum(parts, []) if tree[0] == "or" else [frozenset().union(*chosen) for chosen in itertools.product(*parts)]


def test_licence_expressions():
    """Random expressions against their recursive meaning; long ones in time of their length."""
    rng = random.Random(7)

    def expression(depth):
        if not depth or rng.random() < 0.3:
            return rng.choice(["MIT", "Apache-2.0", "GPL-2.0-only WITH Classpath-exception-2.0", "X-1"])
        return rng.choice(["({} AND {})", "({} OR {})"]).format(expression(depth - 1), expression(depth - 1))

    for _ in range(60):
        found = licenses.parse_expression(expression(4))
        tree = licenses.tree_of(found)
        assert list(licenses.alternatives(tree)) == every_alternative(tree)
        assert set(licenses.evaluate(found)) == frozenset().union(*every_alternative(tree))
    many = licenses.parse_expression(" AND ".join(f"(a{k} OR b{k})" for k in range(30000)))
    assert len(licenses.evaluate(many)) == 60000


def plain_grams(text):
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    line = " " + " ".join(low.split()) + " "
    return Counter(line[i : i + 3] for i in range(len(line) - 2)) if line.strip() else {}


def plain_gram(gram):
    """Product of the letters' vectors, each turned by its place."""
    out = np.ones(language_id.DIM)
    for place, c in enumerate(gram):
        bits = language_id.letter_bits(np.array([0 if c == " " else ord(c)]), 20)[0]
        out *= np.roll(1 - 2.0 * bits, place)
    return out


def test_language_id_samples_each_language(spark):
    """Rare languages are learned whole, frequent ones from about most_rows rows; letters of any script tell them apart."""
    rows = [(k, "the and of that with this", "en") for k in range(3000)] + [(5000 + k, "สวัสดีชาวโลก ภาษาไทย", "th") for k in range(3)] + [(6000, "안녕하세요 세계 한국어", "ko"), (6001, None, "xx"), (6002, "free", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(table, most_rows=50)
    assert model.langs == ["en", "ko", "th"]
    assert [model.predict(t)[0] for t in ("and this", "ภาษาไทยโลก", "한국어 세계")] == ["en", "th", "ko"]
    assert len({language_id.letter_bits(np.array([c]), 20).tobytes() for c in range(0xAC00, 0xAC00 + 5000)}) == 5000
    with pytest.raises(RuntimeError, match="none was drawn"):
        language_id.train(table.where("lang = 'en'"), most_rows=0)
    long = spark.createDataFrame([("ภาษา ไทย " * 200_000,)], "text string")
    assert [r.lang_pred for r in language_id.predicted(long, model, keep=()).collect()] == ["th"]


def test_language_id(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    got = {r.doc_id: r for r in queries.op10_language_id(spark, small_dir).collect()}
    rows = docs.collect()
    out = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert {d for d, r in got.items() if r.held_out} == {r.doc_id for r in out}
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in out]) > 0.95
    # the query's rows are those of a plain computation over the same sample, which is whole here
    rest = [r for r in rows if r not in out and r.text is not None and r.lang is not None]
    vector = lambda text: sum((k * plain_gram(g) for g, k in plain_grams(text).items()), np.zeros(language_id.DIM))
    langs = sorted({r.lang for r in rest})
    sums = {lang: sum((vector(r.text) for r in rest if r.lang == lang), np.zeros(language_id.DIM)) for lang in langs}
    for r in rows[::7]:
        own = vector(r.text or "")
        cosines = [float(own @ sums[lang] / np.sqrt((own @ own) * (sums[lang] @ sums[lang]))) for lang in langs]
        assert got[r.doc_id].lang_pred == langs[int(np.argmax(cosines))] and abs(got[r.doc_id].score - max(0.0, *cosines)) < 1e-9
    model = language_id.train(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "日本"), (4, "日本")], "score long, text string")
    assert [r.lang_pred == "und" for r in language_id.predicted(odd, model, keep=()).collect()] == [True, True, True, False, False]
    empty = language_id.train(docs.limit(0))
    assert [r.lang_pred for r in language_id.predicted(docs.limit(1), empty).collect()] == ["und"]


def test_secrets(spark):
    values = ['password = "Summer2024!" ', "db_password: 'hunter2!x' ", 'secret = "correct-horse-battery-staple"', 'pwd="pA9!kd#02lq$Zx81mn"', "token: 1234567890 "]
    assert [[t[a:b] for a, b in secret_forest.candidates(t)] for t in values] == [["Summer2024!"], ["hunter2!x"], ["correct-horse-battery-staple"], ["pA9!kd#02lq$Zx81mn"], ["1234567890"]]
    kept = secret_forest.secret_scan(spark.createDataFrame([(k, t) for k, t in enumerate([*values, "password: required", 'password = "changeme"', "token = ${TOKEN} "])], "doc_id int, text string"))
    assert {r.doc_id: len(r.findings) for r in kept.collect()} == {k: int(k < 5) for k in range(8)}
    found = secret_forest.labelled_findings(800, seed=77)  # not the ones the forest is trained from
    x = np.array([secret_forest.features(*f[:4]) for f in found])
    y = np.array([f[4] for f in found])
    assert ((secret_forest.default_forest().predict(x) >= 0.5) == y).mean() > 0.95
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    docs = spark.createDataFrame([(1, f'é thstorti token = "{key}" thhantou', None, 1), (2, None, "s", 1), (3, "", "s", 1), (4, "plain words alone", "s", 1), (5, "see uuid 123e4567-e89b-12d3-a456-426614174000 there", "docs", 1)], "doc_id long, text string, source string, findings int")
    got = {r.doc_id: r for r in secret_forest.secret_scan(docs).collect()}
    assert [(f.start, f.stop) for f in got[1].findings] == [(20, 20 + len(key))]
    assert [len(got[k].findings) for k in (2, 3, 4, 5)] == [0, 0, 0, 0] and got[5].n_candidates == 1


def test_secret_query(spark, small_dir):
    """The query against one text after the other; every planted key is found, and little else."""
    folder = str(Path(small_dir).with_name("sf0.01"))  # the smallest folder has no planted keys
    forest, rows = secret_forest.default_forest(), spark.read.parquet(f"{folder}/documents.parquet").collect()
    got, planted, found = {r.doc_id: r for r in queries.op6_secret_forest(spark, folder).collect()}, 0, 0
    for r in rows:
        spans = secret_forest.candidates(r.text or "")
        scores = [float(forest.predict(np.array([secret_forest.features(r.text[a:b], r.text[max(0, a - 40) : a], r.text[b : b + 40], r.source or "")]))[0]) for a, b in spans]
        kept = [(a, b) for (a, b), s in zip(spans, scores) if s >= 0.5]
        assert (got[r.doc_id].n_candidates, got[r.doc_id].spans) == (len(spans), ",".join(f"{a}-{b}" for a, b in kept))
        keys = {m.span(1) for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', r.text or "")}
        assert keys <= set(kept)
        planted, found = planted + len(keys), found + len(kept)
    assert planted > 0 and found <= planted * 1.1 + 1


def test_secret_findings_and_words_from_tables(spark):
    known = [(*f[:4], f[4]) for f in secret_forest.labelled_findings(300)] + [(None, "", "", "", 1), ("x", None, None, None, None)]
    table = spark.createDataFrame(known, "candidate string, before string, after string, path string, label int")
    forest = secret_forest.train_table(table)
    x = np.array([secret_forest.features(*f[:4]) for f in known[:300]])
    assert ((forest.predict(x) >= 0.5) == np.array([f[4] for f in known[:300]])).mean() > 0.95
    assert len(secret_forest.train_table(table, most_rows=60).made) == 20
    with pytest.raises(ValueError, match="no labelled"):
        secret_forest.train_table(table.limit(0))
    docs = spark.createDataFrame([("one two two three",), ("two three",), (None,)], "text string")
    assert secret_forest.learned_words(docs, 2) == {"two", "three"}


def slow_decode(media):
    """The same file without the scans read as arrays."""
    held, progressive_jpeg.scan_array = progressive_jpeg.scan_array, lambda *a: False
    try:
        return progressive_jpeg.decode(media)
    finally:
        progressive_jpeg.scan_array = held


def test_media_of_a_long_text():
    payload = np.random.default_rng(4).integers(0, 256, 64 * (6 * 32767 + 60), dtype=np.uint8).tobytes()
    assert progressive_jpeg.payload_of(progressive_jpeg.decode(progressive_jpeg.encode(payload))) == payload


@pytest.mark.parametrize("n", [1, 2, 5, 6, 7, 40])
def test_media_round_trip(n):
    payload = bytes(random.Random(n).randrange(256) for _ in range(64 * n))
    media = progressive_jpeg.encode(payload)
    fast, slow = progressive_jpeg.decode(media), slow_decode(media)
    for c in fast["components"]:
        assert (fast["components"][c]["blocks"] == slow["components"][c]["blocks"]).all()
    assert progressive_jpeg.payload_of(fast) == payload
    assert progressive_jpeg.rgb(fast).shape == (fast["height"], fast["width"], 3)


def test_media_inverse_transform():
    """One block against the transform's definition."""
    rng = np.random.default_rng(1)
    coef = rng.integers(-200, 200, 64)
    natural = np.zeros((8, 8))
    natural.ravel()[progressive_jpeg.ZIGZAG] = coef
    c = [np.sqrt(0.5)] + [1] * 7
    want = [[sum(c[u] * c[v] / 4 * natural[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) for x in range(8)] for y in range(8)]
    assert np.allclose((coef.astype(np.float32) @ progressive_jpeg.INVERSE).reshape(8, 8), want, atol=0.01)
    assert progressive_jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]


def test_media_query(spark, small_dir):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    feature = defaultdict(set)
    for r in queries.op5_progressive_jpeg(spark, small_dir).collect():
        raw = docs[r.doc_id]
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        feature[raw].add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in feature.values())
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (2, "", 1)], "doc_id long, text string, media int")
    assert {len(r.payload) for r in progressive_jpeg.tensor_column(progressive_jpeg.media_column(odd)).collect()} == {64}
