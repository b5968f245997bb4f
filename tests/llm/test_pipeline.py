"""Every stage of the pipeline against plain Python, on rows with repeated and null doc_ids, and the whole pipeline."""

import random
import re

import pytest
from pyspark.sql import functions as F
from test_near_copies import sets
from test_text_operators import brute_runs, words

import corpus_pipeline

KIND = "doc_id long, text string, lang string, source string, n_chars int"
FIELDS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark, rows):
    return spark.createDataFrame([(d, t, lang, source, len(t or "")) for d, t, lang, source in rows], KIND)


def prose(rng, n=60):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def got(df):
    assert df.columns == FIELDS
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def odd_rows():
    """Unlike texts of one doc_id and of none, repeated rows, copies, near copies, nulls, empty texts."""
    rng = random.Random(21)
    base = [prose(rng, 120) for _ in range(6)]
    near = base[4].split()
    near[60] = "changed"
    rows = [(1, base[0]), (1, base[1]), (None, base[2]), (None, base[3]), (5, base[4]), (5, base[4]), (6, " ".join(near)), (7, base[0].upper()), (8, None), (9, ""), (None, None), (10, base[5]), (10, base[5] + " more")]
    return [(d, t, "en", f"s{k % 2}") for k, (d, t) in enumerate(rows)]


def test_near_dedup_stage_equals_brute_force(spark, odd_rows):
    rows = sorted({(d, t) for d, t, *_ in odd_rows}, key=lambda r: (r[0] is not None, r[0] or 0, str(r[1])))
    own, root = [sets(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(own):
        for j, b in enumerate(own[:i]):
            if root[i] != root[j] and (a == b or len(a & b) * 100 >= len(a | b) * 80):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    kept = got(corpus_pipeline.keep_one_of_each_group(spark, table(spark, odd_rows), ""))
    assert len(kept) == len(set(kept)) == len(set(root))
    groups = [root[rows.index(k)] for k in kept]
    assert sorted(groups) == sorted(set(root))
    for d, t in kept:  # the smallest doc_id of its group, a null one first
        members = [rows[m][0] for m in range(len(rows)) if root[m] == root[rows.index((d, t))]]
        assert d == (None if None in members else min(members))
    assert got(corpus_pipeline.keep_one_of_each_group(spark, table(spark, []), "")) == []


def test_unlike_texts_of_one_doc_id_stay(spark):
    rng = random.Random(3)
    rows = [(1, prose(rng), "en", "a"), (1, prose(rng), "en", "a"), (None, prose(rng), "en", "a"), (None, prose(rng), "en", "a")]
    assert len(got(corpus_pipeline.keep_one_of_each_group(spark, table(spark, rows), ""))) == 4


def test_line_dedup_stage_equals_brute_force(spark):
    rng = random.Random(4)
    pool = [prose(rng, rng.choice([1, 3, 60])) for _ in range(12)]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 8)))) for k in range(20)] + [(50, None), (51, "")]
    want = brute_runs(rows) | {50: None}
    done = corpus_pipeline.remove_repeated_chunks(spark, table(spark, [(d, t, "en", "s") for d, t in rows]), "")
    assert dict(got(done)) == want
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in done.collect())


def test_decontamination_stage_equals_brute_force(spark, tmp_path, odd_rows):
    texts = [t for _, t, *_ in odd_rows if t]
    item = " ".join(texts[0].split()[20:35])
    spark.createDataFrame([(1, item), (2, None), (3, "never seen words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    windows = [words(item)[k : k + 10] for k in range(6)]
    clean = lambda t: not any(words(t)[k : k + 10] == w for w in windows for k in range(len(words(t))))
    rows = [*odd_rows, (70, f"before {item} behind", "en", "s"), (71, item.replace(" ", ", "), "en", "s")]
    want = sorted(((d, t) for d, t, *_ in rows if clean(t)), key=str)
    assert got(corpus_pipeline.drop_contaminated(spark, table(spark, rows), str(tmp_path))) == want and len(want) < len(rows) - 2


def test_language_stage(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select(*FIELDS)
    odd = [(1001, None, "en", "s"), (1002, "12 %%", "en", "s"), (1003, "слова другого языка, которого здесь никто не учил " * 3, None, "s"), (1003, "日本語のテキストです" * 12, None, "s"), (1004, "ok", None, "s"), (1005, "日本", None, "s")]
    kept = {d for d, _ in got(corpus_pipeline.identify_language(spark, docs.unionByName(table(spark, odd)), ""))}
    assert kept == {r.doc_id for r in docs.collect() if re.search(r"[^\W\d_]", r.text or "")} | {1004, 1005}
    unlabelled = docs.unionByName(table(spark, odd)).withColumn("lang", F.lit(None).cast("string"))
    assert {d for d, _ in got(corpus_pipeline.identify_language(spark, unlabelled, ""))} == kept | {1003}


def test_whole_pipeline(spark, small_dir):
    pieces = corpus_pipeline.run(spark, small_dir).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    held = {p.doc_id for p in pieces}
    assert held <= set(docs) and len(held) > 0.7 * len(docs)
    by_sequence = {}
    for p in pieces:
        by_sequence[p.sequence_id] = by_sequence.get(p.sequence_id, 0) + p.length
    assert all(n == 1024 for s, n in by_sequence.items() if s != max(by_sequence))
    assert {p.source for p in pieces} == {docs[d].source for d in held}
