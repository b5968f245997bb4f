"""Token counts, token files and packing against the library, on sf0.001 and on edge cases."""

import glob
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioforge.llm import packing, prefix_counts, queries, token_store
from folioforge.llm.common import new_path
from folioforge.llm.pieces import PieceEncoder

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
EDGES = ["", "   ", "don't we'll  'sun\n\n's \n 're''re 12x34 !!!!", "<|endoftext|> abc <|endoftext|><|endof", "日本語 テキスト émoji 😀 x", "İ \x1c\x85 ss İ'LL", "Ⱥ ǅ ²½ \xa0 x", "a" * 400 + " " * 90, "<|startoftext|>It's", " a  b \n c\n d\n \n e  \nf \n\n g\t h ", "a \n  b   c", "x\xa0 y \xa0z ", "\n \x85\x1c😀b" * 300, "\x1c\x1d \x1e\u2003a\u3000 \u0558 \u1c89\U00010d40 x"]


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, t, f"s{i % 2}", 1) for i, t in enumerate(EDGES)] + [(50, None, None, 1), (7, EDGES[7], "s1", 1), (None, "x y", "s0", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_equal_library(spark, small_dir, path):
    encode = PieceEncoder(path)
    texts = EDGES + [r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    ids, at = encode(pa.array(texts), b"\7\0\0\0")
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == [*encode.library(t), 7], t[:80]
    assert encode(pa.array([], pa.string()))[1].tolist() == [0]
    assert encode(pa.array(["", "日"]).slice(0, 1), b"\7\0\0\0")[1].tolist() == [0, 1]


PARTS = ["a", "b", "é", "Ɓ", "ß", "1", "2", "²", "¼", "!", "'", "'s", "'re", "'ll", "'L", "'RE", " ", "\n", "\t", "\xa0", ".", "Ÿ", "ǅ", "ª", "\xad", "日", "İ"]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cuts_equal_library_on_random_texts(path):
    encode, rnd = PieceEncoder(path), random.Random(4)
    for upto in (25, len(PARTS)):
        texts = ["".join(rnd.choices(PARTS[:upto], k=rnd.randrange(20))) for _ in range(2000)]
        ids, at = encode(pa.array(["z", *texts]).slice(1))
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == encode.library(t), repr(t)


def test_every_prefix_has_the_library_count():
    count, library = prefix_counts.PrefixCounter(BYTE), Tokenizer.from_file(BYTE)
    for t in EDGES:
        assert count.table(t).tolist() == [len(library.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)], t


def test_every_prefix_of_random_texts():
    count, library, rnd = prefix_counts.PrefixCounter(BYTE), Tokenizer.from_file(BYTE), random.Random(6)
    parts = [*PARTS, "  ", "\r", "\x0b", "\x1c", "\x1f", "\x85", "\u2003", "\u3000", "😀", "<|endoftext|>", "<|endof", "\u0558", "\u1c89", "\U00010d40", "\u0300", "\u200b", "\x00"]
    for _ in range(600):
        t = "".join(rnd.choices(parts, k=rnd.randrange(14)))
        assert count.table(t).tolist() == [len(library.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)], repr(t)
    steps = np.array([0, 200, -3], dtype="<i4")
    assert prefix_counts.unpacked(prefix_counts.packed(steps)).tolist() == [0, 200, -3]


def test_prefix_query(spark, small_dir):
    library, docs = Tokenizer.from_file(BYTE), spark.read.parquet(f"{small_dir}/documents.parquet").collect()
    want = {(r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in docs}
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op2_prefix_counts(spark, small_dir).collect()} == want


def test_prefix_table(spark, edges):
    library = Tokenizer.from_file(BYTE)
    for r in prefix_counts.prefix_table(edges, BYTE, budget=5).collect():
        text = (EDGES + [None] * 50)[r.doc_id or 0] if r.doc_id is not None else "x y"
        text = text or ""
        counts = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert (r.n_tokens, r.n_bytes) == (counts[-1], len(text.encode()))
        assert r.fits_chars == max(k for k, c in enumerate(counts) if c <= 5)
    asked = prefix_counts.prefix_table(edges.where("doc_id = 2"), BYTE, budget=5).select(prefix_counts.tokens_of_prefix(F.col("prefix_steps"), 9).alias("n")).first().n
    assert asked == len(library.encode(EDGES[2][:9], add_special_tokens=False).ids)
    assert prefix_counts.prefix_table(edges.limit(0), BYTE, budget=5).count() == 0


def brute_store(rows, end):
    library, at, out = Tokenizer.from_file(WORD), 0, []
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def test_token_store(spark, small_dir, edges):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    got = [tuple(r) for r in queries.op3_token_store(spark, small_dir).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("doc_id").collect()]
    assert got == brute_store(sorted((r.doc_id, r.text) for r in docs.collect()), 1)
    path = new_path(spark, "edge")
    token_store.write_tokens(edges, path, WORD)
    read = token_store.read_tokens(spark, path)
    rows = sorted(read.collect(), key=lambda r: r.start)
    assert [r.key for r in rows] == [None, 0, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9, 10, 11, 12, 13, 50]
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    assert all(r.ids[-1] == 1 and len(r.ids) == r.n_tokens for r in rows)
    token_store.write_tokens(edges.limit(0), path + "e", WORD)
    assert token_store.crc32_of_ids(token_store.read_tokens(spark, path + "e")).count() == 0


def test_token_files(spark, small_dir):
    """Encodings, row groups and page index as the footers have them, and a read of the counts alone."""
    path = new_path(spark, "layout")
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    token_store.write_tokens(docs, path, WORD)
    files = sorted(glob.glob(f"{path.removeprefix('file:')}/*.parquet"))
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert {"DELTA_BINARY_PACKED", "RLE_DICTIONARY"} & set(columns["key"].encodings) and columns["ids.list.element"].compression == "ZSTD"
            assert {"DELTA_BINARY_PACKED", "RLE_DICTIONARY"} & set(columns["ids.list.element"].encodings)
            assert all(c.has_offset_index and c.has_column_index for c in (columns["key"], columns["n_tokens"]))
            assert meta.row_group(g).total_byte_size < 40 << 20
    plan = spark.read.parquet(path).where("key = 7").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1] and "EqualTo(key,7)" in plan


def check_pieces(docs, pieces, seq_len, padding):
    library = Tokenizer.from_file(BYTE)
    ids = {}
    for r in docs:
        ids.setdefault(r.doc_id, []).append([*library.encode(r.text or "", add_special_tokens=False).ids, 0])
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(ids)
    for doc, own in by_doc.items():
        copies = ids[doc]
        assert sum(p.length for p in own) == sum(map(len, copies))
        for p in own:
            assert any(zlib.crc32(np.array(c[p.start : p.start + p.length], dtype="<u4").tobytes()) == p.ids_crc32 and p.doc_tokens == len(c) for c in copies)
        if len(copies) == 1:
            at = 0
            for p in sorted(own, key=lambda p: p.start):
                assert p.start == at and p.length > 0
                at += p.length
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= seq_len
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert len(by_seq) * seq_len - sum(p.length for p in pieces) <= padding


def test_packing(spark, small_dir, edges):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    pieces = packing.pack(docs, BYTE).collect()
    check_pieces(docs.collect(), pieces, 1024, 1023)
    share, total = {}, sum(p.length for p in pieces)
    for p in pieces:
        share[p.source] = share.get(p.source, 0) + p.length / total
    last = max(p.sequence_id for p in pieces)
    for upto in (last // 4, last // 2):  # deficits are carried: no source is more than a slot off its share of what was packed
        for s, part in share.items():
            sent = sum(p.length for p in pieces if p.sequence_id < upto and p.source == s)
            assert abs(sent - part * upto * 1024) <= 3 * 128 + 0.01 * upto * 1024
    check_pieces(edges.collect(), packing.pack(edges, BYTE, seq_len=64, slot=16).collect(), 64, 63)
    check_pieces(edges.collect(), packing.pack(edges, BYTE, seq_len=64, slot=16, weights={"s0": 3, "s1": 1}).collect(), 64, 63)
    assert packing.pack(edges.limit(0), BYTE).count() == 0


def test_packing_keeps_stated_proportions(spark, small_dir):
    """In every prefix of windows each source has its share, within a slot for each source, until one runs dry."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    asked = {"src0": 3.0, "src1": 1.0, "src2": 0.5, "src3": 0.0, "nowhere": 9.0}
    pieces = packing.pack(docs, BYTE, weights=asked).collect()
    check_pieces(docs.collect(), pieces, 1024, 1023)
    total = {}
    for p in pieces:
        total[p.source] = total.get(p.source, 0) + p.length
    shares = {s: asked[s] / 4.5 for s in ("src0", "src1", "src2")}
    dry = min(total[s] / shares[s] for s in shares)
    for upto in range(1, int(dry // 1024) - 3):
        sent = {s: sum(p.length for p in pieces if p.sequence_id < upto and p.source == s) for s in total}
        assert all(abs(sent[s] - share * upto * 1024) <= 4 * 128 for s, share in shares.items()), upto
        assert all(not n for s, n in sent.items() if s not in shares)
    last = max(p.sequence_id for p in pieces if p.source in shares and p.length == 128)
    assert min(p.sequence_id for p in pieces if p.source == "src3" and p.length == 128) >= last - 1
    assert packing.round_of(10**12, 1e-12, 0.0, 8) < packing.BEHIND <= packing.round_of(0, None, 0.5, 8)
    with pytest.raises(ValueError):
        packing.pack(docs, BYTE, weights={"src0": -1})
