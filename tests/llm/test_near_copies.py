"""Near copies of the pipeline against brute force over all pairs."""

import random

import numpy as np

from folioforge.llm import near_copies, simhash


def sets(text, words=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows, percent=80):
    own, root = [(k, sets(t)) for k, t in rows], list(range(len(rows)))
    for i, (_, a) in enumerate(own):
        for j, (_, b) in enumerate(own[:i]):
            if root[i] != root[j] and len(a & b) * 100 >= len(a | b) * percent:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return {k: min(own[m][0] for m in range(len(own)) if root[m] == root[i]) for i, (k, _) in enumerate(own)}


def changed(rng, words, n):
    """words with n of them replaced."""
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"new{rng.random()}"
    return out


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(1, None), (2, ""), (3, " "), (4, "Few words"), (5, "few  WORDS"), (6, "few words more")]
    for f in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([8, 60, 150, 300]))]
        rows.append((100 * f + 100, " ".join(base)))
        for k in range(1, 14):  # one substituted word changes up to five shingles
            base = changed(rng, base, rng.randrange(len(base) // 25 + 1)) if rng.random() < 0.3 else base
            rows.append((100 * f + 100 + k, " ".join(changed(rng, base, rng.randrange(len(base) // 20 + 1)))))
    rng.shuffle(rows)
    table = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, node string")
    want = brute(rows)
    assert 20 < len(set(want.values())) < len(want) - 40
    assert {r.key: r.component for r in near_copies.near_copies(table).collect()} == want
    assert {r.key: r.component for r in near_copies.near_copies(table, held=500).collect()} == want  # keys in several tasks
    assert near_copies.near_copies(table.limit(0)).count() == 0


def test_pipeline_keeps_one_of_near_copies_at_similarity_08(spark):
    import corpus_pipeline

    rng = random.Random(9)
    rows = []
    for k in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        near = changed(rng, base, 5)
        assert len(sets(" ".join(base)) & sets(" ".join(near))) / len(sets(" ".join(base)) | sets(" ".join(near))) >= 0.8
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()) == list(range(0, 80, 2))
    by_bits = {r.key: r.component for r in simhash.near_duplicates(docs, words=4, k=4).collect()}
    assert sum(by_bits[2 * k + 1] == 2 * k for k in range(40)) < 40


def test_pivots_lose_no_link():
    """A key of many members in trees of their own: its forest connects what all links connect."""
    rng = np.random.default_rng(2)
    own = []
    for _ in range(30):
        base = rng.integers(0, 1 << 40, 60)
        own += [np.unique(np.concatenate([base[rng.random(60) > 0.08], rng.integers(0, 1 << 40, rng.integers(0, 6))])) for _ in range(8)]
    links = near_copies.links_within([bytes([k]) for k in range(len(own))], own, 80)
    root = list(range(len(own)))
    wanted = list(range(len(own)))
    merged = lambda r, a, b: [min(r[a], r[b]) if v in (r[a], r[b]) else v for v in r]
    for a, b in links:
        assert len(np.intersect1d(own[a], own[b])) * 100 >= len(np.union1d(own[a], own[b])) * 80
        root = merged(root, a, b)
    for a in range(len(own)):
        for b in range(a):
            if len(np.intersect1d(own[a], own[b])) * 100 >= len(np.union1d(own[a], own[b])) * 80:
                wanted = merged(wanted, a, b)
    assert root == wanted and len(set(root)) < 200 and len(links) == len(own) - len(set(root))


def pair_at_08(rng, n):
    """Two sets of which 8 of 10 of the union are common; the least pair, four of five, for n = 5."""
    own = [rng.getrandbits(64) for _ in range(n)]
    a, b = (own, own[:-1]) if n == 5 else (own[: n * 9 // 10], own[: n * 8 // 10] + own[n * 9 // 10 :])
    return [np.unique(np.array(x, dtype=np.uint64)) for x in (a, b)]


def test_fingerprint_is_simhash():
    """The first 64 bits are the operator's fingerprint of the same shingles, the others majorities as well."""
    rng = random.Random(12)
    for n in (5, 40, 700):
        text = " ".join(f"w{rng.getrandbits(40)}" for _ in range(n))
        own = near_copies.shingles(text, 5)
        found = near_copies.majority(own, 6)
        assert int.from_bytes(np.packbits(found[:64].reshape(8, 8)[::-1]).tobytes(), "big") == simhash.fingerprint(text, 5)
        assert len(found) == 384 and (n < 700 or 0.4 < found.mean() < 0.6)


def test_fingerprints_propose_pairs_at_similarity_08():
    rng = random.Random(13)
    for n in (5, 10, 20, 200):
        for bits in (0, 4, 9):
            for _ in range(60):
                (p, x), (q, y) = (near_copies.print_and_keys(s, bits, 80) for s in pair_at_08(rng, n))
                assert len(np.intersect1d(x, y)) and len(near_copies.print_forest([p, q], 80)) == 1


def test_print_forest_connects_what_candidates_connect():
    rng = random.Random(14)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(256)
        for _ in range(40):
            bits = centre ^ sum(1 << b for b in rng.sample(range(256), rng.randrange(70)))
            prints.add(bits.to_bytes(32, "little") + rng.choice([3, 4, 5, 90, 100, 119, 126]).to_bytes(4, "little"))
    own = sorted(prints)
    read = [(int.from_bytes(p[:32], "little"), int.from_bytes(p[32:], "little")) for p in own]
    usual, most = map(near_copies.most_bits, near_copies.differing(80))
    near = lambda a, b: min(a[1], b[1]) * 100 >= max(a[1], b[1]) * 80 and (a[0] ^ b[0]).bit_count() <= (most if max(a[1], b[1]) <= 5 else usual)
    root = list(range(len(own)))
    for i in range(len(own)):
        for j in range(i):
            if near(read[i], read[j]) and root[i] != root[j]:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    edges = near_copies.print_forest(own, 80)
    found = list(range(len(own)))
    for a, b in edges:
        assert near(read[a], read[b]) and found[a] != found[b]
        found = [min(found[a], found[b]) if r in (found[a], found[b]) else r for r in found]
    assert found == root and 12 < len(set(root)) < len(own) - 100


def test_keys_and_blocks_lose_nothing(spark):
    """Many keys of few texts, and keys in several tasks, against brute force."""
    rng = random.Random(15)
    rows = []
    for f in range(25):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([8, 9, 12, 60, 200]))]
        rows += [(10 * f + k, " ".join(changed(rng, base, rng.randrange(len(base) // 20 + 1)) if k else base)) for k in range(6)] + [(10 * f + 9, " ".join(base[:-1]))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert 25 <= len(set(want.values())) < len(want) - 50
    assert {r.key: r.component for r in near_copies.near_copies(table, spread=8).collect()} == want
    assert {r.key: r.component for r in near_copies.near_copies(table, spread=64, held_prints=10, held=500).collect()} == want


def test_pipeline_stage_links_through_fingerprints(spark, monkeypatch):
    """Without what the fingerprints propose no near copies are found: nothing beside them links texts."""
    import corpus_pipeline

    rng = random.Random(16)
    base = [f"w{rng.randrange(5000)}" for _ in range(100)]
    rows = [(k, " ".join(changed(rng, base, 1) if k else base), "en", "s", 0) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    assert [r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()] == [0]
    forest = near_copies.candidates
    monkeypatch.setattr(near_copies, "candidates", lambda *a: forest(*a).limit(0))
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()) == [0, 1, 2, 3, 4]
