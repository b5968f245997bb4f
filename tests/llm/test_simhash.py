import random

import numpy as np
import pytest
import xxhash
from folioforge.llm import queries, simhash


def brute_print(text, words=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    found = [w for w in low.split(" ") if w]
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_groups(prints, k=4):
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    every = sorted(prints)
    for i, a in enumerate(every):
        for b in every[i + 1 :]:
            if (a ^ b).bit_count() <= k:
                root[find(a)] = find(b)
    return {f: find(f) for f in every}


def check(rows, found):
    prints = [(d, brute_print(t)) for d, t in rows]
    group = brute_groups({p for _, p in prints})
    least = {}
    for d, p in prints:
        least[group[p]] = min(least.get(group[p], d), d)
    assert sorted(found) == sorted((d, p, least[group[p]]) for d, p in prints)


def test_query_equals_brute_force(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").collect()
    found = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in queries.op1_simhash(spark, small_dir).collect()]
    check([(r.doc_id, r.text) for r in docs], found)


def test_edges(spark):
    text = "one two three four five six seven eight " * 40
    rows = [(5, None), (2, ""), (9, " \n"), (4, "É one"), (7, text), (7, text), (8, text + "nine"), (3, "One\x0btwo"), (1, "one two")]
    table = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, fp int")
    check(rows, [(r.key, r.fp % (1 << 64), r.component) for r in simhash.near_duplicates(table).collect()])
    assert simhash.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_forest_connects_what_links_connect(seed):
    rng = random.Random(seed)
    fps = {rng.getrandbits(64) for _ in range(5)}
    for c in list(fps):
        x = c
        for _ in range(60):
            y = (c if rng.random() < 0.5 else x) ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(1, 5))})
            fps.add(y)
            x = y
    own = np.unique(np.array(sorted(fps), dtype=np.uint64))
    edges = simhash.forest(own, 4)
    assert len(edges) < len(own)
    root = {int(f): int(f) for f in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        assert int(own[a] ^ own[b]).bit_count() <= 4
        root[find(int(own[a]))] = find(int(own[b]))
    whole = brute_groups({int(f) for f in own})
    assert len({find(f) for f in whole}) == len(set(whole.values()))


@pytest.mark.parametrize("held", [4, 60])
def test_large_keys_are_split_exactly(spark, held):
    """Fingerprints around a few centres, far more of a key than a task takes."""
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for c in [rng.getrandbits(64) for _ in range(3)]:
        for _ in range(150):
            fps.add(c ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(1, 7))}))
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = [tuple(v % (1 << 64) for v in r) for r in simhash.edges_of(table, 4, 7, held).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        root[find(a)] = find(b)
    want = brute_groups(fps)
    assert {f: min(g for g in fps if find(g) == find(f)) for f in fps} == {f: min(g for g in fps if want[g] == want[f]) for f in fps}
