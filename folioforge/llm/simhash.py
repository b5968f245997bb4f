"""SimHash near-duplicate groups with pivot distance tables.

Fingerprints are taken for each document and grouped, so copies are one node. Two fingerprints that differ in at most k
bits are equal in all but k of the blocks that the bits are dealt to, so they share one of the keys made of the other
blocks. The fingerprints of a key are compared through a table of their distances to reference fingerprints: by the
triangle inequality a pair whose distances to any of those differ by more than k can't be linked, and what is left is
verified on the bits. A key gives the edges of a spanning forest of its links, never all pairs: members are first tied
to hubs, and then only members of different trees are compared. A key with more than HELD fingerprints is split: its
members get keys of the bits that it leaves open, exact by the same argument, and what is still beyond HELD is dealt to
blocks, each pair of which is a task of its own. So no task holds more than two blocks, whatever a key has. Components
follow from the edges by alternating stars.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path, removed, small, stored, stored_at
from .pieces import sliced

BITS = 64
PIVOTS = 32
#: Fingerprints of a key that one task takes.
HELD = 8192
#: Members of a key that are compared with the rest of the key at once.
BLOCK = 2048


def fingerprint(text: str | None, words: int = 4) -> int:
    """The majority bits of the XXH64 (seed 42) of the text's shingles; zero without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: only A-Z, and only ASCII white space
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    line = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist())), dtype=np.uint64, count=n)
    counts = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, n, 1 << 16):
        counts += np.unpackbits(h[lo : lo + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to the reference fingerprints, which are hashes of 0, 1, 2, ..."""
    pivots = np.array([xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42) for i in range(PIVOTS)], dtype=np.uint64)
    return np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)


def linked(fps: np.ndarray, table: np.ndarray, one: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x of one, y of others) of at most k differing bits: discarded by pivot distances, then verified."""
    near = np.ones((len(one), len(others)), dtype=bool)
    for p in range(table.shape[1]):
        near &= np.abs(table[one, p][:, None] - table[others, p][None, :]) <= k
        if p % 8 == 7 and near.sum() * 4 < near.size:
            break
    a, b = np.nonzero(near)
    a, b = one[a], others[b]
    fine = (np.abs(table[a] - table[b]).max(axis=1, initial=0) <= k) & (np.bitwise_count(fps[a] ^ fps[b]) <= k)
    return a[fine], b[fine]


def forest(fps: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Edges that connect what links of at most k bits connect among the distinct fps, at most one less than those."""
    n = len(fps)
    if n == 2:
        return [(0, 1)] if (np.abs(np.diff(pivot_table(fps).astype(int), axis=0)) <= k).all() and int(fps[0] ^ fps[1]).bit_count() <= k else []
    table, edges, tree = pivot_table(fps), [], np.arange(n)

    def tie(hubs: np.ndarray, members: np.ndarray) -> None:
        """Join the trees of each link (hub, member); one edge for each tree that joins."""
        _, some = np.unique(tree[members], return_index=True)
        for a, b in zip(hubs[some].tolist(), members[some].tolist()):
            if tree[a] != tree[b]:
                edges.append((a, b))
                tree[tree == max(tree[a], tree[b])] = min(tree[a], tree[b])

    free = np.arange(n)
    while len(free):  # hubs: every member becomes a hub or is tied to one
        hub, near = linked(fps, table, free[:1], np.arange(n), k)
        lone = near[tree[near] == near]
        lone = lone[(lone != free[0]) & (np.bincount(tree, minlength=n)[lone] == 1)]  # trees of one, joined all at once
        edges += [(int(free[0]), b) for b in lone.tolist()]
        tree[lone] = tree[free[0]]
        tie(hub, near)
        free = np.setdiff1d(free[1:], near, assume_unique=True)
    trees, sizes = np.unique(tree, return_counts=True)
    for t in trees[np.argsort(sizes)][:-1].tolist():  # each smaller tree against all that isn't in it
        mine = np.flatnonzero(tree == tree[t])
        rest = np.flatnonzero(tree != tree[t])
        for lo in range(0, len(mine), BLOCK):
            for x in range(0, len(rest), BLOCK):
                tie(*linked(fps, table, mine[lo : lo + BLOCK], rest[x : x + BLOCK], k))
    return edges


def fingerprints(docs: DataFrame, words: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and fp (a signed long of the 64 bits) for each row of docs."""

    def run(batches):
        for batch in sliced(batches):
            fps = [fingerprint(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fp long")


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def block_masks(open_bits: list[int], k: int, blocks: int) -> list[int]:
    """For each choice of blocks - k of the blocks that open_bits are dealt to, the bits of the chosen ones."""
    edges = [len(open_bits) * i // blocks for i in range(blocks + 1)]
    whole = [sum(1 << b for b in open_bits[lo:hi]) for lo, hi in zip(edges, edges[1:])]
    return [sum(whole[c] for c in chosen) for chosen in combinations(range(blocks), blocks - k)]


def block_keys(fp: Column, masks: list[int], *before: Column) -> Column:
    """One (key, choice) for each mask: a hash of the choice's number and the bits under it, behind what `before` has."""
    return F.array(*(F.struct(F.xxhash64(*before, F.lit(i), fp.bitwiseAND(F.lit(signed(m)))).alias("key"), F.lit(i).alias("choice")) for i, m in enumerate(masks)))


def rekeyed(rows: DataFrame, masks: list[int], k: int, blocks: int) -> DataFrame:
    """fp, key of the rows (fp, key, choice) by the bits that their choice leaves open."""
    by_choice = F.array().cast("array<struct<key:long,choice:int>>")
    for i, mask in enumerate(masks):
        free = [b for b in range(BITS) if not mask >> b & 1]
        by_choice = F.when(F.col("choice") == i, block_keys(F.col("fp"), block_masks(free, k, blocks), F.col("key"))).otherwise(by_choice)
    return rows.select("fp", F.explode(by_choice).alias("k")).select("fp", "k.key")


def large_keys(rows: DataFrame, held: int) -> DataFrame | None:
    """(big, n) of the keys with more than `held` rows; None without any."""
    found = stored(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > held).select(F.col("key").alias("big"), "n"), "large-keys")
    return found if found.limit(1).count() else None


def edges_of(fps: DataFrame, k: int, blocks: int, held: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints: for each key, a spanning forest of its links."""
    held = held or HELD
    masks = block_masks(list(range(BITS)), k, blocks)
    keyed = fps.select("fp", F.explode(block_keys(F.col("fp"), masks)).alias("k")).select("fp", "k.key", "k.choice")
    big = large_keys(keyed, held)
    if big is None:
        return forests(keyed.select("fp", "key"), k)
    big = small(big)
    few = keyed.join(big, F.col("key") == F.col("big"), "left_anti").select("fp", "key")
    split = rekeyed(keyed.join(big, F.col("key") == F.col("big"), "left_semi"), masks, k, blocks)
    still = large_keys(split, held)
    if still is None:
        return forests(few.unionByName(split), k)
    still = small(still)
    few = few.unionByName(split.join(still, F.col("key") == F.col("big"), "left_anti").select("fp", "key"))
    # each member meets its own block and every other block of its key in one task each
    of = split.join(still, F.col("key") == F.col("big")).withColumn("m", F.ceil(F.col("n") * 2 / held).cast("int")).withColumn("x", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda y: F.struct(F.least("x", y).alias("lo"), F.greatest("x", y).alias("hi")))
    dealt = of.select("fp", "key", F.explode(pairs).alias("p")).select("fp", F.xxhash64("key", "p.lo", "p.hi").alias("key"))
    return forests(few, k).unionByName(forests(dealt, k)).distinct()


def forests(keyed: DataFrame, k: int) -> DataFrame:
    """Distinct edges (a, b) of the spanning forests of each key's links. keyed: fp, key."""
    keyed = keyed.repartition("key").sortWithinPartitions("key")

    def run(batches):
        held_key, held = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

        def out(keys, fps):
            """Edges of whole keys; single members go at once."""
            cut = np.flatnonzero(np.diff(keys)) + 1
            first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])
            many = last - first > 1
            found = []
            for a, b in zip(first[many].tolist(), last[many].tolist()):
                own = np.unique(fps[a:b].view(np.uint64))
                found += [(int(own[x]), int(own[y])) for x, y in forest(own, k)]
            pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            keys, fps = np.concatenate([held_key, batch.column("key").to_numpy()]), np.concatenate([held, batch.column("fp").to_numpy()])
            whole = np.searchsorted(keys, keys[-1]) if len(keys) else 0  # the last key may go on
            held_key, held = keys[whole:], fps[whole:]
            if whole:
                yield out(keys[:whole], fps[:whole])
        if len(held):
            yield out(held_key, held)

    return keyed.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node reachable. Large and small stars in turn."""
    spark, path = edges.sparkSession, new_path(edges.sparkSession, "stars")
    now = stored_at(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), path)
    seen = None
    for _ in range(most):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        after = large.join(small, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()
        last, path = path, new_path(spark, "stars")
        now = stored_at(after, path)
        removed(spark, last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        seen = state
    raise RuntimeError(f"components not found in {most} rounds")


def near_duplicates(docs: DataFrame, words: int = 4, k: int = 4, blocks: int = 7, text: str = "text", key: str = "doc_id", held: int | None = None) -> DataFrame:
    """For each row of docs: key, fp, component (the smallest key reachable by links of at most k bits).

    Null and empty texts have fingerprint zero and are linked like any other. Rows with equal keys count as one document
    of several texts only if their fingerprints link; a null key takes part but is smallest of a group only where the
    group has no other. An empty table gives none; other columns are ignored, whatever they are called. A text's work and
    memory follow its length. held: fingerprints of a key in one task (HELD); components don't depend on it.
    """
    prints = stored(fingerprints(docs, words, text, key), "fingerprints")
    groups = stored(prints.groupBy("fp").agg(F.min("key").alias("least")), "distinct-prints")
    roots = components(edges_of(groups.select("fp"), k, blocks, held))
    joined = groups.join(roots, groups.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp"))
    named = joined.groupBy("root").agg(F.min("least").alias("component"))
    # copies and near copies first become a small table of fingerprints with their component
    table = stored(joined.select("fp", "root").join(named, "root").select(F.col("fp").alias("t_fp"), "component"), "print-components")
    return prints.join(table, prints.fp == table.t_fp, "left").select("key", "fp", "component")
