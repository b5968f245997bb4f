"""Near-duplicate groups by exact Jaccard similarity of word shingles: SimHash with pivot tables for a stated similarity.

The fingerprint is that of simhash.py, the majority bits of shingle hashes, of each distinct shingle once and with more bits:
at similarity 0.8 a bit differs with probability 0.15, ten of 64, which 64 bits can't tell from chance and BITS can. Bits
after the first 64 are of hashes mixed from the shingle's XXH64. Candidates are pairs that have all bits of one of the keys
in common, have sizes that allow the similarity and differ in few enough of BITS bits: distances to pivot fingerprints
discard, the bits decide. A key's bits follow from the number of rows, so that SPREAD unrelated texts at most share one, and
the number of keys from a key's bits, so that a linked pair shares none with probability MISS at most; it differs in too
many bits with the same probability. Both are for bits of independent hashes and pairs of the least similarity; more similar
pairs are missed less often.

A key gives a spanning forest of its candidates, never all of them, and their components are the candidate groups, in which
the sets are compared: every link is verified, no other pairs are linked, and what chance or a chain of candidates put into
one group comes apart again. Texts with equal shingle sets are one node. A group's members are first compared with a hub,
twice; then members of different components are compared within the group, the largest one's not with each other, and give
at most a spanning forest. Jaccard distances obey the triangle inequality as Hamming distances do, so a table of distances
to a few members discards pairs without loss before the sets are counted.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stored
from .pieces import sliced
from .simhash import components, large_keys

#: Bits of a fingerprint that are compared; keys may take more.
BITS = 256
#: Unrelated texts that share a key, at most in the mean.
SPREAD = 8192
#: Fingerprints of a key that one task takes.
HELD_PRINTS = 16384
#: Probability that a pair of the least similarity shares no key, and that it differs in more bits than are allowed.
MISS = 1e-6
#: Pairs of fingerprints that are compared at once.
BLOCK = 1 << 18
HUBS = 2
PIVOTS = 16
#: Shingles of a key's members that one task takes.
HELD = 2 << 20
#: Shingles whose bits are counted at once; their number fits a byte.
SLICE = 255


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct XXH64 of the text's word shingles, sorted; of all its words if they are fewer; empty without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: only A-Z, and only ASCII white space
    if not found:
        return np.empty(0, dtype=np.uint64)
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - words + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[min(words, len(found)) - 1 :].tolist())), dtype=np.uint64, count=n))


def node_of(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def is_small(size, percent: int):
    """Sets of so few shingles differ in more bits than others at equal similarity."""
    return size * (100 - percent) <= 100


def differing(percent: int) -> tuple[float, float]:
    """The share of bits in which sets of similarity percent / 100 differ at most: of any sizes, and of two small sets.

    For large sets it is an angle's; the factors are above the greatest excess over it among sets of up to 75 shingles in
    all (140 for percent 80), where it was counted out.
    """
    share = math.acos(min(1.0, 2 * percent / (100 + percent))) / math.pi
    return max(0.01, share * (1.07 if percent == 80 else 1.25)), max(0.01, share * 1.25)


def key_bits(rows: int, spread: int) -> int:
    return max(0, math.ceil(math.log2(max(1, rows) / spread)))


def key_count(bits: int, share: float) -> int:
    """Keys of so many bits of which a pair that differs in `share` of the bits has one in common, but for MISS."""
    return math.ceil(math.log(MISS) / math.log1p(-((1 - share) ** bits))) if bits else 1


@cache
def most_bits(share: float) -> int:
    """The bits of BITS that a pair that differs in `share` of them exceeds with probability MISS at most."""
    tail = 0.0
    for k in range(BITS, -1, -1):
        tail += math.comb(BITS, k) * share**k * (1 - share) ** (BITS - k)
        if tail > MISS:
            return k
    return 0


def majority(own: np.ndarray, words: int) -> np.ndarray:
    """words * 64 bits, each 1 if set in over half the shingles' hashes: the first 64 of the XXH64 itself, others of mixed ones."""
    salt = (np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    counts = np.zeros(words * 64, dtype=np.int64)
    for lo in range(0, len(own), SLICE):
        h = own[lo : lo + SLICE, None]
        z = h + salt
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        z[:, :1] = h
        counts += np.add.reduce(np.unpackbits(z.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return counts * 2 > len(own)


def print_and_keys(own: np.ndarray, bits: int, percent: int) -> tuple[bytes, np.ndarray]:
    """The fingerprint with the set's size behind it, and the set's keys of `bits` bits each."""
    n = key_count(bits, differing(percent)[int(is_small(len(own), percent))])
    found = majority(own, max(BITS, n * bits + 63) // 64)
    keys = found[: n * bits].reshape(n, bits) @ (np.int64(1) << np.arange(bits)) + (np.arange(n) << 48)
    return np.packbits(found[:BITS]).tobytes() + len(own).to_bytes(4, "little"), keys.astype(np.int64)


def prints_of(docs: DataFrame, words: int, text: str, key: str, bits: int, percent: int) -> DataFrame:
    """key, node, size, print and keys (both without values where there are no shingles) for each row of docs."""

    def run(batches):
        for batch in sliced(batches):
            nodes, sizes, prints, keys = [], [], [], []
            for t in batch.column("text").to_pylist():
                own = shingles(t, words)
                nodes.append(node_of(own))
                sizes.append(len(own))
                found = print_and_keys(own, bits, percent) if len(own) else (None, np.empty(0, dtype=np.int64))
                prints.append(found[0])
                keys.append(found[1])
            columns = [batch.column("key"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "size", "print", "keys"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, node binary, size long, print binary, keys array<long>")


def sets_of(docs: DataFrame, words: int, text: str) -> DataFrame:
    """node and its shingles for each row of docs."""

    def run(batches):
        for batch in sliced(batches, size=1 << 20):
            own = [shingles(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in own], pa.binary()), pa.array([s.view(np.int64) for s in own], pa.list_(pa.int64()))], names=["node", "set"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "node binary, set array<long>")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have at least `percent` of their union in common."""
    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", (F.size("set_a") + F.size("set_b")).alias("n"), F.size(F.array_intersect("set_a", "set_b")).alias("common"))
    return both.where(F.col("common") * 100 >= (F.col("n") - F.col("common")) * percent).select("a", "b")


def hub_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of each key's smallest node with its members of other components, and the rows that stay for later."""
    hubs = rows.groupBy("key").agg(F.min(F.struct("node", "root", "size")).alias("hub"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key", "hub")
    with_hub = stored(rows.join(hubs, "key").where("node != hub.node"), "hub-rows")
    return with_hub.where("root != hub.root").select(F.col("hub.node").alias("a"), F.col("node").alias("b"), F.col("hub.size").alias("size_a"), F.col("size").alias("size_b")), with_hub.select("key", "node", "size")


def links_within(roots: list[bytes], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect all trees (members of equal roots) that links of the members connect; each is on the sets."""
    m, sizes = len(sets), np.array([len(s) for s in sets])
    tree = np.unique(np.array(roots, dtype=object), return_inverse=True)[1]
    values, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]

    def in_common(x: int) -> np.ndarray:
        """How many values of each member are in x."""
        lo, hi = np.searchsorted(values, sets[x], "left"), np.searchsorted(values, sets[x], "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(owner[at], minlength=m)

    def distances(x: int) -> np.ndarray:
        common = in_common(x)
        return 1 - common / (sizes[x] + sizes - common)

    asked = np.flatnonzero(tree != np.bincount(tree).argmax()).tolist()
    table = pivot_table(distances, m)[0] if len(asked) > 4 * PIVOTS else np.zeros((m, 0))
    most, found = 1 - percent / 100 + 1e-9, []
    for x in asked:
        if (tree == tree[x]).all():
            break
        left = (tree != tree[x]) & (np.abs(table - table[x]).max(axis=1, initial=0) <= most)
        if not left.any():
            continue
        common = in_common(x)
        near = np.flatnonzero(left & (common * 100 >= (sizes[x] + sizes - common) * percent))
        for y in near.tolist():
            if tree[x] != tree[y]:
                found.append((x, y))
                tree[tree == tree[y]] = tree[x]
    return found


def pivot_table(distances, m: int) -> tuple[np.ndarray, list[int]]:
    """Distances of all m members to PIVOTS of them, each the farthest from those before it, and which these are."""
    columns, pivots, nearest, pivot = [], [], np.full(m, np.inf), 0
    for _ in range(min(PIVOTS, m)):
        columns.append(distances(pivot))
        pivots.append(pivot)
        nearest = np.minimum(nearest, columns[-1])
        pivot = int(nearest.argmax())
    return np.stack(columns, axis=1), pivots


def print_forest(prints: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Pairs of places that connect what candidates among the distinct prints connect, at most one less than those."""
    own = np.frombuffer(b"".join(prints), dtype=np.uint8).reshape(len(prints), BITS // 8 + 4)
    sizes = own[:, BITS // 8 :].copy().view("<u4")[:, 0].astype(np.int64)
    place = np.argsort(sizes, kind="stable")
    sizes, fps = sizes[place], np.ascontiguousarray(own[place, : BITS // 8]).view(np.uint64)
    m, tree, edges = len(fps), np.arange(len(fps)), []
    usual, most = map(most_bits, differing(percent))
    few = is_small(sizes, percent)

    def tie(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> None:
        """Join the trees of the candidates among the pairs (a, b) of distance d; one edge for each tree that joins."""
        fine = (d <= np.where(few[a] & few[b], most, usual)) & (np.minimum(sizes[a], sizes[b]) * 100 >= np.maximum(sizes[a], sizes[b]) * percent)
        a, b = a[fine], b[fine]
        _, some = np.unique(tree[a] * m + tree[b], return_index=True)
        for x, y in zip(a[some].tolist(), b[some].tolist()):
            if tree[x] != tree[y]:
                edges.append((int(place[x]), int(place[y])))
                tree[tree == tree[y]] = tree[x]

    table, pivots = pivot_table(lambda x: np.bitwise_count(fps ^ fps[x]).sum(axis=1, dtype=np.int16), m)
    for p, x in enumerate(pivots):
        tie(np.full(m, x), np.arange(m), table[:, p])
    columns, in_largest = np.ascontiguousarray(fps.T), tree == np.bincount(tree).argmax()
    last = np.searchsorted(sizes * percent, sizes * 100, "right")  # sizes that allow the similarity; each pair from its smaller set
    for rows, others in ((np.flatnonzero(in_largest), ~in_largest), (np.flatnonzero(~in_largest), np.ones(m, dtype=bool))):
        lo = 0
        while lo < len(rows):
            area = (last[rows[lo : lo + BLOCK]] - rows[lo]) * np.arange(1, len(rows[lo : lo + BLOCK]) + 1)
            one = rows[lo : lo + max(1, int(np.searchsorted(area, BLOCK, "right")))]
            lo += len(one)
            two = one[0] + np.flatnonzero(others[one[0] : last[one[-1]]])
            if not len(two) or (tree[two] == tree[one[0]]).all() and (tree[one] == tree[one[0]]).all():
                continue
            near = tree[one][:, None] != tree[two][None, :]
            left = np.count_nonzero(near)
            for p in range(len(pivots)):  # pivots, as long as they discard an eighth of what is left
                near &= np.abs(table[one, p][:, None] - table[two, p][None, :]) <= most
                before, left = left, np.count_nonzero(near)
                if left * 8 >= before * 7:
                    break
            if left * 4 > near.size:  # a part of the bits discards most of the others
                d = np.bitwise_count(columns[0][one][:, None] ^ columns[0][two][None, :])
                for c in columns[1:-1]:
                    d += np.bitwise_count(c[one][:, None] ^ c[two][None, :])
                near &= d <= most
            a, b = np.nonzero(near)
            a, b = one[a], two[b]
            tie(a, b, np.bitwise_count(fps[a] ^ fps[b]).sum(axis=1, dtype=np.int16))
    return edges


def pairs_by_key(rows: DataFrame, work) -> DataFrame:
    """The distinct pairs (a, b) that work gives for the table of each key's rows."""

    def run(batches):
        now, parts, found = None, [], []

        def out():
            made = pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.binary()) for k in (0, 1)], names=["a", "b"])
            found.clear()
            return made

        for batch in batches:
            keys = batch.column("key").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    if parts and keys[lo] != now:
                        found.extend(work(pa.Table.from_batches(parts)))
                        parts = []
                    now = keys[lo]
                    parts.append(batch.slice(lo, hi - lo))
            yield out()
        if parts:
            found.extend(work(pa.Table.from_batches(parts)))
            yield out()

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a binary, b binary").distinct()


def candidates(keyed: DataFrame, percent: int, held: int) -> DataFrame:
    """Pairs (a, b) of prints: a spanning forest of each key's candidates, or of two blocks of a key of more than `held`.

    keyed: key, print. Each pair of blocks is a task's, so all pairs are compared whatever the key holds.
    """
    big = large_keys(keyed, held)
    if big is not None:
        big = small(big)
        few = keyed.join(big, F.col("key") == F.col("big"), "left_anti")
        of = keyed.join(big, F.col("key") == F.col("big")).withColumn("m", F.ceil(F.col("n") * 2 / held).cast("int")).withColumn("x", F.pmod(F.xxhash64("print"), F.col("m")).cast("int"))
        pairs = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda y: F.struct(F.least("x", y).alias("lo"), F.greatest("x", y).alias("hi")))
        dealt = of.select("key", "print", F.explode(pairs).alias("p")).select(F.xxhash64("key", "p.lo", "p.hi").alias("key"), "print")
        keyed = few.unionByName(dealt)

    def work(table):
        prints = table.column("print").to_pylist()
        return [(prints[x], prints[y]) for x, y in print_forest(prints, percent)] if len(prints) > 1 else []

    return pairs_by_key(keyed, work)


def rest_links(rows: DataFrame, sets: DataFrame, percent: int, held: int = HELD) -> DataFrame:
    """Links (a, b) between a key's members in different components: those of a spanning forest of what one task takes.

    A key of more than `held` shingles is dealt to blocks of half as many; each pair of blocks is a task's, so all pairs
    are compared whatever the key holds.
    """
    weight = F.sum("size")
    blocks = F.when(weight > held, F.ceil(weight * 2 / held)).otherwise(1).cast("int")
    mixed = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), blocks.alias("m")).where("lo != hi").select("key", "m")
    own = F.pmod(F.xxhash64("node"), F.col("m")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda y: F.struct(F.least("x", y).alias("lo"), F.greatest("x", y).alias("hi")))
    dealt = rows.select("key", "node", "root").join(mixed, "key").withColumn("x", own).select("key", "node", "root", F.explode(pairs).alias("p"))
    keyed = dealt.select(F.xxhash64("key", "p.lo", "p.hi").alias("key"), "node", "root")

    def work(table):
        nodes = table.column("node").to_pylist()
        own = [s.values.to_numpy(zero_copy_only=False) for s in table.column("set")]
        return [(nodes[x], nodes[y]) for x, y in links_within(table.column("root").to_pylist(), own, percent)]

    return pairs_by_key(keyed.join(sets, "node").select("key", "node", "root", "set"), work)


def near_copies(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id", held: int = HELD, spread: int = SPREAD, held_prints: int = HELD_PRINTS) -> DataFrame:
    """For each row of docs: key, component (the smallest key reachable by links of Jaccard similarity percent / 100 or more).

    Null and empty texts have no shingles and are one group. Null keys, equal keys, empty tables and other columns are
    treated as in simhash.near_duplicates. A text's set of shingles is one row, so memory follows the longest texts.
    """
    prints = stored(prints_of(docs, words, text, key, key_bits(docs.count(), spread), percent), "set-prints")
    groups = stored(prints.groupBy("node").agg(F.min("key").alias("least"), F.any_value("size").alias("size"), F.any_value("print").alias("print"), F.any_value("keys").alias("keys")), "distinct-sets")
    keyed = groups.groupBy("print").agg(F.any_value("keys").alias("keys")).select("print", F.explode("keys").alias("key"))
    near = components(stored(candidates(keyed.select("key", "print"), percent, held_prints), "candidates"))
    named = groups.where("size > 0").join(near.select(F.col("node").alias("r_print"), F.col("root").alias("r_root")), F.col("print") == F.col("r_print"), "left").select(F.coalesce("r_root", "print").alias("key"), "node", "size")
    shared = named.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    live = stored(named.join(shared, "key", "left_semi"), "candidate-groups")
    asked = groups.join(live.select("node").distinct(), "node", "left_semi").select("node", F.col("least").alias("__least"))
    texts = docs.join(asked.select("__least").distinct(), F.col(key).eqNullSafe(F.col("__least")), "left_semi")
    sets = stored(sets_of(texts, words, text).dropDuplicates(["node"]).join(asked.select("node"), "node", "left_semi"), "shingle-sets")
    edges, roots = None, None
    for turn in range(HUBS + 1):
        rows = live.withColumn("root", F.col("node")) if roots is None else live.join(roots.withColumnRenamed("node", "r_node"), F.col("node") == F.col("r_node"), "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
        if turn < HUBS:
            pairs, live = hub_pairs(rows)
            sized = pairs.where(F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent)
            found = stored(linked(sized.select("a", "b").distinct(), sets, percent), "links")
        else:
            found = stored(rest_links(rows, sets, percent, held), "links")
        edges = found if edges is None else edges.unionByName(found)
        roots = components(edges)
    joined = groups.join(roots.withColumnRenamed("node", "r_node"), F.col("node") == F.col("r_node"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = joined.groupBy("root").agg(F.min("least").alias("component"))
    table = stored(joined.join(named, "root").select(F.col("node").alias("t_node"), "component"), "set-components")
    return prints.join(table, prints.node == table.t_node, "left").select("key", "component")
