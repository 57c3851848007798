"""Operator 6: SimHash near-dedup by a binary-trie self-join.

Fingerprint: XXH64 (seed 42) of every 3-word shingle of the lower-cased (A-Z) text; a bit
is 1 if set in over half of them. Fingerprints link at MAX_BITS or fewer differing bits;
a component is what links reach.

Equal fingerprints fall together first (a map-side minimum), so groups of copies of any
size are one trie key. The distinct keys are cut into trie leaves from a histogram of
their leading HISTOGRAM_BITS bits (a bounded table); the driver walks pairs of trie nodes,
accumulates differing bits and prunes beyond MAX_BITS, which leaves the pairs of leaves
that can hold links. Each pair of leaves is one group: the walk goes on there over
sorted keys, node pairs inside one known component are skipped, and what comes out is a
spanning forest (each key with its smallest known key), never all pairs. The forests of
all groups meet in large-star/small-star rounds over written tables.

Null and empty texts have fingerprint zero and link like any other. Rows with a null id
take part; a component's id is the smallest id in it (null if it has none). Repeated rows
stay, with the same component. Other columns are ignored. Empty tables give empty ones.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lexloom.llm.common import text_batches, written

SHINGLE = 3
SEED = 42
MAX_BITS = 2
HISTOGRAM_BITS = 14
#: Bits by which dense prefixes are counted further down.
DEEPER_BITS = 10
#: The trie is cut into about LEAVES leaves, into more where a leaf would pass LEAF_KEYS keys.
LEAVES = 64
LEAF_KEYS = 1 << 18
LEAST_KEYS = 512
_ONE = np.uint64(1)


def fingerprint(text: str | None) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # lower() and split() of bytes: ASCII only
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))
    n = len(words) - SHINGLE + 1
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    bits = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = hashes[at : at + 65536]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp): the fingerprint as a signed 64-bit integer."""

    def run(batches):
        for keys, texts in text_batches(batches, "key", "text"):
            values = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values)], names=[id_col, "fp"])

    picked = docs.select(docs[id_col].cast("long").alias("key"), docs[text_col].alias("text"))
    return picked.mapInArrow(run, f"`{id_col}` long, fp long")


# --- the walk over node pairs -------------------------------------------------------


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _union(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    while True:
        u, v = parent[u], parent[v]
        apart = u != v
        if not apart.any():
            return parent
        u, v = u[apart], v[apart]
        np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))
        parent = _roots(parent)


def _walk(keys: np.ndarray, split: int, bits: int) -> np.ndarray:
    """Smallest linked key (as an index) of each of the sorted uint64 keys.

    split = 0: all pairs; else only pairs of keys[:split] with keys[split:].
    """
    n = len(keys)
    parent = np.arange(n)
    # Links of neighbours, under a few rotations, join dense groups before the walk.
    for turn in range(0, 64, 8):
        turned = (keys << np.uint64(turn)) | (keys >> np.uint64((64 - turn) % 64)) if turn else keys
        order = np.argsort(turned, kind="stable")
        near = np.bitwise_count(keys[order[1:]] ^ keys[order[:-1]]) <= bits
        parent = _union(parent, order[1:][near], order[:-1][near])
    start = (0, split or n, split, n, 0)
    stack = [(0, np.array([start], np.int64))]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > 300_000:
            half = len(pairs) // 2
            stack += [(depth, pairs[half:]), (depth, pairs[:half])]
            continue
        change = np.concatenate([[0], np.cumsum(parent[1:] != parent[:-1])])
        alo, ahi, blo, bhi, diff = pairs.T
        same = (change[ahi - 1] == change[alo]) & (change[bhi - 1] == change[blo]) & (parent[alo] == parent[blo])
        pairs = pairs[~same]
        sizes = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        low = (sizes <= 32) | (depth == 64)
        leaf, sizes = pairs[low], sizes[low]
        for at in range(0, len(leaf), 20_000):  # at most 640,000 comparisons at once
            part, size = leaf[at : at + 20_000], sizes[at : at + 20_000]
            which = np.repeat(np.arange(len(part)), size)
            inner = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            width = (part[:, 3] - part[:, 2])[which]
            u, v = part[which, 0] + inner // width, part[which, 2] + inner % width
            near = np.bitwise_count(keys[u] ^ keys[v]) <= bits
            parent = _union(parent, u[near], v[near])
        pairs = pairs[~low]
        if not len(pairs):
            continue
        ones = np.concatenate([[0], np.cumsum((keys >> np.uint64(63 - depth)) & _ONE, dtype=np.int64)])
        alo, ahi, blo, bhi, diff = pairs.T
        am, bm = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        twin = (alo == blo) & (ahi == bhi)
        below = [
            np.stack([alo, am, blo, bm, diff], 1),
            np.stack([am, ahi, bm, bhi, diff], 1),
            np.stack([alo, am, bm, bhi, diff + 1], 1),
            np.stack([am, ahi, blo, bm, diff + 1], 1)[~twin],
        ]
        below = np.concatenate(below)
        alive = (below[:, 0] < below[:, 1]) & (below[:, 2] < below[:, 3]) & (below[:, 4] <= bits)
        stack.append((depth + 1, below[alive]))
    return parent


def _leaves(histogram: list[tuple[int, int]], target: int, top: int = 0, above: int = 0, bits: int = HISTOGRAM_BITS) -> tuple[list[tuple[int, int]], list[int]]:
    """Trie leaves (prefix, depth) of at most ``target`` keys, and prefixes at the full depth that hold more.

    histogram: (prefix of ``bits`` bits, keys), sorted, all below the prefix ``top`` of depth ``above``.
    """
    found, dense = [], []

    def cut(prefix: int, depth: int, rows: list[tuple[int, int]]) -> None:
        if sum(n for _, n in rows) <= target:
            found.append((prefix, depth))
        elif depth == bits:
            dense.append(prefix)
        else:
            bit = bits - 1 - depth
            for side in (0, 1):
                part = [r for r in rows if (r[0] >> bit & 1) == side]
                if part:
                    cut(2 * prefix + side, depth + 1, part)

    if histogram:
        cut(top, above, histogram)
    return found, dense


def _all_leaves(keys: DataFrame) -> list[tuple[int, int]]:
    """The leaves of the whole trie in order; prefixes that stay dense are counted further down."""
    spark, bits = keys.sparkSession, HISTOGRAM_BITS
    prefix = F.shiftrightunsigned("fp", 64 - bits)
    histogram = sorted((int(r[0]), int(r[1])) for r in keys.groupBy(prefix.alias("p")).count().collect())  # at most 2**HISTOGRAM_BITS rows
    target = max(LEAST_KEYS, min(sum(n for _, n in histogram) // LEAVES, LEAF_KEYS))
    leaves, dense = _leaves(histogram, target)
    while dense and bits < 64:
        # Each dense prefix holds over ``target`` keys, so there are few; the join is bounded by that.
        step = min(DEEPER_BITS, 64 - bits)
        within = F.broadcast(spark.createDataFrame([(p,) for p in dense], "top long"))
        part = keys.select(F.shiftrightunsigned("fp", 64 - bits).alias("top"), F.shiftrightunsigned("fp", 64 - bits - step).alias("p")).join(within, "top")
        below: dict[int, list[tuple[int, int]]] = {}
        for top, p, n in part.groupBy("top", "p").count().collect():
            below.setdefault(int(top), []).append((int(p) & (1 << bits + step) - 1, int(n)))
        dense = []
        for top, rows in below.items():
            found, more = _leaves(sorted(rows), target, top, bits, bits + step)
            leaves += found
            dense += more
        bits += step
    return sorted(leaves, key=lambda x: x[0] << 64 - x[1])


def _leaf_pairs(leaves: list[tuple[int, int]], bits: int) -> list[tuple[int, int]]:
    """Pairs of leaves whose prefixes differ in at most ``bits`` of their common length."""
    low = np.array([p << 64 - d if d else 0 for p, d in leaves], np.uint64)
    # A shift by 64 would leave a number as it is; two leaves of depth 0 can't be.
    drop = np.array([min(63, 64 - d) for _, d in leaves], np.uint64)
    pairs = []
    for i in range(len(leaves)):
        differ = np.bitwise_count((low[i] ^ low[i:]) >> np.maximum(drop[i], drop[i:]))
        pairs += [(i, i + int(j)) for j in np.flatnonzero(differ <= bits)]
    return pairs


def linked(keys: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(fp, root) for keys that link to a smaller one within a leaf pair; keys: distinct ``fp``."""
    spark = keys.sparkSession
    leaves = _all_leaves(keys)
    pairs = _leaf_pairs(leaves, bits) if leaves else []
    lows = np.array([p << (64 - d) if d else 0 for p, d in leaves], np.uint64)
    of: list[list[tuple[int, int]]] = [[] for _ in leaves]
    for number, (i, j) in enumerate(pairs):
        of[i].append((number, 0))
        if j != i:
            of[j].append((number, 1))
    flat = np.array([x for o in of for x in o], np.int64).reshape(-1, 2)
    count = np.array([len(o) for o in of], np.int64)
    first = np.cumsum(count) - count

    def deal(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 20_000):
                part = fp[at : at + 20_000]
                leaf = np.searchsorted(lows, part.view(np.uint64), side="right") - 1
                times = count[leaf]
                which = np.repeat(np.arange(len(part)), times)
                slot = first[leaf][which] + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
                yield pa.RecordBatch.from_arrays([pa.array(flat[slot, 0]), pa.array(flat[slot, 1]), pa.array(part[which])], names=["pair", "side", "fp"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf["fp"].to_numpy().view(np.uint64)
        side = pdf["side"].to_numpy()
        order = np.lexsort((key, side))
        key, split = key[order], int((side == 0).sum())
        if split == len(key):
            split = 0
        elif not split:
            return pd.DataFrame({"fp": [], "root": []}, dtype="int64")
        root = _walk(key, split, bits)
        out = np.flatnonzero(root != np.arange(len(key)))
        signed = key.view(np.int64)
        return pd.DataFrame({"fp": signed[out], "root": signed[root[out]]})

    if not pairs:
        return spark.createDataFrame([], "fp long, root long")
    dealt = keys.select("fp").mapInArrow(deal, "pair long, side long, fp long")
    return dealt.groupBy("pair").applyInPandas(join, "fp long, root long")


def components(edges: DataFrame, a: str = "fp", b: str = "root") -> DataFrame:
    """(node, root): root is the smallest node that links reach; by alternating stars.

    Each round is a minimum per node (combined before the shuffle) joined back to the
    edges; both sides of that join are dealt by the node, so a hub's rows can be split.
    """
    edges = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        # Large star: every larger neighbour of u goes to u's smallest.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        # Small star: u and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = written(small.filter("u <> v").distinct(), "small")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MAX_BITS) -> DataFrame:
    """(id_col, fingerprint, component_id), a row for every row of docs."""
    prints = written(fingerprints(docs, id_col, text_col), "prints")
    keys = written(prints.groupBy("fp").agg(F.min(id_col).alias("rep")), "keys")
    roots = components(linked(keys, bits))
    # Smallest id of each component: its keys, then the minimum, then back to the keys.
    member = roots.withColumnRenamed("node", "fp")
    grouped = keys.join(member, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    grouped = written(grouped, "grouped")
    least = grouped.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_key = grouped.join(least, "root").select("fp", "component_id")
    out = prints.join(of_key, "fp")
    return out.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is their component's: one document of each group stays.

    Rows that repeat an id are copies of one document: one of them stays. Rows without an id
    can't be told apart: they stay if one of them is in a group in which nothing has an id.
    The texts are shuffled once, by id, to meet the ids that stay; at any size alike, as the
    ids that stay grow with the documents.
    """
    found = near_duplicates(docs.select(id_col, text_col), id_col, text_col)
    keep = found.filter(F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy(F.col(id_col).alias("__keep")).agg(F.count("*").alias("__n"))
    keep = written(keep, "keep")
    nulls, repeated = keep.agg(F.count_if(F.col("__keep").isNull()), F.count_if(F.col("__keep").isNotNull() & (F.col("__n") > 1))).first()
    once = keep.filter("__n = 1").hint("merge")
    out = docs.join(once, docs[id_col] == once["__keep"], "left_semi")
    if repeated:
        more = keep.filter("__n > 1").hint("merge")
        out = out.unionByName(docs.join(more, docs[id_col] == more["__keep"], "left_semi").dropDuplicates([id_col]))
    if nulls:
        out = out.unionByName(docs.filter(docs[id_col].isNull()))
    return out
