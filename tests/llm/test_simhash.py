import random
import re

import pytest
import xxhash
from common_docs import no_docs, odd_docs, odd_rows, prose

from lexloom.llm import simhash as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text):
    w = WORD.findall((text or "").translate(LOW))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, bits=2):
    """prints: (id, fingerprint)."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= bits:
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(prints):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [least.get(find(i)) for i in range(len(prints))]


def test_fingerprints_are_those_of_brute_force():
    rng = random.Random(1)
    for text in [None, "", "One", "One TWO", "ÀÉ İ x y", *(prose(rng, rng.randrange(1, 200)) for _ in range(20))]:
        assert S.fingerprint(text) == brute_print(text)


def keys_of(kind, rng):
    if kind == "random":
        return [rng.getrandbits(64) for _ in range(300)]
    if kind == "chain":  # links in a row: each two bits from the one before
        x, out = rng.getrandbits(64), []
        for i in range(200):
            out.append(x)
            x ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
        return out
    if kind == "ball":  # all within a few bits of one key
        x = rng.getrandbits(64)
        return [x ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(5))}) for _ in range(400)]
    return [rng.getrandbits(64) & 0xF000000000000303 for _ in range(200)] + [0, 2**64 - 1]


@pytest.mark.parametrize("kind", ["random", "chain", "ball", "few bits"])
@pytest.mark.parametrize("least", [4, 512])
def test_components_are_those_of_brute_force(spark, monkeypatch, kind, least):
    monkeypatch.setattr(S, "LEAST_KEYS", least)  # small leaves: many pairs of leaves
    rng = random.Random(kind)
    keys = list(dict.fromkeys(keys_of(kind, rng)))
    signed = [k - (1 << 64) if k >> 63 else k for k in keys]
    edges = S.components(S.linked(spark.createDataFrame([(k,) for k in signed], "fp long"))).collect()
    root = {r["node"]: r["root"] for r in edges}
    want = brute_components(list(enumerate(keys)))
    got = [root.get(k, k) for k in signed]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_odd_documents(spark):
    rows = S.near_duplicates(odd_docs(spark)).collect()
    given = [(r[0], brute_print(r[1])) for r in odd_rows()]
    want = [(k, f"{fp:016x}", c) for (k, fp), c in zip(given, brute_components(given))]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    assert S.near_duplicates(no_docs(spark)).count() == 0


def test_one_document_of_each_group_stays(spark):
    docs = odd_docs(spark)
    kept = S.keep_one(docs)
    assert kept.schema == docs.schema
    given = [(r[0], brute_print(r[1])) for r in odd_rows()]
    want = {c for c in brute_components(given) if c is not None}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_chain_is_joined_across_many_leaves(spark):
    """A hypercube path whose ends differ in most bits is one component."""
    keys = [(1 << i) - 1 for i in range(0, 63, 2)]
    roots = S.components(S.linked(spark.createDataFrame([(k,) for k in keys], "fp long"))).collect()
    assert len({r["root"] for r in roots}) == 1 and len(roots) == len(keys) - 1


def test_dense_prefixes_are_cut_further_down(spark, monkeypatch):
    """Keys that share their first 20 bits are dealt to several leaves and none of their links is lost."""
    monkeypatch.setattr(S, "LEAST_KEYS", 40)
    monkeypatch.setattr(S, "LEAF_KEYS", 40)
    rng = random.Random(3)
    keys = sorted({0xABCDE << 44 | rng.getrandbits(44) & 0xFFF000FF for _ in range(900)} | {rng.getrandbits(63) for _ in range(50)})
    frame = spark.createDataFrame([(k - (1 << 64) if k >> 63 else k,) for k in keys], "fp long")
    leaves = S._all_leaves(frame)
    spans = [(p << 64 - d, (p + 1) << 64 - d) for p, d in leaves]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert max(sum(a <= k < b for k in keys) for a, b in spans) <= 40 and all(any(a <= k < b for a, b in spans) for k in keys)
    got = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in S.components(S.linked(frame)).collect()}
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= S.MAX_BITS:
                x, y = sorted((find(a), find(b)), key=signed)
                root[y] = x
    assert {k: got.get(k, k) for k in keys} == {k: find(k) for k in keys}
