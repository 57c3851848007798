import random

from common_docs import no_docs, odd_docs, odd_rows, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import decontaminate as D

ITEMS = "item_id long, text string, key string"


def brute_distance(pattern, text):
    """Least word edit distance of the pattern to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def brute(items, text):
    found = {}
    words = D.normal(text).split()
    for item_id, item in items:
        pattern = D.normal(item).split()
        if pattern:
            d = brute_distance(pattern, words)
            if d <= int(D.MAX_ERROR_RATE * len(pattern) + 1e-9):
                found[item_id] = d
    return found


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=80), st.lists(st.sampled_from("abcd"), max_size=60))
def test_bit_parallel_distance(pattern, text):
    assert D.myers(pattern, text)[0] == brute_distance(pattern, text)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = "changed"
        elif kind == 1:
            words.insert(at, "added")
        elif len(words) > 1:
            del words[at]
    return words


def test_hits_are_those_of_brute_force():
    rng = random.Random(9)
    items = [(i, prose(rng, rng.randrange(1, 40))) for i in range(30)]
    items += [(30, "a a a a a a a a a a"), (31, "a b a b a b a b a b a"), (32, None), (33, "")]
    find = D.Searcher(tuple((k, t) for k, t in items if t is not None))
    for _ in range(120):
        text = prose(rng, rng.randrange(0, 60)).split()
        for _ in range(rng.randrange(3)):
            item = (rng.choice(items)[1] or "a").split()
            at = rng.randrange(len(text) + 1)
            text[at:at] = edited(rng, item, rng.randrange(0, 1 + len(item) // 4))
        flat = rng.choice([" ", ", ", "\n"]).join(text).upper()
        got = {k: (d, a, b) for k, d, _, a, b in find.hits(flat)}
        assert {k: v[0] for k, v in got.items()} == brute([x for x in items if x[1]], flat)
        words = D.normal(flat).split()
        for k, (d, a, b) in got.items():  # the place given holds the item at that distance
            assert brute_distance(D.normal(dict(items)[k]).split(), words[a : b + 1]) == d


def test_leaks_and_clean(spark):
    rng = random.Random(2)
    texts = [r[1] for r in odd_rows(random.Random(5))]
    items = [(1, " ".join(texts[8].split()[10:30]), "x"), (2, prose(rng, 12), "x"), (3, None, "x"), (4, "Stop, now then?", "x"), (5, " .", "x"), (1, " ".join(texts[8].split()[10:30]), "x"), (None, " ".join(texts[10].split()[4000:4020]), "x")]
    docs, bench = odd_docs(spark), spark.createDataFrame(items, ITEMS)
    got = D.leaks(docs, bench).collect()
    assert sorted((str(r["doc_id"]), str(r["item_id"])) for r in got) == [("10", "None"), ("7", "4"), ("8", "1"), ("8", "1")]
    left = D.clean(docs, bench)
    assert left.schema == docs.schema and left.count() == docs.count() - 4
    assert not {7, 8, 10} & {r["doc_id"] for r in left.collect()}
    empty = spark.createDataFrame([], ITEMS)
    assert D.leaks(docs, empty).count() == 0 and D.clean(docs, empty).count() == docs.count()
    assert D.leaks(no_docs(spark), bench).count() == 0 and D.clean(no_docs(spark), bench).count() == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs = odd_docs(spark)
    rng = random.Random(1)
    texts = [r[1].split() for r in odd_rows(random.Random(5)) if r[1] and len(r[1].split()) > 30]
    bench = spark.createDataFrame([(i, " ".join(edited(rng, t[5:25], 2)), "x") for i, t in enumerate(texts)], ITEMS)
    want = sorted(map(tuple, D.leaks(docs, bench).fillna(-1).collect()))
    monkeypatch.setattr(D, "BLOCK_CHARS", 2500)
    assert sorted(map(tuple, D.leaks(docs, bench).fillna(-1).collect())) == want and want
    find = D.Searcher(tuple((r["item_id"], r["text"]) for r in bench.collect()))
    left = [r[0] for r in odd_rows() if next(find.hits(r[1]), None) is None]
    assert sorted(map(str, (r["doc_id"] for r in D.clean(docs, bench).collect()))) == sorted(map(str, left))
