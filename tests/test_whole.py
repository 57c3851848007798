"""Queries over all of their input: against brute force, or SQL without a filter."""

import random
from collections import Counter, defaultdict
from hashlib import md5
from html import escape
from itertools import product

import compare

from lexloom.operators import fuzzy
from lexloom.plans import catalog, lattice_queries
from lexloom.plans.text_queries import PARS


def places(con):
    """Of each order the flags that may stand at each place."""
    found = defaultdict(lambda: defaultdict(set))
    for order, line, flag in con.execute("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem").fetchall():
        found[order][line].add(flag)
    return {order: [flags for _, flags in sorted(lines.items())] for order, lines in found.items()}


def test_every_order_is_parsed(spark, sf_dir):
    orders = places(compare.duck(sf_dir))
    got = {r["l_orderkey"]: r["n_tokens"] for r in catalog.QUERIES["chart_parse"](spark, sf_dir).select("l_orderkey", "n_tokens").collect()}
    assert got == {order: len(w) for order, w in orders.items()}


def test_accepted_orders_are_those_of_the_whole_table(spark, sf_dir):
    language = {"ARA", "ANRA", "ARAN", "ANRAN"}
    want = Counter(len(w) for w in places(compare.duck(sf_dir)).values() if len(w) <= 5 and language & set(map("".join, product(*w))))
    assert {r["n_tokens"]: r["n"] for r in catalog.QUERIES["chart_accepts"](spark, sf_dir).collect()} == want


def test_distance_up_to_a_limit_is_that_of_the_whole_matrix():
    rng = random.Random(7)
    for _ in range(1500):
        a = [rng.choice("abc") for _ in range(rng.randrange(14))]
        b = a[:] if rng.random() < 0.7 else [rng.choice("abc") for _ in range(rng.randrange(14))]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(3)] = [rng.choice("abc") for _ in range(rng.randrange(3))]
        a, b = "".join(a), "".join(b)
        edits = fuzzy.align(a, b)[0]
        assert [fuzzy.within(a, b, k) for k in range(7)] == [edits <= k for k in range(7)]


def test_turns_of_every_length_are_aligned(spark, tmp_path):
    lines = [(1, 0, "user", "a" * 300 + "e"), (1, 1, "assistant", None), (2, 0, "user", "e" * 25), (2, 1, "user", "short e")]
    spark.createDataFrame(lines, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["time"], r["speaker"], r["observed"], r["correct"]) for r in catalog.QUERIES["transcript_alignment"](spark, str(tmp_path)).collect()}
    assert got == {("1", "user", "a" * 300 + "ee", "a" * 300 + "e"), ("1", "assistant", "", ""), ("2", "user", "short ee", "short e")}


def test_cover_takes_the_longest_edge_and_jumps_over_it(spark, sf_dir):
    edges = defaultdict(list)
    for par, *edge in compare.duck(sf_dir).execute(lattice_queries.LATTICE + "SELECT par, beg, nxt, orth FROM lat").fetchall():
        edges[par].append(edge)
    want = []
    for par, own in edges.items():
        at = 0
        while left := [e for e in own if e[0] >= at]:
            beg = min(e[0] for e in left)
            at = max(e[1] for e in left if e[0] == beg)
            want.append((par, beg, at, min(e[2] for e in left if e[:2] == [beg, at])))
    assert any(nxt > beg + 1 for _, beg, nxt, _ in want)
    assert sorted(map(tuple, catalog.QUERIES["greedy_cover"](spark, sf_dir).select("par", "beg", "nxt", "orth").collect())) == sorted(want)


def test_short_paragraphs_are_marked(spark, sf_dir, tmp_path):
    spark.createDataFrame([(-1, "a&\nabcde\nabcdef\nabcd<fghi&\nabcdefghij<")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for at in (str(tmp_path), sf_dir):
        want = set()
        for doc, par, text in compare.duck(at).execute(f"SELECT doc_id, par_id, paragraph FROM ({PARS})").fetchall() if at == sf_dir else [(-1, i, t) for i, t in enumerate(["a&", "abcde", "abcdef", "abcd<fghi&", "abcdefghij<"], 1)]:
            head, span, rest = (escape(x, quote=False) for x in (text[:5], text[5:10], text[10:]))
            html = f'{head}<span class="HEAD">{span}</span>{rest}' if span else head
            want.add((doc, par, md5(html.encode()).hexdigest()))
        assert {tuple(r) for r in catalog.QUERIES["marked_html"](spark, at).collect()} == want
