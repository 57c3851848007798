"""Steps put together, edit distances and programs over masks, against brute force."""

import json
import math
import random
from functools import lru_cache
from itertools import chain, combinations

import pytest

from lexloom.operators import assembly as A
from lexloom.operators import fuzzy as Z
from lexloom.operators import mwe as M
from lexloom.operators import semantics as S


def brute_cost(observed, correct, cost):
    """Least cost over every way to take letters from the right."""

    @lru_cache(None)
    def best(i, j):
        if not i and not j:
            return 0.0
        found = [math.inf]

        def step(op, di, dj):
            price = cost(op, observed[i - di : i], correct[j - dj : j])
            if price is not None:
                found.append(price + best(i - di, j - dj))

        if i:
            step("insert", 1, 0)
        if j:
            step("delete", 0, 1)
        if i and j:
            step("accept" if observed[i - 1] == correct[j - 1] else "substitute", 1, 1)
        if i > 1 and j > 1 and observed[i - 2 : i] == correct[j - 2 : j][::-1] and observed[i - 1] != observed[i - 2]:
            step("transpose", 2, 2)
        return min(found)

    return best(len(observed), len(correct))


@pytest.mark.parametrize("kind", ["unit", "restricted", "probabilistic"])
def test_alignment_costs_least(kind):
    rng = random.Random(11)
    for _ in range(400):
        a, b = ("".join(rng.choice("abą1 ") for _ in range(rng.randrange(8))) for _ in range(2))
        got, script = Z.align(a, b, Z._COSTS[kind])
        assert got == pytest.approx(brute_cost(a, b, Z._COSTS[kind]))
        assert "".join(x for _, x, _ in script) == a and "".join(y for _, _, y in script) == b


def test_restricted_distance_of_pairs(spark):
    rows = [("ab1", "ab2"), ("ab", "ba"), ("a b", "ab"), ("", "x")]
    got = {(r["observed"], r["correct"]): r["cost"] for r in Z.aligned(spark.createDataFrame(rows, "observed string, correct string"), "restricted").collect()}
    assert got == {p: brute_cost(*p, Z.restricted_cost) for p in rows} and got["ab1", "ab2"] == 2


def test_assembled_records_cover_most(spark):
    rng = random.Random(3)
    rows = []
    for segment in range(60):
        for e in range(rng.randrange(1, 8)):
            b = rng.randrange(12)
            rows.append((segment, 1, segment, e, b, b + rng.randrange(1, 6), rng.randrange(3)))
    schema = "doc_id int, par_id int, segment int, edge_id int, beg int, nxt int, grp int"
    got = {}
    for r in M.assemble(spark.createDataFrame(rows, schema)).collect():
        got.setdefault(r["segment"], []).append(r)
    for segment in range(60):
        own = [r for r in rows if r[2] == segment]
        fit = lambda c: len({r[6] for r in c}) == len(c) and all(x[5] <= y[4] or y[5] <= x[4] for x, y in combinations(c, 2))
        most = max(sum(r[5] - r[4] for r in c) for c in chain.from_iterable(combinations(own, k) for k in range(len(own) + 1)) if fit(c))
        chosen = [tuple(r) for r in got.get(segment, [])]
        assert fit(chosen) and sum(r[5] - r[4] for r in chosen) == most


def test_common_relations_are_factored_out():
    v = lambda *r: {"concept": "c", "relations": [list(x) for x in r]}
    got = S.simplify({"variant": [v(("a", 1), ("b", 2)), v(("a", 1), ("b", 3))]})
    assert got == {"concept": "c", "relations": [["", {"variant": [{"relations": [["b", 2]]}, {"relations": [["b", 3]]}]}], ["a", 1]]}
    apart = {"variant": [v(("a", 1)), {"concept": "d", "relations": [["a", 1]]}]}
    assert json.loads(S.text_of(S.simplify(apart)))["variant"] and S.simplify({"variant": [v(("a", 1)), v(("a", 1))]}) == v(("a", 1))


def test_fewest_arguments_are_kept():
    few, many = {"concept": "x", "relations": [["a", {"concept": "y"}]]}, {"concept": "x", "relations": [["a", {"concept": "y"}], ["b", {"concept": "z"}]]}
    assert S.fewest_arguments({"variant": [many, few]}) == (1, few)


def test_dependency_trees_combine_bottom_up(spark):
    rows = [
        (1, 1, 2, "np/n"), (1, 2, 3, "n"), (1, 3, 0, "s\\np"),  # the determiner below its noun
        (2, 1, 3, "np"), (2, 2, 3, "np"), (2, 3, 0, "s\\np"),  # one argument too many
        (3, 1, 2, "np"), (3, 2, 1, "s\\np"),  # a cycle
        (4, 1, 0, "np"),  # not a sentence
        (5, 1, 2, "np"), (5, 2, 0, "(s\\np)/np"), (5, 3, 2, "np"),
    ]
    got = {r["k"]: (r["status"], r["failed_at"]) for r in A.dependency_parsed(spark.createDataFrame(rows, "k int, node int, head int, category string"), ["k"]).collect() if r["k"] != 3}
    assert got[1][0] == "Parsed" and got[2] == ("NotDepParsed", 3) and got[4] == ("NotDepParsed", None) and got[5] == ("Parsed", None)


def test_trees_and_cycles(spark):
    rows = [(1, "a", None, "A"), (1, "b", "a", "B"), (1, "c", "a", "C"), (1, "d", "b", "D"), (2, "x", "y", "X"), (2, "y", "x", "Y"), (2, "z", None, "Z")]
    got = {r["k"]: (r["tree"], r["n_nodes"], r["status"]) for r in A.assembled(spark.createDataFrame(rows, "k int, node string, parent string, label string"), ["k"]).collect()}
    assert got == {1: ("A(B(D),C)", 4, "ok"), 2: ("Z", 1, "cycle: 2 nodes")}


def test_lemmatised_sequences_take_the_worst_part_and_tokens_the_best_alternative(spark):
    parts = [("t1", 0, 0, "Foobar"), ("t1", 1, 0, "foo"), ("t1", 1, 1, "BAR"), ("t2", 0, 0, "none"), ("t3", 0, 0, "foo"), ("t3", 1, 0, "foobar")]
    lexicon = [("foo", "foo", "n", 1), ("foo", "fo", "v", 1), ("bar", "bar", "n", 2), ("foobar", "foobar", "n", 3), ("Foobar", "Foobar", "p", 4)]
    got = {(r["token"], r["alt"], r["part"], r["lemma"], r["flag"]) for r in A.lemmatised(spark.createDataFrame(parts, "token string, alt int, part int, orth string"), spark.createDataFrame(lexicon, "orth string, lemma string, interp string, priority int"), ["token"]).collect()}
    assert got == {("t1", 1, 0, "foo", "ok"), ("t1", 1, 0, "fo", "ok"), ("t1", 1, 1, "bar", "ok"), ("t2", 0, 0, "none", "TokNotFound"), ("t3", 0, 0, "foo", "ok"), ("t3", 0, 0, "fo", "ok")}


def test_a_stream_goes_on_in_a_new_process(tmp_path):
    """Two processes, each with hash seeds of its own, over a growing folder: no result comes twice or is lost."""
    import subprocess
    import sys
    from pathlib import Path

    code = """
import sys
from pyspark.sql import SparkSession
base = sys.argv[1]
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", f"file://{base}/shared").getOrCreate()
from lexloom.streaming import requests
s.range(int(sys.argv[2]), int(sys.argv[2]) + 10).coalesce(1).write.mode("append").parquet(f"{base}/in")
stream = s.readStream.schema("id long").parquet(f"{base}/in")
requests.process(stream, lambda b: b, f"{base}/out").awaitTermination()
"""
    root = str(Path(__file__).resolve().parent.parent)
    for start in ("0", "10"):
        subprocess.run([sys.executable, "-c", code, str(tmp_path), start], check=True, cwd=root, timeout=200, capture_output=True)
    ids = [json.loads(line)["id"] for f in tmp_path.glob("out/batch=*/*.json") for line in f.read_text().splitlines()]
    assert sorted(ids) == list(range(20)) and len(list(tmp_path.glob("out/batch=*"))) == 2
