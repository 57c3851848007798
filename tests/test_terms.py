"""Parsing, JSON laws, rewriting and phonetics against brute force and the laws themselves."""

import json
import random
from fractions import Fraction
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.operators import chart as C
from lexloom.operators import phonetics as P
from lexloom.operators import semantics as S

LEXICON = {"d": ["np/n"], "n": ["n"], "v": ["(s\\np)/np", "s\\np"], "c": ["conj"], "p": ["(np\\np)/np"]}


def brute_parses(words):
    """Categories derivable at cost 0 by trying every bracketing."""
    if len(words) == 1:
        return {C.read(x) for x in LEXICON[words[0]]}
    found = set()
    for cut in range(1, len(words)):
        for a, b in product(brute_parses(words[:cut]), brute_parses(words[cut:])):
            found |= {cat for _, cost, cat in C.combine(a, b) if cost == 0}
    return found


def test_chart_finds_what_every_bracketing_finds():
    rng = random.Random(4)
    for _ in range(120):
        words = [rng.choice("ddnnvcp") for _ in range(rng.randrange(1, 7))]
        chart = {}
        for i, w in enumerate(words):
            for x in LEXICON[w]:
                chart.setdefault((i, i + 1, 0), {})[C.read(x)] = [("lex", w)]
        C.closure(chart, len(words), 0)
        assert set(chart.get((0, len(words), 0), ())) == brute_parses(words)


@pytest.mark.parametrize("text", ["a", "a{x.y}", "(a\\b)/c", "a/(b/c)", "a/b\\c"])
def test_categories_read_back(text):
    assert C.read(str(C.read(text))) == C.read(text)


@pytest.mark.parametrize("text", ["", "/a", "a/", "(a", "a)", "a b)"])
def test_bad_categories(text):
    with pytest.raises((ValueError, IndexError)):
        C.read(text)


def test_features_unify_by_overlap():
    u = lambda a, b: str(C.unify(C.read(a), C.read(b)))
    assert u("np{sg.pl}", "np{sg}") == "np{sg}" and u("np", "np{sg}") == "np{sg}" and u("np{sg}", "np{pl}") == "None" and u("*", "np") == "np"


def test_statuses(spark):
    rows = [(1, 0, 1, "the", "np/n"), (1, 1, 2, "dog", "n"), (1, 2, 3, "runs", "s\\np"), (2, 0, 1, "the", "np/n"), (2, 1, 2, "x", None), (3, 0, 1, "y", None), (4, 0, 1, "z", "np/(")]
    got = {r["k"]: r for r in C.parse(spark.createDataFrame(rows, "k int, lnode int, rnode int, orth string, category string"), ["k"]).collect()}
    assert [got[k]["status"].split(":")[0] for k in (1, 2, 3, 4)] == ["Parsed", "PartialParsed", "NotParsed", "ParseError"]
    assert got[1]["tree"] == "((the dog) runs)" and got[1]["n_trees"] == 1
    many = [(5, i, i + 1, "w", "a/a") for i in range(12)] + [(5, 12, 13, "w", "a")]
    late = C.parse(spark.createDataFrame(many, "k int, lnode int, rnode int, orth string, category string"), ["k"], "a", timeout=0.0).first()
    assert late["status"] == "ParseTimeout"


terms = st.recursive(
    st.sampled_from([{}, "x", "y", {"contradiction": True}]),
    lambda t: st.one_of(st.dictionaries(st.sampled_from("abc"), t, max_size=2), st.builds(lambda op, xs: {op: xs}, st.sampled_from(S.OPERATORS), st.lists(t, max_size=3))),
    max_leaves=8,
)


@settings(max_examples=300, deadline=None)
@given(terms)
def test_normal_form_is_stable_and_json(term):
    text, status = S.normalise(json.dumps(term))
    assert status in ("ok", "contradiction")
    if status == "ok":
        again, _ = S.normalise(text)
        third, _ = S.normalise(again)
        assert third == S.normalise(again)[0] and json.loads(text) is not None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["x", "y", "z", {}]), max_size=4), st.randoms())
def test_order_and_repeats_do_not_matter(items, rng):
    mixed = items + items[:1]
    rng.shuffle(mixed)
    for op in ("with", "and", "or"):
        assert S.normalise(json.dumps({op: items})) == S.normalise(json.dumps({op: mixed}))


def test_laws():
    n = lambda t: json.loads(S.normalise(json.dumps(t))[0])
    assert n({"with": [{"with": ["x", "y"]}, "x"]}) == {"with": ["x", "y"]} and n({"and": [{}, "x"]}) == "x" and n({"or": []}) == {}
    assert n({"list": ["x", "x", {}]}) == {"list": ["x", "x"]}
    assert n({"and": [{"a": "1"}, {"b": "2"}]}) == {"a": "1", "b": "2"}
    assert n({"with": [{"a": "1", "b": "2"}, {"a": "1", "b": "3"}]}) == {"and": [{"a": "1"}, {"with": [{"b": "2"}, {"b": "3"}]}]}
    assert n({"multiply": ["2,5", "4"]}) == "10" and n({"ten-power": ["-2"]}) == "0.01" and n({"concat": ["a", "b"]}) == "ab" and n({"add": ["1", "x"]}) == {"add": ["1", "x"]}
    assert S.normalise("{") == (None, "not json") and S.normalise(None) == (None, "null") and S.normalise('{"a":{"contradiction":true}}')[1] == "contradiction"


@settings(max_examples=200, deadline=None)
@given(st.fractions(max_denominator=1000))
def test_numbers_stay_exact(x):
    assert Fraction(S._number_text(x)) == x


def test_rewriting_ends_or_fails():
    rules = [(1, {"cat": "A"}, {"cat": "B", "roles": {}})]
    assert S.rewrite({"cat": "A", "relations": []}, rules)["cat"] == "B"
    loop = [(1, {"cat": "A"}, {"cat": "A", "roles": {}})]
    with pytest.raises(ValueError):
        S.rewrite({"cat": "A", "relations": []}, loop)
    both = S.lift_variants({"cat": "A", "relations": [["r", {"variant": [{"cat": "x"}, {"cat": "y"}]}]]})
    assert len(both["variant"]) == 2
    cost, kept = S.fewest_arguments({"variant": [{"cat": "a", "relations": [["r", {"cat": "b"}]]}, {"cat": "c"}]})
    assert cost == 0 and kept == {"cat": "c"}


def test_components_of_cycles_and_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (200, 200)]
    got = {r["node"]: r["component"] for r in S.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200}


def test_derivations():
    rules = [("a", "", "1"), ("a", "", "2"), ("ab", "", "3"), ("b", "c", "4")]
    assert P.derivations("aa", rules) == ["11", "12", "21", "22"]
    assert P.derivations("ab", rules) == ["3"] and P.derivations("bc", rules) == ["4c"] and P.derivations("b", rules, keep_unknown=False) == []
    assert P.derivations("", rules) == [""]
