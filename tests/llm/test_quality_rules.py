import random
import re

import pytest
from common_docs import DOCS, no_docs, odd_docs, odd_rows, prose

from lexloom.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    """The columns by comparing all pairs of places."""
    text = text or ""
    w = WORD.findall(text)
    n = len(w)
    out = {"n_words": n, "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text)}
    lines = text.split("\n")
    out["n_dup_lines"] = sum(1 for i, line in enumerate(lines) if WORD.search(line) and line in lines[:i])
    share = [[0] * (n + 1) for _ in range(n + 1)]
    best = [0] * n
    for i in range(n - 1, -1, -1):
        for j in range(n - 1, -1, -1):
            if i != j and w[i] == w[j]:
                share[i][j] = share[i + 1][j + 1] + 1
                best[i] = max(best[i], share[i][j])
    cover = lambda least, width: len({k for i in range(n) if best[i] >= least for k in range(i, i + (width or best[i]))})
    out["n_repeat_words"] = cover(5, 5)
    out["covered_words"] = cover(Q.MIN_REPEAT, 0)
    out["longest_repeat"] = max([b for b in best if b >= 5], default=0)
    out["base_failed"] = n < 10 or 100 * out["n_repeat_words"] > 20 * n
    long = out["longest_repeat"] > Q.MAX_LONGEST and 100 * out["longest_repeat"] > Q.MAX_LONGEST_PERCENT * n
    out["kept"] = not out["base_failed"] and 100 * out["covered_words"] <= Q.MAX_COVERED_PERCENT * n and not long
    return out


def texts(seed):
    rng = random.Random(seed)
    out = [None, "", "\n\n", "a\na\n \na b", "$ # x\x0by\x0cz\rw"]
    for _ in range(25):
        n = rng.randrange(1, 120)
        t = [rng.choice("abcde"[: rng.randrange(1, 6)]) + rng.choice(["", "", "1", "2"]) for _ in range(n)]
        if rng.random() < 0.5:
            i, k = rng.randrange(n), rng.randrange(1, 30)
            t[rng.randrange(n) : 0] = t[i : i + k]
        out.append("".join(x + rng.choice([" ", " ", "\n", "\t", "  "]) for x in t))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_measures_are_those_of_brute_force(seed):
    given = texts(seed)
    got = Q.measure(given)
    for i, text in enumerate(given):
        assert {k: v[i].item() for k, v in got.items()} == brute(text), text


def test_periodic_text_and_shared_passages_stay_in_their_document():
    rng = random.Random(3)
    passage = prose(rng, 80)
    given = [("ab cd " * 400), passage + " " + prose(rng, 300), passage + " x", "z " * 5000]
    got = Q.measure(given)
    assert got["longest_repeat"].tolist() == [798, 0, 0, 4999]
    assert got["n_repeat_words"].tolist() == [800, 0, 0, 5000]
    assert got["kept"].tolist() == [False, True, True, False]


def test_long_repeat_fails_by_the_method_alone():
    rng = random.Random(4)
    once = prose(rng, 700)
    passage = " ".join(once.split()[:60])
    got = Q.measure([once, once + " " + passage, once + " " + " ".join(once.split()[:8])])
    assert got["base_failed"].tolist() == [False, False, False]
    assert got["kept"].tolist() == [True, False, True]


def test_odd_rows_and_extra_columns(spark):
    rows = Q.quality_rules(odd_docs(spark)).collect()
    given = [r for r in odd_rows()]
    assert len(rows) == len(given)
    key = lambda k: (k is None, k or 0)
    want = sorted(((r[0], *(v.item() for v in (x[0] for x in Q.measure([r[1]]).values()))) for r in given), key=lambda r: (key(r[0]), r))
    assert sorted((tuple(r) for r in rows), key=lambda r: (key(r[0]), r)) == want
    assert Q.quality_rules(no_docs(spark)).count() == 0


def test_filter_keeps_all_columns(spark):
    docs = odd_docs(spark)
    kept = Q.quality_filter(docs)
    assert kept.schema == docs.schema
    want = [r for r in odd_rows() if Q.measure([r[1]])["kept"][0]]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, want))
    assert Q.quality_filter(spark.createDataFrame([], DOCS)).count() == 0
