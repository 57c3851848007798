import random
import re

import pytest
from common_docs import no_docs, odd_docs, odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import token_counts as T

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def greedy(word, starts, continuations, longest=40):
    at, n = 0, 0
    while at < len(word):
        table = continuations if at else starts
        end = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in table), None)
        if end is None:
            return 0
        at, n = end, n + 1
    return n


pieces = st.sets(st.text("abc", min_size=1, max_size=5), max_size=12)


@settings(max_examples=400, deadline=None)
@given(pieces, pieces, st.lists(st.text("abcd", min_size=1, max_size=14), max_size=8))
def test_automaton_counts_as_the_greedy_cut(starts, continuations, words):
    a = T.Automaton(starts, continuations)
    assert [a.count(w) for w in words] == [greedy(w, starts, continuations) for w in words]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_whole_vocabulary(name, sf_dir):
    import pyarrow.parquet as pq

    counter = T.Counter(P.path(name))
    starts, continuations = (T.word_piece_vocabulary if name.endswith("model") else T.bpe_vocabulary)(P.path(name))
    words = {w for t in pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist()[:60] for w in WORD.findall(t or "")}
    words = random.Random(1).sample(sorted(words), min(3000, len(words)))
    assert [counter.automaton.count(w) for w in words] == [greedy(w, starts, continuations) for w in words]


def test_odd_rows(spark):
    path = P.path("piece_bpe_32k.model")
    starts, continuations = T.word_piece_vocabulary(path)
    rows = T.token_counts(odd_docs(spark), path).collect()
    want = []
    for r in odd_rows():
        cuts = [greedy(w, starts, continuations) for w in WORD.findall(r[1] or "")]
        want.append(str((r[0], len(cuts), sum(c or 1 for c in cuts), cuts.count(0))))
    assert sorted(str(tuple(r)) for r in rows) == sorted(want)
    assert T.token_counts(no_docs(spark), path).count() == 0
