import random
import re
from collections import defaultdict

import compare
import pytest
from common_docs import DOCS, no_docs, odd_docs, odd_rows
from pyspark.sql import functions as F

from lexloom.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def share(budget, children, name):
    """Budget by weight, none above its cap; what full children leave goes to the others again."""
    got = {c: 0 for c in children}
    open_ = {c: w for c, (w, cap) in children.items() if w > 0 and cap > 0}
    left = min(budget, sum(children[c][1] for c in open_))
    while open_:
        total = sum(open_.values())
        full = [c for c, w in open_.items() if children[c][1] * total <= w * left]
        if not full:
            break
        for c in full:
            got[c] = children[c][1]
            left -= got[c]
            del open_[c]
    if open_:
        total = sum(open_.values())
        parts = {c: divmod(w * left, total) for c, w in open_.items()}
        over = left - sum(q for q, _ in parts.values())
        for i, c in enumerate(sorted(open_, key=lambda c: (-parts[c][1], c))):
            got[c] = parts[c][0] + (i < over)
    return got


def brute_budgets(leaves, total, max_epochs, weights):
    """leaves: (domain, lang, source) -> tokens."""
    weight = lambda level, x: weights[level].get(x, M.DEFAULT_WEIGHT)
    live = lambda leaf: all(weight(i, x) > 0 for i, x in enumerate(leaf))
    cap = {leaf: n * max_epochs if live(leaf) else 0 for leaf, n in leaves.items()}
    out = {}

    def down(prefix, budget):
        level = len(prefix)
        under = defaultdict(int)
        for leaf, c in cap.items():
            if leaf[:level] == prefix:
                under[leaf[level]] += c
        for child, part in share(budget, {x: (weight(level, x), c) for x, c in under.items()}, "").items():
            if level == 2:
                out[(*prefix, child)] = part
            else:
                down((*prefix, child), part)

    down((), total)
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("percent", [10, 60, 150, 400])
def test_budgets_are_those_of_brute_force(spark, seed, percent):
    rng = random.Random(seed)
    leaves = {(rng.choice("abc"), rng.choice("xyz"), f"s{rng.randrange(6)}"): rng.choice([0, 1, 7, 100, 5000, 123_456]) for _ in range(25)}
    weights = ({"a": 5, "b": 0 if seed == 1 else 2}, {"x": 7, "y": 1}, {"s0": 3, "s1": 0 if seed == 2 else 9})
    total = sum(leaves.values()) * percent // 100
    frame = spark.createDataFrame([(*k, n, 1) for k, n in leaves.items()], "__domain string, __lang string, __source string, tokens long, n_rows long")
    got = {tuple(r[c] for c in M.LEAF): r["alloc"] for r in M.leaf_budgets(frame, total, 2, weights).collect()}
    assert got == brute_budgets(leaves, total, 2, weights)


def test_rows_are_those_of_the_sql(spark, sf_dir):
    con = compare.duck(sf_dir)
    assert compare.differences(M.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")), con, M.ORACLE_SQL) == ""


def test_odd_rows_and_prefix(spark):
    rows = M.mix(odd_docs(spark)).collect()
    given = odd_rows()
    assert len(rows) == len(given)
    leaves, taken, full = defaultdict(int), defaultdict(int), {}
    for r in rows:
        leaf = (r["domain"], r["lang"], r["source"])
        leaves[leaf] += r["n_tokens"]
        taken[leaf] += r["tokens_taken"]
        full[leaf] = r["epochs"]
        assert r["tokens_taken"] == r["epochs"] * r["n_tokens"] + r["prefix_tokens"]
    assert sum(leaves.values()) == sum(len(WORD.findall(r[1] or "")) for r in given)
    want = brute_budgets(dict(leaves), sum(leaves.values()) * M.TARGET_PERCENT // 100, M.MAX_EPOCHS, M._WEIGHTS)
    assert dict(taken) == want
    for leaf in leaves:  # at most one document of a leaf is cut (repeated rows: each is a row)
        cut = [r for r in rows if (r["domain"], r["lang"], r["source"]) == leaf and 0 < r["prefix_tokens"] < r["n_tokens"]]
        assert len(cut) <= 1
    assert M.mix(no_docs(spark)).count() == 0


def test_small_buckets_choose_the_same(spark, monkeypatch, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(map(tuple, M.mix(docs).collect()))
    monkeypatch.setattr(M, "BUCKET_ROWS", 3)
    monkeypatch.setattr(M, "BROADCAST_LEAVES", 0)
    assert sorted(map(tuple, M.mix(docs).collect())) == want


def test_mixed_documents_hold_the_tokens_taken(spark):
    docs = odd_docs(spark)
    out = M.mixed_documents(docs)
    assert out.schema == docs.schema
    taken = M.mix(docs).groupBy("doc_id").agg(F.sum("tokens_taken").alias("n")).filter("n > 0")
    got = out.groupBy("doc_id").agg(F.sum(M.token_count(F.col("text"))).alias("n"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, taken.collect())))
    text = {r[0]: r[1] for r in odd_rows()}
    for r in out.collect():
        if r["doc_id"] is not None:
            assert text[r["doc_id"]].startswith(r["text"]) and r["text"]
    assert M.mixed_documents(no_docs(spark)).count() == 0


def test_no_python_on_the_main_path(spark, sf_dir):
    plan = M.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|BroadcastNestedLoop", plan)


def test_all_weights_zero(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "src1", 5, "", "", 0)], DOCS)
    rows = M.mix(docs, weights=({"web": 0}, {}, {})).collect()
    assert [r["tokens_taken"] for r in rows] == [0]
