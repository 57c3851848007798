"""Every stage on what the one before it left, against the operators' own brute-force parts."""

import re
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as P  # noqa: E402
from common_docs import DOCS, no_docs, odd_rows  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from lexloom.llm import decontaminate, mixing, quality_rules, queries, simhash  # noqa: E402
from lexloom.llm.mixing import token_count  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = tuple((r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect())
    stages = dict(P.STAGES)
    assert list(stages) == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "mixing_to_weights", "token_binary_output"]
    rows = docs.collect()
    kept = quality_rules.measure([r["text"] for r in rows])["kept"]
    want = {r["doc_id"] for r, k in zip(rows, kept) if k}
    one = stages["quality_rules"](spark, docs, sf_dir).cache()
    assert {r["doc_id"] for r in one.collect()} == want and one.columns == docs.columns

    prints = [(r["doc_id"], simhash.fingerprint(r["text"])) for r in one.collect()]
    root = {k: k for k, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(prints):
        for b, y in prints[:i]:
            if (x ^ y).bit_count() <= simhash.MAX_BITS and find(a) != find(b):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    two = stages["simhash_near_dedup"](spark, one, sf_dir).cache()
    assert {r["doc_id"] for r in two.collect()} == {find(k) for k, _ in prints} and two.columns == docs.columns

    find_items = decontaminate.Searcher(bench)
    three = stages["benchmark_decontamination"](spark, two, sf_dir).cache()
    assert {r["doc_id"] for r in three.collect()} == {r["doc_id"] for r in two.collect() if next(find_items.hits(r["text"]), None) is None}

    four = stages["mixing_to_weights"](spark, three, sf_dir).cache()
    total = sum(len(WORD.findall(r["text"])) for r in three.collect())
    assert four.columns == docs.columns and four.select(token_count(four["text"]).alias("n")).groupBy().sum("n").first()[0] <= total * 60 // 100

    taken = mixing.mix(three).groupBy("doc_id").agg(F.sum("tokens_taken").alias("n")).filter("n > 0")
    assert sorted(map(tuple, four.groupBy("doc_id").agg(F.sum(token_count(four["text"]))).collect())) == sorted(map(tuple, taken.collect()))

    five = stages["token_binary_output"](spark, four, sf_dir).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.word_bpe())
    want = sorted((r["doc_id"], zlib.crc32(np.array([*t.encode(r["text"], add_special_tokens=False).ids, 1], "<u4").tobytes())) for r in four.collect())
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in five) == want


def test_run_is_the_stages_in_a_row(spark, sf_dir):
    rows = P.run(spark, sf_dir).collect()
    assert rows and {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(rows[0].asDict())


@pytest.fixture(scope="module")
def odd(spark, sf_dir):
    """Odd rows, a text of 2 MB, a repeated benchmark item within words, the item as a short text."""
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    rows = odd_rows()
    extra = ["mit license " * 170_000, f"one two three {item} four five six", f"one two three {item} four five six", item]
    rows += [(200 + i, t, "en", "src9", len(t), "k", "f", 7) for i, t in enumerate(extra)]
    return rows


def stage_of(spark, rows, sf_dir, name):
    docs = spark.createDataFrame(rows, DOCS)
    out = dict(P.STAGES)[name](spark, docs, sf_dir)
    assert name == "token_binary_output" or out.schema == docs.schema
    return out.collect()


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_quality_on_odd_rows(spark, sf_dir, odd):
    kept = quality_rules.measure([r[1] for r in odd])["kept"]
    assert in_order(stage_of(spark, odd, sf_dir, "quality_rules")) == in_order(r for r, k in zip(odd, kept) if k)


def test_near_dedup_on_odd_rows(spark, sf_dir, odd):
    prints = [simhash.fingerprint(r[1]) for r in odd]
    group = list(range(len(odd)))
    for i, x in enumerate(prints):
        for j, y in enumerate(prints[:i]):
            if (x ^ y).bit_count() <= simhash.MAX_BITS and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    ids = {}
    for r, g in zip(odd, group):
        ids.setdefault(g, []).append(r[0])
    want = [min(x for x in found if x is not None) for found in ids.values() if any(x is not None for x in found)]
    assert len(want) == len(ids)  # no group of rows without an id here
    got = stage_of(spark, odd, sf_dir, "simhash_near_dedup")
    assert sorted(r["doc_id"] for r in got) == sorted(want) and {tuple(r) for r in got} <= set(odd)


def test_decontamination_on_odd_rows(spark, sf_dir, odd):
    bench = tuple((r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect())
    find = decontaminate.Searcher(bench)
    want = [r for r in odd if next(find.hits(r[1]), None) is None]
    assert {r[0] for r in odd} - {r[0] for r in want} == {201, 202, 203}
    assert in_order(stage_of(spark, odd, sf_dir, "benchmark_decontamination")) == in_order(want)


def test_mixing_on_odd_rows(spark, sf_dir, odd):
    got = stage_of(spark, odd, sf_dir, "mixing_to_weights")
    taken = {}
    for r in mixing.mix(spark.createDataFrame(odd, DOCS)).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["tokens_taken"]
    found = dict.fromkeys(taken, 0)
    for r in got:
        found[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert any(r["text"] == t or t and t.startswith(r["text"]) for i, t, *_ in odd if i == r["doc_id"])
    assert found == taken and sum(found.values()) > 0


def test_token_files_on_odd_rows(spark, sf_dir, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.word_bpe())
    ids = [[*t.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in odd]
    want = sorted(((r[0], len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, x in zip(odd, ids)), key=str)
    got = stage_of(spark, odd, sf_dir, "token_binary_output")
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


@pytest.mark.parametrize("name", [name for name, _ in P.STAGES])
def test_stages_on_no_rows_and_on_nulls(spark, sf_dir, name):
    assert dict(P.STAGES)[name](spark, no_docs(spark), sf_dir).count() == 0
    got = stage_of(spark, [(None,) * 8] * 3, sf_dir, name)
    assert len(got) == {"simhash_near_dedup": 3, "benchmark_decontamination": 3, "token_binary_output": 3}.get(name, 0)


def test_run_on_a_folder_without_rows(spark, sf_dir, tmp_path):
    for table in ("documents", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
