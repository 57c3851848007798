"""What larger tables showed: results on odd rows, and plans that keep bounded rows and few shuffles."""

import random
from collections import Counter
from pathlib import Path

import compare
import duckdb
import pyarrow as pa
import regex

from lexloom.functions import tokens
from lexloom.operators import chart, semantics
from lexloom.operators import mwe as M
from lexloom.plans import catalog, lattice_queries
from lexloom.plans.base import values


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def duck(path):
    """Views of folders of Parquet files."""
    con = duckdb.connect()
    for table in Path(path).glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM read_parquet('{table}/*.parquet')")
    return con


def odd_texts(spark, path, texts, benchmark=("Thing of the",)):
    """documents and benchmark with the given texts."""
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(benchmark)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), duck(path)


def test_rule_tables_are_of_known_size(spark):
    table = values(spark, [(1, ["of", "the"], {"a": "b"}), (2, None, None)], "k int, words array<string>, tags map<string,string>")
    assert [tuple(r) for r in table.collect()] == [(1, ["of", "the"], {"a": "b"}), (2, None, None)]
    assert table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10_000
    assert values(spark, [], "k int, word string").collect() == []


def test_phrases_meet_bounded_rows(spark, sf_dir):
    got = plan(catalog.QUERIES["token_trie"](spark, sf_dir))
    assert "BroadcastHashJoin" in got and "SortMergeJoin" not in got
    toks = spark.createDataFrame([(1, 1, ["In", "the", "end", "in"]), (1, 2, [])], "doc_id long, par_id int, toks array<string>")
    found = M.token_trie(toks, values(spark, [(1, ["in", "the"]), (2, ["in"]), (3, ["the", "end", "in", "it"]), (4, [])], "phrase_id int, words array<string>"))
    assert sorted(map(tuple, found.collect())) == [(1, 1, 1, 1), (1, 1, 2, 1), (1, 1, 2, 4)]
    assert M.token_trie(toks, values(spark, [], "phrase_id int, words array<string>")).collect() == []


def test_case_is_that_of_sql(spark, tmp_path):
    texts = ["ß ßen SS sS ssö ßöen İen ΟΔΟΣ ŉen ᾀ straßen Ss"]
    at, con = odd_texts(spark, tmp_path, texts, ("Ss ssö SSÖ STRASS straß οδοσ ΟΔΟΣ i ẞ ᾈ ʼN",))
    assert compare.differences(catalog.QUERIES["lemmatise_tokens"](spark, at), con, catalog.ORACLE_SQL["lemmatise_tokens"]) == ""


def test_interps_meet_rules_by_one_tag(spark, sf_dir, tmp_path):
    got = plan(catalog.QUERIES["tag_subset_interps"](spark, sf_dir))
    assert "SortAggregate" not in got and "hits" not in got  # nothing is counted for rules that stand once
    rows = [(1, "a", "b", 2), (1, "c", "d", 1), (2, "a", "b", 1), (3, "ab", "c", 2), (4, None, "c", 3), (5, "a", "bc", None), (None, "a", "b", 2), (6, "c", "d", 1), (6, "c", "d", 1)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert compare.differences(catalog.QUERIES["tag_subset_interps"](spark, str(tmp_path)), duck(tmp_path), catalog.ORACLE_SQL["tag_subset_interps"]) == ""


def test_equal_sentences_are_parsed_once(monkeypatch):
    calls = []
    monkeypatch.setattr(chart, "closure", lambda c, *more, f=chart.closure: calls.append(1) or f(c, *more))
    program, kept = chart._parse, {}
    more = {"keys": ["k"], "kept": kept, "root": chart.read("s"), "max_cost": 1, "timeout": 30.0, "pro": ()}
    words = {"lnode": [0, 1], "rnode": [1, 2], "orth": ["A", "N"], "category": ["np", "s\\np"]}
    one, two = (program({"k": [k, k]} | words, **more) for k in (1, 2))
    assert len(calls) == 1 and one["status"] == ["Parsed"] and one | {"k": [2]} == two
    assert program({"k": [3, 3]} | words | {"category": ["np", None]}, **more)["status"] == ["PartialParsed"] and len(calls) == 2


def test_sentences_are_read_once(spark, sf_dir):
    assert plan(catalog.QUERIES["chart_parse"](spark, sf_dir)).count("lineitem.parquet") == 1


def test_equal_terms_are_computed_once(spark):
    terms = spark.createDataFrame([(i, '{"a":%d}' % (i % 3)) for i in range(300)], "k int, term string").coalesce(1)
    seen = spark.sparkContext.accumulator(0)

    def f(text):
        seen.add(1)
        return (text, "ok")

    got = semantics.mapped(terms, "term", f, ("normal", "status")).collect()
    assert seen.value == 3 and all(r["normal"] == r["term"] for r in got) and len(got) == 300


def test_lattices_are_read_and_shuffled_once(spark, sf_dir):
    for name in ("lattice_renumber", "cutpoint_components"):
        got = plan(catalog.QUERIES[name](spark, sf_dir))
        assert got.count("lineitem.parquet") == 1 and got.count("Exchange hashpartitioning") == 1 and "Join" not in got
    assert "Join" not in plan(catalog.QUERIES["sentence_prepare"](spark, sf_dir))


def test_lattices_of_odd_lines(spark, tmp_path):
    lines = [(1, 1, "A", 0.0, 30.0), (1, 2, "N", 0.1, 30.0), (1, 2, "N", 0.1, 30.0), (1, 5, None, None, 30.0), (11, 2, "R", 0.0, None), (11, 1, "N", None, 1.0), (None, 1, "A", 0.0, 30.0), (2, None, "A", 0.0, 30.0), (3, 1, "N", 0.0, 10.0), (4, 3, "R", 0.0, 10.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string, l_discount double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("lattice_renumber", "cutpoint_components", "sentence_prepare", "lattice_reachable"):
        assert compare.differences(catalog.QUERIES[name](spark, str(tmp_path)), duck(tmp_path), catalog.ORACLE_SQL[name]) == "", name


def test_records_of_odd_parts(spark, sf_dir, tmp_path):
    got = plan(catalog.QUERIES["clarify_categories"](spark, sf_dir))
    assert "Exchange" not in got and "Aggregate" not in got
    parts = [(7 * k, name, size) for k, name, size in ((0, "Big x", 0), (1, "y", 6), (2, "Z", 1), (3, "u", 2), (3, "V", 3), (4, None, 6), (5, "w", 4), (5, "w", 4), (6, "q", 12), (7, "q", 18), (8, "r", 24), (9, "s", 30))]
    spark.createDataFrame([*parts, (1, "n", 5), (None, "n", 6)], "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert compare.differences(catalog.QUERIES["clarify_categories"](spark, str(tmp_path)), duck(tmp_path), catalog.ORACLE_SQL["clarify_categories"]) == ""


def edges_one_by_one(text):
    """Tokens of a paragraph by one match after another."""
    found = []
    for m in regex.finditer(tokens.TOKEN, text or ""):
        if m.group()[0] in " \t\r\n\f":
            if found:
                found[-1][-1] = 100 * (m.end() + 1)
        else:
            found.append([len(found) + 1, m.group(), 100 * (m.start() + 1), 100 * len(m.group()), 100 * (m.end() + 1)])
    return found


def test_tokens_of_columns_are_those_of_matches(monkeypatch):
    rng = random.Random(5)
    signs = "ab ß1٣½.,…\t 😀𝒜漢é́_ \f\n-  "
    texts = [None, "", " ", " a", "a ", "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x11000)])), *("".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(400)), None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array([None, *range(1, len(texts))], pa.int64()), pa.array(range(len(texts)), pa.int32()), pa.array(texts)], names=["doc_id", "par_id", "paragraph"])
    want = [[i or None, i, *e] for i, t in enumerate(texts) for e in edges_one_by_one(t)]
    for part, size in ((batch, 2_000_000), (batch, 50), (batch.slice(7, 300), 100)):
        monkeypatch.setattr(tokens, "CUT_BYTES", size)
        got = [list(r.values()) for b in tokens.edge_batches(part, slices=True) for r in b.to_pylist()]
        assert [g[:-1] for g in got] == [w for w in want if w[1] in set(part["par_id"].to_pylist())]
        assert all(g[-1] == g[3] for g in got)
    calls = []
    monkeypatch.setattr(tokens, "FACTOR", 100)
    monkeypatch.setattr(tokens, "_edges_of", lambda *a, f=tokens._edges_of: calls.append(1) or f(*a))
    monkeypatch.setattr(tokens, "CUT_BYTES", 2_000_000)
    list(tokens.edge_batches(batch))
    assert len(calls) == 1  # whole columns, not a step for each paragraph or token


TEXTS = ["the end. a. b. A.  x ..", "  of the and of the, and in the and de la ,\n\n . \n \t\n de la. z.", "A. of  the. B", "", None, "ß. éa. . x.y. of the", "and of the and of the and of the", "a.", "."]
BY_TEXT = ["token_edges", "sentence_split", "orth_concat", "text_slices", "mwe_bigrams", "mwe_fixpoint", "rule_preselect", "lattice_vocabulary"]


def test_texts_with_odd_paragraphs(spark, tmp_path):
    at, con = odd_texts(spark, tmp_path, TEXTS)
    for name in BY_TEXT:
        assert compare.differences(catalog.QUERIES[name](spark, at), con, catalog.ORACLE_SQL[name]) == "", name


def test_texts_of_one_id(spark, tmp_path):
    """Texts of one id share paragraphs: sets stay sets, each edge meets both texts, null is an id that joins with nothing."""
    rows = [(1, "a. of the x."), (1, "a. of the x."), (2, "of the and"), (None, "a. b."), (None, "a. b.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: Counter(r["doc_id"] for r in catalog.QUERIES[name](spark, str(tmp_path)).select("doc_id").collect())
    assert run("mwe_fixpoint") == {1: 7, 2: 4, None: 4}
    assert run("mwe_bigrams") == {1: 1, 2: 1}
    assert run("orth_concat") == {1: 1, 2: 1, None: 1}
    assert run("text_slices") == {1: 4 * 6, 2: 3}
    got = {tuple(r) for r in catalog.QUERIES["sentence_split"](spark, str(tmp_path)).filter("doc_id = 2 or doc_id is null").select("doc_id", "sentence", "n_edges").collect()}
    assert (2, 1, 3) in got


def test_texts_are_read_once(spark, sf_dir):
    for name, shuffles in (("sentence_split", 0), ("orth_concat", 0), ("text_slices", 0), ("mwe_bigrams", 4), ("mwe_fixpoint", 3)):
        got = plan(catalog.QUERIES[name](spark, sf_dir))
        assert got.count("documents.parquet") <= 2 - (name != "mwe_fixpoint") and got.count("Exchange hashpartitioning") <= shuffles and "SortMergeJoin" not in got, name


def test_large_rule_tables_give_the_same(spark, sf_dir, monkeypatch):
    edges = lattice_queries._mwe_edges(spark, sf_dir)
    rules, made = lattice_queries._rules(spark)
    few, one = (sorted(map(repr, f().collect())) for f in (lambda: M.grown(edges, rules, made, 4), lambda: M.produce(M.matches(edges, rules), made)))
    monkeypatch.setattr(M, "BROADCAST_RULES", 3)
    columns = ["doc_id", "par_id", "beg", "len", "nxt", "orth", "cat"]
    assert few and few == sorted(map(repr, M.grown(edges, rules, made, 4).select(columns).collect()))
    assert one == sorted(map(repr, M.produce(M.matches(edges, rules), made).collect()))
