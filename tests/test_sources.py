"""Text sources, rule languages, sinks, streams and grouped programs."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import fuzzy, lattice, mwe
from lexloom.operators.grouped import by_key
from lexloom.sources import rules, sinks, text
from lexloom.streaming import requests


def test_dictionaries(spark, tmp_path):
    with gzip.open(tmp_path / "d.tab.gz", "wt") as f:
        f.write("domu\tdom\tsubst:sg:gen:m3\nkota\tkot\tsubst:sg:gen:m2\n")
    assert sorted(r["lemma"] for r in text.dictionary(spark, str(tmp_path / "d.tab.gz")).collect()) == ["dom", "kot"]
    (tmp_path / "rules.dic").write_text("@A\nx\t1\n# note\n@B\ny\t2\nz\t3\n")
    got = text.rule_sections(spark, str(tmp_path / "rules.dic"), ["find", "n"]).collect()
    assert sorted(map(tuple, got)) == [("A", "x", "1"), ("B", "y", "2"), ("B", "z", "3")]
    (tmp_path / "p.xml").write_text('<project name="p"><subcorpus name="a"><id>1</id><id>2</id></subcorpus></project>')
    assert text.xml_project(spark, str(tmp_path / "p.xml")).count() == 2
    (tmp_path / "c.json").write_text('[{"text":"a"},{"text":"b"}]')
    assert text.json_corpus(spark, str(tmp_path / "c.json")).count() == 2
    with pytest.raises(Exception, match="not a name"):
        text.named_paragraphs(spark.createDataFrame([("a\tb\tc",)], "line string")).collect()


def test_rule_languages(spark):
    got = rules.phrases(spark, "a b\tab\tsubst\n# c\nx\ty\tz\texact-case\n").collect()
    assert [(r["words"], r["exact_case"]) for r in got] == [(["a", "b"], False), (["x"], True)]
    with pytest.raises(rules.RuleError, match="line 1.*line 3"):
        rules.phrases(spark, "bad\na\tb\tc\na\tb\tc\tsometimes\n")
    slots, made = rules.patterns(spark, "%day %nsp . %month\t%concat(date)[1;3]\n^city the *\tx\n")
    assert [tuple(r) for r in slots.orderBy("rule_id", "slot").collect()][:3] == [(1, 1, "mode", "day", None, None), (1, 2, "orth", ".", None, "nsp"), (1, 3, "mode", "month", None, None)]
    assert [tuple(r) for r in made.orderBy("rule_id").collect()] == [(1, "concat", "date", [1, 3]), (2, "literal", "x", [])]
    with pytest.raises(rules.RuleError, match="beyond slot"):
        rules.patterns(spark, "a b\t%concat(x)[3]\n")
    frames = rules.valence(spark, "@ROLES\nx\n@LEXICON\nlemma=dom, pos=subst: place: subj[Theme]>!{np;pp} + obj{np}\n").collect()
    assert frames[0]["lemma"] == "dom" and [p["necessity"] for p in frames[0]["positions"]] == ["required", "pro"] and frames[0]["positions"][0]["phrases"] == ["np", "pp"]
    g = rules.grammar(spark, "@LEXICON\npos=subst: np : 1.5\nlemma=x, pos=adv, case!=nom|acc: s\\s\n").collect()
    assert [(r["lemma"], r["category"], r["weight"]) for r in g] == [(None, "np", 1.5), ("x", "s\\s", 0.0)]
    assert rules.inference_rules('{"cat":"A"} => {"cat":"B"}, 2\n{"cat":"B"} => {"cat":"C"}, 1\n')[0][0] == 1
    assert rules.coercions(spark, "A\tB\thas:C:d\n").first()["path"][0]["cat"] == "C"


def test_sinks_and_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a"<&', "noun"), (2, "b", "verb")], "id int, orth string, cat string")
    assert sinks.as_xml(rows, ["id"], "e").orderBy("id").first()["xml"] == '<e orth="a&quot;&lt;&amp;" cat="noun"/>'
    sinks.by_class(rows, str(tmp_path / "out"), F.col("cat"), F.col("orth"))
    assert (tmp_path / "out" / "class=noun").is_dir() and spark.read.text(str(tmp_path / "out" / "class=verb")).first()[0] == "b"
    for i in range(3):
        rows.withColumn("part", F.lit(i)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = requests.file_stream(spark, str(tmp_path / "in"), 1)
    query = requests.process(stream, lambda b: b.withColumn("status", F.when(F.col("id") == 1, "ok").otherwise("bad")), str(tmp_path / "json"), only_ok=True, checkpoint=str(tmp_path / "cp"))
    query.awaitTermination()
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    again = requests.process(requests.file_stream(spark, str(tmp_path / "in"), 1), lambda b: b.withColumn("status", F.lit("ok")), str(tmp_path / "json"), checkpoint=str(tmp_path / "cp"))
    again.awaitTermination()  # nothing new: nothing is written twice
    assert spark.read.json(str(tmp_path / "json")).count() == 3


def test_grouped_programs_see_whole_keys(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 2, 3, None]), rng.randrange(10**6)) for _ in range(30_000)] + [(9, 5)]
    df = spark.createDataFrame(rows, "k int, v int")
    got = {r["k"]: (r["n"], r["first"]) for r in by_key(df, ["k"], ["v"], lambda c: {"k": c["k"][:1], "n": [len(c["v"])], "first": [c["v"][0]] if c["v"] == sorted(c["v"]) else [None]}, "k int, n int, first int").collect()}
    want = {}
    for k, v in rows:
        n, least = want.get(k, (0, v))
        want[k] = (n + 1, min(least, v))
    assert got == want
    assert by_key(df.limit(0), ["k"], ["v"], lambda c: {}, "k int, n int").count() == 0


def test_record_assembly_is_that_of_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for seg in range(25):
        for e in range(rng.randrange(1, 8)):
            b = rng.randrange(10)
            rows.append((1, 1, seg, e, b, b + rng.randrange(1, 5), rng.randrange(3)))
    got = mwe.assemble(spark.createDataFrame(rows, "doc_id int, par_id int, segment int, edge_id int, beg int, nxt int, grp int")).collect()
    for seg in range(25):
        own = [r for r in rows if r[2] == seg]
        best = 0
        for mask in range(1 << len(own)):
            some = [r for i, r in enumerate(own) if mask >> i & 1]
            if len({r[6] for r in some}) == len(some) and all(a[5] <= b[4] or b[5] <= a[4] for i, a in enumerate(some) for b in some[:i]):
                best = max(best, sum(r[5] - r[4] for r in some))
        chosen = [r for r in got if r["segment"] == seg]
        assert sum(r["nxt"] - r["beg"] for r in chosen) == best and len({r["grp"] for r in chosen}) == len(chosen)


def test_tagger_path(spark):
    rows = [(1, 0, 1, 0, 2, True), (1, 1, 2, 0, 2, True), (1, 0, 2, 0, 2, False), (2, 0, 1, 0, 2, True), (2, 0, 2, 0, 2, True), (3, 0, 1, 0, 2, True)]
    got = lattice.tagger_path(spark.createDataFrame(rows, "k int, beg int, nxt int, first int, last int, chosen boolean"), ["k"]).collect()
    assert {(r["k"], r["status"].split(" at")[0]) for r in got} == {(1, "ok"), (2, "not one edge"), (3, "no edge")}


def test_alignment_and_beam():
    cost, script = fuzzy.align("abdc", "abcd")
    assert cost == 1 and [s[0] for s in script] == ["accept", "accept", "transpose"]
    assert fuzzy.align("a.c", "abc", fuzzy.restricted_cost)[0] == 2
    trie = fuzzy.Trie(["hello", "world"])
    assert fuzzy.beam_correct("helo world", trie) == "hello world" and fuzzy.beam_correct("short", trie) == "short"
