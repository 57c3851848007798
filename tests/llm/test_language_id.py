import random
import zlib

import numpy as np
from common_docs import no_docs, odd_docs

from lexloom.llm import language_id as L


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in docs.collect()}
    rows = L.learn_and_predict(docs).collect()
    assert len(rows) == docs.count()
    seen = right = 0
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
        lang, text = truth[r["doc_id"]]
        assert (r["lang_pred"] == "und") == (not text or not any(c.isalpha() for c in text))
        if r["held_out"] and lang and len(text or "") > 50 and r["lang_pred"] != "und":
            seen += 1
            right += r["lang_pred"] == lang
    assert seen > 20 and right / seen > 0.95


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(map(tuple, L.learn_and_predict(docs).collect()))
    held = L.held_out(docs["doc_id"])
    from pyspark.sql import functions as F

    other = docs.withColumns({"lang": F.when(held, "zz").otherwise(F.col("lang")), "source": F.lit("x"), "n_chars": F.lit(0)})
    assert sorted(map(tuple, L.learn_and_predict(other).collect())) == want


def test_counts_are_those_of_brute_force():
    rng = random.Random(1)
    for _ in range(20):
        text = "".join(rng.choice("abc Äß.1\n漢") for _ in range(rng.randrange(1, 80)))
        got = L.ngram_counts(text)
        runs = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        if not runs:
            assert got is None
            continue
        flat = [0, *[c for i, run in enumerate(runs) for c in ([0] if i else []) + [ord(x) for x in run]], 0]
        n = sum(c > 0 for c in flat) + len(flat) - 1 + max(0, len(flat) - 2)
        lead = not "".join(c if c.isalpha() else " " for c in text.lower())[0].isspace()
        tail = not "".join(c if c.isalpha() else " " for c in text.lower())[-1].isspace()
        assert abs(int(got.sum()) - n) <= (0 if lead and tail else 2)


def test_nearest_centroid_is_that_of_brute_force():
    rng = np.random.default_rng(3)
    samples = [(lang, rng.poisson(rate[None, :], (40, L.DIMENSIONS))[i]) for lang, rate in (("a", np.r_[np.full(4096, 0.2), np.zeros(4096)]), ("b", np.r_[np.zeros(4096), np.full(4096, 0.2)])) for i in range(40)]
    model = L.fit(samples)
    assert set(model.langs) == {"a", "b"} and len(model.langs) <= 2 * L.CENTROIDS
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5)
    vectors = model.vectors(np.stack([c for _, c in samples]))
    best = [model.langs[max(range(len(model.langs)), key=lambda i: float(v @ model.centroids[i]))] for v in vectors]
    assert best == [lang for lang, _ in samples]


def test_rejection_by_distance():
    english = [("en", L.ngram_counts(f"the cat sat on the mat and the dog ran to the house number of day {i}")) for i in range(30)]
    german = [("de", L.ngram_counts(f"der hund und die katze gehen nicht auf das haus ohne den mann {i}")) for i in range(30)]
    model = L.fit(english + german)
    (lang, score, rejected), (_, far, away), (none, zero, no) = model.predict(["the cat sat on the mat and the dog ran to the house number of day 77", "漢字仮名交じり文", "123 --"])
    assert lang == "en" and not rejected and score > far and away
    assert (none, zero, no) == ("und", 0.0, False)


def test_odd_rows(spark):
    rows = L.learn_and_predict(odd_docs(spark)).collect()
    assert len(rows) == odd_docs(spark).count()
    assert {r["lang_pred"] for r in rows} <= {"en", "de", "fr", "und"}
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (0, 1, 2))
    assert L.learn_and_predict(no_docs(spark)).count() == 0
    nothing = odd_docs(spark).selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in L.learn_and_predict(nothing).collect()} == {"und"}


def test_the_sample_is_bounded_at_any_count(spark, monkeypatch):
    for count in (1, 10**3, 10**9, 10**13):
        reached = (L.hash_limit(300, count) + 1) / 2**63 * count
        assert reached <= min(count, 1.3 * 300 + 11) + 1e-6
    monkeypatch.setattr(L, "SAMPLE_PER_LANG", 5)
    # A third of the rows is one row again and again; it counts once.
    rows = [(i, f"some words {i} of a text") for i in range(400)] + [(1, "the very same text")] * 200
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    assert len(L.training_sample(docs)) == 5
