"""Phonetic rewriting of words, and rules from it.

A rule rewrites ``find`` to one of its outputs where the text goes on with ``right``. All
derivations of a word are kept; they are bounded by the rules that fit at each place.
Words are distinct rows, so the rewriting runs over the vocabulary.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str, str]  # find, right context, output


def derivations(word: str, rules: list[Rule], keep_unknown: bool = True) -> list[str]:
    """All rewritings of a word, longest rules first; a character no rule reads stays or ends the derivation."""
    by_first: dict[str, list[Rule]] = {}
    for rule in sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), r)):
        by_first.setdefault(rule[0][:1], []).append(rule)
    open_: dict[int, set[str]] = {0: {""}}
    for at in range(len(word)):
        for done in open_.pop(at, ()):
            fits = [r for r in by_first.get(word[at], ()) if word.startswith(r[0] + r[1], at)]
            longest = max((len(r[0]) + len(r[1]) for r in fits), default=0)
            for find, right, out in fits:
                if len(find) + len(right) == longest:
                    open_.setdefault(at + len(find), set()).add(done + out)
            if not fits and keep_unknown:
                open_.setdefault(at + 1, set()).add(done + word[at])
    return sorted(open_.get(len(word), ()))


def transcribed(words: DataFrame, rules: list[Rule], word: str = "word") -> DataFrame:
    """A row for each derivation of each word, column ``phon`` (L16, E10). rules: a table of the size of a rule file."""
    schema = ", ".join(f"`{n}` {t}" for n, t in words.dtypes) + ", phon string"

    def run(batches):
        for batch in batches:
            index, out = [], []
            for i, w in enumerate(batch[word].to_pylist()):
                found = derivations(w or "", rules)
                index += [i] * len(found)
                out += found
            yield batch.take(pa.array(index, pa.int64())).append_column("phon", pa.array(out, pa.string())) if index else pa.RecordBatch.from_arrays(
                [*(c.slice(0, 0) for c in batch.columns), pa.array([], pa.string())], names=[*batch.schema.names, "phon"]
            )

    return words.mapInArrow(run, schema)


def round_trip(words: DataFrame, forward: list[Rule], back: list[Rule]) -> DataFrame:
    """Each word's status after rewriting there and back: ok, NotFound, NotEqual or MultipleSolutions."""
    there = transcribed(words.select("word").distinct(), forward)
    again = transcribed(there.select(F.col("word").alias("origin"), F.col("phon").alias("word")), back)
    per = again.groupBy("origin").agg(F.count_distinct("phon").alias("n"), F.bool_or(F.col("phon") == F.col("origin")).alias("same"))
    status = F.when(F.col("n").isNull(), "NotFound").when(~F.col("same"), "NotEqual").when(F.col("n") > 1, "MultipleSolutions").otherwise("ok")
    return words.select("word").distinct().join(per, F.col("word") == F.col("origin"), "left").select("word", status.alias("status"))


def candidates(entries: DataFrame, forward: list[Rule], back: list[Rule], rules: DataFrame, longest: int) -> DataFrame:
    """Rules that lead from a form to its lemma through the transcription (E11). entries: orth, lemma."""
    from lexloom.operators.morphology import probe_suffix_rules

    forms = transcribed(entries.select("orth", "lemma").distinct(), forward, "orth")
    probed = probe_suffix_rules(forms.select(F.col("orth").alias("form"), F.col("lemma").alias("want"), F.col("phon").alias("orth")), rules, longest)
    spelled = transcribed(probed.select("form", "want", "rule_id", "lemma"), back, "lemma")
    return spelled.filter("phon = want").select(F.col("form").alias("orth"), F.col("want").alias("lemma"), "rule_id").distinct()
