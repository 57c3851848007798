"""Sinks: lattices, trees and reports as text, files by class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain_lattice(edges: DataFrame, clean: bool = False) -> DataFrame:
    """One ``line`` per edge (K1); ``clean`` leaves out category X and MWE components."""
    if clean and "cat" in edges.columns:
        edges = edges.filter(F.coalesce("cat", F.lit("")).isin("X", "MWEcomponent") == F.lit(False))
    shown = [c for c in ("beg", "len", "nxt", "orth", "lemma", "pos", "cat") if c in edges.columns]
    return edges.select("doc_id", "par_id", "beg", "nxt", F.concat_ws(" ", *[F.col(c).cast("string") for c in shown]).alias("line"))


def conll(edges: DataFrame, keys: list[str], order: str = "tok") -> DataFrame:
    """Numbered tab-separated ``line`` of each edge (K2); ``_`` for what is absent."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_")) if c in edges.columns else F.lit("_")
    return edges.select(*keys, order, F.concat_ws("\t", F.col(order).cast("string"), *map(cell, ("orth", "lemma", "pos", "interp", "beg", "len"))).alias("line"))


def as_json(rows: DataFrame, keys: list[str], statistics: bool = False) -> DataFrame:
    """Each row as JSON, with its counters if asked (K4)."""
    body = F.to_json(F.struct(*[c for c in rows.columns if c not in keys]))
    return rows.select(*keys, body.alias("json"), *([F.length(body).alias("n_chars")] if statistics else []))


def as_xml(rows: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """Each row as an element with its columns as attributes, escaped."""
    def esc(c: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    attrs = [F.concat(F.lit(f' {c}="'), esc(F.col(c).cast("string")), F.lit('"')) for c in rows.columns if c not in keys]
    return rows.select(*keys, F.concat(F.lit(f"<{tag}"), *[F.coalesce(a, F.lit("")) for a in attrs], F.lit("/>")).alias("xml"))


def dot(links: DataFrame, keys: list[str], src: str, dst: str, label: str) -> DataFrame:
    """Graphviz ``line`` of each link; a writer puts ``digraph G {`` and ``}`` around a key's lines (K8)."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return links.select(*keys, F.concat(F.lit("  "), quoted(src), F.lit(" -> "), quoted(dst), F.lit(" [label="), quoted(label), F.lit("]")).alias("line"))


def by_class(rows: DataFrame, path: str, classes: Column, line: Column) -> None:
    """A folder of text for each class (K11, K12, K14, K17); rows keep to their tasks, so nothing is shuffled."""
    rows.select(classes.alias("class"), line.alias("value")).write.mode("overwrite").partitionBy("class").text(path)


def append(rows: DataFrame, path: str) -> None:
    """(K13, K20)"""
    rows.write.mode("append").csv(path, sep="\t")


def phrase_rules(phrases: DataFrame) -> DataFrame:
    """Phrases as rule-file lines: forms, lemma, interp (K18). phrases: words, lemma, interp."""
    return phrases.select(F.concat_ws("\t", F.array_join("words", " "), "lemma", "interp").alias("line"))


def lexicon_json(forms: DataFrame, lemma: str = "lemma") -> DataFrame:
    """Lemma to the JSON of its distinct forms, in order of their text."""
    others = [c for c in forms.columns if c != lemma]
    return forms.groupBy(lemma).agg(F.to_json(F.sort_array(F.collect_set(F.struct(*others)))).alias("forms"))
