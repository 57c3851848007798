"""Corpus tools: concordances, statistics, triage, subcorpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEFT, RIGHT = 24, 22


def kwic(pars: DataFrame, toks: Column, is_hit, left: int = LEFT, right: int = RIGHT) -> DataFrame:
    """Hits with up to ``left`` and ``right`` tokens of context (W1, K7): slices of the paragraph's own array, no shuffle."""
    rows = pars.withColumn("toks", toks)
    spots = F.filter(F.transform("toks", lambda t, i: F.when(is_hit(t), i + 1)), lambda x: x.isNotNull())
    rows = rows.withColumn("at", F.explode(spots))
    before = F.slice("toks", F.greatest(F.lit(1), F.col("at") - left), F.least(F.lit(left), F.col("at") - 1))
    return rows.select(
        *[c for c in pars.columns if c != "paragraph"], "at", F.array_join(before, " ").alias("left"), F.element_at("toks", F.col("at")).alias("hit"), F.array_join(F.slice("toks", F.col("at") + 1, F.lit(right)), " ").alias("right")
    )


def concordance_order(rows: DataFrame) -> DataFrame:
    """By the hit, then by the left context read backwards, case ignored."""
    return rows.orderBy(F.lower("hit"), F.reverse(F.lower("left")), "left", "hit", "right")


def statuses(sentences: DataFrame, keys: list[str]) -> DataFrame:
    """A text is parsed if all its sentences are."""
    return sentences.groupBy(*keys).agg(F.bool_and("parsed").alias("parsed"), F.count("*").alias("n_sentences"))


def sentence_stats(sentences: DataFrame) -> DataFrame:
    """Annotated and unannotated tokens and characters by status (W8): partial parses charge 17 % of tokens, rounded down."""
    failed, partial = F.col("status") == "failed", F.col("status") == "partial"
    tokens = F.when(failed, F.col("no_tokens")).when(partial, F.floor(F.col("no_tokens") * 17 / 100)).otherwise(0).cast("long")
    chars = F.when(failed, F.col("no_chars")).otherwise(0).cast("long")
    return sentences.withColumns({"tokens_nann": tokens, "chars_nann": chars})


def text_stats(sentences: DataFrame, keys: list[str], sentence: str) -> DataFrame:
    """Least over the alternatives of a sentence, then sums over sentences."""
    cols = ["no_tokens", "no_chars", "tokens_nann", "chars_nann"]
    least = sentence_stats(sentences).groupBy(*keys, sentence).agg(*[F.min(c).alias(c) for c in cols])
    return least.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in cols])


def triage(rows: DataFrame, failed: Column, valid: Column) -> DataFrame:
    """parsed, not_parsed or not_verified."""
    return rows.withColumn("status", F.when(failed, "not_parsed").when(valid, "parsed").otherwise("not_verified"))


def regression(old: DataFrame, new: DataFrame, key: str, payload: str) -> DataFrame:
    """Keys whose payload differs or is on one side only."""
    a, b = old.select(key, F.col(payload).alias("before")), new.select(key, F.col(payload).alias("after"))
    got = a.join(b, key, "full")
    kind = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").when(F.col("before") != F.col("after"), "changed")
    return got.withColumn("change", kind).filter("change is not null")


def new_texts(texts: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """Texts that no parsed corpus has."""
    return texts.join(parsed.select(key).distinct(), key, "left_anti")


def with_symbol(corpus: DataFrame, symbol: str, line: str = "line") -> DataFrame:
    """Rows one of whose space-separated tokens is the symbol."""
    return corpus.filter(F.array_contains(F.split(line, "[ \n]"), symbol))


def moved(membership: DataFrame, ids: DataFrame, source: str, target: str) -> DataFrame:
    """Membership after moving ids from one subcorpus to another (W11). membership: id, subcorpus."""
    move = membership.filter(F.col("subcorpus") == source).join(ids.select("id").distinct(), "id", "left_semi").select("id", F.lit(target).alias("subcorpus"))
    rest = membership.join(move.select("id", F.lit(source).alias("subcorpus")), ["id", "subcorpus"], "left_anti")
    return rest.unionByName(move).distinct()


def marked_html(text: Column, spans: Column) -> Column:
    """Text with category spans in ``<span class>`` (K6). spans: sorted, disjoint (from_, to_, cat), 0-based character offsets."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    step = lambda a, s: F.struct(
        F.concat(a["out"], esc(F.substring(text, a["at"] + 1, s["from_"] - a["at"])), F.lit('<span class="'), s["cat"], F.lit('">'), esc(F.substring(text, s["from_"] + 1, s["to_"] - s["from_"])), F.lit("</span>")).alias("out"),
        s["to_"].cast("int").alias("at"),
    )
    return F.aggregate(spans, state, step, lambda a: F.concat(a["out"], esc(F.substring(text, a["at"] + 1, F.length(text)))))
