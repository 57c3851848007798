"""Dictionary ETL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def merge_lexemes(entries: DataFrame, keys: list[str], form_cols: list[str], single: str) -> DataFrame:
    """Forms of a lexeme together; two values of ``single`` in one lexeme fail."""
    got = entries.groupBy(*keys).agg(
        F.sort_array(F.collect_set(F.struct(*form_cols))).alias("forms"), F.min(single).alias(single), F.max(single).alias("__other"), F.count("*").alias("n")
    )
    clash = F.when(F.col(single) != F.col("__other"), F.raise_error(F.concat(F.lit("conflicting values in "), F.concat_ws("|", *keys))).cast("string"))
    return got.withColumn("__ok", clash).filter("__ok is null").drop("__ok", "__other")


def merge_interps(forms: DataFrame, keys: list[str], interp: str = "interp") -> DataFrame:
    """The interps of a form as one sorted tag."""
    return forms.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set(interp)), "|").alias("interps"))


def normal_aspect(interp: Column) -> Column:
    """``imperf`` and ``perf`` in one slot, in either order, become ``imperf.perf``."""
    return F.regexp_replace(interp, r"(perf[.]imperf|imperf[.]perf)", "imperf.perf")


def without(entries: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Drop listed lemmata."""
    return entries.join(listed, key, "left_anti")


def strip_suffixes(entries: DataFrame, orth: str, suffixes: tuple[str, ...]) -> DataFrame:
    """Stem and suffix of forms with a listed ending; others keep an empty suffix."""
    hit = F.lit(None).cast("string")
    for s in sorted(suffixes, key=len):
        hit = F.when(F.endswith(F.col(orth), F.lit(s)) & (F.length(orth) > len(s)), s).otherwise(hit)
    hit = F.coalesce(hit, F.lit(""))
    return entries.withColumn("suffix", hit).withColumn("stem", F.expr(f"left({orth}, length({orth}) - length(suffix))"))


def common_prefix(a: Column, b: Column) -> Column:
    """Longest common prefix of two words."""
    n = F.least(F.length(a), F.length(b))
    size = F.aggregate(F.sequence(F.lit(0), n), F.lit(0), lambda best, k: F.when(F.left(a, k) == F.left(b, k), F.greatest(best, k)).otherwise(best))
    return F.left(a, size)


def stem_by_priority(forms: DataFrame, selectors: DataFrame, key: str) -> DataFrame:
    """Stem cut by the applicable selector of best priority; "" if two stems tie.

    selectors: suffix, priority.
    """
    from lexloom.operators.morphology import suffixes

    longest = selectors.agg(F.max(F.length("suffix"))).first()[0] or 0
    hit = forms.withColumn("suffix", F.explode(suffixes(F.col("orth"), longest))).join(selectors, "suffix").withColumn("stem", F.expr("left(orth, length(orth) - length(suffix))"))
    best = hit.groupBy(key).agg(F.min_by(F.struct("stem"), F.struct("priority", "stem")).alias("s"), F.min("priority").alias("p"))
    tied = hit.join(best.select(key, "p"), key).filter("priority = p").groupBy(key).agg(F.countDistinct("stem").alias("n"))
    return best.join(tied, key).select(key, F.when(F.col("n") == 1, F.col("s.stem")).otherwise("").alias("stem"))


def validated(forms: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """A flag for forms that have a candidate."""
    return forms.join(candidates.select(*keys).distinct().withColumn("validated", F.lit(True)), keys, "left").withColumn("validated", F.coalesce("validated", F.lit(False)))


def validated_entries(forms: DataFrame, lemma: str) -> DataFrame:
    """Entries with all, some or no forms validated."""
    return forms.groupBy(lemma).agg(F.bool_and("validated").alias("all_valid"), F.bool_or("validated").alias("any_valid"), F.count("*").alias("n_forms"))


def drop_neg_sup(forms: DataFrame, interp: str = "interp") -> DataFrame:
    """No negated or superlative forms."""
    return forms.filter(~F.endswith(F.col(interp), F.lit(":neg")) & ~F.endswith(F.col(interp), F.lit(":sup")))


def without_prefixed(words: DataFrame, prefixes: tuple[str, ...], word: str = "word") -> DataFrame:
    """Drop words that are a listed prefix and another word."""
    rest = F.array(*[F.when(F.startswith(F.col(word), F.lit(p)) & (F.length(word) > len(p)), F.expr(f"substring({word}, {len(p) + 1})")) for p in prefixes])
    cut = words.select(F.col(word).alias("__word"), F.explode(F.filter(rest, lambda x: x.isNotNull())).alias(word))
    bad = cut.join(words.select(word), word, "left_semi").select(F.col("__word").alias(word)).distinct()
    return words.join(bad, word, "left_anti")


def histogram(rows: DataFrame, selector: Column, name: str = "key") -> DataFrame:
    """Counts by a selector."""
    return rows.groupBy(selector.alias(name)).agg(F.count("*").alias("n"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Lines of one side only, marked ``<`` or ``>`` (E17): one grouping of both sides, sets not bags."""
    both = old.distinct().withColumn("side", F.lit(1)).unionByName(new.distinct().withColumn("side", F.lit(2)))
    got = both.groupBy(*old.columns).agg(F.sum("side").alias("sides"))
    return got.filter("sides < 3").select(F.when(F.col("sides") == 1, "<").otherwise(">").alias("mark"), *old.columns)


def out_of_order(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value is less than the one before."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("before", F.lag(value).over(w)).filter(F.col(value) < F.col("before"))


def induce_suffix_rules(pairs: DataFrame, examples: int = 20) -> DataFrame:
    """Rewrite rules form -> lemma behind their common prefix, counts, and the first example lemmata.

    pairs: orth, lemma. Examples are the least by order; the aggregate keeps at most
    ``examples`` of them per rule and task.
    """
    cut = common_prefix(F.col("orth"), F.col("lemma"))
    rules = pairs.withColumn("stem", cut).select(F.expr("substring(orth, length(stem) + 1)").alias("find"), F.expr("substring(lemma, length(stem) + 1)").alias("set_"), "lemma")
    counts = rules.groupBy("find", "set_", "lemma").agg(F.count("*").alias("k"))
    w = W.partitionBy("find", "set_").orderBy("lemma")
    named = counts.withColumn("place", F.row_number().over(w))
    return named.groupBy("find", "set_").agg(F.sum("k").alias("n"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("place") <= examples, F.col("lemma")))), " ").alias("examples"))


def pick_bucket(candidates: DataFrame, keys: list[str], tag: str, preferred: list[str]) -> DataFrame:
    """Candidates of the first preferred tag value that a key has, else of its least value."""
    order = F.lit(len(preferred))
    for i, v in reversed(list(enumerate(preferred))):
        order = F.when(F.col(tag) == v, i).otherwise(order)
    rank = F.struct(order.alias("o"), F.col(tag).alias("t"))
    best = candidates.groupBy(*keys).agg(F.min(rank).alias("__best"))
    return candidates.join(best, keys).filter(F.col(tag) == F.col("__best.t")).drop("__best")


def shortest(candidates: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Candidates with the shortest text."""
    least = candidates.groupBy(*keys).agg(F.min(F.length(text)).alias("__n"))
    return candidates.join(least, keys).filter(F.length(text) == F.col("__n")).drop("__n")


def rule_frequencies(chosen: DataFrame, rule: str, kind: str, freq: str) -> DataFrame:
    """Sum of frequencies of each rule and of each rule and type."""
    per = chosen.groupBy(rule, kind).agg(F.sum(freq).alias("f"))
    return per.groupBy(rule).agg(F.sum("f").alias("freq"), F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", kind, F.col("f").cast("string")))), ",").alias("by_type"))


def stem_dictionary(rows: DataFrame) -> DataFrame:
    """(stem, suffix) to its rule ids."""
    return rows.groupBy("stem", "suffix").agg(F.array_join(F.sort_array(F.collect_set("rule_id")), " ").alias("rule_ids"))


def final_clusters(words: DataFrame, vowels: str = "aeiouyáéíóúàèìòùâêîôûäöü") -> DataFrame:
    """Final consonant cluster and the vowel before it, counted."""
    pattern = f"([{vowels}]?)([^{vowels}]*)$"
    return words.groupBy(F.regexp_extract("word", pattern, 1).alias("vowel"), F.regexp_extract("word", pattern, 2).alias("cluster")).agg(F.count("*").alias("n"))


def conflicts(rules: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """Keys with more than one combination of attributes."""
    return rules.groupBy(*keys).agg(F.countDistinct(*attributes).alias("n_variants"), F.count("*").alias("n")).filter("n_variants > 1")


def evaluate(rows: DataFrame, keys: list[str], predicted: Column, truth: Column) -> DataFrame:
    """Coverage, precision over decided rows, precision over all."""
    hit = predicted.isNotNull() & (predicted == truth)
    got = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(predicted.isNotNull()).alias("decided"), F.count_if(hit).alias("right"))
    return got.select(*keys, "n", "decided", "right", (F.col("decided") / F.col("n")).alias("coverage"), F.when(F.col("decided") > 0, F.col("right") / F.col("decided")).alias("precision"), (F.col("right") / F.col("n")).alias("strict_precision"))


def not_exactly_one(expected: DataFrame, analyses: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose number of matching analyses isn't one."""
    n = analyses.groupBy(*keys).agg(F.count("*").alias("n"))
    return expected.select(*keys).distinct().join(n, keys, "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n <> 1")


def name_types(labels: Column, table: dict[str, str]) -> Column:
    """Classes of pipe-separated type labels, those without one dropped."""
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(labels, "[|]"), lambda x: F.element_at(lookup, x)), lambda x: x.isNotNull())))
