"""Lexicon probes and generation.

Lexicons and rules are DataFrames. Suffix probes explode the (few) suffixes of each
distinct form up to the longest rule, so the join is an equi-join; the engine picks a
broadcast by the rule table's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexloom.operators.grouped import apart, small


def suffixes(form: Column, longest: int) -> Column:
    """The endings of a form, shortest (empty) first, at most ``longest`` characters."""
    return F.transform(F.sequence(F.lit(0), F.least(F.length(form), F.lit(longest))), lambda n: F.right(form, n))


def probe_suffix_rules(forms: DataFrame, rules: DataFrame, longest: int, prefixes: bool = True) -> DataFrame:
    """All rules whose ``find`` ends the form (and ``pref`` starts it), with the lemma they give (L1, L2).

    forms: orth. rules: rule_id, pref, find, set_, and more.
    """
    out = forms.select("*", F.explode(suffixes(F.col("orth"), longest)).alias("find")).join(rules, "find")
    if prefixes:
        out = out.filter(F.startswith("orth", "pref") & (F.length("orth") >= F.length("pref") + F.length("find")))
    stem = F.substring(F.col("orth"), F.length("pref") + 1, F.length("orth") - F.length("pref") - F.length("find"))
    return out.withColumn("stem", stem).withColumn("lemma", F.concat("stem", "set_"))


def analyse(forms: DataFrame, exceptions: DataFrame, rules: DataFrame, stems: DataFrame, longest: int) -> DataFrame:
    """Exception entries and validated rule analyses of each form; ``unk`` where there is none (L3).

    exceptions: orth, lemma, interp. stems: stem, rule_id (the rules a stem is listed with).
    """
    ruled = probe_suffix_rules(forms, rules, longest)
    listed = stems.select("stem", "rule_id", F.lit(True).alias("listed")).distinct()
    ruled = ruled.join(listed, ["stem", "rule_id"], "left").select("orth", "lemma", "interp", F.when(F.col("listed"), "LemmaVal").otherwise("LemmNotVal").alias("status"))
    known = forms.join(exceptions, "orth").select("orth", "lemma", "interp", F.lit("LemmaVal").alias("status"))
    found = known.unionByName(ruled)
    none = forms.join(found.select("orth").distinct(), "orth", "left_anti").select("orth", F.col("orth").alias("lemma"), F.lit("unk").alias("interp"), F.lit("TokNotFound").alias("status"))
    return found.unionByName(none)


def keep_or_all(rows: DataFrame, keys: list[str], good: Column) -> DataFrame:
    """Good rows of each key; all of them where none is good."""
    w = W.partitionBy(*keys)
    return rows.withColumn("__good", good).withColumn("__any", F.max("__good").over(w)).filter("__good or not __any").drop("__good", "__any")


def argmin(rows: DataFrame, keys: list[str], cost: Column, ties: bool = True) -> DataFrame:
    """Rows of least cost of each key, all of them on a tie.

    The least cost is an aggregate combined before the shuffle, joined back; no key's rows
    are sorted.
    """
    rows = rows.withColumn("__cost", cost)
    least = rows.groupBy(*keys).agg(F.min("__cost").alias("__least"))
    kept = rows.join(least, keys).filter(F.col("__cost") == F.col("__least")).drop("__least")
    return kept.drop("__cost") if ties else kept.drop("__cost").dropDuplicates(keys)


def status_priority(status: Column, star: Column, featured: Column, excluded: Column) -> Column:
    """Order of readings when a form is generated."""
    base = F.when(status == "LemmaVal", 100).when(status == "LemmaAlt", 100).when(status == "LemmNotVal", 300).otherwise(400)
    return base + F.when(star == "Star", 1000).otherwise(0) - F.when(featured, 10).otherwise(0) + F.when(excluded, 10).otherwise(0)


def lexicon_priority(in_lexicon: Column, in_dict: Column, validated: Column, no_dict_tag: Column, indeclinable: Column, poss_tag: Column, worse: Column) -> Column:
    """1, 2, 3 or null (never chosen); ``worse``: the token has a clitic, a case change or an auxiliary star."""
    p2 = F.when(worse, F.lit(None).cast("int")).otherwise(3)
    return (
        F.when(in_lexicon & in_dict, F.when(validated | no_dict_tag, 1).otherwise(p2))
        .when(in_lexicon & indeclinable, F.when(poss_tag, 1).otherwise(p2))
        .when(in_lexicon, 1)
        .when(validated, 2)
        .otherwise(p2)
    )


def ontology(rows: DataFrame, by_lemma: DataFrame, by_pos: DataFrame) -> DataFrame:
    """Category by (lemma, pos), else by pos, else X (L12). by_lemma: lemma, pos, cat. by_pos: pos, cat."""
    one = by_lemma.withColumnRenamed("cat", "__one")
    two = by_pos.withColumnRenamed("cat", "__two")
    return rows.join(one, ["lemma", "pos"], "left").join(two, "pos", "left").withColumn("cat", F.coalesce("__one", "__two", F.lit("X"))).drop("__one", "__two")


def compose_rules(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rules of two sets in a row: the second's ending stands behind the first's."""
    return first.alias("a").crossJoin(second.alias("b")).select(
        F.concat_ws("+", "a.rule_id", "b.rule_id").alias("rule_id"), F.concat("a.find", "b.find").alias("find"), F.concat("a.set_", "b.set_").alias("set_"), F.map_concat("a.tags", "b.tags").alias("tags")
    )


def assign_interps(rules: DataFrame, interps: DataFrame) -> DataFrame:
    """Interps whose tags are all among a rule's (L19). rules: rule_id, tags. interps: interp, tags.

    An interp meets the rules by one of its tags alone, and the others are compared in place, so a
    rule makes no row for what it only shares a tag with. Rows of one rule_id are one rule, whose
    equal tags count one by one; those are counted, the few that there may be.
    """
    pairs = interps.select("interp", F.explode(F.map_entries("tags")).alias("tag"))
    want = pairs.groupBy("interp").agg(F.array_sort(F.collect_set("tag")).alias("every"))
    n = want.count()
    own = want.select("interp", "every", F.col("every")[0]["key"].alias("k"), F.col("every")[0]["value"].alias("v"))
    single, repeated = apart(rules, "rule_id")
    met = single.select("rule_id", "tags", F.explode("tags").alias("k", "v")).join(small(own, n), ["k", "v"])
    fits = F.forall("every", lambda t: F.coalesce(F.try_element_at("tags", t["key"]) == t["value"], F.lit(False)))
    found = met.filter(fits).select("rule_id", "interp")
    if repeated is None:
        return found
    each = want.select("interp", F.size("every").alias("n"), F.explode("every").alias("t")).select("interp", "n", "t.key", "t.value")
    hits = repeated.select("rule_id", F.explode("tags")).join(small(each, n), ["key", "value"]).groupBy("rule_id", "interp", "n").agg(F.count("*").alias("hits"))
    return found.unionByName(hits.filter("hits = n").select("rule_id", "interp"))


def by_case_set(forms: DataFrame, key: str, form: str, case: str) -> DataFrame:
    """Each form with its sorted set of cases, then forms by that set."""
    sets = forms.groupBy(key, form).agg(F.array_join(F.sort_array(F.collect_set(case)), ".").alias("cases"))
    return sets.groupBy(key, "cases").agg(F.array_join(F.sort_array(F.collect_set(form)), ",").alias("forms"))


def inflect_phrase(words: DataFrame, forms: DataFrame) -> DataFrame:
    """Forms of phrases of any length: the product of the words' forms of one case and number.

    words: phrase_id, pos, lemma. forms: lemma, number, case, form. A join for each word of the longest phrase.
    """
    n = words.groupBy("phrase_id").agg(F.max("pos").alias("n"))
    cells = words.join(forms, "lemma").join(n, "phrase_id").select("phrase_id", "pos", "n", "number", "case", "form")
    out = cells.filter("pos = 1").select("phrase_id", "n", "number", "case", F.col("form").alias("phrase"))
    done = out.filter("n = 1")
    for k in range(2, (words.agg(F.max("pos")).first()[0] or 1) + 1):
        nxt = cells.filter(f"pos = {k}").drop("pos", "n")
        out = out.filter(f"n >= {k}").join(nxt, ["phrase_id", "number", "case"]).select("phrase_id", "n", "number", "case", F.concat_ws(" ", "phrase", "form").alias("phrase"))
        done = done.unionByName(out.filter(f"n = {k}"))
    return done.select("phrase_id", "number", "case", "phrase").distinct()
