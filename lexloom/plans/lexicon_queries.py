"""Queries over lexicon probes and dictionary ETL (SURVEY L, E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import tokens
from lexloom.operators import dictionary as D
from lexloom.operators import morphology as M
from lexloom.plans.base import query, sql_values, table, values
from lexloom.plans.text_queries import docs

RULES = [
    ("r1", "", "s", "", "subst:pl:nom", "Productive", 50), ("r2", "", "ed", "", "praet:sg:ter", "Productive", 30), ("r3", "", "ing", "", "ger:sg:nom", "Productive", 20), ("r4", "", "ly", "", "adv:pos", "Productive", 10),
    ("r5", "re", "ed", "e", "praet:sg:ter", "Star", 5), ("r6", "", "es", "e", "subst:pl:gen", "Productive", 40), ("r7", "un", "ing", "e", "ger:sg:nom", "Star", 2), ("r8", "", "tion", "te", "subst:sg:nom", "Ndm", 25), ("r9", "", "", "", "subst:sg:nom", "Productive", 60),
]
RULE_COLS = "rule_id string, pref string, find string, set_ string, interp string, star string, freq int"
RULE_SQL = sql_values(RULES, "rule_id, pref, find, set_, interp, star, freq")
VOCAB = "SELECT w AS orth, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS w FROM documents) GROUP BY w"
PROBE = f"SELECT orth, n, rule_id, find, set_, interp, star, freq, substr(orth, length(pref) + 1, length(orth) - length(pref) - length(find)) AS stem, substr(orth, length(pref) + 1, length(orth) - length(pref) - length(find)) || set_ AS lemma FROM ({VOCAB}), {RULE_SQL} WHERE suffix(orth, find) AND starts_with(orth, pref) AND length(orth) >= length(pref) + length(find)"


def vocabulary(spark, sf_dir):
    return tokens.words(docs(spark, sf_dir)).groupBy(F.col("word").alias("orth")).agg(F.count("*").alias("n"))


def rules(spark):
    return values(spark, RULES, RULE_COLS)


@query(f"SELECT orth, rule_id, lemma FROM (SELECT *, rank() OVER (PARTITION BY orth ORDER BY CASE WHEN star = 'Star' THEN 1000 ELSE 0 END - length(find)) AS r FROM ({PROBE})) WHERE r = 1")
def suffix_probe_best(spark, sf_dir):
    """An argmin that keeps ties."""
    got = M.probe_suffix_rules(vocabulary(spark, sf_dir), rules(spark), 4)
    return M.argmin(got, ["orth"], F.when(F.col("star") == "Star", 1000).otherwise(0) - F.length("find")).select("orth", "rule_id", "lemma")


@query(f"SELECT rule_id, count(*) AS n_forms FROM ({VOCAB}), {RULE_SQL} WHERE suffix(orth, find) GROUP BY 1")
def suffix_probe_reverse(spark, sf_dir):
    """L2."""
    return M.probe_suffix_rules(vocabulary(spark, sf_dir), rules(spark), 4, prefixes=False).groupBy("rule_id").agg(F.count("*").alias("n_forms"))


_EXC = [("the", "the", "det"), ("was", "be", "praet:sg:ter"), ("is", "be", "fin:sg:ter"), ("des", "de", "prep:gen")]
_STEM_SQL = f"SELECT DISTINCT orth AS stem, unnest(['r1', 'r2', 'r9']) AS rule_id FROM ({VOCAB}) WHERE n >= 3"


@query(f"""WITH p AS ({PROBE}), s AS ({_STEM_SQL}), found AS (SELECT orth, lemma, interp, 'LemmaVal' AS status FROM {sql_values(_EXC, 'orth, lemma, interp')} WHERE orth IN (SELECT orth FROM ({VOCAB}))
  UNION ALL SELECT p.orth, p.lemma, p.interp, CASE WHEN s.stem IS NULL THEN 'LemmNotVal' ELSE 'LemmaVal' END FROM p LEFT JOIN s ON p.stem = s.stem AND p.rule_id = s.rule_id)
SELECT status, interp, count(*) AS n, count(DISTINCT orth) AS n_orths, count(DISTINCT lemma) AS n_lemmas FROM found GROUP BY ALL""")
def analyse_forms(spark, sf_dir):
    """L3: exceptions, and suffix rules validated against stems."""
    v = vocabulary(spark, sf_dir)
    stems = v.filter("n >= 3").select(F.col("orth").alias("stem"), F.explode(F.array(*map(F.lit, ["r1", "r2", "r9"]))).alias("rule_id"))
    got = M.analyse(v.select("orth"), values(spark, _EXC, "orth string, lemma string, interp string"), rules(spark), stems, 4)
    return got.groupBy("status", "interp").agg(F.count("*").alias("n"), F.countDistinct("orth").alias("n_orths"), F.countDistinct("lemma").alias("n_lemmas"))


_FLUENT = "regexp_matches(lemma, '[aeiou][^aeiou]{0,2}$')"


@query(f"SELECT orth, rule_id, lemma FROM (SELECT *, {_FLUENT} AS ok, max({_FLUENT}::INT) OVER (PARTITION BY orth) AS any_ok FROM ({PROBE})) WHERE ok OR any_ok = 0")
def fallback_filter(spark, sf_dir):
    """L5."""
    got = M.probe_suffix_rules(vocabulary(spark, sf_dir), rules(spark), 4)
    return M.keep_or_all(got, ["orth"], F.col("lemma").rlike("[aeiou][^aeiou]{0,2}$")).select("orth", "rule_id", "lemma")


_BY_LEMMA = [("the", "det", "DET"), ("of", "prep", "REL"), ("and", "conj", "LINK"), ("der", "det", "DET-DE")]
_BY_POS = [("word", "WORD"), ("prep", "REL-ANY"), ("det", "DET-ANY")]
_POS = "CASE WHEN orth IN ('the', 'der', 'le', 'la') THEN 'det' WHEN orth IN ('of', 'to', 'in', 'de') THEN 'prep' WHEN orth = 'and' THEN 'conj' WHEN length(orth) > 3 THEN 'word' ELSE 'short' END"


@query(f"SELECT v.lemma, v.pos, v.n, coalesce(a.cat, b.cat, 'X') AS cat FROM (SELECT orth AS lemma, {_POS} AS pos, n FROM ({VOCAB})) v LEFT JOIN {sql_values(_BY_LEMMA, 'lemma, pos, cat').replace('AS t', 'AS a')} ON v.lemma = a.lemma AND v.pos = a.pos LEFT JOIN {sql_values(_BY_POS, 'pos, cat').replace('AS t', 'AS b')} ON v.pos = b.pos")
def lexicon_default_join(spark, sf_dir):
    """L12, L15."""
    v = vocabulary(spark, sf_dir).select(F.col("orth").alias("lemma"), F.expr(_POS).alias("pos"), "n")
    return M.ontology(v, values(spark, _BY_LEMMA, "lemma string, pos string, cat string"), values(spark, _BY_POS, "pos string, cat string")).select("lemma", "pos", "n", "cat")


_FLAGS = "p_partkey % 2 = 0 AS in_lexicon, p_size % 3 = 0 AS in_dict, p_size % 5 < 2 AS validated, p_size % 7 = 1 AS no_dict_tag, p_partkey % 3 = 0 AS indeclinable, p_partkey % 5 = 0 AS poss_tag, p_size % 4 = 3 AS worse"


@query(f"""SELECT p_brand, priority, count(*) AS n FROM (SELECT p_brand, CASE WHEN in_lexicon AND in_dict THEN CASE WHEN validated OR no_dict_tag THEN 1 WHEN NOT worse THEN 3 END
  WHEN in_lexicon AND indeclinable THEN CASE WHEN poss_tag THEN 1 WHEN NOT worse THEN 3 END WHEN in_lexicon THEN 1 WHEN validated THEN 2 WHEN NOT worse THEN 3 END AS priority FROM (SELECT p_brand, {_FLAGS} FROM part)) WHERE priority IS NOT NULL GROUP BY ALL""")
def lexicon_priority(spark, sf_dir):
    """The decision table, over flags derived from parts."""
    f = table(spark, sf_dir, "part").selectExpr("p_brand", *_FLAGS.split(", "))
    p = M.lexicon_priority(*[F.col(c) for c in ("in_lexicon", "in_dict", "validated", "no_dict_tag", "indeclinable", "poss_tag", "worse")])
    return f.select("p_brand", p.alias("priority")).filter("priority is not null").groupBy("p_brand", "priority").agg(F.count("*").alias("n"))


_CASES = ["nom", "gen", "dat", "acc"]


@query("SELECT o_custkey AS lemma, cases, string_agg(form, ',' ORDER BY form) AS forms FROM (SELECT o_custkey, form, string_agg(c, '.' ORDER BY c) AS cases FROM (SELECT DISTINCT o_custkey, substr(o_orderpriority, 3, 2) AS form, ['nom', 'gen', 'dat', 'acc'][(o_orderkey % 4 + 1)::INT] AS c FROM orders) GROUP BY ALL) GROUP BY ALL")
def forms_by_case_set(spark, sf_dir):
    """L27."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("lemma"), F.substring("o_orderpriority", 3, 2).alias("form"), F.element_at(F.array(*map(F.lit, _CASES)), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("case"))
    return M.by_case_set(o, "lemma", "form", "case").select("lemma", "cases", "forms")


_WORDS = [(1, 1, "nowy"), (1, 2, "dom"), (2, 1, "dom"), (3, 1, "nowy"), (3, 2, "dobry"), (3, 3, "dom")]
_FORMS = [("nowy", "sg", "nom", "nowy"), ("nowy", "sg", "gen", "nowego"), ("nowy", "pl", "nom", "nowe"), ("dom", "sg", "nom", "dom"), ("dom", "sg", "gen", "domu"), ("dom", "pl", "nom", "domy"), ("dobry", "sg", "nom", "dobry"), ("dobry", "sg", "gen", "dobrego"), ("dobry", "pl", "nom", "dobre"), ("dobry", "pl", "nom", "dobrzy")]


@query(f"""WITH w AS (SELECT * FROM {sql_values(_WORDS, 'phrase_id, pos, lemma')}), f AS (SELECT * FROM {sql_values(_FORMS, 'lemma, number, "case", form')}), c AS (SELECT phrase_id, pos, number, "case", form FROM w JOIN f USING (lemma)),
n AS (SELECT phrase_id, max(pos) AS n FROM w GROUP BY 1)
SELECT a.phrase_id, a.number, a."case", concat_ws(' ', a.form, b.form, d.form) AS phrase FROM c a JOIN n ON a.phrase_id = n.phrase_id LEFT JOIN c b ON b.phrase_id = a.phrase_id AND b.pos = 2 AND b.number = a.number AND b."case" = a."case"
LEFT JOIN c d ON d.phrase_id = a.phrase_id AND d.pos = 3 AND d.number = a.number AND d."case" = a."case" WHERE a.pos = 1 AND (n.n < 2 OR b.form IS NOT NULL) AND (n.n < 3 OR d.form IS NOT NULL)""")
def phrase_inflection(spark, sf_dir):
    """L26."""
    return M.inflect_phrase(values(spark, _WORDS, "phrase_id int, pos int, lemma string"), values(spark, _FORMS, "lemma string, number string, case string, form string"))


_RULE_TAGS = "SELECT p_partkey AS rule_id, unnest(['brand', 'type', 'parity']) AS k, unnest([p_brand, p_type, (p_size % 2)::VARCHAR]) AS v FROM part"
_WANTED = "SELECT DISTINCT 'b:' || p_brand AS interp, 'brand' AS k, p_brand AS v FROM part UNION SELECT 'p0', 'parity', '0' UNION SELECT 'bt:' || p_brand || p_type, 'brand', p_brand FROM part UNION SELECT 'bt:' || p_brand || p_type, 'type', p_type FROM part UNION SELECT 'no', 'other', 'x'"


@query(f"WITH h AS ({_RULE_TAGS}), w AS ({_WANTED}), n AS (SELECT interp, count(*) AS n FROM w GROUP BY 1) SELECT rule_id, interp FROM h JOIN w USING (k, v) JOIN n USING (interp) GROUP BY rule_id, interp, n HAVING count(*) = n")
def tag_subset_interps(spark, sf_dir):
    """Parts as rules with tags; interps for brands, brands with types, one parity."""
    p = table(spark, sf_dir, "part")
    r = p.select(F.col("p_partkey").alias("rule_id"), F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type", F.lit("parity"), (F.col("p_size") % 2).cast("string")).alias("tags"))
    # Distinct before they are maps: those can't be hashed and would be sorted, with all parts in a task.
    brands, kinds = p.select("p_brand").distinct(), p.select("p_brand", "p_type").distinct()
    one = brands.select(F.concat(F.lit("b:"), "p_brand").alias("interp"), F.create_map(F.lit("brand"), "p_brand").alias("tags"))
    two = kinds.select(F.concat(F.lit("bt:"), "p_brand", "p_type").alias("interp"), F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type").alias("tags"))
    fixed = values(spark, [("p0", {"parity": "0"}), ("no", {"other": "x"})], "interp string, tags map<string,string>")
    return M.assign_interps(r, one.unionByName(two).unionByName(fixed))


@query(f"SELECT a.rule_id || '+' || b.rule_id AS rule_id, a.find || b.find AS find, a.set_ || b.set_ AS set_ FROM {RULE_SQL.replace('AS t', 'AS a')}, {RULE_SQL.replace('AS t', 'AS b')} WHERE a.pref = '' AND b.pref = ''")
def compound_rules(spark, sf_dir):
    """Rule sets are program text; their product is the result itself."""
    r = rules(spark).filter("pref = ''").select("rule_id", "find", "set_", F.create_map(F.concat(F.lit("t"), "rule_id"), F.lit("x")).alias("tags"))
    s = r.withColumn("tags", F.create_map(F.concat(F.lit("u"), "rule_id"), F.lit("y")))
    return M.compose_rules(r, s).select("rule_id", "find", "set_")


# --- dictionary ETL ------------------------------------------------------------------


@query("SELECT p_brand AS lemma, p_type AS cat, count(*) AS n, count(DISTINCT p_name) AS n_forms, md5(string_agg(DISTINCT p_name, ',' ORDER BY p_name)) AS forms FROM part GROUP BY ALL")
def lexeme_merge(spark, sf_dir):
    """E1, E2."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("lemma"), F.col("p_type").alias("cat"), F.col("p_name").alias("orth"), F.lit("same").alias("proper_type"))
    got = D.merge_lexemes(p, ["lemma", "cat"], ["orth"], "proper_type")
    return got.select("lemma", "cat", "n", F.size("forms").cast("long").alias("n_forms"), F.md5(F.array_join("forms.orth", ",")).alias("forms"))


@query("SELECT p_name AS orth, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS interps FROM part GROUP BY 1")
def interp_merge(spark, sf_dir):
    """E3."""
    return D.merge_interps(table(spark, sf_dir, "part").select(F.col("p_name").alias("orth"), F.col("p_type").alias("interp")), ["orth"])


@query("SELECT event_type AS key, count(*) AS n FROM events GROUP BY 1")
def hist_by_selector(spark, sf_dir):
    """E16."""
    return D.histogram(table(spark, sf_dir, "events"), F.col("event_type"))


@query("WITH a AS (SELECT DISTINCT l FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents WHERE source < 'src15')), b AS (SELECT DISTINCT l FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents WHERE source >= 'src15')) SELECT '<' AS mark, l AS line FROM (FROM a EXCEPT FROM b) UNION ALL SELECT '>', l FROM (FROM b EXCEPT FROM a)")
def dict_diff(spark, sf_dir):
    """E17."""
    lines = docs(spark, sf_dir).select("source", F.explode(F.split("text", "\n")).alias("line"))
    return D.diff(lines.filter("source < 'src15'").select("line"), lines.filter("source >= 'src15'").select("line"))


@query("SELECT o_custkey, o_orderkey, o_totalprice, before FROM (SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) WHERE o_totalprice < before")
def lemma_monotonicity(spark, sf_dir):
    """E18."""
    return D.out_of_order(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_custkey", "o_orderkey", "o_totalprice", "before")


_PREFIXES = ("re", "un", "th", "en", "ver")


@query(f"WITH v AS MATERIALIZED ({VOCAB}), x AS MATERIALIZED (SELECT DISTINCT p || orth AS w FROM v, (SELECT unnest({list(_PREFIXES)}) AS p)) SELECT orth AS word FROM v ANTI JOIN x ON v.orth = x.w")
def prefix_selfjoin_antijoin(spark, sf_dir):
    """E15."""
    return D.without_prefixed(vocabulary(spark, sf_dir).select(F.col("orth").alias("word")), _PREFIXES)


@query(f"""WITH p AS (SELECT orth, lemma FROM ({PROBE}) WHERE rule_id <> 'r9' AND lemma <> ''), c AS (SELECT orth, lemma, (SELECT max(k) FROM range(0, least(length(orth), length(lemma)) + 1) AS r(k) WHERE left(orth, k::INT) = left(lemma, k::INT))::INT AS k FROM p),
r AS (SELECT substr(orth, k + 1) AS find, substr(lemma, k + 1) AS set_, lemma, count(*) AS k FROM c GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY find, set_ ORDER BY lemma) AS place FROM r)
SELECT find, set_, sum(k)::BIGINT AS n, string_agg(lemma, ' ' ORDER BY lemma) FILTER (place <= 20) AS examples FROM n GROUP BY ALL""")
def rule_examples_top20(spark, sf_dir):
    """E9, E20."""
    got = M.probe_suffix_rules(vocabulary(spark, sf_dir), rules(spark).filter("rule_id <> 'r9'"), 4).filter("lemma <> ''")
    return D.induce_suffix_rules(got.select("orth", "lemma")).select("find", "set_", "n", "examples")


@query(f"SELECT orth, rule_id, star FROM (SELECT *, min((CASE star WHEN 'Productive' THEN '0' WHEN 'Ndm' THEN '1' ELSE '2' END) || star) OVER (PARTITION BY orth) AS best FROM ({PROBE})) WHERE star = substr(best, 2)")
def bucket_tiebreak(spark, sf_dir):
    """E22."""
    got = M.probe_suffix_rules(vocabulary(spark, sf_dir), rules(spark), 4)
    return D.pick_bucket(got, ["orth"], "star", ["Productive", "Ndm"]).select("orth", "rule_id", "star")


@query(f"SELECT orth, rule_id, find FROM (SELECT *, min(length(find)) OVER (PARTITION BY orth) AS k FROM ({PROBE}) WHERE find <> '') WHERE length(find) = k")
def min_length_pick(spark, sf_dir):
    """E23."""
    got = M.probe_suffix_rules(vocabulary(spark, sf_dir), rules(spark), 4).filter("find <> ''")
    return D.shortest(got, ["orth"], "find").select("orth", "rule_id", "find")


@query(f"SELECT rule_id, sum(f)::BIGINT AS freq, string_agg(star || ':' || f, ',' ORDER BY star || ':' || f) AS by_type FROM (SELECT rule_id, star, sum(n)::BIGINT AS f FROM ({PROBE}) GROUP BY ALL) GROUP BY 1")
def rule_frequencies(spark, sf_dir):
    """E21."""
    return D.rule_frequencies(M.probe_suffix_rules(vocabulary(spark, sf_dir), rules(spark), 4), "rule_id", "star", "n")


@query(f"SELECT stem, find AS suffix, string_agg(DISTINCT rule_id, ' ' ORDER BY rule_id) AS rule_ids FROM ({PROBE}) GROUP BY ALL")
def stem_dict(spark, sf_dir):
    """E24."""
    got = M.probe_suffix_rules(vocabulary(spark, sf_dir), rules(spark), 4)
    return D.stem_dictionary(got.withColumnRenamed("find", "suffix"))


_SELECTORS = [("ation", 1), ("tion", 2), ("ing", 2), ("ed", 3), ("s", 4), ("", 9)]


@query(f"SELECT orth, CASE WHEN count(DISTINCT stem) FILTER (priority = p) = 1 THEN min(stem) FILTER (priority = p) ELSE '' END AS stem FROM (SELECT orth, left(orth, length(orth) - length(s)) AS stem, priority, min(priority) OVER (PARTITION BY orth) AS p FROM ({VOCAB}), {sql_values(_SELECTORS, 's, priority')} WHERE suffix(orth, s)) GROUP BY orth")
def stem_generation(spark, sf_dir):
    """E8."""
    return D.stem_by_priority(vocabulary(spark, sf_dir).select("orth"), values(spark, _SELECTORS, "suffix string, priority int"), "orth")


_ENDINGS = ("ment", "ly", "keit", "ung")


@query(f"SELECT stem, suffix, count(*) AS n FROM (SELECT orth, suffix, left(orth, length(orth) - length(suffix)) AS stem FROM (SELECT orth, CASE {' '.join(f"WHEN suffix(orth, '{s}') AND length(orth) > {len(s)} THEN '{s}'" for s in sorted(_ENDINGS, key=len, reverse=True))} ELSE '' END AS suffix FROM ({VOCAB}))) GROUP BY ALL")
def suffix_strip(spark, sf_dir):
    """E7."""
    return D.strip_suffixes(vocabulary(spark, sf_dir).select("orth"), "orth", _ENDINGS).groupBy("stem", "suffix").agg(F.count("*").alias("n"))


@query(f"WITH v AS ({VOCAB}) SELECT length(orth)::INT AS size, count(*) AS n FROM v WHERE orth NOT IN (SELECT orth FROM v WHERE n > 50) GROUP BY 1")
def exception_filter(spark, sf_dir):
    """E6."""
    v = vocabulary(spark, sf_dir)
    return D.without(v, v.filter("n > 50").select("orth"), "orth").groupBy(F.length("orth").alias("size")).agg(F.count("*").alias("n"))


_VOW = "aeiouyáéíóúàèìòùâêîôûäöü"


@query(f"SELECT regexp_extract(orth, '([{_VOW}]?)([^{_VOW}]*)$', 1) AS vowel, regexp_extract(orth, '([{_VOW}]?)([^{_VOW}]*)$', 2) AS cluster, count(*) AS n FROM ({VOCAB}) GROUP BY ALL")
def ending_clusters(spark, sf_dir):
    """E25."""
    return D.final_clusters(vocabulary(spark, sf_dir).withColumnRenamed("orth", "word"))


@query(f"SELECT find, count(DISTINCT (set_, interp)) AS n_variants, count(*) AS n FROM {RULE_SQL} GROUP BY 1 HAVING count(DISTINCT (set_, interp)) > 1")
def rule_conflicts(spark, sf_dir):
    """E28."""
    return D.conflicts(rules(spark), ["find"], ["set_", "interp"])


@query("SELECT lang, count(*) AS n, count(pred) AS decided, count(*) FILTER (pred = quality) AS \"right\", count(pred) / count(*) AS coverage, CASE WHEN count(pred) > 0 THEN count(*) FILTER (pred = quality) / count(pred) END AS precision, count(*) FILTER (pred = quality) / count(*) AS strict_precision FROM (SELECT lang, quality, CASE WHEN n_chars > 3000 THEN 1 WHEN n_chars < 500 THEN 0 END AS pred FROM documents JOIN labels USING (doc_id)) GROUP BY 1")
def coverage_precision(spark, sf_dir):
    """E29."""
    d = docs(spark, sf_dir).select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return D.evaluate(d, ["lang"], F.when(F.col("n_chars") > 3000, 1).when(F.col("n_chars") < 500, 0), F.col("quality"))


@query(f"SELECT orth, coalesce(c, 0)::BIGINT AS n FROM ({VOCAB}) LEFT JOIN (SELECT orth, count(*) AS c FROM ({PROBE}) WHERE rule_id <> 'r9' GROUP BY 1) USING (orth) WHERE coalesce(c, 0) <> 1")
def exactly_one(spark, sf_dir):
    """E30."""
    v = vocabulary(spark, sf_dir)
    return D.not_exactly_one(v, M.probe_suffix_rules(v, rules(spark).filter("rule_id <> 'r9'"), 4), ["orth"])


@query(f"SELECT lemma_len, all_valid, any_valid, count(*) AS n FROM (SELECT length(orth)::INT AS lemma_len, orth, bool_and(find <> '') AS all_valid, bool_or(find <> '') AS any_valid FROM ({PROBE}) GROUP BY ALL) GROUP BY ALL")
def validation_flags(spark, sf_dir):
    """E12, E13, E27."""
    got = M.probe_suffix_rules(vocabulary(spark, sf_dir), rules(spark), 4).select("orth", "rule_id", "find")
    flagged = D.validated(got, got.filter("find <> ''"), ["orth", "rule_id"])
    return D.validated_entries(flagged, "orth").groupBy(F.length("orth").alias("lemma_len"), "all_valid", "any_valid").agg(F.count("*").alias("n"))


@query("SELECT p_type, replace(p_type, 'perf.imperf', 'imperf.perf') AS normal, count(*) AS n FROM (SELECT p_type || CASE WHEN p_size % 3 = 0 THEN ':neg' WHEN p_size % 3 = 1 THEN ':perf.imperf' ELSE ':pos' END AS p_type FROM part) WHERE NOT suffix(p_type, ':neg') GROUP BY ALL")
def interp_normalise(spark, sf_dir):
    """E4, E5, E14."""
    p = table(spark, sf_dir, "part").withColumn("p_type", F.concat("p_type", F.when(F.col("p_size") % 3 == 0, ":neg").when(F.col("p_size") % 3 == 1, ":perf.imperf").otherwise(":pos")))
    return D.drop_neg_sup(p, "p_type").groupBy("p_type", D.normal_aspect(F.col("p_type")).alias("normal")).agg(F.count("*").alias("n"))


@query("SELECT classes, count(*) AS n FROM (SELECT concat_ws('|', CASE WHEN p_size % 2 = 0 THEN 'geo' END, CASE WHEN p_size % 3 = 0 THEN 'person' END, CASE WHEN p_size % 5 = 0 THEN 'other' END) AS l, concat_ws(',', CASE WHEN p_size % 3 = 0 THEN 'PERSON' END, CASE WHEN p_size % 2 = 0 THEN 'PLACE' END) AS classes FROM part) GROUP BY 1")
def name_types(spark, sf_dir):
    """E19."""
    label = F.concat_ws("|", *[F.when(F.col("p_size") % k == 0, n) for k, n in ((2, "geo"), (3, "person"), (5, "other"))])
    classes = F.array_join(D.name_types(label, {"geo": "PLACE", "person": "PERSON"}), ",")
    return table(spark, sf_dir, "part").groupBy(classes.alias("classes")).agg(F.count("*").alias("n"))
