"""Queries over phrases, frames and transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import tokens
from lexloom.operators import fuzzy
from lexloom.operators import morphology as M
from lexloom.operators import phonetics
from lexloom.operators import phrases as P
from lexloom.plans.base import query, sql_values, table, values
from lexloom.plans.lexicon_queries import PROBE, VOCAB, rules, vocabulary

_SPLIT = "string_split(text, ' ')"


def _verses(spark, sf_dir):
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", none.alias("pre"), F.split("text", " ").alias("vis"), none.alias("post"))


def _joined(df):
    return df.select("conv_id", "turn", *[F.array_join(c, " ").alias(c) for c in ("pre", "vis", "post")])


@query(f"SELECT conv_id, turn, array_to_string(w[1:a], ' ') AS pre, array_to_string(w[a + 1:n - b], ' ') AS vis, array_to_string(w[n - b + 1:n], ' ') AS post FROM (SELECT *, least(2, n - a) AS b FROM (SELECT *, len(w) AS n, least(3, len(w)) AS a FROM (SELECT conv_id, turn, {_SPLIT} AS w FROM conversations)))")
def verse_shift(spark, sf_dir):
    """Symbols moved outwards."""
    return _joined(P.shift(_verses(spark, sf_dir), 3, 2))


@query(f"SELECT conv_id, turn, '' AS pre, array_to_string(CASE WHEN i > 0 THEN w[1:i] ELSE w END, ' ') AS vis, array_to_string(CASE WHEN i > 0 THEN w[i + 1:] ELSE [] END, ' ') AS post FROM (SELECT conv_id, turn, w, coalesce(list_position(w, 'the'), 0) AS i FROM (SELECT conv_id, turn, {_SPLIT} AS w FROM conversations))")
def verse_align(spark, sf_dir):
    """What follows a term's first occurrence moves to post."""
    return _joined(P.from_term_to_post(_verses(spark, sf_dir), ["the"]))


@query("SELECT event_id, json_keys(props) = ['k'] AND json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AS typed FROM events")
def json_typed(spark, sf_dir):
    """W22."""
    return P.typed_json(table(spark, sf_dir, "events"), "props", "k int").select("event_id", "typed")


_ENDS = [(s, f"aglt{i}") for i, s in enumerate(tokens.AGGLUTINATIVE)]


@query(f"SELECT orth, n, interp FROM ({VOCAB}) JOIN {sql_values(_ENDS, 'orth, interp')} USING (orth)")
def suffix_entries(spark, sf_dir):
    """L4."""
    return P.suffix_entries(vocabulary(spark, sf_dir), values(spark, _ENDS, "orth string, interp string")).select("orth", "n", "interp")


@query(f"SELECT orth, rule_id, row_number() OVER (PARTITION BY orth ORDER BY CASE star WHEN 'Productive' THEN 0 WHEN 'Star' THEN 1 ELSE 2 END, rule_id) ::INT AS place FROM ({PROBE})")
def analysis_order(spark, sf_dir):
    """L8."""
    got = M.probe_suffix_rules(vocabulary(spark, sf_dir), rules(spark), 4)
    return P.numbered(got, ["orth"], [("star", ["Productive", "Star"])], ["rule_id"]).select("orth", "rule_id", "place")


@query("SELECT p_brand AS lemma, bool_or(p_name <> p_brand) AS inflected, string_agg(DISTINCT g, '.' ORDER BY g) AS genders FROM (SELECT p_brand, p_name, ['m', 'f', 'n'][(p_size % 3 + 1)::INT] AS g FROM part) GROUP BY 1")
def inflection_class(spark, sf_dir):
    """L22."""
    g = F.element_at(F.array(F.lit("m"), F.lit("f"), F.lit("n")), F.col("p_size") % 3 + 1)
    return P.inflection_class(table(spark, sf_dir, "part").select(F.col("p_brand").alias("lemma"), F.col("p_name").alias("orth"), g.alias("gender")))


@query(f"SELECT orth, rule_id, score::INT AS score FROM (SELECT *, max(score) OVER (PARTITION BY orth) AS best FROM (SELECT *, length(find) * 1000000 + freq AS score FROM ({PROBE}))) WHERE score = best")
def rule_score(spark, sf_dir):
    """L23."""
    return P.by_rule_score(M.probe_suffix_rules(vocabulary(spark, sf_dir), rules(spark), 4), ["orth"]).select("orth", "rule_id", "score")


_PATTERNS = [(1, "F O", 1), (2, "O O", 2), (3, "O F", 2), (4, "F F", 1), (5, "F O", 2)]


@query(f"WITH t AS (SELECT l_orderkey AS phrase_id, list(l_returnflag ORDER BY l_linenumber) AS w, string_agg(l_linestatus, ' ' ORDER BY l_linenumber) AS tags FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY ALL) GROUP BY 1), p AS (SELECT tags, min(priority)::INT AS priority, arg_min(head, priority) AS head FROM {sql_values(_PATTERNS, 'priority, tags, head')} GROUP BY 1) SELECT phrase_id, priority, w[head] AS head, w[3 - head] AS modifiers FROM t JOIN p USING (tags)")
def canonical_phrases(spark, sf_dir):
    """Two-line orders as phrases, their statuses as tags."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("phrase_id"), F.col("l_linenumber").alias("pos")).agg(F.min("l_returnflag").alias("orth"), F.min("l_linestatus").alias("tag"))
    return P.canonical(li, values(spark, _PATTERNS, "priority int, tags string, head int"))


_DERIVED = [("ger:sg:nom:n:imperf:aff", "subst:sg:nom:n:col"), ("pact:pl:gen.loc:f:imperf:aff", "adj:pl:gen.loc:f:pos"), ("ppas:sg:dat:m1:perf:neg", "adj:sg:dat:m1:pos"), ("subst:sg:nom:f", "subst:sg:nom:f")]


@query("SELECT tag, derived FROM " + sql_values(_DERIVED, "tag, derived"))
def derived_tags(spark, sf_dir):
    """L25."""
    return values(spark, [(t,) for t, _ in _DERIVED], "tag string").select("tag", P.derived_tag(F.col("tag")).alias("derived"))


@query("SELECT l_orderkey, string_agg(l_partkey, ',' ORDER BY l_shipdate, l_partkey) AS arguments FROM lineitem GROUP BY 1")
def ordered_arguments(spark, sf_dir):
    """Q2."""
    return P.ordered_arguments(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_shipdate", "l_partkey")


@query("SELECT l_orderkey, CASE v WHEN 'A.N.R' THEN '' WHEN 'A.R' THEN 'C' ELSE v END AS value FROM (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '.' ORDER BY l_returnflag) AS v FROM lineitem GROUP BY 1)")
def abbreviated_values(spark, sf_dir):
    """Q11."""
    return P.abbreviated(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", {"A.N.R": "", "A.R": "C"})


_COERCE = [("1-URGENT", "5-LOW", "via:x"), ("2-HIGH", "3-MEDIUM", "via:y"), ("3-MEDIUM", "2-HIGH", "via:z")]


@query(f"SELECT o_orderkey, fit, path FROM (SELECT o_orderkey, CASE WHEN cat = wanted THEN 'equal' WHEN path IS NOT NULL THEN 'coerced' ELSE 'none' END AS fit, path FROM (SELECT o_orderkey, o_orderpriority AS cat, CASE o_custkey % 3 WHEN 0 THEN '5-LOW' WHEN 1 THEN '3-MEDIUM' ELSE '2-HIGH' END AS wanted FROM orders) LEFT JOIN {sql_values(_COERCE, 'cat, wanted, path')} USING (cat, wanted))")
def concept_fit(spark, sf_dir):
    """Q6, S21."""
    wanted = F.when(F.col("o_custkey") % 3 == 0, "5-LOW").when(F.col("o_custkey") % 3 == 1, "3-MEDIUM").otherwise("2-HIGH")
    nodes = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("cat"), wanted.alias("wanted"))
    return P.concepts(nodes, values(spark, _COERCE, "cat string, cat2 string, path string")).select("o_orderkey", "fit", "path")


_SCHEMA_RULES = [(1, "verb", ["sg"], "s SCHEMA"), (2, "verb", [], "s\\np SCHEMA"), (3, "noun", ["pl", "sg"], "np SCHEMA")]
_SCHEMA_FRAMES = [(1, "verb", ["sg", "pl"], "/np"), (2, "verb", ["pl"], ""), (3, "noun", [], "/pp")]


@query("SELECT rule_id, frame_id, values, category FROM " + sql_values([(1, 1, "sg", "s /np"), (2, 1, "pl.sg", "s\\np /np"), (2, 2, "pl", "s\\np "), (3, 3, "pl.sg", "np /pp")], "rule_id, frame_id, values, category"))
def schema_substitution(spark, sf_dir):
    """C5."""
    return P.substituted(values(spark, _SCHEMA_RULES, "rule_id int, pos string, values array<string>, category string"), values(spark, _SCHEMA_FRAMES, "frame_id int, pos string, values array<string>, rendered string"))


_POSITIONS = [(1, "verb", [("subj", "np(nom)"), ("obj", "np(acc)")]), (2, "verb", [("subj", "np(nom)")]), (3, "noun", [("mod", "np(gen)")])]
_VARIANTS = [("verb", "passive", "subj", "np(nom)", "prepnp(przez)"), ("verb", "passive", "obj", "np(acc)", "np(nom)"), ("verb", "impersonal", "subj", "np(nom)", None), ("noun", "plain", "mod", "x", "y")]


@query("SELECT frame_id, pos, variant, positions FROM " + sql_values([(1, "verb", "passive", "subj=prepnp(przez),obj=np(nom)"), (1, "verb", "impersonal", "obj=np(acc)"), (2, "verb", "passive", "subj=prepnp(przez)"), (3, "noun", "plain", "mod=np(gen)")], "frame_id, pos, variant, positions"))
def frame_variants(spark, sf_dir):
    """V5."""
    return P.transformed_frames(values(spark, _POSITIONS, "frame_id int, pos string, positions array<struct<role:string,phrase:string>>"), values(spark, _VARIANTS, "pos string, variant string, role string, phrase string, phrase2 string"))


_RENDER = [(1, "s", [("np", "<"), ("np", ">")]), (2, "s", []), (3, "np", [("s/np", "both")])]


@query("SELECT frame_id, category FROM " + sql_values([(1, "(s\\np)/np"), (2, "s"), (3, "np/(s/np)")], "frame_id, category"))
def frame_render(spark, sf_dir):
    """V6."""
    f = values(spark, _RENDER, "frame_id int, head string, positions array<struct<phrase:string,direction:string>>")
    return f.select("frame_id", P.rendered(F.col("head"), F.col("positions")).alias("category"))


@query("SELECT k, (coalesce(m, 0) + row_number() OVER (PARTITION BY k ORDER BY label))::BIGINT AS id, label FROM (SELECT DISTINCT o_custkey AS k, o_orderpriority AS label FROM orders) LEFT JOIN (SELECT o_custkey AS k, max(o_orderkey) AS m FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) USING (k)")
def artificial_tokens(spark, sf_dir):
    """V8."""
    o = table(spark, sf_dir, "orders")
    return P.artificial_tokens(o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id")), o.select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("label")).distinct(), ["k"])


_EDGES = [(1, True), (2, True), (3, False), (4, False), (5, False), (6, False)]
_ARGS = [(1, 2, True, False), (1, 6, False, True), (2, 3, True, False), (2, 4, False, False), (2, 5, False, True)]


@query("SELECT node, opens, closes FROM " + sql_values([(2, 1, 0), (6, 0, 1), (3, 2, 0), (5, 0, 1)], "node, opens, closes"))
def coordination_marks(spark, sf_dir):
    """M9."""
    got = P.coordination_marks(values(spark, _EDGES, "id int, coordinated boolean"), values(spark, _ARGS, "parent int, child int, first boolean, last boolean"), 3)
    return got.select("node", F.col("opens").cast("int").alias("opens"), F.col("closes").cast("int").alias("closes"))


@query()
def transcript_alignment(spark, sf_dir):
    """turns against themselves with a letter changed, by conversation and speaker."""
    c = table(spark, sf_dir, "conversations")
    own = c.select(F.col("conv_id").cast("string").alias("time"), F.col("role").alias("speaker"), F.col("turn").alias("seq"), F.col("text").alias("line"))
    return fuzzy.align_transcripts(own.withColumn("line", F.regexp_replace("line", "e", "ee")), own)


@query("SELECT DISTINCT orth, lemma, 'r1' AS rule_id FROM (SELECT w || 's' AS orth, w AS lemma FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-bd-eg-oq-z]{5,}')) AS w FROM benchmark))")
def phonetic_candidates(spark, sf_dir):
    """Plural forms lead back to their lemma; words without the letters that the sounds change."""
    w = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([a-bd-eg-oq-z]{5,})"), F.lit(1))).alias("lemma")).distinct()
    e = w.select(F.concat("lemma", F.lit("s")).alias("orth"), "lemma")
    only = rules(spark).filter("rule_id = 'r1'")
    return phonetics.candidates(e, [("ph", "", "f")], [("f", "", "f"), ("f", "", "ph")], only, 4)

