"""Queries over parsing, terms, graphs, phonetics, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexloom.functions import tokens
from lexloom.operators import chart as C
from lexloom.operators import lattice as G
from lexloom.operators import phonetics as P
from lexloom.operators import semantics as S
from lexloom.operators.grouped import apart, by_key
from lexloom.plans.base import query, sql_values, table, values
from lexloom.plans.lattice_queries import LATTICE, lattice
from lexloom.plans.text_queries import EDGES, docs, edges
from lexloom.sources import sinks
from lexloom.streaming import requests

# --- chart parsing: an order's lines are a sentence -----------------------------------

_LEXICON = [("A", "flag", "np/n"), ("N", "flag", "n"), ("R", "flag", "(s\\np)/np"), ("A", "flag", "np"), ("N", "flag", "np\\np"), (None, "other", "s")]


def _sentences(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("at"), F.col("l_returnflag").alias("lemma"))
    place = F.dense_rank().over(W.partitionBy("l_orderkey").orderBy("at"))
    # Ranked first: the rows of an order are then in one place, and equal ones go without another shuffle.
    return li.withColumn("rnode", place).select("l_orderkey", (F.col("rnode") - 1).alias("lnode"), "rnode", "lemma").distinct().select("l_orderkey", "lnode", "rnode", F.col("lemma").alias("orth"), "lemma", F.lit("flag").alias("pos"))


@query()
def chart_parse(spark, sf_dir):
    """Every order's lines as a sentence of a toy grammar."""
    entries = C.lexical_entries(_sentences(spark, sf_dir), values(spark, _LEXICON, "lemma string, pos string, category string"))
    return C.parse(entries, ["l_orderkey"], "s", max_cost=1)


_PLACES = "SELECT l_orderkey, list(f ORDER BY l_linenumber) AS w, count(*) AS n FROM (SELECT l_orderkey, l_linenumber, string_agg(DISTINCT l_returnflag, '') AS f FROM lineitem GROUP BY ALL) GROUP BY 1"
_ACCEPTED = " OR ".join("(n = {} AND {})".format(len(w), " AND ".join(f"contains(w[{i}], '{c}')" for i, c in enumerate(w, 1))) for w in ("ARA", "ANRA", "ARAN", "ANRAN"))


@query(f"SELECT k::INT AS n_tokens, count(*) AS n FROM (SELECT n AS k, * FROM ({_PLACES})) WHERE {_ACCEPTED} GROUP BY 1")
def chart_accepts(spark, sf_dir):
    """Sentences of the language accepted at cost 0, against their listing (lengths up to five words)."""
    lexicon = [("A", "flag", "np/n"), ("N", "flag", "n"), ("R", "flag", "(s\\np)/np"), ("A", "flag", "np")]
    entries = C.lexical_entries(_sentences(spark, sf_dir), values(spark, lexicon, "lemma string, pos string, category string"))
    got = C.parse(entries, ["l_orderkey"], "s", max_cost=0).filter("status = 'Parsed' and cost = 0")
    return got.groupBy("n_tokens").agg(F.count("*").alias("n"))


_ITEMS = "SELECT DISTINCT l_suppkey AS k, l_orderkey // 50 AS i, l_orderkey // 50 + l_quantity::BIGINT // 5 AS j FROM lineitem"


@query(f"WITH t AS (SELECT k, i, max(j) AS j FROM ({_ITEMS}) GROUP BY ALL), r AS (SELECT *, max(j) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM t) SELECT k, i, j FROM r WHERE m IS NULL OR j > m")
def maximal_items(spark, sf_dir):
    """C19."""
    li = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as k", "l_orderkey div 50 as i", "l_orderkey div 50 + cast(l_quantity as bigint) div 5 as j").distinct()
    return C.maximal(li, ["k"])


@query(LATTICE + "SELECT par, max(CASE WHEN nxt = last THEN 1 ELSE 0 END)::INT AS closes, count(*) AS n FROM lat GROUP BY 1")
def chart_counters(spark, sf_dir):
    """Entries of a sentence's initial chart."""
    return lattice(spark, sf_dir).groupBy("par").agg(F.max(F.when(F.col("nxt") == F.col("last"), 1).otherwise(0)).alias("closes"), F.count("*").alias("n"))


# The first longest edge at each start, then a walk: on from its end, or from the next start where none begins there.
_COVER = LATTICE.replace("WITH base", "WITH RECURSIVE base").rstrip() + """, b AS MATERIALIZED (SELECT par, beg, nxt, orth FROM (SELECT *, row_number() OVER (PARTITION BY par, beg ORDER BY nxt DESC, orth) AS r FROM lat) WHERE r = 1),
c AS MATERIALIZED (SELECT b.*, (SELECT min(x.beg) FROM b x WHERE x.par = b.par AND x.beg >= b.nxt) AS next FROM b), w AS (SELECT * FROM c WHERE beg = (SELECT min(beg) FROM b x WHERE x.par = c.par) UNION ALL SELECT c.* FROM w JOIN c ON c.par = w.par AND c.beg = w.next)
"""


@query(_COVER + "SELECT par, beg, nxt, orth FROM w")
def greedy_cover(spark, sf_dir):
    """G19, W5."""
    e = lattice(spark, sf_dir).select("par", "beg", "nxt", "orth", F.col("orth").alias("cat"))
    return G.greedy_cover(e, ["par"]).select("par", "beg", "nxt", "orth")


@query(EDGES + "SELECT doc_id, par_id, tok, substr(paragraph, (beg / 100)::BIGINT, (len / 100)::BIGINT) AS slice FROM edges JOIN (SELECT doc_id, unnest(p) AS paragraph, generate_subscripts(p, 1)::INT AS par_id FROM (SELECT doc_id, list_filter(string_split_regex(text, '[\\n\\r]'), lambda x: x <> '') AS p FROM documents)) USING (doc_id, par_id)")
def text_slices(spark, sf_dir):
    """What an edge's position cuts from its paragraph, cut where the paragraph is at hand.

    Documents of one id share paragraphs: each edge meets all texts of its own.
    """
    columns = ["doc_id", "par_id", "tok", "slice"]
    single, repeated = apart(docs(spark, sf_dir).select("doc_id", "text").filter("doc_id is not null"), "doc_id")
    found = tokens.tokenise(tokens.paragraphs(single), slices=True).select(columns)
    if repeated is None:
        return found
    pars = tokens.paragraphs(repeated)
    return found.unionByName(G.slices(pars, tokens.tokenise(pars), ["doc_id", "par_id"]).select(columns))


# --- terms and graphs ------------------------------------------------------------------


@query()
def json_normalise(spark, sf_dir):
    """Q18-Q23: event properties under ``with`` and ``add``."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"with":['), "props", F.lit(",{},"), "props", F.lit(',{"sum":{"add":["1,5","'), (F.col("event_id") % 7).cast("string"), F.lit('"]}}]}')).alias("term"))
    return S.normalised(e, "term").select("event_id", "normal", "status")


@query("SELECT event_id, '{\"sum\":\"' || CASE WHEN event_id % 7 % 2 = 0 THEN (event_id % 7 // 2 + 1)::VARCHAR ELSE (event_id % 7 // 2 + 1)::VARCHAR || '.5' END || '\"}' AS normal, 'ok' AS status FROM events")
def json_fold(spark, sf_dir):
    """Q22: exact sums and products with a decimal comma; half of each id's remainder, and one."""
    k = (F.col("event_id") % 7).cast("string")
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"sum":{"add":["1",{"multiply":["0,5","'), k, F.lit('"]}]}}')).alias("term"))
    return S.normalised(e, "term").select("event_id", "normal", "status")


_GRAPH_RULES = [
    (1, {"cat": "Order", "roles": {"line": {"sense": "R"}}, "rest": True}, {"cat": "Order", "sense": "returned", "roles": {}, "rest": True}),
    (2, {"cat": "Order", "sense": "open", "roles": {"line": "$x"}, "rest": True}, {"cat": "Order", "sense": "seen", "roles": {"first": "$x"}, "rest": True}),
]


def _graphs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("l"))
    rel = F.transform("l", lambda x: F.concat(F.lit('["line",{"cat":"Line","sense":"'), x["l_returnflag"], F.lit('"}]')))
    return li.select("l_orderkey", F.concat(F.lit('{"cat":"Order","sense":"open","relations":['), F.array_join(rel, ","), F.lit("]}")).alias("term"))


@query()
def graph_rewrite(spark, sf_dir):
    """Q14-Q17, Q10."""
    return S.rewritten(_graphs(spark, sf_dir), "term", _GRAPH_RULES).select("l_orderkey", "graph", "status")


@query("SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R')::INT AS n_left, count(*) FILTER (l_returnflag = 'R') > 0 AS returned FROM lineitem GROUP BY 1")
def graph_rewrite_counts(spark, sf_dir):
    """Q17: the same rules; each returned line is taken out by one rewrite, until none is left."""
    got = S.rewritten(_graphs(spark, sf_dir), "term", _GRAPH_RULES)
    left = F.size(F.regexp_extract_all("graph", F.lit('("Line")'), F.lit(1)))
    return got.select("l_orderkey", left.alias("n_left"), F.contains("graph", F.lit('"returned"')).alias("returned"))


@query("WITH RECURSIVE l AS (SELECT DISTINCT conv_id * 2 AS a, (conv_id * 7 % 50) * 2 + 1 AS b FROM conversations), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r(node, c) AS (SELECT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON r.node = e.a) SELECT node, min(c) AS component FROM r GROUP BY 1")
def coref_components(spark, sf_dir):
    """Q5, V1: conversations linked to shared buckets; classes of what links reach."""
    l = table(spark, sf_dir, "conversations").selectExpr("conv_id * 2 as a", "(conv_id * 7 % 50) * 2 + 1 as b").distinct()  # noqa: E741
    return S.components(l, "a", "b")


@query("SELECT node, min(text) AS label FROM (SELECT md5(p_brand || p_type) AS node, p_brand || p_type AS text FROM part) GROUP BY 1")
def hash_cons(spark, sf_dir):
    """Q4: equal terms share one reference."""
    return table(spark, sf_dir, "part").select(F.concat("p_brand", "p_type").alias("text")).groupBy(F.md5("text").alias("node")).agg(F.min("text").alias("label"))


_FRAMES = [(1, "A", "flag", ["F"]), (2, "R", "flag", ["F", "O"]), (3, "", "flag", []), (4, "A", "flag", ["Q"])]


@query(f"SELECT l_orderkey, l_linenumber, frame_id FROM lineitem JOIN (SELECT * FROM {sql_values([f for f in _FRAMES if f[0] != 4], 'frame_id, lemma, pos, required')}) ON lemma = l_returnflag OR lemma = ''")
def frame_assign(spark, sf_dir):
    """V3, V4: frames whose lexemes occur, by lemma and by default."""
    frames = values(spark, _FRAMES, "frame_id int, lemma string, pos string, required array<string>")
    lexemes = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("lexeme"))
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("lemma"), F.lit("flag").alias("pos"))
    return S.assign_frames(t, S.reduce_frames(frames, lexemes)).select("l_orderkey", "l_linenumber", "frame_id")


@query("SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN c_name ELSE '' END AS orth FROM customer")
def unused_tokens(spark, sf_dir):
    """V2."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("orth"))
    return S.unused_tokens(c, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey", "orth")


# --- phonetics, sinks, streams ---------------------------------------------------------

_SOUNDS = [("ch", "", "x"), ("sch", "", "S"), ("c", "e", "s"), ("c", "i", "s"), ("c", "", "k"), ("qu", "", "kw"), ("ph", "", "f"), ("th", "", "T")]


@query("WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents) SELECT word, replace(regexp_replace(replace(replace(replace(replace(replace(word, 'sch', 'S'), 'ch', 'X'), 'qu', 'kw'), 'ph', 'f'), 'th', 'T'), 'c(e|i)', 's\\1', 'g'), 'c', 'k').replace('X', 'x') AS phon FROM v")
def phonetic(spark, sf_dir):
    """One derivation a word here, as its rules' contexts are disjoint."""
    w = docs(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1))).alias("word")).distinct()
    return P.transcribed(w, _SOUNDS)


@query("WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents) SELECT CASE WHEN contains(word, 'f') OR contains(word, 'ph') THEN 'MultipleSolutions' ELSE 'ok' END AS status, count(*) AS n FROM v GROUP BY 1")
def phonetic_round_trip(spark, sf_dir):
    """Ph and f sound alike, so words with either come back in more than one spelling."""
    w = docs(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1))).alias("word")).distinct()
    return P.round_trip(w, [("ph", "", "f")], [("f", "", "f"), ("f", "", "ph")]).groupBy("status").agg(F.count("*").alias("n"))


@query(EDGES + "SELECT doc_id, par_id, tok, concat_ws(chr(9), tok::VARCHAR, orth, '_', '_', '_', beg::VARCHAR, len::VARCHAR) AS line FROM edges")
def conll_lines(spark, sf_dir):
    """K2: all tokens."""
    return sinks.conll(edges(spark, sf_dir), ["doc_id", "par_id"])


@query("SELECT c_custkey, '<customer c_name=\"' || c_name || '\" c_mktsegment=\"' || replace(c_mktsegment, '&', '&amp;') || '\"/>' AS xml FROM customer")
def xml_elements(spark, sf_dir):
    """K3, K19."""
    return sinks.as_xml(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_custkey"], "customer")


@query("SELECT n_regionkey, '  \"' || n_regionkey || '\" -> \"' || n_name || '\" [label=\"' || n_nationkey || '\"]' AS line FROM nation")
def dot_lines(spark, sf_dir):
    """K8."""
    return sinks.dot(table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_regionkey").alias("src"), "n_name", "n_nationkey"), ["n_regionkey"], "src", "n_name", "n_nationkey")


@query("SELECT p_brand AS lemma, '[' || string_agg(j, ',' ORDER BY orth, size) || ']' AS forms FROM (SELECT DISTINCT p_brand, p_type AS orth, p_size AS size, '{\"orth\":\"' || p_type || '\",\"size\":' || p_size || '}' AS j FROM part) GROUP BY 1")
def lexicon_json(spark, sf_dir):
    """L28, K4, K17."""
    return sinks.lexicon_json(table(spark, sf_dir, "part").select(F.col("p_brand").alias("lemma"), F.col("p_type").alias("orth"), F.col("p_size").alias("size")))


@query("SELECT event_type, count(*) AS n, sum(user_id)::BIGINT AS total FROM events GROUP BY 1")
def stream_request_counts(spark, sf_dir):
    """The events as a file stream, counters so far at its end."""
    import uuid

    return requests.counted_once(spark, f"{sf_dir}/events.parquet", ["event_type"], "user_id", f"counts_{uuid.uuid4().hex}")


@query("SELECT conv_id, count(*) FILTER (r = 'user' AND coalesce(before, '') <> 'user') AS runs, count(*) AS turns FROM (SELECT conv_id, role AS r, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) GROUP BY 1")
def sentence_map(spark, sf_dir):
    """A program mapped over the ordered parts of each text."""

    def runs(c):
        n = sum(r == "user" and (i == 0 or c["role"][i - 1] != "user") for i, r in enumerate(c["role"]))
        return {"conv_id": c["conv_id"][:1], "runs": [n], "turns": [len(c["role"])]}

    return by_key(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], runs, "conv_id long, runs long, turns long")
