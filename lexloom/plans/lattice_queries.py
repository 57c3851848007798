"""Queries over lattices, multi-word rules, corpora and edit distance (SURVEY G, M, W, F)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexloom.functions import tokens
from lexloom.operators import corpus as C
from lexloom.operators import fuzzy as Z
from lexloom.operators import lattice as G
from lexloom.operators import mwe as M
from lexloom.operators.grouped import apart
from lexloom.plans.base import query, sql_values, table, values
from lexloom.plans.text_queries import EDGES, PARS, docs, edges

# --- lattices made of orders: line numbers are nodes, large quantities skip one -----------

LATTICE = """WITH base AS (SELECT l_orderkey AS par, l_linenumber AS beg, l_linenumber + 1 AS nxt, l_returnflag AS orth, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS unannotated, 1 AS size FROM lineitem
  WHERE NOT (l_orderkey % 11 = 0 AND l_linenumber = 2)
  UNION ALL SELECT l_orderkey, l_linenumber, l_linenumber + 2, l_returnflag || '+', 0, 2 FROM lineitem WHERE l_quantity > 25),
lim AS (SELECT l_orderkey AS par, 1 AS first, max(l_linenumber) + 1 AS last FROM lineitem GROUP BY 1),
lat AS (SELECT b.*, l.first, l.last FROM base b JOIN lim l ON b.par = l.par WHERE b.nxt <= l.last)
"""
_LIM = LATTICE.replace("WITH base", "WITH RECURSIVE base")


def lattice(spark, sf_dir):
    """One read and one shuffle: an order's last node by a window, then the edges of each line."""
    li = table(spark, sf_dir, "lineitem").filter("l_orderkey is not null")
    li = li.select(F.col("l_orderkey").alias("par"), F.col("l_linenumber").alias("beg"), F.col("l_returnflag").alias("orth"), F.when(F.col("l_discount") > 0.05, 1).otherwise(0).alias("unannotated"), (F.col("l_quantity") > 25).alias("wide"))
    li = li.withColumn("last", F.max("beg").over(W.partitionBy("par")) + 1)
    edge = lambda width, orth, unannotated: F.struct((F.col("beg") + width).alias("nxt"), orth.alias("orth"), unannotated.alias("unannotated"), F.lit(width).alias("size"))
    one = F.when(~((F.col("par") % 11 == 0) & (F.col("beg") == 2)), edge(1, F.col("orth"), F.col("unannotated")))
    two = F.when(F.col("wide"), edge(2, F.concat("orth", F.lit("+")), F.lit(0)))
    found = li.select("par", "beg", "last", F.explode(F.array(one, two)).alias("e")).filter("e.nxt <= last")
    return found.select("par", "beg", "e.nxt", "e.orth", "e.unannotated", "e.size", F.lit(1).alias("first"), "last")


_REACH = _LIM + ", r(par, node) AS (SELECT par, first FROM lim UNION SELECT l.par, l.nxt FROM r JOIN lat l ON l.par = r.par AND l.beg = r.node)"


@query(_REACH + "SELECT l.par, l.beg, l.nxt, l.orth, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.par = l.par AND r.node = l.last) THEN 'ok' ELSE 'broken' END AS status FROM lat l JOIN r ON r.par = l.par AND r.node = l.beg")
def lattice_reachable(spark, sf_dir):
    """G4, G18."""
    return G.reachable(lattice(spark, sf_dir), ["par"]).select("par", "beg", "nxt", "orth", F.when(F.col("status") == "ok", "ok").otherwise("broken").alias("status"))


@query(_LIM + """, p(par, node, cost) AS (SELECT par, first, 0 FROM lim UNION SELECT l.par, l.nxt, p.cost + l.unannotated * 1000 + l.size FROM p JOIN lat l ON l.par = p.par AND l.beg = p.node),
best AS (SELECT par, node, min(cost) AS cost FROM p GROUP BY ALL)
SELECT lim.par, (b.cost // 1000)::BIGINT AS unannotated, (b.cost % 1000)::BIGINT AS total FROM (SELECT DISTINCT par, last FROM lat) lim LEFT JOIN best b ON b.par = lim.par AND b.node = lim.last""")
def lattice_shortest(spark, sf_dir):
    """G7, G8, G10."""
    return G.fewest_unannotated(lattice(spark, sf_dir), ["par"]).select("par", "unannotated", "total")


@query(_LIM + """, q AS (SELECT par, beg, nxt, orth, first, last, size * 3 - 2 AS quality FROM lat), f(par, node, s) AS (SELECT par, first, 0 FROM lim UNION SELECT l.par, l.nxt, f.s + l.quality FROM f JOIN q l ON l.par = f.par AND l.beg = f.node),
b(par, node, s) AS (SELECT par, last, 0 FROM lim UNION SELECT l.par, l.beg, b.s + l.quality FROM b JOIN q l ON l.par = b.par AND l.nxt = b.node),
ff AS (SELECT par, node, max(s) AS s FROM f GROUP BY ALL), bb AS (SELECT par, node, max(s) AS s FROM b GROUP BY ALL)
SELECT q.par, q.beg, q.nxt, q.orth FROM q JOIN ff ON ff.par = q.par AND ff.node = q.beg JOIN bb ON bb.par = q.par AND bb.node = q.nxt JOIN ff t ON t.par = q.par AND t.node = q.last WHERE ff.s + q.quality + bb.s = t.s""")
def lattice_best_paths(spark, sf_dir):
    """Ties kept."""
    e = lattice(spark, sf_dir).withColumn("quality", (F.col("size") * 3 - 2).cast("double"))
    return G.best_paths(e, ["par"]).select("par", "beg", "nxt", "orth")


_CUT = LATTICE + """, c AS (SELECT par, beg, max(nxt) AS m FROM lat GROUP BY ALL),
d AS (SELECT *, CASE WHEN coalesce(max(m) OVER (PARTITION BY par ORDER BY beg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= beg THEN 1 ELSE 0 END AS s FROM c),
k AS (SELECT par, beg, (sum(s) OVER (PARTITION BY par ORDER BY beg ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS component FROM d)"""


@query(_CUT + "SELECT par, beg, nxt, orth, component FROM lat JOIN k USING (par, beg)")
def cutpoint_components(spark, sf_dir):
    """G11."""
    return G.components(lattice(spark, sf_dir).select("par", "beg", "nxt", "orth"), ["par"]).select("par", "beg", "nxt", "orth", "component")


@query(LATTICE.replace("lat AS (", "lat AS MATERIALIZED (") + ", n AS MATERIALIZED (SELECT par, node, dense_rank() OVER (PARTITION BY par ORDER BY node) - 1 AS k FROM (SELECT par, beg AS node FROM lat UNION SELECT par, nxt FROM lat)) SELECT l.par, l.orth, a.k::INT AS lnode, b.k::INT AS rnode FROM lat l JOIN n a ON a.par = l.par AND a.node = l.beg JOIN n b ON b.par = l.par AND b.node = l.nxt")
def lattice_renumber(spark, sf_dir):
    """G15, G16."""
    return G.renumbered(lattice(spark, sf_dir).select("par", "beg", "nxt", "orth"), ["par"]).select("par", "orth", "lnode", "rnode")


@query(LATTICE + "SELECT par, count(*) AS n, count(DISTINCT nxt) AS n_nodes FROM lat WHERE orth <> 'A' GROUP BY 1")
def category_filter(spark, sf_dir):
    """G3, G5."""
    e = lattice(spark, sf_dir).withColumn("cat", F.col("orth"))
    return G.without_category(e, "A").groupBy("par").agg(F.count("*").alias("n"), F.countDistinct("nxt").alias("n_nodes"))


# Sentences of documents: abbreviation edges span their full stop.
_ABBR = "SELECT a.doc_id, a.par_id, a.beg, b.beg + b.len - a.beg AS len, b.nxt, a.orth || '.' AS orth FROM edges a JOIN edges b ON a.doc_id = b.doc_id AND a.par_id = b.par_id AND a.nxt = b.beg AND a.beg + a.len = b.beg WHERE b.orth = '.' AND length(a.orth) <= 2"


@query(EDGES.rstrip() + f""", lat AS (SELECT doc_id, par_id, beg, len, nxt, orth FROM edges UNION ALL {_ABBR}),
c AS (SELECT *, CASE WHEN coalesce(max(nxt) OVER (PARTITION BY doc_id, par_id ORDER BY beg, nxt, orth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= beg THEN 1 ELSE 0 END AS s FROM lat),
d AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, par_id ORDER BY beg, nxt, orth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS component FROM c),
p AS (SELECT doc_id, par_id, component, min(beg) AS beg, max(nxt) AS nxt, count(*) = 1 AND bool_or(orth = '.') AS stop, count(*) AS n FROM d GROUP BY ALL),
q AS (SELECT *, coalesce(sum(stop::INT) OVER (PARTITION BY doc_id, par_id ORDER BY component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS sentence FROM p)
SELECT doc_id, par_id, sentence::BIGINT AS sentence, min(beg)::BIGINT AS beg, max(nxt)::BIGINT AS nxt, sum(n)::BIGINT AS n_edges FROM q GROUP BY ALL""")
def sentence_split(spark, sf_dir):
    """G11, G12."""
    single, repeated = apart(docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    found = tokens.map_edges(tokens.paragraphs(single), _sentences_of, "doc_id long, par_id int, sentence long, beg long, nxt long, n_edges long")
    if repeated is None:
        return found
    # Documents of one id share their paragraphs' lattices, whose edges have to meet.
    e = tokens.tokenise(tokens.paragraphs(repeated)).select("doc_id", "par_id", "beg", "len", "nxt", "orth")
    b = e.filter("orth = '.'").select("doc_id", "par_id", F.col("beg").alias("b"), F.col("len").alias("bl"), F.col("nxt").alias("bn"))
    short = e.filter("length(orth) <= 2 and beg + len = nxt")
    abbr = short.join(b, [short.doc_id == b.doc_id, short.par_id == b.par_id, short.nxt == b.b]).select(short.doc_id, short.par_id, "beg", (F.col("b") + F.col("bl") - F.col("beg")).alias("len"), F.col("bn").alias("nxt"), F.concat("orth", F.lit(".")).alias("orth"))
    got = G.sentences(e.unionByName(abbr), ["doc_id", "par_id"], F.col("orth") == ".")
    return found.unionByName(got.groupBy("doc_id", "par_id", "sentence").agg(F.min("beg").cast("long").alias("beg"), F.max("nxt").cast("long").alias("nxt"), F.count("*").alias("n_edges")))


def _sentences_of(edges: pa.RecordBatch) -> pa.RecordBatch:
    """Sentences of whole paragraphs' tokens with their abbreviations, by columns."""
    beg, length, nxt, tok = (edges.column(n).to_numpy().astype(np.int64) for n in ("beg", "len", "nxt", "tok"))
    orth = edges.column("orth")
    stop = pc.equal(orth, ".").to_numpy(zero_copy_only=False)
    key = np.cumsum(tok == 1)
    abbr = np.zeros(len(beg), bool)
    named = edges.column("doc_id").is_valid().to_numpy(zero_copy_only=False)  # without an id nothing joins
    abbr[:-1] = named[:-1] & (pc.utf8_length(orth).to_numpy()[:-1] <= 2) & (beg + length == nxt)[:-1] & stop[1:] & (key[1:] == key[:-1])
    # Each token, and behind it the edge over it and its stop.
    i = np.repeat(np.arange(len(beg)), 1 + abbr)
    wide = np.zeros(len(i), bool)
    wide[1:] = i[1:] == i[:-1]
    to = nxt[np.minimum(i + wide, len(beg) - 1)]
    # An abbreviation of a stop is longer than one.
    sentence = G.sentence_numbers(key[i], beg[i], to, stop[i] & ~wide)
    first = np.flatnonzero(np.append(True, (np.diff(key[i]) != 0) | (np.diff(sentence) != 0))[: len(i)])
    n = np.diff(np.append(first, len(i)))
    most = np.maximum.reduceat(to, first) if len(first) else to
    ids = [edges.column(c).take(pa.array(i[first])) for c in ("doc_id", "par_id")]
    return pa.RecordBatch.from_arrays([*ids, *(pa.array(x, pa.int64()) for x in (sentence[first], beg[i][first], most, n))], names=["doc_id", "par_id", "sentence", "beg", "nxt", "n_edges"])


@query(EDGES + "SELECT CASE WHEN orth = '.' THEN '<sentence>' ELSE '<clause>' END AS orth, count(*) AS n, sum(beg + len - 1)::BIGINT AS places FROM edges WHERE orth IN ('.', ',', ';', '¶') GROUP BY 1")
def clause_brackets(spark, sf_dir):
    """G14."""
    got = G.brackets(edges(spark, sf_dir)).filter("kind = 'Bracket'")
    return got.groupBy("orth").agg(F.count("*").alias("n"), F.sum("beg").alias("places"))


@query("SELECT o_custkey, o_orderkey, m AS mode FROM (SELECT *, min(p) OVER (PARTITION BY o_custkey) AS best FROM (SELECT o_custkey, o_orderkey, o_orderstatus AS m, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS p FROM orders)) WHERE p = best")
def mode_preference(spark, sf_dir):
    """G24."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("mode"))
    return G.prefer_mode(o, ["o_custkey"], ["F", "O"])


@query("SELECT par, string_agg(t, '|' ORDER BY t) AS interp FROM (SELECT par, h || ':' || string_agg(l, '.' ORDER BY l) AS t FROM (SELECT DISTINCT l_orderkey AS par, 'subst:' || l_returnflag AS h, l_linestatus AS l FROM lineitem) GROUP BY par, h) GROUP BY 1")
def interp_combine(spark, sf_dir):
    """G1."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("par"), F.concat_ws(":", F.lit("subst"), "l_returnflag", "l_linestatus").alias("interp"))
    return G.merge_interps(li, ["par"])


_FREQ = [("N", 2.5), ("A", 1.25)]


@query(f"SELECT l_orderkey, l_linenumber, w + coalesce(f.freq, w) AS weight FROM (SELECT l_orderkey, l_linenumber, l_returnflag, 0.5::DOUBLE - CASE WHEN l_quantity > 40 THEN 25 ELSE 0 END - CASE WHEN l_tax > 0.05 THEN 20 ELSE 0 END AS w FROM lineitem) LEFT JOIN {sql_values(_FREQ, 'lemma, freq').replace('AS t', 'AS f')} ON f.lemma = l_returnflag")
def edge_weights(spark, sf_dir):
    """G2, with the doubled weight where a lemma has no frequency."""
    flag = F.array_compact(F.array(F.when(F.col("l_quantity") > 40, "TokNotFound"), F.when(F.col("l_tax") > 0.05, "LemmNotVal")))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("lemma"), flag.alias("flags"), F.lit(0.5).alias("weight"))
    return G.weighted(li, values(spark, _FREQ, "lemma string, freq double")).select("l_orderkey", "l_linenumber", "weight")


# --- multi-word rules -----------------------------------------------------------------

_RULES = [("r1", 1, "orth", "of"), ("r1", 2, "orth", "the"), ("r2", 1, "orth", "in"), ("r2", 2, "orth", "the"), ("r3", 1, "orth", "to"), ("r3", 2, "orth", "the"), ("r4", 1, "orth", "and"), ("r4", 2, "cat", "PP"), ("r5", 1, "cat", "PP"), ("r5", 2, "orth", "and"), ("r5", 3, "cat", "PP"), ("r6", 1, "orth", "de"), ("r6", 2, "orth", "la"), ("r7", 1, "cat", "AND"), ("r7", 2, "orth", ","), ("r8", 1, "orth", "zzzz"), ("r8", 2, "orth", "the")]
_PROD = [("r1", "PP"), ("r2", "PP"), ("r3", "PP"), ("r4", "AND"), ("r5", "PPS"), ("r6", "PP"), ("r7", "CLAUSE"), ("r8", "NONE")]
_LITS = "('of', 'the', 'in', 'to', 'and', 'de', 'la', ',', 'zzzz')"


def _rules(spark):
    return values(spark, _RULES, "rule_id string, slot int, op string, arg string"), values(spark, _PROD, "rule_id string, cat string")


def _mwe_edges(spark, sf_dir):
    return edges(spark, sf_dir).select("doc_id", "par_id", "beg", "len", "nxt", "orth", F.lit(None).cast("string").alias("cat"))


def _match2(src: str, a: str, b: str) -> str:
    return f"SELECT x.doc_id, x.par_id, x.beg, y.beg + y.len - x.beg AS len, y.nxt, x.orth || CASE WHEN x.beg + x.len < x.nxt THEN ' ' ELSE '' END || y.orth AS orth, CATNAME AS cat FROM {src} x JOIN {src} y ON x.doc_id = y.doc_id AND x.par_id = y.par_id AND x.nxt = y.beg WHERE {a.replace('@', 'x')} AND {b.replace('@', 'y')}"


def _round(i: int) -> str:
    src = f"e{i}"
    o = lambda w: f"lower(@.orth) = '{w}'"
    c = lambda k: f"@.cat = '{k}'"
    two = [(o("of"), o("the"), "PP"), (o("in"), o("the"), "PP"), (o("to"), o("the"), "PP"), (o("and"), c("PP"), "AND"), (o("de"), o("la"), "PP"), (c("AND"), o(","), "CLAUSE")]
    parts = [_match2(src, a, b).replace("CATNAME", f"'{k}'") for a, b, k in two]
    parts.append(f"SELECT x.doc_id, x.par_id, x.beg, z.beg + z.len - x.beg AS len, z.nxt, x.orth || CASE WHEN x.beg + x.len < x.nxt THEN ' ' ELSE '' END || y.orth || CASE WHEN y.beg + y.len < y.nxt THEN ' ' ELSE '' END || z.orth AS orth, 'PPS' AS cat FROM {src} x JOIN {src} y ON x.doc_id = y.doc_id AND x.par_id = y.par_id AND x.nxt = y.beg JOIN {src} z ON z.doc_id = y.doc_id AND z.par_id = y.par_id AND y.nxt = z.beg WHERE x.cat = 'PP' AND lower(y.orth) = 'and' AND z.cat = 'PP'")
    return f", e{i + 1} AS MATERIALIZED (SELECT * FROM e{i} UNION {' UNION '.join(parts)})"


_FIX = EDGES.rstrip() + f", e0 AS MATERIALIZED (SELECT doc_id, par_id, beg, len, nxt, orth, NULL::VARCHAR AS cat FROM edges WHERE lower(orth) IN {_LITS})" + "".join(_round(i) for i in range(4))


@query(_FIX + "SELECT doc_id, par_id, beg, len, nxt, orth, cat FROM e1 WHERE cat IS NOT NULL")
def mwe_bigrams(spark, sf_dir):
    """One round."""
    r, p = _rules(spark)
    return M.produce(M.matches(_mwe_edges(spark, sf_dir), r), p).select("doc_id", "par_id", "beg", "len", "nxt", "orth", "cat")


@query(_FIX + "SELECT doc_id, par_id, beg, len, nxt, orth, cat FROM e4 UNION SELECT doc_id, par_id, beg, len, nxt, orth, NULL FROM edges")
def mwe_fixpoint(spark, sf_dir):
    """M2, M5, M7: set semantics, four rounds.

    New edges have categories and tokens have none; so new ones are distinct, and tokens are but
    for documents of one id.
    """
    r, p = _rules(spark)
    columns = ["doc_id", "par_id", "beg", "len", "nxt", "orth", "cat"]
    new = M.grown(_mwe_edges(spark, sf_dir), r, p, rounds=4)
    single, repeated = apart(docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    own = lambda d: tokens.tokenise(tokens.paragraphs(d)).withColumn("cat", F.lit(None).cast("string")).select(columns)
    found = own(single).unionByName(new.select(columns))
    return found if repeated is None else found.unionByName(own(repeated).distinct())


@query(EDGES + "SELECT 'orth' AS op, lower(orth) AS arg FROM edges GROUP BY ALL")
def lattice_vocabulary(spark, sf_dir):
    """M1."""
    return M.vocabulary(_mwe_edges(spark, sf_dir))


@query(EDGES.rstrip() + f", v AS MATERIALIZED (SELECT DISTINCT lower(orth) AS arg FROM edges) SELECT rule_id FROM {sql_values(_RULES, 'rule_id, slot, op, arg')} GROUP BY 1 HAVING bool_and(op = 'orth' AND arg IN (FROM v))")
def rule_preselect(spark, sf_dir):
    """M2."""
    return M.selected_rules(_mwe_edges(spark, sf_dir), _rules(spark)[0]).select("rule_id").distinct()


_SPANS = "SELECT DISTINCT l_suppkey AS k, l_returnflag AS label, l_orderkey AS beg, l_orderkey + l_quantity::BIGINT AS end_ FROM lineitem"


@query(f"WITH s AS ({_SPANS}) SELECT * FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE a.k = b.k AND a.label = b.label AND b.beg <= a.beg AND b.end_ >= a.end_ AND (b.beg < a.beg OR b.end_ > a.end_))")
def span_containment_antijoin(spark, sf_dir):
    """M8."""
    s = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("label"), F.col("l_orderkey").alias("beg"), (F.col("l_orderkey") + F.col("l_quantity").cast("long")).alias("end_")).distinct()
    return M.without_contained(s, ["k"], ["label"])


@query("SELECT conv_id, segment, count(*) AS n, min(turn) AS first FROM (SELECT *, (sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS segment FROM conversations) WHERE segment > 0 GROUP BY ALL")
def anchor_segments(spark, sf_dir):
    """M12."""
    got = M.segments(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.col("role") == "user")
    return got.groupBy("conv_id", "segment").agg(F.count("*").alias("n"), F.min("turn").alias("first"))


_PHRASES = [(1, ["of", "the"]), (2, ["in", "the"]), (3, ["de", "la"]), (4, ["the"])]


@query(EDGES.rstrip() + """, w AS (SELECT doc_id, par_id, tok, lower(orth) AS o, lower(lead(orth) OVER (PARTITION BY doc_id, par_id ORDER BY tok)) AS o2 FROM edges)
SELECT phrase_id, count(*) AS n, sum(tok)::BIGINT AS places FROM (SELECT CASE WHEN o = 'of' AND o2 = 'the' THEN 1 WHEN o = 'in' AND o2 = 'the' THEN 2 WHEN o = 'de' AND o2 = 'la' THEN 3 WHEN o = 'the' THEN 4 END AS phrase_id, tok FROM w) WHERE phrase_id IS NOT NULL GROUP BY 1""")
def token_trie(spark, sf_dir):
    """T14, T18."""
    toks = F.filter(tokens.runs(F.col("paragraph")), lambda t: ~t.rlike("^[ \t\r\n\f]"))
    p = tokens.paragraphs(docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", "par_id", toks.alias("toks"))
    got = M.token_trie(p, values(spark, _PHRASES, "phrase_id int, words array<string>"))
    return got.groupBy("phrase_id").agg(F.count("*").alias("n"), F.sum("at").alias("places"))


# --- corpus tools ---------------------------------------------------------------------

_HITS = ("er", "on", "thing")


def _pars(spark, sf_dir):
    return tokens.paragraphs(docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", "par_id", "paragraph")


def _toks():
    return F.filter(tokens.runs(F.col("paragraph")), lambda t: ~t.rlike("^[ \t\r\n\f]"))


_KW = EDGES.rstrip() + """, k AS (SELECT doc_id, par_id, tok AS pos, orth, list(orth) OVER (PARTITION BY doc_id, par_id ORDER BY tok ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS l, list(orth) OVER (PARTITION BY doc_id, par_id ORDER BY tok ROWS BETWEEN 1 FOLLOWING AND 22 FOLLOWING) AS r FROM edges)
SELECT doc_id, par_id, pos AS "at", coalesce(array_to_string(l, ' '), '') AS "left", orth AS hit, coalesce(array_to_string(r, ' '), '') AS "right" """


@query(_KW + "FROM k WHERE lower(orth) IN ('er', 'on', 'thing')")
def kwic_24_22(spark, sf_dir):
    """W1, K7."""
    return C.kwic(_pars(spark, sf_dir), _toks(), lambda t: F.lower(t).isin(*_HITS))


@query(_KW.replace("SELECT doc_id, par_id, pos AS", "SELECT CASE WHEN regexp_matches(orth, '^[0-9]+$') THEN 'NUMBER' ELSE 'MARK' END AS cat, doc_id, par_id, pos AS") + "FROM k WHERE regexp_matches(orth, '^[0-9]+$') OR orth IN ('#', '%', '*')")
def kwic_by_category(spark, sf_dir):
    """W2."""
    got = C.kwic(_pars(spark, sf_dir), _toks(), lambda t: t.rlike("^[0-9]+$") | t.isin("#", "%", "*"))
    return got.withColumn("cat", F.when(F.col("hit").rlike("^[0-9]+$"), "NUMBER").otherwise("MARK"))


@query(_KW.replace("SELECT doc_id, par_id, pos AS", "SELECT row_number() OVER (ORDER BY lower(orth), reverse(lower(coalesce(array_to_string(l, ' '), ''))), coalesce(array_to_string(l, ' '), ''), orth, coalesce(array_to_string(r, ' '), ''), doc_id, par_id, pos) AS place, doc_id, par_id, pos AS") + "FROM k WHERE lower(orth) = 'thing' ORDER BY place LIMIT 100")
def concordance_top(spark, sf_dir):
    """A concordance's first hundred lines; the report is a top-k."""
    got = C.kwic(_pars(spark, sf_dir), _toks(), lambda t: F.lower(t) == "thing")
    top = got.orderBy(F.lower("hit"), F.reverse(F.lower("left")), "left", "hit", "right", "doc_id", "par_id", "at").limit(100)
    keys = [F.lower("hit"), F.reverse(F.lower("left")), F.col("left"), F.col("hit"), F.col("right"), F.col("doc_id"), F.col("par_id"), F.col("at")]
    return top.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*keys)).cast("long"))


_SENT = "SELECT doc_id, i % 7 AS sentence, ['failed', 'partial', 'parsed'][(length(line) % 3 + 1)::INT] AS status, length(line) // 5 AS no_tokens, length(line) AS no_chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"


def _sents(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    n = F.length("line")
    return d.select("doc_id", ((F.col("i") + 1) % 7).alias("sentence"), F.element_at(F.array(F.lit("failed"), F.lit("partial"), F.lit("parsed")), n % 3 + 1).alias("status"), F.floor(n / 5).alias("no_tokens"), n.alias("no_chars"))


@query(f"SELECT doc_id, sum(a)::BIGINT AS no_tokens, sum(b)::BIGINT AS no_chars, sum(c)::BIGINT AS tokens_nann, sum(d)::BIGINT AS chars_nann FROM (SELECT doc_id, sentence, min(no_tokens) AS a, min(no_chars) AS b, min(CASE status WHEN 'failed' THEN no_tokens WHEN 'partial' THEN no_tokens * 17 // 100 ELSE 0 END) AS c, min(CASE WHEN status = 'failed' THEN no_chars ELSE 0 END) AS d FROM ({_SENT}) GROUP BY ALL) GROUP BY 1")
def stats_min_then_sum(spark, sf_dir):
    """W8."""
    return C.text_stats(_sents(spark, sf_dir), ["doc_id"], "sentence")


@query(f"SELECT doc_id, bool_and(status = 'parsed') AS parsed, count(*) AS n_sentences FROM ({_SENT}) GROUP BY 1")
def status_aggregate(spark, sf_dir):
    """W7."""
    return C.statuses(_sents(spark, sf_dir).withColumn("parsed", F.col("status") == "parsed"), ["doc_id"])


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN n_chars < 200 THEN 'not_parsed' WHEN l.quality = 1 THEN 'parsed' ELSE 'not_verified' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY 1")
def status_triage(spark, sf_dir):
    """W19, W18, W6, K14."""
    d = docs(spark, sf_dir).select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return C.triage(d, F.col("n_chars") < 200, F.coalesce(F.col("quality") == 1, F.lit(False))).groupBy("status").agg(F.count("*").alias("n"))


@query("WITH a AS (SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS p FROM conversations WHERE turn % 5 <> 4 GROUP BY 1), b AS (SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS p FROM conversations WHERE conv_id % 4 <> 0 GROUP BY 1) SELECT conv_id, a.p AS before, b.p AS after, CASE WHEN a.p IS NULL THEN 'new' WHEN b.p IS NULL THEN 'gone' ELSE 'changed' END AS change FROM a FULL JOIN b USING (conv_id) WHERE a.p IS DISTINCT FROM b.p")
def regression_compare(spark, sf_dir):
    """W20, Q23."""
    c = table(spark, sf_dir, "conversations")
    flat = lambda df: df.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",").alias("p"))
    return C.regression(flat(c.filter("turn % 5 <> 4")), flat(c.filter("conv_id % 4 <> 0")), "conv_id", "p")


@query("SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE lang IS DISTINCT FROM 'de') WHERE line NOT IN (SELECT unnest(string_split(text, chr(10))) FROM benchmark) AND line NOT IN (SELECT unnest(string_split(text, chr(10))) FROM documents WHERE lang = 'de') GROUP BY 1")
def new_text_antijoin(spark, sf_dir):
    """W21, W12."""
    lines = lambda df: df.select(F.explode(F.split("text", "\n")).alias("line"))
    d = docs(spark, sf_dir)
    known = lines(table(spark, sf_dir, "benchmark")).unionAll(lines(d.filter("lang = 'de'")))
    return C.new_texts(lines(d.filter("lang is distinct from 'de'")), known, "line").groupBy("line").agg(F.count("*").alias("n"))


@query("WITH m AS (SELECT doc_id AS id, source AS subcorpus FROM documents), hit AS (SELECT doc_id FROM documents WHERE list_contains(string_split_regex(text, '[ \\n]'), 'the')) SELECT id, CASE WHEN subcorpus = 'src1' AND id IN (FROM hit) THEN 'picked' ELSE subcorpus END AS subcorpus FROM m")
def subcorpus_select_move(spark, sf_dir):
    """W10, W11."""
    d = docs(spark, sf_dir)
    hit = C.with_symbol(d.select(F.col("doc_id").alias("id"), F.col("text").alias("line")), "the")
    return C.moved(d.select(F.col("doc_id").alias("id"), F.col("source").alias("subcorpus")), hit, "src1", "picked")


@query("SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)")
def sentence_dump(spark, sf_dir):
    """Sorted on output."""
    return docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).orderBy("line")


# --- edit distance --------------------------------------------------------------------


@query("WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{5,}')) AS w FROM benchmark), b AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{5,}')) AS w FROM documents) SELECT a.w AS a, b.w AS b, levenshtein(a.w, b.w)::INT AS distance FROM a, b WHERE abs(length(a.w) - length(b.w)) <= 1 AND levenshtein(a.w, b.w) <= 1")
def edit_distance_pairs(spark, sf_dir):
    """F1 as a similarity join."""
    low = lambda df: df.select(F.explode(F.regexp_extract_all("text", F.lit("([a-z]{5,})"), F.lit(1))).alias("word")).distinct()
    return Z.within_one(low(table(spark, sf_dir, "benchmark")), low(docs(spark, sf_dir)))


_PAIRS = "SELECT p_name AS observed, p_type AS correct FROM part"


@query()
def edit_class_share(spark, sf_dir):
    """edit scripts of part names against types."""
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("observed"), F.col("p_type").alias("correct")).distinct()
    return Z.edit_classes(p)


@query("SELECT p_name AS observed, p_type AS correct, damerau_levenshtein(p_name, p_type)::DOUBLE AS cost FROM (SELECT DISTINCT p_name, p_type FROM part)")
def damerau_distance(spark, sf_dir):
    """Damerau-Levenshtein by alignment."""
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("observed"), F.col("p_type").alias("correct")).distinct()
    return Z.aligned(p).select("observed", "correct", "cost")


@query()
def probabilistic_edit(spark, sf_dir):
    """F3."""
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("observed"), F.col("p_type").alias("correct")).distinct()
    return Z.aligned(p, "probabilistic").select("observed", "correct", F.round("cost", 6).alias("cost"))


@query()
def beam_correct(spark, sf_dir):
    """Order priorities with a letter doubled, corrected against their own words."""
    o = table(spark, sf_dir, "orders").select(F.lower(F.regexp_replace("o_orderpriority", "(?i)i", "ii")).alias("line")).distinct()
    return Z.corrected(o, ["urgent", "high", "medium", "not", "specified", "low", "specifiied"])


@query("SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM documents")
def vocabulary(spark, sf_dir):
    """F11."""
    return tokens.words(docs(spark, sf_dir)).select("word").distinct()


_ESC = lambda t: f"replace(replace(replace({t}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"SELECT doc_id, par_id, md5({_ESC('substr(paragraph, 1, 5)')} || CASE WHEN length(paragraph) > 5 THEN '<span class=\"HEAD\">' || {_ESC('substr(paragraph, 6, 5)')} || '</span>' || {_ESC('substr(paragraph, 11)')} ELSE '' END) AS html FROM ({PARS})")
def marked_html(spark, sf_dir):
    """K6: the span ends with a shorter paragraph, and is absent where it would be empty."""
    spans = F.array(F.struct(F.lit(5).alias("from_"), F.least(F.lit(10), F.length("paragraph")).alias("to_"), F.lit("HEAD").alias("cat")))
    spans = F.filter(spans, lambda s: s["from_"] < s["to_"])
    return _pars(spark, sf_dir).select("doc_id", "par_id", F.md5(C.marked_html(F.col("paragraph"), spans)).alias("html"))
