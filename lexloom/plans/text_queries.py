"""Queries over paragraphs, tokens and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexloom.functions import tags, tokens
from lexloom.operators.grouped import apart
from lexloom.plans.base import query, sql_values, table, values
from lexloom.sources import text

RUNS = f"SELECT doc_id, par_id, unnest(regexp_extract_all(paragraph, '({tokens.TOKEN})')) AS run, generate_subscripts(regexp_extract_all(paragraph, '({tokens.TOKEN})'), 1) AS k FROM (SELECT doc_id, unnest(p) AS paragraph, generate_subscripts(p, 1) AS par_id FROM (SELECT doc_id, list_filter(string_split_regex(text, '[\\n\\r]'), lambda x: x <> '') AS p FROM documents))"
PARS = "SELECT doc_id, unnest(p) AS paragraph, generate_subscripts(p, 1)::INT AS par_id FROM (SELECT doc_id, list_filter(string_split_regex(text, '[\\n\\r]'), lambda x: x <> '') AS p FROM documents)"
EDGES = f"""
WITH runs AS ({RUNS}),
placed AS (SELECT *, coalesce(sum(length(run)) OVER (PARTITION BY doc_id, par_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos,
  lead(run) OVER (PARTITION BY doc_id, par_id ORDER BY k) AS after FROM runs),
edges AS (SELECT doc_id, par_id::INT AS par_id, row_number() OVER (PARTITION BY doc_id, par_id ORDER BY k)::INT AS tok, run AS orth, (100 * (pos + 1))::INT AS beg, (100 * length(run))::INT AS len,
  (100 * (pos + 1 + length(run) + CASE WHEN regexp_matches(coalesce(after, ''), '^[ \\t\\r\\n\\f]') THEN length(after) ELSE 0 END))::INT AS nxt
  FROM placed WHERE NOT regexp_matches(run, '^[ \\t\\r\\n\\f]'))
"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenise(tokens.paragraphs(docs(spark, sf_dir).select("doc_id", "text")))


@query(f"SELECT doc_id, par_id, paragraph FROM ({PARS})")
def para_split(spark, sf_dir):
    """S2."""
    return tokens.paragraphs(docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", "par_id", "paragraph")


@query(EDGES + "SELECT doc_id, par_id, tok, orth, beg, len, nxt FROM edges")
def token_edges(spark, sf_dir):
    """T1, T2, T12, T15."""
    return edges(spark, sf_dir)


_KIND = """CASE WHEN regexp_matches(orth, '^\\p{N}+$') THEN 'Digits'
  WHEN NOT regexp_matches(orth, '^\\p{L}+$') THEN CASE WHEN regexp_matches(orth, '^[.,;:!?]$') THEN 'Interp' WHEN regexp_matches(orth, '^[-+*/=<>%$#@&|]$') THEN 'Symbol' ELSE 'Other' END
  WHEN length(orth) = 1 AND orth <> lower(orth) THEN 'CapLetter' WHEN length(orth) = 1 THEN 'SmallLetter' WHEN orth = lower(orth) THEN 'AllSmall' WHEN orth = upper(orth) THEN 'AllCap'
  WHEN substr(orth, 1, 1) <> lower(substr(orth, 1, 1)) AND substr(orth, 2) = lower(substr(orth, 2)) THEN 'FirstCap' ELSE 'SomeCap' END"""


@query(f"SELECT {_KIND} AS kind, count(*) AS n, sum(length(orth))::BIGINT AS chars FROM (SELECT run AS orth FROM ({RUNS}) WHERE NOT regexp_matches(run, '^[ \\t\\r\\n\\f]')) GROUP BY 1")
def token_kind_hist(spark, sf_dir):
    """No offsets needed, so runs are exploded in the JVM and counted map-side."""
    runs = docs(spark, sf_dir).select(F.explode(tokens.runs(F.col("text"))).alias("orth"))
    runs = runs.filter(~F.col("orth").rlike("^[ \t\r\n\f]"))
    return runs.groupBy(tokens.case_kind(F.col("orth")).alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("orth")).alias("chars"))


_DIGITS = """SELECT mode, value, count(*) AS n FROM (SELECT unnest(r, recursive := true) FROM (SELECT list_filter([
  {'mode': 'dig', 'value': d}, CASE WHEN d[1] <> '0' THEN {'mode': 'posnum', 'value': d} END, CASE WHEN d = '0' OR d[1] <> '0' THEN {'mode': 'natnum', 'value': d} END,
  CASE WHEN length(d) <= 2 AND d::BIGINT BETWEEN 1 AND 12 THEN {'mode': 'month', 'value': lpad(d::BIGINT::VARCHAR, 2, '0')} END,
  CASE WHEN length(d) <= 2 AND d::BIGINT BETWEEN 0 AND 24 THEN {'mode': 'hour', 'value': lpad(d::BIGINT::VARCHAR, 2, '0')} END,
  CASE WHEN length(d) <= 2 AND d::BIGINT BETWEEN 1 AND 31 THEN {'mode': 'day', 'value': lpad(d::BIGINT::VARCHAR, 2, '0')} END,
  CASE WHEN length(d) = 2 AND d[1] < '6' THEN {'mode': 'minute', 'value': lpad(d::BIGINT::VARCHAR, 2, '0')} END,
  {'mode': length(d)::VARCHAR || 'dig', 'value': d}, CASE WHEN length(d) <= 3 AND d[1] <> '0' THEN {'mode': 'pref3dig', 'value': d} END], lambda x: x IS NOT NULL) AS r FROM RUNS)) GROUP BY ALL"""


@query(_DIGITS.replace("RUNS", "(SELECT unnest(regexp_extract_all(text, '[0-9]+')) AS d FROM documents)"))
def digit_classes(spark, sf_dir):
    """T3."""
    d = docs(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit("([0-9]+)"), F.lit(1))).alias("d"))
    return d.select(F.inline(tokens.digit_classes(F.col("d")))).groupBy("mode", "value").agg(F.count("*").alias("n"))


@query(_DIGITS.replace("RUNS", "(SELECT unnest(regexp_extract_all(props, '[0-9]+')) AS d FROM events)").replace("mode, value, count", "mode, count(DISTINCT value) AS n_values, count").replace("GROUP BY ALL", "GROUP BY mode"))
def digit_classes_events(spark, sf_dir):
    """T3 over event properties."""
    d = table(spark, sf_dir, "events").select(F.explode(F.regexp_extract_all("props", F.lit("([0-9]+)"), F.lit(1))).alias("d"))
    return d.select(F.inline(tokens.digit_classes(F.col("d")))).groupBy("mode").agg(F.countDistinct("value").alias("n_values"), F.count("*").alias("n"))


_DECADES = [["", *("M" * i for i in range(1, 4))], *(["", a, 2 * a, 3 * a, a + b, b, b + a, b + 2 * a, b + 3 * a, a + c] for a, b, c in ("CDM", "XLC", "IVX"))]
_NUMERALS = "SELECT n AS value, " + " || ".join(f"({d})[n // {10**k} % 10 + 1]" for d, k in zip(_DECADES, (3, 2, 1, 0))) + " AS orth FROM range(1, 4000) AS r(n)"


@query(f"SELECT orth, value::INT AS value, value <= 12 AS roman_month, n FROM (SELECT w AS orth, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\\p{{L}}+')) AS w FROM documents) GROUP BY w) JOIN ({_NUMERALS}) USING (orth)")
def roman_tokens(spark, sf_dir):
    """T4: whole words that are numerals, against all numerals up to 3,999 written by rule."""
    d = docs(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1))).alias("orth"))
    d = d.withColumn("value", tokens.roman_value(F.col("orth"))).filter("value is not null")
    return d.groupBy("orth", "value").agg(F.count("*").alias("n")).withColumn("roman_month", F.col("value") <= 12)


@query(f"SELECT orth, stem, suffix, n FROM (SELECT w AS orth, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w FROM documents) GROUP BY w), LATERAL (SELECT left(w, length(w) - length(s)) AS stem, s AS suffix FROM (SELECT unnest(['', {', '.join(repr(s) for s in tokens.AGGLUTINATIVE)}]) AS s) WHERE s = '' OR (suffix(w, s) AND length(w) > length(s)))".replace("SELECT w AS orth, count(*) AS n", "SELECT w AS orth, w, count(*) AS n"))
def agglutinative_splits(spark, sf_dir):
    """Over the vocabulary, not over every occurrence."""
    v = tokens.words(docs(spark, sf_dir)).groupBy("word").agg(F.count("*").alias("n"))
    return v.select(F.col("word").alias("orth"), "n", F.inline(tokens.suffix_splits(F.col("word")))).select("orth", "stem", "suffix", "n")


@query("SELECT w AS orth, k AS reading, p AS part FROM (SELECT w, unnest([1, 2]) AS k, unnest([[w], CASE WHEN w[1] = 'x' AND length(w) > 1 THEN ['x', substr(w, 2)] END]) AS parts FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS w FROM documents)), LATERAL (SELECT unnest(parts) AS p)")
def leading_x(spark, sf_dir):
    """T7."""
    v = tokens.words(docs(spark, sf_dir)).select(F.col("word").alias("orth")).distinct()
    return v.select("orth", F.posexplode(tokens.leading_x(F.col("orth"))).alias("k", "parts")).select("orth", (F.col("k") + 1).alias("reading"), F.explode("parts").alias("part"))


_ENT = "html"
for _n, _s in [*((k, v) for k, v in tokens.ENTITIES.items() if k != "amp"), ("amp", "&")]:
    _ENT = f"replace({_ENT}, '&{_n};', '{_s}')"


@query(f"SELECT page_id, length({_ENT})::INT AS n_chars, md5({_ENT}) AS digest FROM pages")
def html_entities(spark, sf_dir):
    """Entities."""
    plain = tokens.decode_entities(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(plain).alias("n_chars"), F.md5(plain).alias("digest"))


@query("""SELECT kind, sign, count(*) AS n FROM (SELECT s AS sign, CASE WHEN s = '.' THEN 'dot' WHEN s = '…' OR s = '...' THEN 'ellipsis' WHEN regexp_matches(s, '^[.]{2,}$') THEN 'multidot'
  WHEN s IN ('-', '–', '—', '−') THEN 'hyphen' WHEN s IN ('"', '„', '”', '“', '«', '»', '''') THEN 'quote' ELSE 'sign' END AS kind
  FROM (SELECT unnest(regexp_extract_all(text, '[.]+|[^\\p{L}\\p{N} \\t\\r\\n\\f.]')) AS s FROM documents)) GROUP BY ALL""")
def sign_kinds(spark, sf_dir):
    """Signs."""
    s = docs(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(r"([.]+|[^\p{L}\p{N} \t\r\n\f.])"), F.lit(1))).alias("sign"))
    return s.groupBy(tokens.sign_kind(F.col("sign")).alias("kind"), "sign").agg(F.count("*").alias("n"))


_LOW = lambda c, kind, p: f"list_transform(regexp_extract_all(lower({c}), '{p}'), lambda x: {{'kind': '{kind}', 'value': x}})"
_URLS = lambda c: f"list_filter({_LOW(c, 'email', tokens.EMAIL)} || {_LOW(c, 'host', tokens.HOST)} || list_filter({_LOW(c, 'ip4', tokens.IPV4)}, lambda x: len(list_filter(string_split(x.value, '.'), lambda o: o::INT > 255)) = 0), lambda x: x.value NOT IN ('m.in', 'm.st', 'b.zm'))"


@query(f"SELECT kind, value, count(DISTINCT src)::BIGINT AS n FROM (SELECT src, unnest(u, recursive := true) FROM (SELECT 'd' || doc_id AS src, {_URLS('text')} AS u FROM documents UNION ALL SELECT 'p' || page_id, {_URLS('url')} FROM pages)) GROUP BY ALL")
def url_email_hosts(spark, sf_dir):
    """Distinct per text, then counted, so a text adds one to each address."""
    one = docs(spark, sf_dir).select(F.explode(tokens.found_urls(F.col("text"))).alias("u"))
    two = table(spark, sf_dir, "pages").select(F.explode(tokens.found_urls(F.col("url"))).alias("u"))
    return one.unionAll(two).groupBy("u.kind", "u.value").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT page_id, unnest(x) AS tag, generate_subscripts(x, 1)::INT AS pos FROM (SELECT page_id, regexp_extract_all(html, '</?[A-Za-z][A-Za-z0-9]*[^<>]*>') AS x FROM pages)),
k AS (SELECT page_id, pos, lower(regexp_extract(tag, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) AS name, CASE WHEN starts_with(tag, '</') THEN -1 WHEN suffix(tag, '/>') THEN 0 ELSE 1 END AS delta FROM t)
SELECT page_id, pos, name, (sum(delta) OVER (PARTITION BY page_id, name ORDER BY pos))::BIGINT AS open_now FROM k""")
def html_tag_scope(spark, sf_dir):
    """How often each tag is open after each of its tags; a window per page and tag name."""
    t = table(spark, sf_dir, "pages").select("page_id", F.posexplode(tokens.fold_tags(F.col("html"))).alias("k", "tag"))
    delta = F.when(F.col("tag.kind") == "close", -1).when(F.col("tag.kind") == "single", 0).otherwise(1)
    w = W.partitionBy("page_id", "name").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return t.select("page_id", (F.col("k") + 1).alias("pos"), F.col("tag.name").alias("name"), delta.alias("delta")).select("page_id", "pos", "name", F.sum("delta").over(w).alias("open_now"))


@query(EDGES + "SELECT doc_id, par_id, md5(string_agg(orth || CASE WHEN beg + len < nxt THEN ' ' ELSE '' END, '' ORDER BY tok)) AS spaced, md5(string_agg(orth, '' ORDER BY tok)) AS joined FROM edges GROUP BY ALL")
def orth_concat(spark, sf_dir):
    """Of a paragraph's own text, where white space behind a token is one space or none.

    Documents of one id share paragraphs, whose tokens are gathered in order.
    """
    single, repeated = apart(docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    space = "[ \t\r\n\f]+"
    joined = F.regexp_replace("paragraph", space, "")
    spaced = F.regexp_replace(F.regexp_replace("paragraph", f"^{space}", ""), space, " ")
    found = tokens.paragraphs(single).filter(joined != "").select("doc_id", F.col("par_id").cast("int").alias("par_id"), F.md5(spaced).alias("spaced"), F.md5(joined).alias("joined"))
    if repeated is None:
        return found
    e = tokens.tokenise(tokens.paragraphs(repeated)).groupBy("doc_id", "par_id").agg(F.array_sort(F.collect_list(F.struct("tok", "orth", (F.col("beg") + F.col("len") < F.col("nxt")).alias("sp")))).alias("e"))
    spaced = F.array_join(F.transform("e", lambda x: F.concat(x["orth"], F.when(x["sp"], " ").otherwise(""))), "")
    return found.unionByName(e.select("doc_id", "par_id", F.md5(spaced).alias("spaced"), F.md5(F.array_join("e.orth", "")).alias("joined")))


# Tags of parts: part of speech by size, slots by keys, some with several values, some wild, some wrong.
_POS, _NUM, _CASE, _GENDER = ["subst", "adj", "fin", "adv", "prep", "foo"], ["sg", "pl", "sg.pl", "_"], ["nom", "gen.acc", "_", "xyz", "loc"], ["m1", "f", "m1.m2", "_"]
_PICK = {"pos": (_POS, "p_size % 6"), "num": (_NUM, "p_partkey % 4"), "cas": (_CASE, "p_partkey % 5"), "gen": (_GENDER, "(p_partkey + p_size) % 4")}
_TAG_OF = {"subst": "concat_ws(':', pos, num, cas, gen)", "adj": "concat_ws(':', pos, num, cas, gen, 'pos')", "fin": "concat_ws(':', pos, num, 'ter', 'imperf')", "adv": "concat_ws(':', pos, 'com')", "prep": "concat_ws(':', pos, cas)", "foo": "concat_ws(':', pos, num)"}
_CASES = " ".join(f"WHEN '{p}' THEN {t}" for p, t in _TAG_OF.items())
# Every seventh part has a second reading.
_TAG_EXPR = f"CASE pos {_CASES} END || CASE WHEN p_partkey % 7 = 0 THEN '|subst:pl:' || cas || ':f' ELSE '' END"
_PARTS = "SELECT *, " + ", ".join(f"{a}[({i}) + 1] AS {n}" for n, (a, i) in _PICK.items()) + " FROM part"
TAGS_SQL = f"(SELECT p_partkey, {_TAG_EXPR} AS tag FROM ({_PARTS}))"


def tagged_parts(p):
    for name, (options, at) in _PICK.items():
        p = p.withColumn(name, F.element_at(F.array(*map(F.lit, options)), F.expr(f"int({at}) + 1")))
    return p.withColumn("tag", F.expr(_TAG_EXPR))


def part_tags(spark, sf_dir):
    return tagged_parts(table(spark, sf_dir, "part")).select("p_partkey", "tag")


_ALTS = "list_transform(string_split({}, '|'), lambda a: list_transform(string_split(a, ':'), lambda s: string_split(s, '.')))"
_SLOTS = "MAP {" + ", ".join(f"'{p}': {[[p], *map(list, slots)]}" for p, slots in tags.TAGSET.items()) + "}"
_RENDER = "array_to_string(list_transform({}, lambda a: array_to_string(list_transform(a, lambda v: array_to_string(v, '.')), ':')), '|')"


@query(f"""WITH t AS (SELECT p_partkey, tag, {_ALTS.format('tag')} AS alts FROM {TAGS_SQL}), m AS (SELECT *, {_SLOTS} AS slots FROM t),
a AS (SELECT p_partkey, tag, alts, list_transform(alts, lambda a: slots[a[1][1]]) AS every FROM m),
k AS (SELECT *, len(list_filter(range(1, len(alts) + 1), lambda i: coalesce(len(every[i]), -1) <> len(alts[i]))) = 0 AS known FROM a)
SELECT p_partkey, tag, CASE WHEN known THEN {_RENDER.format("list_transform(range(1, len(alts) + 1), lambda i: list_transform(range(1, len(alts[i]) + 1), lambda j: CASE WHEN alts[i][j] = ['_'] THEN every[i][j] ELSE alts[i][j] END))")} END AS expanded,
known AND len(list_filter(range(1, len(alts) + 1), lambda i: len(list_filter(range(1, len(alts[i]) + 1), lambda j: NOT (alts[i][j] = ['_'] OR list_has_all(every[i][j], alts[i][j])))) > 0)) = 0 AS is_valid FROM k""")
def tag_expand(spark, sf_dir):
    """Tags of all parts."""
    t = part_tags(spark, sf_dir).withColumn("alts", tags.parse(F.col("tag")))
    return t.select("p_partkey", "tag", tags.render(tags.expand(F.col("alts"))).alias("expanded"), tags.valid(F.col("alts")).alias("is_valid"))


_PATTERNS = [("subst:_:nom:_",), ("adj:sg:gen.dat:_:pos",), ("fin:_:ter:_",), ("subst:pl:_:f",)]


@query(f"""WITH p AS (SELECT pattern, unnest({_ALTS.format('pattern')}) AS a FROM {sql_values(_PATTERNS, 'pattern')}), g AS (SELECT tag, unnest({_ALTS.format('tag')}) AS b FROM {TAGS_SQL})
SELECT DISTINCT pattern, tag FROM p, g WHERE len(a) = len(b) AND len(list_filter(range(1, len(a) + 1), lambda i: NOT (a[i] = ['_'] OR b[i] = ['_'] OR list_has_any(a[i], b[i])))) = 0""")
def tag_match(spark, sf_dir):
    """Patterns against tags; the pattern table is program text, hence broadcast."""
    p = values(spark, _PATTERNS, "pattern string")
    t = part_tags(spark, sf_dir).select("tag").distinct()
    return t.join(F.broadcast(p), tags.matches(tags.parse(F.col("pattern")), tags.parse(F.col("tag")))).select("pattern", "tag")


@query(f"SELECT p_partkey, pos, coalesce(coarse, pos) AS coarse FROM (SELECT p_partkey, string_split(string_split(tag, '|')[1], ':')[1] AS pos FROM {TAGS_SQL}) LEFT JOIN {sql_values(list(tags.COARSE.items()), 'pos, coarse')} USING (pos)")
def pos_coarse(spark, sf_dir):
    """Tags of all parts."""
    pos = F.split("tag", "[:|]")[0]
    return part_tags(spark, sf_dir).select("p_partkey", pos.alias("pos"), tags.coarse(pos).alias("coarse"))


@query(f"""SELECT p_partkey, string_agg(rest, '|' ORDER BY i) AS rest FROM (SELECT p_partkey, i, array_to_string(list_transform(range(1, len(a) + 1), lambda j: CASE WHEN j = 2 THEN 'sg' ELSE a[j] END), ':') AS rest
  FROM (SELECT p_partkey, generate_subscripts(string_split(tag, '|'), 1) AS i, string_split(unnest(string_split(tag, '|')), ':') AS a FROM {TAGS_SQL}) WHERE list_contains(string_split(a[2], '.'), 'sg')) GROUP BY 1""")
def tag_select(spark, sf_dir):
    """Readings of all parts that may be singular, cut to it."""
    cut = tags.select(tags.parse(F.col("tag")), 1, F.lit("sg"))
    return part_tags(spark, sf_dir).select("p_partkey", tags.render(cut).alias("rest")).filter("rest <> ''")


@query("SELECT p_partkey, p_size, array_to_string(eq, ',') AS eq, array_to_string(neq, ',') AS neq FROM (SELECT p_partkey, p_size, CASE WHEN len(s) = 0 THEN [1, 2, 3] WHEN list_has_any(s, [1, 2, 3]) THEN list_filter(s, lambda x: x IN (1, 2, 3)) END AS eq, CASE WHEN len(s) > 0 AND len(list_filter(s, lambda x: x NOT IN (1, 2, 3))) > 0 THEN list_filter(s, lambda x: x NOT IN (1, 2, 3)) END AS neq FROM (SELECT p_partkey, p_size, list_filter([p_size % 4, p_size % 4 + 1], lambda x: x > 0 AND p_size > 5) AS s FROM part))")
def selector_apply(spark, sf_dir):
    """Value sets derived from part sizes."""
    part = table(spark, sf_dir, "part")
    s = F.filter(F.array(F.col("p_size") % 4, F.col("p_size") % 4 + 1), lambda x: (x > 0) & (F.col("p_size") > 5))
    wanted = F.array(F.lit(1), F.lit(2), F.lit(3))
    return part.select("p_partkey", "p_size", F.array_join(tags.apply_selector(s, "=", wanted), ",").alias("eq"), F.array_join(tags.apply_selector(s, "<>", wanted), ",").alias("neq"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
g AS (SELECT *, sum(CASE WHEN trim(line) = '' OR length(line) < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS request FROM l)
SELECT doc_id, request::BIGINT AS request, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM g WHERE NOT (trim(line) = '' OR length(line) < 20) GROUP BY ALL""")
def request_groups(spark, sf_dir):
    """Lines up to a separator are one request; here blank or very short lines separate."""
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    return text.requests(lines, (F.trim("line") == "") | (F.length("line") < 20)).groupBy("doc_id", "request").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query("SELECT role AS name, conv_id::VARCHAR AS ident, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY ALL")
def named_paragraphs(spark, sf_dir):
    """S3: ``name | id TAB text`` lines made from conversations and read again."""
    lines = table(spark, sf_dir, "conversations").select(F.concat("role", F.lit(" | "), "conv_id", F.lit("\t"), "text").alias("line"))
    return text.named_paragraphs(lines).groupBy("name", "ident").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT p_name AS orth, p_brand AS lemma, p_type AS interp, NULL::VARCHAR AS proper_type, p_size AS freq FROM part")
def freq_tab_scan(spark, sf_dir):
    """A frequency dictionary in its text form, parsed by the source."""
    lines = table(spark, sf_dir, "part").select(F.concat_ws("", "p_size", F.lit(" "), "p_name", F.lit("\t"), "p_brand", F.lit("\t"), "p_type").alias("line"))
    return text.freq_dictionary(lines)


@query("SELECT word, n, log10(n + 1) AS freq FROM (SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS w FROM documents) GROUP BY w)")
def lemma_log_freq(spark, sf_dir):
    """S22."""
    return tokens.words(docs(spark, sf_dir)).groupBy("word").agg(F.count("*").alias("n")).withColumn("freq", F.log10(F.col("n") + 1))


@query("SELECT conv_id, turn, role, last_value(CASE WHEN turn % 3 = 0 THEN role || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations")
def section_fill(spark, sf_dir):
    """Section headers carried forward to the rows behind them."""
    c = table(spark, sf_dir, "conversations").withColumn("header", F.when(F.col("turn") % 3 == 0, F.concat("role", "turn")))
    return text.fill_sections(c, ["conv_id"], "turn", "header").select("conv_id", "turn", "role", "section")


CLASSES = [("V", "a"), ("V", "e"), ("V", "i"), ("C", "t"), ("C", "k")]
SHAPES = [(1, "C", "V", "C"), (2, "V", "C", "V")]


@query(f"SELECT rule, a.s || b.s || c.s AS form FROM {sql_values(SHAPES, 'rule, x, y, z')}, {sql_values(CLASSES, 'k, s').replace('AS t', 'AS a')}, {sql_values(CLASSES, 'k, s').replace('AS t', 'AS b')}, {sql_values(CLASSES, 'k, s').replace('AS t', 'AS c')} WHERE a.k = x AND b.k = y AND c.k = z")
def symbol_classes(spark, sf_dir):
    """Each slot of a rule becomes the symbols of its class."""
    shapes = values(spark, SHAPES, "rule int, x string, y string, z string")
    return text.expand_classes(shapes, ["x", "y", "z"], values(spark, CLASSES, "klass string, symbol string"), "form").select("rule", "form")


@query("SELECT page_id, k AS name, v AS value FROM (SELECT page_id, unnest(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&')) AS kv FROM pages), LATERAL (SELECT split_part(kv, '=', 1) AS k, split_part(kv, '=', 2) AS v) WHERE kv <> ''")
def form_fields(spark, sf_dir):
    """S29."""
    return text.form_fields(table(spark, sf_dir, "pages"), "url").select("page_id", "name", "value")
