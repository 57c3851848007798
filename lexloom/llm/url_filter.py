"""Operator 7: URL filter by a path-template tree, with allow/block rules before it.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
path: from there up to ``?``, ``#`` or the end; both empty for a null url or one without
``://``. A rule fits its host and all subdomains if the path starts with its path; the
longest (host and path) wins, a later-named one on a tie.

For urls without a rule the urls with one are the labelled examples. Per host, paths form a
tree of segments. Segments that look variable (numbers, long hexadecimal or mixed ones)
become ``*``, extension kept. Level by level, a node with many children, nearly one per
page, has them generalised to ``*``; else children whose share of blocked pages is within
Z standard errors of their parent's (unlabelled ones too) are merged into one branch ``~``.
Levels beyond LEVELS stay below one branch ``**``. A template's purity is its blocked share,
smoothed by STRENGTH pages of the prior: the blocked share of the same pattern over all
hosts, itself smoothed by the overall share. Above THRESHOLD its pages are blocked.

Counts are combined before each shuffle; after the first grouping (distinct host and
pattern) only counts move. Nothing is labelled: all unruled pages are allowed. Repeated
rows and null ids stay as they are; extra columns are ignored; an empty table gives an
empty one. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import written

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
LEVELS = 4
MANY_CHILDREN = 8
#: Children to pages of a node whose children are variable, in percent.
VARIABLE_PERCENT = 50
Z = 2
STRENGTH = 4
THRESHOLD = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# No braces and no backslashes: the same text serves both SQL dialects.
_VARIABLE = f"^([0-9]+|{'[0-9a-f]' * 8}+|[a-z]*[0-9]{'[0-9a-z_-]' * 7}+)([.][a-z0-9]+)?$"

_PARSED = f"""
SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host,
       regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM {{pages}}) AS cut
"""


def _fill(text: str, **names: str) -> str:
    for name, value in names.items():
        text = text.replace("{" + name + "}", value)
    return text


def _case(value) -> str:
    """CASE over the rules, longest first; value: host, path, verdict -> SQL literal."""
    ordered = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    whens = " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND path LIKE '{p}%' THEN '{value(h, p, v)}'" for h, p, v in ordered)
    return f"CASE {whens} END"


_RULED = f"""
SELECT page_id, host, path, {_case(lambda h, p, v: h + p)} AS rule, {_case(lambda h, p, v: v)} AS ruled FROM {{parsed}} AS parsed
"""
_SEGMENTS = f"""
SELECT *, {{join}} AS pattern FROM (
  SELECT *, {{map}}(split(substring(path, 2), '/'), {{x}} CASE WHEN {{like}}(x, '{_VARIABLE}') THEN regexp_replace(x, '{_VARIABLE}', '*{{second}}') ELSE x END) AS segs
  FROM {{ruled}} AS ruled) AS cut
"""
_PATHS = """
SELECT host, pattern, any_value(segs) AS segs, count(*) AS pages,
       sum(CASE WHEN ruled IS NOT NULL THEN 1 ELSE 0 END) AS labelled, sum(CASE WHEN ruled = 'block' THEN 1 ELSE 0 END) AS bad
FROM {rows} GROUP BY host, pattern
"""


def _level(d: int, at: str) -> tuple[str, str, str]:
    """SQL of level d: children of each node, the nodes, and the paths with their template one longer."""
    seg = f"CASE WHEN {{size}}(segs) < {d} THEN NULL ELSE {{get}}(segs, {d}) END"
    kids = f"SELECT host, template, seg, sum(pages) AS pages, sum(labelled) AS labelled, sum(bad) AS bad FROM (SELECT *, {seg} AS seg FROM {at}) AS cut WHERE seg IS NOT NULL GROUP BY host, template, seg"
    nodes = "SELECT host, template, count(*) AS n_kids, sum(pages) AS n_pages, sum(labelled) AS n_labelled, sum(bad) AS n_bad FROM {kids} AS kids GROUP BY host, template"
    symbol = f"""CASE WHEN n_kids >= {MANY_CHILDREN} AND 100 * n_kids >= {VARIABLE_PERCENT} * n_pages THEN '*'
        WHEN n_kids = 1 THEN k.seg
        WHEN k.labelled = 0 THEN '~'
        WHEN abs(CAST(k.bad AS DOUBLE) / k.labelled - CAST(n_bad AS DOUBLE) / n_labelled)
             <= {Z} * sqrt((n_bad + 0.5e0) * (n_labelled - n_bad + 0.5e0) / ((n_labelled + 1e0) * (n_labelled + 1e0)) / k.labelled) THEN '~'
        ELSE k.seg END"""
    chosen = f"SELECT k.host, k.template, k.seg, {symbol} AS symbol FROM {{kids}} AS k JOIN {{nodes}} AS n ON k.host = n.host AND k.template = n.template"
    return kids, nodes, chosen


def _grow(d: int, at: str, chosen: str) -> str:
    seg = f"CASE WHEN {{size}}(segs) < {d} THEN NULL ELSE {{get}}(segs, {d}) END"
    return f"""SELECT p.host, p.pattern, p.segs, p.pages, p.labelled, p.bad,
        CASE WHEN c.symbol IS NULL THEN p.template ELSE concat(p.template, '/', c.symbol) END AS template
        FROM (SELECT *, {seg} AS seg FROM {at}) AS p LEFT JOIN {chosen} AS c ON p.host = c.host AND p.template = c.template AND p.seg = c.seg"""


_FINAL = f"""
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.ruled, CASE WHEN v.purity > {THRESHOLD}e0 THEN 'block' ELSE 'allow' END) AS verdict, v.template, round(v.purity, 6) AS purity
FROM {{rows}} AS r JOIN {{verdicts}} AS v ON r.host = v.host AND r.pattern = v.pattern
"""
_DEEP = f"SELECT host, pattern, pages, labelled, bad, CASE WHEN {{size}}(segs) > {LEVELS} THEN concat(template, '/**') ELSE template END AS template FROM {{at}}"
_VERDICTS = f"""
SELECT p.host, p.pattern, p.template, (t.bad + {STRENGTH}e0 * g.prior) / (t.labelled + {STRENGTH}e0) AS purity
FROM {{deep}} AS p
JOIN (SELECT host, template, sum(labelled) AS labelled, sum(bad) AS bad FROM {{deep}} AS x GROUP BY host, template) AS t ON p.host = t.host AND p.template = t.template
JOIN (SELECT pattern, (sum(bad) + {STRENGTH}e0 * {{overall}}) / (sum(labelled) + {STRENGTH}e0) AS prior FROM {{deep}} AS x GROUP BY pattern) AS g ON p.pattern = g.pattern
"""


#: What the two dialects say differently.
_SPARK = {"x": "x ->", "size": "size", "get": "element_at", "map": "transform", "like": "regexp_like", "second": "$2", "join": "concat_ws('/', segs)"}
_DUCK = {"x": "lambda x:", "size": "len", "get": "list_extract", "map": "list_transform", "like": "regexp_matches", "second": "\\2", "join": "array_to_string(segs, '/')"}


def url_filter(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity: a row for every row of pages."""
    spark = pages.sparkSession
    # No views are registered: each step is SQL over DataFrames passed by name.
    sql = lambda text, **tables: spark.sql(_fill(text, **_SPARK), **tables)
    parsed = sql(_PARSED, pages=pages.select("page_id", "url"))
    ruled = sql(_fill(_RULED, parsed="{parsed}"), parsed=parsed)
    rows = written(sql(_SEGMENTS, ruled=ruled), "urls")
    at = sql(_PATHS, rows=rows).withColumn("template", F.lit(""))
    at = written(at, "paths")
    for d in range(1, LEVELS + 1):
        kids, nodes, chosen = _level(d, "{at}")
        k = sql(kids, at=at)
        n = sql(nodes, kids=k)
        c = sql(chosen, kids=k, nodes=n)
        at = written(sql(_grow(d, "{at}", "{chosen}"), at=at, chosen=c), "level")
    deep = sql(_DEEP, at=at)
    labelled, bad = deep.agg(F.sum("labelled"), F.sum("bad")).first()
    overall = f"CAST({bad or 0} AS DOUBLE) / {max(1, labelled or 0)}"
    verdicts = sql(_VERDICTS.replace("{overall}", overall), deep=deep)
    return sql(_FINAL, rows=rows, verdicts=verdicts)


def _oracle() -> str:
    with_ = [
        ("parsed", _fill(_PARSED, pages="pages")),
        ("ruled", _fill(_RULED, parsed="parsed")),
        ("urls", _fill(_SEGMENTS, ruled="ruled", **_DUCK)),
        ("paths0", f"SELECT *, '' AS template FROM ({_fill(_PATHS, rows='urls')})"),
    ]
    for d in range(1, LEVELS + 1):
        kids, nodes, chosen = _level(d, f"paths{d - 1}")
        with_ += [
            (f"kids{d}", _fill(kids, **_DUCK)),
            (f"nodes{d}", nodes.replace("{kids}", f"kids{d}")),
            (f"chosen{d}", chosen.replace("{kids}", f"kids{d}").replace("{nodes}", f"nodes{d}")),
            (f"paths{d}", _fill(_grow(d, f"paths{d - 1}", f"chosen{d}"), **_DUCK)),
        ]
    with_.append(("deep", _fill(_DEEP, at=f"paths{LEVELS}", **_DUCK)))
    overall = "(SELECT CAST(coalesce(sum(bad), 0) AS DOUBLE) / greatest(1, coalesce(sum(labelled), 0)) FROM deep)"
    with_.append(("verdicts", _VERDICTS.replace("{overall}", overall).replace("{deep}", "deep")))
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in with_) + _FINAL.replace("{rows}", "urls").replace("{verdicts}", "verdicts")


ORACLE_SQL = _oracle()
