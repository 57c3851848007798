"""Operator 1: mixing sources to target weights over a domain-language-source tree.

A total token budget goes down the tree: each node's budget is dealt to its children by
weight, none gets more than it can hold (its leaves' tokens x max_epochs), and what a full
child leaves goes to its siblings by weight again. A node never gets more than its leaves
can hold, so a shortage reaches its parent's siblings only when its own siblings are full.
Integers throughout: floors, then largest remainders (ties by name).

A leaf of budget b and n tokens is read b // n whole times (epochs); the remaining tokens
are a prefix of the next epoch, whose order is a seeded hash of epoch and document id. The
prefix is a running sum in two steps: hash ranges ("buckets") of at most about the square
root of the leaf's rows are summed, the sums run over the leaf, and documents run inside
their bucket, so no task sees a whole leaf, however hot.

Tokens are words ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have none and are never
chosen. Null domains, languages and sources are the leaves ``other``, ``und`` and
``unknown``. Repeated rows count each. Extra columns, whatever their names: ignored by
``mix``, kept by ``mixed_documents``. Empty tables give empty ones. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from lexloom.llm.common import written

LEVELS = ("domain", "lang", "source")
LEAF = [f"__{x}" for x in LEVELS]
#: A leaf table of at most so many rows is broadcast; a larger one is joined by key.
BROADCAST_LEAVES = 50_000
BUCKET_ROWS = 1000

#: Production weights; what isn't named weighs DEFAULT_WEIGHT.
DOMAIN_WEIGHTS = {"web": 5, "reference": 3, "forum": 2}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 1, "es": 1}
SOURCE_WEIGHTS = {"src0": 3, "src9": 2}
DEFAULT_WEIGHT = 1
TARGET_PERCENT = 60
MAX_EPOCHS = 2
SEED = 17

_INT = T.DecimalType(38, 0)


def source_domain(source: Column) -> Column:
    """Domains of the supplied tables' sources, by the number in their name."""
    n = F.substring(source, 4, 9).try_cast("int")
    return F.when(n < 8, "web").when(n < 14, "reference").when(n.isNotNull(), "forum").otherwise("other")


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(name: Column, weights: dict[str, int]) -> Column:
    out = F.lit(DEFAULT_WEIGHT)
    for key, weight in sorted(weights.items()):
        out = F.when(name == key, weight).otherwise(out)
    return out.cast("long")


def deal(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Add ``alloc``: each node's share of ``budget`` (its parent's) by ``weight``, at most ``cap``."""
    big = lambda c: F.col(c).cast(_INT)
    order = W.partitionBy(*parents).orderBy(F.when(F.col("weight") > 0, F.col("cap").cast("double") / F.col("weight")).otherwise(0.0), name)
    group = W.partitionBy(*parents)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    nodes = nodes.withColumns({"before": before, "rest": rest})
    nodes = nodes.withColumn("full", big("cap") * big("rest") <= big("weight") * (F.col("budget") - F.col("before")).cast(_INT))
    nodes = nodes.withColumn("left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(group), F.lit(0)))
    nodes = nodes.withColumn("among", F.sum(F.when(~F.col("full"), F.col("weight"))).over(group))
    share = F.expr("case when full then cap else cast(weight as decimal(38,0)) * left div among end")
    rem = F.expr("case when full then -1 else cast(weight as decimal(38,0)) * left % among end")
    nodes = nodes.withColumns({"base": share.cast("long"), "rem": rem.cast("long")})
    nodes = nodes.withColumn("over", F.col("left") - F.coalesce(F.sum(F.when(~F.col("full"), F.col("base"))).over(group), F.lit(0)))
    place = F.row_number().over(group.orderBy(F.desc("rem"), name))
    nodes = nodes.withColumn("place", place)
    extra = F.when(~F.col("full") & (F.col("place") <= F.col("over")), 1).otherwise(0)
    return nodes.withColumn("alloc", (F.col("base") + extra).cast("long")).drop("before", "rest", "full", "left", "among", "base", "rem", "over", "place")


def leaf_budgets(leaves: DataFrame, total: int, max_epochs: int, weights: tuple[dict, dict, dict]) -> DataFrame:
    """leaves: LEAF columns, ``tokens``, ``n_rows``. Adds ``alloc``, the leaf's budget in tokens."""
    domain, lang, source = LEAF
    of = [_weight(F.col(c), w) for c, w in zip(LEAF, weights)]
    live = (of[0] > 0) & (of[1] > 0) & (of[2] > 0)
    leaves = leaves.withColumn("cap", F.when(live, F.col("tokens") * max_epochs).otherwise(F.lit(0)).cast("long"))
    langs = leaves.groupBy(domain, lang).agg(F.sum("cap").alias("cap"))
    domains = langs.groupBy(domain).agg(F.sum("cap").alias("cap"))
    root = domains.withColumns({"weight": of[0], "budget": F.lit(total).cast("long"), "__root": F.lit(0)})
    root = deal(root, ["__root"], domain).select(domain, F.col("alloc").alias("budget"))
    langs = deal(langs.join(root, domain).withColumn("weight", of[1]), [domain], lang).select(domain, lang, F.col("alloc").alias("budget"))
    found = deal(leaves.join(langs, [domain, lang]).withColumn("weight", of[2]), [domain, lang], source)
    return found.select(*LEAF, "tokens", "n_rows", "alloc")


def _with_leaf(docs: DataFrame, domain: Column, lang: Column, source: Column, text: Column, whole_row: bool = False) -> DataFrame:
    """LEAF and ``__n`` with ``__id``, and the whole row in ``__row`` if asked: no column of docs can clash."""
    row = [F.struct("*").alias("__row")] if whole_row else []
    return docs.select(
        *row,
        docs["doc_id"].alias("__id"),
        F.coalesce(domain, F.lit("other")).alias(LEAF[0]),
        F.coalesce(lang, F.lit("und")).alias(LEAF[1]),
        F.coalesce(source, F.lit("unknown")).alias(LEAF[2]),
        token_count(text).alias("__n"),
    )


def _chosen(rows: DataFrame, leaves: DataFrame, id_col: str, seed: int) -> DataFrame:
    """rows (LEAF, __n, id and more) with __full epochs and the __part tokens taken of the next."""
    size = F.greatest(F.lit(BUCKET_ROWS), F.ceil(F.sqrt("n_rows")))
    leaves = leaves.select(
        *LEAF,
        F.when(F.col("tokens") > 0, F.expr("alloc div tokens")).otherwise(0).alias("__full"),
        F.when(F.col("tokens") > 0, F.expr("alloc % tokens")).otherwise(0).alias("__rest"),
        F.ceil(F.col("n_rows") / size).cast("long").alias("__buckets"),
    )
    leaves = written(leaves, "leaves")
    small = F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.join(small, LEAF)
        text = F.concat_ws("|", F.lit(str(seed)), F.col("__full").cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
        rows = rows.withColumn("__h", F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"))
        return rows.withColumn("__bucket", F.expr("shiftright(shiftright(__h, 30) * __buckets, 30)"))

    sums = placed(rows.select(*LEAF, "__n", id_col)).groupBy(*LEAF, "__bucket").agg(F.sum("__n").alias("__sum"))
    run = W.partitionBy(*LEAF).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    ahead = sums.select(*LEAF, "__bucket", F.coalesce(F.sum("__sum").over(run), F.lit(0)).alias("__ahead"))
    inside = W.partitionBy(*LEAF, "__bucket").orderBy("__h", F.col(id_col), "__n").rowsBetween(W.unboundedPreceding, -1)
    rows = placed(rows).join(written(ahead, "ahead"), [*LEAF, "__bucket"])
    ahead_of = F.col("__ahead") + F.coalesce(F.sum("__n").over(inside), F.lit(0))
    return rows.withColumn("__part", F.greatest(F.lit(0), F.least(F.col("__n"), F.col("__rest") - ahead_of)).cast("long"))


def _plan(narrow: DataFrame, percent: int, max_epochs: int, weights) -> DataFrame:
    leaves = written(narrow.groupBy(*LEAF).agg(F.sum("__n").alias("tokens"), F.count("*").alias("n_rows")), "sizes")
    total = int(leaves.agg(F.sum("tokens")).first()[0] or 0) * percent // 100
    return leaf_budgets(leaves, total, max_epochs, weights)


_WEIGHTS = (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS)


def mix(docs: DataFrame, percent: int = TARGET_PERCENT, max_epochs: int = MAX_EPOCHS, weights=_WEIGHTS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: its leaf, tokens, whole epochs, tokens of the last epoch's prefix, tokens taken."""
    narrow = _with_leaf(docs, source_domain(docs["source"]), docs["lang"], docs["source"], docs["text"])
    narrow = written(narrow, "tokens")
    found = _chosen(narrow, _plan(narrow, percent, max_epochs, weights), "__id", seed)
    return found.select(
        F.col("__id").alias("doc_id"),
        *(F.col(c).alias(name) for c, name in zip(LEAF, LEVELS)),
        F.col("__n").alias("n_tokens"),
        F.col("__full").alias("epochs"),
        F.col("__part").alias("prefix_tokens"),
        (F.col("__full") * F.col("__n") + F.col("__part")).alias("tokens_taken"),
    )


def text_prefix(text: str, tokens: str) -> Column:
    """The text up to and with its word number ``tokens`` (names of columns)."""
    return F.expr(f"""substring({text}, 1, aggregate(split(translate({text}, '\\t\\n\\u000b\\u000c\\r', '     '), ' '),
        named_struct('n', 0L, 'at', 0),
        (a, w) -> if(a.n >= {tokens}, a, named_struct('n', a.n + if(w = '', 0L, 1L), 'at', a.at + length(w) + 1)),
        a -> a.at - 1))""")


def mixed_documents(docs: DataFrame, percent: int = TARGET_PERCENT, max_epochs: int = MAX_EPOCHS, weights=_WEIGHTS, seed: int = SEED) -> DataFrame:
    """The mix itself: rows of docs once for each epoch; the last of a leaf is cut to its prefix of tokens."""
    leaf = _with_leaf(docs, source_domain(docs["source"]), docs["lang"], docs["source"], docs["text"], whole_row=True)
    narrow = written(leaf.select(*LEAF, "__n"), "tokens")
    found = _chosen(leaf, _plan(narrow, percent, max_epochs, weights), "__id", seed)
    wholes = F.col("__full") + (F.col("__part") == F.col("__n")).cast("long")
    cut = (F.col("__part") > 0) & (F.col("__part") < F.col("__n"))
    found = found.filter("__n > 0").withColumns({"__wholes": wholes, "__cut": cut}).filter("__wholes > 0 or __cut")
    once = found.withColumn("__takes", F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("__wholes").cast("int")), F.when(F.col("__cut"), F.array("__part")).otherwise(F.array().cast("array<long>"))))
    rows = once.select("__row", F.explode("__takes").alias("__take"))
    rows = rows.withColumn("__text", F.when(F.col("__take") < 0, F.col("__row.text")).otherwise(text_prefix("__row.text", "__take")))
    out = []
    for c in docs.columns:
        own = F.col("__row")[c]
        if c == "text":
            own = F.col("__text")
        elif c == "n_chars":
            own = F.when(F.col("__take") < 0, own).otherwise(F.length("__text")).cast(docs.schema[c].dataType)
        out.append(own.alias(c))
    return rows.select(*out)


def _sql_weight(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} {' '.join(f"WHEN '{k}' THEN {v}" for k, v in sorted(weights.items()))} ELSE {DEFAULT_WEIGHT} END"


def _sql_deal(source: str, parents: str, name: str, out: str) -> str:
    return f"""
{out}_a AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before,
    (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS rest
  FROM {source} WINDOW o AS (PARTITION BY {parents} ORDER BY cap::DOUBLE / weight, {name})),
{out}_b AS (SELECT *, cap::HUGEINT * rest <= weight::HUGEINT * (budget - before) AS is_full FROM {out}_a),
{out}_c AS (SELECT *, (budget - coalesce(sum(cap) FILTER (is_full) OVER g, 0))::HUGEINT AS remaining,
    (sum(weight) FILTER (NOT is_full) OVER g)::HUGEINT AS among FROM {out}_b WINDOW g AS (PARTITION BY {parents})),
{out}_d AS (SELECT *, CASE WHEN is_full THEN cap ELSE (weight::HUGEINT * remaining) // among END AS base,
    CASE WHEN is_full THEN -1 ELSE (weight::HUGEINT * remaining) % among END AS rem FROM {out}_c),
{out}_e AS (SELECT *, remaining - coalesce(sum(base) FILTER (NOT is_full) OVER (PARTITION BY {parents}), 0) AS over_,
    row_number() OVER (PARTITION BY {parents} ORDER BY rem DESC, {name}) AS place FROM {out}_d),
{out} AS (SELECT * EXCLUDE (before, rest, is_full, remaining, among, base, rem, over_, place),
    (base + CASE WHEN NOT is_full AND place <= over_ THEN 1 ELSE 0 END)::BIGINT AS alloc FROM {out}_e)"""


ORACLE_SQL = f"""
WITH docs AS (
  SELECT doc_id, CASE WHEN TRY_CAST(substr(source, 4, 9) AS INT) < 8 THEN 'web' WHEN TRY_CAST(substr(source, 4, 9) AS INT) < 14 THEN 'reference'
    WHEN TRY_CAST(substr(source, 4, 9) AS INT) IS NOT NULL THEN 'forum' ELSE 'other' END AS domain,
    coalesce(lang, 'und') AS lang, coalesce(source, 'unknown') AS source,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {MAX_EPOCHS})::BIGINT AS cap FROM docs GROUP BY ALL),
root AS (SELECT domain, sum(cap)::BIGINT AS cap, {_sql_weight("domain", DOMAIN_WEIGHTS)} AS weight,
    ((SELECT sum(n_tokens) FROM docs) * {TARGET_PERCENT} // 100)::BIGINT AS budget, 0 AS top FROM leaves GROUP BY domain),
{_sql_deal("root", "top", "domain", "by_domain")},
lang_in AS (SELECT l.domain, l.lang, sum(l.cap)::BIGINT AS cap, {_sql_weight("l.lang", LANG_WEIGHTS)} AS weight, any_value(d.alloc) AS budget
  FROM leaves l JOIN by_domain d ON l.domain = d.domain GROUP BY l.domain, l.lang),
{_sql_deal("lang_in", "domain", "lang", "by_lang")},
leaf_in AS (SELECT l.*, {_sql_weight("l.source", SOURCE_WEIGHTS)} AS weight, b.alloc AS budget
  FROM leaves l JOIN by_lang b ON l.domain = b.domain AND l.lang = b.lang),
{_sql_deal("leaf_in", "domain, lang", "source", "by_leaf")},
plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN alloc // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN alloc % tokens ELSE 0 END AS rest FROM by_leaf),
placed AS (SELECT d.*, p.epochs, p.rest, ('0x' || substr(md5(concat_ws('|', '{SEED}', p.epochs, coalesce(d.doc_id::VARCHAR, 'null'))), 1, 15))::BIGINT AS h
  FROM docs d JOIN plan p USING (domain, lang, source)),
run AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM placed),
done AS (SELECT *, greatest(0, least(n_tokens, rest - ahead))::BIGINT AS prefix_tokens FROM run)
SELECT doc_id, domain, lang, source, n_tokens, epochs::BIGINT AS epochs, prefix_tokens, (epochs * n_tokens + prefix_tokens)::BIGINT AS tokens_taken FROM done
"""
