"""Whole steps put together from parts."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from lexloom.functions import tags, tokens
from lexloom.operators import lattice as G
from lexloom.operators.chart import combine, read
from lexloom.operators.grouped import Columns, by_key


# --- tokens and lattices -----------------------------------------------------------------


def case_variants(orth: Column) -> Column:
    """A form as it stands, in small letters, with a first capital, in capitals; each once."""
    low, up = tokens.lower, tokens.upper
    return F.array_distinct(F.array(orth, low(orth), F.concat(up(F.substring(orth, 1, 1)), low(F.substring(orth, 2, 1_000_000))), up(orth)))


def lemmatised(parts: DataFrame, lexicon: DataFrame, keys: list[str]) -> DataFrame:
    """Readings of tokens by a lexicon, in every case variant, of the best priority group.

    parts: keys, alt, part, orth: a token's alternatives, each a sequence of parts. lexicon: orth,
    lemma, interp, priority (1 is best). A part has its best readings, an alternative the worst
    of its parts' priorities, a token the alternatives of the least; a part outside the lexicon
    is its own lemma, at priority 5. Flags: TokNotFound, LemmNotVal beyond priority 2.
    """
    forms = parts.select("orth").distinct().select("orth", F.explode(case_variants(F.col("orth"))).alias("form"))
    found = forms.join(lexicon.withColumnRenamed("orth", "form"), "form").select("orth", "lemma", "interp", "priority")
    least = found.groupBy("orth").agg(F.min("priority").alias("priority"))
    best = found.join(least, ["orth", "priority"]).distinct()
    read_ = parts.join(best, "orth", "left").withColumns({"lemma": F.coalesce("lemma", "orth"), "interp": F.coalesce("interp", F.lit("unk")), "priority": F.coalesce("priority", F.lit(5))})
    of_alt = read_.groupBy(*keys, "alt").agg(F.max("priority").alias("worst"))
    of_token = of_alt.groupBy(*keys).agg(F.min("worst").alias("token_priority"))
    kept = of_alt.join(of_token, keys).filter("worst = token_priority").select(*keys, "alt", "token_priority")
    flag = F.when(F.col("priority") == 5, "TokNotFound").when(F.col("priority") > 2, "LemmNotVal").otherwise("ok")
    return read_.join(kept, [*keys, "alt"]).withColumn("flag", flag)


def _prepare(c: Columns) -> Columns:
    out = G._reach(c, "first", "last")
    node = {at: i for i, at in enumerate(sorted({*out["beg"], *out["nxt"]}))}
    n = len(out["beg"])
    status = ["ok" if s == "ok" else "not lemmatized" for s in out["status"]]
    return out | {"status": status, "lnode": [node[b] for b in out["beg"]], "rnode": [node[x] for x in out["nxt"]], "n_edges": [n] * n}


def prepared(edges: DataFrame, keys: list[str], cats: tuple[str, ...] = ("X", "MWEcomponent")) -> DataFrame:
    """Sentences ready to parse (G17): edges outside ``cats`` on the way from ``first``, their nodes counted from 0.

    Adds status, ``ok`` or ``not lemmatized`` where no path reaches ``last``, lnode, rnode and n_edges: one pass over a key.
    """
    kept = edges
    for cat in cats:
        kept = G.without_category(kept, cat)
    more = [StructField("status", StringType()), StructField("lnode", IntegerType()), StructField("rnode", IntegerType()), StructField("n_edges", LongType())]
    return by_key(kept, keys, G.ORDER, _prepare, StructType([*kept.schema.fields, *more]))


def with_components(lexicon: DataFrame, rules: DataFrame) -> DataFrame:
    """The lexicon with every literal of the rules it lacks, as category MWEcomponent (M6). rules: op, arg. lexicon: orth, cat."""
    literals = rules.filter("op = 'orth'").select(F.col("arg").alias("orth")).distinct()
    return lexicon.select("orth", "cat").unionByName(literals.join(lexicon.select("orth").distinct(), "orth", "left_anti").withColumn("cat", F.lit("MWEcomponent")))


def done(edges: DataFrame, keys: list[str], mark: Column) -> DataFrame:
    """Whether a paragraph holds a marked edge."""
    return edges.groupBy(*keys).agg(F.bool_or(F.coalesce(mark, F.lit(False))).alias("done"))


# --- rules and lexicons ------------------------------------------------------------------


def disjoint_rules(rules: DataFrame, longest: int) -> DataFrame:
    """Each suffix with the rules of all suffixes of it (L20): a word needs its longest suffix only. rules: rule_id, find."""
    from lexloom.operators.morphology import suffixes

    finds = rules.select("find").distinct().select("find", F.explode(suffixes(F.col("find"), longest)).alias("super"))
    return finds.join(rules.select("rule_id", F.col("find").alias("super")), "super").select("find", "rule_id").distinct()


def alternation_maps(pairs: DataFrame) -> DataFrame:
    """Alternations by either side (L21): direction, key, values. pairs: stem, surface."""
    one = lambda d, a, b: pairs.groupBy(F.col(a).alias("key")).agg(F.array_join(F.sort_array(F.collect_set(b)), ",").alias("values")).select(F.lit(d).alias("direction"), "key", "values")
    return one("forward", "stem", "surface").unionByName(one("reverse", "surface", "stem"))


def entry_index(entries: DataFrame) -> DataFrame:
    """Part of speech to lemma to its sorted entries (V7), as (pos, lemma, entries): one shuffle by both. entries: pos, lemma, entry."""
    return entries.groupBy("pos", "lemma").agg(F.sort_array(F.collect_set("entry")).alias("entries"))


def _slots(pos: Column, a: Column, proper: Column) -> dict[str, Column]:
    """Values of the record's columns that an alternative ``a`` (slots x values, the pos first) allows."""
    slot = lambda i: F.array_distinct(F.get(a, F.lit(i)))
    none = F.array(F.lit(None).cast("string"))
    nominal, verbal = pos.isin("subst", "adj"), pos == "fin"
    return {
        "number": F.when(nominal | verbal, slot(1)).otherwise(none),
        "case": F.when(nominal, slot(2)).when(pos == "prep", slot(1)).otherwise(none),
        "gender": F.when(nominal, slot(3)).otherwise(none),
        "subtype": F.when(pos == "subst", F.array(proper)).when(pos == "adj", slot(4)).when(verbal, slot(2)).when(pos == "adv", slot(1)).otherwise(none),
    }


def clarified(rows: DataFrame, tag: str, lemma: str) -> DataFrame:
    """Category records of tagged lemmata (C1): a row for each number, case and gender an alternative allows.

    ``pos2`` is the coarse class, ``subtype`` proper or common for nouns, grade for adjectives and
    adverbs, person for verbs. Slots that a class lacks are null; ``_`` stands for all values;
    alternatives of an unknown part of speech have no record. A row's records are distinct: one that
    an earlier alternative of the row has is left out there, so no records are gathered.
    """
    proper = F.when(F.col(lemma).rlike("^[A-Z]"), "proper").otherwise("common")
    alts = rows.withColumn("__alts", tags.expand(tags.parse(F.col(tag)))).filter("__alts is not null").withColumn("__proper", proper)
    alt = alts.select("*", F.posexplode("__alts").alias("__k", "__a")).withColumn("pos", F.expr("__a[0][0]"))
    out = alt.withColumn("pos2", tags.coarse(F.col("pos")))
    own = _slots(F.col("pos"), F.col("__a"), F.col("__proper"))
    for name, values in own.items():
        out = out.withColumn(name, F.explode(values))

    def has(b: Column) -> Column:
        same = b[0][0] == F.col("pos")
        for name, values in _slots(F.col("pos"), b, F.col("__proper")).items():
            same = same & (F.col(name).isNull() | F.coalesce(F.array_contains(values, F.col(name)), F.lit(False)))
        return same

    first = F.when(F.col("__k") == 0, True).otherwise(~F.exists(F.slice("__alts", 1, F.col("__k")), has))
    return out.filter(first).drop("__alts", "__a", "__k", "__proper")


# --- trees and graphs --------------------------------------------------------------------


def _tree(c: Columns, keys: list[str]) -> Columns:
    label, below = dict(zip(c["node"], c["label"])), {}
    for node, parent in zip(c["node"], c["parent"]):
        below.setdefault(parent, []).append(node)
    roots = [n for n, p in zip(c["node"], c["parent"]) if p is None or p not in label]
    # Children are dereferenced after their parents, so a walk backwards has them first.
    order, stack = [], sorted(roots, reverse=True)
    while stack:
        node = stack.pop()
        order.append(node)
        stack += sorted(below.get(node, []), reverse=True)
    text: dict = {}
    for node in reversed(order):
        own = sorted(text[b] for b in below.get(node, []))
        text[node] = label[node] + (f"({','.join(own)})" if own else "")
    status = "ok" if len(order) == len(label) else f"cycle: {len(label) - len(order)} nodes"
    return {k: [c[k][0]] for k in keys} | {"tree": ["|".join(text[r] for r in sorted(roots))], "n_nodes": [len(order)], "status": [status]}


def assembled(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """References followed into trees, as canonical text (Q7, Q25): ``label(child,child)``, children in order of their text.

    nodes: keys, node, parent, label. Nodes that no root reaches are counted in ``status`` (Q9).
    """
    schema = ", ".join(f"`{k}` {t}" for k, t in nodes.dtypes if k in keys) + ", tree string, n_nodes int, status string"
    return by_key(nodes, keys, ["node"], partial(_tree, keys=keys), schema)


def residual(terms: DataFrame, term: str, operators: tuple[str, ...]) -> DataFrame:
    """Terms that still hold an operator that reduction should have removed, with those found (Q9)."""
    found = F.filter(F.array(*[F.when(F.contains(F.col(term), F.lit(f'"{o}"')), o) for o in operators]), lambda x: x.isNotNull())
    return terms.withColumn("residual", F.array_join(found, ",")).filter("residual <> ''")


def text_graphs(sentences: DataFrame, keys: list[str], order: str, graph: str, status: str) -> DataFrame:
    """A text's sentence graphs as one (Q13), in order; a text with a part that has none stays without."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(graph).alias("g"))))
    per = sentences.groupBy(*keys).agg(F.bool_and((F.col(status) == "ok") & F.col(graph).isNotNull()).alias("whole"), parts.alias("p"))
    joined = F.array_join(F.transform("p", lambda x: x["g"]), ",")
    return per.select(*keys, F.when(F.col("whole"), F.concat(F.lit("Text("), joined, F.lit(")"))).alias("graph"))


def _depend(c: Columns, keys: list[str], root: str) -> Columns:
    cats = {n: read(t) for n, t in zip(c["node"], c["category"])}
    below: dict = {}
    for node, head in zip(c["node"], c["head"]):
        below.setdefault(head, []).append(node)
    done_, order, stack = {}, [], list(below.get(0, []))
    while stack:
        node = stack.pop()
        order.append(node)
        stack += below.get(node, [])
    for node in reversed(order):
        # On each side the nearest first, the sides in any order: what i from the left and j from the right give.
        left, right = (sorted((d for d in below.get(node, []) if (d < node) is side), key=lambda d: abs(d - node)) for side in (True, False))
        take = lambda pairs: {cat for x, y in pairs for _, cost, cat in combine(x, y) if cost == 0}
        cell = {(0, 0): {cats[node]}}
        for i in range(len(left) + 1):
            for j in range(len(right) + 1):
                if i or j:
                    cell[i, j] = (take((y, x) for x in cell[i - 1, j] for y in done_[left[i - 1]]) if i else set()) | (take((x, y) for x in cell[i, j - 1] for y in done_[right[j - 1]]) if j else set())
        found = cell[len(left), len(right)]
        done_[node] = found
    tops = below.get(0, [])
    ok = len(tops) == 1 and len(order) == len(cats) and read(root) in done_[tops[0]]
    failed = [n for n in reversed(order) if not done_[n]]
    return {k: [c[k][0]] for k in keys} | {"status": ["Parsed" if ok else "NotDepParsed"], "failed_at": [failed[0] if failed else None]}


def dependency_parsed(tokens: DataFrame, keys: list[str], root: str = "s") -> DataFrame:
    """Whether categories combine along a given dependency tree, bottom-up.

    tokens: keys, node (from 1), head (0: the root), category. ``failed_at``: the first node, from
    below, whose dependents don't combine with it; null where the tree is no tree or ends in another category.
    """
    schema = ", ".join(f"`{k}` {t}" for k, t in tokens.dtypes if k in keys) + ", status string, failed_at int"
    return by_key(tokens, keys, ["node"], partial(_depend, keys=keys, root=root), schema)
