"""Multi-word patterns over lattice edges.

A rule is rows (rule_id, slot, op, arg); ``op`` is ``orth`` or ``cat``. A match is a chain of
edges, the next beginning where the last ends. Only edges that some slot can match take
part in matching: the filter is the vocabulary of the rules, broadcast while it is small.
They are dealt by paragraph once, and a paragraph's chains and rounds are followed there.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexloom.operators.grouped import by_key
from lexloom.sources.scratch import written

KEYS = ["doc_id", "par_id"]
EDGE = ["beg", "len", "nxt", "orth", "cat", "low"]
#: A rule table up to so many rows is broadcast.
BROADCAST_RULES = 100_000


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_RULES else df


def vocabulary(edges: DataFrame) -> DataFrame:
    """What occurs, as (op, arg) (M1): distinct words and categories first, then their pairs."""
    words = edges.select(F.lower("orth").alias("orth"), "cat").distinct()
    both = F.explode(F.array(F.struct(F.lit("orth").alias("op"), F.col("orth").alias("arg")), F.struct(F.lit("cat").alias("op"), F.col("cat").alias("arg"))))
    return words.select(both.alias("v")).select("v.*").filter("arg is not null").distinct()


def selected_rules(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules all of whose slots occur (M2)."""
    n = rules.groupBy("rule_id").agg(F.count("*").alias("n"))
    hit = rules.join(vocabulary(edges), ["op", "arg"], "left_semi").groupBy("rule_id").agg(F.count("*").alias("hits"))
    live = hit.join(n, "rule_id").filter("hits = n").select("rule_id")
    return rules.join(live, "rule_id", "left_semi")


Rules = tuple[dict, dict, dict]


def _held(rules: DataFrame) -> Rules | None:
    """A rule table as dictionaries: (op, arg) to the first slots it fills, (rule, slot) to all it may hold, rule to its slots; None beyond BROADCAST_RULES."""
    rows = rules.select("rule_id", "slot", "op", "arg").take(BROADCAST_RULES + 1)
    if len(rows) > BROADCAST_RULES:
        return None
    heads, slots, last = defaultdict(set), defaultdict(set), defaultdict(int)
    for rule, slot, op, arg in rows:
        slots[rule, slot].add((op, arg))
        last[rule] = max(last[rule], slot)
        if slot == 1:
            heads[op, arg].add(rule)
    return dict(heads), dict(slots), dict(last)


def _chains(own: list[tuple], rules: Rules) -> list[tuple]:
    """Matches among a paragraph's edges (beg, len, nxt, orth, cat, low): (rule, beg, end, nxt, orth, low, n_parts)."""
    heads, slots, last = rules
    at = defaultdict(list)
    for e in own:
        at[e[0]].append((e, {("orth", e[5]), ("cat", e[4])}))
    found = []
    for here in list(at.values()):
        for (beg, length, nxt, orth, _, low), is_ in here:
            for rule in set().union(*(heads.get(x, ()) for x in is_)):
                open_ = [(beg + length, nxt, orth, low)]
                for k in range(2, last[rule] + 1):
                    want = slots.get((rule, k), ())
                    grown = []
                    for end, to, text, small in open_:
                        gap = " " if end < to else ""
                        grown += [(b + n, x, text + gap + o, small + gap + l) for (b, n, x, o, _, l), has in at.get(to, ()) if not has.isdisjoint(want)]
                    open_ = grown
                found += [(rule, beg, *chain, last[rule]) for chain in open_]
    return found


def _live(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges that some slot can match, with their small letters; a chain needs keys to join by."""
    wanted = rules.select("op", "arg").distinct()
    n = wanted.count()
    probe = edges.select(*KEYS, "beg", "len", "nxt", "orth", "cat", F.lower("orth").alias("low"))
    words = _small(wanted.filter("op = 'orth'").select(F.col("arg").alias("low"), F.lit(True).alias("__w")).distinct(), n)
    cats = _small(wanted.filter("op = 'cat'").select(F.col("arg").alias("cat"), F.lit(True).alias("__c")).distinct(), n)
    probe = probe.filter(" and ".join(f"{k} is not null" for k in KEYS))  # nulls join with nothing
    return probe.join(words, "low", "left").join(cats, "cat", "left").filter("__w or __c").select(probe.columns)


def matches(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(KEYS, rule_id, beg, end_, nxt, orth, n_parts): chains of edges that match a rule (M3).

    The edges are read once: those that a slot can match are dealt by paragraph, whose chains are
    followed in memory. Equal edges and alternatives make equal matches.
    """
    held = _held(rules)
    if held is None:
        return _joined(edges, rules)
    names = ["rule_id", "beg", "end_", "nxt", "orth", "n_parts"]

    def run(c):
        found = _chains(list(zip(*(c[n] for n in EDGE))), held)
        columns = list(zip(*((r, b, e, n, o, p) for r, b, e, n, o, _, p in found))) or [()] * len(names)
        return {k: [c[k][0]] * len(found) for k in KEYS} | dict(zip(names, map(list, columns)))

    live = _live(edges, rules)
    kind = dict(live.dtypes)
    schema = ", ".join(f"{k} {kind[k]}" for k in KEYS) + f", rule_id {dict(rules.dtypes)['rule_id']}, beg {kind['beg']}, end_ {kind['beg']}, nxt {kind['nxt']}, orth string, n_parts int"
    return by_key(live, KEYS, ["beg", "nxt"], run, schema)


def _joined(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """``matches`` by a join for each slot, for rule tables that no task should hold."""
    shape = rules.groupBy("rule_id").agg(F.max("slot").alias("slots"))
    longest, n = shape.agg(F.max("slots"), F.count("*")).first()
    if not longest:
        longest, n = 0, 0
    slots = rules.join(shape, "rule_id")
    arg = F.explode(F.filter(F.array(F.struct(F.lit("orth").alias("op"), F.lower("orth").alias("arg")), F.struct(F.lit("cat").alias("op"), F.col("cat").alias("arg"))), lambda x: x["arg"].isNotNull()))
    fits = edges.select(*KEYS, "beg", "len", "nxt", "orth", arg.alias("v")).select(*KEYS, "beg", "len", "nxt", "orth", "v.*").join(_small(slots, n), ["op", "arg"])
    fits = fits.select(*KEYS, "rule_id", "slot", "slots", "beg", (F.col("beg") + F.col("len")).alias("end_"), "nxt", "orth")
    open_ = fits.filter("slot = 1").drop("slot").withColumn("n_parts", F.lit(1))
    done = [open_.filter("slots = 1")]
    for k in range(2, longest + 1):
        step = fits.filter(f"slot = {k}").select(*KEYS, "rule_id", F.col("beg").alias("nxt"), F.col("end_").alias("e2"), F.col("nxt").alias("n2"), F.col("orth").alias("o2"))
        open_ = open_.filter(f"slots >= {k}").join(step, [*KEYS, "rule_id", "nxt"])
        spaced = F.when(F.col("end_") < F.col("nxt"), F.concat_ws(" ", "orth", "o2")).otherwise(F.concat("orth", "o2"))
        open_ = open_.select(*KEYS, "rule_id", "slots", "beg", F.col("e2").alias("end_"), F.col("n2").alias("nxt"), spaced.alias("orth"), F.lit(k).alias("n_parts"))
        done.append(open_.filter(f"slots = {k}"))
    return reduce(lambda a, b: a.unionByName(b), done).drop("slots") if done else open_


def produce(found: DataFrame, productions: DataFrame) -> DataFrame:
    """New edges of matches (M4). productions: rule_id, cat."""
    made = found.join(productions, "rule_id")  # a rule table; the engine broadcasts it while its size allows
    return made.select(*KEYS, "beg", (F.col("end_") - F.col("beg")).alias("len"), "nxt", "orth", "cat").distinct()


def grown(edges: DataFrame, rules: DataFrame, productions: DataFrame, rounds: int = 5) -> DataFrame:
    """What ``fixpoint`` adds to the edges that a slot can match (M5, M7): all rounds of a paragraph in one place.

    Each new edge comes once; no round is written or shuffled.
    """
    held = _held(rules)
    if held is None:
        return _grown_joined(edges, rules, productions, rounds)
    cats = defaultdict(set)
    for rule, cat in productions.select("rule_id", "cat").collect():
        cats[rule].add(cat)

    def run(c):
        own = dict.fromkeys(zip(*(c[n] for n in EDGE)))
        first, before = len(own), 0
        for _ in range(rounds):
            if len(own) == before:
                break
            before = len(own)
            own |= dict.fromkeys((b, e - b, n, o, cat, low) for r, b, e, n, o, low, _ in _chains(list(own), held) for cat in cats.get(r, ()))
        new = list(own)[first:]
        return {k: [c[k][0]] * len(new) for k in KEYS} | {n: [e[i] for e in new] for i, n in enumerate(EDGE[:-1])}

    live = _live(edges, rules)
    return by_key(live, KEYS, ["beg", "nxt"], run, live.drop("low").schema)


def _grown_joined(edges: DataFrame, rules: DataFrame, productions: DataFrame, rounds: int) -> DataFrame:
    """``grown`` by joins, each round a table of the shared folder, for rule tables that no task should hold."""
    first = written(_live(edges, rules).drop("low").distinct(), "mwe")
    live, size = first, first.count()
    for _ in range(rounds):
        live = written(live.unionByName(produce(_joined(live, rules), productions)).distinct(), "mwe")
        now = live.count()
        if now == size:
            break
        size = now
    return live.subtract(first)


def fixpoint(edges: DataFrame, rules: DataFrame, productions: DataFrame, rounds: int = 5) -> DataFrame:
    """Edges with all that the rules make of them in up to ``rounds`` rounds, as a set (M5, M7)."""
    edges = edges.select(*KEYS, "beg", "len", "nxt", "orth", "cat")
    return edges.unionByName(grown(edges, rules, productions, rounds)).distinct()


def contained(spans: DataFrame, keys: list[str], same: list[str]) -> DataFrame:
    """Spans that lie properly within another of the same key and label (M8).

    A running pass instead of an interval join: in the order of start (longest first), a
    span is contained if an earlier-placed one reaches at least as far.
    """
    w = W.partitionBy(*keys, *same).orderBy("beg", F.desc("end_"))
    distinct = spans.select(*keys, *same, "beg", "end_").distinct()
    reach = F.max("end_").over(w.rowsBetween(W.unboundedPreceding, -1))
    return distinct.withColumn("__r", reach).filter(F.col("__r") >= F.col("end_")).drop("__r")


def without_contained(spans: DataFrame, keys: list[str], same: list[str]) -> DataFrame:
    return spans.join(contained(spans, keys, same), [*keys, *same, "beg", "end_"], "left_anti")


def segments(rows: DataFrame, keys: list[str], order: str, anchor) -> DataFrame:
    """Segment number: each anchor opens one; rows before the first are in none."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("segment", F.sum(F.when(anchor, 1).otherwise(0)).over(w)).filter("segment > 0")


def insert_markers(edges: DataFrame, markers: DataFrame) -> DataFrame:
    """Marker edges of 10 units beside marked ones, which shrink by as much (M10). markers: KEYS, beg, nxt, side, mark."""
    got = edges.join(markers, [*KEYS, "beg", "nxt"], "left")
    left = F.when(F.col("side") == "left", F.array(F.struct(F.col("mark").alias("orth"), F.col("beg").alias("b"), F.lit(10).alias("l"), (F.col("beg") + 10).alias("n"))))
    body = F.struct(
        "orth", F.when(F.col("side") == "left", F.col("beg") + 10).otherwise(F.col("beg")).alias("b"), F.when(F.col("side").isNotNull(), F.col("len") - 10).otherwise(F.col("len")).alias("l"),
        F.when(F.col("side") == "right", F.col("beg") + F.col("len") - 10).otherwise(F.col("nxt")).alias("n"),
    )
    right = F.when(F.col("side") == "right", F.array(F.struct(F.col("mark").alias("orth"), (F.col("beg") + F.col("len") - 10).alias("b"), F.lit(10).alias("l"), F.col("nxt").alias("n"))))
    none = F.array().cast("array<struct<orth:string,b:int,l:int,n:int>>")
    rows = F.concat(F.coalesce(left, none), F.array(body), F.coalesce(right, none))
    return got.select(*KEYS, F.inline(rows)).toDF(*KEYS, "orth", "beg", "len", "nxt")


def assemble(edges: DataFrame, groups: int = 10) -> DataFrame:
    """Per segment at most one edge of each attribute group, without overlap, covering most.

    edges: doc_id, par_id, segment, edge_id, beg, nxt, grp (0-based). A program over bit masks
    of groups, per segment.
    """

    def run(c):
        states: dict[tuple[int, int], tuple[int, tuple]] = {(0, 0): (0, ())}  # (end, mask): covered, edges
        for e, b, n, g in zip(c["edge_id"], c["beg"], c["nxt"], c["grp"]):
            bit = 1 << g
            for (end, mask), (covered, chosen) in list(states.items()):
                if end <= b and not mask & bit:
                    key, value = (n, mask | bit), (covered + n - b, (*chosen, e))
                    if key not in states or (-value[0], value[1]) < (-states[key][0], states[key][1]):
                        states[key] = value
        _, chosen = min(states.values(), key=lambda s: (-s[0], s[1]))
        keep = [e in chosen for e in c["edge_id"]]
        return {name: [v for v, k in zip(values, keep) if k] for name, values in c.items()}

    return by_key(edges, [*KEYS, "segment"], ["nxt", "beg", "edge_id"], run, edges.schema)


def token_trie(pars_tokens: DataFrame, phrases: DataFrame, ignore_case: bool = True) -> DataFrame:
    """Places where a phrase's tokens stand in a row (T14, T18): first-token equi-join, then the rest is compared.

    pars_tokens: KEYS, toks (array). phrases: phrase_id, words (array). Each place goes into the join
    with as many tokens as the longest phrase has, not with its whole row of tokens.
    """
    low = (lambda c: F.transform(c, lambda x: F.lower(x))) if ignore_case else (lambda c: c)
    want = phrases.select("phrase_id", low("words").alias("words")).withColumn("first", F.get("words", F.lit(0)))
    longest, n = want.agg(F.max(F.size("words")), F.count("*")).first()
    toks = pars_tokens.select(*KEYS, low("toks").alias("toks")).select(*KEYS, "toks", F.posexplode("toks").alias("at", "first"))
    toks = toks.select(*KEYS, "at", "first", F.slice("toks", F.col("at") + 1, max(longest or 1, 1)).alias("part"))
    hit = toks.join(_small(want, n), "first").filter("slice(part, 1, size(words)) = words")
    return hit.select(*KEYS, "phrase_id", (F.col("at") + 1).alias("at"))
