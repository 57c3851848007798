"""Chart parsing with a categorial grammar: a sentence's chart per key.

A category is a string: an atom (``np``, ``np{nom}`` with features), ``X/Y`` (wants a Y to
the right) or ``X\\Y`` (to the left), brackets as needed. Features are sets of values; two
unify if the sets meet, ``*`` meets anything. Items are (from, to, cost, category); items of
one cell and category are merged and keep their derivations as alternatives. The chart of a
sentence is bounded by its length and ``max_cost``; a clock per sentence turns a long one
into the status ParseTimeout instead of a lost task.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass
from functools import lru_cache, partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.grouped import Columns, by_key

TIMEOUT = 30.0
MAX_COST = 2


@dataclass(frozen=True)
class Cat:
    """An atom with features, or a functor: result, slash and argument."""

    atom: str = ""
    features: frozenset = frozenset()
    result: Cat | None = None
    slash: str = ""
    argument: Cat | None = None

    def __hash__(self) -> int:
        """Kept: charts look categories up all the time, and their parts would be hashed anew."""
        found = self.__dict__.get("_hash")
        if found is None:
            found = hash((self.atom, self.features, self.result, self.slash, self.argument))
            object.__setattr__(self, "_hash", found)
        return found

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_hash"}  # strings hash differently in another process

    def __str__(self) -> str:
        if not self.slash:
            return self.atom + ("{" + ".".join(sorted(self.features)) + "}" if self.features else "")
        wrap = lambda c: f"({c})" if c.slash else str(c)
        return f"{wrap(self.result)}{self.slash}{wrap(self.argument)}"


_TOKEN = re.compile(r"[()/\\]|[^()/\\{}]+(?:\{[^}]*\})?")


@lru_cache(maxsize=100_000)
def read(text: str) -> Cat:
    """A category from its string; slashes bind to the left."""
    tokens = _TOKEN.findall(text)
    at = 0

    def primary() -> Cat:
        nonlocal at
        if at == len(tokens):
            raise ValueError(f"a category is missing: {text}")
        token = tokens[at]
        at += 1
        if token == "(":
            inner = whole()
            if at >= len(tokens) or tokens[at] != ")":
                raise ValueError(f"unbalanced: {text}")
            at += 1
            return inner
        if token in ")/\\":
            raise ValueError(f"a category is missing: {text}")
        name, _, features = token.partition("{")
        return Cat(name.strip(), frozenset(filter(None, features.rstrip("}").split("."))))

    def whole() -> Cat:
        nonlocal at
        left = primary()
        while at < len(tokens) and tokens[at] in "/\\":
            slash = tokens[at]
            at += 1
            left = Cat(result=left, slash=slash, argument=primary())
        return left

    if not tokens:
        raise ValueError("an empty category")
    found = whole()
    if at != len(tokens):
        raise ValueError(f"left over in {text}")
    return found


def unify(a: Cat, b: Cat) -> Cat | None:
    """What both can be (C14): features meet, none stands for all."""
    if a.slash != b.slash:
        return None
    if a.slash:
        r, g = unify(a.result, b.result), unify(a.argument, b.argument)
        return Cat(result=r, slash=a.slash, argument=g) if r and g else None
    if a.atom != b.atom and "*" not in (a.atom, b.atom):
        return None
    both = a.features & b.features if a.features and b.features else a.features | b.features
    if a.features and b.features and not both:
        return None
    return Cat(a.atom if b.atom == "*" else b.atom, both)


@lru_cache(maxsize=100_000)
def combine(left: Cat, right: Cat) -> list[tuple[str, int, Cat]]:
    """(rule, cost, category): application both ways (C11), cross composition at cost 1 (C12), coordination."""
    found = []
    if left.slash == "/" and unify(left.argument, right):
        found.append(("fa", 0, left.result))
    if right.slash == "\\" and unify(right.argument, left):
        found.append(("ba", 0, right.result))
    if left.slash == "/" and right.slash == "\\" and unify(left.argument, right.result):
        found.append(("fc", 1, Cat(result=left.result, slash="\\", argument=right.argument)))
    if right.slash == "\\" and left.slash == "/" and unify(right.argument, left.result):
        found.append(("bc", 1, Cat(result=right.result, slash="/", argument=left.argument)))
    if left.atom == "conj" and not right.slash:
        found.append(("cj", 0, Cat(result=right, slash="\\", argument=right)))
    return found


Chart = dict[tuple[int, int, int], dict[Cat, list[tuple]]]


def closure(chart: Chart, n: int, max_cost: int = MAX_COST, pro: dict[str, Cat] | None = None, deadline: float | None = None) -> Chart:
    """All items over spans (C9): by length, start, split and costs, equal categories of a cell merged.

    pro: atoms an implicit argument may stand for, at cost 1 (C10). TimeoutError past the deadline.
    """

    def add(i: int, k: int, cost: int, cat: Cat, how: tuple) -> None:
        if cost > max_cost:
            return
        cell = chart.setdefault((i, k, cost), {})
        known = cat in cell
        if how not in cell.setdefault(cat, []):
            cell[cat].append(how)
        if not known and pro and cat.slash and not cat.argument.slash and cat.argument.atom in pro and unify(cat.argument, pro[cat.argument.atom]):
            add(i, k, cost + 1, cat.result, ("pro", (i, k, cost, cat)))

    for (i, k, cost), cell in list(chart.items()):
        for cat in list(cell):
            how, cell[cat] = cell[cat], []
            del cell[cat]
            for h in how:
                add(i, k, cost, cat, h)
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            k = i + length
            for j in range(i + 1, k):
                if deadline and time.monotonic() > deadline:
                    raise TimeoutError
                for c1 in range(max_cost + 1):
                    for c2 in range(max_cost + 1 - c1):
                        for a in list(chart.get((i, j, c1), ())):
                            for b in list(chart.get((j, k, c2), ())):
                                for rule, extra, cat in combine(a, b):
                                    add(i, k, c1 + c2 + extra, cat, (rule, (i, j, c1, a), (j, k, c2, b)))
    return chart


def count_derivations(chart: Chart, item: tuple, memo: dict) -> int:
    """Number of trees below an item; shared parts are counted once and multiplied (C8, C20 without enumeration)."""
    if item not in memo:
        memo[item] = 0
        i, k, cost, cat = item
        total = 0
        for how in chart[i, k, cost][cat]:
            part = 1
            for below in how[1:]:
                if isinstance(below, tuple):
                    part *= count_derivations(chart, below, memo)
            total += part
        memo[item] = total
    return memo[item]


def tree(chart: Chart, item: tuple) -> str:
    """One derivation in brackets: the first alternative in order of its text (C22 without variants)."""
    i, k, cost, cat = item
    how = min(chart[i, k, cost][cat], key=str)
    if how[0] == "lex":
        return how[1]
    parts = [tree(chart, below) for below in how[1:]]
    return parts[0] if how[0] == "pro" else f"({' '.join(parts)})"


def cover(chart: Chart, n: int) -> list[tuple]:
    """A partial parse (C17, C18): items side by side over [0, n], fewest first, then least cost."""
    best: dict[int, tuple] = {0: (0, 0, ())}
    for i in range(n):
        if i not in best:
            continue
        count, cost, path = best[i]
        options = [(k, c, cat) for (a, k, c), cell in chart.items() if a == i for cat in cell] + [(i + 1, 0, None)]
        for k, c, cat in sorted(options, key=str):
            new = (count + 1 + (cat is None), cost + c, (*path, (i, k, c, cat)))
            if k not in best or new[:2] < best[k][:2]:
                best[k] = new
    return list(best[n][2])


#: Parsed sentences that a task keeps: equal ones have equal charts.
KEPT = 50_000


def _sentence(words: tuple, root: Cat, max_cost: int, timeout: float, pro: tuple) -> dict:
    """What ``parse`` says of one sentence: (lnode, rnode, orth, category) of its rows, in order."""
    n = max(w[1] for w in words)
    chart: Chart = {}
    out = {"n_tokens": n, "status": "", "cost": None, "n_items": 0, "n_trees": None, "tree": None}
    try:
        for i, k, orth, cat in words:
            if cat is not None:
                chart.setdefault((i, k, 0), {}).setdefault(read(cat), []).append(("lex", orth))
        closure(chart, n, max_cost, dict(pro), time.monotonic() + timeout)
        done = [(cost, cat) for cost in range(max_cost + 1) for cat in chart.get((0, n, cost), ()) if unify(cat, root)]
        out["n_items"] = sum(map(len, chart.values()))
        if done:
            cost = done[0][0]
            items = [(0, n, cost, cat) for x, cat in done if x == cost]
            memo: dict = {}
            out |= {"status": "Parsed", "cost": cost, "n_trees": float(sum(count_derivations(chart, i, memo) for i in items)), "tree": min(tree(chart, i) for i in items)}
        else:
            parts = cover(chart, n)
            known = [p for p in parts if p[3] is not None]
            out |= {"status": "PartialParsed" if known else "NotParsed", "cost": sum(p[2] for p in known), "tree": " ".join(tree(chart, p) if p[3] is not None else "?" for p in parts)}
    except TimeoutError:
        out["status"] = "ParseTimeout"
    except (ValueError, RecursionError) as e:
        out["status"] = f"ParseError: {e}"
    return out


def _parse(c: Columns, keys: list[str], kept: dict, **more) -> Columns:
    words = tuple(zip(c["lnode"], c["rnode"], c["orth"], c["category"]))
    out = kept.get(words)
    if out is None:
        out = _sentence(words, **more)
        if out["status"] != "ParseTimeout":  # the clock's answer, not the sentence's
            if len(kept) >= KEPT:
                kept.clear()
            kept[words] = out
    return {k: [c[k][0]] for k in keys} | {k: [v] for k, v in out.items()}


def parse(tokens: DataFrame, keys: list[str], root: str = "s", max_cost: int = MAX_COST, timeout: float = TIMEOUT, pro: dict[str, str] | None = None) -> DataFrame:
    """One row per sentence: status, least cost, trees and one of them.

    tokens: keys, lnode, rnode (0-based, dense), orth, category (null: no entry); parallel rows are ambiguity.
    Sentences of equal rows have equal parses, so a task keeps those that it has met.
    """
    schema = ", ".join(f"`{k}` {t}" for k, t in tokens.dtypes if k in keys) + ", n_tokens int, status string, cost int, n_items long, n_trees double, tree string"
    program = partial(_parse, keys=keys, kept={}, root=read(root), max_cost=max_cost, timeout=timeout, pro=tuple((k, read(v)) for k, v in (pro or {}).items()))
    return by_key(tokens, keys, ["lnode", "rnode", "category", "orth"], program, schema)


def lexical_entries(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Categories by (lemma, pos), and those of the pos alone (C3, C4): two left joins, the tokens read once.

    lexicon: lemma (null: any), pos, category. A token without any has one row without category.
    """
    own = lexicon.filter("lemma is not null").groupBy("lemma", "pos").agg(F.collect_list("category").alias("__own"))
    any_ = lexicon.filter("lemma is null").groupBy("pos").agg(F.collect_list("category").alias("__any"))
    none = F.array().cast("array<string>")
    known = F.concat(F.coalesce("__own", none), F.coalesce("__any", none))
    found = tokens.join(own, ["lemma", "pos"], "left").join(any_, "pos", "left")
    return found.select(*tokens.columns, F.explode_outer(known).alias("category"))


def maximal(items: DataFrame, keys: list[str]) -> DataFrame:
    """Longest item at each start that no earlier one covers (C19). items: keys, i, j and more."""
    from pyspark.sql.window import Window as W

    longest = items.groupBy(*keys, "i").agg(F.max("j").alias("j"))
    w = W.partitionBy(*keys).orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    top = longest.withColumn("__r", F.max("j").over(w)).filter("__r is null or j > __r").drop("__r")
    return items.join(top, [*keys, "i", "j"], "left_semi")
