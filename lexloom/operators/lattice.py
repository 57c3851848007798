"""Lattice operators: a lattice is a table of edges (key..., beg, nxt) of one paragraph.

Windows and groups are keyed by paragraph; a paragraph comes from one row of text, so its
edges are bounded by that. The path programs below need order within a paragraph and run
over its sorted edges, streamed.
"""

from __future__ import annotations

from functools import partial
from itertools import compress

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window as W

from lexloom.operators.grouped import Columns, by_key


def kinds_only(edges: DataFrame, kind: str = "kind", pos: str = "pos") -> DataFrame:
    """Interp, Ideogram, Other and Lemma edges, no abbreviations' own."""
    return edges.filter(F.col(kind).isin("Interp", "Ideogram", "Other", "Lemma") & ~((F.col(kind) == "Lemma") & (F.coalesce(pos, F.lit("")) == "brev")))


def without_category(edges: DataFrame, cat: str) -> DataFrame:
    """(G5)"""
    return edges.filter(F.coalesce("cat", F.lit("")) != cat)


def weighted(edges: DataFrame, freqs: DataFrame, flags: dict[str, float] | None = None, keep_quirk: bool = True) -> DataFrame:
    """Weight by flags and lemma frequency (G2). edges: lemma, flags array, weight. freqs: lemma, freq.

    ``keep_quirk``: without a frequency the weight so far counts twice; else it counts once.
    """
    flags = flags or {"TokNotFound": -25.0, "LemmNotVal": -20.0, "NotValProper": -1.0, "LemmLowercase": -0.1}
    own = F.col("weight")
    for name, cost in flags.items():
        own = own + F.when(F.array_contains("flags", name), cost).otherwise(0.0)
    got = edges.join(freqs, "lemma", "left").withColumn("weight", own)
    return got.withColumn("weight", F.col("weight") + F.coalesce("freq", F.col("weight") if keep_quirk else F.lit(0.0))).drop("freq")


def components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Number of the cut-point component of each edge: one starts where no earlier edge reaches over.

    Edges of one start are of one component, so frames go by the value of ``beg``. A component is
    counted at the first edge of its start, so one order of the rows serves all.
    """
    w = W.partitionBy(*keys).orderBy("beg")
    reach = F.max("nxt").over(w.rangeBetween(W.unboundedPreceding, -1))
    starts = ((reach.isNull() | (reach <= F.col("beg"))) & (F.row_number().over(w) == F.rank().over(w))).cast("long")
    return edges.withColumn("component", starts).withColumn("component", F.sum("component").over(w.rangeBetween(W.unboundedPreceding, 0)))


def sentences(edges: DataFrame, keys: list[str], is_stop: Column) -> DataFrame:
    """Sentence number of each edge: a component that is one stop alone closes a sentence.

    A stop that a wider edge spans is no component of its own and closes nothing.
    """
    c = components(edges, keys)
    per = c.groupBy(*keys, "component").agg(F.count("*").alias("__n"), F.bool_or(is_stop).alias("__stop"))
    w = W.partitionBy(*keys).orderBy("component").rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("sentence", F.coalesce(F.sum(F.when((F.col("__n") == 1) & F.col("__stop"), 1).otherwise(0)).over(w), F.lit(0)) + 1)
    return c.join(per.select(*keys, "component", "sentence"), [*keys, "component"])


def sentence_numbers(key: np.ndarray, beg: np.ndarray, nxt: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """``sentences`` over columns of whole keys, numbered upwards, sorted by key and start."""
    if not len(key):
        return key
    far = int(max(nxt.max(), beg.max())) + 1
    reach = np.maximum.accumulate(key * far + nxt)
    place = np.append(True, (np.diff(key) != 0) | (np.diff(beg) != 0))  # the first edge of each start
    at = np.flatnonzero(place)
    opens = np.append(True, reach[at[1:] - 1] <= (key * far + beg)[at[1:]])
    first = at[opens]  # the first edge of each component
    closes = (np.diff(np.append(first, len(key))) == 1) & stop[first]
    before = np.cumsum(closes) - closes
    heads = np.append(True, np.diff(key[first]) != 0)
    number = before - before[np.flatnonzero(heads)][np.cumsum(heads) - 1] + 1
    return np.repeat(number, np.diff(np.append(first, len(key))))


def one_sentence(edges: DataFrame) -> DataFrame:
    """(G13)"""
    return edges.withColumn("sentence", F.lit(1))


def brackets(edges: DataFrame, stops: tuple[str, ...] = (".",), breaks: tuple[str, ...] = (",", ";", "¶")) -> DataFrame:
    """Zero-ish-width bracket edges at stops and breaks, beside the edges themselves."""
    mark = F.when(F.col("orth").isin(*stops), "<sentence>").when(F.col("orth").isin(*breaks), "<clause>")
    extra = edges.withColumn("__m", mark).filter("__m is not null").withColumns({"orth": F.col("__m"), "beg": F.col("beg") + F.col("len") - 1, "len": F.lit(1), "kind": F.lit("Bracket")})
    return edges.withColumn("kind", F.lit("Token")).unionByName(extra.drop("__m").withColumn("nxt", F.col("nxt")))


def renumbered(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Positions as dense nodes from 0 (G15): each edge's places among its key's nodes, by one shuffle and one sort."""
    w = W.partitionBy(*keys)
    whole = edges.filter(" and ".join(f"`{c}` is not null" for c in (*keys, "beg", "nxt")))
    nodes = F.array_sort(F.array_union(F.collect_set("beg").over(w), F.collect_set("nxt").over(w)))
    place = lambda at: (F.array_position("__n", F.col(at)) - 1).cast("int")
    return whole.withColumn("__n", nodes).withColumns({"lnode": place("beg"), "rnode": place("nxt")}).drop("__n")


def slices(pars: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """The text an edge covers, by its position."""
    return edges.join(pars.select(*keys, "paragraph"), keys).withColumn("slice", F.expr("substring(paragraph, cast(beg / 100 as int), cast(len / 100 as int))")).drop("paragraph")


def prefer_mode(rows: DataFrame, keys: list[str], order: list[str], mode: str = "mode") -> DataFrame:
    """Of the alternatives of a key those of the first mode in order that it has."""
    place = F.lit(len(order))
    for i, m in reversed(list(enumerate(order))):
        place = F.when(F.col(mode) == m, i).otherwise(place)
    best = rows.groupBy(*keys).agg(F.min(place).alias("__p"))
    return rows.join(best, keys).filter(place == F.col("__p")).drop("__p")


def merge_interps(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges equal but for their tags as one, the tags' slots factored where only one slot differs (G1).

    ``interp`` is pos:slot:...; values of the last slot are joined by dots, then whole tags by bars.
    """
    head, last = F.regexp_extract("interp", r"^(.*):([^:]*)$", 1), F.regexp_extract("interp", r"([^:]*)$", 1)
    one = edges.groupBy(*keys, head.alias("__h")).agg(F.array_join(F.sort_array(F.collect_set(last)), ".").alias("__l"))
    tag = F.when(F.col("__h") == "", F.col("__l")).otherwise(F.concat_ws(":", "__h", "__l"))
    return one.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set(tag)), "|").alias("interp"))


# --- programs over the edges of one paragraph, in order of (beg, nxt) -------------------

ORDER = ["beg", "nxt"]


def _take(c: Columns, keep: list[bool]) -> Columns:
    return {n: list(compress(v, keep)) for n, v in c.items()}


def _reach(c: Columns, first: str, last: str) -> Columns:
    begin, end = c[first][0], c[last][0]
    forward = {begin}
    for b, n in zip(c["beg"], c["nxt"]):
        if b in forward:
            forward.add(n)
    out = _take(c, [b in forward for b in c["beg"]])
    status = "ok" if end in forward else f"BrokenPaths({begin},{end},{max(forward)})"
    return out | {"status": [status] * len(out["beg"])}


def reachable(edges: DataFrame, keys: list[str], first: str = "first", last: str = "last") -> DataFrame:
    """Edges reachable from ``first``; ``status`` says if ``last`` is, and how far one gets."""
    schema = StructType([*edges.schema.fields, StructField("status", StringType())])
    return by_key(edges, keys, ORDER, partial(_reach, first=first, last=last), schema)


def _shortest(c: Columns, keys: list[str]) -> Columns:
    begin, end = c["first"][0], c["last"][0]
    best: dict[int, tuple] = {begin: (0, 0, ())}
    for b, n, cost, size, orth in zip(c["beg"], c["nxt"], c["unannotated"], c["size"], c["orth"]):
        if b in best:
            j, i, names = best[b]
            new = (j + cost, i + size, (names, orth) if cost else names)
            if n not in best or new[:2] < best[n][:2]:
                best[n] = new
    j, i, names = best.get(end, (None, None, None))
    path = None if j is None else []
    while names:
        names, orth = names
        path.append(orth)
    return {k: [c[k][0]] for k in keys} | {"unannotated": [j], "total": [i], "names": [path and path[::-1]]}


def fewest_unannotated(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Least (unannotated, total) over paths, in that order, and the unannotated orths of the path taken.

    edges: keys, beg, nxt, first, last, unannotated (0 or 1), size, orth. With characters as
    sizes this is G9; with unannotated = 0 everywhere, G7. Null: no path.
    """
    schema = ", ".join(f"`{k}` {t}" for k, t in edges.dtypes if k in keys) + ", unannotated long, total long, names array<string>"
    return by_key(edges, keys, [*ORDER, "orth"], partial(_shortest, keys=keys), schema)


def _best(c: Columns, tolerance: float) -> Columns:
    begin, end = c["first"][0], c["last"][0]
    fore, back = {begin: 0.0}, {end: 0.0}
    rows = list(zip(c["beg"], c["nxt"], c["quality"]))
    for b, n, q in rows:
        if b in fore:
            fore[n] = max(fore.get(n, float("-inf")), fore[b] + q)
    for b, n, q in sorted(rows, key=lambda r: (-r[0], -r[1])):
        if n in back:
            back[b] = max(back.get(b, float("-inf")), back[n] + q)
    top = fore.get(end, float("inf"))
    return _take(c, [b in fore and n in back and fore[b] + q + back[n] >= top - tolerance for b, n, q in rows])


def best_paths(edges: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """All edges on a path of greatest quality from ``first`` to ``last``."""
    return by_key(edges, keys, ORDER, partial(_best, tolerance=tolerance), edges.schema)


def _cover(c: Columns) -> Columns:
    order = sorted(range(len(c["beg"])), key=lambda i: (c["beg"][i], -c["nxt"][i], c["cat"][i] is None, c["cat"][i] or ""))
    taken, at = [], None
    for i in order:
        if at is None or c["beg"][i] >= at:
            taken.append(i)
            at = c["nxt"][i]
    return {n: [v[i] for i in taken] for n, v in c.items()} | {"place": list(range(1, len(taken) + 1))}


def greedy_cover(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Left to right the longest edge at each start, categorised ones first on a tie."""
    return by_key(edges, keys, ORDER, _cover, StructType([*edges.schema.fields, StructField("place", IntegerType())]))


def tagger_path(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The edges a tagger chose, if they make one path from ``first`` to ``last``; else ``status`` says where not.

    edges: keys, beg, nxt, first, last, chosen (boolean).
    """

    def run(c: Columns) -> Columns:
        own = _take(c, c["chosen"])
        at, status = c["first"][0], "ok"
        for b, n in zip(own["beg"], own["nxt"]):
            if b != at:
                status = f"not one edge at {min(b, at)}"
                break
            at = n
        if status == "ok" and at != c["last"][0]:
            status = f"no edge at {at}"
        return own | {"status": [status] * len(own["beg"])}

    return by_key(edges, keys, ORDER, run, StructType([*edges.schema.fields, StructField("status", StringType())]))
