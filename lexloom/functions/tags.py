"""Positional tags: parse, render, expand, select, match, coarsen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slots and all values of each part of speech; ``_`` in a tag stands for all values of its slot.
TAGSET: dict[str, tuple[tuple[str, ...], ...]] = {
    "subst": (("sg", "pl"), ("nom", "gen", "dat", "acc", "inst", "loc", "voc"), ("m1", "m2", "m3", "n", "f")),
    "adj": (("sg", "pl"), ("nom", "gen", "dat", "acc", "inst", "loc", "voc"), ("m1", "m2", "m3", "n", "f"), ("pos", "com", "sup")),
    "fin": (("sg", "pl"), ("pri", "sec", "ter"), ("imperf", "perf")),
    "adv": (("pos", "com", "sup"),),
    "prep": (("nom", "gen", "dat", "acc", "inst", "loc"),),
}
COARSE = {"subst": "noun", "depr": "noun", "adj": "adj", "adja": "adj", "fin": "verb", "inf": "verb", "praet": "verb", "adv": "adv", "prep": "prep"}


def parse(tag: Column) -> Column:
    """``pos:a.b:c|pos:d:e`` as alternatives x slots x values, the pos as first slot."""
    return F.transform(F.split(tag, "[|]"), lambda alt: F.transform(F.split(alt, ":"), lambda slot: F.split(slot, "[.]")))


def render(alts: Column) -> Column:
    return F.array_join(F.transform(alts, lambda alt: F.array_join(F.transform(alt, lambda slot: F.array_join(slot, ".")), ":")), "|")


def _slots() -> Column:
    entries = []
    for pos, slots in TAGSET.items():
        entries += [F.lit(pos), F.array(F.array(F.lit(pos)), *[F.array(*map(F.lit, s)) for s in slots])]
    return F.create_map(*entries)


def expand(alts: Column) -> Column:
    """``_`` becomes all values of its slot; an unknown pos or slot count makes the result null."""
    full = lambda alt: F.element_at(_slots(), alt[0][0])
    one = lambda alt: F.when(F.size(full(alt)) == F.size(alt), F.zip_with(alt, full(alt), lambda v, every: F.when(v == F.array(F.lit("_")), every).otherwise(v)))
    out = F.transform(alts, one)
    return F.when(~F.exists(out, lambda a: a.isNull()), out)


def valid(alts: Column) -> Column:
    """Every value is one of its slot's."""
    full = lambda alt: F.element_at(_slots(), alt[0][0])
    ok = lambda alt: F.coalesce(
        (F.size(full(alt)) == F.size(alt)) & F.forall(F.zip_with(alt, full(alt), lambda v, every: (v == F.array(F.lit("_"))) | (F.size(F.array_except(v, every)) == 0)), lambda x: x), F.lit(False)
    )
    return F.forall(alts, ok)


def matches(pattern: Column, tag: Column) -> Column:
    """One alternative of each overlaps in every slot, ``_`` with anything."""
    any_ = F.array(F.lit("_"))
    slot = lambda p, t: (p == any_) | (t == any_) | F.arrays_overlap(p, t)
    alt = lambda p, t: (F.size(p) == F.size(t)) & F.forall(F.zip_with(p, t, lambda a, b: F.coalesce(slot(a, b), F.lit(False))), lambda x: x)
    return F.exists(pattern, lambda p: F.exists(tag, lambda t: alt(p, t)))


def select(alts: Column, slot: int, value: Column) -> Column:
    """Alternatives whose slot holds the value, restricted to it; n covers n:col and n:ncol."""
    wider = F.when(value == "n", F.array(F.lit("n"), F.lit("ncol"), F.lit("col"))).otherwise(F.array(value))
    cut = F.transform(alts, lambda alt: F.transform(alt, lambda v, i: F.when(i == slot, F.array_intersect(v, wider)).otherwise(v)))
    return F.filter(cut, lambda alt: F.size(F.get(alt, F.lit(slot))) > 0)


def coarse(pos: Column) -> Column:
    """Coarse class of a part of speech, itself if it has none."""
    table = F.create_map(*[F.lit(x) for kv in COARSE.items() for x in kv])
    return F.coalesce(F.element_at(table, pos), pos)


def apply_selector(values: Column, relation: str, wanted: Column) -> Column:
    """Value set after ``=`` or ``<>`` (C2): unset is assigned by ``=`` and fails under ``<>``; null means failure."""
    unset = F.size(values) == 0
    if relation == "=":
        cut = F.array_intersect(values, wanted)
        return F.when(unset, wanted).when(F.size(cut) > 0, cut)
    cut = F.array_except(values, wanted)
    return F.when(~unset & (F.size(cut) > 0), cut)
