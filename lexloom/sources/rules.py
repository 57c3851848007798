"""Rule and lexicon languages as tables.

Files of rules are parsed line by line on the driver: they are program input of the size of
a dictionary source, not data. Errors are collected with their line and raised together.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


class RuleError(ValueError):
    """All bad lines of a rule file: (line number, what is wrong)."""

    def __init__(self, found: list[tuple[int, str]]):
        self.found = found
        super().__init__("; ".join(f"line {n}: {what}" for n, what in found))


def _lines(text: str) -> list[tuple[int, str]]:
    """Numbered lines without comments and blanks."""
    cut = ((n, line.split("#", 1)[0].rstrip()) for n, line in enumerate(text.split("\n"), 1))
    return [(n, line) for n, line in cut if line.strip()]


def _all(text: str, one) -> list:
    out, bad = [], []
    for n, line in _lines(text):
        try:
            out.append(one(n, line))
        except (ValueError, IndexError) as e:
            bad.append((n, str(e)))
    if bad:
        raise RuleError(bad)
    return [x for x in out if x is not None]


def phrases(spark: SparkSession, text: str) -> DataFrame:
    """``orths TAB lemma TAB interp [TAB exact]``: (rule_id, words, lemma, interp, exact_case)."""

    def one(n, line):
        parts = line.split("\t")
        if len(parts) not in (3, 4):
            raise ValueError(f"{len(parts)} fields instead of 3 or 4")
        if len(parts) == 4 and parts[3] not in ("exact-case", "any-case"):
            raise ValueError(f"unknown case mark {parts[3]}")
        return n, parts[0].split(), parts[1], parts[2], len(parts) == 4 and parts[3] == "exact-case"

    return spark.createDataFrame(_all(text, one), "rule_id int, words array<string>, lemma string, interp string, exact_case boolean")


_SLOT = re.compile(r"%(sp|nsp)|%([a-z0-9-]+)|\^([A-Za-z]+)|\{([^}:]+)(?::([^}]*))?\}|(\*)|(\S+)")
_PRODUCTION = re.compile(r"^(?:%([a-z-]+)\()?([^\[\]()]*)\)?(?:\[([0-9;]*)\])?$")


def patterns(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """Slots and productions of ``pattern TAB production`` lines.

    Slots: ``%mode`` (ideogram), ``^cat`` (category), ``{lemma:interp}``, ``*`` (anything),
    ``%sp``/``%nsp`` (space, none, before the next slot), else a word. A production is a
    lemma, ``%concat(cat)`` and the like, with argument numbers ``[1;3]``.
    """
    slots, productions = [], []

    def one(n, line):
        parts = line.split("\t")
        if len(parts) != 2:
            raise ValueError(f"{len(parts)} fields instead of 2")
        at, spacing, own = 0, None, []
        for m in _SLOT.finditer(parts[0]):
            guard, mode, cat, lemma, interp, any_, orth = m.groups()
            if guard:
                spacing = guard
                continue
            at += 1
            op, arg = ("mode", mode) if mode else ("cat", cat) if cat else ("lemma", lemma) if lemma else ("any", None) if any_ else ("orth", orth)
            own.append((n, at, op, arg, interp, spacing))
            spacing = None
        made = _PRODUCTION.match(parts[1])
        if not own or not made:
            raise ValueError("no slot" if not own else f"production {parts[1]}")
        args = [int(x) for x in (made[3] or "").split(";") if x]
        if any(not 1 <= a <= at for a in args):
            raise ValueError(f"argument beyond slot {at}")
        slots.extend(own)
        productions.append((n, made[1] or "literal", made[2], args))

    _all(text, one)
    return (
        spark.createDataFrame(slots, "rule_id int, slot int, op string, arg string, interp string, spacing string"),
        spark.createDataFrame(productions, "rule_id int, kind string, value string, args array<int>"),
    )


def sections(text: str) -> list[tuple[str, int, str]]:
    """(section, line number, line) under ``@NAME`` headers; a line before the first is an error."""
    out, name = [], None
    for n, line in _lines(text):
        if line.startswith("@"):
            name = line[1:].strip()
        elif name is None:
            raise RuleError([(n, "no section yet")])
        else:
            out.append((name, n, line))
    return out


_SELECTOR = re.compile(r"\s*([A-Za-z0-9_-]+)\s*(!=|=)\s*([^,]+)")


def selectors(text: str) -> list[tuple[str, str, list[str]]]:
    """``a=x|y, b!=z`` as (selector, relation, values)."""
    found = [(m[1], "<>" if m[2] == "!=" else "=", [v.strip() for v in m[3].split("|")]) for m in map(_SELECTOR.fullmatch, text.split(",")) if m]
    if len(found) != len(text.split(",")):
        raise ValueError(f"not a list of selectors: {text}")
    return found


_POSITION = re.compile(r"^(?:(\w+)\s*)?(?:\[([^\]]*)\])?\s*([<>]?)([?!]?)\{([^}]*)\}$")


def valence(spark: SparkSession, text: str) -> DataFrame:
    """Frames of ``selectors : sense : position + position`` under ``@LEXICON``.

    A position is ``role[range]direction necessity{phrase;phrase}``. Rows: frame_id, lemma, pos,
    selectors, sense, positions.
    """
    out, bad = [], []
    for section, n, line in sections(text):
        if section != "LEXICON":
            continue
        try:
            head, sense, frame = (x.strip() for x in line.split(":", 2))
            sels = selectors(head)
            get = lambda k: next((v[0] for s, r, v in sels if s == k and r == "="), "")
            positions = []
            for part in filter(None, (p.strip() for p in frame.split("+"))):
                m = _POSITION.match(part)
                if not m:
                    raise ValueError(f"position {part}")
                positions.append((m[1] or "", m[2] or "", m[3] or "both", {"?": "optional", "!": "required"}.get(m[4], "pro"), [x.strip() for x in m[5].split(";")]))
            out.append((n, get("lemma"), get("pos"), [(s, r, v) for s, r, v in sels], sense, positions))
        except ValueError as e:
            bad.append((n, str(e)))
    if bad:
        raise RuleError(bad)
    return spark.createDataFrame(
        out,
        "frame_id int, lemma string, pos string, selectors array<struct<selector:string,relation:string,values:array<string>>>, sense string, "
        "positions array<struct<role:string,range:string,direction:string,necessity:string,phrases:array<string>>>",
    )


def grammar(spark: SparkSession, text: str) -> DataFrame:
    """``selectors : category [: weight]`` under ``@LEXICON``: rule_id, lemma (null: any), pos, selectors, category, weight."""
    from lexloom.operators.chart import read

    out, bad = [], []
    for section, n, line in sections(text):
        if section != "LEXICON":
            continue
        try:
            parts = [x.strip() for x in line.split(":")]
            sels = selectors(parts[0])
            get = lambda k: next((v[0] for s, r, v in sels if s == k and r == "="), None)
            out.append((n, get("lemma"), get("pos"), [(s, r, v) for s, r, v in sels], str(read(parts[1])), float(parts[2]) if len(parts) > 2 else 0.0))
        except (ValueError, IndexError) as e:
            bad.append((n, str(e)))
    if bad:
        raise RuleError(bad)
    return spark.createDataFrame(out, "rule_id int, lemma string, pos string, selectors array<struct<selector:string,relation:string,values:array<string>>>, category string, weight double")


def inference_rules(text: str) -> list[tuple[int, dict, dict]]:
    """``pattern => template, priority`` with both sides as JSON, for ``semantics.rewrite``."""
    import json

    def one(n, line):
        body, _, priority = line.rpartition(",")
        left, arrow, right = body.partition("=>")
        if not arrow:
            raise ValueError("no =>")
        return int(priority), json.loads(left), json.loads(right)

    return sorted(_all(text, one), key=lambda r: r[0])


def coercions(spark: SparkSession, text: str) -> DataFrame:
    """``cat TAB cat2 TAB relation:cat:sense ...``: category pairs with their relation path."""

    def one(n, line):
        cat, cat2, *path = line.split("\t")
        steps = [tuple((x + "::").split(":")[:3]) for p in path for x in p.split()]
        return cat, cat2, steps

    return spark.createDataFrame(_all(text, one), "cat string, cat2 string, path array<struct<relation:string,cat:string,sense:string>>")


def fixed_phrases(frames: DataFrame) -> DataFrame:
    """Lemmata of the part of speech ``fixed`` as word sequences."""
    from pyspark.sql import functions as F

    return frames.filter("pos = 'fixed'").select("frame_id", F.split("lemma", " +").alias("words"))
