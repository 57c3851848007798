"""Operator 9: license scan by ordered signature rules.

Texts become lower-case (A-Z) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Keywords gate
the rules of ``license_rules``: a rule's regex runs only in texts that hold its keyword.
A detection that lies within one of the same or higher priority (or, at the same priority,
within a longer or earlier one) is suppressed, and so is a family or bare notice that
overlaps a better one; others may overlap. Base phrases are
counted as word sequences, and their labels always stay.

Null and empty texts have no words, places or labels: counts 0, places null, labels '',
score 0. The score is the best remaining detection's priority / 100, or 1 with a base
phrase. Repeated rows are scanned one by one; other columns are ignored; an empty table
gives an empty one.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.llm.common import text_batches
from lexloom.llm.license_rules import RULES

BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Rules up to this priority name a family or a bare notice; they also yield to a better one that they overlap.
GENERIC = 50
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]
TYPES = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
SPANS = "array<struct<label:string,priority:int,first_word:long,last_word:long>>"


@cache
def rules() -> list[tuple[str, re.Pattern, int, re.Pattern]]:
    found = []
    for line in RULES.strip().splitlines():
        label, keyword, priority, pattern = (x.strip() for x in line.split(" | ", 3))
        for name, text in (("{V}", "(?:version |v |v)?"), ("{L}", "(?:licen[cs]ed?)"), ("{N}", "(?![0-9]| [0-9])")):
            pattern = pattern.replace(name, text)
        found.append((label, keyword, int(priority), re.compile(f"(?<= )(?:{pattern})(?= )".encode())))
    return found


@cache
def by_keyword() -> dict[bytes, list[tuple[str, int, re.Pattern]]]:
    table: dict[bytes, list[tuple[str, int, re.Pattern]]] = {}
    for label, keyword, priority, pattern in rules():
        for k in ("license", "licence") if keyword == "licen[cs]e" else (keyword,):
            table.setdefault(f" {k}".encode(), []).append((label, priority, pattern))
    return table


def flat(text: str | None) -> tuple[int, bytes]:
    """Number of words; the words with a space before and after each."""
    words = text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []
    return len(words), b" %s " % b" ".join(words)


def detect(line: bytes) -> list[tuple[int, int, str, int]]:
    """(start, end, label, priority) that suppression leaves, by start."""
    table, found = by_keyword(), {}
    for keyword in filter(line.__contains__, table):
        for label, priority, pattern in table[keyword]:
            for m in pattern.finditer(line):
                found[m.start(), m.end(), label] = max(priority, found.get((m.start(), m.end(), label), 0))
    return suppress([(*span, priority) for span, priority in found.items()])


def suppress(found: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Drop what lies within a detection that is before it in the order of priority, length, start.

    A GENERIC one also yields to any better one that it overlaps. Priorities are taken from the
    highest down, the spans of each all at once: sorted by start, a span lies within an earlier
    one if some end so far is not before its own. Linear but for the sorts.
    """
    if not found:
        return []
    start, end, priority = (np.array([x[i] for x in found], np.int64) for i in (0, 1, 3))
    label = np.array([x[2] for x in found])
    taken = bytearray(int(end.max()))  # bytes that kept spans cover
    kept = np.zeros(0, np.int64)
    for p in sorted(set(priority.tolist()), reverse=True):
        own = np.flatnonzero(priority == p)
        if p <= GENERIC:  # one after the other: whether one stays hangs on those that stayed
            new = []
            for i in own[np.lexsort((label[own], start[own], start[own] - end[own]))].tolist():
                if taken.find(1, start[i], end[i]) < 0:
                    taken[start[i] : end[i]] = b"\1" * int(end[i] - start[i])
                    new.append(i)
        else:
            both = np.concatenate([kept, own])
            # At one place those of higher priority and longer ones come first, then by label.
            both = both[np.lexsort((label[both], -priority[both], -end[both], start[both]))]
            before = np.concatenate([[0], np.maximum.accumulate(end[both])[:-1]])
            new = both[(before < end[both]) & (priority[both] == p)]
            for a, b in zip(start[new].tolist(), end[new].tolist()):
                taken[a:b] = b"\1" * (b - a)
        kept = np.concatenate([kept, np.array(new, np.int64)])
    return sorted(found[i] for i in kept.tolist())


def base_places(line: bytes) -> list[tuple[int, str]]:
    """(byte offset, label) of each base phrase."""
    found = []
    for label, phrase in BASE:
        key = f" {phrase} ".encode()
        at = line.find(key)
        while at >= 0:
            found.append((at + 1, label))
            at = line.find(key, at + 1)
    return sorted(found)


def word_numbers(line: bytes, places: list[int]) -> list[int]:
    """The number of the word that starts, or ends, at each place; one pass over the line."""
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    return (np.searchsorted(spaces, places) - 1).tolist()


def scan(text: str | None, with_spans: bool = True) -> tuple:
    """The columns of SCHEMA, then the spans (label, priority, first word, last word)."""
    n, line = flat(text)
    places, found = base_places(line), detect(line)
    base = sorted({label for _, label in places})
    labels = sorted({*base, *(x[2] for x in found)})
    score = 1.0 if places else max((x[3] for x in found), default=0) / 100
    first, last = word_numbers(line, [places[0][0], places[-1][0]]) if places else (None, None)
    spans = []
    if with_spans and found:
        numbers = word_numbers(line, [at for x in found for at in x[:2]])
        spans = [{"label": x[2], "priority": x[3], "first_word": a, "last_word": b} for x, a, b in zip(found, numbers[::2], numbers[1::2])]
    return n, len(places), first, last, ",".join(base), ",".join(labels), score, spans


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """One row per row of docs: its id, the columns of SCHEMA and the detections."""
    span_type = pa.list_(pa.struct([("label", pa.string()), ("priority", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64())]))

    def run(batches):
        for keys, texts in text_batches(batches, "key", "text"):
            columns = list(zip(*(scan(t, spans) for t in texts)))
            arrays = [pa.array(keys, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, TYPES))]
            names = [id_col, *FIELDS]
            if spans:
                arrays.append(pa.array(columns[-1], span_type))
                names.append("detections")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    picked = docs.select(docs[id_col].cast("long").alias("key"), docs[text_col].alias("text"))
    return picked.mapInArrow(run, f"`{id_col}` long, {SCHEMA}" + f", detections {SPANS}" * spans)
