"""Operator 8: quality rules with suffix-array repetition.

Words are ``[^\\x20\\x09-\\x0D]+``. Besides the base counts, the suffixes of a text that
share a window of ``WINDOW`` words with another suffix are put in suffix order (prefix
doubling over window classes); the longest-common-prefix of neighbours gives the
intervals of maximal repeated substrings. Each suffix of an interval spans the longest
prefix it shares, so the union of these spans is the union over all maximal repeats.
Suffixes without such a partner share fewer words than any repeat counted here.

All documents of a batch are sorted together (classes never cross documents), whole
texts always. Null and empty texts have no words: they fail the base rule. Repeated rows
are judged one by one. Other columns are ignored by ``quality_rules`` and passed through
unchanged by ``quality_filter``, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from collections import defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.llm.common import BATCH_CHARS, text_batches, words_of

WINDOW = 5
#: Base rule.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Suffix-array rule: repeats of at least MIN_REPEAT words may cover MAX_COVERED_PERCENT of
#: the words; the longest may have MAX_LONGEST words or MAX_LONGEST_PERCENT of the text.
MIN_REPEAT = 12
MAX_COVERED_PERCENT = 15
MAX_LONGEST = 100
MAX_LONGEST_PERCENT = 10

SYMBOLS = "#*$%&|<>"
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_words long, longest_repeat long, base_failed boolean, kept boolean"
)
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]


def _candidates(ids: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions whose word window occurs again in their document."""
    n = len(ids)
    at = np.flatnonzero(np.arange(n) + WINDOW <= ends)
    if not len(at):
        return at
    rng = np.random.default_rng(7)
    mixed = rng.integers(0, 2**63, int(ids.max()) + 1, np.uint64)[ids]
    key = (doc[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(WINDOW):
        key = key * np.uint64(0xD6E8FEB86659FD93) + mixed[at + k]
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    hit = np.zeros(len(order), bool)
    hit[1:] |= same
    hit[:-1] |= same
    at, key = at[order[hit]], key[hit]
    # Different windows may share a hash: go by the words themselves from here on.
    order = np.lexsort([*(ids[at + k] for k in range(WINDOW - 1, -1, -1)), doc[at]])
    at = at[order]
    new = np.ones(len(at), bool)
    new[1:] = doc[at[1:]] != doc[at[:-1]]
    for k in range(WINDOW):
        new[1:] |= ids[at[1:] + k] != ids[at[:-1] + k]
    cls = np.cumsum(new) - 1
    return at[np.bincount(cls)[cls] > 1] if len(at) else at


def repeats(ids: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of repeated suffixes and the words each shares with its best neighbour.

    ids: word ids; doc: document of each word (ascending); ends: end position of that document.
    """
    at = _candidates(ids, doc, ends)
    if not len(at):
        return at, at
    n = len(ids)
    # Ranks in word order of all windows that a comparison below can meet: a suffix tied
    # over h words has candidates at each of them, so the next window starts at one + WINDOW.
    need = np.union1d(at, np.minimum(at + WINDOW, ends[at] - 1))
    columns = [doc[need]]
    for k in range(WINDOW):
        columns.append(np.where(need + k < ends[need], ids[np.minimum(need + k, n - 1)], -1))
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(need), bool)
    for column in columns:
        new[1:] |= column[order[1:]] != column[order[:-1]]
    rank = np.full(n + 1, -1)
    rank[need[order]] = np.cumsum(new)
    levels, h = [], WINDOW
    while True:
        levels.append((h, rank))
        # Behind the end of its document a suffix has nothing: first in order.
        second = np.where(at + h < ends[at], rank[np.minimum(at + h, n)], -1)
        first = rank[at]
        order = np.lexsort((second, first))
        at, first, second = at[order], first[order], second[order]
        new = np.ones(len(at), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        if new.all():
            break
        # Keep the order among all windows: others stay where they stood, between the tied.
        base = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
        start = np.repeat(first[base] * (len(at) + 1), np.diff(np.r_[base, len(at)]))
        wider = np.where(rank >= 0, rank * (len(at) + 1), -1)
        wider[at] = start + np.cumsum(new) - np.repeat(np.cumsum(new)[base], np.diff(np.r_[base, len(at)]))
        values, rank = np.unique(wider, return_inverse=True)
        rank = rank - (values[0] < 0)
        h *= 2
    left, right = at[:-1].copy(), at[1:].copy()
    end_l, end_r = ends[left], ends[right]
    lcp = np.zeros(len(left), np.int64)
    for h, rank in reversed(levels):
        equal = (left < end_l) & (right < end_r)
        equal &= rank[np.minimum(left, n)] == rank[np.minimum(right, n)]
        equal &= (left + h <= end_l) & (right + h <= end_r) & (rank[np.minimum(left, n)] >= 0)
        lcp[equal] += h
        left[equal] += h
        right[equal] += h
    live = doc[at[:-1]] == doc[at[1:]]
    for _ in range(WINDOW - 1):
        live = live & (left < end_l) & (right < end_r)
        live[live] = ids[left[live]] == ids[right[live]]
        lcp[live] += 1
        left[live] += 1
        right[live] += 1
    best = np.zeros(len(at), np.int64)
    best[1:] = lcp
    best[:-1] = np.maximum(best[:-1], lcp)
    return at, best


def _covered(n: int, at: np.ndarray, length) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _dup_lines(text: str) -> int:
    seen: set[str] = set()
    found = 0
    for line in text.split("\n"):
        if line in seen:
            found += 1
        elif line.strip(" \t\n\v\f\r"):
            seen.add(line)
    return found


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The columns of SCHEMA for a list of texts."""
    table: defaultdict[bytes, int] = defaultdict()
    table.default_factory = table.__len__
    words = [words_of(t) for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    total = int(n_words.sum())
    ids = np.fromiter((i for w in words for i in map(table.__getitem__, w)), np.int64, total)
    doc = np.repeat(np.arange(len(texts)), n_words)
    ends = np.cumsum(n_words)[doc] if total else np.zeros(0, np.int64)
    at, best = repeats(ids, doc, ends)
    out = {"n_words": n_words}
    # Code points in words: all but the six separators.
    out["word_chars"] = np.array([len(t) - sum(map(t.count, " \t\n\v\f\r")) if t else 0 for t in texts], np.int64)
    out["n_symbols"] = np.array([sum(map(t.count, SYMBOLS)) if t else 0 for t in texts], np.int64)
    out["n_dup_lines"] = np.array([_dup_lines(t) if t else 0 for t in texts], np.int64)
    count = partial(np.bincount, minlength=len(texts))
    out["n_repeat_words"] = count(doc[_covered(total, at, WINDOW)])
    long = best >= MIN_REPEAT
    out["covered_words"] = count(doc[_covered(total, at[long], best[long])])
    out["longest_repeat"] = np.zeros(len(texts), np.int64)
    np.maximum.at(out["longest_repeat"], doc[at], best)
    out["base_failed"] = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * n_words)
    out["kept"] = (
        ~out["base_failed"]
        & (100 * out["covered_words"] <= MAX_COVERED_PERCENT * n_words)
        & ((out["longest_repeat"] <= MAX_LONGEST) | (100 * out["longest_repeat"] <= MAX_LONGEST_PERCENT * n_words))
    )
    return out


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and the columns of SCHEMA."""

    def run(batches):
        for keys, texts in text_batches(batches, "key", "text"):
            got = measure(texts)
            yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), *(pa.array(got[f]) for f in FIELDS)], names=[id_col, *FIELDS])

    picked = docs.select(docs[id_col].alias("key"), docs[text_col].alias("text"))
    key_type = pa.string() if dict(picked.dtypes)["key"] == "string" else pa.int64()
    return picked.mapInArrow(run, f"`{id_col}` {picked.dtypes[0][1]}, {SCHEMA}")


def quality_filter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged."""
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            kept, texts, size = [], [], 0
            for text in [*batch.column(place).to_pylist(), StopIteration]:
                if text is StopIteration or texts and size + len(text or "") > BATCH_CHARS:
                    kept.append(measure(texts)["kept"] if texts else np.zeros(0, bool))
                    texts, size = [], 0
                if text is not StopIteration:
                    texts.append(text)
                    size += len(text or "")
            yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)
