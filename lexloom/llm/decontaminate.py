"""Operator 2: benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and taken as words of letters and digits. A test item of n words may
differ in k = floor(MAX_ERROR_RATE * n) word edits. Cut into k + 1 pieces, at least one
stays whole in any place within k edits, so exact hits of pieces (one Aho-Corasick pass
over the text) give all candidate places, and Myers' bit-parallel distance, with words as
symbols, verifies each. Candidate windows of one item that overlap are verified as one.

The items are taken in blocks of at most BLOCK_CHARS characters (or one longer item), one
scan of the documents for each block. A block is a file in the shared folder; the driver
holds one at a time, plans hold their paths, so what goes to the executors is bounded
whatever the benchmark's size.

Items of fewer than 1 / MAX_ERROR_RATE words have no budget and match whole and exactly.
Items without a word (null, empty) match nothing; repeated items count once. Null and empty documents are clean. Repeated documents are judged one by
one. Other columns are ignored by ``leaks`` and kept by ``clean``. Empty tables: ``leaks``
is empty, ``clean`` returns the documents.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import fresh_dir, open_fs, put_file, text_batches

MAX_ERROR_RATE = 0.2
BLOCK_CHARS = 8_000_000
LEAK_SCHEMA = "{id} long, item_id long, distance long, item_words long, first_word long, last_word long"
_GAPS = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    """Words of letters and digits, lower-cased, with a space before and after each."""
    return _GAPS.sub(" ", f" {text.lower()} ") if text else " "


def pieces(words: list[str], budget: int) -> list[tuple[int, list[str]]]:
    """(offset, words) of budget + 1 pieces of near-equal length that make up the item."""
    n, parts = len(words), budget + 1
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """Least edit distance of the pattern to any stretch of text, and where the first such ends."""
    m = len(pattern)
    peq: defaultdict[str, int] = defaultdict(int)
    for i, word in enumerate(pattern):
        peq[word] |= 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, m, 0
    for j, word in enumerate(text):
        eq = peq.get(word, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = ph << 1 & mask, mh << 1 & mask  # row zero is free: a match may start anywhere
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Searcher:
    def __init__(self, items: tuple[tuple[int | None, str], ...]):
        self.items: list[tuple[int | None, list[str], int]] = []
        places: defaultdict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in dict.fromkeys(items):
            words = normal(text).split()
            if not words:
                continue
            budget = int(MAX_ERROR_RATE * len(words) + 1e-9)
            for offset, part in pieces(words, budget):
                places[f" {' '.join(part)} "].append((len(self.items), offset))
            self.items.append((item_id, words, budget))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()

    def hits(self, text: str | None) -> Iterator[tuple[int | None, int, int, int, int]]:
        """(item id, distance, item words, first word, last word): the best place of each item."""
        if not text or not self.items:
            return
        flat = normal(text)
        starts: defaultdict[int, set[int]] = defaultdict(set)
        seen, word = 0, 0
        for end, (length, found) in self.automaton.iter(flat):
            begin = end - length + 1
            # Hits come by their end; the count of words goes along with the start.
            word += flat.count(" ", seen, begin) if begin >= seen else -flat.count(" ", begin, seen)
            seen = begin
            for item, offset in found:
                starts[item].add(word - offset)
        if not starts:
            return
        words = flat.split()
        for item in sorted(starts):
            item_id, pattern, budget = self.items[item]
            best = None
            for low, high in _windows(sorted(starts[item]), len(pattern), budget):
                low, high = max(0, low), min(len(words), high)
                distance, end = myers(pattern, words[low:high])
                if distance <= budget and (best is None or distance < best[0]):
                    _, back = myers(pattern[::-1], words[max(low, low + end - len(pattern) - budget) : low + end][::-1])
                    best = distance, low + end - max(back, 1), low + end - 1
            if best:
                yield item_id, best[0], len(pattern), best[1], best[2]


def _windows(starts: list[int], n: int, budget: int) -> Iterator[tuple[int, int]]:
    low = high = None
    for s in starts:
        a, b = s - budget, s + n + budget
        if low is None:
            low, high = a, b
        elif a <= low + n:  # near-equal alignments of one place
            high = max(high, b)
        else:
            yield low, high
            # The next window starts on its own; it may overlap, never leaves a place out.
            low, high = a, b
    if low is not None:
        yield low, high


@lru_cache(maxsize=2)
def searcher(path: str) -> Searcher:
    filesystem, local = open_fs(path)
    with filesystem.open_input_file(local) as stream:
        return Searcher(tuple(map(tuple, json.loads(stream.read()))))


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> list[str]:
    """Files of the benchmark's items, a block in each."""
    folder = fresh_dir(benchmark.sparkSession, "benchmark")
    paths: list[str] = []
    block, size = [], 0

    def put() -> None:
        data = json.dumps(block).encode()
        paths.append(put_file(folder, f"block-{len(paths):06d}.json", lambda out: out.write(data)))

    rows = benchmark.select(F.col(item_col).cast("long"), F.col(text_col)).filter(F.col(text_col).isNotNull()).distinct()
    for item_id, text in rows.toLocalIterator():
        if block and size + len(text) > BLOCK_CHARS:
            put()
            block, size = [], 0
        block.append((item_id, text))
        size += len(text)
    if block:
        put()
    return paths


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item found in it, with the item's best place."""
    schema = LEAK_SCHEMA.format(id=f"`{id_col}`")
    names = [id_col, "item_id", "distance", "item_words", "first_word", "last_word"]
    picked = docs.select(docs[id_col].cast("long").alias("key"), docs[text_col].alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for block in item_blocks(benchmark, item_col, item_text):

        def run(batches, block=block):
            find = searcher(block)
            for keys, texts in text_batches(batches, "key", "text"):
                rows = [(k, *hit) for k, t in zip(keys, texts) for hit in find.hits(t)]
                columns = [list(c) for c in zip(*rows)] or [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        out = out.unionByName(picked.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs in which no item is found, all columns unchanged."""
    place, schema = docs.columns.index(text_col), docs.schema
    for block in item_blocks(benchmark, item_col, item_text):

        def run(batches, block=block):
            find = searcher(block)
            for batch in batches:
                good = [next(find.hits(t.as_py()), None) is None for t in batch.column(place)]
                yield batch.filter(pa.array(good, pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
