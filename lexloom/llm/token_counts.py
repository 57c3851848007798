"""Operator 5: greedy word-piece counts by a linear longest-match automaton.

A word is cut into the longest vocabulary entry that starts it, then the longest
continuation entries. The trie of the vocabulary has failure links: where no edge fits, the
longest matches of what has been read are known to be popped, so each node keeps their
number and the node that stands for the rest. Reading a word once, character by character,
adds up popped pieces; no piece is ever built. A word that can't be cut counts as one
unknown piece.

Words are ``[^\\x20\\x09-\\x0D]+`` of whole texts. The vocabulary is a sentencepiece
model's (entries with U+2581 start words, others continue them) or a word-end BPE file's
(any entry starts or continues), or any two sets of entries. Null and empty texts have no words: counts 0. Repeated rows count
one by one; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.llm.common import text_batches, words_of

SCHEMA = "n_words long, n_tokens long, n_unknown_words long"
#: Words whose count a worker remembers.
CACHE_WORDS = 400_000


class Automaton:
    """Trie with a root for word starts and one for continuations."""

    def __init__(self, starts: set[str], continuations: set[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        self.fail: list[int] = [-1, -1]
        self.pops: list[int] = [0, 0]
        final = [False, False]
        parent: list[tuple[int, str]] = [(-1, ""), (-1, "")]
        for root, entries in ((0, starts), (1, continuations)):
            for entry in entries:
                node = root
                for ch in entry:
                    down = self.next[node].get(ch)
                    if down is None:
                        down = len(self.next)
                        self.next[node][ch] = down
                        self.next.append({})
                        self.fail.append(-1)
                        self.pops.append(0)
                        final.append(False)
                        parent.append((node, ch))
                    node = down
                if node > 1:
                    final[node] = True
        level = [*self.next[0].values(), *self.next[1].values()]
        while level:  # breadth first, so shorter prefixes are done
            for node in level:
                if final[node]:  # all of it is one piece; the rest is empty
                    self.fail[node], self.pops[node] = 1, 1
                    continue
                up, ch = parent[node]
                at, popped = self.fail[up], self.pops[up]
                while at >= 0 and ch not in self.next[at]:
                    popped += self.pops[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.pops[node] = self.next[at][ch], popped
            level = [down for node in level for down in self.next[node].values()]

    def count(self, word: str) -> int:
        """Pieces of the greedy cut; 0 if there is none."""
        node, pieces = 0, 0
        nexts, fail, pops = self.next, self.fail, self.pops
        for ch in word:
            down = nexts[node].get(ch)
            while down is None:
                pieces += pops[node]
                node = fail[node]
                if node < 0:
                    return 0
                down = nexts[node].get(ch)
            node = down
        while node != 1:
            pieces += pops[node]
            node = fail[node]
            if node < 0:
                return 0
        return pieces


def word_piece_vocabulary(path: str) -> tuple[set[str], set[str]]:
    """Starting and continuing entries of a sentencepiece model: those with and without U+2581."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    starts, continuations = set(), set()
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        if piece.startswith("▁"):
            starts.add(piece[1:])
        else:
            continuations.add(piece)
    return starts - {""}, continuations - {""}


def bpe_vocabulary(path: str) -> tuple[set[str], set[str]]:
    """Entries of a tokenizers JSON file with word ends: any entry may start or continue."""
    with open(path, encoding="utf-8") as f:
        entries = {t.removesuffix("</w>") for t in json.load(f)["model"]["vocab"]} - {""}
    return entries, entries


class Counter:
    def __init__(self, path: str):
        self.automaton = Automaton(*(word_piece_vocabulary if path.endswith(".model") else bpe_vocabulary)(path))
        self.known: dict[bytes, int] = {}

    def counts(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, count, out = self.known, self.automaton.count, []
        for text in texts:
            words = words_of(text)
            for word in set(words).difference(known):
                known[word] = count(word.decode("utf-8", "surrogatepass"))
            found = [*map(known.__getitem__, words)]
            unknown = found.count(0)
            out.append((len(words), sum(found) + unknown, unknown))
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id and the columns of SCHEMA."""

    def run(batches):
        count = counter(vocabulary).counts
        for keys, texts in text_batches(batches, "key", "text"):
            columns = zip(*count(texts))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], names=[id_col, "n_words", "n_tokens", "n_unknown_words"])

    picked = docs.select(docs[id_col].cast("long").alias("key"), docs[text_col].alias("text"))
    return picked.mapInArrow(run, f"`{id_col}` long, {SCHEMA}")
