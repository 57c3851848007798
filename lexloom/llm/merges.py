"""Byte-pair merging of many short pieces in step, with numpy.

``PieceMerger`` applies a tokenizer file's ordered merges to byte strings: every round joins
in each piece the pair of least rank, the leftmost first, until none is left, as the
tokenizer does for one piece. A pair is looked up in a table of displaced rows: the second
symbols of all pairs with one first symbol stand at that symbol's own shift.
"""

from __future__ import annotations

import json

import numpy as np

#: Pieces longer than this are left to the tokenizer.
MAX_BYTES = 48
#: Pieces merged in step.
IN_STEP = 20_000
_NONE = np.uint16(0xFFFF)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1 ... of size[0] numbers, then those of start[1] and so on."""
    stop = np.cumsum(size)
    return np.repeat(start - stop + size, size) + np.arange(int(stop[-1]) if len(stop) else 0)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class PieceMerger:
    """Merges of a byte-level vocabulary whose words end in ``suffix``; ids and ranks in one order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # Rank order must be id order: then the least id made is the merge of least rank.
        self.usable = len(vocab) <= 0xFFFF and bool(suffix) and bool((np.diff(made) > 0).all()) and not model.get("dropout") and not model.get("ignore_merges")
        if not self.usable:
            return
        inner = byte_symbols()
        self.inner = np.array([vocab[c] for c in inner], np.uint16)
        self.final = np.array([vocab[c + suffix] for c in inner], np.uint16)
        first, second = np.array([vocab[a] for a, _ in pairs]), np.array([vocab[b] for _, b in pairs])
        self._displace(first, second, made)

    def _displace(self, first: np.ndarray, second: np.ndarray, made: np.ndarray) -> None:
        slots = 1 << 18
        self.owner, self.made = np.full(slots + (1 << 16), _NONE, np.uint16), np.full(slots + (1 << 16), _NONE, np.uint16)
        self.shift = np.zeros(1 << 16, np.int32)
        order = np.argsort(first, kind="stable")
        starts = np.flatnonzero(np.diff(first[order], prepend=-1))
        rows = np.split(order, starts[1:])
        at = 0
        for row in sorted(rows, key=len, reverse=True):
            ends, a = second[row], int(first[row[0]])
            while (self.owner[at + ends] != _NONE).any():
                at = (at * 5 + 1031) % slots
            self.shift[a] = at
            self.owner[at + ends], self.made[at + ends] = a, made[row]
            at = (at * 5 + 1031) % slots

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that each pair makes, or _NONE."""
        at = self.shift[a] + b
        return np.where(self.owner[at] == a, self.made[at], _NONE)

    def merge(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of ``size`` bytes (1 to MAX_BYTES) in a row: their ids in a row, and how many each has."""
        order, start = np.argsort(size, kind="stable"), np.cumsum(size) - size
        found, counts = [np.zeros(0, np.uint16)], np.zeros(len(size), np.int64)
        for at in range(0, len(order), IN_STEP):
            part = order[at : at + IN_STEP]
            symbols = self._merge(data[ranges(start[part], size[part])], size[part])
            kept = symbols != _NONE
            counts[part] = kept.sum(axis=1)
            found.append(symbols[kept])
        by_size = np.concatenate(found)
        first = np.empty(len(size), np.int64)
        first[order] = np.cumsum(counts[order]) - counts[order]
        return by_size[ranges(first, counts)], counts

    def _merge(self, data: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A row of symbols for each piece, _NONE behind its end."""
        n, width = len(size), int(size.max())
        column = np.arange(width)
        there = column < size[:, None]
        symbols = np.full((n, width + 1), _NONE, np.uint16)
        symbols[:, :width][there] = self.inner[data]
        row = np.arange(n)
        symbols[row, size - 1] = self.final[data[np.cumsum(size) - 1]]
        made = np.full((n, width), _NONE, np.uint16)
        if width > 1:
            made[:, : width - 1] = self._pair(symbols[:, : width - 1], symbols[:, 1:width])
        # Rows still merging are kept together; the others have been put back.
        live, s, m = row, symbols, made
        while len(live):
            at = m.argmin(axis=1)
            new = m[np.arange(len(live)), at]
            more = np.flatnonzero(new != _NONE)
            if len(more) < len(live):
                symbols[live] = s
                live, s, m, at, new = live[more], s[more], m[more], at[more], new[more]
                if not len(live):
                    break
            r = np.arange(len(live))
            gone = column[None, :] > at[:, None]
            s[:, :width] = np.where(gone, s[:, 1:], s[:, :width])
            m[:, : width - 1] = np.where(gone[:, : width - 1], m[:, 1:], m[:, : width - 1])
            m[:, width - 1] = _NONE
            s[r, at] = new
            after = s[r, at + 1]
            m[r, at] = self._pair(new, after)
            inside = np.flatnonzero(at > 0)
            m[inside, at[inside] - 1] = self._pair(s[inside, at[inside] - 1], new[inside])
        return symbols[:, :width]
