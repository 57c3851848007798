"""Token ids of whole texts for a lower-casing word tokenizer, many words at a time.

For tokenizers that lower-case, drop white space and merge byte pairs within pieces (words
of letters, single digits, runs of other signs, English contractions), the ids of a text are
those of its pieces in a row. Texts are cut into pieces with numpy; a hash table of pieces
(exact: it compares all bytes) gives the ids of those seen before, ``merges`` those of new
ones. Only words of printable ASCII and Latin-1 letters without ``<|`` are cut so. Other
words, and pieces of more than KEY_BYTES bytes, go one by one through the tokenizer itself,
behind a dictionary. All is bounded: texts are taken CHUNK bytes at a time, cut at white
space, and what is remembered is forgotten after ENTRIES entries.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from lexloom.llm.merges import PieceMerger, ranges

CHUNK = 2_000_000
KEY_BYTES = 24
ENTRIES = 500_000
_SLOTS_BITS = 20
_SPACE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_SPACES = b" \t\n\x0b\x0c\r"
_C0, _C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2**64 - 1], np.uint64)


def _classes() -> np.ndarray:
    table = np.full(256, _ODD, np.uint8)
    table[33:127] = _SIGN
    table[list(_SPACES)] = _SPACE
    table[ord("0") : ord("9") + 1] = _DIGIT
    table[ord("a") : ord("z") + 1] = _LETTER
    table[0xC3] = _LETTER
    return table


_CLASS = _classes()
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def cut(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """raw: UTF-8 that ends in white space. Lower-cased bytes, starts, ends and oddness of its pieces.

    An odd piece is a whole word that must not be cut here; its bytes are to be taken from raw.
    """
    low, n = _LOWER[raw], len(raw)
    kind = _CLASS[low]
    # Latin-1 letters: C3 and a byte of their own; capitals lie 32 below (but for the signs D7, F7).
    lead = np.flatnonzero(low[:-1] == 0xC3)
    tail = low[lead + 1]
    low[lead + 1] = tail + (np.uint8(32) * (tail < 0x9F))
    kind[lead + 1] = _LETTER
    signs = lead[(tail | np.uint8(0x20)) == 0xB7]
    kind[signs] = kind[signs + 1] = _ODD
    kind[np.flatnonzero((low[:-1] == ord("<")) & (low[1:] == ord("|")))] = _ODD
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == _DIGIT
    quotes = np.flatnonzero(low[:-3] == ord("'"))
    quotes = quotes[start[quotes]]
    one, two = low[quotes + 1], low[quotes + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    start[quotes[short | long] + 1] = False
    after = quotes[short | long] + np.where(short, 2, 3)[short | long]
    start[after[kind[after] == _LETTER]] = True
    start &= kind != _SPACE
    odd = kind == _ODD
    word = kind != _SPACE
    flags = odd
    if odd.any():  # words with an odd byte are one piece each
        first = word & np.concatenate([[True], ~word[:-1]])
        number = np.cumsum(first)
        bad = np.zeros(int(number[-1]) + 1, bool)
        bad[number[odd]] = True
        flags = bad[number] & word
        start = start & ~flags | first & flags
    at = np.flatnonzero(start)
    last = word[:-1] & (start[1:] | ~word[1:])  # raw ends in white space
    return low, at, np.flatnonzero(last) + 1, flags[at]


class WordIds:
    """``encode`` gives the ids of whole texts as uint16 arrays."""

    def __init__(self, merger: PieceMerger, one_by_one: Callable[[list[str]], list[bytes]]):
        self.merger, self.one_by_one = merger, one_by_one
        self.slots = np.empty((2, 1 << _SLOTS_BITS), np.int32)
        self.keys = np.empty((3, ENTRIES * 2), np.uint64)
        self.first, self.size = np.empty(ENTRIES * 2, np.int64), np.empty(ENTRIES * 2, np.int64)
        self._forget()

    def _forget(self) -> None:
        self.slots[:] = -1
        self.count, self.pool, self.pooled = 0, np.empty(1 << 20, np.uint16), 0
        self.odd: dict[bytes, int] = {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[] for _ in texts]
        owners, held, size = [], [], 0
        for i, text in enumerate(texts):
            data = text.encode("utf-8", "surrogatepass") if text else b""
            at = 0
            while at < len(data):
                stop = len(data) if len(data) - at <= CHUNK else _gap(data, at + CHUNK)
                if size and size + stop - at > CHUNK:
                    self._chunk(owners, held, out)
                    owners, held, size = [], [], 0
                owners.append(i)
                held.append(data[at:stop])
                size += stop - at
                at = stop
        if held:
            self._chunk(owners, held, out)
        none = np.zeros(0, np.uint16)
        return [x[0] if len(x) == 1 else np.concatenate([none, *x]) for x in out]

    def _chunk(self, owners: list[int], held: list[bytes], out: list[list[np.ndarray]]) -> None:
        if self.count > ENTRIES:
            self._forget()
        joined = b" \n".join([*held, b"   "])
        raw = np.frombuffer(joined, np.uint8)
        low, start, end, odd = cut(raw)
        size = end - start
        entry = np.empty(len(start), np.int64)
        plain = ~odd & (size <= KEY_BYTES)
        low = np.concatenate([low, np.zeros(KEY_BYTES, np.uint8)])
        # Pieces of up to eight bytes, most of all, are one number each; they have slots of their own.
        for wide, there in enumerate((plain & (size <= 8), plain & (size > 8))):
            at = np.flatnonzero(there)
            entry[at] = self._find(low, start[at], size[at], wide)
        rest = np.flatnonzero(~plain)
        if len(rest):
            entry[rest] = self._one_by_one([joined[a:b] for a, b in zip(start[rest].tolist(), end[rest].tolist())])
        counts = self.size[entry]
        ids = self.pool[ranges(self.first[entry], counts)]
        # Where each text's pieces end, then its ids.
        stops = np.cumsum(np.fromiter((len(h) + 2 for h in held), np.int64, len(held)))
        done = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(start, stops)].tolist()
        for i, a, b in zip(owners, [0, *done], done):
            out[i].append(ids[a:b])

    def _find(self, low: np.ndarray, start: np.ndarray, size: np.ndarray, wide: int) -> np.ndarray:
        """The entry of each piece; new ones are merged and entered. ``wide``: of more than eight bytes."""
        windows = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))
        keys = [windows[start + 8 * j] & _MASKS.take(np.clip(size - 8 * j, 0, 8)) for j in range(3 if wide else 1)]
        h = keys[0] * _C0
        if wide:
            h ^= keys[1] * _C1 ^ keys[2] * _C2
        h ^= h >> np.uint64(31)
        slots = self.slots[wide]
        slot = (h * _C3 >> np.uint64(64 - _SLOTS_BITS)).astype(np.int64)
        entry, live, new = np.empty(len(start), np.int64), np.arange(len(start)), []
        before = self.count
        while len(live):
            found = slots.take(slot.take(live))
            fresh = live[found < 0]
            if len(fresh):
                # The last to write a free slot has it; the others look again, for it may be theirs.
                slots[slot[fresh]] = fresh
                fresh = fresh[slots[slot[fresh]] == fresh]
                own = np.arange(self.count, self.count + len(fresh))
                self._room(self.count + len(fresh))
                slots[slot[fresh]] = own
                for j, key in enumerate(keys):
                    self.keys[j, own] = key[fresh]
                self.count += len(fresh)
                new.append(fresh)
                found = slots.take(slot.take(live))
            same = np.logical_and.reduce([self.keys[j].take(found) == key.take(live) for j, key in enumerate(keys)])
            entry[live[same]] = found[same]
            live = live[~same]
            slot[live] = slot[live] + 1 & (1 << _SLOTS_BITS) - 1
        if new:
            at = np.concatenate(new)
            ids, counts = self.merger.merge(low[ranges(start[at], size[at])], size[at])
            self._enter(before, ids, counts)
        return entry

    def _room(self, n: int) -> None:
        if n > len(self.first):
            self.keys = np.concatenate([self.keys, np.empty_like(self.keys)], axis=1)
            self.first, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.first, self.size))
        if n > 3 << _SLOTS_BITS - 2:
            raise MemoryError("more distinct pieces in one chunk than the table holds")

    def _enter(self, at: int, ids: np.ndarray, counts: np.ndarray) -> None:
        self.first[at : at + len(counts)] = self.pooled + np.cumsum(counts) - counts
        self.size[at : at + len(counts)] = counts
        while self.pooled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.pooled : self.pooled + len(ids)] = ids
        self.pooled += len(ids)

    def _one_by_one(self, words: list[bytes]) -> list[int]:
        new = list({w for w in words if w not in self.odd})
        if new:
            found = [np.frombuffer(x, np.uint16) for x in self.one_by_one([w.decode() for w in new])]
            self._room(self.count + len(new))
            self._enter(self.count, np.concatenate(found), np.array([len(x) for x in found], np.int64))
            self.odd.update(zip(new, range(self.count, self.count + len(new))))
            self.count += len(new)
        return [self.odd[w] for w in words]


def _gap(data: bytes, at: int) -> int:
    """The first white space at or after a place, or the end."""
    while at < len(data) and data[at] not in _SPACES:
        at += 1
    return at
