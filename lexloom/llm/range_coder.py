"""Adaptive context-mixing range coder for token ids, many blocks in step.

A group of ids is cut into blocks of BLOCK ids. Every block starts from the same state: the
group's starting table (``start_table``: the group's ids in order of frequency, with 16-bit
frequencies), empty contexts and fixed weights. Nothing passes from block to block, so any
block decodes alone from the table and its own words; each has a CRC-32 of its ids.

Three adaptive predictions are mixed for each id:

* order 2: the id last seen after the two before (slot found by hash, with a tag);
* order 1: the two leading ids after the one before, by their counts;
* order 0: starting frequencies plus the block's own counts, these weighted so that they
  lead after START_IDS ids. Counts grow with each id; the cumulative table that coding
  needs is made anew at the places of REBUILD.

Weights belong to the confidence of the contexts (STATES states a block) and follow each
prediction's share in the mixed probability of the id that came (order 0's as the starting
table has it). The ids that the contexts name have intervals of mixed mass of their own in a
64-bit range coder, whose carries are added when all words are there; the rest of the range is
order 0's. numpy runs all blocks of a group in step, one id of each at a time; order 0's
intervals are looked up some blocks at a time by the encoder, whose ids are known beforehand.
Weights are single floats, each operation rounded by itself, so both directions agree.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np

BLOCK = 4096
#: Blocks in step; fewer with a wide alphabet (``max_lanes``).
LANES = 4096
#: Bytes of adaptive state in step.
STATE_BYTES = 160_000_000
SLOTS_BITS = 11
#: Ranks in a row of the cumulative table: their starts and the end, 16 numbers, are a cache line.
SEGMENT = 15
#: Blocks whose counts are summed up at once.
PART = 16
#: Sum of the starting frequencies, and the weight of one id of the block.
TOTAL, START_IDS = 1 << 16, 512
STEP = TOTAL // START_IDS
#: Places whose contexts the encoder looks up at once.
AHEAD = 16
REBUILD = frozenset((32, 80, 160, 320, 640, 1200, 2200))
STATES = 80
RATE = np.float32(0.02)
#: Mass of all intervals, and what of it order 0 keeps whatever the weights.
ONE, FLOOR = 1 << 16, 1 << 10
#: Above every id: a context that names none.
NONE = np.uint32(0xFFFF)
_U = np.uint64
#: The range stays in [_LEAST, _WHOLE): 16 bits go out below it, and low has a bit for the carry.
_WHOLE, _LEAST, _BELOW = _U(1 << 62), _U(1 << 46), _U((1 << 46) - 1)
_16, _30, _46 = _U(16), _U(30), _U(46)


def _count_states():
    """Order 1 keeps the counts (a, b) of its two ids as the number 16 * a + b, a >= b.

    For each: shares of the two and confidence (0 to 15); what follows when neither, the first
    or the second came, and masks of where the new id replaces the second and the two change
    places then (256 * (0, 1, 2; 3 as 1) + state).
    """
    shares, trust = np.zeros((2, 1024), np.float32), np.zeros(1024, np.uint32)
    after, miss, swap = (np.zeros(1024, np.uint32) for _ in range(3))
    for a in range(16):
        for b in range(16):
            at, n = 16 * a + b, a + b
            if n:
                shares[:, at] = a / n, b / n
                trust[at] = min(15, 1 + min(4, a * 4 // n) + 5 * ((n > 1) + (n > 4)))
            for came in range(4):
                x, y = (a - a // 4, 1) if came == 0 else (a, b + 1) if came == 2 else (a + 1, b)
                if max(x, y) > 15:
                    x, y = (x + 1) // 2, (y + 1) // 2
                after[256 * came + at] = 16 * max(x, y) + min(x, y)
                miss[256 * came + at] = NONE * (came == 0)
                swap[256 * came + at] = NONE * (y > x)
    return shares, trust * np.uint32(LANES), after, miss, swap


_SHARES, _TRUST, _AFTER, _MISS, _SWAP = _count_states()
_SHARE_A, _SHARE_B = _SHARES
#: Starting weights of orders 2 and 1 by state: 16 * (times order 2 was right, to 3; 4: another context) + trust.
_WEIGHTS = np.array([((0, 0.15, 0.5, 0.75, 0)[s], (0.6, 0.5, 0.3, 0.15, 0.6)[s] * (t > 0) * (t + 1) / 16) for s in range(5) for t in range(16)], np.float32).view(np.complex64).reshape(-1)
#: Order 0 keeps some weight even where the others have all.
_OVER = np.float32(1 + FLOOR / ONE)
_SCALE, _KEEP = np.float32(ONE - FLOOR), np.float32(1) - RATE
_K_LAST, _K_BEFORE, _K_SPREAD = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0x2C1B3C6D))
_K_SLOT, _K_SLOTS, _K_TAG = (np.uint32(x) for x in (32 - SLOTS_BITS, (1 << SLOTS_BITS) - 1, 1 << 20))
_K_ONCE, _K_TWICE, _K_OTHER, _K_TIMES = (np.uint32(x << 16) for x in (1, 2, 4, 7))
_K16, _K_LOW, _K_STEP = np.uint32(16), np.uint32(0xFFFF), np.uint32(STEP)


def start_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur, the most frequent first, and frequencies, one at least, of sum TOTAL."""
    count = np.bincount(ids, minlength=1 << 16).astype(np.int64)
    order = np.argsort(-count, kind="stable")[: int((count > 0).sum())]
    freq = 1 + count[order] * (TOTAL - len(order)) // max(1, len(ids))
    freq[0] += TOTAL - int(freq.sum())
    return order.astype(np.uint16), freq


def max_lanes(alphabet: int) -> int:
    return max(1, min(LANES, STATE_BYTES // (7 * alphabet + (12 << SLOTS_BITS) + 8 * STATES)))


def _lines(shape: tuple[int, ...]) -> np.ndarray:
    """Numbers whose rows of 16 are cache lines."""
    n = math.prod(shape)
    room = np.empty(n + 16, np.uint32)
    skip = -room.ctypes.data % 64 // 4
    return room[skip : skip + n].reshape(shape)


def _turned(rows: np.ndarray) -> np.ndarray:
    """The transpose, copied a few cache lines at a time."""
    out = np.empty(rows.shape[::-1], rows.dtype)
    for a in range(0, len(rows), 64):
        out[:, a : a + 64] = rows[a : a + 64].T
    return out


class _Model:
    """The adaptive state of blocks in step; both directions drive it alike. Ids are ranks.

    A slot of order 2 holds tag (12 bits), times (4) and id (16); one of order 1 the count
    state (32 bits), second id (16) and first id (16). What is computed at each place lies in
    arrays made once, so that a place costs few passes over short rows.
    """

    def __init__(self, grid: np.ndarray, freq: np.ndarray):
        lanes, self.grid = grid.shape[1], grid  # ids by place and block, those to come not yet read
        if lanes > LANES:
            raise ValueError(f"more than {LANES} blocks in step")
        self.lanes, self.segments = lanes, -(-len(freq) // SEGMENT)
        # Tables are rows by slot, blocks side by side, so what all blocks use often lies together.
        self.lane, self.row = np.arange(lanes, dtype=np.int64), np.uint32(lanes)
        self.lane32 = self.lane.astype(np.uint32)
        self.freq = np.zeros(self.segments * SEGMENT, np.uint32)
        self.freq[: len(freq)] = freq
        self.usual = (freq / np.float64(TOTAL)).astype(np.float32)
        self.count, self.counted = np.zeros((lanes, len(self.freq)), np.uint16), 0
        self.one = np.full(lanes << SLOTS_BITS, int(NONE) << 16 | int(NONE), np.uint64)
        self.two = np.full(lanes << SLOTS_BITS, _K_OTHER | NONE, np.uint32)
        self.weight = np.repeat(_WEIGHTS, LANES)
        #: Ids that the contexts name (order 2's, order 1's two), their shares; masses up to each of them and of all.
        self.named, self.share = np.zeros((4, lanes), np.uint32), np.zeros((3, lanes), np.float32)
        self.upto = np.zeros((5, lanes), np.int64)
        self.upto[4] = ONE
        self.sums, self.both = np.zeros((3, lanes), np.float32), np.zeros((2, lanes), np.float32)
        self.weights, self.came = np.zeros((2, lanes), np.float32), np.zeros((2, lanes), np.float32)
        self.two_weights = np.zeros(lanes, np.complex64)
        self.other, self.twice = np.full(lanes, _K_OTHER), np.full(lanes, _K_TWICE)
        self.e_two, self.e_one, self.new_one = (np.zeros(lanes, k) for k in (np.uint32, np.uint64, np.uint64))
        self.pair, self.new_pair = self.e_one.view(np.uint32).reshape(lanes, 2), self.new_one.view(np.uint32).reshape(lanes, 2)
        self.state = np.zeros(lanes, np.int64)
        self.state_byte = self.state.view(np.uint8).reshape(lanes, 8)[:, 1]

    def tables(self, t: int) -> Iterator[tuple[slice, np.ndarray]]:
        """Order 0 from the counts of the t ids so far: some blocks, where each id starts for them and the end."""
        size = len(self.freq)
        for a in range(0, self.lanes, PART):
            part = slice(a, min(a + PART, self.lanes))
            n = part.stop - a
            if t:
                new = self.grid[self.counted : t, part] + np.arange(0, n * size, size)
                self.count[part] += np.bincount(new.reshape(-1), minlength=n * size).astype(np.uint16).reshape(n, size)
            starts = np.zeros((n, size + 1), np.uint32)
            share = self.count[part] * _K_STEP
            share += self.freq
            np.cumsum(share, axis=1, dtype=np.uint32, out=starts[:, 1:])
            yield part, starts
        self.counted, self.total = t, TOTAL + STEP * t

    def rebuild(self, t: int) -> None:
        """What ``search`` needs: rows of a block's starts, coarser ones of every 16th and so on up to one row a block."""
        if not t:
            self.cum = _lines((self.segments, self.lanes, 16))
        for part, starts in self.tables(t):
            self.cum[:, part, :SEGMENT] = starts[:, :-1].reshape(len(starts), -1, SEGMENT).swapaxes(0, 1)
            self.cum[:, part, SEGMENT] = starts[:, SEGMENT::SEGMENT].T
        self.levels = [self.cum]
        while len(self.levels[0]) > 1:
            below = self.levels[0]
            level = _lines((-(-len(below) // 16), self.lanes, 16))
            level[-1] = 0xFFFFFFFF
            for i in range(len(below)):
                level[i // 16, :, i % 16] = below[i, :, 0]
            self.levels.insert(0, level)

    def address(self, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the slots of orders 2 and 1 after two ids, and the tag; for one place or many."""
        h = last * _K_LAST
        h ^= before * _K_BEFORE
        h *= _K_SPREAD
        two = h >> _K_SLOT
        two *= self.row
        two += self.lane32
        one = last & _K_SLOTS
        one *= self.row
        one += self.lane32
        h *= _K_TAG
        return two.astype(np.int64), one.astype(np.int64), h

    def predict(self, at_two: np.ndarray, at_one: np.ndarray, tag: np.ndarray) -> None:
        """Fill ``named``, ``share`` and ``upto`` (masses up to the id named first, second, third)."""
        named, share, both, sums = self.named, self.share, self.both, self.sums
        e_two = self.two.take(at_two, mode="clip", out=self.e_two)
        self.one.take(at_one, mode="clip", out=self.e_one)
        times = e_two ^ tag  # below 4 where the tag fits
        np.minimum(times, self.other, out=times)
        times &= _K_TIMES
        self.times = times
        np.bitwise_and(e_two, _K_LOW, out=named[0])
        np.bitwise_and(self.pair[:, 0], _K_LOW, out=named[1])
        np.right_shift(self.pair[:, 0], _K16, out=named[2])
        self.state[:] = self.pair[:, 1]
        at = _TRUST.take(self.state, mode="clip")
        at += times
        at += self.lane32
        self.at_w = at = at.astype(np.int64)
        self.weight.take(at, mode="clip", out=self.two_weights)
        weights = self.weights
        weights[0], weights[1] = self.two_weights.real, self.two_weights.imag
        _SHARE_A.take(self.state, mode="clip", out=share[1])
        _SHARE_B.take(self.state, mode="clip", out=share[2])
        share[1:] *= weights[1]
        share[0] = weights[0]
        # An id that both orders name has the mass of both, as order 2's.
        np.multiply(share[1:], named[1:3] == named[0], out=both)
        np.add(both[0], both[1], out=sums[0])
        sums[0] += weights[0]
        np.subtract(share[1:], both, out=sums[1:])
        sums[1] += sums[0]
        sums[2] += sums[1]
        sums *= _SCALE
        self.upto[1:4] = sums.astype(np.int32)

    def learn(self, x: np.ndarray, usual: np.ndarray, is_named: np.ndarray, tag: np.ndarray, at_two: np.ndarray, at_one: np.ndarray) -> None:
        """x: the ids (uint32) that came; usual: their starting shares of order 0; where x is the first, second, third one named."""
        share, weights, came, times, named = self.share, self.weights, self.came, self.times, self.named
        right = np.multiply(share, is_named, out=self.sums)
        came[0] = right[0]
        np.add(right[1], right[2], out=came[1])
        rate = _OVER - weights[0]
        rate -= weights[1]
        rate *= usual
        rate += came[0]
        rate += came[1]
        np.divide(RATE, rate, out=rate)
        weights *= _KEEP
        came *= rate
        weights += came
        self.two_weights.real, self.two_weights.imag = weights
        self.weight[self.at_w] = self.two_weights
        is_named = is_named.view(np.uint8)
        kind = is_named[2] + is_named[2]
        np.add(kind, is_named[1], out=self.state_byte)
        second, first = named[2] ^ x, named[1]
        second &= _MISS.take(self.state, mode="clip")
        second ^= named[2]
        turn = first ^ second
        turn &= _SWAP.take(self.state, mode="clip")
        second ^= turn
        second <<= _K16
        second |= first ^ turn
        self.new_pair[:, 0] = second
        self.new_pair[:, 1] = _AFTER.take(self.state, mode="clip")
        self.one[at_one] = self.new_one
        # One more time where order 2's own context named it (times 1 to 3), else the first time.
        more = np.minimum(times, self.twice)
        more *= is_named[0]
        more *= times < self.other
        more += _K_ONCE
        more |= x
        more |= tag
        self.two[at_two] = more

    def search(self, want: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids whose order-0 intervals hold the wanted places, where these start, and their frequencies."""
        wide, at = np.repeat(want, 16), None
        for level in self.levels:
            if at is None:
                at, line = np.zeros(self.lanes, np.int64), level[0]
            else:
                line = level.reshape(-1, 16).take(at * self.lanes + self.lane, axis=0, mode="clip")
            row, line = at, line.reshape(-1)
            part = np.bitwise_count(np.packbits(line <= wide).view(np.uint16)) - np.uint8(1)
            at = (row << 4) + part
        place = (self.lane << 4) + part
        start = line.take(place, mode="clip")
        place += 1
        return (row * SEGMENT + part).astype(np.uint32), start, line.take(place, mode="clip") - start


def _carry(word: np.ndarray) -> np.ndarray:
    """Words of 16 bits from words of 17, whose top bit counts in the word before."""
    over = np.flatnonzero(word >> _K16)
    while len(over):
        word[over] &= _K_LOW
        over = over[over > 0] - 1
        word[over] += np.uint32(1)
        over = over[word[over] > _K_LOW]
    return word.astype(np.uint16)


def encode_blocks(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids: uint16, all in the table. Words of each block, CRC of each, all words in order."""
    n = len(ids)
    lanes = -(-n // BLOCK)
    rank = np.zeros(1 << 16, np.uint16)
    rank[table[0]] = np.arange(len(table[0]))
    grid = np.zeros(lanes * BLOCK, np.uint16)
    grid[:n] = rank[ids]
    grid = _turned(grid.reshape(lanes, BLOCK))
    tail = n - (lanes - 1) * BLOCK
    model = _Model(grid, table[1])
    low, rng, end = np.zeros(lanes, np.uint64), np.full(lanes, _WHOLE), None
    upto, place, then = model.upto.reshape(-1), np.empty(lanes, np.int64), 0
    out_lane, out_word = [], []
    for t in range(BLOCK):
        if t == tail:  # the last block is over; what follows of it is padding
            if lanes == 1:
                break
            end = low[-1]
        if t == then:
            first, then = t, min([BLOCK, *(r for r in REBUILD if r > t)])
            zero_start, zero_share = np.empty((2, then - t, lanes), np.uint32)
            for part, starts in model.tables(t):
                at = grid[t:then, part] + np.arange(0, starts.size, starts.shape[1])
                starts = starts.reshape(-1)
                zero_start[:, part] = start = starts.take(at)
                at += 1
                np.subtract(starts.take(at), start, out=zero_share[:, part])
        if not t % AHEAD:  # what depends on the ids alone
            x_ahead = np.zeros((min(AHEAD, BLOCK - t) + 2, lanes), np.uint32)
            have = min(t, 2)
            x_ahead[2 - have :] = grid[t - have : t + AHEAD]
            two_ahead, one_ahead, tag_ahead = model.address(x_ahead[1:-1], x_ahead[:-2])
            usual_ahead = model.usual.take(x_ahead[2:])
        i = t % AHEAD
        x, at_two, at_one, tag = x_ahead[i + 2], two_ahead[i], one_ahead[i], tag_ahead[i]
        model.predict(at_two, at_one, tag)
        is_named = model.named[:3] == x
        is_other = ~is_named
        is_other |= model.upto[1:4] == model.upto[:3]
        is_other[1] &= is_other[0]
        is_other[2] &= is_other[1]
        kind = is_other.view(np.uint8)
        place[:] = kind[0] + kind[1] + kind[2]
        place *= lanes
        place += model.lane
        start = upto.take(place, mode="clip")
        place += lanes
        share = upto.take(place, mode="clip")
        share -= start
        unit = rng >> _16
        low += unit * start.view(np.uint64)
        np.multiply(unit, share.view(np.uint64), out=rng)
        unit = rng // _U(model.total)
        low += unit * (zero_start[t - first] * is_other[2])
        unit *= zero_share[t - first]
        np.putmask(rng, is_other[2], unit)
        idx = (rng < _LEAST).nonzero()[0]
        while len(idx):
            a, b = low.take(idx), rng.take(idx) << _16
            gone = idx if t < tail or idx[-1] < lanes - 1 else idx[:-1]
            out_lane.append(gone.astype(np.uint16))
            out_word.append((a[: len(gone)] >> _46).astype(np.uint32))
            a &= _BELOW
            low[idx], rng[idx] = a << _16, b
            idx = idx[b < _LEAST]
        model.learn(x, usual_ahead[i], is_named, tag, at_two, at_one)
    del model, upto, zero_start, zero_share, x_ahead, two_ahead, one_ahead, tag_ahead, usual_ahead
    # Two words name a number in the range, whatever follows them.
    if end is not None:
        low[-1] = end
    low = (low + _U((1 << 30) - 1) >> _30) << _30
    for a in (low, (low & _BELOW) << _16):
        out_lane.append(np.arange(lanes, dtype=np.uint16))
        out_word.append((a >> _46).astype(np.uint32))
    lane, word = np.concatenate(out_lane), np.concatenate(out_word)
    raw = ids.astype("<u2")
    crc = np.array([zlib.crc32(raw[i : i + BLOCK]) for i in range(0, n, BLOCK)], np.uint32)
    return np.bincount(lane, minlength=lanes).astype(np.uint32), crc, _carry(word[np.argsort(lane, kind="stable")])


def decode_blocks(n: int, table: tuple[np.ndarray, np.ndarray], words: np.ndarray, crc: np.ndarray, payload: np.ndarray) -> np.ndarray:
    """The n ids of blocks that all but the last are full; ValueError if a block's checksum differs."""
    lanes = len(words)
    tail = n - (lanes - 1) * BLOCK
    grid = np.zeros((BLOCK, lanes), np.uint16)
    model = _Model(grid, table[1])
    data = np.concatenate([payload, np.zeros(8, np.uint16)]).astype(np.uint16)
    pos = np.cumsum(words, dtype=np.int64) - words
    # The number less the range's lower end; its window of 62 bits ends two bits before a word does.
    code = np.zeros(lanes, np.uint64)
    for i in range(3):
        code = code << _16 | data[pos + i]
    code = code << _U(14) | data[pos + 3] >> np.uint16(2)
    pos += 3
    data[:-1] = data[:-1] << np.uint16(14) | data[1:] >> np.uint16(2)
    rng, unit = np.full(lanes, _WHOLE), np.empty(lanes, np.uint64)
    cuts, place = np.zeros((5, lanes), np.uint64), np.empty(lanes, np.int64)
    flat, named = cuts.reshape(-1), model.named.reshape(-1)
    upto = model.upto.view(np.uint64)
    last, before = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
    for t in range(tail if lanes == 1 else BLOCK):
        if not t or t in REBUILD:
            model.rebuild(t)
        at_two, at_one, tag = model.address(last, before)
        model.predict(at_two, at_one, tag)
        np.right_shift(rng, _16, out=unit)
        np.multiply(upto[1:], unit, out=cuts[1:])
        over = cuts[1:4] <= code
        kind = over.view(np.uint8)
        place[:] = kind[0] + kind[1] + kind[2]
        place *= lanes
        place += model.lane
        x = named.take(place, mode="clip")
        start = flat.take(place, mode="clip")
        place += lanes
        flat.take(place, mode="clip", out=rng)
        rng -= start
        code -= start
        np.floor_divide(rng, _U(model.total), out=unit)
        want = code // unit
        new, start, share = model.search(np.minimum(want, _U(model.total - 1)).astype(np.uint32))
        code -= unit * (start * over[2])
        unit *= share
        np.putmask(rng, over[2], unit)
        np.putmask(x, over[2], new)
        idx = (rng < _LEAST).nonzero()[0]
        while len(idx):
            at, b = pos.take(idx), rng.take(idx) << _16
            a = code.take(idx) << _16
            a |= data.take(at, mode="clip").astype(np.uint64)
            code[idx] = a
            at += 1
            pos[idx], rng[idx] = at, b
            idx = idx[b < _LEAST]
        model.learn(x, model.usual.take(x, mode="clip"), model.named[:3] == x, tag, at_two, at_one)
        grid[t] = x
        last, before = x, last
    ids = table[0].take(np.concatenate([_turned(grid[:, a : a + 64]) for a in range(0, lanes, 64)]).reshape(-1)[:n])
    raw = ids.astype("<u2")
    for i, want in enumerate(crc):
        if zlib.crc32(raw[i * BLOCK : (i + 1) * BLOCK]) != want:
            raise ValueError(f"checksum of block {i} differs")
    return ids
