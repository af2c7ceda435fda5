"""Token ids in blocks, each coded by itself with an adaptive context-mixing range coder.

A file holds a number of blocks of `steps` ids. Its header is the state that every block starts from: the file's ids by falling
frequency (an id's rank), how often each occurs, and which rank most often follows each of the first GRID ranks. A block is decoded from
the header and its own digits, without other blocks; all blocks of a file are coded side by side, one id of each in a numpy step.
Integers and exact quotients only: an encoder and a decoder anywhere agree.

Prediction of an id: order 2 and order 1 each remember, by context, the id that followed last and how often that held (order 1 starts
from the header's followers). The confidence of each has a weight learnt in the block (order 1's also by whether the two agree),
and the weights add up in the logistic domain to the probability that the candidate is the id. If it isn't, order 0 codes the id:
each of the first OWN ranks is a symbol by itself, later ranks form symbols of 2**k neighbours of equal shares. The symbols'
frequencies start as the file's and are learnt in the block: after FIRST ids and whenever twice as many ids are
behind, they become the file's shares, weighing PRIOR ids, and the block's own counts together.

Memories and weights learn at the end of every EVERY ids, so that an encoder knows a run's predictions at once and a decoder's
step only reads. Candidates are among the first 2**14 ranks.

The range coder keeps 52 bits and gives digits of 16. An id is one share of 2**PARTS parts: 16 bits for the candidate, 14 for order 0's
symbol. A carry stays in its digit and is settled at the end.

File: MAGIC, length and crc32 of the header, header (zstd of JSON and arrays: steps, ids, frequencies, followers, keys and lengths of
texts, whether the last text goes on in the next file, and for each block its digits, ids, the crc32 of its ids and of its digits), then the
blocks' digits. Keys are kept as text. A file holds any number of blocks and at most 2**18 - 1 distinct ids.

Cases: no ids: a file without blocks. A cut or changed file is an error that names the block or the header.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import zstandard as zstd

MAGIC = b"TWIDS\x03"
STEPS, LEAST_STEPS, SIDE = 2048, 512, 512  # ids of a block; of a small file's blocks at least; blocks wanted for a numpy step
OWN, GROUPS = 1024, 255  # symbols of order 0: single ranks, and groups of ranks
GRID = 1024  # ranks with a follower in the header
EVERY = 128  # ids of a block between two lessons; the first ones are shorter
FIRST, PRIOR = 256, 2048
SLOTS = 12  # bits of an order's memory in a block
SOME = 256  # blocks that learn at a time, so that less of what they remember leaves the processor's cache
TOTAL, PARTS = 14, 30  # bits of order 0's frequencies, and of all shares
_SHIFT = 36
_TOP, _FULL = np.int64(1) << 52, np.int64(1) << _SHIFT
_LOW = _FULL - 1

#: 65536ths by log odds in 256ths; what is left for other ids can be cut in 2**10 parts.
_SQUASH = 16 * np.clip(np.round(4096 / (1 + np.exp(-np.arange(-2048, 2048) / 256.0))), 16, 4032).astype(np.int64)
#: Log odds that blocks start from, by confidence.
_START2 = np.array([-300, 100, 300, 500], np.int32)
_START1 = np.array([[-700, -700], [-300, 0], [-150, 150], [0, 300]], np.int32)


class Start:
    """The state that every block of a file starts from."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, follow: np.ndarray):
        self.ids, self.counts, self.follow = ids, counts, follow
        n = len(ids)
        self.single = min(n, OWN)
        self.bits = max(0, int(np.ceil(np.log2(max(1, (n - self.single) / GROUPS)))))
        ranks = np.arange(n)
        self.symbol = np.where(ranks < self.single, ranks, self.single + ((ranks - self.single) >> self.bits)).astype(np.int32)
        self.symbols = int(self.symbol[-1]) + 1 if n else 1
        # what a symbol's first rank is, and how many even bits follow it
        self.lead = np.concatenate([np.arange(self.single), self.single + (np.arange(self.symbols - self.single) << self.bits)]).astype(np.int64)
        self.tail = np.where(np.arange(self.symbols) < self.single, 0, self.bits).astype(np.int64)
        prior = np.zeros(self.symbols, np.int64)
        np.add.at(prior, self.symbol, counts.astype(np.int64))
        # in 256ths of an id: whole numbers on every machine
        self.prior = (prior * (256 * PRIOR) // max(1, int(prior.sum())) + 1).astype(np.int32)


class Model:
    """What the blocks remember, one lane each."""

    def __init__(self, lanes: int, start: Start):
        base = np.arange(lanes, dtype=np.int64)
        first = np.zeros(1 << SLOTS, np.uint16)  # rank * 4 + confidence
        known = np.flatnonzero(start.follow >= 0)
        first[known] = (start.follow[known] << 2) | 1
        self.near, self.far = np.tile(first, lanes), np.zeros(lanes << SLOTS, np.uint16)
        self.by1, self.by2 = np.tile(_START1, (lanes, 1, 1)), np.tile(_START2, (lanes, 1))
        self.of, self.of_cell = base << SLOTS, base << 5
        self.start, self.lanes = start, lanes
        self.row = base * start.symbols
        self.fresh: list[np.ndarray] = []
        self.weight = start.prior[None]  # all lanes start alike
        self.mix()
        self.size, share = self.shares(self.weight)
        self.share = np.tile(share, (lanes, 1)).ravel()

    def mix(self) -> None:
        """The candidate's probability for each confidence of order 2, of order 1, and whether they agree."""
        odds = self.by2[:, :, None, None] + self.by1[:, None, :, :] + 2048
        self.chance = _SQUASH.take(odds.ravel(), mode="clip")

    def shares(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each symbol's share of 2**TOTAL in every lane: its size, and start * 2**15 + size; none is empty."""
        n = self.start.symbols
        upto = np.cumsum(weight, axis=1, dtype=np.float64)
        whole = upto[:, -1:].copy()
        upto *= (1 << TOTAL) - n
        upto /= whole
        edge = np.zeros((len(upto), n + 1), np.int32)
        edge[:, 1:] = upto
        edge[:, 1:] += np.arange(1, n + 1, dtype=np.int32)
        size = np.diff(edge, axis=1)
        return size, (edge[:, :-1] << 15) | size

    def frequencies(self) -> None:
        """Takes in the symbols since the last time, of some lanes at a time."""
        if len(self.weight) < self.lanes:
            self.weight = np.tile(self.weight, (self.lanes, 1))
        share, sizes = self.share.reshape(self.lanes, -1), np.empty_like(self.weight)
        for a in range(0, self.lanes, SOME):
            weight = self.weight[a : a + SOME]
            at = np.concatenate([(f[a : a + SOME] + self.row[: len(weight), None]).ravel("K") for f in self.fresh])
            count = np.bincount(at, minlength=weight.size).reshape(weight.shape)
            count *= 256
            weight += count
            sizes[a : a + SOME], share[a : a + SOME] = self.shares(weight)
        self.size, self.fresh = sizes, []

    def predict(self, one: np.ndarray, mixed: np.ndarray, chance: np.ndarray | None = None, into: tuple[np.ndarray | None, ...] = (None,) * 6) -> tuple[np.ndarray, ...]:
        """The candidate after `one` and its probability, and what led to them; `mixed` stands for the last two ids. One step, or
        lanes x steps: then a lane's memory stays in the processor's cache. chance: the probabilities in another type; into: arrays for what a
        lesson needs."""
        of, of_cell = (self.of, self.of_cell) if one.ndim == 1 else (self.of[:, None], self.of_cell[:, None])
        best, r, i1, i2, e1, e2 = into
        i1 = np.bitwise_and(one, (1 << SLOTS) - 1, out=i1)
        i1 += of
        i2 = np.bitwise_and(mixed, (1 << SLOTS) - 1, out=i2)
        i2 += of
        e1, e2 = self.near.take(i1, mode="clip", out=e1), self.far.take(i2, mode="clip", out=e2)
        c1 = e1 >> 2
        only1 = (e2 == 0).astype(np.uint16)
        only1 *= c1
        best = np.right_shift(e2, 2, out=best)
        best |= only1  # order 2's if it remembers one: an empty slot is 0
        cell = e2 & 3
        cell <<= 2
        e1_ = e1 & 3
        cell |= e1_
        cell <<= 1
        cell |= c1 == best
        r = np.add(of_cell, cell, out=r)
        return best, (self.chance if chance is None else chance).take(r, mode="clip"), r, i1, i2, e1, e2

    def run(self, ranks: np.ndarray, a: int, b: int) -> tuple[np.ndarray, ...]:
        """Predictions for columns a to b of ranks, which begin with two zeros."""
        one = ranks[:, a + 1 : b + 1].astype(np.int64)
        mixed = one * 40503
        mixed += ranks[:, a:b] * np.int64(60493)
        mixed >>= 3
        return self.predict(one, mixed)

    def learn(self, x: np.ndarray, seen: tuple[np.ndarray, ...], done: int) -> None:
        """Takes in a run of ids (lanes x steps) with their predictions, of some lanes at a time; `done` ids are then behind. Of two lessons for a
        slot the later counts."""
        for a in range(0, self.lanes, SOME):
            self._learn(a, x[a : a + SOME], *(s[a : a + SOME] for s in seen))
        self.mix()
        self.fresh.append(self.start.symbol.take(x.T).T)
        if done >= FIRST and done & (done - 1) == 0:
            self.frequencies()

    def _learn(self, a: int, x: np.ndarray, best: np.ndarray, r: np.ndarray, i1: np.ndarray, i2: np.ndarray, e1: np.ndarray, e2: np.ndarray) -> None:
        """The lanes from a on learn."""
        lanes = len(x)
        x = np.minimum(x, 0xFFFF).astype(np.uint16)  # no candidate's rank is that high
        at = r - (a << 5)
        at <<= 1
        at |= best == x
        told = np.bincount(at.ravel("K"), minlength=lanes << 6).reshape(-1, 2)  # misses and hits
        n = told.sum(axis=1)
        off = (told[:, 1] * 65536 - n * self.chance[a << 5 : (a + lanes) << 5]).astype(np.float64)
        n, off = n.reshape(lanes, 4, 4, 2), off.reshape(lanes, 4, 4, 2)
        for by, axes in ((self.by1[a : a + lanes], 1), (self.by2[a : a + lanes], (2, 3))):
            by += np.trunc(off.sum(axes) / (512 * np.maximum(1.0, n.sum(axes) / 8))).astype(np.int32)
            np.clip(by, -1800, 1800, out=by)
        fresh = x << 2
        fresh |= 1
        many = self.start.ids.size >> 14
        seldom = x >= 1 << 14 if many else None
        for slots, i, e in ((self.near, i1, e1), (self.far, i2, e2)):
            same = (e >> 2) == x
            same &= e > 0
            more = e | 3
            more -= 1
            np.minimum(more, e, out=more)
            more += 1  # one more, 3 at most
            more ^= fresh
            more *= same
            more ^= fresh
            more = np.where(seldom, e, more) if many else more
            slots[np.ascontiguousarray(i.T)] = more.T


def _runs(steps: int) -> Iterator[tuple[int, int]]:
    """The steps between lessons."""
    a, size = 0, EVERY // 4
    while a < steps:
        yield a, min(a + size, steps)
        a += size
        size = min(EVERY, a)


def _encode(ranks: np.ndarray, start: Start) -> tuple[np.ndarray, np.ndarray]:
    """Digits of all lanes of ranks (lanes x steps) one after another, and how many each has."""
    lanes, steps = ranks.shape
    los, sizes = np.empty((steps, lanes), np.int32), np.empty((steps, lanes), np.int32)  # each id's share, of 2**PARTS
    for l in range(0, lanes, SOME):
        some = ranks[l : l + SOME]
        model = Model(len(some), start)
        before = np.concatenate([np.zeros((len(some), 2), np.int32), some], axis=1)
        for a, b in _runs(steps):
            x = some[:, a:b].astype(np.int64)
            best, p, *seen = model.run(before, a, b)
            miss = (best != x).astype(np.int64)
            symbol = start.symbol.take(x)
            share = model.share.take(symbol + model.row[:, None]).astype(np.int64)
            lo, size = share >> 15, share & 0x7FFF
            left = 65536 - p
            lo *= left
            size *= left
            if start.bits:
                tail, value = start.tail.take(symbol), x - start.lead.take(symbol)
                within = (size * value) >> tail
                size = ((size * (value + 1)) >> tail) - within
                lo += within
            edge = p << TOTAL
            lo += edge
            lo *= miss
            size -= edge
            size *= miss
            size += edge
            los[a:b, l : l + SOME], sizes[a:b, l : l + SOME] = lo.T, size.T
            if b < steps:
                model.learn(x, (best, *seen), b)
    low, width = np.zeros(lanes, np.int64), np.full(lanes, _TOP)
    kind = np.uint16 if lanes <= 1 << 16 else np.uint32
    of, digits = [], []
    for a in range(0, steps, EVERY):
        for lo, size in zip(los[a : a + EVERY].astype(np.int64), sizes[a : a + EVERY].astype(np.int64), strict=True):
            width >>= PARTS
            lo *= width
            low += lo
            width *= size
            at = (width < _FULL).nonzero()[0]
            while len(at):
                top = low[at]
                of.append(at.astype(kind))
                digits.append((top >> _SHIFT).astype(np.uint32))
                top &= _LOW
                top <<= 16
                low[at] = top
                wide = width[at] << 16
                width[at] = wide
                at = at[wide < _FULL]
    del los, sizes
    every = np.arange(lanes)
    for _ in range(4):
        of.append(every.astype(kind))
        digits.append((low >> _SHIFT).astype(np.uint32))
        low = (low & _LOW) << 16
    lane, digit = np.concatenate(of), np.concatenate(digits)
    del of, digits
    order = np.argsort(lane, kind="stable")
    count = np.bincount(lane, minlength=lanes)
    digit = digit[order]
    while len(over := np.flatnonzero(digit >> 16)):  # a carry moves one digit up; it never leaves its lane
        carry = digit[over] >> 16
        digit[over] &= 0xFFFF
        np.add.at(digit, over - 1, carry)
    return digit.astype("<u2"), count


def _slots(model: Model, into: np.ndarray | None) -> np.ndarray:
    """The symbol at each of a lane's 2**TOTAL places; `into`: the table of the frequencies before, which is written over."""
    symbols = np.arange(model.start.symbols, dtype=np.int16)
    if into is None:
        return np.tile(symbols.repeat(model.size[0]), (model.lanes, 1))  # all lanes start alike
    for a in range(0, model.lanes, SOME):
        for row, size in zip(into[a : a + SOME], model.size[a : a + SOME].astype(np.int64), strict=True):
            row[:] = symbols.repeat(size)
    return into


def _decode(digits: np.ndarray, counts: np.ndarray, steps: int, start: Start) -> np.ndarray:
    """The ranks (lanes x steps) again. Code, width and shares are whole numbers below 2**53 in doubles, and quotients stay below 2**31, so both are
    exact once cut. A step's cost is that of its numpy calls: nothing is chosen by a mask element by element, and no call mixes types."""
    lanes = len(counts)
    model = Model(lanes, start)
    digits = np.concatenate([digits, np.zeros(8, digits.dtype)]).astype(np.int32)
    next_ = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    code = np.zeros(lanes, np.int64)
    for _ in range(3):
        code = (code << 16) | digits[next_]
        next_ += 1
    code = ((code << 4) | (digits[next_] >> 12)).astype(np.float64)
    width = np.full(lanes, float(_TOP))
    digits[:-1] = ((digits[:-1] & 0xFFF) << 4) | (digits[1:] >> 12)  # 52 bits end within a digit: from here on in steps of 16 after them
    digits = digits.astype(np.float64)
    out = np.zeros((lanes, steps), np.int32)
    slot_row, lane = np.arange(lanes, dtype=np.int64) << TOTAL, np.arange(lanes, dtype=np.int64)
    full, unit, group, lead = float(_FULL), 2.0**-PARTS, float(1 << start.bits), start.lead
    slots = held = None
    one, last, mixed = (np.zeros(lanes, np.int64) for _ in range(3))
    # what a miss and a hit give, one after the other
    lows, sizes, ids = np.zeros(2 * lanes), np.zeros(2 * lanes), np.zeros(2 * lanes, np.int64)
    lo, size, x, edge, best_ = lows[:lanes], sizes[:lanes], ids[:lanes], sizes[lanes:], ids[lanes:]
    part, v, left, top, digit, kept = (np.zeros(lanes) for _ in range(6))
    new = np.zeros((EVERY, lanes), np.int64)
    seen = tuple(np.zeros((EVERY, lanes), t) for t in (np.uint16, np.int64, np.int64, np.int64, np.uint16, np.uint16))
    for a, b in _runs(steps):
        if held is not model.size:
            held = model.size
            slots = _slots(model, slots)
        chance, flat = model.chance.astype(np.float64), slots.ravel()
        for k in range(b - a):
            np.multiply(one, 40503, out=mixed)
            mixed += last
            mixed >>= 3
            np.multiply(one, 60493, out=last)
            best, p = model.predict(one, mixed, chance, tuple(s[k] for s in seen))[:2]
            np.multiply(width, unit, out=part)
            np.floor(part, out=part)
            np.divide(code, part, out=v)
            np.floor(v, out=v)
            np.multiply(p, float(1 << TOTAL), out=edge)
            hit = v < edge
            v -= edge
            np.subtract(65536.0, p, out=left)
            slot = (v / left).astype(np.int64)
            slot += slot_row
            symbol = flat.take(slot, mode="clip")
            x[:] = symbol  # a single rank's own number
            share = model.share.take(model.row + x, mode="clip")
            lo[:] = share >> 15
            lo *= left
            share &= 0x7FFF
            size[:] = share
            size *= left
            if start.bits and len(at := (symbol >= start.single).nonzero()[0]):  # the rank within a group
                within, below = size.take(at), lo.take(at)
                value = v.take(at)
                value -= below
                value += 1
                value *= group
                value -= 1
                value /= within
                np.floor(value, out=value)
                x[at] = lead.take(symbol.take(at)) + value.astype(np.int64)
                value *= within
                within += value
                value /= group
                np.floor(value, out=value)
                within /= group
                np.floor(within, out=within)
                within -= value
                size[at] = within
                below += value
                lo[at] = below
            lo += edge
            best_[:] = best
            pick = hit.astype(np.int64)
            pick *= lanes
            pick += lane
            one = ids.take(pick, mode="clip", out=new[k])
            lows.take(pick, mode="clip", out=kept)
            kept *= part
            code -= kept
            sizes.take(pick, mode="clip", out=width)
            width *= part
            short = (width < full).astype(np.float64)
            np.multiply(short, 65535.0, out=top)
            top += 1
            width *= top
            code *= top
            digits.take(next_, mode="clip", out=digit)
            digit *= short
            code += digit
            next_ += short.astype(np.int64)
            at = (width < full).nonzero()[0]
            while len(at):
                where = next_[at]
                code[at] = code[at] * 65536 + digits.take(where, mode="clip")
                next_[at] = where + 1
                wide = width[at] * 65536
                width[at] = wide
                at = at[wide < full]
        met = new[: b - a]
        out[:, a:b] = met.T
        if b < steps:
            model.learn(met.T, tuple(s[: b - a].T for s in seen), b)
            one = one.copy()  # its place is written over
    return out


def _begin(ids: np.ndarray) -> tuple[Start, np.ndarray]:
    """The starting state for ids, and their ranks."""
    most = int(ids.max(initial=0))
    if most < 1 << 22:
        count = np.bincount(ids, minlength=1)
        found = np.flatnonzero(count)
        count = count[found]
    else:
        found, count = np.unique(ids, return_counts=True)
    order = np.lexsort((found, -count))
    found, count = found[order], count[order]
    if most < 1 << 22:
        rank_of = np.zeros(most + 1, np.int32)
        rank_of[found] = np.arange(len(found))
        ranks = rank_of[ids]
    else:
        by_id = np.argsort(found)
        ranks = by_id[np.searchsorted(found[by_id], ids)].astype(np.int32)
    side = min(GRID, max(1, len(found)))
    a, b = ranks[:-1], ranks[1:]
    both = np.minimum(a, side).astype(np.int64) * (side + 1)
    both += np.minimum(b, side)
    pairs = np.bincount(both, minlength=(side + 1) ** 2).reshape(side + 1, side + 1)[:side, :side]
    follow = np.where(pairs.max(axis=1) > 0, pairs.argmax(axis=1), -1).astype(np.int32)
    return Start(found.astype(np.int64), count.astype(np.int64), follow), ranks


def pack(ids: np.ndarray, lengths: list[int], keys: list[str | None], steps: int = STEPS, goes_on: bool = False) -> bytes:
    """A file of the texts' ids, one after another; goes_on: the last text has more ids in the next file."""
    ids = np.ascontiguousarray(ids, "<u4")
    n = len(ids)
    steps = max(1, min(steps, max(LEAST_STEPS, -(-n // SIDE)), n))
    lanes = -(-n // steps)
    start, ranks = _begin(ids)
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ranks
    digits, counts = _encode(grid.reshape(lanes, steps), start) if n else (np.zeros(0, "<u2"), np.zeros(0, np.int64))
    ends = np.cumsum(counts)
    blocks = [[int(counts[i]), len(b := ids[i * steps : (i + 1) * steps]), zlib.crc32(b.tobytes()), zlib.crc32(digits[ends[i] - counts[i] : ends[i]].tobytes())] for i in range(lanes)]
    by_id = np.argsort(start.ids, kind="stable")
    arrays = [np.diff(start.ids[by_id], prepend=0).astype("<u4"), start.counts[by_id].astype("<u4"), start.follow.astype("<i2")]
    about = json.dumps({"steps": steps, "distinct": len(start.ids), "follow": len(start.follow), "keys": keys, "lengths": lengths, "goes_on": goes_on, "blocks": blocks}).encode()
    head = zstd.compress(struct.pack("<I", len(about)) + about + b"".join(x.tobytes() for x in arrays))
    return MAGIC + struct.pack("<II", len(head), zlib.crc32(head)) + head + digits.tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, list[int], list[str | None], bool]:
    """ids, lengths, keys, and whether the last text goes on; a block whose ids differ from its checksum is an error."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a file of ids")
    at = len(MAGIC) + 8
    size, crc = struct.unpack("<II", data[len(MAGIC) : at])
    head = data[at : at + size]
    if zlib.crc32(head) != crc:
        raise ValueError("the header differs from its checksum")
    head = zstd.decompress(head)
    n_about = struct.unpack_from("<I", head)[0]
    h = json.loads(head[4 : 4 + n_about])
    m, k = h["distinct"], 4 + n_about
    found = np.cumsum(np.frombuffer(head, "<u4", m, k).astype(np.int64))
    count = np.frombuffer(head, "<u4", m, k + 4 * m).astype(np.int64)
    order = np.lexsort((found, -count))
    start = Start(found[order], count[order], np.frombuffer(head, "<i2", h["follow"], k + 8 * m).astype(np.int32))
    digits, counts = np.frombuffer(data, "<u2", offset=at + size), np.array([b[0] for b in h["blocks"]], np.int64)
    if len(digits) < counts.sum():
        raise ValueError("cut short")
    at = 0
    for i, b in enumerate(h["blocks"]):
        if zlib.crc32(digits[at : at + b[0]].tobytes()) != b[3]:
            raise ValueError(f"block {i} differs from its checksum")
        at += b[0]
    if not len(counts):
        return np.zeros(0, "<u4"), h["lengths"], h["keys"], h["goes_on"]
    got = _decode(digits, counts, h["steps"], start)
    ranks = got.ravel()[: sum(b[1] for b in h["blocks"])]  # only the last block may be shorter
    ids = np.take(start.ids, ranks, mode="clip").astype("<u4")
    at = 0
    for i, b in enumerate(h["blocks"]):
        if zlib.crc32(ids[at : at + b[1]].tobytes()) != b[2]:
            raise ValueError(f"block {i} differs from its checksum")
        at += b[1]
    return ids, h["lengths"], h["keys"], h["goes_on"]
