"""An adaptive context-mixing range coder for token ids.

Ids are cut into blocks of ``BLOCK``; each block starts from an empty model, so that it can be decoded alone with the
segment's head, and has a checksum. Three models predict the next id: order 2 and order 1 name the id that last followed
the same two or one ids (hashed contexts), with a confidence; order 0 is the distribution of the block's last ``HISTORY``
ids, taken anew at each of ``RENEWED``, added to ``PRIOR`` slots that the head deals to ids by their counts in the segment.
Their shares are mixed by adaptive weights, one pair for each state of the two confidences, which learn from every id, and
the mixed distribution drives one arithmetic coding step. An id that order 0 gives nothing is escaped and sent as its
number in the segment's alphabet.

All blocks of a segment (or, with a large alphabet, groups of them) are coded in lockstep: a step handles one id of every
block with array operations.

Segment: magic "MXC2", block size, ids, blocks, ids of the alphabet, bytes of its deflated table (alphabet as u32, slots as
u16), that table; for each block its length in 16-bit words and the CRC-32 of its ids as little-endian u32 (u32 each); the
CRC-32 of all that (u32); then the blocks' words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 4096
MAGIC = b"MXC2"
UNIT = 13  # order 0's ids share 2^UNIT units, two a slot at least
PRIOR, HISTORY = 2048, 2048  # slots
RENEWED = (128, 256, 512, 1024, 1536, 2048, 3072)  # ids of a block after which order 0 is taken anew
C1, C2 = 1024, 2048  # contexts of order 1 and 2
ESCAPE = 5  # of the share besides order 1 and 2, 2^-ESCAPE is for ids that order 0 gives nothing
PLACES = 1 << 22  # of the table (block, id) of a group of blocks
MASK, TOP, BOTTOM = (1 << 48) - 1, 1 << 32, 1 << 24
SCALE = 1 << 16
CAP1, CAP2, FLOOR = 16384, 40960, 96  # of SCALE for each id prediction; the rest is order 0's at least
NONE = 1 << 28  # no id

I = np.int64  # noqa: E741


class Model:
    """The state of ``lanes`` blocks at the same position. Ids must be below ``NONE``."""

    def __init__(self, lanes: int) -> None:
        lane = np.arange(lanes, dtype=I)
        self.t1, self.t2 = np.full(lanes * C1, NONE << 2, I), np.full(lanes * C2, NONE << 2, I)  # id << 2 | confidence
        self.w1, self.w2 = np.full(lanes * 32, 2048, I), np.full(lanes * 32, 2048, I)
        self.o1, self.o2, self.ow = lane * C1, lane * C2, lane * 32
        self.i1, self.i2, self.before = self.o1, self.o2, np.zeros(lanes, I)

    def predict(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the first ``n`` lanes: order 2's and order 1's ids and their shares of SCALE."""
        self.i1, self.i2 = self.i1[:n], self.i2[:n]
        e1, e2 = self.t1.take(self.i1), self.t2.take(self.i2)
        self.g1, self.g2 = e1 >> 2, e2 >> 2
        self.k1, self.k2 = e1 & 3, e2 & 3
        s = self.k2 << 2
        s |= self.k1
        s <<= 1
        s += self.g1 == self.g2
        s += self.ow[:n]
        self.s = s
        self.f2, self.f1 = self.w2.take(s), self.w1.take(s)
        return self.g2, self.g1, self.f2, self.f1

    def update(self, n: int, x: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """``hit1`` without the hits of order 2."""
        for w, f, hit, cap in ((self.w2, self.f2, hit2, CAP2), (self.w1, self.f1, hit1, CAP1)):
            step = hit * (cap - FLOOR)
            step += FLOOR
            step -= f
            step >>= 5
            step += f
            w[self.s] = step
        new = x << 2
        new += 1
        np.minimum(self.k1, 2, out=self.k1)
        np.minimum(self.k2, 2, out=self.k2)
        self.k1 *= self.g1 == x
        self.k2 *= hit2
        self.k1 += new
        self.k2 += new
        self.t1[self.i1], self.t2[self.i2] = self.k1, self.k2
        a = x * 40503
        b = self.before[:n] * 3
        b += a
        b >>= 5
        b &= C2 - 1
        b += self.o2[:n]
        self.i2, self.before = b, a
        a = a >> 6
        a &= C1 - 1
        a += self.o1[:n]
        self.i1 = a


class Order0:
    """The slots of each id (by number) in each block: the prior's and those of the block's last ids (steps, lanes)."""

    def __init__(self, prior: np.ndarray, history: np.ndarray) -> None:
        kinds, lanes = len(prior), history.shape[1]
        self.m, self.kinds = int(prior.sum()) + len(history), kinds
        self.base = np.arange(lanes, dtype=I) * (kinds + 1)
        count = np.bincount((history + np.arange(lanes, dtype=I) * kinds).ravel(), minlength=lanes * kinds).reshape(lanes, kinds)
        count += prior
        edge = np.zeros((lanes, kinds + 1), np.int32)  # the first slot of each id, and the end
        np.cumsum(count, axis=1, out=edge[:, 1:])
        self.edge, self.count = edge.ravel(), count.ravel()

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For numbers (..., lanes): first unit and end unit, 2^UNIT and 0 where the id has no slot; and where."""
        at = x + self.base[: x.shape[-1]]
        first = self.edge.take(at)
        at += 1
        end = self.edge.take(at)
        none = first == end
        first = _division(first << UNIT, self.m)
        end = _division(end << UNIT, self.m)
        first[none], end[none] = 1 << UNIT, 0
        return first, end, none

    def slots(self) -> np.ndarray:
        """The number of the id at each slot, block after block."""
        lanes = len(self.base)
        return np.repeat(np.broadcast_to(np.arange(self.kinds, dtype=np.int32), (lanes, self.kinds)).ravel(), self.count)


def _division(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """Floors of a / b; exact in doubles where a < 2^48, b < 2^32 and the quotient is below 2^17."""
    return (a / b).astype(I)


def _interval(a: np.ndarray, end: np.ndarray, escape: np.ndarray, f2: np.ndarray, f1: np.ndarray, hit2: np.ndarray, hit1: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id's part of SCALE: (order 2's id, order 1's id, order 0's ids, escape)."""
    few = rest >> ESCAPE
    ids = rest - few
    start = a * ids
    start >>= UNIT
    size = end * ids
    size >>= UNIT
    size -= start
    np.copyto(size, few, where=escape)
    start += f2
    start += f1
    np.copyto(start, f2, where=hit1)
    np.copyto(size, f1, where=hit1)
    start[hit2] = 0
    np.copyto(size, f2, where=hit2)
    return start, size


class Encoder:
    def __init__(self, lanes: int) -> None:
        self.low, self.rng = np.zeros(lanes, I), np.full(lanes, MASK, I)
        self.width = BLOCK + 16
        self.out = np.zeros(lanes * self.width, np.uint16)
        self.base = np.arange(lanes, dtype=I) * self.width
        self.at = self.base.copy()
        self.room = self.width

    def put(self, lanes: np.ndarray | slice, start: np.ndarray, size: np.ndarray) -> None:
        r = self.rng[lanes] >> 16
        size *= r
        start *= r
        start += self.low[lanes]
        low, rng = start, size
        go = _unsettled(low, rng)
        while len(go):
            lo, ra = low.take(go), rng.take(go)
            if ra.min() < BOTTOM:
                ra = _narrowed(lo, ra)
            self._emit(go if isinstance(lanes, slice) else lanes[go], lo >> 32)
            lo <<= 16
            lo &= MASK
            ra <<= 16
            low[go], rng[go] = lo, ra
            if ra.min() >= TOP:
                break
            go = go[_unsettled(lo, ra)]
        self.low[lanes], self.rng[lanes] = low, rng

    def _emit(self, lanes: np.ndarray, words: np.ndarray) -> None:
        if not self.room:  # as many emissions as a lane has words: look whether one is full
            used = int((self.at - self.base).max())
            if used == self.width:
                wide = np.zeros((len(self.base), 2 * self.width), np.uint16)
                wide[:, : self.width] = self.out.reshape(-1, self.width)
                self.out, self.width = wide.ravel(), 2 * self.width
                base = np.arange(len(self.base), dtype=I) * self.width
                self.at += base - self.base
                self.base = base
            self.room = self.width - used
        self.room -= 1
        at = self.at.take(lanes)
        self.out[at] = words
        at += 1
        self.at[lanes] = at

    def finish(self) -> list[bytes]:
        lanes = np.arange(len(self.low))
        for _ in range(3):
            self._emit(lanes, self.low >> 32)
            self.low = (self.low << 16) & MASK
        return [self.out[b:e].astype("<u2").tobytes() for b, e in zip(self.base.tolist(), self.at.tolist(), strict=True)]


class Decoder:
    def __init__(self, streams: list[np.ndarray]) -> None:
        pad = np.zeros(BLOCK * 4, np.uint16)  # a block's reader may run ahead of its words, never by more
        self.words = np.concatenate([*streams, pad]).astype(I)
        sizes = np.array([len(s) for s in streams], I)
        first = np.cumsum(sizes) - sizes
        self.low, self.rng = np.zeros(len(streams), I), np.full(len(streams), MASK, I)
        w = [self.words[first + i] for i in range(3)]
        self.code, self.at = (w[0] << 32) | (w[1] << 16) | w[2], first + 3

    def value(self, lanes: np.ndarray | slice) -> np.ndarray:
        self.r = self.rng[lanes] >> 16
        code = self.code[lanes] - self.low[lanes]
        code &= MASK
        return np.minimum(_division(code, self.r), SCALE - 1)

    def take(self, lanes: np.ndarray | slice, start: np.ndarray, size: np.ndarray) -> None:
        size *= self.r
        start *= self.r
        start += self.low[lanes]
        low, rng = start, size
        go = _unsettled(low, rng)
        while len(go):
            lo, ra = low.take(go), rng.take(go)
            if ra.min() < BOTTOM:
                ra = _narrowed(lo, ra)
            which = go if isinstance(lanes, slice) else lanes[go]
            at = self.at.take(which)
            code = self.code.take(which)
            code <<= 16
            code &= MASK
            code |= self.words.take(at)
            self.code[which] = code
            at += 1
            self.at[which] = at
            lo <<= 16
            lo &= MASK
            ra <<= 16
            low[go], rng[go] = lo, ra
            if ra.min() >= TOP:
                break
            go = go[_unsettled(lo, ra)]
        self.low[lanes], self.rng[lanes] = low, rng


def _unsettled(low: np.ndarray, rng: np.ndarray) -> np.ndarray:
    """Where a word goes out: its bits are settled, or the range has become too small."""
    top = low + rng
    top ^= low
    need = top < TOP
    if rng.min() < BOTTOM:
        need |= rng < BOTTOM
    return need.nonzero()[0]


def _narrowed(low: np.ndarray, rng: np.ndarray) -> np.ndarray:
    """The ranges, cut at the next boundary where the top word is not settled."""
    return np.where((low ^ (low + rng)) < TOP, rng, -low & (BOTTOM - 1))


def _blocks(n: int) -> tuple[int, int]:
    lanes = max(1, -(-n // BLOCK))
    return lanes, n - (lanes - 1) * BLOCK


def _stages(steps: int) -> list[tuple[int, int]]:
    """(begin, end) of the stretches between renewals of order 0."""
    cuts = [0, *[c for c in RENEWED if c < steps]]
    return list(zip(cuts, [*cuts[1:], steps], strict=True))


def _prior(numbers: np.ndarray, kinds: int) -> np.ndarray:
    """``PRIOR`` slots dealt by counts: whole parts first, then the largest remainders."""
    share = np.bincount(numbers, minlength=kinds).astype(I) * PRIOR
    slots, rest = share // max(len(numbers), 1), share % max(len(numbers), 1)
    slots[np.argsort(-rest, kind="stable")[: PRIOR - int(slots.sum())]] += 1
    return slots.astype(np.int32)


def _alphabet(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur, ascending, and each id's number among them."""
    if not len(ids) or int(ids.max()) >= 1 << 22:
        return np.unique(ids, return_inverse=True)
    there = np.bincount(ids) > 0
    return np.flatnonzero(there), (np.cumsum(there) - 1)[ids]


def _groups(lanes: int, kinds: int) -> list[tuple[int, int]]:
    size = max(1, PLACES // max(kinds, 1))
    return [(i, min(i + size, lanes)) for i in range(0, lanes, size)]


def _digits(kinds: int) -> list[tuple[int, int]]:
    """How an escaped number is sent: (shift, values) of each digit, the high one first."""
    return [(0, kinds)] if kinds <= 1 << 12 else [(8, -(-kinds >> 8)), (0, 256)]


def _encode_lanes(grid: np.ndarray, last: int, prior: np.ndarray) -> list[bytes]:
    """The streams of blocks side by side: numbers (steps, lanes), the last block ending at ``last``."""
    steps, lanes = grid.shape
    model, coder, digits = Model(lanes), Encoder(lanes), _digits(len(prior))
    for begin, end in _stages(steps if lanes > 1 else last):
        order0 = Order0(prior, grid[max(0, begin - HISTORY) : begin])
        for t in range(begin, end):
            k = (t - begin) % 64
            if not k:
                starts, ends, unseen = order0.find(grid[t : min(t + 64, end)])
            m = lanes if t < last else lanes - 1
            x, escape = grid[t, :m].astype(I), unseen[k, :m]
            g2, g1, f2, f1 = model.predict(m)
            hit2 = g2 == x
            hit1 = (g1 == x) & ~hit2
            start, size = _interval(starts[k, :m], ends[k, :m], escape, f2, f1, hit2, hit1, SCALE - f2 - f1)
            coder.put(slice(0, m), start, size)
            raw = np.flatnonzero(escape & ~hit2 & ~hit1)
            if len(raw):
                for shift, values in digits:
                    part = SCALE // values
                    coder.put(raw, (x[raw] >> shift & (255 if values == 256 and not shift else -1)) * part, np.full(len(raw), part))
            model.update(m, x, hit2, hit1)
    return coder.finish()


def encode(ids: np.ndarray) -> bytes:
    """A segment of ids below 2^28, of fewer than 2^24 kinds."""
    n = len(ids)
    lanes, last = _blocks(n)
    steps = BLOCK if lanes > 1 else last
    alphabet, numbers = _alphabet(ids)
    prior = _prior(numbers, len(alphabet))
    grid = np.zeros(lanes * BLOCK, np.int32)
    grid[:n] = numbers
    grid, streams = grid.reshape(lanes, BLOCK), []
    for a, b in _groups(lanes, len(alphabet)):
        streams += _encode_lanes(np.ascontiguousarray(grid[a:b, :steps].T), last if b == lanes else steps, prior)
    flat = ids.astype("<u4")
    about = zlib.compress(alphabet.astype("<u4").tobytes() + prior.astype("<u2").tobytes())
    table = b"".join(struct.pack("<II", len(s) // 2, zlib.crc32(flat[i * BLOCK : (i + 1) * BLOCK].tobytes())) for i, s in enumerate(streams))
    head = MAGIC + struct.pack("<IIIII", BLOCK, n, lanes, len(alphabet), len(about)) + about + table
    return b"".join([head, struct.pack("<I", zlib.crc32(head)), *streams])


class Corrupt(ValueError):
    """A segment whose checksums don't hold."""


def _decode_lanes(streams: list[np.ndarray], steps: int, last: int, prior: np.ndarray) -> np.ndarray:
    """The numbers (steps, lanes) of blocks side by side."""
    lanes, kinds = len(streams), len(prior)
    coder, grid, digits = Decoder(streams), np.zeros((steps, lanes), np.int32), _digits(kinds)
    model, lane = Model(lanes), np.arange(lanes, dtype=I)
    for begin, end in _stages(steps if lanes > 1 else last):
        order0 = Order0(prior, grid[max(0, begin - HISTORY) : begin])
        slots, row = order0.slots(), lane * order0.m
        for t in range(begin, end):
            m = lanes if t < last else lanes - 1
            every = slice(0, m)
            g2, g1, f2, f1 = model.predict(m)
            v = coder.value(every)
            both = f2 + f1
            hit2 = v < f2
            hit1 = (v < both) & ~hit2
            rest = SCALE - both
            ids0 = rest - (rest >> ESCAPE)
            v -= both
            escape = v >= ids0
            # the unit, then the slot that holds it
            v += 1
            v <<= UNIT
            v -= 1
            unit = _division(v, ids0)
            unit += 1
            unit *= order0.m
            unit -= 1
            unit >>= UNIT
            np.clip(unit, 0, order0.m - 1, out=unit)
            unit += row[:m]
            x = slots.take(unit).astype(I)
            a, b, _ = order0.find(x)
            a[escape] = 1 << UNIT
            start, size = _interval(a, b, escape, f2, f1, hit2, hit1, rest)
            coder.take(every, start, size)
            np.copyto(x, g1, where=hit1)
            np.copyto(x, g2, where=hit2)
            np.minimum(x, kinds - 1, out=x)  # a damaged stream may name an id that isn't
            raw = np.flatnonzero(escape & ~hit2 & ~hit1)
            if len(raw):
                number = np.zeros(len(raw), I)
                for shift, values in digits:
                    part = SCALE // values
                    digit = np.minimum(coder.value(raw) // part, values - 1)
                    coder.take(raw, digit * part, np.full(len(raw), part))
                    number |= digit << shift
                x[raw] = np.minimum(number, kinds - 1)
            grid[t, :m] = x
            model.update(m, x, hit2, hit1)
    return grid


def decode(data: bytes) -> np.ndarray:
    """The ids of a segment (u32); raises ``Corrupt`` where a checksum fails."""
    if data[:4] != MAGIC or len(data) < 28:
        raise Corrupt("not a segment")
    block, n, lanes, kinds, about = struct.unpack_from("<IIIII", data, 4)
    body = 24 + about + 8 * lanes
    if block != BLOCK or len(data) < body + 4 or zlib.crc32(data[:body]) != struct.unpack_from("<I", data, body)[0]:
        raise Corrupt("header")
    known = zlib.decompress(data[24 : 24 + about])
    alphabet, prior = np.frombuffer(known, "<u4", kinds), np.frombuffer(known, "<u2", kinds, 4 * kinds).astype(np.int32)
    table = np.frombuffer(data, "<u4", 2 * lanes, 24 + about).reshape(lanes, 2)
    ends = np.cumsum(table[:, 0].astype(I)) * 2 + body + 4
    if ends[-1] != len(data):
        raise Corrupt("length")
    streams = [np.frombuffer(data, "<u2", int(k), int(e - 2 * k)) for k, e in zip(table[:, 0].astype(I), ends, strict=True)]
    _, last = _blocks(n)
    steps = BLOCK if lanes > 1 else last
    ids = np.zeros((lanes, BLOCK), np.uint32)
    for a, b in _groups(lanes, kinds) if n else ():
        ids[a:b, :steps] = alphabet[_decode_lanes(streams[a:b], steps, last if b == lanes else steps, prior).T]
    ids = ids.ravel()[:n].astype("<u4")
    for i in range(lanes):
        if zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].tobytes()) != int(table[i, 1]):
            raise Corrupt(f"block {i}")
    return ids
