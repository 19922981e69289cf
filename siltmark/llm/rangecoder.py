"""An adaptive context-mixing range coder for token ids, run over many blocks at once.

Blocks are independent: each starts with fresh statistics. Because of that a batch of
blocks is coded in lockstep, one id of every block a step, with array operations.

A block begins with its own alphabet, the different ids in it, sorted and delta-coded; from
then on an id is its place in the alphabet. Three models predict it:

* order 2: the id that last followed the same two ids, with a confidence,
* order 1: the one that last followed the same id, with a confidence,
* order 0: adaptive counts over the whole alphabet.

The weights with which they are mixed are counted: under each confidence of order 2 (and
whether order 1 agrees) and under each confidence of order 1 the block counts how often
order 2 was right, order 1 was, or neither. The counts of the two cells that hold now are added up, so
each cell weighs as much as it has seen. With the mixed odds the range coder takes "as order 2
says", "as order 1 says" or the id by order 0, whose counts then adapt.
"""

from __future__ import annotations

import numpy as np

#: Ids of a block at most: the frequencies of order 0 add up to 2 ** 12, and each id of the alphabet has one at least.
MAX_STEPS = 2048
_TOTAL = 12
#: Slots of order 2 in a block. Order 1 has one for each id of the alphabet.
SLOTS = 1024
#: Low and span have 61 bits and give out 32 at a time.
_FREE = 29
_FULL, _SHORT, _FREE_MASK = np.int64(1) << 61, np.int64(1) << _FREE, (np.int64(1) << _FREE) - 1
#: Three counts in a number, of 21 bits each: order 2 was right, order 1 was, neither.
_FIELD = 21
_MASK = (1 << _FIELD) - 1
_ONE = np.array([1 << _FIELD * i for i in range(3)], np.int64) * 4
_START2 = np.array([c + (c << _FIELD) + (8 << 2 * _FIELD) for c in (1, 2, 4, 8)] * 2, np.int64)
_START1 = np.array([1 + (c << _FIELD) + (8 << 2 * _FIELD) for c in (1, 2, 4, 8)], np.int64)
_GAIN = 2
#: Frequencies of order 0 are taken anew from its counts at these steps.
_REFRESHES = frozenset([8, 16, 32, 64, 128, 256, 512, 1024, 1536])


class _Model:
    """The statistics of a batch of blocks; coder and decoder run through the same states.

    A slot holds a predicted place in the alphabet times 4 plus its confidence. What is kept for each
    id of an alphabet lies block after block, without room between.
    """

    def __init__(self, sizes: np.ndarray, search: bool):
        lanes = len(sizes)
        self.lane, self.sizes = np.arange(lanes), sizes
        self.base, self.base2 = np.cumsum(sizes) - sizes, self.lane * SLOTS
        self.cells2, self.cells1, self.base_search = self.lane * 8, self.lane * 4, self.lane << _TOTAL
        run, at = _spread(sizes)
        self.least, self.first = (at + 1).astype(np.int16), self.base
        self.room = ((1 << _TOTAL) - sizes).astype(np.float64)
        self.places = at.astype(np.int16) if search else None
        self.slots1, self.slots2 = np.zeros(len(run), np.int16), np.zeros(lanes * SLOTS, np.int16)
        self.mix2, self.mix1 = np.tile(_START2, lanes), np.tile(_START1, lanes)
        self.counts = np.ones(len(run), np.int16)
        self.begin, self.part, self.search = np.zeros(len(run), np.int16), np.zeros(len(run), np.int16), None
        self.before1, self.before2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.step = 0
        self.refresh()

    def refresh(self) -> None:
        """Frequencies of order 0 from its counts, each at least 1, and for a decoder what place each part has."""
        total = np.cumsum(self.counts, dtype=np.int64)
        last = total[self.base + self.sizes - 1]
        before = np.r_[0, last[:-1]]
        total -= np.repeat(before, self.sizes)
        # A little more than the ratio, so that the last sum isn't rounded to less than the room.
        share = (total * np.repeat(self.room * (1 + 1e-12) / (last - before), self.sizes)).astype(np.int16)
        share += self.least
        self.begin[1:] = share[:-1]
        self.begin[self.first] = 0
        np.subtract(share, self.begin, out=self.part)
        if self.places is not None:
            self.search = np.repeat(self.places, self.part)

    def predict(self) -> None:
        """Both guesses and the mixed counts."""
        self.at1 = self.base + self.before1
        self.at2 = (self.before1 * 421 + self.before2 * 29 & SLOTS - 1) + self.base2
        slot1, slot2 = self.slots1.take(self.at1), self.slots2.take(self.at2)
        self.one, self.two = slot1 >> 2, slot2 >> 2
        self.sure1, self.sure2 = slot1 & 3, slot2 & 3
        self.cell2 = self.cells2 + (self.sure2 | (self.one == self.two).view(np.int8) << 2)
        self.cell1 = self.cells1 + self.sure1
        self.mixed2, self.mixed1 = self.mix2.take(self.cell2), self.mix1.take(self.cell1)
        mixed = self.mixed2 + self.mixed1
        self.n2 = mixed & _MASK
        self.n21 = (mixed >> _FIELD & _MASK) + self.n2
        self.n = (mixed >> 2 * _FIELD) + self.n21

    def learn(self, x: np.ndarray, wide: np.ndarray, says2: np.ndarray, says1: np.ndarray, kind: np.ndarray, rest: np.ndarray) -> None:
        """Takes in the places (``x``, and ``wide`` as longs). A right guess gains confidence, a wrong one gives way."""
        new = x << 2
        self.slots2[self.at2] = new + np.minimum(self.sure2 + 1, 3) * says2
        self.slots1[self.at1] = new + np.minimum(self.sure1 + 1, 3) * says1
        one = _ONE.take(kind)
        self.mix2[self.cell2] = self.mixed2 + one
        self.mix1[self.cell1] = self.mixed1 + one
        self.counts[rest] += _GAIN
        self.before2, self.before1 = self.before1, wide
        self.step += 1
        if self.step in _REFRESHES:
            self.refresh()


def _local(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of ``ids`` (blocks x steps) in the alphabets of their blocks, the alphabets one after the other, and their sizes."""
    lanes, steps = ids.shape
    ranked = np.sort(ids.astype(np.uint32) << 11 | np.arange(steps, dtype=np.uint32), axis=1)
    own = (ranked >> 11).astype(np.uint16)
    new = np.ones(ids.shape, bool)
    new[:, 1:] = own[:, 1:] != own[:, :-1]
    places = np.empty(lanes * steps, np.int16)
    ranked &= MAX_STEPS - 1
    ranked += np.arange(lanes, dtype=np.uint32)[:, None] * np.uint32(steps)
    places[ranked.reshape(-1)] = (np.cumsum(new, axis=1, dtype=np.int16) - np.int16(1)).reshape(-1)
    return places.reshape(lanes, steps), own[new], new.sum(axis=1)


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items in runs of ``sizes``: the number of each item's run, and its number in the run."""
    run = np.repeat(np.arange(len(sizes)), sizes)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def write_alphabets(ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Sorted alphabets as Rice codes of their steps: size u16, bytes u16, low bits u8; the low bits of all; the rest in unary."""
    run, at = _spread(sizes)
    steps = ids.astype(np.int64)
    steps[1:] -= np.where(at[1:] > 0, steps[:-1] + 1, 0)
    mean = np.maximum(np.add.reduceat(steps, np.cumsum(sizes) - sizes) / sizes, 1.0)
    low = np.maximum(np.floor(np.log2(mean * 0.7 + 1e-9)), 0).astype(np.int64)
    high = steps >> low[run]
    ends = np.cumsum(high + 1)
    first = np.cumsum(sizes) - sizes
    unary = ends - np.repeat(ends[first] - high[first] - 1, sizes) - 1
    bits = np.add.reduceat(high + 1, first) + low * sizes
    n_bytes = -(-bits // 8)
    start = np.cumsum(n_bytes) - n_bytes
    out = np.zeros(int(n_bytes.sum()) * 8, np.uint8)
    own = low[run]
    place = (start * 8)[run]
    out[place + (low * sizes)[run] + unary] = 1
    place += at * own
    for i in range(int(low.max())):
        mine = np.flatnonzero(own > i)
        out[place.take(mine) + i] = steps.take(mine) >> i & 1
    packed = np.packbits(out).tobytes()
    heads = np.empty(len(sizes), _HEAD)
    heads["size"], heads["bytes"], heads["low"] = sizes, n_bytes, low
    head = heads.tobytes()
    n = _HEAD.itemsize
    return [head[n * i : n * i + n] + packed[a : a + b] for i, (a, b) in enumerate(zip(start.tolist(), n_bytes.tolist()))]


_HEAD = np.dtype([("size", "<u2"), ("bytes", "<u2"), ("low", "u1")])


def read_alphabets(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The alphabets one after the other, their sizes, and where each block goes on."""
    heads = np.frombuffer(b"".join([b[: _HEAD.itemsize] for b in blocks]), _HEAD)
    sizes, n_bytes, low = (heads[c].astype(np.int64) for c in ("size", "bytes", "low"))
    after = _HEAD.itemsize + n_bytes
    bits = np.unpackbits(np.frombuffer(b"".join([b[_HEAD.itemsize : e] for b, e in zip(blocks, after.tolist())]), np.uint8))
    run, at = _spread(sizes)
    begin = (np.cumsum(n_bytes) - n_bytes) * 8
    own = low[run]
    place = begin[run] + at * own
    steps = np.zeros(len(run), np.int64)
    for i in range(int(low.max())):
        mine = np.flatnonzero(own > i) if low.min() <= i else slice(None)
        where = place[mine] + i
        steps[mine] |= bits.take(where).astype(np.int64) << i
        bits[where] = 0
    # What is left of the bits are the unary parts: a 1 ends each.
    ones = np.flatnonzero(bits.view(bool))
    steps |= ones - np.where(at > 0, np.r_[0, ones[:-1]] + 1, (begin + low * sizes)[run]) << own
    ids = np.cumsum(steps + (at > 0))
    first = np.cumsum(sizes) - sizes
    return ids - np.repeat(ids[first] - steps[first], sizes), sizes, after


def encode(ids: np.ndarray) -> list[bytes]:
    """Codes the columns of ``ids`` (steps x blocks, values below 65536), each to bytes of its own."""
    steps, lanes = ids.shape
    if steps > MAX_STEPS:
        raise ValueError("a block is too long")
    local, alphabet, sizes = _local(np.ascontiguousarray(ids.T).astype(np.uint16))
    local = np.ascontiguousarray(local.T)
    model = _Model(sizes, False)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, _FULL)
    width = steps + 3
    # Words lie by place and then block: blocks are about equally far, so they write side by side.
    words = np.zeros(width * lanes, np.int64)
    at = model.lane.copy()
    for t in range(steps):
        x = local[t]
        wide = x.astype(np.int64)
        model.predict()
        says2, says1 = model.two == x, model.one == x
        miss2 = ~says2
        kind = miss2.view(np.int8) + (miss2 & ~says1).view(np.int8)
        lost = kind == 2
        first = np.where(says2, 0, np.where(lost, model.n21, model.n2))
        end = np.where(says2, model.n2, np.where(lost, model.n, model.n21))
        r = span // model.n
        low += r * first
        span = r * (end - first)
        place = model.base + wide
        r = span >> _TOTAL
        low += r * model.begin.take(place) * lost
        span = np.where(lost, r * model.part.take(place), span)
        model.learn(x, wide, says2, says1, kind, place[lost])
        short = np.flatnonzero(span < _SHORT)
        if len(short):
            left, where = low.take(short), at.take(short)
            words[where] = left >> _FREE
            at[short] = where + lanes
            low[short] = (left & _FREE_MASK) << 32
            span[short] <<= 32
    words[at] = low >> _FREE
    words[at + lanes] = (low & _FREE_MASK) << 32 - _FREE
    ends = at // lanes + 2
    words = words.reshape(width, lanes)[: int(ends.max(initial=0))]
    for j in range(len(words) - 1, 0, -1):  # a word may hold a carry for the one before
        words[j - 1] += words[j] >> 32
    out = np.ascontiguousarray((words & 0xFFFFFFFF).astype("<u4").T)
    return [head + out[i, :n].tobytes() for i, (head, n) in enumerate(zip(write_alphabets(alphabet, sizes), ends.tolist()))]


def decode(blocks: list[bytes], steps: int) -> np.ndarray:
    """The ids (steps x blocks) of blocks that were coded with the same number of steps."""
    lanes = len(blocks)
    alphabet, sizes, after = read_alphabets(blocks)
    coded = [b[a:] for b, a in zip(blocks, after.tolist())]
    width = max(map(len, coded)) // 4 + 2
    words = np.zeros((lanes, width), np.int64)
    for i, b in enumerate(coded):
        words[i, : len(b) // 4] = np.frombuffer(b, "<u4")
    model = _Model(sizes, True)
    code = (words[:, 0] << _FREE) + (words[:, 1] >> 32 - _FREE)
    # What follows the first 61 bits, 32 at a time, by place and then block.
    later = ((words[:, 1:-1] & (1 << 32 - _FREE) - 1) << _FREE) + (words[:, 2:] >> 32 - _FREE)
    later = np.ascontiguousarray(np.concatenate([later, np.zeros((lanes, 1), np.int64)], axis=1).T)
    flat, at, last = later.reshape(-1), model.lane.copy(), (later.shape[0] - 1) * lanes + model.lane
    span = np.full(lanes, _FULL)
    local = np.zeros((steps, lanes), np.int16)
    top = (1 << _TOTAL) - 1
    for t in range(steps):
        model.predict()
        r = span // model.n
        v = code // r
        miss2, lost = v >= model.n2, v >= model.n21
        first = np.where(lost, model.n21, np.where(miss2, model.n2, 0))
        end = np.where(lost, model.n, np.where(miss2, model.n21, model.n2))
        code -= r * first
        span = r * (end - first)
        r = span >> _TOTAL
        v = np.minimum(code // r, top)
        x = np.where(lost, model.search.take(model.base_search + v), np.where(miss2, model.one, model.two))
        local[t] = x
        wide = x.astype(np.int64)
        place = model.base + wide
        code -= r * model.begin.take(place) * lost
        span = np.where(lost, r * model.part.take(place), span)
        model.learn(x, wide, model.two == x, model.one == x, miss2.view(np.int8) + lost.view(np.int8), place[lost])
        short = np.flatnonzero(span < _SHORT)
        if len(short):
            where = at.take(short)
            code[short] = (code.take(short) << 32) + flat.take(where)
            at[short] = np.minimum(where + lanes, last.take(short))
            span[short] <<= 32
    start = np.cumsum(sizes) - sizes
    return alphabet.astype(np.uint16)[start[None, :] + local]
