"""An adaptive context-mixing range coder for token ids, vectorised over lanes.

A block of ids is cut into lanes of equal length that are coded in step: at each step every lane
codes one id from the same model, which is then updated with all of them. The model mixes three predictions:

* order 2: the id last seen after the lane's two last ids (hashed), with a confidence;
* order 1: the id last seen after its last id, with a confidence;
* order 0: frequencies of all ids of the block so far.

How much of the probability the two predicted ids get is learned for each pair of confidences, and the
order-0 frequencies share the rest; the sum of the three drives a 64-bit carryless range coder that writes 16-bit
words. Encoder and decoder start every block from the same state.
"""

from __future__ import annotations

import numpy as np

LANES, LANE_TOKENS = 8192, 256
BITS = 24  # of the mixed total
ZERO_BITS = 18  # of the order-0 total
CONTEXTS = 19  # bits of a hashed order-2 context
SURE = 7  # highest confidence
REFRESH = 8  # steps between updates of frequencies and weights
#: Bounds of the coder: words leave when the top ones agree, and the range is cut short below LEAST.
TOP, LEAST, WORD = np.uint64(1 << 48), np.uint64(1 << 32), np.uint64(16)
_HIGH = np.uint64(48)
#: Odd multipliers that hash the two last ids.
_MIX1, _MIX2 = 0x1F123BB5, 0x5851F42D


class Model:
    """The mixed prediction, and its update, for all lanes at once."""

    def __init__(self, ids: int, lanes: int):
        self.ids = ids
        self.counts = np.zeros(ids, np.int64)
        self.after1 = np.zeros(ids, np.int32)  # predicted id * 8 + confidence
        self.after2 = np.zeros(1 << CONTEXTS, np.int32)
        self.last = np.zeros(lanes, np.int64)
        self.before = np.zeros(lanes, np.int64)
        states = 2 * (SURE + 1) ** 2
        self.seen, self.hit2, self.hit1 = (np.full(states, x) for x in (4.0, 1.0, 1.0))
        self.steps = 0
        self.fresh: list[tuple] = []
        self._refresh()

    def _refresh(self) -> None:
        """Order-0 table and weights from what has been seen."""
        if self.fresh:
            own, state, is2, is1 = (np.concatenate(x) for x in zip(*self.fresh))
            n = len(self.seen)
            self.counts += np.bincount(own, minlength=self.ids)
            self.seen += np.bincount(state, minlength=n)
            self.hit2 += np.bincount(state[is2], minlength=n)
            self.hit1 += np.bincount(state[is1], minlength=n)
        self.fresh = []
        room = (1 << ZERO_BITS) - self.ids
        total = int(self.counts.sum())
        share = self.counts * room // total if total else np.zeros(self.ids, np.int64)
        self.cumulative = np.concatenate(([0], np.cumsum(share + 1)))
        self.cumulative[-1] = 1 << ZERO_BITS  # the last id gets what rounding leaves
        self.at = None
        # At least a sixteenth of the total stays for order 0, so every id can be coded.
        scale = (1 << BITS) * 15 / 16 / np.maximum(self.seen, self.hit2 + self.hit1)
        self.mass2, self.mass1 = (self.hit2 * scale).astype(np.int64), (self.hit1 * scale).astype(np.int64)
        self.mass1[1::2] = 0  # where both predict the same id it gets one share
        self.mass0 = (1 << BITS) - self.mass2 - self.mass1

    def predict(self) -> None:
        self.slot = (self.before * _MIX1 + self.last * _MIX2 >> 9) & ((1 << CONTEXTS) - 1)
        self.e1, self.e2 = self.after1[self.last], self.after2[self.slot]
        p1, p2 = self.e1 >> 3, self.e2 >> 3
        self.state = (((self.e2 & 7) << 4) | ((self.e1 & 7) << 1)) + (p1 == p2)
        self.p1, self.p2 = p1.astype(np.int64), p2.astype(np.int64)
        self.m2, self.m1, self.m0 = self.mass2[self.state], self.mass1[self.state], self.mass0[self.state]

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the ids' shares: what ids before get, then a predicted id's mass, then its order-0 share."""
        self.is2, self.is1 = ids == self.p2, ids == self.p1
        low = self.cumulative[ids] * self.m0 >> ZERO_BITS
        size = (self.cumulative[ids + 1] * self.m0 >> ZERO_BITS) - low
        low += self.m2 * (ids > self.p2)
        low += self.m1 * (ids > self.p1)
        size += self.m2 * self.is2
        size += self.m1 * self.is1
        return low, size

    def find(self, value: np.ndarray) -> np.ndarray:
        """The id whose share holds a value."""
        if self.at is None:
            self.at = np.repeat(np.arange(self.ids, dtype=np.int32), np.diff(self.cumulative))
        first = self.p1 <= self.p2
        a, b = np.minimum(self.p1, self.p2), np.maximum(self.p1, self.p2)
        ma, mb = np.where(first, self.m1, self.m2), np.where(first, self.m2, self.m1)
        over = value - (self.cumulative[a] * self.m0 >> ZERO_BITS)
        past = over >= ma
        in_a = (over >= 0) ^ past
        value = value - ma * past
        over = value - (self.cumulative[b] * self.m0 >> ZERO_BITS)
        past = over >= mb
        in_b = (over >= 0) ^ past
        value = value - mb * past
        # the largest order-0 place whose scaled value is not above
        place = (((value + 1) << ZERO_BITS) - 1) // self.m0
        np.clip(place, 0, (1 << ZERO_BITS) - 1, out=place)
        ids = self.at[place].astype(np.int64)
        ids[in_b] = b[in_b]
        ids[in_a] = a[in_a]
        return ids

    def update(self, ids: np.ndarray) -> None:
        """Takes in one id of each of the first len(ids) lanes, after interval()."""
        n = len(ids)
        is1, is2 = self.is1[:n], self.is2[:n]
        self.fresh.append((ids, self.state[:n], is2, is1 & ~is2))
        anew = (ids << 3).astype(np.int32)
        for table, at, entry, hit in ((self.after1, self.last[:n], self.e1[:n], is1), (self.after2, self.slot[:n], self.e2[:n], is2)):
            sure = entry & 7
            missed = np.where(sure > 1, entry - 2, anew)
            table[at] = np.where(hit, entry + (sure < SURE), missed)
        self.before[:n] = self.last[:n]
        self.last[:n] = ids
        self.steps += 1
        if self.steps % REFRESH == 0:
            self._refresh()


def _renormal(low: np.ndarray, width: np.ndarray):
    """Yields the lanes that a word leaves, and the words, until every width is large enough; changes low and width."""
    at = np.flatnonzero(((low ^ (low + width)) < TOP) | (width < LEAST))
    while len(at):
        l, w = low[at], width[at]
        short = ((l ^ (l + w)) >= TOP) & (w < LEAST)
        if short.any():
            w[short] = (~l[short] + np.uint64(1)) & (LEAST - np.uint64(1))
        yield at, l >> _HIGH
        l <<= WORD
        w <<= WORD
        low[at], width[at] = l, w
        at = at[((l ^ (l + w)) < TOP) | (w < LEAST)]


def lanes_for(n: int) -> int:
    return max(1, min(LANES, n // LANE_TOKENS))


def _shape(n: int) -> tuple[int, int, int]:
    """Lanes, steps, and how many lanes (the first ones) take part in the last step."""
    lanes = lanes_for(n)
    steps = -(-n // lanes)
    return lanes, steps, n - lanes * (steps - 1)


def _by_step(ids: np.ndarray) -> np.ndarray:
    """ids as a row for each step; the first lanes are one longer than the others, whose last step is 0."""
    lanes, steps, full = _shape(len(ids))
    out = np.zeros((lanes, steps), np.int64)
    out[:full] = ids[: full * steps].reshape(full, steps)
    out[full:, : steps - 1] = ids[full * steps :].reshape(lanes - full, steps - 1)
    return np.ascontiguousarray(out.T)


def _in_order(rows: np.ndarray, n: int) -> np.ndarray:
    """The ids of _by_step() one lane after another."""
    lanes, steps, full = _shape(n)
    return np.concatenate([rows[:, :full].T.ravel(), rows[: steps - 1, full:].T.ravel()])


def encode(ids: np.ndarray, vocabulary: int) -> bytes:
    """Words of each lane, after their numbers. Needs the number of ids to decode."""
    n = len(ids)
    if not n:
        return b""
    lanes, steps, full = _shape(n)
    rows = _by_step(ids)
    model = Model(vocabulary, lanes)
    low = np.zeros(lanes, np.uint64)
    width = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    who, words = [], []
    for step in range(steps):
        take = lanes if step < steps - 1 else full
        model.predict()
        own = rows[step, :take]
        begin, size = model.interval(rows[step])
        unit = width[:take] >> np.uint64(BITS)
        low[:take] += unit * begin[:take].astype(np.uint64)
        width[:take] = unit * size[:take].astype(np.uint64)
        for at, word in _renormal(low[:take], width[:take]):
            who.append(at.astype(np.int16))
            words.append(word.astype("<u2"))
        model.update(own)
    for k in range(4):
        who.append(np.arange(lanes, dtype=np.int16))
        words.append((low >> _HIGH).astype("<u2"))
        low = low << WORD
    who, words = np.concatenate(who), np.concatenate(words)
    order = np.argsort(who, kind="stable")
    return np.bincount(who, minlength=lanes).astype("<u4").tobytes() + words[order].tobytes()


def decode(data: bytes, n: int, vocabulary: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    lanes, steps, full = _shape(n)
    numbers = np.frombuffer(data, "<u4", lanes).astype(np.int64)
    words = np.concatenate([np.frombuffer(data, "<u2", offset=4 * lanes).astype(np.uint64), np.zeros(4, np.uint64)])
    next_ = np.cumsum(numbers) - numbers
    code = np.zeros(lanes, np.uint64)
    for _ in range(4):
        code = (code << WORD) | words[next_]
        next_ += 1
    model = Model(vocabulary, lanes)
    low = np.zeros(lanes, np.uint64)
    width = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    out = np.zeros((steps, lanes), np.int32)
    for step in range(steps):
        take = lanes if step < steps - 1 else full
        model.predict()
        unit = width >> np.uint64(BITS)
        value = np.minimum((code - low) // unit, np.uint64((1 << BITS) - 1)).astype(np.int64)
        ids = model.find(value)
        begin, size = model.interval(ids)
        own = ids[:take]
        out[step, :take] = own
        low[:take] += unit[:take] * begin[:take].astype(np.uint64)
        width[:take] = unit[:take] * size[:take].astype(np.uint64)
        for at, _ in _renormal(low[:take], width[:take]):
            code[at] = (code[at] << WORD) | words[next_[at]]
            next_[at] += 1
        model.update(own)
    return _in_order(out, n)
