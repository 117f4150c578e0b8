"""An adaptive context-mixing range coder for blocks of token ids.

A block is cut into lanes that are coded in step, all feeding one model that is empty at the block's start, so numpy does each
step for all lanes at once. For each id the model has three predictions: the adaptive frequencies of all ids so far (order 0),
the id that last followed the one before (order 1), and the id that last followed the two before (order 2). Their probabilities
are mixed: an id's share of the range is the sum of the three predictions' shares for it, each times its weight. There is a set
of weights for each pair of confidences of the orders 1 and 2; it follows the share that each prediction had in the ids that
came (the responsibilities of a mixture). Encoder and decoder update the model alike after each step.

The words of all lanes stand in the order in which the decoder needs them, so a step reads a stretch of them.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
I32 = np.uint32
WEIGHT_BITS = 10
#: A lane writes 16 bits when its range is below; then the range is 2^48 or more again.
LEAST = U(1 << 48)
SLOTS = 18
STEPS, MOST_LANES = 256, 8191


class Model:
    """Ids from 0 to vocab-1; vocab stands for what is before a lane's first id, vocab+1 for no prediction."""

    def __init__(self, vocab: int, decoding: bool = False):
        self.vocab, self.decoding = vocab, decoding
        self.id_bits = max(20, int(vocab).bit_length() + 4)
        self.bits = U(self.id_bits + WEIGHT_BITS)
        # shares of the range: in half words where they fit
        self.kind = I32 if self.bits < 32 else U
        self.shift = self.kind(self.id_bits)
        # id and confidence in one number: 0 nothing seen, 1 seen, 2 and 3 right once or more in a row
        self.one = np.full(vocab + 1, vocab + 1 << 2, I32)
        self.two = np.full(1 << SLOTS, vocab + 1 << 2, I32)
        self.shares = np.tile([2.0, 1.0, 1.0], (32, 1))
        self.counts = np.zeros(vocab, np.int64)
        self.seen: list[np.ndarray] = []
        self.step, self.next = 0, 1
        self.rebuild()
        self.reweigh()

    def rebuild(self) -> None:
        if self.seen:
            self.counts += np.bincount(np.concatenate(self.seen), minlength=self.vocab)
            self.seen = []
        whole = 1 << self.id_bits
        f = 1 + self.counts * (whole - self.vocab) // max(1, int(self.counts.sum()))
        f[0] += whole - int(f.sum())
        ends = np.cumsum(f)
        self.freq = np.append(f, [0, 0]).astype(self.kind)
        self.start = np.concatenate([[0], ends, [whole]]).astype(self.kind)
        if self.decoding:
            self.holder = np.repeat(np.arange(self.vocab, dtype=np.uint16 if self.vocab <= 1 << 16 else I32), f)

    def reweigh(self) -> None:
        w = 1 + (self.shares * (((1 << WEIGHT_BITS) - 3) / self.shares.sum(1, keepdims=True))).astype(np.int64)
        w[:, 0] += (1 << WEIGHT_BITS) - w.sum(1)
        self.w0, self.w1, self.w2 = (np.ascontiguousarray(c) for c in w.astype(self.kind).T)
        self.m1, self.m2 = self.w1 << self.shift, self.w2 << self.shift

    def predict(self, last: np.ndarray, before: np.ndarray):
        """The place of the two ids before, what is stored for them, and the ids of order 1 and 2 and the weights' row."""
        h = ((before.view(U) * U(0x9E3779B97F4A7C15) + last.view(U)) * U(0xD6E8FEB86659FD93) >> U(64 - SLOTS)).astype(np.int64)
        s1, s2 = self.one.take(last), self.two.take(h)
        p1, p2 = s1 >> I32(2), s2 >> I32(2)
        row = ((s2 & I32(3)) << I32(2)) + (s1 & I32(3)) + ((p1 == p2).astype(I32) << I32(4))
        return h, s1, s2, p1, p2, row.astype(np.int64)

    def learn(self, x, last, h, s1, s2, p1, p2, row, w0, m1, m2, e1=None, e2=None) -> None:
        """e1, e2: where the predictions were right, if that is known."""
        if e1 is None:
            e1, e2 = x == p1, x == p2
        weigh = self.step < 32 or self.step % 8 == 0  # later on an eighth of the ids tells enough
        hit = np.flatnonzero(e1 | e2) if weigh else ()
        if len(hit):
            y, at = x[hit], row[hit]
            m1, m2 = m1[hit] * e1[hit], m2[hit] * e2[hit]
            every = (m1 + m2 + w0[hit] * self.freq[y]).astype(np.float64)
            n1, n2 = np.bincount(at, m1 / every, 32), np.bincount(at, m2 / every, 32)
            self.shares[:, 1] += n1
            self.shares[:, 2] += n2
            self.shares[:, 0] -= n1 + n2
        if weigh:
            self.shares[:, 0] += np.bincount(row, minlength=32)
            self.reweigh()
        new = x << I32(2) | I32(1)  # surer by one, 3 at most, where it was right
        self.one[last] = new + e1 * np.minimum(s1 & I32(3), I32(2))
        self.two[h] = new + e2 * np.minimum(s2 & I32(3), I32(2))
        self.seen.append(x)
        self.step += 1
        if self.step == self.next:
            self.next = min(self.next * 2, self.next + 48)
            self.rebuild()


def shape(n: int) -> tuple[int, int]:
    """Lanes and steps of a block of n ids."""
    lanes = min(MOST_LANES, max(1, n // STEPS))
    return lanes, -(-n // lanes)


def _rows(n: int, lanes: int, steps: int, t: int) -> int:
    """Lanes that have an id at step t; lane l has the ids from l*steps on."""
    return max(0, min(lanes, -(-(n - t) // steps)))


def encode(ids: np.ndarray, vocab: int) -> np.ndarray:
    """The block as 16-bit words: the first four of each lane, then the others in the order of decoding."""
    n = len(ids)
    lanes, steps = shape(n)
    grid = np.zeros(lanes * steps, I32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = Model(vocab)
    low, rng = np.zeros(lanes, U), np.full(lanes, ~U(0), U)
    words, place = np.zeros((3 * steps + 8) * lanes, np.uint16), np.arange(lanes)  # the lanes' next words, `lanes` apart
    last, before = np.full(lanes, vocab, np.int64), np.full(lanes, vocab, np.int64)
    order = [np.zeros(0, I32)]
    for t in range(steps):
        a = _rows(n, lanes, steps, t)
        if not a:
            break
        x, la = grid[t, :a], last[:a]
        at = x.astype(np.int64)
        h, s1, s2, p1, p2, row = model.predict(la, before[:a])
        w0, m1, m2 = model.w0.take(row), model.m1.take(row), model.m2.take(row)
        e1, e2 = p1 == x, p2 == x
        start = w0 * model.start.take(at) + m1 * (p1 < x) + m2 * (p2 < x)
        freq = w0 * model.freq.take(at) + m1 * e1 + m2 * e2
        r = rng[:a] >> model.bits
        start = start * r
        low[:a] += start
        over = np.flatnonzero(low[:a] < start)
        freq = freq * r
        rng[:a] = freq
        carry = place[over]
        while len(carry):  # a carry goes into the words before
            carry = carry - lanes
            words[carry] += np.uint16(1)
            carry = carry[words[carry] == 0]
        todo = np.flatnonzero(freq < LEAST)
        while len(todo):
            lo, to = low[todo], place[todo]
            words[to] = lo >> U(48)
            order.append(to.astype(I32))
            place[todo] = to + lanes
            low[todo] = lo << U(16)
            wide = rng[todo] << U(16)
            rng[todo] = wide
            todo = todo[wide < LEAST]
        model.learn(x, la, h, s1, s2, p1, p2, row, w0, m1, m2, e1, e2)
        before[:a] = la
        last[:a] = at
    for _ in range(4):
        words[place] = low >> U(48)
        low <<= U(16)
        place += lanes
    # the decoder is four words ahead
    return np.concatenate([words[: 4 * lanes], words.take(np.concatenate(order) + I32(4 * lanes))])


def decode(words: np.ndarray, n: int, vocab: int) -> np.ndarray:
    lanes, steps = shape(n)
    model = Model(vocab, decoding=True)
    rng, code = np.full(lanes, ~U(0), U), np.zeros(lanes, U)
    for k in range(4):
        code = code << U(16) | words[k * lanes : (k + 1) * lanes]
    done = 4 * lanes
    grid = np.zeros((steps, lanes), I32)
    last, before = np.full(lanes, vocab, np.int64), np.full(lanes, vocab, np.int64)
    for t in range(steps):
        a = _rows(n, lanes, steps, t)
        if not a:
            break
        la, c = last[:a], code[:a]
        h, s1, s2, p1, p2, row = model.predict(la, before[:a])
        w0, m1, m2 = model.w0.take(row), model.m1.take(row), model.m2.take(row)
        r = rng[:a] >> model.bits
        v = (c // r).astype(model.kind)
        # where the predicted ids' shares start, and how wide they are
        both = p1 == p2
        i1, i2 = p1.astype(np.int64), p2.astype(np.int64)
        start1 = w0 * model.start.take(i1) + m2 * (p2 < p1)
        start2 = w0 * model.start.take(i2) + m1 * (p1 < p2)
        wide1 = w0 * model.freq.take(i1) + m1 + m2 * both
        wide2 = w0 * model.freq.take(i2) + m2 + m1 * both
        hit1, hit2 = v - start1 < wide1, v - start2 < wide2
        x, start, freq = i1, start1.copy(), wide1
        k = np.flatnonzero(hit2)
        x[k], start[k], freq[k] = i2[k], start2[k], wide2[k]
        new = np.flatnonzero(~(hit1 | hit2))
        if len(new):
            u, w = v[new], w0[new]
            past = (u > start1[new]) * m1[new] + (u > start2[new]) * m2[new]
            y = model.holder[((u - past) // w).astype(np.int64)].astype(np.int64)
            x[new] = y
            start[new] = w * model.start[y] + past
            freq[new] = w * model.freq[y]
        c -= start * r
        freq = freq * r
        rng[:a] = freq
        todo = np.flatnonzero(freq < LEAST)
        while len(todo):
            code[todo] = code[todo] << U(16) | words[done : done + len(todo)]
            done += len(todo)
            wide = rng[todo] << U(16)
            rng[todo] = wide
            todo = todo[wide < LEAST]
        grid[t, :a] = x
        model.learn(grid[t, :a], la, h, s1, s2, p1, p2, row, w0, m1, m2, hit1, hit2)
        before[:a] = la
        last[:a] = x
    return np.ascontiguousarray(grid.T).ravel()[:n]
