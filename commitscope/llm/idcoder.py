"""Adaptive context-mixing range coder for token ids, vectorised over lanes.

A block is coded on its own: models start afresh, so blocks can be decoded in any order. Its ids are dealt to lanes
(contiguous runs) that advance together, one id each per step; the model is shared by the lanes of the block and
updated after every step, so encoder and decoder see the same state.

Model: order 2 and order 1 each predict one id from the ids before it, with a confidence; the two confidences select
adaptive weights by which the predictions and the order-0 distribution share the range. Order 0 is an adaptive
frequency table over all ids, refreshed at growing intervals.

Block layout (little-endian): magic, number of ids, lanes, vocabulary size, crc32 of the ids as uint32 (each uint32),
the words per lane (uint32 each), then the lanes' 16-bit words.
"""

from __future__ import annotations

import zlib

import numpy as np

MAGIC = 0x31434D43
HEAD = 5
LANES, LANE_IDS = 4096, 128
MASK48, WORD = np.uint64((1 << 48) - 1), np.uint64(16)
LOW32 = np.uint64((1 << 32) - 1)
MIX_BITS, TOP_CONF = 12, 7
SLOTS1, SLOTS2 = 1 << 16, 1 << 18


#: Confidence after a miss (first half) and after a hit.
CONF_NEXT = np.array([1 if c <= 1 else c >> 1 for c in range(TOP_CONF + 1)] + [min(c + 1, TOP_CONF) for c in range(TOP_CONF + 1)], np.int8)


class CorruptBlock(ValueError):
    pass


class _Model:
    def __init__(self, vocab: int, lanes: int):
        self.vocab, self.bits = vocab, max(16, int(vocab - 1).bit_length() + 2)
        self.count = np.zeros(vocab, np.int64)
        self.pending: list[np.ndarray] = []
        self.pred1, self.conf1 = np.zeros(SLOTS1, np.int32), np.zeros(SLOTS1, np.int8)
        self.pred2, self.conf2 = np.zeros(SLOTS2, np.int32), np.zeros(SLOTS2, np.int8)
        self.mix = np.ones((TOP_CONF + 1) ** 2 * 3, np.int64)
        self.mix[2::3] = 4
        self.p1, self.p2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.due, self.step, self.mix_due = 1, 0, 1
        self._refresh()
        self._weigh()

    def _weigh(self) -> None:
        w = self.mix.reshape(-1, 3)
        width = 1 + w * ((1 << MIX_BITS) - 3) // w.sum(axis=1, keepdims=True)
        width[:, 2] = (1 << MIX_BITS) - width[:, 0] - width[:, 1]
        self.width = width.ravel().astype(np.uint64)
        self.begin = (np.cumsum(width, axis=1) - width).ravel().astype(np.uint64)
        self.end2, self.end1 = self.begin[1::3], self.begin[2::3]

    def _refresh(self) -> None:
        if self.pending:
            self.count += np.bincount(np.concatenate(self.pending), minlength=self.vocab)
            self.pending = []
        total, spare = 1 << self.bits, (1 << self.bits) - self.vocab
        n = int(self.count.sum())
        freq = 1 + (self.count * spare // n if n else np.full(self.vocab, spare // self.vocab))
        freq[int(np.argmax(freq))] += total - int(freq.sum())
        self.freq = freq.astype(np.uint64)
        self.cum = (np.cumsum(freq) - freq).astype(np.uint64)
        self.slot = None

    def table(self) -> np.ndarray:
        if self.slot is None:
            self.slot = np.repeat(np.arange(self.vocab, dtype=np.int32), self.freq.astype(np.int64))
        return self.slot

    def predict(self, a: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids that order 2 and order 1 predict for the first ``a`` lanes."""
        p1 = self.p1[:a]
        s1 = p1 & (SLOTS1 - 1)
        s2 = (p1 * 0x9E3779B1 + self.p2[:a] * 0x85EBCA6B) >> 11 & (SLOTS2 - 1)
        self.at = s1, s2
        self.guess = self.pred1[s1], self.pred2[s2]
        self.conf = self.conf1[s1], self.conf2[s2]
        self.ctx = self.conf[1] * np.int16(TOP_CONF + 1) + self.conf[0]
        return self.guess[1], self.guess[0]

    def update(self, ids: np.ndarray, case: np.ndarray) -> None:
        """ids as coded; case: context * 3 + kind."""
        a = len(ids)
        self.mix += np.bincount(case, minlength=len(self.mix))
        for pred, conf, s, guess, c in zip((self.pred1, self.pred2), (self.conf1, self.conf2), self.at, self.guess, self.conf):
            hit = guess == ids
            conf[s] = CONF_NEXT[hit.view(np.int8) * np.int8(TOP_CONF + 1) + c]
            new = np.flatnonzero((c <= 1) > hit)
            pred[s[new]] = ids[new]
        self.p2[:a] = self.p1[:a]
        self.p1[:a] = ids
        self.pending.append(ids)
        self.step += 1
        if self.step == self.mix_due:
            self._weigh()
            self.mix_due += max(1, min(8, self.step // 4))
        if self.step == self.due:
            self._refresh()
            if self.mix.sum() > 1 << 24:
                self.mix = (self.mix >> 1) + 1
            self.due += max(1, min(64, self.step // 2))


def _plan(n: int) -> tuple[int, np.ndarray]:
    lanes = max(1, min(LANES, n // LANE_IDS))
    size = np.full(lanes, n // lanes)
    size[: n % lanes] += 1
    return lanes, size


def encode_block(ids: np.ndarray, vocab: int) -> bytes:
    n = len(ids)
    head = [MAGIC, n, 0, vocab, zlib.crc32(ids.astype("<u4").tobytes())]
    if n == 0:
        return np.array(head, "<u4").tobytes()
    lanes, size = _plan(n)
    head[2] = lanes
    start = np.cumsum(size) - size
    m = _Model(vocab, lanes)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, MASK48)
    words, at = np.zeros((lanes, 3 * int(size[0]) + 8), np.uint16), np.zeros(lanes, np.int64)
    flat, row = words.ravel(), np.arange(lanes) * words.shape[1]
    bits = np.uint64(m.bits)
    mix_bits = np.uint64(MIX_BITS)
    every = np.arange(lanes)
    ids = ids.astype(np.int32)
    for t in range(int(size[0])):
        a = lanes if t < size[-1] else int((size > t).sum())
        x = ids[start[:a] + t]
        guess2, guess1 = m.predict(a)
        kind = 2 - ((guess1 == x).view(np.int8) | ((guess2 == x).view(np.int8) << 1))
        np.maximum(kind, 0, out=kind)
        case = m.ctx * np.int16(3) + kind
        unit = rng[:a] >> mix_bits
        low[:a] += unit * m.begin[case]
        rng[:a] = unit * m.width[case]
        miss = np.flatnonzero(kind == 2)
        y = x[miss]
        unit = rng[miss] >> bits
        low[miss] += unit * m.cum[y]
        rng[miss] = unit * m.freq[y]
        on, lo, r = every[:a], low[:a], rng[:a]
        while True:
            same = (lo ^ (lo + r)) <= LOW32
            go = np.flatnonzero(same | (r <= LOW32))
            if not len(go):
                break
            on, lo, r, same = on[go], lo[go], r[go], same[go]
            r = np.where(same, r, (~lo + np.uint64(1)) & LOW32)
            put = at[on]
            flat[row[on] + put] = lo >> np.uint64(32)
            at[on] = put + 1
            lo, r = (lo << WORD) & MASK48, r << WORD
            low[on], rng[on] = lo, r
        m.update(x, case)
    for s in (32, 16, 0):
        words[every, at] = (low >> np.uint64(s)) & np.uint64(0xFFFF)
        at += 1
    keep = np.arange(words.shape[1])[None, :] < at[:, None]
    return np.array(head, "<u4").tobytes() + at.astype("<u4").tobytes() + words[keep].astype("<u2").tobytes()


def decode_block(data: bytes) -> np.ndarray:
    """The ids of a block; raises CorruptBlock where the checksum or layout does not hold."""
    if len(data) < 4 * HEAD:
        raise CorruptBlock("short block")
    magic, n, lanes, vocab, crc = (int(v) for v in np.frombuffer(data, "<u4", HEAD))
    if magic != MAGIC or n and _plan(n)[0] != lanes:
        raise CorruptBlock("not a block")
    if n == 0:
        return np.empty(0, np.int32)
    _, size = _plan(n)
    if len(data) < 4 * (HEAD + lanes):
        raise CorruptBlock("short block")
    length = np.frombuffer(data, "<u4", lanes, 4 * HEAD).astype(np.int64)
    flat = np.frombuffer(data, "<u2", offset=4 * (HEAD + lanes)).astype(np.uint64)
    if length.sum() != len(flat):
        raise CorruptBlock("short block")
    flat = np.append(flat, np.zeros(4, np.uint64))  # damaged data may read on
    last = len(flat) - 1
    at = np.cumsum(length) - length
    code = (flat[at] << np.uint64(32)) | (flat[np.minimum(at + 1, last)] << WORD) | flat[np.minimum(at + 2, last)]
    at += 3
    start = np.cumsum(size) - size
    m = _Model(vocab, lanes)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, MASK48)
    out = np.empty(n, np.int32)
    bits, top = np.uint64(m.bits), np.uint64((1 << m.bits) - 1)
    mix_bits = np.uint64(MIX_BITS)
    every = np.arange(lanes)
    for t in range(int(size[0])):
        a = lanes if t < size[-1] else int((size > t).sum())
        guess2, guess1 = m.predict(a)
        unit = rng[:a] >> mix_bits
        v = (code[:a] - low[:a]) // np.maximum(unit, np.uint64(1))
        kind = (v >= m.end2[m.ctx]).view(np.int8) + (v >= m.end1[m.ctx]).view(np.int8)
        case = m.ctx * np.int16(3) + kind
        low[:a] += unit * m.begin[case]
        rng[:a] = unit * m.width[case]
        x = np.where(kind == 0, guess2, guess1)
        miss = np.flatnonzero(kind == 2)
        unit = rng[miss] >> bits
        v = np.minimum((code[miss] - low[miss]) // np.maximum(unit, np.uint64(1)), top)
        y = m.table()[v.astype(np.int64)]
        x[miss] = y
        low[miss] += unit * m.cum[y]
        rng[miss] = unit * m.freq[y]
        on, lo, r = every[:a], low[:a], rng[:a]
        while True:
            same = (lo ^ (lo + r)) <= LOW32
            go = np.flatnonzero((same | (r <= LOW32)) & (r > 0))
            if not len(go):
                break
            on, lo, r, same = on[go], lo[go], r[go], same[go]
            r = np.where(same, r, (~lo + np.uint64(1)) & LOW32)
            get = at[on]
            code[on] = ((code[on] << WORD) & MASK48) | flat[np.minimum(get, last)]
            at[on] = get + 1
            lo, r = (lo << WORD) & MASK48, r << WORD
            low[on], rng[on] = lo, r
        out[start[:a] + t] = x
        m.update(x, case)
    if zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise CorruptBlock("checksum does not match")
    return out
