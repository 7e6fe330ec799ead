"""Adaptive context-mixing range coder for token ids below 65536.

A file is cut into blocks. Every block starts from nothing: its model, its coder and its
checksum are its own, so any block is read without others. A block's ids are dealt
into lanes, contiguous stretches that are coded side by side with numpy: each step
codes one id of every lane, with one model for all lanes that learns from all of
them after the step. So the model sees the whole block, and steps stay vectors.

Three orders predict each id. Order 2 names the id that last followed the two ids
before it, order 1 the best follower of the one before it, order 0 has the
frequencies of all ids of the block so far. Each named id is a binary decision:
how often predictions of such standing were right, and how often predictions of
that id were, are mixed in the logistic domain with weights learned on the way. The
decisions' masses and order 0's frequencies make one interval, which a range coder
for each lane codes at once. What predictions name changes with every step; estimates
and weights, each of thousands of lanes, learn from every step at first, then from every
16th. All numbers that decide are integers, or doubles of single exact operations, so
any machine decodes alike.
"""

from __future__ import annotations

import zlib
from decimal import Decimal
from functools import lru_cache

import numpy as np

BLOCK, LANES = 1 << 23, 6144
#: Fewest ids of a lane, as a power of two, while there is more than one lane.
_LEAST_LANE = 8
_SLOTS = 20  # bits of a place in order 2's table
_WHOLE, _FINE = 12, 18  # bits of the masses of decisions, and of order 0's frequencies
_BOTH = _WHOLE + _FINE
#: Order 0 is counted anew, and decisions learn, at every step before the first number, then each time so many steps have gone.
_REFRESH, _LEARN = (16, 64), (32, 16)
#: Kinds of standing: order 2's (0 to 7), whether order 1 names the same id, order 1's (0 to 15).
_KINDS, _NAMES = 256, 4096
_ABSENT, _MOST = -(1 << 30), 1 << 18
U = np.uint64
_MASK31, _LEAST = U((1 << 31) - 1), U(1 << 31)


@lru_cache(1)
def _logistic() -> tuple[np.ndarray, np.ndarray]:
    """squash (0, then 4096 * logistic(d / 256) for d from -2047 to 2047) and the inverse of the latter, stretch, as integers; decimal arithmetic is the same everywhere."""
    up = [int(4096 / (1 + (Decimal(-d) / 256).exp())) for d in range(-2047, 2048)]
    squash = np.clip(np.array(up, np.int64), 1, 4095)
    stretch = np.clip(np.searchsorted(squash, np.arange(4096)) - 2047, -2047, 2047).astype(np.int64)
    return np.concatenate([[0], squash]).astype(np.int32), stretch


@lru_cache(1)
def _standings() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By kind: whether order 2 and order 1 name an id of their own; by kind, without and then with a hit: their standings (<< 16) after it, 0 where the name gives way."""
    c2, same, c1 = np.arange(_KINDS) >> 5, np.arange(_KINDS) >> 4 & 1, np.arange(_KINDS) & 15
    after2 = np.concatenate([np.maximum(c2 - 1, 0), np.minimum(c2 + 2, 7)])
    after1 = np.concatenate([np.maximum(c1 - 1, 0), np.minimum(c1 + 2, 15)])
    return c2 > 0, (c1 > 0) & (same == 0), (after2 << 16).astype(np.int32), (after1 << 16).astype(np.int32)


def _due(step: int, every: tuple[int, int]) -> bool:
    return step < every[0] or step % every[1] == 0


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a // b as int64 for quotients below 2**31: by doubles, then put right, which is faster than division of integers."""
    q = (a / b).astype(np.int64)
    rest = (a - q.view(U) * b).view(np.int64)
    q -= rest < 0
    q += rest >= b.view(np.int64)
    return q


def _turned(a: np.ndarray) -> np.ndarray:
    """a.T in order of its rows; some columns at a time, so that what is read stays near."""
    out = np.empty(a.shape[::-1], a.dtype)
    for i in range(0, len(a), 64):
        out[:, i : i + 64] = a[i : i + 64].T
    return out


class _Decision:
    """Whether a named id is the next one: two adaptive estimates, by standing and by id, and their logistic mixture."""

    def __init__(self, present: np.ndarray) -> None:
        self.squash, self.stretch = _logistic()
        self.absent = ~present
        self.hits = [np.full(_KINDS, 0.5), np.full(_NAMES, 0.5)]
        self.tries = [np.full(_KINDS, 1.5), np.full(_NAMES, 1.5)]
        self.weights = [45000, 20000]
        self._learned()

    def _learned(self) -> None:
        self.at = [self.stretch[(h / t * 4096).astype(np.int64)] for h, t in zip(self.hits, self.tries)]
        # each estimate's part of the mixture, in 65536ths; where nothing is named there is no mass
        self.parts = [(w * a).astype(np.int32) for w, a in zip(self.weights, self.at)]
        self.parts[0] += 2048 << 16
        self.parts[0][self.absent] = _ABSENT

    def predict(self, kind: np.ndarray, name: np.ndarray) -> np.ndarray:
        """Probability in 4096ths, 0 where nothing is named."""
        self.keys = kind, (name & (_NAMES - 1)).astype(np.int64)
        mixed = self.parts[0].take(kind)
        mixed += self.parts[1].take(self.keys[1])
        mixed >>= 16
        self.p = self.squash.take(mixed, mode="clip")
        return self.p

    def learn(self, tried: np.ndarray, hit: np.ndarray) -> None:
        """hit is only where tried is."""
        n = int(np.count_nonzero(tried))
        if not n:
            return
        miss = ((hit.astype(np.int64) << _WHOLE) - self.p) * tried
        for i in (0, 1):
            w = self.weights[i] + int(miss @ self.at[i].take(self.keys[i])) // (n << 4)
            self.weights[i] = max(-_MOST, min(_MOST, w))
            self.hits[i] += np.bincount(self.keys[i][hit], minlength=len(self.hits[i]))
            self.tries[i] += np.bincount(self.keys[i][tried], minlength=len(self.hits[i]))
        self._learned()


class _Model:
    """Predictions for the next id of each of n lanes over ids below top."""

    def __init__(self, n: int, top: int, decodes: bool = False) -> None:
        self.top, self.decodes = top, decodes
        present2, present1, self.after2, self.after1 = _standings()
        self.by2 = np.full(1 << _SLOTS, -1, np.int32)  # check << 20 | standing << 16 | id
        self.best = np.zeros(top, np.int32)  # standing << 16 | id
        self.two, self.one = _Decision(present2), _Decision(present1)
        self.p1, self.p2 = np.zeros(n, np.int64), np.zeros(n, np.uint32)
        self.count = np.zeros(top, np.int64)
        self.fresh: list[np.ndarray] = []
        self.step = 0

    def _frequencies(self) -> None:
        """Order 0: size and begin of each id seen (and, last, of any other id) in a whole of 2**18; named: what lies where."""
        if self.fresh:
            self.count += np.bincount(np.concatenate(self.fresh), minlength=self.top)
            self.fresh = []
        seen = self.count > 0
        total, distinct, once = int(self.count.sum()), int(np.count_nonzero(seen)), int(np.count_nonzero(self.count == 1))
        whole = 1 << _FINE
        new = max(1, min(whole * (once + 1) // (total + once + 2), (whole - distinct) // 2))
        size = np.zeros(self.top + 1, np.int64)
        if total:
            size[:-1] = self.count * ((whole - distinct - new) / total) + seen
        size[-1] = whole - int(size.sum())
        self.size = size.astype(np.int32)
        self.begin = (np.cumsum(size) - size).astype(np.int32)
        if self.decodes:
            self.named = np.repeat(np.arange(self.top + 1, dtype=np.int32), size)

    def predict(self) -> None:
        """Named ids id2 and id1, their masses m2 and m1, what rest is left to order 0 and where it begins."""
        if _due(self.step, _REFRESH):
            self._frequencies()
        self.step += 1
        self.last = self.p1.astype(np.uint32)
        mixed = self.last * np.uint32(0x9E3779B1)
        mixed += self.p2 * np.uint32(0x85EBCA77)
        self.slot = (mixed >> np.uint32(32 - _SLOTS)).astype(np.int64)
        mixed ^= mixed >> np.uint32(9)
        mixed &= np.uint32(0xFF)
        mixed <<= np.uint32(20)
        self.check = mixed.view(np.int32)
        e2, e1 = self.by2.take(self.slot), self.best.take(self.p1)
        self.id2, self.id1 = e2 & 0xFFFF, e1 & 0xFFFF
        e2 ^= self.check
        any2 = e2.view(np.uint32) < np.uint32(1 << 20)
        e2 >>= 15
        e2 &= 14
        e2 += self.id1 == self.id2
        e2 *= any2
        e2 <<= 4
        e1 >>= 16
        e2 += e1
        self.kind = e2.astype(np.int64)
        self.m2 = self.two.predict(self.kind, self.id2)
        rest = (1 << _WHOLE) - self.m2
        self.m1 = self.one.predict(self.kind, self.id1) * rest
        self.m1 >>= _WHOLE
        rest -= self.m1
        self.rest, self.begins = rest, self.m2 + self.m1

    def update(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """ids as int64; hit2 and hit1: where a named id was coded."""
        if _due(self.step - 1, _LEARN):
            tried2 = self.m2 > 0
            self.two.learn(tried2, hit2)
            self.one.learn((self.m1 > 0) & ~hit2, hit1)
        x = ids.astype(np.int32)
        same1 = x == self.id1
        x += 65536
        for table, at, names, after, hit, check in ((self.by2, self.slot, self.id2, self.after2, hit2, self.check), (self.best, self.p1, self.id1, self.after1, same1, None)):
            now = after.take(self.kind + hit.astype(np.int64) * _KINDS)
            # a prediction without standing gives way
            new = (x - names) * (now == 0)
            now += names
            now += new
            if check is not None:
                now += check
            table[at] = now
        self.fresh.append(ids)
        self.p2, self.p1 = self.last, ids


def _encode_lanes(ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, used): ids (lanes, steps) coded; each lane's words as 32-bit values."""
    n, steps = ids.shape
    model, ids = _Model(n, top), _turned(ids)
    low, width = np.zeros(n, U), np.full(n, (1 << 63) - 1, U)
    room = steps * 3 // 2 + 4
    # the lanes' next words lie side by side
    out, put = np.zeros(room * n, U), np.arange(n)
    for x in ids:
        x = x.astype(np.int64)
        model.predict()
        hit2 = (x == model.id2) & (model.m2 > 0)
        miss2 = ~hit2
        hit1 = (x == model.id1) & (model.m1 > 0) & miss2
        miss = miss2 & ~hit1
        left2, left = miss2.astype(np.int32), miss.astype(np.int32)
        # of the masses of order 2, order 1 and order 0, the one that is coded
        mass = model.m2 + (model.m1 - model.m2) * left2
        mass += (model.rest - model.m1) * left
        size = model.size.take(x)
        new = miss & (size == 0)
        some = bool(new.any())
        g = np.where(new, top, x) if some else x
        if some:
            size = model.size.take(g)
        lo = model.m2 * left2
        lo += model.m1 * left
        lo <<= _FINE
        lo += model.begin.take(g) * left * mass
        size -= 1 << _FINE
        size *= left
        size += 1 << _FINE
        size *= mass
        width >>= U(_BOTH)
        low += width * lo.astype(U)
        width *= size.astype(U)
        k = np.flatnonzero(width < _LEAST)
        at, word = put.take(k), low.take(k)
        out[at] = word >> U(31)
        put[k] = at + n
        low[k] = (word & _MASK31) << U(32)
        width[k] <<= U(32)
        if some:  # an id that this block's order 0 does not know yet: 16 plain bits
            k = np.flatnonzero(new)
            r = width[k] >> U(16)
            low[k] += r * x[k].astype(U)
            width[k] = r
            k = k[r < _LEAST]
            out[put[k]] = low[k] >> U(31)
            put[k] += n
            low[k] = (low[k] & _MASK31) << U(32)
            width[k] <<= U(32)
        model.update(x, hit2, hit1)
    out[put] = low >> U(31)
    out[put + n] = (low & _MASK31) << U(1)
    used = put // n + 2
    out = out.reshape(room, n)[: int(used.max())]
    while (over := out >> U(32)).any():
        out &= U(0xFFFFFFFF)
        out[:-1] += over[1:]
    return out.T.astype(np.uint32, order="C"), used


def _decode_lanes(words: np.ndarray, steps: int, top: int) -> np.ndarray:
    """ids (lanes, steps) from words (lanes, any) padded with zeros."""
    n = len(words)
    w = np.concatenate([words.T.astype(U, order="C"), np.zeros((3, n), U)])
    code = (w[0] << U(31)) | (w[1] >> U(1))
    # the lanes' next words lie side by side
    stream = (((w[:-1] & U(1)) << U(31)) | (w[1:] >> U(1))).ravel()
    take = np.arange(n, 2 * n)
    model, width = _Model(n, top, True), np.full(n, (1 << 63) - 1, U)
    out = np.zeros((steps, n), np.uint16)
    for t in range(steps):
        model.predict()
        width >>= U(_BOTH)
        v = np.minimum(_quotient(code, width), (1 << _BOTH) - 1).astype(np.int32)
        at = v >> _FINE
        miss2, miss = at >= model.m2, at >= model.begins
        hit2, hit1 = ~miss2, miss2 & ~miss
        left2, left = miss2.astype(np.int32), miss.astype(np.int32)
        mass = model.m2 + (model.m1 - model.m2) * left2
        mass += (model.rest - model.m1) * left
        lo = model.m2 * left2
        lo += model.m1 * left
        lo <<= _FINE
        # the quotient of two such small integers is exact enough to be cut off
        v -= lo
        v *= left
        g = model.named.take((v / mass).astype(np.int64))
        x = model.id2 + (model.id1 - model.id2) * left2
        x += (g - model.id1) * left
        size = model.size.take(g)
        size -= 1 << _FINE
        size *= left
        size += 1 << _FINE
        size *= mass
        lo += model.begin.take(g) * left * mass
        code -= width * lo.astype(U)
        width *= size.astype(U)
        k = np.flatnonzero(width < _LEAST)
        at = take.take(k)
        code[k] = (code.take(k) << U(32)) | stream.take(at, mode="clip")
        take[k] = at + n
        width[k] <<= U(32)
        new = x == top
        x = x.astype(np.int64)
        if new.any():
            k = np.flatnonzero(new)
            r = width[k] >> U(16)
            v = np.minimum(_quotient(code[k], r), 0xFFFF)
            x[k] = np.minimum(v, top - 1)
            code[k] -= r * v.astype(U)
            width[k] = r
            k = k[r < _LEAST]
            code[k] = (code[k] << U(32)) | stream.take(take[k], mode="clip")
            take[k] += n
            width[k] <<= U(32)
        out[t] = x
        model.update(x, hit2, hit1)
    return _turned(out)


MAGIC = b"DLTOK3\n\0"
_HEAD = np.dtype([("tokens", "<u4"), ("lanes", "<u4"), ("top", "<u4"), ("sizes", "<u4"), ("words", "<u4"), ("crc32", "<u4")])


def _lanes(tokens: int) -> int:
    return max(1, min(LANES, tokens >> _LEAST_LANE))


def write_ids(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A file of ids: MAGIC, number of blocks (4 bytes), then each block: its head, the words of each lane (zlib, 4 bytes each), the lanes' words.

    A block holds block ids, the last one what remains. Lanes are equally long; what the last
    ones lack is coded as 0. A head names tokens, lanes, the bound of the ids, the bytes
    of the lanes' sizes, the words of all lanes, and the CRC-32 of both.
    """
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError("ids must be below 65536")
    parts = []
    for at in range(0, len(ids), block):
        part = np.asarray(ids[at : at + block])
        n = _lanes(len(part))
        steps, top = -(-len(part) // n), int(part.max()) + 1
        padded = np.zeros(n * steps, np.uint16)
        padded[: len(part)] = part
        words, used = _encode_lanes(padded.reshape(n, steps), top)
        sizes = zlib.compress(used.astype("<u4").tobytes())
        body = sizes + words[np.arange(words.shape[1]) < used[:, None]].astype("<u4").tobytes()
        head = np.array([(len(part), n, top, len(sizes), int(used.sum()), zlib.crc32(body))], _HEAD)
        parts.append(head.tobytes() + body)
    return MAGIC + np.uint32(len(parts)).tobytes() + b"".join(parts)


def read_ids(data: bytes) -> np.ndarray:
    """The ids of a file; ValueError if it is not one, is cut short, or a block's checksum is wrong."""
    if data[: len(MAGIC)] != MAGIC or len(data) < len(MAGIC) + 4:
        raise ValueError("not a file of token ids")
    blocks, at = int(np.frombuffer(data, "<u4", 1, len(MAGIC))[0]), len(MAGIC) + 4
    out = []
    for k in range(blocks):
        if len(data) < at + _HEAD.itemsize:
            raise ValueError("file of token ids is cut short")
        tokens, lanes, top, sizes, words, crc = np.frombuffer(data, _HEAD, 1, at)[0].tolist()
        at += _HEAD.itemsize
        body = data[at : at + sizes + 4 * words]
        if len(body) < sizes + 4 * words:
            raise ValueError("file of token ids is cut short")
        if zlib.crc32(body) != crc:
            raise ValueError(f"block {k} of a file of token ids is damaged")
        used = np.frombuffer(zlib.decompress(body[:sizes]), "<u4").astype(np.int64)
        padded = np.zeros((lanes, int(used.max())), np.uint32)
        padded[np.arange(padded.shape[1]) < used[:, None]] = np.frombuffer(body, "<u4", words, sizes)
        out.append(_decode_lanes(padded, -(-tokens // lanes), top).ravel()[:tokens])
        at += len(body)
    if at != len(data):
        raise ValueError("file of token ids is cut short")
    return np.concatenate(out).astype(np.uint32) if out else np.empty(0, np.uint32)
