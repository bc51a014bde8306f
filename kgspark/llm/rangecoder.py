"""Adaptive context-mixing range coder for token ids, many blocks at a time.

A block codes up to BLOCK ids by itself: no state is carried into it, and its
header holds a checksum of its ids. For each id, an order-2 and an order-1 table
name the id that last followed the same two or one, with a confidence; the
order-0 count of the named id is the third input. The chances that each input
gives the named id are mixed in the logistic domain by weights, and the mix is
corrected by what came in the same joint context. Counts of outcomes are kept
for each id; chances and weights are learnt from them at places that grow apart
(see _mixes). One binary decision, coded with the mixed chance, says whether the
named id comes; if not, the id is coded by adaptive order-0 frequencies over the
block's own alphabet.

The coder keeps a low end of 64 bits with carries and a range in [2^48, 2^64),
and moves 16 bits at a time. All arithmetic is in integers, so that files read
back alike everywhere. Blocks are lanes of numpy arrays: each step codes one id
of every block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

BLOCK = 4096
LANES = 2048  # blocks coded side by side
SLOTS = 4096  # of the order-2 table of a block
STEP, START = 8, 1  # weight of a seen id, of an unseen one
JOINT = 128  # contexts: order-1 confidence (4), order-2 confidence (4), whether order 1 names the same id (2), order-0 level (4)
SHARE = 12  # occurrences of a joint context that count as much as the mix
MAGIC = b"IDB1"
HEAD = struct.Struct("<4sIIII")  # magic, ids, alphabet size, crc32 of the ids as little-endian u32, bytes of the alphabet

_P = (np.arange(4096) + 0.5) / 4096
#: 12-bit chance → logit in 1/256, and back from logit + 2048 to a 16-bit chance.
STRETCH = np.clip(np.rint(256 * np.log(_P / (1 - _P))), -2047, 2047).astype(np.int64)
SQUASH = np.clip(np.rint(65536 / (1 + np.exp(-(np.arange(4096) - 2048) / 256))), 64, 65472).astype(np.int64)
#: Times seen → level of the order-0 input, placed as in the joint context.
LEVEL = (np.digitize(np.arange(BLOCK + 1), [2, 8, 32]) << 5).astype(np.uint16)


def _recounts(t: int) -> bool:
    """Whether order-0 frequencies are summed anew before place t of a block."""
    return t % 64 == 0 or t in (8, 16, 32)


def _mixes(t: int) -> bool:
    """Whether chances and weights are learnt anew before place t."""
    return t % 512 == 0 or t in (32, 64, 128, 256)


class _Lanes:
    """Model state of many blocks; tables are flat, a lane after the other."""

    def __init__(self, symbols: np.ndarray) -> None:
        n, self.width = len(symbols), int(symbols.max())
        row = np.arange(n)
        self.at1, self.at2, self.atj = row * (self.width + 1), row * SLOTS, row * JOINT
        self.next1 = np.zeros(n * (self.width + 1), np.uint16)  # symbol and, in 2 bits, confidence
        self.next2 = np.zeros(n * SLOTS, np.uint16)
        self.seen = np.zeros((n, self.width + 1), np.uint16)
        self.base = np.where(np.arange(self.width)[None, :] < symbols[:, None], START, 0).astype(np.int32)
        self.lane = (row << 16).astype(np.int32)  # keeps sums of all lanes in one ascending order
        self.cum = np.zeros((n, self.width + 1), np.int32)
        self.flat = self.cum.reshape(-1)
        self.symbols = symbols
        self.joint = np.zeros(n * JOINT, np.uint32)  # hits in the upper half, occurrences in the lower one
        self.weights = np.full((n, 3), 30000, np.int64)
        self.chance = np.zeros(n * JOINT, np.uint64)
        self.a = np.full(n, self.width)  # last symbol, and the hash of the one before it
        self.b = np.zeros(n, np.int64)

    def recount(self, live: int, t: int) -> None:
        """Sums of order-0 frequencies; all blocks that live have seen t ids."""
        freq = self.seen[:live, :-1] * np.int32(STEP)
        freq += self.base[:live]
        np.cumsum(freq, axis=1, out=self.cum[:live, 1:])
        self.cum[:live, 1:] += self.lane[:live, None]
        self.cum[:live, 0] = self.lane[:live]
        self.total = (self.symbols[:live] * START + STEP * t).astype(np.uint64)

    def mix(self, live: int) -> None:
        joint = self.joint[: live * JOINT].astype(np.int64).reshape(live, 4, 2, 4, 4)
        n, h = joint & 0xFFFF, joint >> 16
        logits = []
        for others in ((2, 3, 4), (1, 3), (1, 2, 4)):  # order 0 by level, order 1 by confidence and agreement, order 2 by confidence
            some, hits = n.sum(axis=others, keepdims=True), h.sum(axis=others, keepdims=True)
            logits.append(STRETCH[np.minimum((4 * hits + 1) * 4096 // (4 * some + 8), 4095)])
        w, every = self.weights[:live], np.maximum(n.sum(axis=(1, 2, 3, 4)), 1)
        for _ in range(2):
            p = self._mixed(w, logits)
            err = (h << 16) - n * p
            for i, x in enumerate(logits):
                w[:, i] += ((err * x).sum(axis=(1, 2, 3, 4)) // every) >> 9
        np.clip(w, -200000, 200000, out=w)
        p = ((h << 16) + SHARE * self._mixed(w, logits)) // (n + SHARE)
        self.chance[: live * JOINT] = np.clip(p, 64, 65472).reshape(-1).astype(np.uint64)

    @staticmethod
    def _mixed(w: np.ndarray, logits: list[np.ndarray]) -> np.ndarray:
        dot = sum(w[:, i].reshape(-1, 1, 1, 1, 1) * x for i, x in enumerate(logits)) >> 16
        return SQUASH[np.clip(dot, -2047, 2047) + 2048]

    def predict(self, live: int) -> tuple:
        """(named symbol, its 16-bit chance, what learn() needs)."""
        a = self.a[:live]
        i1 = self.at1[:live] + a
        ha = a * 40503
        i2 = ((ha + self.b[:live]) & (SLOTS - 1)) + self.at2[:live]
        s1, s2 = self.next1.take(i1), self.next2.take(i2)
        c1, c2 = s1 & 3, s2 & 3
        g1, g2 = s1 >> 2, s2 >> 2
        guess = np.where(c2 > 0, g2, g1)
        level = LEVEL.take(self.seen.reshape(-1).take(self.at1[:live] + guess))
        level |= c1
        level |= c2 << 2
        level |= (g1 == guess).astype(np.uint16) << 4
        k = self.atj[:live] + level
        return guess, self.chance.take(k), (i1, i2, s1, s2, c1, c2, g1, g2, k, ha)

    def learn(self, live: int, symbol: np.ndarray, hit: np.ndarray, state: tuple) -> None:
        i1, i2, s1, s2, c1, c2, g1, g2, k, ha = state
        fresh = (symbol << 2) | 1
        self.next1[i1] = np.where(g1 == symbol, np.minimum(s1 + 1, s1 | 3), np.where(c1 > 1, s1 - 1, fresh))
        self.next2[i2] = np.where(g2 == symbol, np.minimum(s2 + 1, s2 | 3), np.where(c2 > 1, s2 - 1, fresh))
        self.joint[k] += (hit.astype(np.uint32) << 16) + np.uint32(1)
        self.seen.reshape(-1)[self.at1[:live] + symbol] += np.uint16(1)
        np.right_shift(ha, 5, out=self.b[:live])
        self.a[:live] = symbol


TOP, NONE, S16, S48 = np.uint64(1 << 48), np.uint64(0), np.uint64(16), np.uint64(48)
FULL = np.uint64((1 << 64) - 1)


def _alphabet(ids: np.ndarray) -> bytes:
    return zlib.compress(np.diff(ids, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 6)


def _read_alphabet(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, n).T.copy().view("<u4").reshape(-1)).astype(np.int64)


def encode_blocks(blocks: list[np.ndarray], lanes: int = LANES) -> list[bytes]:
    """One self-contained byte string for each array of ids (unsigned 32-bit, at most BLOCK of them)."""
    out: list[bytes] = [b""] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    for at in range(0, len(order), lanes):
        part = order[at : at + lanes]
        for i, data in zip(part, _encode([np.asarray(blocks[i], dtype="<u4") for i in part])):
            out[i] = data
    return out


def _encode(blocks: list[np.ndarray]) -> Iterator[bytes]:
    sizes = np.array([len(b) for b in blocks])
    if not len(sizes) or sizes[0] == 0:
        return iter([HEAD.pack(MAGIC, 0, 0, 0, 0) for _ in blocks])
    n, longest = len(blocks), int(sizes[0])
    alphabets, grid = [], np.zeros((longest, n), np.uint16)
    for i, b in enumerate(blocks):
        letters, place = np.unique(b, return_inverse=True)
        alphabets.append(letters)
        grid[: len(b), i] = place
    model = _Lanes(np.array([max(1, len(a)) for a in alphabets]))
    low, span = np.zeros(n, np.uint64), np.full(n, FULL)
    room = 3 * longest + 8
    words = np.zeros(n * room, np.uint16)
    begin = np.arange(n) * room
    used = begin.copy()

    def carry(who: np.ndarray) -> None:
        back = used[who] - 1
        while len(back):
            words[back] += np.uint16(1)
            back = back[words[back] == 0] - 1

    live = n
    for t in range(longest):
        while sizes[live - 1] <= t:
            live -= 1
        if _recounts(t):
            model.recount(live, t)
        if _mixes(t):
            model.mix(live)
        symbol = grid[t, :live]
        guess, p, state = model.predict(live)
        hit = guess == symbol
        l, s, u, total = low[:live], span[:live], used[:live], model.total[:live]
        part = (s >> S16) * p
        r = (s - part) // total
        at = model.at1[:live] + symbol
        start, stop = model.flat.take(at), model.flat.take(at + 1)
        add = np.where(hit, NONE, part + r * (start - model.lane[:live]).astype(np.uint64))
        l += add
        s[:] = np.where(hit, part, r * (stop - start).astype(np.uint64))
        over = l < add
        if over.any():
            carry(np.flatnonzero(over))
        small = s < TOP
        while small.any():
            words[u] = (l >> S48).astype(np.uint16)  # where nothing moves, the next word will be written over this one
            u += small
            shift = small.astype(np.uint64) << np.uint64(4)
            l <<= shift
            s <<= shift
            small = s < TOP
        model.learn(live, symbol, hit, state)
    for _ in range(4):
        words[used] = (low >> S48).astype(np.uint16)
        used += 1
        low <<= S16
    out = []
    for i, b in enumerate(blocks):
        letters = _alphabet(alphabets[i])
        out.append(HEAD.pack(MAGIC, len(b), len(alphabets[i]), zlib.crc32(b.tobytes()), len(letters)) + letters + words[begin[i] : used[i]].astype("<u2").tobytes())
    return iter(out)


def decode_blocks(data: list[bytes], lanes: int = LANES) -> list[np.ndarray]:
    """The ids of each block; ValueError if a block's magic or checksum is wrong."""
    heads = []
    for d in data:
        head = HEAD.unpack_from(d)
        if head[0] != MAGIC:
            raise ValueError("not a block of ids")
        heads.append(head)
    out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(data)
    order = sorted((i for i in range(len(data)) if heads[i][1]), key=lambda i: -heads[i][1])
    for at in range(0, len(order), lanes):
        part = order[at : at + lanes]
        for i, ids in zip(part, _decode([data[i] for i in part], [heads[i] for i in part])):
            if zlib.crc32(ids.tobytes()) != heads[i][3]:
                raise ValueError("a block's checksum does not match")
            out[i] = ids
    return out


def _decode(data: list[bytes], heads: list[tuple]) -> Iterator[np.ndarray]:
    sizes, symbols = np.array([h[1] for h in heads]), np.array([h[2] for h in heads])
    n, longest = len(data), int(sizes[0])
    alphabets, codes = [], []
    for d, h in zip(data, heads):
        a = HEAD.size + h[4]
        alphabets.append(_read_alphabet(d[HEAD.size : a], h[2]))
        codes.append(np.frombuffer(d, "<u2", offset=a))
    room = max(map(len, codes)) + 4
    words = np.zeros((n, room), np.uint16)
    for i, c in enumerate(codes):
        words[i, : len(c)] = c
    model = _Lanes(symbols)
    code = np.zeros(n, np.uint64)  # relative to low
    for k in range(4):
        code = (code << S16) | words[:, k]
    words = words.reshape(-1)
    used, span = np.arange(n) * room + 4, np.full(n, FULL)
    grid = np.zeros((longest, n), np.uint16)
    live = n
    for t in range(longest):
        while sizes[live - 1] <= t:
            live -= 1
        if _recounts(t):
            model.recount(live, t)
        if _mixes(t):
            model.mix(live)
        guess, p, state = model.predict(live)
        c, s, u, total, lane = code[:live], span[:live], used[:live], model.total[:live], model.lane[:live]
        part = (s >> S16) * p
        hit = c < part
        rest = np.where(hit, NONE, c - part)
        r = (s - part) // total
        value = np.minimum(rest // r, total - np.uint64(1)).astype(np.int32) + lane
        at = model.flat[: live * (model.width + 1)].searchsorted(value, side="right") - 1
        symbol = np.where(hit, guess, at - model.at1[:live]).astype(np.uint16)
        start, stop = model.flat.take(at), model.flat.take(at + 1)
        c[:] = np.where(hit, c, rest - r * (start - lane).astype(np.uint64))
        s[:] = np.where(hit, part, r * (stop - start).astype(np.uint64))
        small = s < TOP
        while small.any():
            shift = small.astype(np.uint64) << np.uint64(4)
            c <<= shift
            s <<= shift
            c |= np.where(small, words.take(u), np.uint16(0))
            u += small
            small = s < TOP
        grid[t, :live] = symbol
        model.learn(live, symbol, hit, state)
    for i in range(n):
        yield alphabets[i][grid[: sizes[i], i]].astype("<u4")
