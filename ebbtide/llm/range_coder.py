"""Adaptive context-mixing range coder for blocks of token ids.

A block is coded by itself: all its statistics start empty. For each id, the two ids before it and
the one before it each predict the id that followed them last. One symbol says which prediction
holds, or none; its probabilities are adaptive, in a context mixed from how often either
prediction has held and whether they agree. If none holds, the id is coded by its frequency so
far in the block (order 0), which is counted anew at positions that quadruple.

Many blocks are coded side by side, a numpy lane each, as one block gives no parallel work. The
coder works on places in the block's sorted list of different ids, which leads the block. It
keeps `low` below 2**48 and writes 16 bits when `range` falls below 2**32; carries go into
the words already written.
"""

from __future__ import annotations

import itertools
import struct
import zlib

import numpy as np

BLOCK_IDS = 1 << 12
LANES = 2048
_MAGIC = b"EBTK"
#: Magic, version, 0, alphabet, ids, words, CRC of the ids, bytes of the tables, CRC of what follows.
_HEAD = struct.Struct("<4sHHIIIIII")
_T1, _T2 = 10, 11
_TOP, _BOTTOM, _LOW32 = 1 << 48, 1 << 32, (1 << 32) - 1
#: The three odds of a context add up to 2**_ODDS and move by 1/2**_RATE of the way.
_ODDS, _RATE = 12, 5
_MOST = (1 << _ODDS) - 64


class _Model:
    """State of `n` lanes; the first `k` are in use. Tables of all lanes lie in one flat array."""

    def __init__(self, n: int, alphabet: int):
        self.alphabet = alphabet
        self.bits = (alphabet - 1).bit_length() + 2
        # The number that came next, and above its 16 bits how often in a row it has held (0 to 3).
        self.next1, self.next2 = np.zeros(n << _T1, np.int32), np.zeros(n << _T2, np.int32)
        self.odds2, self.odds1 = np.full(n << 5, 1 << _ODDS - 2, np.int64), np.full(n << 5, 1 << _ODDS - 3, np.int64)
        self.count = np.zeros(n * alphabet, np.uint16)
        self.c1, self.c2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
        lane = np.arange(n)
        self.base1, self.base2, self.base5, self.base = lane << _T1, lane << _T2, lane << 5, lane * alphabet
        self.rebuild(n, 0)

    def rebuild(self, k: int, seen: int) -> None:
        """Order-0 frequencies of the first k lanes: one for each number, the rest by count."""
        total, size = 1 << self.bits, self.alphabet
        count = self.count[: k * size].reshape(k, size).astype(np.int32)
        # `seen` is a power of two and the counts add up to it, so the product stays below 2**31.
        freq = 1 + (count * (total - size) >> seen.bit_length() - 1) if seen else np.full((k, size), total // size, np.int32)
        freq[:, 0] += total - freq.sum(axis=1, dtype=np.int32)
        start = np.zeros((k, size + 1), np.int32)
        np.cumsum(freq, axis=1, out=start[:, 1:])
        self.start = start.ravel()
        self.code_of = np.repeat(np.tile(np.arange(size, dtype=np.uint16), k), freq.ravel())

    def predict(self, k: int) -> None:
        mixed = self.c1[:k] * 40503
        self.i1 = self.base1[:k] + (mixed >> 2 & (1 << _T1) - 1)
        self.i2 = self.base2[:k] + (mixed + self.c2[:k] * 60493 >> 3 & (1 << _T2) - 1)
        n1, n2 = self.next1.take(self.i1), self.next2.take(self.i2)
        self.p1, self.p2, self.s1, self.s2 = n1 & 0xFFFF, n2 & 0xFFFF, n1 >> 16, n2 >> 16
        self.row = self.base5[:k] + (self.s2 << 3) + (self.s1 << 1) + (self.p1 == self.p2)
        self.f2, self.f1 = self.odds2.take(self.row), self.odds1.take(self.row)

    def learn(self, k: int, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """hit1: the order-1 prediction held and the order-2 one did not."""
        self.odds2[self.row] = self.f2 + (hit2 * _MOST - self.f2 + 16 >> _RATE)
        self.odds1[self.row] = self.f1 + (hit1 * _MOST - self.f1 + 16 >> _RATE)
        self.next2[self.i2] = ids + (np.minimum(self.s2 + 1, 3) * hit2 << 16)
        self.next1[self.i1] = ids + (np.minimum(self.s1 + 1, 3) * (self.p1 == ids) << 16)
        self.count[self.base[:k] + ids] += 1
        self.c2[:k], self.c1[:k] = self.c1[:k], ids


def _due(t: int) -> bool:
    return t in (128, 512, 2048, 8192)


def _by_length(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes from long to short, and how many are in use at each position."""
    order = np.argsort(-lengths, kind="stable")
    used = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(lengths.max(initial=0)), side="right")
    return order, used


def encode_lanes(blocks: list[np.ndarray], alphabet: int) -> list[bytes]:
    """The words of each block of numbers below `alphabet`, at most 2**16."""
    lengths = np.array([len(b) for b in blocks], np.int64)
    order, used = _by_length(lengths)
    n = len(blocks)
    grid = np.zeros((len(used), n), np.int64)
    for at, i in enumerate(order):
        grid[: lengths[i], at] = blocks[i]
    model = _Model(n, alphabet)
    low, width = np.zeros(n, np.int64), np.full(n, _TOP, np.int64)
    room = 2 * len(used) + 4
    # Word by word, lane beside lane: lanes move at a like pace, so neighbours share cache lines.
    words = np.zeros(room * n, np.uint16)
    every = np.arange(n)
    place = every.copy()

    def put(who, lo, wi) -> None:
        over = np.flatnonzero(lo >= _TOP)
        if len(over):
            lo[over] &= _TOP - 1
            at = place[who[over]] - n
            while len(at):
                words[at] += 1
                at = at[words[at] == 0] - n
        small = np.flatnonzero(wi < _BOTTOM)
        if len(small):
            lanes, tail = who[small], lo[small]
            at = place[lanes]
            words[at] = tail >> 32
            place[lanes] = at + n
            lo[small] = (tail & _LOW32) << 16
            wi[small] <<= 16

    for t, k in enumerate(used.tolist()):
        if _due(t):
            model.rebuild(k, t)
        ids = grid[t, :k]
        model.predict(k)
        hit2 = model.p2 == ids
        hit1 = (model.p1 == ids) & ~hit2
        f2, f1 = model.f2, model.f1
        share = width[:k] >> _ODDS
        both = f2 + f1
        start = np.where(hit2, 0, np.where(hit1, f2, both))
        freq = np.where(hit2, f2, np.where(hit1, f1, (1 << _ODDS) - both))
        lo, wi = low[:k] + share * start, share * freq
        put(every[:k], lo, wi)
        miss = np.flatnonzero(~(hit2 | hit1))
        if len(miss):
            share = wi[miss] >> model.bits
            at = model.base[miss] + miss + ids[miss]
            begin = model.start.take(at).astype(np.int64)
            lo2, wi2 = lo[miss] + share * begin, share * (model.start.take(at + 1) - begin)
            put(miss, lo2, wi2)
            lo[miss], wi[miss] = lo2, wi2
        low[:k], width[:k] = lo, wi
        model.learn(k, ids, hit2, hit1)
    out: list[bytes] = [b""] * n
    for at, i in enumerate(order):
        tail = int(low[at])
        last = np.array([tail >> 32, tail >> 16 & 0xFFFF, tail & 0xFFFF], np.uint16)
        out[i] = np.concatenate([words[at : place[at] : n], last]).astype("<u2").tobytes()
    return out


def decode_lanes(coded: list[bytes], lengths: np.ndarray, alphabet: int) -> list[np.ndarray]:
    """The numbers of each block, from its words and how many there are."""
    order, used = _by_length(lengths)
    n = len(coded)
    room = max((len(c) // 2 for c in coded), default=0) + 4
    words = np.zeros((room, n), np.int64)
    for at, i in enumerate(order):
        own = np.frombuffer(coded[i], "<u2")
        words[: len(own), at] = own
    code = (words[0] << 32) + (words[1] << 16) + words[2]
    words = words.ravel()
    model = _Model(n, alphabet)
    width, place = np.full(n, _TOP, np.int64), np.arange(n) + 3 * n
    grid = np.zeros((len(used), n), np.int64)
    every = np.arange(n)

    def refill(who, co, wi) -> None:
        small = np.flatnonzero(wi < _BOTTOM)
        if len(small):
            lanes = who[small]
            at = place[lanes]
            co[small] = (co[small] << 16) + words[at]
            wi[small] <<= 16
            place[lanes] = at + n

    def slot(co, share, most: int) -> np.ndarray:
        return np.minimum((co.view(np.uint64) // share.view(np.uint64)).view(np.int64), most)

    for t, k in enumerate(used.tolist()):
        if _due(t):
            model.rebuild(k, t)
        model.predict(k)
        f2, f1 = model.f2, model.f1
        share = width[:k] >> _ODDS
        target = slot(code[:k], share, (1 << _ODDS) - 1)
        both = f2 + f1
        hit2 = target < f2
        hit1 = (target < both) & ~hit2
        start = np.where(hit2, 0, np.where(hit1, f2, both))
        freq = np.where(hit2, f2, np.where(hit1, f1, (1 << _ODDS) - both))
        co, wi = code[:k] - share * start, share * freq
        refill(every[:k], co, wi)
        ids = np.where(hit2, model.p2, model.p1)
        miss = np.flatnonzero(~(hit2 | hit1))
        if len(miss):
            wi2, co2 = wi[miss], co[miss]
            share = wi2 >> model.bits
            target = slot(co2, share, (1 << model.bits) - 1)
            lost = model.code_of.take((miss << model.bits) + target).astype(np.int64)
            at = model.base[miss] + miss + lost
            begin = model.start.take(at).astype(np.int64)
            co2, wi2 = co2 - share * begin, share * (model.start.take(at + 1) - begin)
            refill(miss, co2, wi2)
            co[miss], wi[miss], ids[miss] = co2, wi2, lost
        code[:k], width[:k] = co, wi
        grid[t, :k] = ids
        model.learn(k, ids, hit2, hit1)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    for at, i in enumerate(order):
        out[i] = grid[: lengths[i], at]
    return out


def _alphabet(different: int) -> int:
    return max(256, 1 << max(0, different - 1).bit_length())


def _batches(count: int):
    """Ranges of at most LANES blocks, of like size: a short last range would idle."""
    parts = -(-count // LANES)
    for i in range(parts):
        yield range(count * i // parts, count * (i + 1) // parts)


def write_blocks(blocks: list[tuple[np.ndarray, bytes]]) -> list[bytes]:
    """Each block, at most 2**16 ids below 2**32 and a table of its documents, as bytes that can be
    read by themselves."""
    listed = [np.unique(ids, return_inverse=True) for ids, _ in blocks]
    out = [b""] * len(blocks)
    for own in _batches(len(blocks)):
        size = _alphabet(max(len(listed[i][0]) for i in own))  # one for all lanes
        for i, words in zip(own, encode_lanes([listed[i][1] for i in own], size)):
            ids, documents = blocks[i]
            steps = np.diff(listed[i][0], prepend=0).astype("<u4").tobytes()
            tables = zlib.compress(struct.pack("<I", len(steps)) + steps + documents, 1)
            sums = zlib.crc32(ids.astype("<u4").tobytes()), len(tables), zlib.crc32(tables + words)
            out[i] = _HEAD.pack(_MAGIC, 1, 0, size, len(ids), len(words) // 2, *sums) + tables + words
    return out


def read_blocks(payloads: list[bytes]) -> list[tuple[np.ndarray, bytes]]:
    """The ids and document table of each block; raises ValueError for a damaged one."""
    heads, bodies = [], []
    for payload in payloads:
        if len(payload) < _HEAD.size or payload[:4] != _MAGIC:
            raise ValueError("not a block of token ids")
        head, body = _HEAD.unpack_from(payload), payload[_HEAD.size :]
        if zlib.crc32(body) != head[8] or len(body) != head[7] + 2 * head[5]:
            raise ValueError("a block of token ids is damaged")
        heads.append(head)
        bodies.append(body)
    out: list[tuple[np.ndarray, bytes]] = [(np.zeros(0, np.int64), b"")] * len(payloads)
    sizes = sorted({(h[3], i) for i, h in enumerate(heads)})
    for size, group in itertools.groupby(sizes, key=lambda s: s[0]):
        members = [i for _, i in group]
        for own in ([members[i] for i in r] for r in _batches(len(members))):
            lengths = np.array([heads[i][4] for i in own], np.int64)
            coded = [bodies[i][heads[i][7] :] for i in own]
            for i, places in zip(own, decode_lanes(coded, lengths, size)):
                out[i] = _listed(places, heads[i], bodies[i])
    return out


def _listed(places: np.ndarray, head: tuple, body: bytes) -> tuple[np.ndarray, bytes]:
    """Ids and document table of a block whose places in the list of different ids are known."""
    tables = zlib.decompress(body[: head[7]])
    end = 4 + struct.unpack_from("<I", tables)[0]
    ids = np.cumsum(np.frombuffer(tables[4:end], "<u4").astype(np.int64))[places]
    if zlib.crc32(ids.astype("<u4").tobytes()) != head[6]:
        raise ValueError("a block of token ids does not decode to its checksum")
    return ids, tables[end:]


def crc32_joined(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of two byte strings in a row, from their own: first * x^(8n) + second, modulo the
    CRC's polynomial with bits in reverse."""

    def times(a: int, b: int) -> int:
        product = 0
        for bit in range(31, -1, -1):
            if a >> bit & 1:
                product ^= b
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return product

    shift, power, n = 1 << 31, 1 << 23, second_bytes  # 1 and x^8
    while n:
        if n & 1:
            shift = times(shift, power)
        power = times(power, power)
        n >>= 1
    return times(shift, first) ^ second
