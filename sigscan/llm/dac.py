"""Directly addressable codes: integers cut into chunk levels, with continuation bitmaps and rank directories.

A value's low bits are an entry of level 0. If bits remain, its continuation
bit is set and the next bits are the entry of level 1 whose index is the number
of set continuation bits before it; and so on. Rank directories (one 32-bit
count for every 512 bits) make that index a constant-time lookup, so any value
is read without decoding another. Level widths are multiples of 4 bits, chosen
for the least size (Brisaboa, Ladra, Navarro, 2013).
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from functools import cache

import numpy as np

_MAGIC = b"SDAC0001"
_BLOCK = 512


def _plan(lengths: np.ndarray) -> list[int]:
    """Widths of the levels for a histogram of bit lengths (index: bits), by dynamic programming."""
    top = max(4, -(-int(np.flatnonzero(lengths)[-1] if lengths.any() else 1) // 4) * 4)
    above = lengths[::-1].cumsum()[::-1]
    longer = lambda b: int(above[b + 1]) if b + 1 < len(above) else 0

    @cache
    def best(done: int) -> tuple[float, tuple[int, ...]]:
        if done >= top:
            return 0, ()
        n = longer(done) if done else int(lengths.sum())
        tries = []
        for w in range(4, top - done + 1, 4):
            cost, rest = best(done + w)
            tries.append((n * (w + (0 if done + w >= top else 1.0625)) + cost, (w, *rest)))
        return min(tries)

    return list(best(0)[1])


def _pack(x: np.ndarray, w: int) -> bytes:
    """Planes of 8 bits, low bits first, and one of 4 bits if w is odd in nibbles."""
    out = []
    for shift in range(0, w - w % 8, 8):
        out.append(((x >> np.uint32(shift)) & np.uint32(255)).astype(np.uint8).tobytes())
    if w % 8:
        n = ((x >> np.uint32(w - 4)) & np.uint32(15)).astype(np.uint8)
        n = np.append(n, np.zeros(len(n) % 2, np.uint8))
        out.append((n[::2] | (n[1::2] << 4)).tobytes())
    return b"".join(out)


def _plane_bytes(n: int, w: int) -> int:
    return n * (w // 8) + ((n + 1) // 2 if w % 8 else 0)


class Dac:
    """A sequence of unsigned 32-bit integers in levels; reads single values or all of them."""

    def __init__(self, data: bytes | memoryview):
        self.data = memoryview(data)
        self.n, k = struct.unpack_from("<QI", self.data, 0)
        at, self.levels = 12 + 12 * k, []
        for i in range(k):
            w, n = struct.unpack_from("<IQ", self.data, 12 + 12 * i)
            planes, at = at, at + _plane_bytes(n, w)
            bits = words = ranks = None
            if i < k - 1:
                size = -(-n // _BLOCK) * (_BLOCK // 8)
                words = np.frombuffer(self.data[at : at + size], np.uint8)
                at += size
                ranks = np.frombuffer(self.data[at : at + 4 * (-(-n // _BLOCK) + 1)], np.uint8).view("<u4") if n else np.zeros(1, "<u4")
                at += 4 * (-(-n // _BLOCK) + 1)
            self.levels.append((w, n, planes, words, ranks))
        self.size = at

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        x = np.ascontiguousarray(values, np.uint32)
        bits = np.zeros(33, np.int64)
        edges = np.concatenate([[0], 2 ** np.arange(33, dtype=np.float64)])
        bits += np.histogram(x, edges)[0]
        widths = _plan(bits)
        head, body = [], []
        for i, w in enumerate(widths):
            head.append(struct.pack("<IQ", w, len(x)))
            body.append(_pack(x, w))
            if i == len(widths) - 1:
                break
            more = x >> np.uint32(w) > 0
            padded = np.zeros(-(-len(x) // _BLOCK) * _BLOCK, bool)
            padded[: len(x)] = more
            body.append(np.packbits(padded, bitorder="little").tobytes())
            body.append(np.concatenate([[0], padded.reshape(-1, _BLOCK).sum(1).cumsum()]).astype("<u4").tobytes())
            x = x[more] >> np.uint32(w)
        return struct.pack("<QI", len(values), len(widths)) + b"".join(head + body)

    def _plane(self, planes: int, n: int, w: int, at: np.ndarray | None) -> np.ndarray:
        value = np.zeros(n if at is None else len(at), np.uint32)
        for k in range(w // 8):
            p = np.frombuffer(self.data[planes + k * n : planes + (k + 1) * n], np.uint8)
            value |= (p if at is None else p[at]).astype(np.uint32) << np.uint32(8 * k)
        if w % 8:
            start = planes + (w // 8) * n
            p = np.frombuffer(self.data[start : start + (n + 1) // 2], np.uint8)
            if at is None:
                nib = np.empty(2 * len(p), np.uint8)
                nib[::2], nib[1::2] = p & 15, p >> 4
                nib = nib[:n]
            else:
                nib = (p[at >> 1] >> ((at & 1) * 4).astype(np.uint8)) & 15
            value |= nib.astype(np.uint32) << np.uint32(w - 4)
        return value

    def get(self, index: np.ndarray) -> np.ndarray:
        """Values at the given positions, each by rank alone."""
        at = np.asarray(index, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("position out of range")
        out, live, shift = np.zeros(len(at), np.uint32), np.arange(len(at)), 0
        for w, n, planes, words, ranks in self.levels:
            out[live] |= self._plane(planes, n, w, at) << np.uint32(shift)
            if words is None or not len(live):
                break
            go = (words[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            live, at, shift = live[go], at[go], shift + w
            block = at // _BLOCK
            inside = np.bitwise_count(words.reshape(-1, _BLOCK // 8)[block]).astype(np.int64).cumsum(1)
            byte = (at % _BLOCK) >> 3
            before = np.where(byte > 0, inside[np.arange(len(at)), np.maximum(byte - 1, 0)], 0)
            tail = np.bitwise_count(words[at >> 3] & ((1 << (at & 7)) - 1).astype(np.uint8))
            at = ranks[block].astype(np.int64) + before + tail
        return out

    def all(self) -> np.ndarray:
        """The whole sequence."""
        out, live, shift = None, None, 0
        for w, n, planes, words, _ in self.levels:
            value = self._plane(planes, n, w, None)
            if out is None:
                out = value
            else:
                out[live] |= value << np.uint32(shift)
            if words is None:
                break
            more = np.flatnonzero(np.unpackbits(words, count=n, bitorder="little"))
            live, shift = more if live is None else live[more], shift + w
        return out


class Writer:
    """A file of segments: each holds whole documents' ids; a footer gives every segment's place."""

    def __init__(self, out, segment_ids: int = 1 << 20):
        self.out, self.limit = out, segment_ids
        self.keys, self.null, self.lens, self.parts, self.held = [], [], [], [], 0
        self.index, self.docs, self.ids = [], 0, 0
        self.at = self.out.write(_MAGIC)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key or 0)
        self.null.append(key is None)
        self.lens.append(len(ids))
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.limit:
            self._flush()

    def add_many(self, keys: list[int | None], lens: np.ndarray, ids: np.ndarray) -> None:
        """Add documents whose ids follow each other."""
        self.keys += [k or 0 for k in keys]
        self.null += [k is None for k in keys]
        self.lens += lens.tolist()
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.limit:
            self._flush()

    def _flush(self) -> None:
        if not self.keys:
            return
        body = struct.pack("<Q", len(self.keys)) + np.array(self.keys, "<i8").tobytes() + np.array(self.null, np.uint8).tobytes() + np.array(self.lens, "<u8").tobytes() + Dac.encode(np.concatenate(self.parts))
        self.index.append((self.at, len(body), self.docs, self.ids))
        self.out.write(body)
        self.at += len(body)
        self.docs += len(self.keys)
        self.ids += self.held
        self.keys, self.null, self.lens, self.parts, self.held = [], [], [], [], 0

    def close(self) -> None:
        self._flush()
        foot = b"".join(struct.pack("<4Q", *x) for x in self.index) + struct.pack("<3Q", len(self.index), self.docs, self.ids)
        self.out.write(foot + _MAGIC)


class Reader:
    """Reads a file of :class:`Writer` from a seekable stream: segments in turn, or any token by its position."""

    def __init__(self, stream):
        self.stream = stream
        end = stream.size() if callable(getattr(stream, "size", None)) else stream.seek(0, 2)
        stream.seek(end - 32)
        tail = stream.read(32)
        if tail[24:] != _MAGIC:
            raise ValueError("not a complete token file")
        n, self.docs, self.ids = struct.unpack("<3Q", tail[:24])
        stream.seek(end - 32 - 32 * n)
        self.index = list(struct.iter_unpack("<4Q", stream.read(32 * n)))

    def _segment(self, k: int):
        at, size, _, _ = self.index[k]
        self.stream.seek(at)
        body = memoryview(self.stream.read(size))
        (n,) = struct.unpack_from("<Q", body, 0)
        keys = np.frombuffer(body[8 : 8 + 8 * n], "<i8")
        null = np.frombuffer(body[8 + 8 * n : 8 + 9 * n], np.uint8).astype(bool)
        lens = np.frombuffer(bytes(body[8 + 9 * n : 8 + 17 * n]), "<u8").astype(np.int64)
        return keys, null, lens, Dac(bytes(body[8 + 17 * n :]))

    def documents(self, check: bool = False):
        """Yield (key or None, position of the first id in this file, ids).

        ``check``: the last id of each document is also read by its position alone, and must agree.
        """
        for k, (_, _, _, first) in enumerate(self.index):
            keys, null, lens, code = self._segment(k)
            ids, ends = code.all(), lens.cumsum()
            if check and (code.get(ends[lens > 0] - 1) != ids[ends[lens > 0] - 1]).any():
                raise ValueError("random access and sequential reading differ")
            at = 0
            for key, gone, n in zip(keys.tolist(), null.tolist(), lens.tolist(), strict=True):
                yield None if gone else key, first + at, ids[at : at + n]
                at += n

    def _bytes(self, at: int, size: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(size)

    def token(self, position: int) -> int:
        """The id at a position of this file. Of each level it reads the id's own bytes, one block of continuation bits and one rank."""
        if not 0 <= position < self.ids:
            raise IndexError("position out of range")
        k = bisect_right(self.index, position, key=lambda x: x[3]) - 1
        start = self.index[k][0]
        (docs,) = struct.unpack("<Q", self._bytes(start, 8))
        code = start + 8 + 17 * docs
        _, levels = struct.unpack("<QI", self._bytes(code, 12))
        head = self._bytes(code + 12, 12 * levels)
        i, at, value, shift = position - self.index[k][3], code + 12 + 12 * levels, 0, 0
        for level, (w, n) in enumerate(struct.iter_unpack("<IQ", head)):
            for p in range(w // 8):
                value |= self._bytes(at + p * n + i, 1)[0] << (shift + 8 * p)
            if w % 8:
                value |= (self._bytes(at + (w // 8) * n + (i >> 1), 1)[0] >> (4 * (i & 1)) & 15) << (shift + w - 4)
            if level == levels - 1:
                break
            bits = at + _plane_bytes(n, w)
            ranks = bits + -(-n // _BLOCK) * (_BLOCK // 8)
            block, inside = divmod(i, _BLOCK)
            word = int.from_bytes(self._bytes(bits + block * (_BLOCK // 8), _BLOCK // 8), "little")
            if not word >> inside & 1:
                break
            i = struct.unpack("<I", self._bytes(ranks + 4 * block, 4))[0] + (word & ((1 << inside) - 1)).bit_count()
            at, shift = ranks + 4 * (-(-n // _BLOCK) + 1), shift + w
        return value
