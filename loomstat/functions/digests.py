"""The first 32 bits of many md5 digests at a time, as ``conv(substr(md5(text), 1, 8), 16, 10)`` gives them."""

from __future__ import annotations

import hashlib
import math
import threading

import numpy as np
import pyarrow as pa

_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_SHIFTS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_STARTS = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes of a message that fits one block, and digests taken in one turn.
ONE_BLOCK, TURN = 55, 32768
_LOW = 0xFFFFFFFF
# Arrays without dimensions: NumPy takes them faster than scalars.
_K_AT, _BY = ([np.array(x, np.uint32) for x in xs] for xs in (_K, range(33)))
_scratch = threading.local()


def _first_word(words: list, n: int) -> np.ndarray:
    """The digests' first 32 bits for blocks given as 16 words, each an array of ``n`` or one number for all."""
    a, b, c, d = _STARTS
    begun = 0
    while begun < 15 and isinstance(words[begun], int):  # what all blocks share is worked out once
        f = ((b & c) | (~b & d)) + a + _K[begun] + words[begun] & _LOW
        shift = _SHIFTS[0][begun % 4]
        a, b, c, d = d, (b + (f << shift | f >> 32 - shift)) & _LOW, b, c
        begun += 1
    if getattr(_scratch, "rows", np.empty((0, 0))).shape[1] != n:
        _scratch.rows = np.empty((6, n), np.uint32)
    for row, x in zip(_scratch.rows, (a, b, c, d), strict=False):
        row[:] = x
    a, b, c, d, f, g = _scratch.rows
    for i in range(begun, 61):  # the last three steps do not reach the first word
        turn, k = divmod(i, 16)
        if turn == 0:
            np.bitwise_xor(c, d, f)
            np.bitwise_and(f, b, f)
            np.bitwise_xor(f, d, f)
        elif turn == 1:
            k = (5 * i + 1) % 16
            np.bitwise_xor(b, c, f)
            np.bitwise_and(f, d, f)
            np.bitwise_xor(f, c, f)
        elif turn == 2:
            k = (3 * i + 5) % 16
            np.bitwise_xor(b, c, f)
            np.bitwise_xor(f, d, f)
        else:
            k = 7 * i % 16
            np.invert(d, f)
            np.bitwise_or(f, b, f)
            np.bitwise_xor(f, c, f)
        word = words[k]
        np.add(f, a, f)
        if not isinstance(word, int):
            np.add(f, word, f)
            word = 0
        np.add(f, np.array(_K[i] + word & _LOW, np.uint32) if word else _K_AT[i], f)
        shift = _SHIFTS[turn][i % 4]
        np.left_shift(f, _BY[shift], g)
        np.right_shift(f, _BY[32 - shift], f)
        np.bitwise_or(f, g, f)
        np.add(f, b, a)
        a, b, c, d = d, a, b, c
    return (b + np.uint32(_STARTS[0])).byteswap()


class Endings:
    """The ends of messages, to be hashed after any beginning."""

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.binary()).combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts.cast(pa.binary())
        self.n, self.texts = len(texts), texts
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + self.n + 1].astype(np.int64) if self.n else np.zeros(1, np.int64)
        self.lengths = np.diff(ends)
        self.longest = int(self.lengths.max(initial=0))
        self.rows = np.zeros((self.n, self.longest + 1), np.uint8)
        data = np.frombuffer(texts.buffers()[2], np.uint8) if self.n and ends[-1] > ends[0] else np.zeros(0, np.uint8)
        at = np.arange(self.longest)
        inside = at < self.lengths[:, None]
        self.rows[:, : self.longest][inside] = data[ends[0] : ends[-1]]
        self.rows[np.arange(self.n), self.lengths] = 0x80
        self.shifted: dict[int, np.ndarray] = {}

    def _words(self, shift: int) -> np.ndarray:
        """The endings and the mark behind them as words, begun ``shift`` bytes into the first."""
        if shift not in self.shifted:
            wide = np.zeros((self.n, -(-(shift + self.longest + 1) // 4) * 4), np.uint8)
            wide[:, shift : shift + self.longest + 1] = self.rows
            self.shifted[shift] = np.ascontiguousarray(wide.view("<u4").T)
        return self.shifted[shift]

    def after(self, beginnings: list[bytes]) -> np.ndarray:
        """First 32 bits for each beginning, all of one length, (rows) and ending (columns)."""
        size, times = len(beginnings[0]), len(beginnings)
        if size + self.longest > ONE_BLOCK:
            digest = lambda x: int.from_bytes(hashlib.md5(x, usedforsecurity=False).digest()[:4], "big")
            return np.array([[digest(x + y) for y in self.texts.to_pylist()] for x in beginnings], np.uint32).reshape(times, self.n)
        whole, shift = divmod(size, 4)
        heads = np.zeros((times, whole * 4 + 4), np.uint8)
        heads[:, :size] = np.frombuffer(b"".join(beginnings), np.uint8).reshape(times, size)
        heads, tails, words = heads.view("<u4"), self._words(shift), [0] * 16
        for k in range(whole):
            words[k] = int(heads[0, k]) if (heads[:, k] == heads[0, k]).all() else np.repeat(heads[:, k], self.n)
        for k, tail in enumerate(tails):
            words[whole + k] = np.tile(tail, times) if times > 1 else tail
        if shift:
            words[whole] = words[whole] | np.repeat(heads[:, whole], self.n)
        bits = ((self.lengths + size) * 8).astype(np.uint32)
        words[14] = int(bits[0]) if self.n and (bits == bits[0]).all() else np.tile(bits, times)
        return _first_word(words, times * self.n).reshape(times, self.n)


def turns(names: list[bytes], width: int) -> list[list[int]]:
    """Places in ``names`` parted into runs of one length, few enough for one turn over ``width`` endings."""
    most, out = max(1, TURN // max(1, width)), []
    for k, name in enumerate(names):
        if out and len(out[-1]) < most and len(names[out[-1][0]]) == len(name):
            out[-1].append(k)
        else:
            out.append([k])
    return out
