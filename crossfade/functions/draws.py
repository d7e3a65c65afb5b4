"""Reproducible draws: md5 of a seed and a key, alike on every engine and partitioning."""

from __future__ import annotations

import hashlib
import math
import struct

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(seed, *parts) -> Column:
    """The md5 hex string of the parts joined by colons; sorting by it is a shuffle."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)) if not isinstance(seed, Column) else seed.cast("string"), *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def unit(key: Column) -> Column:
    """A draw in [0, 1) from the first 52 bits of an md5 hex string."""
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


_SINES = [int(abs(math.sin(i + 1)) * (1 << 32)) & 0xFFFFFFFF for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_FEW, _RUN = 64, 8192  # fewer keys are digested one by one; so many at a time stay in a core's cache


def _compress(state: list[np.ndarray], words: list[np.ndarray]) -> list[np.ndarray]:
    """A step of md5 for many messages at once: words that all of them share have one element."""
    a, b, c, d = state
    for i in range(64):
        turn, at = divmod(i, 16)
        if turn == 0:
            f, g = d ^ (b & (c ^ d)), i
        elif turn == 1:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif turn == 2:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f = f + a + (words[g] + np.uint32(_SINES[i]))
        by = _TURNS[turn][at % 4]
        a, d, c, b = d, c, b, b + ((f << np.uint32(by)) | (f >> np.uint32(32 - by)))
    return [x + y for x, y in zip(state, (a, b, c, d), strict=True)]


def units(head: str, first: int, last: int) -> np.ndarray:
    """Draws in [0, 1) by the keys ``head`` and a number from ``first`` to ``last``, as ``unit`` has them."""
    start, parts, lo = head.encode(), [], first
    while lo <= last:
        digits = len(str(lo))
        hi = min(last, 10**digits - 1, lo + _RUN - 1)
        if hi - lo < _FEW:
            bits = np.array([int.from_bytes(hashlib.md5(start + b"%d" % i).digest()[:8], "big") for i in range(lo, hi + 1)], np.uint64)
        else:
            length = len(start) + digits
            blocks = (length + 8) // 64 + 1
            text = np.zeros((hi - lo + 1, 64 * blocks), np.uint8)
            text[:, : len(start)] = np.frombuffer(start, np.uint8)
            left = np.arange(lo, hi + 1)
            for at in range(length - 1, len(start) - 1, -1):
                text[:, at] = 48 + left % 10
                left = left // 10
            text[:, length] = 128
            text[:, -8:] = np.frombuffer(struct.pack("<Q", 8 * length), np.uint8)
            words = np.ascontiguousarray(text.view("<u4").astype(np.uint32).T)
            state = [np.array([x], np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
            own = range(len(start) // 4, (length - 1) // 4 + 1)  # the words that differ
            for k in range(blocks):
                state = _compress(state, [words[i] if i in own else words[i, :1] for i in range(16 * k, 16 * k + 16)])
            a, b = (np.broadcast_to(x, hi - lo + 1).byteswap().astype(np.uint64) for x in state[:2])
            bits = (a << np.uint64(32)) | b
        parts.append((bits >> np.uint64(12)).astype(float) / (1 << 52))
        lo = hi + 1
    return np.concatenate(parts) if parts else np.zeros(0)
