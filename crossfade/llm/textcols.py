"""Vectorised word scanning over Arrow string columns.

Texts stay in Arrow's contiguous UTF-8 buffer. Words are found with a 256-entry
byte table and hashed with prefix sums, so that no Python object is made for a
word. Work goes in segments of bounded size, whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 18  # bytes hashed at once
CHUNK = 1 << 21  # bytes of whole documents handled at once

_BASE = 0x9E3779B97F4A7C15 | 5  # odd, 5 mod 8
_MASK = (1 << 64) - 1


def _table(is_word, lower: bool) -> np.ndarray:
    t = np.zeros(256, np.uint16)
    for b in range(256):
        c = b + 32 if lower and 0x41 <= b <= 0x5A else b
        if is_word(c):
            t[b] = c + 1
    return t


#: ``[^\x20\x09-\x0D]+`` after lower-casing A-Z.
BLANK_SPLIT = _table(lambda c: c != 0x20 and not 0x09 <= c <= 0x0D, lower=True)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: 0-9, a-z and all beyond ASCII.
ALNUM_SPLIT = _table(lambda c: 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80, lower=True)
#: The same as a table for bytes.translate: other bytes become blanks.
ALNUM_TRANSLATE = bytes(int(x) - 1 if x else 0x20 for x in ALNUM_SPLIT)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.n, self.pow, self.inv = 0, None, None

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            n = max(n, SEGMENT + 4096)
            self.pow, self.inv, self.n = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n), n
        return self.pow, self.inv


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes; a longer document is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def scan_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, spans: bool = False):
    """Words of consecutive documents.

    Returns the 64-bit hash of each word and, per document, the index of its
    first word (n + 1 entries); with ``spans`` also the byte range of each word.
    Words never cross documents. A segment is cut where a word ends.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    hashes, firsts, lasts = [], [], []
    s = lo
    while s < hi:
        e = min(s + SEGMENT, hi)
        # a word may go on beyond the segment: extend it to the word's end
        while e < hi and table[data[e - 1]] and table[data[e]] and offsets[np.searchsorted(offsets, e)] != e:
            stop = min(e + 4096, hi)
            gap = np.flatnonzero(table[data[e:stop]] == 0)
            after = int(offsets[np.searchsorted(offsets, e)])
            stop = min(e + int(gap[0]) if len(gap) else stop, after)
            e = stop
        m = table[data[s:e]]
        word = m > 0
        n = e - s
        broken = np.zeros(n + 1, bool)
        broken[offsets[np.searchsorted(offsets, s) : np.searchsorted(offsets, e, "right")] - s] = True
        broken[0] = broken[n] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | broken[1:n]
        last = word.copy()
        last[:-1] &= ~word[1:] | broken[1:n]
        a, b = np.flatnonzero(first), np.flatnonzero(last)
        if len(a):
            power, inverse = _POWERS.upto(n)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(m * power[:n], out=total[1:])
            hashes.append(mix((total[b + 1] - total[a]) * inverse[a]))
            firsts.append(a + s)
            lasts.append(b + 1 + s)
        s = e
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    a = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
    bounds = np.searchsorted(a, offsets)
    if spans:
        return h, bounds, a, (np.concatenate(lasts) if lasts else np.zeros(0, np.int64))
    return h, bounds
