"""Quality rules: counts of words, symbols and repeats, and compression bands.

Prose compresses to a share of its bytes that depends on its length alone.
Each text, and each of its chunks of a fixed size, is compressed with
zstandard; a share below the band for its length tells of repetition, one
above it of noise such as encoded data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back

SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\x0b\x0c\r"
_PIECE = 1 << 20  # bytes split into words at once


@dataclass(frozen=True)
class Band:
    """Limits of compressed bytes to bytes, for texts of ``least`` bytes and more."""

    least: int
    low: float
    high: float


#: By length, at level 3: half of what prose compresses to, and 1.4 times as much (base64 comes to 0.76). Under 128 bytes the frame and the first literals outweigh the text, so that no limit holds.
BANDS = (
    Band(128, 0.36, 1.04),
    Band(256, 0.32, 0.92),
    Band(512, 0.28, 0.80),
    Band(1024, 0.25, 0.72),
    Band(4096, 0.22, 0.66),
    Band(16384, 0.18, 0.62),
)
#: Bytes of a chunk, and the share of a text's bytes that may lie in chunks out of band.
CHUNK, BAD_SHARE = 4096, 0.2


def _word_codes(raw: bytes) -> tuple[np.ndarray, int]:
    """A number for each word, equal for equal words, and how many differ. A long text is split piece by piece."""
    ids: dict[bytes, int] = {}
    found, at = [], 0
    while at < len(raw):
        end = min(at + _PIECE, len(raw))
        while end < len(raw) and raw[end] not in _BLANKS:
            end += 1
        found.append(np.fromiter((ids.setdefault(w, len(ids)) for w in raw[at:end].split()), np.int64))
        at = end
    return (np.concatenate(found) if found else np.zeros(0, np.int64)), len(ids)


def repeated_words(codes: np.ndarray, distinct: int, size: int = 5) -> int:
    """Words inside windows of ``size`` words that are found twice or more. Windows are numbered, not hashed, so that no two are confused."""
    n = len(codes) - size + 1
    if n < 2:
        return 0
    keys, span = codes[:n], distinct
    for step in range(1, size):
        if span * distinct >= 1 << 62:
            seen, keys = np.unique(keys, return_inverse=True)
            span = len(seen)
        keys, span = keys * distinct + codes[step : step + n], span * distinct
    _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[which] > 1)
    edges = np.zeros(len(codes) + 1, np.int64)
    edges[starts] += 1
    edges[starts + size] -= 1
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def repeated_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[bytes] = set()
    n = 0
    for line in raw.split(b"\n") if b"\n" in raw else ():
        if line.strip(_BLANKS):
            n += line in seen
            seen.add(line)
    return n


class Compressor:
    """Compressed shares against the bands; one for a worker."""

    def __init__(self, bands: tuple[Band, ...] = BANDS, chunk: int = CHUNK, level: int = 3) -> None:
        self.bands, self.chunk = sorted(bands, key=lambda b: b.least), chunk
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False)

    def share(self, raw: bytes) -> float:
        return len(self.zstd.compress(raw)) / len(raw)

    def side(self, size: int, share: float) -> int:
        """-1 below the band of ``size``, 1 above it, else 0."""
        band = next((b for b in reversed(self.bands) if size >= b.least), None)
        return 0 if band is None else -1 if share < band.low else int(share > band.high)

    def judge(self, raw: bytes, bad_share: float) -> tuple[float | None, int, int, str | None]:
        """The whole's share, bytes in chunks that are repetitive and incompressible, and the reason to reject."""
        if not raw:
            return None, 0, 0, None
        whole, bad = self.share(raw), {-1: 0, 0: 0, 1: 0}
        if len(raw) > self.chunk:
            for at in range(0, len(raw), self.chunk):
                part = raw[at : at + self.chunk]
                bad[self.side(len(part), self.share(part))] += len(part)
        side = self.side(len(raw), whole)
        if not side:
            side = -1 if bad[-1] > bad_share * len(raw) else int(bad[1] > bad_share * len(raw))
        return whole, bad[-1], bad[1], (None, "incompressible", "repetitive")[side]


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: tuple[Band, ...] = BANDS, chunk: int = CHUNK, bad_share: float = BAD_SHARE, level: int = 3
) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bytes, ratio, low_bytes, high_bytes, reason.

    Words are runs without blanks, counted as they stand; ``word_chars`` are
    their code points. ``ratio`` is compressed bytes to bytes of the whole
    text (null for none), ``low_bytes`` and ``high_bytes`` lie in chunks below
    and above their bands, and ``reason`` is ``repetitive``,
    ``incompressible`` or null: by the whole text, or by more than
    ``bad_share`` of its bytes in such chunks. Null and empty texts have
    zeros, no ratio and no reason; a long text is one of many words; repeated
    rows are judged one by one; other columns are ignored.
    """

    @give_back
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = Compressor(bands, chunk, level)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                codes, distinct = _word_codes(raw)
                chars = sum(raw.count(bytes((c,))) for c in _BLANKS)
                chars = len(raw) - _continuations(raw) - chars
                symbols = sum(raw.count(bytes((c,))) for c in SYMBOLS)
                rows.append((len(codes), chars, symbols, repeated_lines(raw), repeated_words(codes, distinct), len(raw), *zstd.judge(raw, bad_share)))
            columns = list(zip(*rows)) or [()] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, _TYPES.values()))], ["doc_id", *_TYPES])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = {pa.int64(): "long", pa.float64(): "double", pa.string(): "string"}
    return rows.mapInArrow(scan, f"doc_id {dict(rows.dtypes)['doc_id']}, " + ", ".join(f"{c} {kinds[t]}" for c, t in _TYPES.items()))


_TYPES = {c: pa.int64() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes")}
_TYPES |= {"ratio": pa.float64(), "low_bytes": pa.int64(), "high_bytes": pa.int64(), "reason": pa.string()}


def _continuations(raw: bytes) -> int:
    """Bytes that go on with a code point."""
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80)) if raw else 0
