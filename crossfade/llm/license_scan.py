"""Fuzzy search for short license notices.

Texts are normalised to lower-case words with one blank between. An error
bound of k splits a notice into k + 1 pieces, of which a match within k edits
keeps one whole (the pigeonhole principle): exact searches for the pieces
locate candidates, and the regex library's bounded-error matching verifies
each one and gives its span and edits. Words that tell one license from
another are no part of the fuzzy pattern: they stand in a match unchanged, in
their place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back
from .textcols import ALNUM_TRANSLATE


@dataclass(frozen=True)
class Notice:
    """A notice in normalised words; ``exact`` are the words that must not be edited."""

    phrase: str
    label: str
    exact: tuple[str, ...] = ()
    base: bool = False

    @property
    def errors(self) -> int:
        """Edits allowed: one for every eight characters that may be edited, three at most, none for notices under 16 characters."""
        free = len(self.phrase) - sum(len(w) + 1 for w in self.exact)
        return 0 if len(self.phrase) < 16 else min(3, free // 8)


# fixed values: the notices searched for
NOTICES = (
    Notice("under the mit license", "mit", ("mit",), True),
    Notice("apache license version 2", "apache-2", ("2",), True),
    Notice("cc by nc", "cc-by-nc", ("cc", "by", "nc"), True),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    Notice("gnu general public license version 2", "gpl-2", ("2",)),
    Notice("gnu general public license version 3", "gpl-3", ("3",)),
    Notice("gnu lesser general public license", "lgpl", ("lesser",)),
    Notice("mozilla public license version 2", "mpl-2", ("2",)),
    Notice("redistribution and use in source and binary forms with or without modification", "bsd"),
    Notice("creative commons attribution noncommercial", "cc-by-nc"),
    Notice("all rights reserved", "all-rights-reserved"),
)


@dataclass(frozen=True)
class Match:
    """A notice found: word range (end exclusive), edits, and whether it is an exact base place."""

    label: str
    first: int
    last: int
    errors: int
    size: int
    base: bool


def _pattern(notice: Notice) -> bytes:
    """The notice with errors in each stretch of free words; the best match in all is sought."""
    runs: list[list[str]] = []
    for w in notice.phrase.split():
        if w in notice.exact or not runs or runs[-1][0] in notice.exact:
            runs.append([w])
        else:
            runs[-1].append(w)
    quoted = ((regex.escape(" ".join(r).encode()), r[0] in notice.exact) for r in runs)
    body = b" ".join(q if whole else b"(?:%s){e<=%d}" % (q, notice.errors) for q, whole in quoted)
    return rb"(?b)(?<![^ ])%s(?![^ ])" % body


class Searcher:
    """Finds ``notices`` in texts; built once for a worker."""

    def __init__(self, notices: tuple[Notice, ...] = NOTICES) -> None:
        self.notices = []
        for n in notices:
            raw, k = n.phrase.encode(), n.errors
            cuts = [round(i * len(raw) / (k + 1)) for i in range(k + 2)]
            seeds = [(raw[a:b], a) for a, b in zip(cuts, cuts[1:])] if k else []
            self.notices.append((n, raw, k, seeds, regex.compile(_pattern(n)) if k else None))

    def find(self, text: str | None) -> tuple[int, list[Match]]:
        """The number of words and all matches, by place."""
        if not text:
            return 0, []
        words = text.encode("utf-8", "surrogatepass").translate(ALNUM_TRANSLATE).split()
        norm = b" %s " % b" ".join(words)
        out: list[Match] = []
        for n, raw, k, seeds, fuzzy in self.notices:
            size, taken = n.phrase.count(" ") + 1, None
            p = norm.find(b" %s " % raw)
            counted, first = 0, -1
            while p >= 0:
                taken = taken or bytearray(len(norm))
                first, counted = first + norm.count(b" ", counted, p + 1), p + 1
                out.append(Match(n.label, first, first + size, 0, len(raw), n.base))
                taken[p + 1 : p + 1 + len(raw)] = b"\1" * len(raw)
                p = norm.find(b" %s " % raw, p + 1)
            tried = set()
            for seed, offset in seeds:
                p = norm.find(seed)
                while p >= 0:
                    # a match starts within k of where the seed has it, and the word after its end is seen too
                    lo = max(p - offset - k - 1, 0)
                    hi = min(p - offset + len(raw) + 2 * k + 2, len(norm))
                    if lo not in tried and not (taken and taken[p]):
                        tried.add(lo)
                        m = fuzzy.search(norm, lo, hi)
                        if m and sum(m.fuzzy_counts) <= k:
                            a, b = m.start() + (len(m[0]) - len(m[0].lstrip())), m.end() - (len(m[0]) - len(m[0].rstrip()))
                            taken = taken or bytearray(len(norm))
                            if not any(taken[a:b]):
                                taken[a:b] = b"\1" * (b - a)
                                first = norm.count(b" ", 0, a) - 1
                                out.append(Match(n.label, first, first + len(m[0].split()), sum(m.fuzzy_counts), len(raw), False))
                    p = norm.find(seed, p + 1)
        return len(words), sorted(out, key=lambda m: (m.first, m.last, m.label))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """Per document: doc_id, n_words, matches (label, first, last, errors, score, base), by place.

    ``first`` and ``last`` are word indexes from 0, ``last`` exclusive; score is
    1 - errors / length; ``base`` marks exact places of base notices. Null and
    empty texts have no words and no matches; repeated rows are scanned one by
    one; other columns are ignored.
    """

    @give_back
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(notices)
        kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("errors", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))
        for batch in batches:
            got = [searcher.find(t.as_py()) for t in batch.column(1)]
            matches = [[{"label": m.label, "first": m.first, "last": m.last, "errors": m.errors, "score": max(0.0, 1 - m.errors / m.size), "base": m.base} for m in found] for _, found in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array(matches, kind)], ["doc_id", "n_words", "matches"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, matches array<struct<label:string,first:long,last:long,errors:long,score:double,base:boolean>>")
