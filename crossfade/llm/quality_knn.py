"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text's terms are its words, by a hash, pairs of neighbouring byte classes and
a few measures of repetition, all from whole texts. Term weights (tf-idf) and
the latent axes (truncated SVD) are fitted on a bounded sample of labelled
rows, whose latent vectors are broadcast; every document takes exact cosine
products with all of them, block by block, and its nearest neighbours vote with
their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import give_back
from .textcols import BLANK_SPLIT, buffers, mix, scan_words

SAMPLE_PER_LABEL = 1500  # labelled rows of each label that are fitted on, at most
AXES = 32
NEIGHBOURS = 15
_BLOCK_BYTES = 1 << 20
_BINS = 8


def _classes() -> np.ndarray:
    """Byte classes: each small letter, capitals, digits, blank, line end, each common mark, others, beyond ASCII."""
    out = np.zeros(256, np.int64)
    marks = "!?.,;:|#$%&*@'\"()-_=<>/"
    for b in range(256):
        c = chr(b)
        if "a" <= c <= "z":
            out[b] = b - 0x61
        elif "A" <= c <= "Z":
            out[b] = 26
        elif "0" <= c <= "9":
            out[b] = 27
        elif c == "\n":
            out[b] = 29
        elif c.isspace() and b < 0x80:
            out[b] = 28
        elif b >= 0x80:
            out[b] = 30
        elif c in marks:
            out[b] = 32 + marks.index(c)
        else:
            out[b] = 31
    return out


_CLASS = _classes()
_N = int(_CLASS.max()) + 1
_WORDS = 1024  # buckets of words
_PAIRS = _N * _N
TERMS = _PAIRS + 4 * _BINS + _WORDS


def _bins(share: np.ndarray) -> np.ndarray:
    """Soft one-hot of shares in [0, 1]."""
    x = np.clip(share, 0, 1) * (_BINS - 1)
    lo = np.minimum(x.astype(np.int64), _BINS - 2)
    out = np.zeros((len(share), _BINS))
    at = np.arange(len(share))
    out[at, lo], out[at, lo + 1] = 1 - (x - lo), x - lo
    return out


def _repeated(hashes: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """Per document: the share of its ``width``-word sequences that it has had before."""
    n = max(len(hashes) - width + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for k in range(width if n else 0):
        rolled = mix(rolled * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n])
    out = np.zeros(len(bounds) - 1)
    for d in range(len(out)):
        own = rolled[bounds[d] : max(bounds[d + 1] - width + 1, bounds[d])]
        if len(own) > 1:
            out[d] = 1 - len(np.unique(own)) / len(own)
    return out


def _stuttered(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per document: the share of its words that repeat the word before."""
    same = np.concatenate([[0], np.cumsum(np.concatenate([[False], hashes[1:] == hashes[:-1]]))]) if len(hashes) else np.zeros(1, np.int64)
    lo, hi = np.minimum(bounds[:-1] + 1, bounds[1:]), bounds[1:]
    return (same[hi] - same[lo]) / np.maximum(np.diff(bounds) - 1, 1)


def term_counts(column: pa.Array) -> Iterator[np.ndarray]:
    """Rows of term weights before idf, a block of documents at a time; a text without bytes is a row of zeros."""
    data, offsets = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and offsets[j + 1] - offsets[i] <= _BLOCK_BYTES:
            j += 1
        part, docs = offsets[i : j + 1], j - i
        out = np.zeros((docs, TERMS), np.float32)
        counts = np.zeros(docs * _PAIRS)
        for lo in range(int(part[0]), int(part[-1]), _BLOCK_BYTES):
            hi = min(lo + _BLOCK_BYTES + 1, int(part[-1]))  # the pair at the seam belongs to the earlier piece
            c = _CLASS[data[lo:hi]]
            owner = np.searchsorted(part, np.arange(lo, hi), "right") - 1
            same = owner[1:] == owner[:-1]
            counts += np.bincount((owner[:-1] * _PAIRS + c[:-1] * _N + c[1:])[same], minlength=len(counts))
        counts = counts.reshape(docs, -1)
        out[:, :_PAIRS] = _unit(counts)
        words, bounds = scan_words(data, part, BLANK_SPLIT)
        some = (np.diff(bounds) > 0)[:, None]
        upper = counts.reshape(docs, _N, _N)[:, 26, :].sum(1) / np.maximum(counts.sum(1), 1)
        measures = (_repeated(words, bounds, 1), _repeated(words, bounds, 3), _stuttered(words, bounds), upper)
        out[:, _PAIRS:-_WORDS] = 0.35 * np.hstack([_bins(m) for m in measures]) * some
        place = np.repeat(np.arange(docs), np.diff(bounds)) * _WORDS + (words % np.uint64(_WORDS)).astype(np.int64)
        out[:, -_WORDS:] = 0.5 * _unit(np.bincount(place, minlength=docs * _WORDS).reshape(docs, -1))
        yield out
        i = j


def _unit(counts: np.ndarray) -> np.ndarray:
    """Roots of counts, rows of length 1 or 0."""
    tf = np.sqrt(counts)
    norm = np.linalg.norm(tf, axis=1, keepdims=True)
    return tf / np.where(norm > 0, norm, 1)


@dataclass
class Model:
    """Idf weights, latent axes, and the labelled vectors that vote; its size depends on the sample bound alone."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int

    def __post_init__(self) -> None:
        self.onto = self.idf.astype(np.float64)[:, None] * self.axes

    def project(self, terms: np.ndarray) -> np.ndarray:
        z = terms @ self.onto
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        return np.divide(z, norm, out=np.zeros_like(z), where=norm > 1e-12)

    def score(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(terms), self.prior)
        z = self.project(terms)
        cos = z @ self.vectors.T
        k = min(self.neighbours, cos.shape[1])
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        w = np.clip(np.take_along_axis(cos, near, 1), 0, None) ** 8
        total = w.sum(1)
        vote = (w * self.labels[near]).sum(1)
        out = np.where(total > 1e-9, vote / np.maximum(total, 1e-9), self.prior)
        return np.clip(out, 0, 1)


def _axes(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """The first k right singular vectors of x, by subspace iteration: no square matrix of terms is made."""
    k = min(k, *x.shape)
    q = np.random.default_rng(0).standard_normal((x.shape[1], min(k + 8, *x.shape))).astype(x.dtype)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, turn = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ turn.T)[:, :k]


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = SAMPLE_PER_LABEL, axes: int = AXES, neighbours: int = NEIGHBOURS) -> Model:
    """Fit on at most ``per_label`` labelled documents of each label, taken in the order of a hash of their id.

    Labels other than 0 and 1, null ids and labels without a document are left
    out; a document with several labels counts with the largest. Documents that
    repeat an id all take part. Without any labelled document the model gives
    0.5 to all; a text without terms gets the share of label 1 in the sample.
    """
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("labelled")).agg(F.max(label_col).cast("int").alias("y"))
    parts = [marks.where(F.col("y") == y).orderBy(F.xxhash64(F.col("labelled").cast("string")), "labelled").limit(per_label) for y in (0, 1)]
    chosen = {r.labelled: r.y for p in parts for r in p.collect()}
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(chosen)  # 2 * per_label ids at most

    @give_back
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            at = [i for i, x in enumerate(ids) if x in sent.value]
            if at:
                terms = [_packed(r) for block in term_counts(batch.column(1).take(pa.array(at))) for r in block]
                yield pa.RecordBatch.from_arrays([pa.array([str(ids[i]) for i in at]), pa.array([sent.value[ids[i]] for i in at], pa.int32()), pa.array(terms, pa.binary())], ["i", "y", "terms"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(scan, "i string, y int, terms binary")
    # of an id that repeats beyond reason, as many rows as there are places in the sample
    rows = rows.orderBy(F.xxhash64("i"), "i", "terms").limit(2 * per_label).toPandas()
    rows = rows.sort_values(["i", "terms"], ignore_index=True)
    if rows.empty:
        return Model(np.ones(TERMS), np.zeros((TERMS, 1)), np.zeros((0, 1)), np.zeros(0), 0.5, neighbours)
    x = np.zeros((len(rows), TERMS), np.float32)
    for i, raw in enumerate(rows.pop("terms")):
        _unpack(raw, x[i])
    y = rows.y.to_numpy(np.float64)
    idf = (np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))) + 1).astype(np.float32)
    x *= idf
    own = _axes(x, axes)
    x /= idf
    model = Model(idf, own, np.zeros((0, axes)), y, float(y.mean()), neighbours)
    model.vectors = model.project(x)
    return model


def _packed(row: np.ndarray) -> bytes:
    """The places and values of what isn't zero."""
    at = np.flatnonzero(row)
    return at.astype(np.int32).tobytes() + row[at].tobytes()


def _unpack(raw: bytes, row: np.ndarray) -> None:
    half = len(raw) // 2
    row[np.frombuffer(raw[:half], np.int32)] = np.frombuffer(raw[half:], np.float32)


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row; only the text is an input of a score. Null texts count as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @give_back
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [sent.value.score(t) for t in term_counts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def keep_quality(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """``docs``, all columns, without the rows that score below ``least``.

    Null and empty texts score the share of label 1 in the sample; repeated
    rows are judged one by one; other columns may have any name.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    @give_back
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [sent.value.score(t) for t in term_counts(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(scores) >= least)) if scores else batch

    return docs.mapInArrow(scan, docs.schema)


def held_out(id_column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5 == 0
