"""Phrase collocations by suffix sorting.

Every word starts a suffix, cut at ``max_n`` words or where its piece ends.
Suffixes are shuffled by language and first word and sorted in reverse order,
so that all suffixes with a common prefix stand together and one stack counts
every prefix in one pass. The parts of each phrase are joined afterwards.

A scan before that finds what makes the shuffle small and even, by tables
whose size does not grow with the corpus:

- words are counted into a fixed number of buckets; a word whose bucket stays
  under the least count is in no frequent phrase, so that suffixes end there;
- prefixes that hold more than a fixed share of all words: a suffix under such
  a prefix is shuffled by one word more, up to the first prefix that is none.
  Counts of the shorter prefixes are then partial and are added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textcols as T
from .shared import Scratch, give_back, materialize

#: log2 of the buckets of word counts, a bit each in the end; with more words than buckets fewer suffixes are cut.
BUCKET_BITS = 26
#: A prefix with more than this share of all words is shuffled by longer prefixes.
HOT_SHARE = 1 / 4096
#: Bytes of text whose equal suffixes go as one.
RUN = 1 << 20

_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_WORD = T._table(lambda c: c not in b" \t" + _PIECE_ENDS, lower=True)
_IS_END = np.isin(np.arange(256), list(_PIECE_ENDS))
# no word holds a byte from 9 to 13: the nine bytes below move up by one, so that 0 can part words and sorts before all others
_SAFE = np.array([b + 1 if b < 9 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
_RAW = bytes([0x20, *range(9), *range(10, 256)])
_END = np.uint64(1)


def _name_hash(name: str) -> int:
    """FNV-1a of a language's name: the same on every worker."""
    h = 0xCBF29CE484222325
    for b in name.encode():
        h = ((h ^ b) * 0x100000001B3) & (1 << 64) - 1
    return h


class _Words:
    """Words of some documents: a number and a hash for each, and where pieces begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: list[str]) -> None:
        lo, hi = int(offsets[0]), int(offsets[-1])
        hashes, bounds, first, last = T.scan_words(data, offsets, _WORD, spans=True)
        self.n, of_doc = len(first), np.diff(bounds)
        if not self.n:
            return
        self.langs = sorted(set(langs))
        place = {name: i for i, name in enumerate(self.langs)}
        self.lang = np.repeat(np.array([place[x] for x in langs], np.int64), of_doc)
        self.hash = T.mix(hashes + np.array([_name_hash(x) for x in self.langs], np.uint64)[self.lang])
        marks = np.zeros(hi - lo + 1, np.int32)
        np.cumsum(_IS_END[data[lo:hi]], out=marks[1:])
        self.fresh = np.ones(self.n, bool)
        self.fresh[1:] = marks[first[1:] - lo] != marks[last[:-1] - lo]
        self.fresh[bounds[:-1][of_doc > 0]] = True
        edge = np.zeros(hi - lo + 1, np.int8)
        edge[first - lo] += 1
        edge[last - lo] -= 1
        sizes = np.zeros(self.n + 1, np.int64)
        np.cumsum(last - first, out=sizes[1:])
        flat = _SAFE[data[lo:hi][np.cumsum(edge[:-1], dtype=np.int8) > 0]]
        coded = pa.Array.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(sizes), pa.py_buffer(flat)]).dictionary_encode()
        self.words, self.code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)

    def buckets(self) -> np.ndarray:
        return (self.hash >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)

    def ends(self, keep: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the run of kept words of one piece ends that each of the words ``at`` lies in."""
        stops = np.append(np.flatnonzero(self.fresh | ~keep), self.n)
        return stops[np.searchsorted(stops, at, "right")]

    def longer(self, at: np.ndarray, end: np.ndarray, h: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of prefixes of ``step`` words made longer by one, and which have that one."""
        there = at + step < end
        return T.mix(h * np.uint64(3) + np.where(there, self.hash[np.minimum(at + step, self.n - 1)], _END)), there


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal keys the first place and the number; and each key's group."""
    got = pa.array(keys).dictionary_encode()
    group = got.indices.to_numpy().astype(np.int64)
    first = np.zeros(len(got.dictionary), np.int64)
    first[group[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return first, np.bincount(group, minlength=len(first)), group


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Words]:
    for batch in batches:
        langs = batch.column(0).to_pylist()
        data, offsets = T.buffers(batch.column(1))
        for i, j in T.chunks(offsets, RUN):
            words = _Words(data, offsets[i : j + 1], langs[i:j])
            if words.n:
                yield words


def _survey(rows: DataFrame, max_n: int) -> DataFrame:
    """Sums (kind, key, lang, n): of words by language (kind 0), by bucket (1), and of prefixes (2) with a good share of some chunk's words."""

    @give_back
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _chunks(batches):
            kinds, keys, langs, sums = [], [], [], []

            def add(kind: int, key: np.ndarray, lang: list, n: np.ndarray) -> None:
                kinds.append(np.full(len(key), kind, np.int8))
                keys.append(key.astype(np.int64, copy=False))
                langs.extend(lang)
                sums.append(n.astype(np.int64, copy=False))

            add(0, np.zeros(len(words.langs)), words.langs, np.bincount(words.lang, minlength=len(words.langs)))
            bucket, n = np.unique(words.buckets(), return_counts=True)
            add(1, bucket, [None] * len(bucket), n)
            # a prefix is no more frequent than a shorter one; of full length none need be told apart, for equal suffixes are one row
            at = np.arange(words.n)
            end, h = words.ends(np.ones(words.n, bool), at), words.hash
            for step in range(1, max_n):
                first, n, group = _grouped(h)
                often = n >= max(1, words.n * HOT_SHARE)
                add(2, h[first[often]].view(np.int64), [None] * int(often.sum()), n[often])
                at, end, h = (x[often[group]] for x in (at, end, h))
                h, there = words.longer(at, end, h, step)
                at, end, h = at[there], end[there], h[there]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds)), pa.array(np.concatenate(keys)), pa.array(langs, pa.string()), pa.array(np.concatenate(sums))], ["kind", "key", "lang", "n"])

    return rows.mapInArrow(scan, "kind tinyint, key long, lang string, n long").groupBy("kind", "key", "lang").agg(F.sum("n").alias("n"))


def _pack(slot: np.ndarray, n: np.ndarray, suffixes: pa.Array) -> bytes:
    """Suffixes with their slots and numbers as one compressed block."""
    sizes = np.diff(np.frombuffer(suffixes.buffers()[1], np.int64)[suffixes.offset : suffixes.offset + len(suffixes) + 1]).astype(np.uint32)
    begin = int(np.frombuffer(suffixes.buffers()[1], np.int64)[suffixes.offset])
    raw = np.frombuffer(suffixes.buffers()[2], np.uint8)[begin : begin + int(sizes.sum(dtype=np.int64))]
    head = np.array([len(n)], np.int64)
    return zstandard.ZstdCompressor(level=6).compress(b"".join(x.tobytes() for x in (head, n, sizes, slot, raw)))


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Depths, numbers, sizes and bytes of a block's suffixes."""
    raw = zstandard.ZstdDecompressor().decompress(block)
    m = int(np.frombuffer(raw, np.int64, 1)[0])
    n, sizes = np.frombuffer(raw, np.int64, m, 8), np.frombuffer(raw, np.uint32, m, 8 + 8 * m)
    return np.frombuffer(raw, np.uint8, m, 8 + 12 * m), n, sizes, np.frombuffer(raw, np.uint8, -1, 8 + 13 * m)


def _suffixes(rows: DataFrame, frequent, hot, max_n: int, buckets: int) -> DataFrame:
    """Suffixes at frequent words, equal ones of a run together, in compressed blocks: bucket, block.

    A suffix is its first word, its language in hexadecimal and its other
    words, parted by zero bytes. Its bucket is by the hash of the first of its
    prefixes that is not hot; with it goes how many words that prefix has.
    """

    @give_back
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, heavy = frequent.value, hot.value
        for words in _chunks(batches):
            bucket = words.buckets()
            keep = (often[bucket >> 3] >> (bucket & 7).astype(np.uint8) & 1).astype(bool)
            at = np.flatnonzero(keep)
            if not len(at):
                continue
            end, h = words.ends(keep, at), words.hash[at]
            depth, slot = np.zeros(len(at), np.uint8), np.zeros(len(at), np.uint64)
            for step in range(1, max_n + 1):
                settled = depth == 0
                if step < max_n and len(heavy):
                    settled &= heavy[np.searchsorted(heavy, h) % len(heavy)] != h
                depth[settled], slot[settled] = step, h[settled]
                if step < max_n:
                    h, _ = words.longer(at, end, h, step)
            length = np.minimum(end - at, max_n)
            codes = [np.where(length > k, words.code[np.minimum(at + k, words.n - 1)] + 1, 0) for k in range(max_n)]
            first, n, group = _grouped(h)
            for c in (words.lang[at], *codes):
                if not np.array_equal(c[first][group], c):  # two suffixes of one hash: told apart by their words
                    first, n, group = _grouped(_numbered([words.lang[at], *codes]))
                    break
            own = (slot[first] % np.uint64(buckets)).astype(np.int64)
            # by bucket, then about by words: near suffixes are short to write
            order = np.argsort(own << 42 | np.minimum(codes[0][first], (1 << 21) - 1) << 21 | np.minimum(codes[1][first], (1 << 21) - 1), kind="stable")
            first, n, own = first[order], n[order], own[order]
            names = pa.array([x.encode().hex().encode() for x in words.langs], pa.large_binary())
            parts = [words.words.take(pa.array(codes[0][first] - 1)), names.take(pa.array(words.lang[at][first]))]
            parts += [words.words.take(pa.array(c[first] - 1, mask=c[first] == 0)) for c in codes[1:]]
            joined = pc.binary_join_element_wise(*parts, pa.scalar(b"\0", pa.large_binary()), null_handling="skip")
            cuts = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own))
            blocks = [_pack(depth[first[a:b]], n[a:b], joined.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(own[cuts[:-1]].astype(np.int32)), pa.array(blocks, pa.binary())], ["bucket", "block"])

    return rows.mapInArrow(scan, "bucket int, block binary")


def _numbered(columns: list[np.ndarray]) -> np.ndarray:
    """A number for each row of columns, equal for equal rows."""
    out = columns[0]
    for c in columns[1:]:
        out = np.unique(out * (int(c.max()) + 1) + c, return_inverse=True)[1]
    return out


@give_back
def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks to rows: suffix, n, depth."""
    for batch in batches:
        for block in batch.column(1):
            depth, n, sizes, raw = _unpack(block.as_py())
            ends = np.zeros(len(n) + 1, np.int32)
            np.cumsum(sizes, out=ends[1:])
            suffix = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))])
            yield pa.RecordBatch.from_arrays([suffix, pa.array(n), pa.array(depth.astype(np.int8))], ["suffix", "n", "depth"])


class _Stack:
    """Counts of all prefixes of sorted suffixes, some suffixes at a time.

    Open are the prefixes of the last suffix, shorter ones below longer ones,
    each with its count so far and how many words make a count whole.
    """

    def __init__(self, max_n: int, least: int) -> None:
        self.max_n, self.least = max_n, least
        self.open: list[list] = []  # prefix, count, depth
        self.closed: list[tuple[bytes, int]] = []

    def _close(self, prefix: bytes, n: int, words: int, depth: int) -> None:
        if n >= self.least or words < depth:
            self.closed.append((prefix, n))

    def push(self, suffixes: pa.Array, n: np.ndarray, depth: np.ndarray) -> None:
        at = np.frombuffer(suffixes.buffers()[1], np.int32)[suffixes.offset : suffixes.offset + len(suffixes) + 1].astype(np.int64)
        data = np.frombuffer(suffixes.buffers()[2], np.uint8)
        begin, size, rows = at[:-1], np.diff(at), len(n)
        # where each prefix ends: at its parting bytes but the first, which follows the first word, and at the end
        zeros = np.flatnonzero(data[at[0] : at[-1]] == 0) + at[0]
        before = np.searchsorted(zeros, at)
        words = np.diff(before)  # as many as parting bytes, for the language has one
        # bytes that a suffix has in common with the one before it
        common = np.zeros(rows, np.int64)
        least = np.minimum(size[1:], size[:-1])
        flat = np.zeros(rows, np.int64)
        np.cumsum(least, out=flat[1:])
        step = np.arange(int(flat[-1])) - np.repeat(flat[:-1], least)
        differ = np.append(np.flatnonzero(data[np.repeat(begin[1:], least) + step] != data[np.repeat(begin[:-1], least) + step]), int(flat[-1]))
        common[1:] = np.minimum(differ[np.searchsorted(differ, flat[:-1])] - flat[:-1], least)
        total = np.zeros(rows + 1, np.int64)
        np.cumsum(n, out=total[1:])
        first = data[begin[0] : begin[0] + size[0]].tobytes()
        kept = 0
        for words_open, (prefix, *_rest) in enumerate(self.open, 1):
            if first == prefix or first.startswith(prefix + b"\0"):
                kept = words_open
        for gone in range(len(self.open), kept, -1):
            self._close(self.open[-1][0], self.open[-1][1], gone, self.open.pop()[2])
        now = []
        for k in range(1, self.max_n + 1):
            has = words >= k
            # the k-th prefix ends before the parting byte k, or with the suffix
            ends = np.where(words > k, zeros[np.minimum(before[:-1] + k, max(len(zeros) - 1, 0))], at[1:]) - begin
            same = np.zeros(rows, bool)
            other = np.append(False, (common[1:] < size[:-1]) & (data[np.minimum(begin[:-1] + common[1:], len(data) - 1)] != 0))
            same[1:] = (has[1:] & has[:-1]) & ((common[1:] > ends[1:]) | ((common[1:] == ends[1:]) & ~other[1:]))
            starts = np.append(np.flatnonzero(~same), rows)
            sums = total[starts[1:]] - total[starts[:-1]]
            starts = starts[:-1]
            if k <= kept:
                self.open[k - 1][1] += int(sums[0])
                if len(starts) > 1:
                    prefix, count, deep = self.open[k - 1]
                    self._close(prefix, count, k, deep)
            real = has[starts]
            fresh = real & ((sums >= self.least) | (k < depth[starts]))
            fresh[-1] = real[-1]
            fresh[0] &= k > kept
            for j in np.flatnonzero(fresh).tolist():
                a = int(begin[starts[j]])
                prefix = data[a : a + int(ends[starts[j]])].tobytes()
                if j == len(starts) - 1:
                    now.append([prefix, int(sums[j]), int(depth[starts[j]])])
                else:
                    self._close(prefix, int(sums[j]), k, int(depth[starts[j]]))
            if len(starts) == 1 and k <= kept:
                now.append(self.open[k - 1])
        self.open = now

    def finish(self) -> None:
        while self.open:
            prefix, count, deep = self.open.pop()
            self._close(prefix, count, len(self.open) + 1, deep)

    def take(self) -> pa.RecordBatch:
        langs, phrases = [], []
        for prefix, _ in self.closed:
            word, lang, *more = prefix.split(b"\0")
            langs.append(bytes.fromhex(lang.decode()).decode())
            phrases.append(b"\0".join([word, *more]).translate(_RAW))
        out = pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array([n for _, n in self.closed], pa.int64())], ["lang", "phrase", "f"])
        self.closed = []
        return out


def _count_prefixes(blocks: DataFrame, least: int, max_n: int, buckets: int) -> DataFrame:
    """Lang, phrase and count of every prefix, in one pass over the sorted suffixes; whole counts under ``least`` are left out, partial ones are not."""

    @give_back
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = _Stack(max_n, least)
        for batch in batches:
            if batch.num_rows:
                stack.push(batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy())
                yield stack.take()
        stack.finish()
        yield stack.take()

    dealt = blocks.repartitionById(buckets, "bucket").mapInArrow(_spread, "suffix binary, n long, depth tinyint").sortWithinPartitions(F.col("suffix").desc())
    return dealt.mapInArrow(scan, "lang string, phrase string, f long")


def phrase_counts(docs: DataFrame, scratch: Scratch, lang_col: str = "lang", text_col: str = "text", least: int = 100, max_n: int = 5) -> tuple[DataFrame, DataFrame]:
    """Words by language (lang, n), and phrases of 1 to ``max_n`` words with ``least`` occurrences or more (lang, phrase, f), as tables of ``scratch``.

    ``max_n`` may be up to 7. Occurrences are all contiguous ones within pieces, overlaps included.
    """
    if not 2 <= max_n <= 7:
        raise ValueError(f"max_n must be from 2 to 7, not {max_n}")
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    survey = scratch.table(_survey(rows, max_n), "collocation-survey")
    sizes = survey.where("kind = 0").select("lang", "n")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    # a bit for each bucket, put together by the executors
    often = np.zeros(1 << (BUCKET_BITS - 3), np.uint8)
    bits = survey.where(F.col("n") >= least).where("kind = 1").groupBy(F.bitmap_bucket_number(F.col("key") + 1).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("key") + 1)).alias("bits"))
    for at, part in bits.collect():
        often[(at - 1) * 4096 : at * 4096] = np.frombuffer(part, np.uint8)
    # at most 1 / HOT_SHARE for each length
    hot = survey.where(F.col("n") >= max(least, total * HOT_SHARE)).where("kind = 2").select("key").toPandas()["key"].to_numpy(np.int64)
    sc = spark.sparkContext
    frequent, heavy = scratch.broadcast(sc.broadcast(often)), scratch.broadcast(sc.broadcast(np.sort(hot.view(np.uint64))))
    # a bucket is a partition, and a block is what a run of text has for it
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = _count_prefixes(_suffixes(rows, frequent, heavy, max_n, buckets), least, max_n, buckets)
    counted = counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return sizes, scratch.table(counted, "phrase-counts")


def _exact(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 100, max_n: int = 5, subsume: int = 100, top: int = 2000) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    Words are lower-cased in A-Z and parted by blanks and tabs inside pieces,
    which end at ``.,;:!?`` and line ends; ``n`` is the number of a
    language's words. Candidates are phrases of 2 to ``max_n`` words found
    ``a >= least`` times. A cut into two parts that are found l and r times
    scores floor(1000 a n / (l r)), in whole numbers of 38 digits; the
    lowest-scoring cut counts, ties go to the smallest first part. A candidate
    goes if some longer one holds its words and has ``subsume`` per cent of
    its occurrences. Ranks go by score, a, then phrase.

    A null language is ``und``; null and empty texts have no words; a language
    with none has no rows; long texts are scanned in segments; repeated rows
    count each; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    try:
        sizes, counts = phrase_counts(docs, scratch, lang_col, text_col, least, max_n)
        part = lambda a, n: F.array_join(F.slice("words", a, n), " ")
        words = counts.withColumn("words", F.split("phrase", " ")).withColumn("m", F.size("words")).where("m > 1")
        # a longer phrase's inner ones, of two words or more
        spans = F.filter(
            F.flatten(F.transform(F.sequence(F.lit(2), F.col("m") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("m") - n + 1), lambda a: F.struct(a.alias("a"), n.alias("n"))))), lambda s: s["n"] >= 2
        )
        inner = words.where("m > 2").select("lang", "words", F.col("f").alias("outer"), F.explode(spans).alias("s")).select("lang", part(F.col("s.a"), F.col("s.n")).alias("phrase"), "outer")
        held = scratch.table(inner.groupBy("lang", "phrase").agg(F.max("outer").alias("outer")), "held-phrases")
        kept = words.join(held, ["lang", "phrase"], "left").where(F.expr(f"outer IS NULL OR 100 * outer < {int(subsume)} * f"))
        cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "words", "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
        cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("m") - F.col("k")).alias("right"))
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
        cuts = cuts.join(sizes, "lang").select("lang", "phrase", "a", "n", "k", "l", "r", (_exact(F.lit(1000)) * _exact(F.col("a")) * _exact(F.col("n"))).alias("x"), (_exact(F.col("l")) * _exact(F.col("r"))).alias("y"))
        best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct(F.expr("x div y").alias("score"), "k", "l", "r")).alias("cut"))
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase"))
        ranked = best.withColumn("rank", rank).where(F.col("rank") <= top)
        return materialize(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score"), "collocations")
    finally:
        scratch.clear()
