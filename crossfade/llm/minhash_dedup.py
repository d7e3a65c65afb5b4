"""MinHash near-duplicate detection.

1. Words of whole texts are hashed in Arrow batches; a document's set is that
   of its distinct word shingles. Documents of equal sets form a class, which
   goes on as one row, so that exact copies cost nothing further.
2. ``bands * rows`` minima under multiply-add-shift hash functions (a universal
   family) form the signature; each band of minima gives one bucket.
3. Each class is compared with one leader, the least class of its buckets, and
   what is linked becomes components. Buckets that still hold several of them
   are then compared in full, across components, in blocks of bounded size.
   Either way short sketches come first, in the first bucket that a pair
   shares, and full sets confirm. A block emits a spanning forest of its
   verified links, never all its pairs.
4. Connected components by alternating large-star and small-star.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bittable import build, settle, sift
from .components import components
from .shared import MIDDLE, WIDE, Scratch, drop_shuffles, give_back, materialize
from .textcols import BLANK_SPLIT, buffers, chunks, mix, scan_words

BLOCK_CLASSES = 2048  # classes of a bucket that one task compares with as many others
BLOCK_SHINGLES = 2_000_000  # the same as a limit on the size of their sets
NO_ID = (1 << 63) - 1  # stands for a null id, behind all others
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _coefficients(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, n, dtype=np.uint64)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    data, offsets = buffers(column)
    for i, j in chunks(offsets):
        words, bounds = scan_words(data, offsets[i : j + 1], BLANK_SPLIT)
        n = len(words) - width + 1
        rolled = np.zeros(max(n, 0), np.uint64)
        for k in range(width):
            rolled = mix(rolled * _STEP + words[k : k + n]) if n > 0 else rolled
        for d in range(j - i):
            lo, hi = int(bounds[d]), int(bounds[d + 1])
            if hi - lo >= width:
                yield np.unique(rolled[lo : hi - width + 1])
            elif hi > lo:  # fewer words: the whole sequence is one shingle
                h = np.zeros(1, np.uint64)
                for w in words[lo:hi]:
                    h = mix(h * _STEP + w)
                yield mix(h + np.uint64(hi - lo))
            else:
                yield words[:0]


def _minima(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Signatures (documents x hash functions) of non-empty sets."""
    x = np.concatenate(sets) >> np.uint64(32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), len(a)), np.uint32)
    for k in range(len(a)):
        out[:, k] = np.minimum.reduceat(((a[k] * x + b[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _compact(minima: np.ndarray, bands: int) -> list[bytes]:
    """Of each signature an 8-byte hash of every band, then the lowest byte of every minimum (the sketch)."""
    banded = minima.reshape(len(minima), bands, -1).astype(np.uint64)
    keys = np.zeros((len(minima), bands), np.uint64)
    for r in range(banded.shape[2]):
        keys = mix(keys * _STEP + banded[:, :, r] + np.uint64(1))
    return [k.tobytes() + s.tobytes() for k, s in zip(keys, minima.astype(np.uint8), strict=True)]


def _digest(s: np.ndarray) -> int:
    """Of a whole set: equal sets have equal digests, others differ but for a chance of 2**-64."""
    size = np.full(1, len(s), np.uint64)
    one = mix(np.add.reduce(s, keepdims=True) + _STEP * size)
    return int((one ^ mix(np.bitwise_xor.reduce(s, keepdims=True))).view(np.int64)[0])


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int, seed: int) -> DataFrame:
    """(doc_id, n_shingles, k: set digest or null, sig: band hashes and sketch as bytes, or null, row: digest of id and text), one row per input row."""

    @give_back
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coefficients(bands * rows, seed)
        for batch in batches:
            sets, counts, keys, sigs = [], [], [], []

            def flush() -> None:
                if sets:
                    sigs.extend(_compact(_minima(sets, a, b), bands))
                    sets.clear()

            order, held = [], 0
            for s in shingle_sets(batch.column(1), width):
                counts.append(len(s))
                if len(s):
                    keys.append(_digest(s))
                    order.append(len(counts) - 1)
                    sets.append(s)
                    held += len(s)
                    if held > 100_000:
                        flush()
                        held = 0
                else:
                    keys.append(None)
            flush()
            full = [None] * len(counts)
            for i, sig in zip(order, sigs, strict=True):
                full[i] = sig
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(keys, pa.int64()), pa.array(full, pa.binary()), batch.column(2)],
                ["doc_id", "n_shingles", "k", "sig", "row"],
            )

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), _row(id_col, text_col).alias("row"))
    return given.mapInArrow(scan, "doc_id long, n_shingles long, k long, sig binary, row long")


def _row(id_col: str, text_col: str):
    """A digest of a row's id and text: rows that agree in both are repeats of one another."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def _starts(batch: pa.RecordBatch) -> np.ndarray:
    """Where each tile (bucket, lo, hi) of sorted rows begins."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for c in range(3):
        x = batch.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _sifted(batch: pa.RecordBatch, starts: np.ndarray, least: float) -> pa.RecordBatch:
    """The rows of whole tiles that have a partner in another component whose estimate reaches ``least`` and whose first shared band is the tile's.

    All tiles go together: step s compares every row with the one s places on.
    """
    n = batch.num_rows
    found = np.zeros(n, bool)
    if n:
        lo, hi, own, c, band = (batch.column(i).to_numpy() for i in (1, 2, 3, 5, 6))
        keys = batch.column(7).flatten().to_numpy().reshape(n, -1)
        raw = batch.column(8)
        offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + n + 1]
        sketches = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(n, -1)
        ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
        before = np.arange(keys.shape[1])[None, :]
        left = np.arange(n)
        step = 0
        while len(left):
            step += 1
            left = left[left + step < ends[left]]
            for part in np.array_split(left, max(1, len(left) // 20_000)):
                i = part[((lo[part] == hi[part]) | (own[part] != own[part + step])) & (c[part] != c[part + step])]
                i = i[np.count_nonzero(sketches[i] == sketches[i + step], axis=1) >= least * sketches.shape[1]]
                i = i[~((keys[i] == keys[i + step]) & (before < band[i][:, None])).any(axis=1)]
                found[i] = True
                found[i + step] = True
    return batch.select(["bucket", "lo", "hi", "own", "k", "c"]).filter(pa.array(found))


def _forest(sets: list[np.ndarray], own: np.ndarray, components: np.ndarray, lo: int, hi: int, percent: int) -> list[tuple[int, int]]:
    """Verified links of a block pair, less those between members that are linked already."""
    sizes = np.array([len(s) for s in sets])
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    marked = np.zeros(len(values), np.int64)
    root = np.unique(components, return_inverse=True)[1]
    links = []
    right = own == hi
    for i in np.flatnonzero(own == lo):
        mine = codes[starts[i] : starts[i] + sizes[i]]
        marked[mine] = 1
        both = np.add.reduceat(marked[codes], starts)
        marked[mine] = 0
        ok = right & (root != root[i]) & (100 * both >= percent * (sizes + sizes[i] - both))
        for j in np.flatnonzero(ok):
            if root[j] != root[i]:
                links.append((int(i), int(j)))
                root[root == root[j]] = root[i]
    return links


class _Confirm:
    """From the rows of tiles to verified links."""

    def __init__(self, docs: DataFrame, reps: DataFrame, sketches: DataFrame, scratch: Scratch, id_col: str, text_col: str, width: int, percent: int, hashes: int) -> None:
        self.reps, self.sketches, self.scratch, self.width, self.percent = reps, sketches, scratch, width, percent
        own = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
        self.texts = docs.select(own.alias("wanted"), F.col(text_col).cast("string").alias("text"))
        self.classes, self.tiles = reps.count(), 0
        # an estimate this far below the threshold is off by 4.5 standard deviations of the signature
        p = percent / 100
        self.least = p + (1 - p) / 256 - 4.5 * (p * (1 - p) / hashes) ** 0.5

    def links(self, rows: DataFrame) -> DataFrame:
        """``rows``: bucket, lo, hi, own, k, c, band. A tile compares its blocks lo and hi, and members of different components c alone."""
        least, width, percent = self.least, self.width, self.percent

        @give_back
        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                batch = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0] if batch.num_rows else held
                if batch is None:
                    continue
                at = _starts(batch)
                yield _sifted(batch.slice(0, at[-1]), at[:-1], least)
                held = batch.slice(at[-1])  # the last tile may go on in the next batch
            if held is not None and held.num_rows:
                yield _sifted(held, np.zeros(1, np.int64), least)

        dealt = rows.join(self.sketches, "k").select("bucket", "lo", "hi", "own", "k", "c", "band", "keys", "sketch")
        dealt = dealt.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
        tiles = self.scratch.table(dealt.mapInArrow(pick, "bucket long, lo int, hi int, own int, k long, c long"), "tiles", self.classes, WIDE)
        self.tiles = tiles.count()
        drop_shuffles(tiles.sparkSession)
        full = self._sets(tiles)

        def verify(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            _, lo, hi = key
            pdf = pdf.drop_duplicates("k").sort_values("k", ignore_index=True)
            got = _forest([np.frombuffer(x, np.uint64) for x in pdf.members], pdf.own.to_numpy(), pdf.c.to_numpy(), lo, hi, percent)
            a, b = (pdf[["rep", "k"]].iloc[[x[end] for x in got]].reset_index(drop=True) for end in (0, 1))
            return pd.concat([a.set_axis(["a_rep", "a_k"], axis=1), b.set_axis(["b_rep", "b_k"], axis=1)], axis=1)

        verified = tiles.join(full, "k").groupBy("bucket", "lo", "hi").applyInPandas(verify, "a_rep long, a_k long, b_rep long, b_k long")
        end = lambda x: F.struct(F.col(f"{x}_rep").alias("rep"), F.col(f"{x}_k").alias("k")).alias(x)
        return verified.select(end("a"), end("b"))

    def _sets(self, tiles: DataFrame) -> DataFrame:
        """Full sets of the classes in ``tiles``, from whole texts once more; a bit table keeps most other texts from the shuffle."""
        width = self.width
        wanted = self.scratch.table(tiles.select("k").distinct().join(self.reps.select("k", "rep"), "k").select(F.col("rep").alias("wanted"), "k"), "wanted", self.tiles)

        @give_back
        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                reps_of, keys, found = [], [], []
                for rep, want, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), shingle_sets(batch.column(0), width), strict=True):
                    if len(s) and _digest(s) == want:  # another text may carry the same id
                        reps_of.append(rep)
                        keys.append(want)
                        found.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(reps_of, pa.int64()), pa.array(keys, pa.int64()), pa.array(found, pa.binary())], ["rep", "k", "members"])

        # merged at any size, so that what is shuffled follows the input
        texts = sift(self.texts, F.col("wanted"), self.scratch.broadcast(build(wanted, "wanted")), True).join(wanted.hint("merge"), "wanted").select("text", F.col("wanted").alias("rep"), "k")
        return self.scratch.table(texts.mapInArrow(sets, "rep long, k long, members binary"), "sets", min(self.tiles, self.classes), WIDE)


def _parts(size: str, weight: str):
    """Into how many blocks so many classes with so many shingles go."""
    return F.greatest(F.ceil(F.greatest(F.col(size) / F.lit(BLOCK_CLASSES), F.col(weight) / F.lit(BLOCK_SHINGLES))), F.lit(1)).cast("int")


def _stars(rows: DataFrame, scratch: Scratch, classes: int) -> DataFrame:
    """Tiles that compare every class with one leader: the least class of any of its buckets.

    What a leader or a bucket has in all is written before it is joined: a join
    of two scans is shuffled on both sides, so that a hot one can be split.
    """
    led = rows.where("k <> leader").groupBy("k").agg(F.min("leader").alias("leader"), F.first("n_shingles").alias("n_shingles"))
    counts = led.groupBy("leader").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("weight")).select("leader", _parts("size", "weight").alias("parts"))
    led, counts = scratch.table(led, "led", classes), scratch.table(counts, "leaders", classes)
    block = F.pmod(F.xxhash64("k"), F.col("parts")).cast("int") + 1
    members = led.join(counts, "leader").select(F.col("leader").alias("bucket"), F.lit(0).alias("lo"), block.alias("hi"), block.alias("own"), "k")
    leaders = counts.select(F.col("leader").alias("bucket"), F.lit(0).alias("lo"), F.explode(F.sequence(F.lit(1), "parts")).alias("hi"), F.lit(0).alias("own"), F.col("leader").alias("k"))
    return members.unionByName(leaders).select("*", F.col("k").alias("c"), F.lit(0).alias("band"))


def _rest(rows: DataFrame, scratch: Scratch, buckets: int) -> DataFrame:
    """Tiles of the buckets that hold several components: of each, all others against all, but its largest component not against itself."""
    counts = rows.groupBy("bucket", "c").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    open_ = counts.groupBy("bucket").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.max(F.struct("n", "c", "w")).alias("m"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("components"))
    open_ = open_.where("components > 1").select("bucket", "main", "n", "w", F.col("m.n").alias("n_main"), F.col("m.w").alias("w_main"))
    open_ = open_.withColumns({"n_rest": F.col("n") - F.col("n_main"), "w_rest": F.col("w") - F.col("w_main")})
    whole = _parts("n", "w") == 1
    open_ = open_.select("bucket", "main", F.when(whole, 1).otherwise(_parts("n_rest", "w_rest")).alias("rest"), F.when(whole, 0).otherwise(_parts("n_main", "w_main")).alias("mains"))
    out = rows.join(scratch.table(open_, "open-buckets", buckets), "bucket")
    in_main = (F.col("mains") > 0) & (F.col("c") == F.col("main"))
    h = F.xxhash64("k")
    own = F.when(in_main, F.col("rest") + F.pmod(h, F.greatest("mains", F.lit(1)))).otherwise(F.pmod(h, F.col("rest"))).cast("int")
    others = F.when(in_main, F.col("rest")).otherwise(F.col("rest") + F.col("mains"))
    out = out.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    return out.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "k", "c", "band")


def linked_classes(docs: DataFrame, reps: DataFrame, scratch: Scratch, id_col: str, text_col: str, width: int, bands: int, rows: int, percent: int) -> DataFrame:
    """(node, component) of the classes that are linked with others; both are (rep, k), the least id and the key of a class.

    First each class is compared with one leader, which settles most of a large
    group in proportion to its size. Then the buckets that still hold several
    components are compared in full, across components only.
    """
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 1 + 8 * i, 8)) for i in range(bands)])
    band = reps.select("k", "n_shingles", F.posexplode(keys).alias("band", "bucket"))
    stats = band.groupBy("bucket").agg(F.min("k").alias("leader"), F.count("*").alias("size")).where("size > 1").select("bucket", "leader")
    count = reps.count()
    stats = scratch.table(stats, "bucket-leaders", bands * count // 2)
    shared = scratch.table(band.join(stats, "bucket"), "buckets", bands * count)
    # the sketch, and four bytes of each band; of few classes that share no bucket besides
    sketches = reps.select(
        "k",
        F.array(*[F.hash(F.substring("sig", 1 + 8 * i, 8)) for i in range(bands)]).alias("keys"),
        F.substring("sig", 1 + 8 * bands, bands * rows).alias("sketch"),
    )
    sharing = scratch.broadcast(build(scratch.table(shared.select("k").distinct(), "sharing", count), "k"))
    sketches = scratch.table(sift(sketches, F.col("k"), sharing, True), "sketches", count, MIDDLE)
    stars = Scratch(docs.sparkSession)
    confirm = _Confirm(docs, reps, sketches, stars, id_col, text_col, width, percent, bands * rows)
    # a tile's links are a forest of its rows
    links = confirm.links(_stars(shared, stars, count))
    first = components(links, confirm.tiles)
    stars.clear()
    drop_shuffles(docs.sparkSession)
    confirm.scratch = scratch
    known = first.select(F.col("node.k").alias("k"), F.col("component.k").alias("c"))
    placed = shared.join(known, "k", "left").select("bucket", "band", "k", "n_shingles", F.coalesce("c", "k").alias("c"))
    more = confirm.links(_rest(placed, scratch, bands * count // 2))
    return components(more.union(first.where("node <> component")), confirm.tiles + count)


class _Found:
    """Signed rows, classes of equal sets (k, rep, row: of the row to keep) and linked classes (k, least: the component's id, head: its class)."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int, percent: int, seed: int) -> None:
        self.scratch, self.rows = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
        self.signed = self.rows.table(signatures(docs, id_col, text_col, width, bands, rows, seed), "signatures")
        own = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("rep"), "row")
        classes = self.signed.where("k is not null").groupBy("k").agg(F.min(own).alias("own"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
        self.reps = self.scratch.table(classes.select("k", "own.rep", "own.row", "n_shingles", "sig"), "classes", self.signed.count(), MIDDLE)
        linked = linked_classes(docs, self.reps, self.scratch, id_col, text_col, width, bands, rows, percent)
        # nodes are ordered by id, so the least node of a component has its id
        self.linked = self.scratch.table(linked.select(F.col("node.k").alias("k"), F.col("component.rep").alias("least"), F.col("component.k").alias("head")), "linked", self.reps.count())
        drop_shuffles(docs.sparkSession)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2, bands: int = 40, rows: int = 5, percent: int = 80, seed: int = 7
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their
    shingle sets; ``component_id`` is the smallest doc_id reachable and
    ``kept`` tells whether that is the document itself. At a similarity of
    exactly ``percent`` = 80 a pair shares no bucket with probability
    (1 - 0.8 ** rows) ** bands, 1.3e-7 by default; a candidate is lost to the
    sketch with 3e-6; links found are verified on full sets.

    Null and empty texts have no shingles and are linked with nothing. A null
    id is no component's id: such a row takes the smallest other id of its
    component (null, if none) and isn't kept; other ids must be whole numbers. Repeated rows are documents of
    their own; those with one id are kept together. Other columns of ``docs``
    are ignored. An empty table gives an empty result.
    """
    found = _Found(docs, id_col, text_col, width, bands, rows, percent, seed)
    ids = found.reps.select("k", "rep").join(found.linked.select("k", "least"), "k", "left").select("k", F.nullif(F.coalesce("least", "rep"), F.lit(NO_ID)).alias("component_id"))
    # as a table of its own, so that a join on a large class of copies can be split
    ids = materialize(ids, "components-of-classes", found.reps.count())
    found.scratch.clear()
    out = found.signed.select("doc_id", "n_shingles", "k").join(ids, "k", "left")
    component = F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2, bands: int = 40, rows: int = 5, percent: int = 80, seed: int = 7
) -> DataFrame:
    """``docs``, with all its columns, of each group of near-duplicates one row.

    Groups are those of ``near_duplicates``, but decided row by row: of a group
    the row of the smallest id stays (a null id comes last), of several rows
    with that id one text, and of rows that repeat both id and text any one.
    Rows of one id whose texts fall into different groups are judged apart.
    Null, empty and wordless texts belong to no group and all stay.
    """
    found = _Found(docs, id_col, text_col, width, bands, rows, percent, seed)
    # of each class its row to keep, null where another class heads the component
    heads = found.reps.select("k", "row").join(found.linked.select("k", "head"), "k", "left")
    heads = found.scratch.table(heads.select("k", F.when(F.coalesce("head", "k") == F.col("k"), F.col("row")).alias("stays")), "heads", found.reps.count())
    placed = found.signed.where("k is not null").select("k", "row").join(heads, "k")
    marks = placed.groupBy(F.col("row").alias("mark")).agg(F.bool_or(F.coalesce(F.col("row") == F.col("stays"), F.lit(False))).alias("keep"), F.count("*").alias("n"))
    # a row that stays and isn't there again needs no mark
    marks = materialize(marks.where("not keep or n > 1").select("mark", "keep"), "marks", found.signed.count())
    found.scratch.clear()
    found.rows.clear()
    wordless = F.coalesce(F.translate(F.col(text_col).cast("string"), " \t\n\x0b\x0c\r", "") == "", F.lit(True))
    return settle(docs, _row(id_col, text_col), marks, wordless)
