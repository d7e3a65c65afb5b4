"""Candidate retrieval from a catalog DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw_key
from ..schema import CANDIDATE_LIMIT, CatalogError

DRAW = "draw"  # the column of a table in the order of its draws
SLACK = 1.3  # more rows are read than would do on average, so that one bound mostly does
PUSHED_IDS = 64  # ids that go to the scan as comparisons, so that it skips what can't hold them
LIST_BOUND = 50_000  # ids or artists sent along as one broadcast table; more are joined by a shuffle


def ordered_distinct(values: Sequence | None) -> list:
    """Without empty values and repeats, in the order given."""
    return list(dict.fromkeys(v for v in values or () if v))


def _without(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows whose column is none of ``values``; as in SQL, a null is dropped once there is a list."""
    values = ordered_distinct(values)
    if not values:
        return df
    spark = df.sparkSession
    gone = spark.createDataFrame([(v,) for v in values], f"{column} string")
    gone = F.broadcast(gone) if len(values) <= LIST_BOUND else gone
    return df.where(F.col(column).isNotNull()).join(gone, column, "left_anti")


def eligible(min_popularity: float | None = None, max_popularity: float | None = None, year_range: tuple[int, int] | None = None) -> Column:
    """Bounds on popularity (null: 0 for the lower, 100 for the upper) and release year (null fails)."""
    # plain comparisons, which the scan can take over; what a null stands for decides whether it passes
    out = F.lit(True)
    pop = F.col("popularity")
    if min_popularity is not None:
        out &= pop >= min_popularity if min_popularity > 0 else pop.isNull() | (pop >= min_popularity)
    if max_popularity is not None:
        out &= pop <= max_popularity if max_popularity < 100 else pop.isNull() | (pop <= max_popularity)
    if year_range is not None:
        out &= (F.col("release_year") >= year_range[0]) & (F.col("release_year") <= year_range[1])
    return out


def filter_candidates(
    catalog: DataFrame,
    exclude_ids: Sequence[str] | None = None,
    exclude_artists: Sequence[str] | None = None,
    min_popularity: float | None = None,
    max_popularity: float | None = None,
    year_range: tuple[int, int] | None = None,
) -> DataFrame:
    """Eligible rows; the bounds reach the scan, the lists are anti-joined."""
    out = catalog.where(eligible(min_popularity, max_popularity, year_range))
    out = _without(out, "track_id", exclude_ids or ())
    return _without(out, "artist_primary_canon", exclude_artists or ())


def count_candidates(catalog: DataFrame, **bounds) -> int:
    return filter_candidates(catalog, **bounds).count()


def _draw(df: DataFrame, seed: int | str) -> Column:
    key = F.coalesce(F.col("track_id"), *([F.col("title_canon")] if "title_canon" in df.columns else []), F.lit(""))
    return draw_key(seed, key)


def bounded_sample(candidates: DataFrame, limit: int = CANDIDATE_LIMIT, seed: int | str = 0) -> DataFrame:
    """A reproducible sample of at most ``limit`` rows: a top-k, not a sort."""
    return candidates.orderBy(_draw(candidates, seed), "track_id").limit(limit)


def in_order_of_draws(catalog: DataFrame, seed: int | str = 0) -> DataFrame:
    """The catalog with its draws, ranged and sorted by them: as a table, it lets a sample read a part alone."""
    return catalog.withColumn(DRAW, _draw(catalog, seed)).repartitionByRange(DRAW).sortWithinPartitions(DRAW)


def ordered_sample(ordered: DataFrame, limit: int, choose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``bounded_sample`` takes of ``choose(catalog)``, from a table in the order of its draws.

    A bound on the draw goes to the scan, which skips what lies beyond. It is
    estimated from the number of rows, and widened by what was found below it
    until enough are; with all draws below it, it is the whole.
    """
    total, share, found = ordered.count(), 0.0, 0
    while found < limit and share < 1:
        # of so many rows as were found below the last bound, or of all if none was tried
        rate = found / (total * share) if share else 1.0
        share = min(1.0, max(2 * share, SLACK * limit / (max(rate, 1e-9) * max(total, 1))))
        below = ordered.where(F.col(DRAW) < f"{int(share * (1 << 52)):013x}") if share < 1 else ordered
        found = choose(below).limit(limit).count()
    return choose(below).orderBy(DRAW, "track_id").limit(limit).drop(DRAW)


def _with_ids(catalog: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Rows that may have one of some ids; of few of them as comparisons that a scan can take over, each for itself."""
    if not 0 < len(ids) <= PUSHED_IDS:
        return catalog
    return catalog.where(reduce(lambda a, b: a | b, [F.col("track_id") == v for v in ids]))


def load_tracks(catalog: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Rows by id, in the order asked for, each once; unknown ids are left out."""
    wanted = ordered_distinct(ids)
    spark = catalog.sparkSession
    asked = spark.createDataFrame([(v, i) for i, v in enumerate(wanted)], "track_id string, asked int")
    return _with_ids(catalog, wanted).join(F.broadcast(asked) if len(wanted) <= LIST_BOUND else asked, "track_id").orderBy("asked").drop("asked")


def load_seeds(catalog: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The same, but an id that isn't there is an error."""
    out = load_tracks(catalog, ids)
    there = {r[0] for r in out.select("track_id").distinct().collect()}
    missing = [i for i in ordered_distinct(ids) if i not in there]
    if missing:
        raise CatalogError(f"seed tracks missing from the catalog: {missing[:5]}")
    return out


def lookup(catalog: DataFrame, track_id: str) -> DataFrame:
    """The row of one id, if there is one."""
    return catalog.where(F.col("track_id") == track_id).limit(1)


@dataclass(frozen=True)
class Prepared:
    """A pool of candidates, what the scaler is fitted on, and the popularity bound that held."""

    candidates: DataFrame
    scaler_source: DataFrame
    min_popularity: float | None
    pool_size: int

    @property
    def bounded(self) -> bool:
        """Whether the scaler sees the bounded pool alone."""
        return self.scaler_source is self.candidates

    def release(self) -> None:
        """Give back the pool's cached rows."""
        self.candidates.unpersist()


def prepare(
    catalog: DataFrame,
    seeds: DataFrame,
    top_n: int = 10,
    min_popularity: float | None = 20,
    year_range: tuple[int, int] | None = None,
    same_artist_exclusion: bool = False,
    exclude_ids: Sequence[str] | None = None,
    limit: int = CANDIDATE_LIMIT,
    fit_on: str = "candidates",
    seen: DataFrame | None = None,
    ordered: DataFrame | None = None,
) -> Prepared:
    """The pool for one request: bounds, exclusions, the bounded sample.

    With fewer than ``top_n`` candidates the lower popularity bound is dropped,
    and nothing else. ``fit_on`` tells what the scaler sees: the pool, or the
    whole ``catalog``. ``seen`` (track_id) is a list of any length to leave out.
    ``ordered`` is the same catalog as a table in the order of its draws, of
    which the sample reads a part.
    """
    if fit_on not in ("candidates", "catalog"):
        raise ValueError(f"unknown scaler source: {fit_on}")
    known = seeds.select("track_id", "artist_primary_canon").collect()
    ids = ordered_distinct([r.track_id for r in known] + list(exclude_ids or ()))
    artists = [r.artist_primary_canon for r in known] if same_artist_exclusion else None

    def pool(bound: float | None) -> DataFrame:
        # at most ``limit`` rows, read by the count, the fits and the scores
        def choose(source: DataFrame) -> DataFrame:
            rows = filter_candidates(source, ids, artists, bound, None, year_range)
            if seen is not None:
                rows = rows.where("track_id is not null").join(seen.select("track_id"), "track_id", "left_anti").select(*rows.columns)
            return rows

        return (bounded_sample(choose(catalog), limit) if ordered is None else ordered_sample(ordered, limit, choose)).persist()

    bound = min_popularity
    candidates = pool(bound)
    size = candidates.count()
    if bound is not None and size < top_n:
        candidates.unpersist()
        bound = None
        candidates = pool(bound)
        size = candidates.count()
    return Prepared(candidates, candidates if fit_on == "candidates" else catalog, bound, size)
