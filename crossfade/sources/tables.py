"""CSV, JSON, text and Parquet sources, and the header map of raw track tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import TypeVar

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schema import CatalogError
from .records import csv_table
from .storage import Folder, file_of

T = TypeVar("T")

# fixed values: texts of a CSV cell that stand for a missing value
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# fixed values: column names that a field may have, best first, and fields found by a part of the name
EXACT_NAMES = {
    "id": ("id", "track_id", "spotify_id", "uri"),
    "name": ("name", "track_name", "title"),
    "artists": ("artists", "artist_names", "artist", "artist_name"),
    "isrc": ("isrc",),
    "album": ("album", "album_name"),
}
PART_NAMES = {"duration": "duration", "explicit": "explicit", "popularity": "popularity", "release_year": "year"}
PLAIN_NAMES = ("danceability", "energy", "valence", "speechiness", "acousticness", "instrumentalness", "liveness", "loudness", "tempo", "key", "mode")


def read_csv(spark: SparkSession, paths: str | Sequence[str], order: str | None = None) -> DataFrame:
    """All columns as strings; the usual tokens for a missing value become null.

    Files are read in splits, quoted line breaks or not. ``order`` names a
    column for the place of a row as read, which no splitting changes.
    """
    columns = csv_header(spark, paths if isinstance(paths, str) else list(paths))
    # a column of that name in the files gives way
    df = csv_table(spark, paths, [f"_{c}" if c == order else c for c in columns], order)
    return df.select(*[F.when(~F.col(f"`{c}`").isin(*NULL_TOKENS), F.col(f"`{c}`")).alias(c) for c in columns if c != order], *[order] * (order is not None))


def csv_header(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """The column names alone; no rows are read."""
    return spark.read.csv(path, header=True, quote='"', escape='"').columns


def csv_rows(spark: SparkSession, paths: Sequence[str]) -> int:
    """Physical lines but the header's, summed over files."""
    return sum(max(0, spark.read.text(p).count() - 1) for p in paths)


def map_header(columns: Sequence[str]) -> dict[str, str | None]:
    """Which column holds which field; the case of names doesn't matter."""
    lower = {c.lower(): c for c in columns}
    out = {field: next((lower[n] for n in names if n in lower), None) for field, names in EXACT_NAMES.items()}
    out |= {field: next((c for c in columns if part in c.lower()), None) for field, part in PART_NAMES.items()}
    return out | {n: lower.get(n) for n in PLAIN_NAMES}


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The catalog at a path; a read that fails is tried once more, for a table may be replaced meanwhile."""
    return with_catalog(spark, path, lambda catalog: catalog)


def with_catalog(spark: SparkSession, path: str, query: Callable[[DataFrame], T]) -> T:
    """What ``query`` makes of the catalog at a path.

    A query that runs to its end inside, as a count does, is tried once more
    if it fails, with the table's files listed anew: a table that is replaced
    between its reading and its use has other files. Failures of single tasks
    are Spark's to repeat (``spark.task.maxFailures``).
    """
    uri = Folder(spark, path).uri
    for last in (False, True):
        try:
            return query(spark.read.parquet(uri))
        except (PySparkException, Py4JJavaError) as e:
            if last:
                raise CatalogError(f"can't read the catalog at {path}: {e}") from e
            spark.catalog.refreshByPath(uri)


def empty_like(df: DataFrame) -> DataFrame:
    """The same columns and no rows."""
    return df.limit(0)


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet table: a count that reads no column, so that footers answer it."""
    return spark.read.parquet(path).count()


ITEM_TYPE = "id string, name string, artists array<struct<name:string>>, duration_ms long"


def read_playlist_pages(pages: DataFrame, playlist_col: str = "playlist_id", page_col: str = "page", json_col: str = "body") -> DataFrame:
    """Items of paged JSON: playlist_id, position (from 0, over all pages) and the track struct; a null item keeps its place."""
    kind = f"items array<struct<item:struct<{_struct(ITEM_TYPE)}>,track:struct<{_struct(ITEM_TYPE)}>>>"
    parsed = pages.select(F.col(playlist_col).alias("playlist_id"), F.col(page_col).alias("page"), F.from_json(json_col, kind).alias("b"))
    items = parsed.select("playlist_id", "page", F.posexplode(F.coalesce("b.items", F.array().cast(kind.split(" ", 1)[1]))).alias("at", "i"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("playlist_id").orderBy("page", "at")) - 1
    track = F.coalesce("i.item", "i.track")
    return items.select("playlist_id", place.alias("position"), track.alias("track")).where("track is not null")


def fetch_pages(playlists: DataFrame, fetch: Callable[[str], str], url_col: str = "url", playlist_col: str = "playlist_id") -> DataFrame:
    """(playlist_id, page, body) of every page, from the first URL of each playlist on.

    ``fetch`` gives the JSON text of a URL and runs on the executors, so that
    playlists are read side by side; a page's ``next`` is the URL of the page
    after it. A page that comes back to an earlier one ends its playlist.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for playlist, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen: set[str] = set()
                while url and url not in seen:
                    body = fetch(url)
                    yield pa.RecordBatch.from_arrays([pa.array([playlist], pa.string()), pa.array([len(seen)], pa.int32()), pa.array([body], pa.string())], ["playlist_id", "page", "body"])
                    seen.add(url)
                    url = json.loads(body).get("next")

    return playlists.select(F.col(playlist_col).cast("string"), F.col(url_col).cast("string")).mapInArrow(read, "playlist_id string, page int, body string")


def attach_art(rows: DataFrame, fetch: Callable[[str], list[str]], id_col: str = "track_id", name: str = "album_art_url") -> DataFrame:
    """``rows`` with the picture that stands for each id: of the URLs that ``fetch`` gives the second, else the first.

    An id whose fetch fails has none, and holds up no other.
    """

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = []
            for track in batch.column(batch.schema.get_field_index(id_col)).to_pylist():
                try:
                    urls.append((fetch(track)[:2] or [None])[-1])
                except Exception:  # noqa: BLE001  whatever a service may raise
                    urls.append(None)
            yield batch.append_column(name, pa.array(urls, pa.string()))

    return rows.mapInArrow(pick, StructType([*rows.schema.fields, StructField(name, StringType())]))


def _struct(ddl: str) -> str:
    return ",".join(":".join(f.strip().split(" ", 1)) for f in ddl.split(", "))


def read_list(spark: SparkSession, path: str | None, first: Sequence[str] = ()) -> list[str]:
    """Lines of a text file after the values given, without blanks, comments and repeats, in order."""
    out = [v.strip() for v in first]
    if path:
        rows = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
        text = F.regexp_replace("value", r"^\s+|\s+$", "")
        out += [r.v for r in rows.select(text.alias("v"), "n").where("v <> '' and not startswith(v, '#')").orderBy("n").collect()]
    return list(dict.fromkeys(v for v in out if v))


def read_json(path: str) -> dict:
    """A small JSON file."""
    shelf, name = file_of(SparkSession.active(), path)
    text = shelf.read(name)
    if text is None:
        raise FileNotFoundError(path)
    return json.loads(text)


def read_id_filter(spark: SparkSession, path: str) -> set[str]:
    """Playlist ids of a text list, or the held-out ones of a tuning result."""
    if path.endswith(".json"):
        ids = read_json(path).get("partition", {}).get("test_playlist_ids")
        if not isinstance(ids, list) or not ids:
            raise ValueError(f"no held-out playlist ids in {path}")
        return {str(i) for i in ids}
    return set(read_list(spark, path))


def read_weights(path: str) -> dict[str, float]:
    """The weights that a tuning result has selected."""
    from ..functions.features import check_weights

    weights = read_json(path).get("selected_weights")
    if not isinstance(weights, dict) or not weights:
        raise ValueError(f"no selected weights in {path}")
    return check_weights(weights)


def current_artifact(folder: str, override: str | None = None) -> str:
    """The artifact that ``CURRENT`` in ``folder`` names; a name with a path in it is refused."""
    if override:
        return override
    shelf = Folder(SparkSession.active(), folder)
    name = shelf.read("CURRENT")
    if name is None:
        raise CatalogError(f"no catalog in {folder}")
    name = name.strip()
    if not name or "/" in name or name in (".", ".."):
        raise CatalogError(f"not an artifact's name: {name!r}")
    if not shelf.has(name):
        raise CatalogError(f"{folder}/{name} isn't there")
    return f"{folder.rstrip('/')}/{name}"


def first_existing(paths: Sequence[str]) -> str | None:
    """The first path that exists, on any file system."""
    return next((p for p in paths if Folder(SparkSession.active(), p).there()), None)


def text_column(df: DataFrame, name: str | None, kind: str = "string") -> Column:
    """A column that may be missing."""
    return F.col(f"`{name}`").cast(kind) if name else F.lit(None).cast(kind)
