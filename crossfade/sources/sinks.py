"""Sinks: catalog publishing, the merge cache, CSV, JSON, and files of a report; all on storage that executors share."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable, Sequence
from functools import singledispatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DEPLOYED_TYPES, CatalogError, NoMatchesError
from .storage import Folder, file_of
from .tables import read_catalog

MERGE_SCHEMA_VERSION = 1
ROW_GROUP = 122_880  # rows of a published row group; fixed value


def sha256_file(spark: SparkSession, path: str) -> str:
    found = Folder(spark, path).digests().first()
    return found.sha256 if found else hashlib.sha256().hexdigest()  # an empty file has no lines


def sha256_table(spark: SparkSession, path: str) -> str:
    """Of a table's part files: the digest of their sorted digests, which the executors work out."""
    parts = sorted(r.sha256 for r in Folder(spark, path).digests().collect())
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def deployed(catalog: DataFrame) -> DataFrame:
    """The published columns in their narrow types."""
    return catalog.select(*[F.col(c).cast(t).alias(c) for c, t in DEPLOYED_TYPES.items()])


def publish_catalog(catalog: DataFrame, folder: str, version: str) -> str:
    """Write the published columns as an artifact named by version and content, and make it the current one.

    The table is first written under a hidden name; an empty one is refused,
    and then nothing but that changes. The artifact of the same content is
    used again. Readers follow ``CURRENT``, which is replaced in one step.

    Rows are ranged and sorted by id, with a Bloom filter of the ids of each
    row group, so that a search for some ids skips most files, row groups and pages.
    """
    if not re.fullmatch(r"[A-Za-z0-9_-]+", version):
        raise ValueError(f"not a version: {version!r}; letters, digits, '-' and '_' only")
    spark, shelf = catalog.sparkSession, Folder(catalog.sparkSession, folder)
    shelf.make()
    hidden = shelf.aside(version)
    try:
        rows = deployed(catalog).repartitionByRange("track_id").sortWithinPartitions("track_id")
        options = {"compression": "zstd", "parquet.block.row.count.limit": ROW_GROUP, "parquet.bloom.filter.enabled#track_id": "true", "parquet.bloom.filter.expected.ndv#track_id": ROW_GROUP}
        rows.write.options(**options).parquet(shelf.of(hidden))
        if spark.read.parquet(shelf.of(hidden)).isEmpty():
            raise CatalogError("there are no rows to publish")
        artifact = f"catalog-{version}-{sha256_table(spark, shelf.of(hidden))[:16]}.parquet"
        if not shelf.has(artifact):
            shelf.move(hidden, artifact)
    finally:
        shelf.drop(hidden)
    shelf.write("CURRENT", f"{artifact}\n")
    return f"{folder.rstrip('/')}/{artifact}"


def publish_draws(spark: SparkSession, artifact: str, seed: int = 0) -> str:
    """Beside an artifact, the same rows in the order of their draws, for samples that read a part; once for each seed."""
    from ..operators.retrieve import in_order_of_draws

    shelf, name = file_of(spark, artifact)
    ordered = f"{name}.draws-{seed}"
    if not shelf.has(ordered):
        hidden = shelf.aside(ordered)
        try:
            in_order_of_draws(spark.read.parquet(shelf.of(name)), seed).write.options(compression="zstd", **{"parquet.block.row.count.limit": ROW_GROUP}).parquet(shelf.of(hidden))
            shelf.move(hidden, ordered)
        finally:
            shelf.drop(hidden)
    return f"{artifact}.draws-{seed}"


def fingerprint(spark: SparkSession, paths: Sequence[str]) -> str:
    """Of input files by path, size and time of change, in any order."""
    inputs = sorted(Folder(spark, p).status() for p in paths)
    return hashlib.sha256(json.dumps([MERGE_SCHEMA_VERSION, inputs]).encode()).hexdigest()[:16]


def cached(spark: SparkSession, paths: Sequence[str], folder: str, build: Callable[[Callable[[DataFrame, str], DataFrame]], DataFrame], rebuild: bool = False) -> DataFrame:
    """The table built from files, kept under their fingerprint; a failed build leaves nothing behind.

    ``build`` is given a way to write what it makes in between, which goes with the build.
    """
    shelf, name = Folder(spark, folder), f"merged_{fingerprint(spark, paths)}.parquet"
    shelf.make()
    if rebuild or not shelf.has(f"{name}/_SUCCESS"):
        hidden = shelf.aside("merged")

        def write(rows: DataFrame, part: str) -> DataFrame:
            rows.write.parquet(shelf.of(f"{hidden}/{part}"))
            return spark.read.schema(rows.schema).parquet(shelf.of(f"{hidden}/{part}"))

        try:
            build(write).write.parquet(shelf.of(f"{hidden}/whole"))
            shelf.drop(name)
            shelf.move(f"{hidden}/whole", name)  # another builder's table of the same files will do as well
        finally:
            shelf.drop(hidden)
    return spark.read.parquet(shelf.of(name))


def merged_catalog(spark: SparkSession, paths: Sequence[str], folder: str = ".dataset_cache", rebuild: bool = False) -> DataFrame:
    """CSV files merged into one catalog, from the cache where they haven't changed."""
    from ..operators.merge import COLUMNS, merge_tables
    from .tables import read_csv

    def build(write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
        return merge_tables([read_csv(spark, Folder(spark, p).uri, "ord") for p in paths], write=write).select(*COLUMNS)

    return cached(spark, paths, folder, build, rebuild)


def catalog_bundle(spark: SparkSession, folder: str, raw_paths: Sequence[str] | None = None, cache: str = ".dataset_cache") -> DataFrame:
    """The published catalog, or the merged raw files if there are any."""
    from .tables import current_artifact

    if raw_paths:
        return merged_catalog(spark, raw_paths, cache)
    return read_catalog(spark, current_artifact(folder))


URIS_PER_CALL = 100  # that a service takes at once


def send_playlist(rows: DataFrame, create: Callable[[], str], add: Callable[[str, list[str]], None], prefix: str = "track:") -> str:
    """Make a playlist of ranked rows (rank, track_id) with the service that ``create`` and ``add`` call; its id.

    A recommendation is a few rows, which are collected; without any it is an error.
    """
    from ..functions.text import track_uri

    uris = [r.uri for r in rows.select("rank", track_uri(F.col("track_id"), prefix).alias("uri")).where("uri is not null").orderBy("rank").collect()]
    if not uris:
        raise NoMatchesError("there is no track to send")
    playlist = create()
    for i in range(0, len(uris), URIS_PER_CALL):
        add(playlist, uris[i : i + URIS_PER_CALL])
    return playlist


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, in the order of ``df``; arrays become JSON.

    The executors write its parts side by side, an ordered table by ranges;
    the parts are joined byte by byte in the file system.
    """
    flat = df.select(*[F.to_json(F.col(f"`{c}`")).alias(c) if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, t in df.dtypes])
    shelf, name = file_of(df.sparkSession, path)
    hidden = shelf.aside(name)
    head = ",".join('"' + c.replace('"', '""') + '"' if re.search(r'[",\r\n]', c) else c for c in df.columns) + "\n"
    try:
        flat.write.csv(shelf.of(hidden), quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        parts = [n for n in Folder(df.sparkSession, shelf.of(hidden)).names() if n.startswith("part-")]
        shelf.join([f"{hidden}/{n}" for n in parts], name, head)
    finally:
        shelf.drop(hidden)


@singledispatch
def jsonable(value):
    """What JSON can hold in place of a payload's value; texts, whole numbers, booleans and null stand as they are."""
    return value


@jsonable.register
def _(value: float):
    # NaN and the infinities are no JSON numbers
    return value if math.isfinite(value) else None


@jsonable.register(list)
@jsonable.register(tuple)
def _(value):
    return [*map(jsonable, value)]


@jsonable.register
def _(value: dict):
    return dict(zip(map(str, value), map(jsonable, value.values())))


def write_json(payload: dict, path: str, sort_keys: bool = False) -> str:
    return write_text(json.dumps(jsonable(payload), indent=2, sort_keys=sort_keys, allow_nan=False) + "\n", path)


def write_text(text: str, path: str) -> str:
    shelf, name = file_of(SparkSession.active(), path)
    shelf.write(name, text)
    return path
