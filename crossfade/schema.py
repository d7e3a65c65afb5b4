"""Names, bounds and weights that every part of the engine agrees on."""

from __future__ import annotations

# fixed values: feature order, clip bounds, default weights
FEATURES = ("danceability", "energy", "valence", "acousticness", "instrumentalness", "liveness", "speechiness", "tempo", "loudness", "duration_ms")
TEMPO_BOUNDS = (0.0, 300.0)
LOUDNESS_BOUNDS = (-60.0, 0.0)
DURATION_BOUNDS = (30_000.0, 1_200_000.0)
DEFAULT_WEIGHTS = {
    "danceability": 1.5,
    "energy": 2.0,
    "valence": 0.5,
    "acousticness": 2.0,
    "instrumentalness": 2.0,
    "liveness": 0.5,
    "speechiness": 0.25,
    "tempo": 1.0,
    "loudness": 0.75,
    "duration_ms": 0.25,
}

# fixed values: words that mark a title as a variant of another recording
TITLE_VARIANTS = ("clean", "explicit", "radio edit", "remaster", "remastered", "instrumental", "acoustic", "live", "deluxe", "anniversary edition", "club mix", "extended mix")
MATCH_VARIANTS = ("live", "remix", "instrumental", "clean", "explicit", "karaoke", "cover", "demo", "edit")

# fixed values: steering
STEERABLE = ("energy", "valence", "danceability", "acousticness")
STEERING_STRENGTH = 0.7
STEERING_WEIGHT = 0.2
MAX_ADJUSTMENT = 0.5
SETTING_RANGE = (1.0, 10.0)

# fixed values: features named in an explanation
EXPLAINED = ("energy", "valence", "acousticness", "tempo")

DURATION_TOLERANCE_MS = 2000
DEDUPE_BUCKET_MS = 3000
CANDIDATE_LIMIT = 100_000

CATALOG_SCHEMA = (
    "track_id string, title_raw string, title_canon string, artists_raw array<string>, artist_primary_canon string, duration_ms int, "
    "explicit boolean, popularity int, release_year int, isrc string, album string, danceability double, energy double, valence double, "
    "speechiness double, acousticness double, instrumentalness double, liveness double, loudness double, tempo double, key int, mode int"
)
#: The published subset and its types.
DEPLOYED_TYPES = {
    "track_id": "string",
    "title_raw": "string",
    "title_canon": "string",
    "artists_raw": "array<string>",
    "artist_primary_canon": "string",
    "duration_ms": "int",
    "popularity": "float",
    "release_year": "smallint",
    "danceability": "float",
    "energy": "float",
    "valence": "float",
    "speechiness": "float",
    "acousticness": "float",
    "instrumentalness": "float",
    "liveness": "float",
    "loudness": "float",
    "tempo": "float",
}


class EngineError(Exception):
    """Base of the engine's errors."""


class CatalogError(EngineError):
    """A catalog that can't be read, published or found."""


class NoMatchesError(EngineError):
    """A playlist none of whose tracks are in the catalog."""
