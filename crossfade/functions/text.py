"""Text cleaning and canonical forms as column expressions.

Only two steps need Python: the case fold of lists beyond ASCII and the parsing
of serialised lists. Both are Arrow UDFs whose input is null for the rows that
don't need them.
"""

from __future__ import annotations

import ast
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..schema import MATCH_VARIANTS, SETTING_RANGE, TITLE_VARIANTS

_ANY = "|".join(TITLE_VARIANTS)


@cache
def _fold_steps() -> list[tuple[str, str]]:
    """What each character beyond ASCII leaves of itself, as (characters, first letters), (characters, second letters) and so on.

    From the compatibility decomposition of every code point: letters stay,
    marks go, and a ligature or a unit gives several letters.
    """
    left = {}
    for code in [*range(0x80, 0xD800), *range(0xE000, 0x110000)]:
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if plain:
            left[chr(code)] = plain
    steps = []
    for k in range(max(map(len, left.values()))):
        has = [c for c in left if len(left[c]) > k]
        steps.append(("".join(has), "".join(left[c][k] for c in has)))
    return steps


def _fold(c: Column) -> Column:
    (chars, letters), *more = _fold_steps()
    ascii_ = "".join(map(chr, range(0x80)))  # without a letter in the places behind the first
    pieces = lambda ch: F.concat(F.translate(ch, chars, letters), *[F.translate(ch, several + ascii_, then) for several, then in more])
    several = F.array_join(F.transform(F.split(c, ""), pieces), "")
    # most texts have no character of several letters: one translation of the whole will do
    plain = F.when(F.length(F.translate(c, more[0][0], "")) == F.length(c), F.translate(c, chars, letters)).otherwise(several)
    return F.regexp_replace(plain, r"[^\x00-\x7F]", "")


@F.pandas_udf(ArrayType(StringType()))
def _literal_list(s: pd.Series) -> pd.Series:
    def parse(x):
        if x is None:
            return None
        try:
            got = ast.literal_eval(x)
        except (SyntaxError, ValueError, MemoryError, RecursionError):
            return None
        return [t for t in (str(a).strip() for a in got) if t] if isinstance(got, (list, tuple)) else None

    # rows share texts: each is parsed once a batch
    parsed = {x: parse(x) for x in set(s)}
    return pd.Series([parsed.get(x) for x in s], index=s.index, dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def _casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else [t.casefold() for t in x])


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def fold_ascii(c: Column) -> Column:
    """Accents folded, whatever is left beyond ASCII dropped; null becomes empty."""
    c = F.coalesce(c, F.lit(""))
    foreign = c.rlike(r"[^\x00-\x7F]")
    return F.when(foreign, _fold(c)).otherwise(c)


def _squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def canon_title(c: Column) -> Column:
    """Folded, lower-cased, without trailing variant marks in brackets or after the first dash, words only."""
    t = F.lower(strip(fold_ascii(c)))
    t = F.regexp_replace(t, rf"(\s*[(\[{{](?=[^()\[\]{{}}]*\b(?:{_ANY})\b)[^()\[\]{{}}]+[)\]}}])+\s*$", "")
    t = F.regexp_replace(t, rf"^([^-\n]*?)\s*-\s*(?=.*\b(?:{_ANY})\b).+$", "$1")
    return _squeeze(F.regexp_replace(t, r"[^\w\s]", " "))


def canon_artist_name(c: Column) -> Column:
    """One artist's name, folded, lower-cased and squeezed; punctuation stays."""
    return _squeeze(F.lower(fold_ascii(c)))


def canon_artist(artists: Column) -> Column:
    """The canonical name of the first artist of an array; empty if there is none."""
    return canon_artist_name(F.get(artists, 0))


def canon_artist_text(c: Column) -> Column:
    """The same of a text: a serialised list's first entry, else what stands before the first comma."""
    text = strip(c)
    listed = text.startswith("[")
    parsed = _literal_list(F.when(listed, text))
    return canon_artist_name(F.when(parsed.isNotNull(), F.get(parsed, 0)).otherwise(F.split_part(text, F.lit(","), F.lit(1))))


def parse_bool(c: Column) -> Column:
    t = F.lower(strip(c.cast("string")))
    return F.when(t.isin("true", "1", "yes", "1.0"), True).when(t.isin("false", "0", "no", "0.0"), False)


def clean_id(c: Column) -> Column:
    """Trimmed; blank is null."""
    # nullif works its text out once, where a condition would once more for its value
    return F.nullif(strip(c.cast("string")), F.lit(""))


def track_id(c: Column) -> Column:
    """What follows the last colon of a cleaned id."""
    return clean_id(F.element_at(F.split(clean_id(c), ":"), -1))


def split_names(c: Column) -> Column:
    """The non-blank parts between commas."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip), lambda x: x != "")


def casefolded(names: Column) -> Column:
    """Names without regard to case: in lower case, or beyond ASCII in full case folding."""
    foreign = F.exists(names, lambda n: n.rlike(r"[^\x00-\x7F]"))
    return F.when(foreign, _casefold(F.when(foreign, names))).otherwise(F.transform(names, F.lower))


def name_key(names: Column) -> Column:
    """What names are looked up by: their parts without regard to case, with a separator that no part has."""
    return F.array_join(casefolded(names), "\x1f")


def join_known(parts: Column, known: Column) -> Column:
    """Parts joined left to right into the longest names that ``known`` (a map by ``name_key``) has.

    At each place the longest run of two or more parts that is known is taken
    as one name; a part that begins none stands for itself.
    """
    # bound once: an expression that a lambda names would be worked out at each of its places
    bound = F.array(F.struct(parts.alias("parts"), casefolded(parts).alias("keys")))
    return F.get(F.transform(bound, lambda p: _joined(p["parts"], p["keys"], known)), 0)


def _joined(parts: Column, keys: Column, known: Column) -> Column:
    empty = F.array().cast("array<string>")
    state_of = lambda out, end: F.struct(out.alias("out"), end.alias("next"))

    def step(state: Column, i: Column) -> Column:
        key = lambda e: F.array_join(F.slice(keys, i + 1, e - i), "\x1f")
        ends = F.filter(F.sequence(F.size(parts), i + 2, F.lit(-1)), lambda e: F.map_contains_key(known, key(e)))
        end = F.get(ends, 0)
        name = F.when(end.isNotNull(), F.element_at(known, key(end))).otherwise(F.get(parts, i))
        taken = state_of(F.concat(state["out"], F.array(name)), F.coalesce(end, i + 1))
        return F.when(state["next"] == i, taken).otherwise(state)

    start = state_of(empty, F.lit(0))
    # sequence() counts down below two remaining parts: such places can't begin a name
    places = F.when(F.size(parts) > 0, F.sequence(F.lit(0), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    guarded = lambda s, i: F.when(i + 2 <= F.size(parts), step(s, i)).otherwise(
        F.when(s["next"] == i, state_of(F.concat(s["out"], F.array(F.get(parts, i))), i + 1)).otherwise(s)
    )
    return F.aggregate(places, start, guarded, lambda s: s["out"])


def parse_artists(c: Column, column_name: str, known: Column | None = None) -> Column:
    """An artist field as a list: a serialised list's entries; names between commas if the column is ``artist_names``; else one name."""
    text = clean_id(c)
    listed = text.startswith("[")
    literal = _literal_list(F.when(listed, text))
    if column_name.lower() == "artist_names":
        parts = split_names(text)
        plain = parts if known is None else join_known(parts, known)
    else:
        plain = F.array(text)
    none = F.array().cast("array<string>")
    return F.when(text.isNull(), none).when(literal.isNotNull(), literal).otherwise(plain)


def playlist_id(c: Column) -> Column:
    """The id in a playlist URL, URI or bare id; null if there is none."""
    t = strip(c)
    found = F.coalesce(F.nullif(F.regexp_extract(t, r"playlist[/:]([A-Za-z0-9]+)", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"^([A-Za-z0-9]+)$", 1), F.lit("")))
    return found


def require_playlist_id(c: Column) -> Column:
    """The same, or an error."""
    return F.coalesce(playlist_id(c), F.raise_error(F.concat(F.lit("not a playlist: "), F.coalesce(c, F.lit("null")))).cast("string"))


def artist_display(artists: Column) -> Column:
    """Names joined by commas; without any, ``Unknown artist``."""
    names = F.filter(F.transform(artists, strip), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.nullif(F.array_join(names, ", "), F.lit("")), F.lit("Unknown artist"))


def artist_display_text(c: Column) -> Column:
    """The same of a text, which may be a serialised list."""
    text = strip(c)
    listed = text.startswith("[") & text.endswith("]")
    names = _literal_list(F.when(listed, text))
    return F.when(names.isNotNull(), artist_display(names)).otherwise(F.coalesce(F.nullif(text, F.lit("")), F.lit("Unknown artist")))


def track_uri(c: Column, prefix: str = "track:") -> Column:
    """``prefix`` and the cleaned id; null for none."""
    return F.concat(F.lit(prefix), clean_id(c))


def setting_to_adjustment(c: Column) -> Column:
    """A setting from 1 to 10 as a shift from -0.5 to 0.5; null and non-finite settings are an error."""
    low, high = SETTING_RANGE
    finite = c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    value = F.greatest(F.lit(low), F.least(F.lit(high), c.cast("double")))
    return F.when(finite, (value - (low + high) / 2) / (high - low)).otherwise(F.raise_error(F.lit("setting must be finite")).cast("double"))


def is_variant(title: Column) -> Column:
    """Whether a title names a variant that ranks behind plain recordings."""
    return F.coalesce(F.lower(title).rlike("|".join(MATCH_VARIANTS)), F.lit(False))


def source_key(track: Column, title: Column, artist: Column, duration: Column, position: Column) -> Column:
    """What tells the items of a playlist apart: the id, else title, artist and duration, else the position."""
    described = (F.coalesce(title, F.lit("")) != "") | (F.coalesce(artist, F.lit("")) != "") | (F.coalesce(duration, F.lit(0)) != 0)
    by_text = F.concat_ws("\x1f", F.lit("m"), F.coalesce(title, F.lit("")), F.coalesce(artist, F.lit("")), F.coalesce(duration.cast("string"), F.lit("")))
    return F.coalesce(F.concat(F.lit("i\x1f"), F.nullif(track, F.lit(""))), F.when(described, by_text), F.concat(F.lit("p\x1f"), position.cast("string")))


def image_url(images: Column) -> Column:
    """Of an array of images with a url: the second, else the first, else null."""
    return F.coalesce(F.get(images, 1)["url"], F.get(images, 0)["url"])
