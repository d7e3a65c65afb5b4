"""DuckDB SQL of the same results as ``queries``, written independently of the DataFrame plans."""

from __future__ import annotations

from ..schema import DEFAULT_WEIGHTS, FEATURES, MATCH_VARIANTS, TITLE_VARIANTS

_W = [DEFAULT_WEIGHTS[f] for f in FEATURES]

TRACKS = """
l AS (
  SELECT l_partkey, count(*) AS n, avg(l_discount) AS disc, avg(l_tax) AS tax, avg(l_quantity) AS qty, avg((l_returnflag = 'R')::INTEGER) AS ret,
    avg((l_linestatus = 'O')::INTEGER) AS opn, stddev_pop(l_discount) AS sdisc, stddev_pop(l_tax) AS stax
  FROM lineitem GROUP BY 1
),
tracks AS (
  SELECT p_partkey::VARCHAR AS track_id, p_name AS title_raw, lower(p_name) AS title_canon, [p_brand] AS artists_raw, lower(p_brand) AS artist_primary_canon, p_type AS album,
    CASE WHEN p_partkey % 13 <> 0 THEN least(100, greatest(0, 5 * (n - 20)))::INTEGER END AS popularity,
    (1960 + (p_partkey * 7) % 60)::INTEGER AS release_year, least(1.0::DOUBLE, 10 * disc) AS danceability, least(1.0::DOUBLE, 12.5 * tax) AS energy, qty / 50 AS valence,
    ret AS acousticness, opn AS instrumentalness, least(1.0::DOUBLE, 20 * sdisc) AS liveness, least(1.0::DOUBLE, 20 * stax) AS speechiness,
    CASE WHEN p_partkey % 17 <> 0 THEN (60 + 3 * p_size)::DOUBLE END AS tempo, CASE WHEN p_partkey % 19 <> 0 THEN -60 + p_retailprice / 20 END AS loudness,
    (p_size * 9000 + (p_partkey % 7) * 1000)::INTEGER AS duration_ms, p_size
  FROM l JOIN part ON l_partkey = p_partkey
),
catalog AS (SELECT * FROM tracks WHERE p_size <> 50)
"""

OCCURRENCES = """
occ AS (
  SELECT o_custkey::VARCHAR AS playlist_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, l_linenumber, l_partkey) - 1 AS position, l_partkey AS pk
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey
)
"""

MEMBERSHIPS = f"""{OCCURRENCES},
memberships AS (
  SELECT playlist_id, position, pk::VARCHAR AS source_track_id, CASE WHEN p_size <> 50 THEN pk::VARCHAR END AS catalog_track_id, p_size <> 50 AS matched
  FROM (SELECT playlist_id, pk, min(position) AS position FROM occ GROUP BY ALL) JOIN part ON pk = p_partkey
)
"""

_KW = "|".join(TITLE_VARIANTS)


def canon(x: str) -> str:
    """The canonical form of a title as a SQL expression."""
    x = f"trim(lower(strip_accents(coalesce({x}, ''))), ' ')"
    x = rf"regexp_replace({x}, '[^\x00-\x7F]', '', 'g')"
    x = rf"regexp_replace({x}, '(\s*[(\[{{][^()\[\]{{}}]*\b({_KW})\b[^()\[\]{{}}]*[)\]}}])+\s*$', '')"
    x = rf"regexp_replace({x}, '^([^-]*?)\s*-\s*.*\b({_KW})\b.*$', '\1')"
    x = rf"regexp_replace({x}, '[^\w\s]', ' ', 'g')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


ITEMS = f"""{OCCURRENCES},
raw_items AS (
  SELECT playlist_id, position, CASE pk % 3 WHEN 0 THEN pk::VARCHAR WHEN 1 THEN 'x' || pk END AS source_track_id,
    p_name || CASE pk % 4 WHEN 0 THEN ' - Live' WHEN 1 THEN ' (Remastered 2011)' WHEN 2 THEN ' [Radio Edit]' ELSE '' END AS title, upper(p_brand) AS artist,
    CASE WHEN pk % 5 <> 0 THEN (p_size * 9000 + (pk % 7) * 1000 + 1500)::BIGINT END AS duration_ms
  FROM occ JOIN part ON pk = p_partkey
),
keyed AS (
  SELECT *, {canon("title")} AS title_canon, lower(artist) AS artist_canon,
    CASE WHEN source_track_id IS NOT NULL THEN 'i' || source_track_id ELSE concat_ws('~', 'm', {canon("title")}, lower(artist), coalesce(duration_ms::VARCHAR, '')) END AS item_key
  FROM raw_items
),
items AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY playlist_id, item_key ORDER BY position) = 1)
"""

MATCHES = f"""
by_id AS (SELECT i.*, c.track_id AS found FROM items i LEFT JOIN (SELECT DISTINCT track_id FROM catalog) c ON c.track_id = i.source_track_id),
meta AS (
  SELECT i.playlist_id, i.item_key, i.position, c.track_id AS found
  FROM items i JOIN catalog c ON c.title_canon = i.title_canon AND c.artist_primary_canon = i.artist_canon AND (coalesce(i.duration_ms, 0) = 0 OR abs(c.duration_ms - i.duration_ms) <= 2000)
  QUALIFY row_number() OVER (PARTITION BY i.playlist_id, i.item_key ORDER BY regexp_matches(lower(c.title_raw), '{"|".join(MATCH_VARIANTS)}'), c.popularity DESC NULLS LAST, c.release_year DESC NULLS LAST, c.track_id) = 1
),
best AS (
  SELECT b.playlist_id, b.position, b.source_track_id, coalesce(b.found, m.found) AS catalog_track_id, coalesce(b.found, m.found) IS NOT NULL AS matched, b.title, b.artist
  FROM by_id b LEFT JOIN meta m ON m.playlist_id = b.playlist_id AND m.item_key = b.item_key
)
"""

SUMMARY = """
totals AS (SELECT playlist_id, count(*) AS total_source_tracks FROM raw_items GROUP BY 1),
summary AS (
  SELECT playlist_id, total_source_tracks, count(*) AS total_unique_source_tracks, total_source_tracks - count(*) AS duplicate_tracks_removed,
    sum(matched::INTEGER)::BIGINT AS matched_unique_tracks, round(sum(matched::INTEGER) / count(*), 6) AS match_rate, sum(matched::INTEGER) >= 10 AS included
  FROM best JOIN totals USING (playlist_id) GROUP BY playlist_id, total_source_tracks
)
"""


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0::DOUBLE"


def each(pattern: str, names=FEATURES) -> str:
    return ", ".join(pattern.replace("@", f) for f in names)


_T = {
    "tempo": "CASE WHEN tempo IS NOT NULL THEN ln(1 + greatest(0.0, least(300.0, tempo))) END",
    "loudness": "CASE WHEN loudness IS NOT NULL THEN greatest(-60.0, least(0.0, loudness)) END",
    "duration_ms": "CASE WHEN duration_ms IS NOT NULL THEN ln(1 + greatest(30000.0, least(1200000.0, duration_ms::DOUBLE)) / 60000) END",
}


UNIT = "(('0x' || substr(md5({0}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def transformed(name: str, src: str) -> str:
    cols = ", ".join(f"({_T.get(f, f)})::DOUBLE AS t_{f}" for f in FEATURES)
    return f"{name} AS (SELECT *, {cols} FROM {src})"


def fitted(name: str, src: str) -> str:
    """Statistics of a transformed source: one row."""
    return f"""
{name}_m AS (SELECT {each("coalesce(median(t_@), 0) AS med_@")} FROM {src}),
{name} AS (
  SELECT {each("any_value(med_@) AS med_@")}, {each("avg(coalesce(t_@, med_@)) AS mean_@")},
    {each("CASE WHEN stddev_pop(coalesce(t_@, med_@)) < 1e-12 THEN 1 ELSE stddev_pop(coalesce(t_@, med_@)) END AS sd_@")}
  FROM {src}, {name}_m
)"""


def scaled(name: str, src: str, stats: str) -> str:
    return f"{name} AS (SELECT {src}.*, {each('(coalesce(t_@, med_@) - mean_@) / sd_@ AS z_@')} FROM {src}, {stats})"


def cosine(u, v, pairs) -> str:
    dot = " + ".join(f"{u(x)} * {v(x)}" for x in pairs)
    a, b = (" + ".join(f"{s(x)} * {s(x)}" for x in pairs) for s in (u, v))
    return f"CASE WHEN sqrt({a}) * sqrt({b}) > 0 THEN ({dot}) / (sqrt({a}) * sqrt({b})) ELSE 0 END"


SEEDS = "seeds AS (SELECT * FROM catalog WHERE track_id IN (SELECT catalog_track_id FROM memberships WHERE playlist_id = '7' AND matched ORDER BY position LIMIT 5))"
POOL = "pool AS (SELECT * FROM catalog WHERE coalesce(popularity, 0) >= 20 AND track_id NOT IN (SELECT track_id FROM seeds) ORDER BY md5('0:' || track_id), track_id LIMIT 100000)"
REQUEST = ",\n".join(
    [
        TRACKS, MEMBERSHIPS, SEEDS, POOL, transformed("pool_t", "pool"), fitted("stats", "pool_t"), scaled("pool_z", "pool_t", "stats"), transformed("seeds_t", "seeds"), scaled("seeds_z", "seeds_t", "stats"),
        f"prof AS (SELECT {each('median(z_@) AS p_@')}, median(energy) AS b_energy, median(valence) AS b_valence FROM seeds_z)",
    ]
)

_UNWEIGHTED = cosine(lambda f: f"p_{f}", lambda f: f"z_{f}", FEATURES)
_WEIGHTED = cosine(lambda x: f"(p_{x[0]} * {x[1]})", lambda x: f"(z_{x[0]} * {x[1]})", list(zip(FEATURES, _W)))
_CENTRED = cosine(lambda x: f"((p_{x[0]} - c_{x[0]}) * {x[1]})", lambda x: f"((z_{x[0]} - c_{x[0]}) * {x[1]})", list(zip(FEATURES, _W)))


def _penalty(f: str, d: float) -> str:
    target = f"greatest(0.0, least(1.0, b_{f} + {d} * 0.7))"
    return f"0.2 * abs(coalesce({f}, b_{f}) - {target})"


_STEERED = f"round(round({_WEIGHTED}, 9) - {_penalty('energy', 0.25)} - {_penalty('valence', -0.3)}, 9)"


def _scores(sim: str, score: str | None = None) -> str:
    return f"WITH {REQUEST} SELECT track_id, {r6(f'round({sim}, 9)')} AS similarity, {r6(score or f'round({sim}, 9)')} AS score FROM pool_z, prof"


def _top(sim: str, score: str) -> str:
    return f"""WITH {REQUEST}, s AS (SELECT track_id, round({sim}, 9) AS similarity, {score} AS score FROM pool_z, prof)
SELECT rank, track_id, {r6('similarity')} AS similarity, {r6('score')} AS score
FROM (SELECT *, row_number() OVER (ORDER BY score DESC, track_id)::INTEGER AS rank FROM s) WHERE rank <= 10"""




def _form(key: str, fill: str, forms) -> str:
    """By a row's key one of the forms, filled."""
    quoted = ", ".join("'" + f.replace("'", "''") + "'" for f in forms)
    return f"replace(([{quoted}])[{key} % {len(forms)} + 1], '{{}}', {fill}::VARCHAR)"


def _formed(table: str, key: str, fill: str, column: str, forms) -> str:
    return f"(SELECT {key}, {fill}, {_form(key, fill, forms)} AS {column} FROM {table})"


# merge

RAW = f"""
raw0 AS (
  SELECT p_partkey::VARCHAR AS track_id, p_name AS title_raw, [p_brand] AS artists, (p_size * 9000 + (p_partkey % 7) * 1000)::INTEGER AS duration_ms, p_partkey % 2 = 0 AS explicit,
    (p_partkey % 100)::INTEGER AS popularity, (1960 + p_partkey % 60)::INTEGER AS release_year, CASE WHEN p_partkey % 3 = 0 THEN 'I' || (p_partkey // 6) END AS isrc, p_type AS album,
    least(1.0::DOUBLE, p_size / 50) AS energy, NULL::DOUBLE AS valence, CASE WHEN p_partkey % 11 <> 0 THEN (60 + p_size)::DOUBLE END AS tempo, p_partkey AS ord
  FROM part
  UNION ALL
  SELECT p_partkey::VARCHAR, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' (Live)' ELSE '' END, [p_brand, 'Guest'], (p_size * 9000 + (p_partkey % 7) * 1000 + (p_partkey % 5) * 900)::INTEGER, NULL,
    ((p_partkey * 3) % 101)::INTEGER, (1961 + p_partkey % 59)::INTEGER, NULL, NULL, NULL, CASE WHEN p_partkey % 4 = 0 THEN 1.0::DOUBLE ELSE p_size / 100 END, NULL, (1::BIGINT << 50) + p_partkey
  FROM part
  UNION ALL
  SELECT NULL, upper(p_name), [p_brand, 'Other'], (p_size * 9000 + 400)::INTEGER, NULL, NULL, NULL, CASE WHEN p_partkey % 3 = 0 THEN 'I' || (p_partkey // 6) END, NULL, NULL, NULL, NULL, (2::BIGINT << 50) + p_partkey
  FROM part
),
norm AS (SELECT *, {canon("title_raw")} AS title_canon, lower(artists[1]) AS artist_canon FROM raw0)
"""


def merge_pass(name: str, src: str, keys: list[str], step: int) -> str:
    named = ", ".join(f"{k} AS k{i}" for i, k in enumerate(keys))
    by = ", ".join(f"k{i}" for i in range(len(keys)))
    some = " AND ".join(f"k{i} IS NOT NULL" for i in range(len(keys)))
    first = lambda c: f"first({c} ORDER BY ord) FILTER ({c} IS NOT NULL) AS {c}"
    return f"""
{name}_k AS (SELECT *, {named} FROM {src}),
{name}_g AS (
  SELECT {first('track_id')}, {first('isrc')}, first(title_raw ORDER BY length(title_raw) DESC, ord) AS title_raw, first(artists ORDER BY len(artists) DESC, ord) AS artists,
    first(album ORDER BY length(album) DESC, ord) FILTER (album IS NOT NULL) AS album, max(popularity) AS popularity, bool_or(explicit) AS explicit, max(release_year) AS release_year,
    list_reduce(list(duration_ms ORDER BY ord) FILTER (duration_ms IS NOT NULL), lambda a, d: CASE WHEN abs(a - d) <= 2000 THEN greatest(a, d) ELSE a END) AS duration_ms,
    {first('energy')}, {first('valence')}, {first('tempo')}, min(ord) AS ord
  FROM {name}_k WHERE {some} GROUP BY {by}
),
{name} AS (
  SELECT track_id, isrc, title_raw, {canon('title_raw')} AS title_canon, artists, lower(artists[1]) AS artist_canon, album, popularity, explicit, release_year, duration_ms, energy, valence, tempo, ord FROM {name}_g
  UNION ALL BY NAME
  SELECT track_id, isrc, title_raw, title_canon, artists, artist_canon, album, popularity, explicit, release_year, duration_ms, energy, valence, tempo, ord + (1::BIGINT << {58 + step}) AS ord
  FROM {name}_k WHERE NOT ({some})
)"""


_CANON_KEY = ["nullif(title_canon, '')", "nullif(artist_canon, '')", "round_even(duration_ms / 3000, 0)"]


def _merged(ctes: str, name: str) -> str:
    return f"""WITH {RAW}{ctes} SELECT track_id, title_raw, title_canon, artist_canon AS artist_primary_canon, duration_ms, explicit, popularity, release_year, isrc, album,
  array_to_string(artists, '|') AS artists, {r6('energy')} AS energy, {r6('valence')} AS valence, {r6('tempo')} AS tempo FROM {name}"""


# benchmark

SPLIT = f"""{MEMBERSHIPS},
splits AS (SELECT unnest([0, 1])::INTEGER AS split_id),
ordered AS (
  SELECT playlist_id, split_id, catalog_track_id, row_number() OVER (PARTITION BY playlist_id, split_id ORDER BY md5('0:' || playlist_id || ':' || split_id || ':split:' || catalog_track_id), catalog_track_id)::INTEGER AS place
  FROM (SELECT DISTINCT playlist_id, catalog_track_id FROM memberships WHERE matched), splits
),
sizes AS (
  SELECT playlist_id, split_id, coalesce(n_matched, 0) AS n_matched, n FROM (SELECT playlist_id, count(*) AS n, count(catalog_track_id) AS n_matched FROM memberships GROUP BY 1), splits
),
asked AS (SELECT *, n - 5 AS num_positives, n_matched - 5 AS num_matched FROM sizes WHERE n_matched >= 5 AND n > 5)
"""

BENCH = f"""RECURSIVE {TRACKS}, {SPLIT},
{transformed("cat_t", "catalog")},
cat_o AS (SELECT *, row_number() OVER (ORDER BY md5('0:' || track_id), track_id) AS o FROM cat_t),
req_seeds AS (SELECT playlist_id, split_id, catalog_track_id AS track_id FROM ordered JOIN asked USING (playlist_id, split_id) WHERE place <= 5),
req_pool AS (
  SELECT a.playlist_id, a.split_id, c.* FROM asked a, cat_o c
  WHERE coalesce(c.popularity, 0) >= 20 AND NOT EXISTS (FROM req_seeds s WHERE s.playlist_id = a.playlist_id AND s.split_id = a.split_id AND s.track_id = c.track_id)
),
req_m AS (SELECT playlist_id, split_id, count(*) AS pool_size, {each("coalesce(median(t_@), 0) AS med_@")} FROM req_pool GROUP BY 1, 2),
req_s AS (
  SELECT playlist_id, split_id, any_value(pool_size) AS pool_size, {each("any_value(med_@) AS med_@")}, {each("avg(coalesce(t_@, med_@)) AS mean_@")}, {each("stddev_pop(coalesce(t_@, med_@)) AS sd_@")}
  FROM req_pool JOIN req_m USING (playlist_id, split_id) GROUP BY 1, 2
),
req_p AS (
  SELECT playlist_id, split_id, {each("median((coalesce(t_@, med_@) - mean_@) / CASE WHEN sd_@ < 1e-12 THEN 1 ELSE sd_@ END) AS p_@")}, median(energy) AS b_energy, median(valence) AS b_valence
  FROM req_seeds JOIN cat_t USING (track_id) JOIN req_s USING (playlist_id, split_id) GROUP BY 1, 2
),
req_z AS (
  SELECT playlist_id, split_id, track_id, artist_primary_canon, popularity, energy, valence, pool_size, o, b_energy, b_valence, {each("p_@")}, {each("(coalesce(t_@, med_@) - mean_@) / CASE WHEN sd_@ < 1e-12 THEN 1 ELSE sd_@ END AS z_@")}
  FROM req_pool JOIN req_s USING (playlist_id, split_id) JOIN req_p USING (playlist_id, split_id)
),
req_scores AS (
  SELECT playlist_id, split_id, track_id, artist_primary_canon, popularity, pool_size, unnest([
    {{'s': 'popularity', 'x': coalesce(popularity, 0)::DOUBLE}}, {{'s': 'unweighted_cosine', 'x': round({_UNWEIGHTED}, 9)}}, {{'s': 'weighted_cosine', 'x': round({_WEIGHTED}, 9)}},
    {{'s': 'weighted_cosine_pca', 'x': round({_WEIGHTED}, 9)}}, {{'s': 'deployed', 'x': round({_WEIGHTED}, 9)}},
    {{'s': 'weighted_cosine_pca_steered', 'x': round(round({_WEIGHTED}, 9) - {_penalty('energy', 0.25)} - {_penalty('valence', 0.25)}, 9)}}]) AS e
  FROM req_z
),
ranked AS (
  SELECT playlist_id, split_id, e.s AS strategy, track_id, artist_primary_canon, popularity, pool_size, e.x AS score,
    row_number() OVER (PARTITION BY playlist_id, split_id, e.s ORDER BY e.x DESC, track_id)::INTEGER AS rank
  FROM req_scores QUALIFY rank <= CASE WHEN e.s = 'deployed' THEN 30 ELSE 10 END
),
drawn AS (
  SELECT * FROM ranked WHERE strategy = 'deployed' QUALIFY row_number() OVER (PARTITION BY playlist_id, split_id
    ORDER BY -ln(greatest({UNIT.format("'0:' || playlist_id || ':' || split_id || ':deployed:' || track_id")}, 1e-300)) / exp(-(rank - 1) / 10), track_id) <= 10
),
-- a partial shuffle: place i takes the row at j, which an earlier step s with the same j has filled with the one at s
jumps AS (
  SELECT a.playlist_id, a.split_id, list(i + floor({UNIT.format("'0:' || a.playlist_id || ':' || a.split_id || ':random:' || i")} * (pool_size - i))::BIGINT ORDER BY i) AS js
  FROM asked a JOIN req_s USING (playlist_id, split_id), (SELECT unnest(range(10)) AS i) GROUP BY 1, 2
),
chase AS (
  SELECT playlist_id, split_id, js, i, js[i + 1] AS p, i AS bound FROM jumps, (SELECT unnest(range(10)) AS i)
  UNION ALL
  SELECT playlist_id, split_id, js, i, bound - list_position(list_reverse(js[1 : bound]), p) AS p, bound - list_position(list_reverse(js[1 : bound]), p) AS bound
  FROM chase WHERE bound > 0 AND list_contains(js[1 : bound], p)
),
placed AS (SELECT playlist_id, split_id, i, arg_min(p, bound) AS p FROM chase GROUP BY 1, 2, 3),
random AS (
  SELECT r.playlist_id, r.split_id, 'random' AS strategy, track_id, artist_primary_canon, popularity, pool_size, (10 - i)::DOUBLE AS score, (i + 1)::INTEGER AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY playlist_id, split_id ORDER BY o) - 1 AS p FROM req_z) r JOIN placed USING (playlist_id, split_id, p)
),
recs AS (
  FROM ranked WHERE strategy <> 'deployed'
  UNION ALL BY NAME SELECT * REPLACE (row_number() OVER (PARTITION BY playlist_id, split_id ORDER BY rank)::INTEGER AS rank) FROM drawn
  UNION ALL BY NAME FROM random
)
"""

PER_SPLIT = f"""{BENCH},
retr AS (
  SELECT a.playlist_id, a.split_id, count(p.track_id) AS num_retrievable
  FROM asked a LEFT JOIN ordered o ON o.playlist_id = a.playlist_id AND o.split_id = a.split_id AND o.place > 5
    LEFT JOIN req_pool p ON p.playlist_id = a.playlist_id AND p.split_id = a.split_id AND p.track_id = o.catalog_track_id GROUP BY 1, 2
),
hits AS (
  SELECT r.*, (o.place > 5)::INTEGER AS hit FROM recs r LEFT JOIN ordered o ON o.playlist_id = r.playlist_id AND o.split_id = r.split_id AND o.catalog_track_id = r.track_id
),
per AS (
  SELECT playlist_id, split_id, strategy, any_value(pool_size) AS candidate_pool_size, coalesce(sum(hit), 0) AS hits, coalesce(sum(CASE WHEN hit = 1 THEN 1 / log2(rank + 1) END), 0) AS dcg,
    count(*) AS n_recs, count(DISTINCT artist_primary_canon) AS n_artists, avg(popularity) AS pop,
    CASE WHEN strategy LIKE 'weighted_cosine_pca%' THEN (avg(abs(c.energy - greatest(0, least(1, b_energy + 0.25 * 0.7)))) + avg(abs(c.valence - greatest(0, least(1, b_valence + 0.25 * 0.7))))) / 2 END AS distance
  FROM hits JOIN req_p USING (playlist_id, split_id) JOIN (SELECT track_id, energy, valence FROM catalog) c USING (track_id) GROUP BY 1, 2, 3
)
SELECT playlist_id, split_id, strategy, candidate_pool_size, {r6('hits / 10')} AS precision_at_k, {r6('hits / num_positives')} AS recall_at_k,
  {r6("dcg / list_sum(list_transform(range(1, least(num_positives, 10) + 1), lambda i: 1 / log2(i + 1)))")} AS ndcg_at_k,
  {r6('CASE WHEN num_matched > 0 THEN hits / num_matched ELSE 0 END')} AS matched_recall_at_k, {r6('CASE WHEN num_retrievable > 0 THEN hits / num_retrievable ELSE 0 END')} AS retrievable_recall_at_k,
  {r6('num_matched / num_positives')} AS matched_recall_ceiling, {r6('num_retrievable / num_positives')} AS candidate_recall_ceiling, {r6('n_recs / 10')} AS fill_rate,
  {r6('n_artists / n_recs')} AS artist_diversity, {r6('pop')} AS avg_recommendation_popularity, {r6('distance')} AS steering_target_distance
FROM per JOIN asked USING (playlist_id, split_id) JOIN retr USING (playlist_id, split_id)
"""

LOG = """
log AS (SELECT event_type AS strategy, user_id::VARCHAR AS playlist_id, (event_id % 977)::VARCHAR AS track_id, value FROM events),
means AS (SELECT playlist_id, strategy, avg(value) AS ndcg_at_k, avg(value / 7) AS recall_at_k FROM log GROUP BY 1, 2)
"""

_FILTER = "coalesce(popularity, 0) >= 20 AND track_id NOT IN ('1', '2') AND artist_primary_canon NOT IN ('brand#7', 'brand#12')"


def oracle_sql() -> dict[str, str]:
    from .queries import ARTIST_FIELDS, ARTIST_NAMES, BOOLEANS, EDGE_TITLES, PLAYLIST_REFERENCES

    cat = f"WITH {TRACKS}"
    lab = f"WITH {MEMBERSHIPS}"
    scal = f"{cat}, {transformed('cat_t', 'catalog')}, {fitted('stats', 'cat_t')}, {scaled('cat_z', 'cat_t', 'stats')}"
    match = f"WITH {TRACKS}, {ITEMS}, {MATCHES}"
    prof = lambda agg: f"{scal}, {MEMBERSHIPS} SELECT playlist_id, {each(f'round({agg}(z_@), 6) + 0.0::DOUBLE AS @')} FROM memberships JOIN cat_z ON track_id = catalog_track_id GROUP BY 1"
    sample = f"""WITH {REQUEST}, s AS (SELECT track_id, round({_WEIGHTED}, 9) AS score FROM pool_z, prof),
  ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, track_id) AS r FROM s QUALIFY r <= 30),
  drawn AS (SELECT *, row_number() OVER (ORDER BY -ln(greatest({UNIT.format("'3:' || track_id")}, 1e-300)) / exp(-(r - 1) / 10), track_id) AS k FROM ranked)
SELECT row_number() OVER (ORDER BY r)::INTEGER AS rank, track_id, {r6('score')} AS score FROM drawn WHERE k <= 10"""
    names, as_name, as_text = zip(*ARTIST_NAMES)
    fields, many, one = zip(*ARTIST_FIELDS)
    brand = lambda forms, fill="p_brand": _form("p_partkey", fill, forms)
    return {
        "catalog_scan": f"{cat} SELECT track_id, title_raw, title_canon, artist_primary_canon, popularity, release_year, duration_ms, {each('round(@, 6) + 0.0::DOUBLE AS @', [f for f in FEATURES if f != 'duration_ms'])} FROM catalog",
        "typed_projection": f"{cat} SELECT track_id, release_year::SMALLINT AS release_year, duration_ms, {each('round(@::FLOAT::DOUBLE, 6) + 0.0::DOUBLE AS @', ['popularity', 'energy', 'tempo', 'loudness'])} FROM catalog",
        "filter_candidates": f"{cat} SELECT track_id, popularity, release_year, artist_primary_canon FROM catalog WHERE {_FILTER} AND coalesce(popularity, 100) <= 90 AND release_year BETWEEN 1970 AND 2010",
        "count_candidates": f"{cat} SELECT count(*) AS eligible FROM catalog WHERE {_FILTER}",
        "bounded_sample": f"{cat} SELECT track_id FROM catalog WHERE coalesce(popularity, 0) >= 20 ORDER BY md5('0:' || track_id), track_id LIMIT 100",
        "load_tracks_ordered": f"{cat} SELECT track_id, title_raw FROM catalog WHERE track_id IN ('9', '4', '11')",
        "point_lookup": f"{cat} SELECT track_id, title_raw, artist_primary_canon FROM catalog WHERE track_id = '11'",
        "fallback_candidates": f"{cat}, {MEMBERSHIPS}, {SEEDS} SELECT track_id, true AS bound_dropped FROM catalog WHERE track_id NOT IN (SELECT track_id FROM seeds)",
        "exclude_same_artist": f"{cat}, {MEMBERSHIPS}, {SEEDS} SELECT track_id, artist_primary_canon FROM catalog WHERE coalesce(popularity, 0) >= 20 AND track_id NOT IN (SELECT track_id FROM seeds) AND artist_primary_canon NOT IN (SELECT artist_primary_canon FROM seeds)",
        "seen_exclusion": f"{cat} SELECT track_id FROM catalog WHERE coalesce(popularity, 0) >= 20 AND track_id NOT IN (SELECT (user_id * 3)::VARCHAR FROM events WHERE event_type = 'view')",
        "canon_title": f"WITH {ITEMS} SELECT DISTINCT title, {canon('title')} AS canon FROM raw_items",
        "canon_title_edges": f"SELECT p_partkey, title, {canon('title')} AS canon FROM {_formed('part', 'p_partkey', 'p_name', 'title', EDGE_TITLES)}",
        "canon_artist": f"SELECT p_partkey, {brand(names)} AS name, {brand(as_name, 'lower(p_brand)')} AS as_name, {brand(as_text, 'lower(p_brand)')} AS as_text FROM part",
        "parse_artists": f"SELECT p_partkey, {brand(fields)} AS field, {brand(many)} AS many, {brand(one)} AS one FROM part",
        "parse_bool": f"SELECT o_orderkey, v, CASE WHEN lower(trim(v)) IN ('true', '1', 'yes', '1.0') THEN true WHEN lower(trim(v)) IN ('false', '0', 'no', '0.0') THEN false END AS b FROM {_formed('orders', 'o_orderkey', 'o_orderstatus', 'v', BOOLEANS)}",
        "playlist_id_extract": f"SELECT c_custkey, v, coalesce(nullif(regexp_extract(trim(v), 'playlist[/:]([A-Za-z0-9]+)', 1), ''), nullif(regexp_extract(trim(v), '^([A-Za-z0-9]+)$', 1), '')) AS id FROM {_formed('customer', 'c_custkey', 'c_nationkey', 'v', PLAYLIST_REFERENCES)}",
        "artist_display": f"WITH {ITEMS} SELECT DISTINCT artist AS first, artist || ', Guest' AS shown, 'Unknown artist' AS unknown FROM raw_items",
        "track_uris": f"WITH {ITEMS} SELECT DISTINCT 'track:' || source_track_id AS uri FROM raw_items WHERE source_track_id IS NOT NULL",
        "setting_scale": "SELECT setting, round((greatest(1, least(10, setting)) - 5.5) / 9, 6) + 0.0::DOUBLE AS shift FROM (SELECT DISTINCT (l_quantity - 2) / 4 AS setting FROM lineitem)",
        "source_identity": f"WITH {ITEMS} SELECT substr(item_key, 1, 1) AS kind, count(*) AS n, count(DISTINCT item_key) AS n_keys FROM keyed GROUP BY 1",
        "normalize_rows": _merged("", "norm"),
        "known_comma_artists": "SELECT DISTINCT lower(p_brand) || '|the ' || lower(p_type) AS key, p_brand || ', The ' || p_type AS name FROM part",
        "dedupe_by_id": _merged("," + merge_pass("a", "norm", ["track_id"], 0), "a"),
        "dedupe_by_isrc": _merged("," + merge_pass("a", "norm", ["isrc"], 1), "a"),
        "dedupe_by_canon_duration": _merged("," + merge_pass("a", "norm", _CANON_KEY, 2), "a"),
        "merge_three_pass": _merged(
            "," + merge_pass("a", "norm", ["track_id"], 0) + "," + merge_pass("b", "a", ["isrc"], 1) + "," + merge_pass("c", "b", _CANON_KEY, 2)
            + ", e AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY track_id, isrc, title_canon, artist_canon, duration_ms ORDER BY ord) = 1)", "e"),
        "duplicate_reduction": "SELECT 3 * count(*) AS raw_rows, 2 * count(*) AS merged_rows, round(1.0::DOUBLE / 3, 6) AS rate FROM part",
        "match_by_id": f"{match} SELECT playlist_id, position, source_track_id, found AS catalog_track_id FROM by_id",
        "match_by_metadata": f"{match} SELECT playlist_id, position, found AS catalog_track_id FROM meta",
        "match_best": f"{match} SELECT playlist_id, position, catalog_track_id, matched FROM best",
        "membership_labels": f"{match} SELECT playlist_id, position, source_track_id, catalog_track_id, matched, title AS source_title, artist || ', Guest' AS source_artist FROM best",
        "match_summary": f"{match}, {SUMMARY} FROM summary",
        "label_builder": f"{match}, {SUMMARY} SELECT playlist_id, position, catalog_track_id, matched FROM best WHERE playlist_id IN (SELECT playlist_id FROM summary WHERE matched_unique_tracks >= 20)",
        "match_rollup": f"{match}, {SUMMARY} SELECT count(*) AS num_playlists, sum(total_unique_source_tracks)::BIGINT AS total_tracks, sum(matched_unique_tracks)::BIGINT AS matched_tracks, round(sum(matched_unique_tracks) / sum(total_unique_source_tracks), 6) AS match_rate FROM summary",
        "playlist_profile_rows": f"{match} SELECT playlist_id, count(*) AS n, count(DISTINCT catalog_track_id) AS n_tracks FROM best WHERE matched GROUP BY 1",
        "normalize_memberships": f"WITH {OCCURRENCES} SELECT playlist_id, min(position) AS position, pk::VARCHAR AS source_track_id, pk::VARCHAR AS catalog_track_id, true AS matched FROM occ GROUP BY playlist_id, pk",
        "membership_audit": f"""{lab}, n AS (SELECT playlist_id, count(*) AS n, sum(matched::INTEGER) AS m FROM memberships GROUP BY 1),
          pairs AS (SELECT a.playlist_id AS a, b.playlist_id AS b, count(*) AS c FROM memberships a JOIN memberships b ON a.source_track_id = b.source_track_id AND a.playlist_id < b.playlist_id GROUP BY 1, 2),
          j AS (SELECT c / (x.n + y.n - c) AS j FROM pairs JOIN n x ON x.playlist_id = a JOIN n y ON y.playlist_id = b)
          SELECT count(*) AS num_playlists, sum(n)::BIGINT AS num_memberships, sum(m)::BIGINT AS matched_memberships, round(sum(m) / sum(n), 6) AS match_rate, min(n) AS min_playlist_size, median(n) AS median_playlist_size,
            max(n) AS max_playlist_size, (SELECT round(max(j), 6) FROM j) AS max_pairwise_jaccard, (SELECT count(*) FROM j WHERE j >= 0.8) AS near_duplicate_pairs, count(*) >= 50 AS benchmark_ready FROM n""",
        "pairwise_jaccard": f"""{lab}, n AS (SELECT playlist_id, count(*) AS n FROM memberships GROUP BY 1),
          pairs AS (SELECT a.playlist_id AS a, b.playlist_id AS b, count(*) AS shared FROM memberships a JOIN memberships b ON a.source_track_id = b.source_track_id AND a.playlist_id < b.playlist_id GROUP BY 1, 2)
          SELECT a, b, shared, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM pairs JOIN n x ON x.playlist_id = a JOIN n y ON y.playlist_id = b WHERE shared / (x.n + y.n - shared) >= 0.1""",
        "special_transforms": f"{cat}, {transformed('cat_t', 'catalog')} SELECT track_id, {each('round(t_@, 6) + 0.0::DOUBLE AS @', ['tempo', 'loudness', 'duration_ms'])} FROM cat_t",
        "scaler_stats": f"{scal} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, {r6(f'med_{f}')} AS median, {r6(f'mean_{f}')} AS mean, {r6(f'sd_{f}')} AS sd FROM stats" for f in FEATURES),
        "impute_medians": f"{scal} SELECT track_id, {r6('coalesce(t_tempo, med_tempo)')} AS tempo, {r6('coalesce(t_loudness, med_loudness)')} AS loudness FROM cat_t, stats",
        "scaled_features": f"{scal} SELECT track_id, {each('round(z_@, 6) + 0.0::DOUBLE AS @')} FROM cat_z",
        "weighted_features": f"{scal} SELECT track_id, " + ", ".join(f"{r6(f'z_{f} * {w}')} AS {f}" for f, w in zip(FEATURES, _W)) + " FROM cat_z",
        "profile_median": prof("median"),
        "profile_mean": prof("avg"),
        "cosine_unweighted": _scores(_UNWEIGHTED),
        "cosine_weighted": _scores(_WEIGHTED),
        "cosine_pca_full_rank": f"WITH {REQUEST}, c AS (SELECT {each('avg(z_@) AS c_@')} FROM pool_z) SELECT track_id, {r6(_CENTRED)} AS similarity, {r6(_CENTRED)} AS score FROM pool_z, prof, c",
        "pca_2d": f"""{scal}, m AS (SELECT avg(z_energy) AS ex, avg(z_valence) AS ey, 0.5 * atan2(2 * covar_pop(z_energy, z_valence), var_pop(z_energy) - var_pop(z_valence)) AS th FROM cat_z)
          SELECT track_id, round(power((z_energy - ex) * cos(th) + (z_valence - ey) * sin(th), 2), 6) + 0.0::DOUBLE AS first, round(power((z_valence - ey) * cos(th) - (z_energy - ex) * sin(th), 2), 6) + 0.0::DOUBLE AS second FROM cat_z, m""",
        "steered_rerank": _scores(_WEIGHTED, _STEERED),
        "explanations": f"""WITH {REQUEST}, e AS (SELECT track_id, list_sort([{', '.join(f"{{'d': abs(z_{f} - p_{f}), 'i': {i}, 'f': '{f}'}}" for i, f in enumerate(FEATURES) if f in ('energy', 'valence', 'acousticness', 'tempo'))}]) AS l FROM pool_z, prof)
          SELECT track_id, 'Recommended because it is similar to your playlist in ' || l[1].f || ', ' || l[2].f || ', and ' || l[3].f || '.' AS recommendation_reason FROM e""",
        "recommend_weighted": _top(_WEIGHTED, _STEERED),
        "topn_popularity": f"""WITH {REQUEST}, s AS (SELECT track_id, coalesce(popularity, 0)::DOUBLE AS score FROM pool)
          SELECT row_number() OVER (ORDER BY score DESC, track_id)::INTEGER AS rank, track_id, score AS similarity, score FROM s QUALIFY rank <= 10""",
        "topn_random": f"""WITH {REQUEST}, s AS (SELECT track_id, row_number() OVER (ORDER BY md5('5:' || track_id), track_id)::INTEGER AS rank FROM pool)
          SELECT rank, track_id, (11 - rank)::DOUBLE AS similarity, (11 - rank)::DOUBLE AS score FROM s WHERE rank <= 10""",
        "topn_weighted_sample": sample,
        "seed_split": f"WITH {SPLIT} SELECT playlist_id, split_id, place, catalog_track_id FROM ordered WHERE place <= 5",
        "split_requests": f"WITH {SPLIT} SELECT playlist_id, split_id, 5 AS num_seeds, num_matched::INTEGER AS num_matched_positives, num_positives FROM asked",
        "skipped_requests": f"WITH {SPLIT} SELECT playlist_id, split_id, CASE WHEN n_matched < 5 THEN 'too few matched tracks for 5 seeds' ELSE 'nothing is left to be found' END AS reason FROM sizes WHERE n_matched < 5 OR n <= 5",
        "playlist_partition": f"""{lab}, p AS (SELECT DISTINCT playlist_id FROM memberships), o AS (SELECT playlist_id, row_number() OVER (ORDER BY md5('0:partition:' || playlist_id), playlist_id) AS r, count(*) OVER () AS n FROM p)
          SELECT playlist_id, r <= ceil(n * 0.2) AS is_test FROM o""",
        "benchmark_recommendations": f"WITH {BENCH} SELECT playlist_id, split_id, strategy, rank, track_id, {r6('score')} AS score FROM recs",
        "benchmark_per_split": f"WITH {PER_SPLIT}",
        "exposure_summary": f"""WITH {LOG}, s AS (SELECT unnest(['click', 'view', 'never']) AS strategy), c AS (SELECT strategy, count(DISTINCT track_id) AS u, count(*) AS t FROM log GROUP BY 1)
          SELECT strategy, coalesce(u, 0) AS unique_recommendations, coalesce(t, 0) AS total_recommendations, CASE WHEN t > 0 THEN round(1 - u / t, 6) + 0.0::DOUBLE ELSE 0 END AS recommendation_repeat_rate,
            round(coalesce(u, 0) / 2000, 6) + 0.0::DOUBLE AS catalog_coverage FROM s LEFT JOIN c USING (strategy)""",
        "playlist_means": f"WITH {LOG} SELECT playlist_id, strategy, {r6('ndcg_at_k')} AS ndcg_at_k, {r6('recall_at_k')} AS recall_at_k FROM means",
        "bootstrap_ci": f"""WITH {LOG}, v AS (SELECT strategy, metric, list(value ORDER BY playlist_id) AS v FROM (UNPIVOT means ON ndcg_at_k, recall_at_k INTO NAME metric VALUE value) GROUP BY 1, 2),
          b AS (SELECT strategy, metric, v, unnest(range(50)) AS b FROM v),
          d AS (SELECT strategy, metric, b, v, unnest(range(len(v))) AS i FROM b),
          s AS (SELECT strategy, metric, b, avg(v[1 + floor({UNIT.format("'0:' || strategy || ':' || metric || ':' || b || ':' || i")} * len(v))::INTEGER]) AS m FROM d GROUP BY 1, 2, 3)
          SELECT strategy, metric, any_value(round(list_avg(v), 6)) + 0.0::DOUBLE AS mean, round(quantile_cont(m, 0.05), 6) + 0.0::DOUBLE AS ci_low, round(quantile_cont(m, 0.95), 6) + 0.0::DOUBLE AS ci_high
          FROM s JOIN v USING (strategy, metric) GROUP BY 1, 2""",
        "trial_selection": f"""WITH {LOG}, t AS (SELECT strategy AS name, round(avg(ndcg_at_k), 1) AS ndcg, round(avg(recall_at_k), 6) AS recall FROM means GROUP BY 1),
          i AS (SELECT dense_rank() OVER (ORDER BY name)::INTEGER AS index, name, ndcg, recall FROM t) FROM i ORDER BY ndcg DESC, recall DESC, index LIMIT 1""",
        "target_distance": f"""{cat}, {MEMBERSHIPS}, r AS (SELECT playlist_id, c.energy, c.valence FROM memberships JOIN catalog c ON track_id = catalog_track_id),
          b AS (SELECT playlist_id, greatest(0, least(1, median(energy) + 0.25 * 0.7)) AS te, greatest(0, least(1, median(valence) - 0.3 * 0.7)) AS tv FROM r GROUP BY 1)
          SELECT playlist_id, round((avg(abs(energy - te)) + avg(abs(valence - tv))) / 2, 6) + 0.0::DOUBLE AS steering_target_distance FROM r JOIN b USING (playlist_id) GROUP BY 1""",
        "diagnostics": f"""{cat}, {MEMBERSHIPS} SELECT playlist_id, {r6('count(*) / 10')} AS fill_rate, {r6('count(DISTINCT artist_primary_canon) / count(*)')} AS artist_diversity,
            {r6('1 - count(DISTINCT artist_primary_canon) / count(*)')} AS artist_duplication_rate, {r6('avg(energy)')} AS avg_similarity, {r6('avg(popularity)')} AS avg_recommendation_popularity
          FROM memberships JOIN catalog ON track_id = catalog_track_id GROUP BY 1""",
        "hourly_events": f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, {r6('sum(value)')} AS value FROM events GROUP BY 1, 2",
        "first_shown": "SELECT user_id::VARCHAR AS user_id, json_extract_string(props, '$.k') AS track_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_shown FROM events WHERE event_type = 'view' AND json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1, 2",
        "embedding_cosine": """WITH e AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label AS l, i, avg(x) AS m FROM e GROUP BY 1, 2),
          c AS (SELECT vec_id, l, CASE WHEN sum(x * x) * sum(m * m) > 0 THEN round(sum(x * m) / sqrt(sum(x * x) * sum(m * m)), 6) ELSE 0 END AS cosine FROM e JOIN m USING (i) GROUP BY 1, 2)
          SELECT vec_id, l AS label, cosine + 0.0::DOUBLE AS cosine FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, l) = 1""",
    }
