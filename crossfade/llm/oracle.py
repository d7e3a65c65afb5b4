"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), both_of AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM both_of JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), sym AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (
  SELECT a AS doc_id, a AS r FROM sym UNION SELECT reach.doc_id, sym.b FROM reach JOIN sym ON sym.a = reach.r
), comp AS (
  SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(comp.c, d.doc_id)::BIGINT AS component_id, coalesce(comp.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""

OP7 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP8 = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages
), rules(v, h, p) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), j AS (
  SELECT u.*, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS k
  FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM j WHERE k = 1
"""

OP9 = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
bw AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, size, array_to_string(ws[i : i + size - 1], ' ') AS t
  FROM (SELECT item_id, ws, least(10, len(ws)) AS size, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM bw WHERE len(ws) > 0)
),
hit AS (
  SELECT d.doc_id, d.i, d.size, win.item_id
  FROM (SELECT doc_id, size, i, array_to_string(ws[i : i + size - 1], ' ') AS t
        FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM dw, (SELECT DISTINCT size FROM win) WHERE len(ws) >= size)) d
  JOIN win ON win.size = d.size AND win.t = d.t
),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS l FROM hit GROUP BY doc_id)
SELECT dw.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_E = "replace(coalesce({c}, ''), '\\', '\\\\')"
for _g in ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
    _E = f"replace({_E}, '{_g}', '{_g[0]}\\{_g[1:]}')"

OP10 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), t AS (
  SELECT *, length('<|im_start|>') + length({_E.format(c="role")}) + length('<|im_sep|>') + length({_E.format(c="text")}) + length('<|im_end|>') AS size,
    row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), x AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR i = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM x GROUP BY conv_id
"""


LICENSE_BASE = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
f AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
    list_filter(range(len(ws)), lambda i: ws[i + 1 : i + 4] = ['under', 'the', 'mit', 'license']) AS mit,
    list_filter(range(len(ws)), lambda i: ws[i + 1 : i + 4] = ['apache', 'license', 'version', '2']) AS apache,
    list_filter(range(len(ws)), lambda i: ws[i + 1 : i + 3] = ['cc', 'by', 'nc']) AS cc
  FROM w
), a AS (SELECT *, list_concat(mit, apache, cc) AS every FROM f)
SELECT doc_id, n_words, len(every)::BIGINT AS n_base, list_min(every)::BIGINT AS first_word, list_max(every)::BIGINT AS last_word,
  array_to_string(list_filter([CASE WHEN len(apache) > 0 THEN 'apache-2' END, CASE WHEN len(cc) > 0 THEN 'cc-by-nc' END, CASE WHEN len(mit) > 0 THEN 'mit' END], lambda x: x IS NOT NULL), ',') AS base_labels
FROM a
"""

# the texts between the matches of a pattern and the matches give their places; letters of the keywords in either case, for ASCII alone
_KEYWORD = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = rf"""(?:{_KEYWORD})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KIND = """
  SELECT doc_id, '{kind}' AS kind, {order} AS o, k, list_sum(list_transform(gaps[1 : k], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1 : k - 1], lambda x: length(x))), 0) AS a, length(found[k]) AS size
  FROM (SELECT doc_id, found, gaps, held, unnest(range(1, len(found) + 1)) AS k
        FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS found, regexp_split_to_array(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', {group}) AS held FROM d))
  WHERE length(held[k]) >= {least}
"""
_KINDS = "UNION ALL".join(
    _KIND.format(kind=kind, order=n, pattern=pattern, group=group, least=least)
    for n, (kind, pattern, group, least) in enumerate((("assign", _ASSIGN, 1, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32)))
)
SECRET_BASE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({_KINDS}),
l AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || a::BIGINT || ':' || (a + size)::BIGINT, ',' ORDER BY a, o) AS spans
  FROM s GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(spans, '')) AS base_sha256
FROM d LEFT JOIN l USING (doc_id)
"""

TOKEN_ROLLUP_WORDS = r"""
WITH d AS (
  SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM documents
), now AS (
  SELECT source, lang, CASE WHEN doc_id % 9 = 0 THEN 7 WHEN doc_id % 2 = 0 THEN 2 * n + 1 ELSE n END AS n FROM d WHERE doc_id % 3 <> 0 OR doc_id % 9 = 0
)
SELECT source, lang, 'words' AS version, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens FROM now GROUP BY source, lang
"""

# words without blanks, as they stand; a window is found twice if its words are
QUALITY_BASE = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, ws[i : i + 4] AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 4)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM win) WHERE n > 1
), again AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM twice) GROUP BY doc_id
), line AS (
  SELECT doc_id, sum(n - 1) AS n
  FROM (SELECT doc_id, l, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l)
  GROUP BY doc_id
), f AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(line.n, 0)::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN line USING (doc_id) LEFT JOIN again USING (doc_id)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f
"""

OP12 = r"""
WITH piece AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), size AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM piece GROUP BY lang
), starts AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM piece
), f AS (
  SELECT lang, g AS words, array_to_string(g, ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, ws[i : i + m - 1] AS g FROM starts, (VALUES (1), (2), (3), (4), (5)) AS s(m) WHERE i + m - 1 <= len(ws)) GROUP BY lang, g HAVING count(*) >= 100
), held AS (
  SELECT lang, words[a : a + m - 1] AS words, max(f) AS o
  FROM (SELECT lang, words, f, m, unnest(range(1, len(words) - m + 2)) AS a FROM f, (VALUES (2), (3), (4)) AS s(m) WHERE len(words) > m) GROUP BY ALL
), kept AS (
  SELECT f.* FROM f LEFT JOIN held USING (lang, words) WHERE len(f.words) > 1 AND (o IS NULL OR 100 * o < 100 * f)
), cut AS (
  SELECT c.lang, c.phrase, c.f AS a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * c.f * n // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(words))) AS k FROM kept) c
  JOIN f x ON x.lang = c.lang AND x.words = c.words[1 : k] JOIN f y ON y.lang = c.lang AND y.words = c.words[k + 1 :] JOIN size ON size.lang = c.lang
), best AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""


def _op13() -> str:
    """Rows are taken one by one; for each state the cheapest way so far stands as a struct of cost, letters and repaired text.

    Ways of equal cost to the same place never continue one another, so that the least letters stay least when more follow.
    """
    longer = lambda v, cost, letter, said: f"CASE WHEN {v} IS NOT NULL THEN {{'c': {v}.c + {cost}, 'l': {v}.l || '{letter}', 't': {v}.t || {said}}} END"
    least = lambda *of: f"list_min(list_filter([{', '.join(of)}], lambda x: x IS NOT NULL))"
    put = lambda v, role: longer(v, 2, "I", f"'{role}:' || chr(10)")
    user = least("s2", put("s0", "user"), put("s1", "user"), put("s3", "user"))
    settled = lambda rows: f"SELECT conv_id, i, s0, s1, u2 AS s2, {least('s3', put('u2', 'assistant'))} AS s3 FROM (SELECT *, {user} AS u2 FROM ({rows}))"
    row = "CASE WHEN gone THEN NULL ELSE {} END"
    own = "role || ':' || text || chr(10)"
    keep = lambda v, initial: row.format(f"CASE WHEN left(role, 1) = '{initial}' THEN {longer(v, 'cut', 'K', own)} END")
    rerole = lambda v, role: row.format(longer(v, "2 + cut", "R", f"'{role}:' || text || chr(10)"))
    drop = lambda v: longer(v, 3, "D", "''")
    users = [f(v, r) for v in ("s0", "s1", "s3") for f, r in ((keep, "u"), (rerole, "user"))]
    step = f"""SELECT s.conv_id, s.i + 1 AS i, {drop('s0')} AS s0, {least(drop('s1'), keep('s0', 's'))} AS s1, {least(drop('s2'), *users)} AS s2,
      {least(drop('s3'), keep('s2', 'a'), rerole('s2', 'assistant'))} AS s3 FROM s JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i"""
    nothing = "NULL::STRUCT(c BIGINT, l VARCHAR, t VARCHAR)"
    start = f"SELECT conv_id, 1::BIGINT AS i, {{'c': 0::BIGINT, 'l': '', 't': ''}} AS s0, {nothing} AS s1, {nothing} AS s2, {nothing} AS s3 FROM (SELECT DISTINCT conv_id FROM conversations)"
    # crc32 of an ASCII text: each character goes in, then eight shifts
    fed = "flatten(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {fed}), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT)"
    return rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS hit FROM conversations
), d AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN hit = 3 THEN 2 ELSE 1 END)) AS copy
  FROM c WHERE hit <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM d
), f AS (
  SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[.!?][ 	-
]*$') AS open, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM o
), r AS (
  SELECT conv_id, i, role, text, blank OR again AS gone, (open AND NOT (blank OR again))::BIGINT AS cut FROM f
), n AS (
  SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank)::BIGINT AS blank,
    count(*) FILTER (again AND NOT blank)::BIGINT AS duplicate, count(*) FILTER (open AND NOT again AND NOT blank)::BIGINT AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal
  FROM f GROUP BY conv_id
), s AS (
  {settled(settled(start))} UNION ALL {settled(settled(step))}
), e AS (
  SELECT s.conv_id, {least('s0', 's3')} AS v FROM s LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM s.conv_id WHERE s.i = coalesce(n.rows, 0) + 1
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  v.c AS cost, v.l AS audit, sha256(left(v.t, greatest(length(v.t) - 1, 0))) AS repaired_sha256
FROM e LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_minhash_dedup": OP6, "op7_kdtree_topk": OP7, "op8_url_filter": OP8, "op9_decontamination": OP9, "op10_chat_format": OP10, "license_base": LICENSE_BASE, "secret_base": SECRET_BASE, "token_rollup_words": TOKEN_ROLLUP_WORDS, "quality_base": QUALITY_BASE, "op12_collocations": OP12, "op13_chat_repair": _op13()}
