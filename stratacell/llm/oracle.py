"""SQL of the queries that SQL can express."""

from __future__ import annotations

from .secrets import ADDED, KINDS, LIVE_OWNERS, LIVE_REPOSITORIES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NON_SPACE = r"[^\x20\x09-\x0D]+"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
places AS (SELECT item_id, j, least(13, len(w)) AS n, array_to_string(list_slice(w, j, j + 12), ' ') AS k
        FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS j FROM b WHERE len(w) > 0)),
win AS (SELECT DISTINCT item_id, n, k FROM places),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS k
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes)),
hit AS (SELECT doc_id, item_id, p, pos.n FROM pos JOIN win ON pos.k = win.k AND pos.n = win.n),
words AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS i FROM hit) GROUP BY 1),
met AS (SELECT doc_id, CAST(item_id AS VARCHAR) AS item, p, pos.n, p - j AS diagonal FROM pos JOIN places ON pos.k = places.k AND pos.n = places.n),
runs AS (SELECT doc_id, item, min(p) AS start, count(*) + max(n) - 1 AS size
         FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item, diagonal ORDER BY p) AS run FROM met) GROUP BY doc_id, item, diagonal, run),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, start, item) AS nth FROM runs) WHERE nth = 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(size, 0) AS longest_match, item AS longest_item, start - 1 AS longest_start
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN best USING (doc_id)"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_NON_SPACE}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, j, j + 4), ' ') AS k
      FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS j FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 80 * (p.n + q.n - o)),
r(node, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.node, links.b FROM r JOIN links ON r.other = links.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(other) AS component_id FROM r GROUP BY 1) c USING (doc_id)"""


def _kind(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    size = lambda x: f"coalesce(list_sum(list_transform({x}, lambda x: length(x))), 0)"
    return f"""SELECT doc_id, source, CAST({size("g[1:i]")} + {size("m[1:i-1]")} AS BIGINT) AS s, {rank} AS rank, '{kind}' AS kind, length(m[i]) AS n, v[i] AS value
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, source, string_split_regex(t, {p}) AS g, regexp_extract_all(t, {p}, 0) AS m, regexp_extract_all(t, {p}, {group}) AS v FROM d)) WHERE length(v[i]) >= {least}"""


_JOINED = "coalesce(string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) FILTER ({}), '')"

SECRETS = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
base AS ({" UNION ALL ".join(_kind(i, *k) for i, k in enumerate(KINDS))}),
more AS (SELECT k.* FROM ({" UNION ALL ".join(_kind(len(KINDS) + i, *k) for i, k in enumerate(ADDED[:-1]))}) k
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = k.doc_id AND b.s < k.s + k.n AND k.s < b.s + b.n)),
known AS (SELECT * FROM base UNION ALL SELECT * FROM more),
runs AS (SELECT k.* FROM ({_kind(len(KINDS) + len(ADDED) - 1, *ADDED[-1])}) k WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= 10
  AND NOT EXISTS (SELECT 1 FROM known b WHERE b.doc_id = k.doc_id AND b.s < k.s + k.n AND k.s < b.s + b.n)),
spans AS (SELECT * FROM known UNION ALL SELECT * FROM runs),
judged AS (SELECT value, count(DISTINCT source) <= {LIVE_OWNERS} AND count(DISTINCT (doc_id, source)) <= {LIVE_REPOSITORIES} AS live FROM spans GROUP BY 1)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256({_JOINED.format(f"rank < {len(KINDS)}")}) AS base_sha256, {_JOINED.format(f"rank < {len(KINDS)} OR live")} AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
FROM d LEFT JOIN spans USING (doc_id) LEFT JOIN judged USING (value) GROUP BY 1"""
