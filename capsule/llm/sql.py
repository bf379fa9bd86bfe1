"""SQL of the queries that SQL can express, for the check against another engine."""

from __future__ import annotations

from capsule.llm.secrets import BASE, RULES

_WORDS = r"'[\x20\x09-\x0D]+'"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# base32 of a digest: each five hexadecimal digits are twenty bits, hence four letters
_BASE32 = """array_to_string(list_transform(range(8), lambda b: array_to_string(list_transform([15, 10, 5, 0], lambda s:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 5 * b, 5) AS BIGINT) >> s) & 31 AS BIGINT), 1)), '')), '')"""

ARCHIVES = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(t) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to, 'ok' AS status FROM f"""

_KINDS = ", ".join(f"({_quoted(r.kind)}, {i}, {_quoted(r.plain)}, {r.group}, {r.least})" for i, r in enumerate(RULES))
SECRETS = f"""
WITH rules(kind, ord, pattern, grp, least) AS (VALUES {_KINDS}),
found AS (SELECT doc_id, kind, ord, least, regexp_extract_all(t, pattern) AS m,
    CASE grp WHEN 2 THEN regexp_extract_all(t, pattern, 2) ELSE regexp_extract_all(t, pattern) END AS g,
    string_split_regex(t, pattern) AS p
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), rules WHERE regexp_matches(t, pattern)),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found),
spans AS (SELECT doc_id, kind, ord,
    CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start,
    length(m[i]) AS size FROM each WHERE length(g[i]) >= least),
text_of AS (SELECT doc_id, ord, start, kind || ':' || start || ':' || (start + size) AS s FROM spans),
summed AS (SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
    string_agg(s, ',' ORDER BY start, ord) FILTER (ord < {len(BASE)}) AS base, string_agg(s, ',' ORDER BY start, ord) AS spans
  FROM text_of GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN summed USING (doc_id)"""



def _classes(n: int, percent: int, out: str) -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORDS}), lambda x: x <> '') AS w
  FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + {n - 1}], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - {n - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
reached AS (SELECT DISTINCT a AS id, a AS other FROM links UNION SELECT r.id, l.b FROM reached r JOIN links l ON l.a = r.other),
first_of AS (SELECT id, min(other) AS lowest FROM reached GROUP BY id), many AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(lowest, d.doc_id) AS component_id, {out}
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN first_of ON id = d.doc_id LEFT JOIN many ON a = d.doc_id"""


CLASSES = _classes(3, 90, "coalesce(n_links, 0) AS n_links")
NEAR = _classes(2, 80, "coalesce(lowest, d.doc_id) = d.doc_id AS kept")


def _terms(name: str, key: str) -> str:
    return f"""SELECT {key}, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM {name}"""


RANKED = f"""
WITH wanted AS (SELECT item_id, term, count(*) AS q FROM ({_terms("benchmark", "item_id")}) GROUP BY ALL),
t AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM ({_terms("documents", "doc_id")}) GROUP BY ALL),
long AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM long),
m AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM long, total),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, total GROUP BY term, docs),
scored AS (SELECT item_id, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM wanted JOIN w USING (term) JOIN t USING (term) JOIN m USING (doc_id) GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20"""
