"""SQL building blocks for the DuckDB check: the projection of `driver_tables` written a second time, in SQL."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from capsule import fixed
from capsule.sources import driver_tables as dt


def q(v) -> str:
    """A SQL literal."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def items(values: Iterable) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def in_list(values: Iterable) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def case(column: str, table: Mapping, default: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + f" ELSE {default} END"


def rules(column: str, table, default: str = "NULL") -> str:
    return ("CASE " + " ".join(f"WHEN regexp_matches({column}, {q('(?i)' + p)}) THEN {q(v)}" for p, v in table)
            + f" ELSE {default} END")


def values(name: str, columns: str, rows: Iterable[tuple]) -> str:
    body = ", ".join("(" + ", ".join(q(x) for x in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def rnd(x: str, d: int) -> str:
    """Decimal rounding on the exact binary value (printf), negative zero folded away."""
    return f"(CAST(printf('%.{d}f', {x}) AS DOUBLE) + 0.0)"


_TYPES = "[" + ", ".join(items(dt.TYPES[c]) for c in dt.CATEGORY) + "]"
_CENTS = "CAST(CAST(round(p_retailprice - 880, 2) AS DECIMAL(10,2)) AS VARCHAR)"
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"

PARTS = f"""
parts0 AS (
  SELECT p_partkey AS part, p_partkey // 5 % 8 AS kind, p_size % 12 AS ci, p_partkey // 11 % 5 AS pi, *
  FROM part),
parts AS (
  SELECT part, {items(dt.CATEGORY)}[part % 5 + 1] AS category,
    {_TYPES}[part % 5 + 1][kind + 1] AS subcategory, {items(dt.COLOR)}[ci + 1] AS primary_color,
    {items(dt.PATTERN)}[pi + 1] AS pattern, {items(dt.MATERIAL)}[part // 3 % 14 + 1] AS material,
    {items(dt.FABRIC)}[part // 13 % 5 + 1] AS fabric_guess, {items(dt.GENDER)}[part % 3 + 1] AS gender,
    CASE WHEN part % 4 <> 0 THEN p_brand END AS brand,
    CASE WHEN part % 7 = 1 THEN '' WHEN part % 7 = 2 THEN '0' WHEN part % 7 = 3 THEN 'n/a'
         WHEN part % 7 > 3 THEN {_CENTS} END AS price,
    {items(dt.PRICE_SOURCE)}[part // 7 % 4 + 1] AS price_source,
    CASE WHEN part % 10 = 0 THEN CAST(p_size AS VARCHAR) || '.50' END AS purchase_price,
    CASE WHEN part % 6 = 1 THEN 1.5 WHEN part % 6 = 2 THEN 9000.0 WHEN part % 6 = 3 THEN -4.0
         WHEN part % 6 > 3 THEN p_size + 20.5 END::DOUBLE AS estimated_price_usd,
    {items(dt.CONFIDENCE)}[part // 2 % 5 + 1] AS price_confidence,
    {items(dt.ESTIMATE_SOURCE)}[part // 6 % 3 + 1] AS price_estimate_source,
    1 + p_size % 5 AS formality,
    [{items(dt.STYLE)}[part % 6 + 1], {items(dt.STYLE)}[part // 6 % 6 + 1]] AS style_tags,
    {items(dt.COLOR)}[ci + 1] || ' ' || {_TYPES}[part % 5 + 1][kind + 1] AS label,
    p_name || ' ' || {items(dt.PATTERN)}[pi + 1] || ' ' || {_TYPES}[part % 5 + 1][kind + 1] AS description,
    p_name AS part_name, part AS image_key, (ci * 5 + pi) * 40 + kind * 5 + part % 5 AS text_key,
    part * 7 + 3 AS style_key
  FROM parts0)"""

CLOSET = PARTS + """,
closet AS (
  SELECT o.o_custkey AS user_id, 'i' || o.o_custkey || '_' || l.l_partkey AS item_id,
    min(o.o_orderdate) AS created_at, count(*) AS times_bought, 'closet' AS status, any_value(p) AS p, part
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN parts p ON p.part = l.l_partkey
  GROUP BY o.o_custkey, l.l_partkey, part),
closet_items AS MATERIALIZED (
  SELECT user_id, item_id, created_at, times_bought, status, parts.* FROM closet JOIN parts USING (part))"""

CANDIDATES = """,
candidate_items AS MATERIALIZED (
  SELECT u.user_id, 'c' || u.user_id || '_' || parts.part AS item_id, TIMESTAMP '2002-01-01' AS created_at,
    'candidate' AS status, parts.*
  FROM (SELECT DISTINCT o_custkey AS user_id FROM orders) u
  CROSS JOIN (SELECT unnest(range(5)) AS slot) s
  CROSS JOIN (SELECT max(p_partkey) + 1 AS n FROM part) c
  JOIN parts ON parts.part = 5 * ((u.user_id * 31 + s.slot * 17) % (c.n // 5)) + s.slot)"""

VECTORS = """,
vecs AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
vec_count AS (SELECT count(*) AS n FROM embeddings)"""

REAL_PRICE = f"""
  CASE WHEN regexp_matches(price, {q(NUMBER)}) AND TRY_CAST(price AS DOUBLE) > 0 THEN TRY_CAST(price AS DOUBLE)
       WHEN price_source = 'user' AND regexp_matches(price, {q(NUMBER)}) AND TRY_CAST(price AS DOUBLE) = 0 THEN 0.0
       ELSE NULL END"""


def with_(*parts: str) -> str:
    """WITH clause out of building blocks (each a comma-separated list of CTEs)."""
    return "WITH " + ",\n".join(p.strip().strip(",") for p in parts if p.strip()) + "\n"


OPTIONS = fixed.DEFAULT_SETTINGS
