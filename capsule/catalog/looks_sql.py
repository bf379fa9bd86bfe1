"""SQL of the outfit search and the verdict, written as plain joins for the check."""

from capsule import fixed
from capsule.catalog import oracle as o
from capsule.catalog.registry import CENTER

MASK = "CASE gender WHEN 'mens' THEN 1 WHEN 'womens' THEN 2 ELSE 3 END"


def dot(a: str, b: str) -> str:
    """Cosine of two joined vectors, 0 when one is missing."""
    return f"coalesce(round(list_inner_product({a}.v, {b}.v), 12), 0.0)"


# ---- settings: user_id, thr (strictness), loose (gender does not matter), layer (shoes complete a look), most (pairs)
DEFAULTS = """,
sets AS (SELECT DISTINCT o_custkey AS user_id, 0.5::DOUBLE AS thr, FALSE AS loose, TRUE AS layer, 40 AS most FROM orders)"""
VARIED = """,
sets AS (SELECT DISTINCT o_custkey AS user_id, CAST([0.4, 0.5, 0.55, 0.6] AS DOUBLE[])[o_custkey % 4 + 1] AS thr,
  o_custkey % 5 = 0 AS loose, o_custkey % 3 <> 0 AS layer, [3, 40, 100][o_custkey % 7 % 3 + 1] AS most FROM orders)"""
# every owned item is judged; each has a closet of its own, its owner's without it
OWNED = o.CLOSET.replace("closet_items", "all_items") + """,
candidate_items AS MATERIALIZED (SELECT * REPLACE (item_id AS user_id) FROM all_items),
closet_items AS MATERIALIZED (
  SELECT a.* REPLACE (c.item_id AS user_id) FROM candidate_items c JOIN all_items b ON b.item_id = c.item_id
  JOIN all_items a ON a.user_id = b.user_id AND a.item_id <> c.item_id)"""
OWNED_DEFAULTS = """,
sets AS (SELECT item_id AS user_id, 0.5::DOUBLE AS thr, FALSE AS loose, TRUE AS layer, 40 AS most FROM candidate_items)"""


def _score(total: str, n: str) -> str:
    return f"(1.0 / (1.0 + exp(-(({total}) / ({n} * ({n} - 1) / 2.0) - {CENTER}) / {fixed.SCORE_TAU})))"


def base(items: str = o.CLOSET + o.CANDIDATES, settings: str = DEFAULTS) -> str:
    return items + settings + o.VECTORS + _BASE


_BASE = f""",
ci AS MATERIALIZED (SELECT user_id, item_id, category, created_at, {MASK} AS mask, style_key % n AS k FROM closet_items, vec_count),
ca0 AS MATERIALIZED (SELECT user_id, item_id, category, {MASK} AS mask, style_key % n AS k, thr, loose, layer, most
  FROM candidate_items JOIN sets USING (user_id), vec_count),
ca AS MATERIALIZED (SELECT c.*, c.layer AND c.category <> 'shoes' AND EXISTS (SELECT 1 FROM ci s WHERE s.user_id = c.user_id
         AND s.category = 'shoes' AND (c.loose OR (s.mask & c.mask) <> 0)) AS us FROM ca0 c)"""


def completed(name: str, source: str) -> str:
    """Bases of `source` (item_id, us, m1, m2, m3 masks, k1..k3, tot, n, ids) with their best shoes, passing ones."""
    return f""",
{name}_rows AS MATERIALIZED (
  SELECT b.*, sh.item_id AS shoe, sh.created_at AS shoe_at, sh.k AS ks
  FROM {source} b JOIN ci sh ON sh.user_id = b.user_id
  WHERE b.us AND sh.category = 'shoes' AND (b.loose OR ((sh.mask & b.m1) <> 0 AND (sh.mask & b.m2) <> 0
    AND (sh.mask & b.m3) <> 0 AND (sh.mask & b.cm) <> 0))),
{name}_all AS MATERIALIZED (
  SELECT b.*, round(b.tot + {dot('x1', 'xs')} + {dot('x2', 'xs')} + {dot('x3', 'xs')}, 12) AS full_tot
  FROM {name}_rows b LEFT JOIN vecs xs ON xs.vec_id = b.ks LEFT JOIN vecs x1 ON x1.vec_id = b.k1
  LEFT JOIN vecs x2 ON x2.vec_id = b.k2 LEFT JOIN vecs x3 ON x3.vec_id = b.k3),
{name} AS MATERIALIZED (
  SELECT * FROM (
    SELECT item_id, user_id, thr, loose, most, tord, ids, m1, m2, m3, cm, k1, k2, k3, tot, n, us, ord_key, shoe, n + 1 AS full_n,
      {_score('full_tot', '(n + 1)')} AS score FROM {name}_all
    QUALIFY row_number() OVER (PARTITION BY item_id, ids ORDER BY full_tot DESC, shoe_at, shoe) = 1
    UNION ALL
    SELECT item_id, user_id, thr, loose, most, tord, ids, m1, m2, m3, cm, k1, k2, k3, tot, n, us, ord_key, NULL, n,
      {_score('round(tot, 12)', 'n')} FROM {source} WHERE NOT us AND n > 1)
  WHERE score >= thr)"""


_PAIR = "struct_pack(ta := t.created_at, ti := t.item_id, ba := b.created_at, bi := b.item_id)"
_LOOKS = f""",
first_bases AS MATERIALIZED (
  SELECT c.item_id, c.user_id, c.thr, c.loose, c.most, c.category, c.us, 0 AS tord, [c.item_id, p.item_id] AS ids, c.mask AS cm, c.mask AS m1,
    p.mask AS m2, 3 AS m3, c.k AS k1, p.k AS k2, NULL::BIGINT AS k3, {dot('s', 'z')} AS tot, 2 AS n, NULL AS ord_key
  FROM ca c JOIN ci p ON p.user_id = c.user_id AND (c.loose OR (p.mask & c.mask) <> 0)
    AND p.category = CASE c.category WHEN 'top' THEN 'bottom' WHEN 'bottom' THEN 'top' END
  JOIN vecs s ON s.vec_id = c.k JOIN vecs z ON z.vec_id = p.k
  UNION ALL
  SELECT c.item_id, c.user_id, c.thr, c.loose, c.most, c.category, c.us, 0, [c.item_id], c.mask, c.mask, 3, 3, c.k, NULL, NULL, 0.0, 1, NULL
  FROM ca c WHERE c.category = 'dress'
  UNION ALL
  SELECT c.item_id, c.user_id, c.thr, c.loose, c.most, c.category, c.us, 1,
    CASE c.category WHEN 'dress' THEN [c.item_id, p.item_id] ELSE [p.item_id, c.item_id] END, c.mask, c.mask, p.mask, 3,
    c.k, p.k, NULL, {dot('s', 'z')}, 2, NULL
  FROM ca c JOIN ci p ON p.user_id = c.user_id AND (c.loose OR (p.mask & c.mask) <> 0)
    AND p.category = CASE c.category WHEN 'dress' THEN 'outerwear' WHEN 'outerwear' THEN 'dress' END
  JOIN vecs s ON s.vec_id = c.k JOIN vecs z ON z.vec_id = p.k),
pair_bases AS MATERIALIZED (
  SELECT c.item_id, c.user_id, c.thr, c.loose, c.most, c.category, c.us, -1 AS tord, [t.item_id, b.item_id] AS ids, c.mask AS cm,
    t.mask AS m1, b.mask AS m2, 3 AS m3, t.k AS k1, b.k AS k2, NULL::BIGINT AS k3, {dot('s', 'z')} AS tot, 2 AS n, {_PAIR} AS ord_key
  FROM ca c JOIN ci t ON t.user_id = c.user_id AND t.category = 'top' AND (c.loose OR (t.mask & c.mask) <> 0)
  JOIN ci b ON b.user_id = c.user_id AND b.category = 'bottom' AND (c.loose OR ((b.mask & c.mask) <> 0 AND (b.mask & t.mask) <> 0))
  JOIN vecs s ON s.vec_id = t.k JOIN vecs z ON z.vec_id = b.k WHERE c.category = 'outerwear')""" \
    + completed("first_looks", "first_bases") + completed("pair_looks", "pair_bases") + f""",
best_pairs AS MATERIALIZED (
  SELECT * FROM pair_looks QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, ord_key) <= most),
second_rows AS MATERIALIZED (
  SELECT l.item_id, l.user_id, l.thr, l.loose, l.most, l.us, 1 AS tord, list_append(l.ids, w.item_id) AS ids, l.cm, l.m1, l.m2,
    w.mask AS m3, l.k1, l.k2, w.k AS k3, l.tot AS tot2
  FROM first_looks l JOIN ca c ON c.item_id = l.item_id AND c.category IN ('top', 'bottom')
  JOIN ci w ON w.user_id = l.user_id AND w.category = 'outerwear' AND (l.loose OR (w.mask & l.cm) <> 0)
  UNION ALL
  SELECT l.item_id, l.user_id, l.thr, l.loose, l.most, l.us, 0, list_append(l.ids, c.item_id), l.cm, l.m1, l.m2, c.mask, l.k1, l.k2, c.k, l.tot
  FROM best_pairs l JOIN ca c ON c.item_id = l.item_id),
second_bases AS MATERIALIZED (
  SELECT r.* EXCLUDE (tot2), r.tot2 + {dot('x1', 'x3')} + {dot('x2', 'x3')} AS tot, 3 AS n, NULL AS ord_key
  FROM second_rows r JOIN vecs x1 ON x1.vec_id = r.k1 JOIN vecs x2 ON x2.vec_id = r.k2
  JOIN vecs x3 ON x3.vec_id = r.k3)""" \
    + completed("second_looks", "second_bases") + f""",
shoe_rows AS MATERIALIZED (
  SELECT c.item_id, c.user_id, c.thr, c.loose, 0 AS tord, [t.item_id, b.item_id] AS ids, c.mask AS cm, t.mask AS m1, b.mask AS m2,
    t.k AS k1, b.k AS k2, c.k AS kc, 2 AS n
  FROM ca c JOIN ci t ON t.user_id = c.user_id AND t.category = 'top' AND (c.loose OR (t.mask & c.mask) <> 0)
  JOIN ci b ON b.user_id = c.user_id AND b.category = 'bottom' AND (c.loose OR ((b.mask & c.mask) <> 0 AND (b.mask & t.mask) <> 0))
  WHERE c.category = 'shoes'
  UNION ALL
  SELECT c.item_id, c.user_id, c.thr, c.loose, 1, [d.item_id], c.mask, d.mask, 3, d.k, NULL, c.k, 1
  FROM ca c JOIN ci d ON d.user_id = c.user_id AND d.category = 'dress' AND (c.loose OR (d.mask & c.mask) <> 0)
  WHERE c.category = 'shoes'),
shoe_bases AS MATERIALIZED (
  SELECT r.*, {dot('x1', 'x2')} AS tot, round({dot('x1', 'x2')} + {dot('x1', 'xc')} + {dot('x2', 'xc')}, 12) AS new_tot
  FROM shoe_rows r JOIN vecs x1 ON x1.vec_id = r.k1 LEFT JOIN vecs x2 ON x2.vec_id = r.k2
  JOIN vecs xc ON xc.vec_id = r.kc),
shoe_owned AS MATERIALIZED (
  SELECT b.item_id, b.ids, max(round(b.tot + {dot('x1', 'xs')} + {dot('x2', 'xs')}, 12)) AS owned
  FROM shoe_bases b JOIN ci sh ON sh.user_id = b.user_id AND sh.category = 'shoes' AND (b.loose OR ((sh.mask & b.m1) <> 0
    AND (sh.mask & b.m2) <> 0 AND (sh.mask & b.cm) <> 0))
  JOIN vecs xs ON xs.vec_id = sh.k JOIN vecs x1 ON x1.vec_id = b.k1 LEFT JOIN vecs x2 ON x2.vec_id = b.k2
  GROUP BY b.item_id, b.ids),
shoe_looks AS MATERIALIZED (
  SELECT b.item_id, b.user_id, b.tord, list_append(b.ids, b.item_id) AS ids, b.n + 1 AS full_n,
    {_score('new_tot', '(b.n + 1)')} AS score
  FROM shoe_bases b LEFT JOIN shoe_owned w ON w.item_id = b.item_id AND w.ids = b.ids
  WHERE {_score('new_tot', '(b.n + 1)')} >= thr AND new_tot > coalesce(w.owned, -1e9)),
sim_rows AS MATERIALIZED (
  SELECT c.item_id, c.user_id, i.item_id AS other, i.created_at, c.image_key % n AS ka, i.image_key % n AS kb,
    c.text_key % n AS ta, i.text_key % n AS tb
  FROM candidate_items c JOIN closet_items i ON i.user_id = c.user_id AND i.category = c.category, vec_count
  WHERE i.item_id <> c.item_id),
sim_all AS MATERIALIZED (
  SELECT r.*, {dot('a', 'b')} AS isim, {dot('x', 'y')} AS tsim, round(0.7 * {dot('a', 'b')} + 0.3 * {dot('x', 'y')}, 12) AS sim
  FROM sim_rows r LEFT JOIN vecs a ON a.vec_id = ka LEFT JOIN vecs b ON b.vec_id = kb
  LEFT JOIN vecs x ON x.vec_id = ta LEFT JOIN vecs y ON y.vec_id = tb),
sim_top AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, isim DESC, created_at, other) AS rn FROM sim_all),
levels AS MATERIALIZED (
  SELECT c.item_id, t.other, coalesce(t.sim, 0) AS sim, CASE WHEN coalesce(t.sim, 0) >= 0.88 THEN 'near_duplicate'
    WHEN coalesce(t.sim, 0) >= 0.8 THEN 'similar' ELSE 'none' END AS level
  FROM candidate_items c LEFT JOIN sim_top t ON t.item_id = c.item_id AND t.rn = 1),
shoe_suffix AS (SELECT item_id, CASE WHEN us THEN '+shoes' ELSE '' END AS sfx FROM ca),
all_looks AS (
  SELECT item_id, user_id, tord, CASE WHEN shoe IS NULL THEN ids ELSE list_append(ids, shoe) END AS ids,
    full_n, score FROM first_looks
  UNION ALL SELECT item_id, user_id, tord, CASE WHEN shoe IS NULL THEN ids ELSE list_append(ids, shoe) END, full_n, score
    FROM second_looks
  UNION ALL SELECT item_id, user_id, tord, ids, full_n, score FROM shoe_looks
  UNION ALL SELECT c.item_id, c.user_id, 0, [c.item_id], 1, 0.5 FROM ca c JOIN levels v USING (item_id)
    WHERE c.category = 'dress' AND NOT c.us AND v.level <> 'near_duplicate'),
looks AS MATERIALIZED (
  SELECT l.item_id, l.user_id, l.tord, l.full_n, l.score, array_to_string(list_sort(l.ids), '|') AS outfit_key,
    CASE WHEN c.category IN ('top', 'bottom') THEN ['top+bottom' || sfx, 'top+bottom+outerwear' || sfx][tord + 1]
         WHEN c.category = 'outerwear' THEN ['top+bottom+outerwear' || sfx, 'dress+outerwear' || sfx][tord + 1]
         WHEN c.category = 'dress' THEN ['dress' || sfx, 'dress+outerwear' || sfx][tord + 1]
         ELSE ['top+bottom+shoes', 'dress+shoes'][tord + 1] END AS template
  FROM all_looks l JOIN ca c USING (item_id) JOIN shoe_suffix USING (item_id))"""



def looks(items: str = o.CLOSET + o.CANDIDATES, settings: str = DEFAULTS) -> str:
    return base(items, settings) + _LOOKS


BASE, LOOKS = base(), looks()
