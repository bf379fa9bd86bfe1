"""Similarity, outfit and verdict queries."""

from pyspark.sql import functions as F

from capsule import fixed
from capsule.catalog import oracle as o
from capsule.catalog.looks_sql import BASE, LOOKS, MASK, OWNED, OWNED_DEFAULTS, VARIED
from capsule.catalog.looks_sql import looks as looks_sql
from capsule.catalog.registry import CENTER, joined, query
from capsule.functions.numbers import exact_round
from capsule.operators import looks, similarity

col = F.col


@query("candidate_outfits", "CMB-1", "CMB-2", "CMB-3", "CMB-4", "CMB-5", "CMB-6", "CMB-9", "CMB-11", "JN-2", "JN-3",
       "JN-4", "JN-5", "AGG-1", "TOP-1", "VEC-8", "FLT-2",
       sql=o.with_(LOOKS) + f"SELECT item_id, template, outfit_key, full_n AS n_items, {o.rnd('score', 6)} AS score FROM looks")
def _(t):
    e = t.evaluation()
    return e.outfits.select("item_id", "template", looks.set_key(col("members")).alias("outfit_key"), "n_items",
                            exact_round(col("score"), 6).alias("score"))


@query("redundancy_matches", "JN-1", "VEC-3", "VEC-5", "VEC-2",
       sql=o.with_(LOOKS) + f"""SELECT item_id, other AS match_id, rn AS rank, {o.rnd('sim', 4)} AS similarity,
         {o.rnd('isim', 4)} AS image_similarity, {o.rnd('tsim', 4)} AS text_similarity
         FROM sim_top WHERE rn <= 3 AND sim >= {fixed.MATCH_FLOOR}""")
def _(t):
    m = t.evaluation().similar.select("item_id", F.explode(F.filter("matches", lambda x: x.isNotNull())).alias("m"))
    return m.select("item_id", col("m.item_id").alias("match_id"), col("m.rank").cast("bigint").alias("rank"),
                    *[exact_round(col(f"m.{c}"), 4).alias(c) for c in
                      ("similarity", "image_similarity", "text_similarity")])


@query("duplicate_levels", "VEC-4",
       sql=o.with_(LOOKS) + f"SELECT item_id, level, {o.rnd('sim', 4)} AS top_similarity FROM levels")
def _(t):
    return t.evaluation().similar.select("item_id", col("redundancy_level").alias("level"), "top_similarity")


@query("cosine_search", "VEC-2", "VEC-1",
       sql=o.with_(o.CLOSET, o.CANDIDATES, o.VECTORS) + f"""
       , rows AS MATERIALIZED (SELECT c.item_id AS cand_id, i.item_id, i.created_at, c.image_key % n AS ka, i.image_key % n AS kb
         FROM candidate_items c JOIN closet_items i ON i.user_id = c.user_id, vec_count),
       sims AS MATERIALIZED (SELECT cand_id, item_id, created_at, round(list_inner_product(a.v, b.v), 12) AS s
         FROM rows LEFT JOIN vecs a ON a.vec_id = ka LEFT JOIN vecs b ON b.vec_id = kb)
       SELECT cand_id, item_id, rank, {o.rnd('s', 6)} AS similarity FROM (SELECT *, row_number() OVER (
         PARTITION BY cand_id ORDER BY s DESC, created_at, item_id) AS rank FROM sims) WHERE rank <= 10""")
def _(t):
    vec = {"image": "image_key"}
    hits = similarity.nearest(t.refs(t.candidates(), **vec), t.refs(t.closet(), **vec), 10, by=["user_id"], vectors=t.referable())
    return hits.select("cand_id", "item_id", col("rank").cast("bigint").alias("rank"),
                       exact_round(col("similarity"), 6).alias("similarity"))


@query("outfit_bounds", "CMB-2", "CMB-10",
       sql=o.with_(BASE) + f"""
       , n AS (SELECT c.item_id, c.category,
           count(*) FILTER (i.category = 'top') AS t, count(*) FILTER (i.category = 'bottom') AS b,
           count(*) FILTER (i.category = 'outerwear') AS w, count(*) FILTER (i.category = 'dress') AS d,
           count(*) FILTER (i.category = 'shoes') AS s
         FROM ca c LEFT JOIN ci i ON i.user_id = c.user_id AND (i.mask & c.mask) <> 0 GROUP BY ALL),
       p AS (SELECT c.item_id, count(*) AS pairs FROM ca c
         JOIN ci t ON t.user_id = c.user_id AND t.category = 'top' AND (t.mask & c.mask) <> 0
         JOIN ci b ON b.user_id = c.user_id AND b.category = 'bottom' AND (b.mask & c.mask) <> 0
           AND (b.mask & t.mask) <> 0 GROUP BY c.item_id)
       SELECT n.item_id, s AS shoes_pool, CASE category WHEN 'top' THEN b * (1 + w) WHEN 'bottom' THEN t * (1 + w)
         WHEN 'outerwear' THEN least(coalesce(pairs, 0), 40) + d WHEN 'dress' THEN 1 + w
         ELSE coalesce(pairs, 0) + d END AS max_possible FROM n LEFT JOIN p USING (item_id)""")
def _(t):
    from capsule.operators.attributes import default_settings
    c = t.candidates()
    c = c.join(default_settings(c.select("user_id").distinct()), "user_id")
    p = looks.with_pools(c, looks.pool_counts(t.closet()))
    return p.select("item_id", col("pool_shoes").alias("shoes_pool"),
                    looks.most_outfits(col("category"), col("max_pairs_for_layering")).alias("max_possible"))




def prices(name: str, src: str) -> str:
    """CTE <name>: items of `src` with known price, estimate and effective price."""
    num = f"regexp_matches({{0}}, {o.q(o.NUMBER)})"
    conf = "lower(trim(coalesce(price_confidence, '')))"
    return f""",
{name}_r AS (SELECT *, {o.REAL_PRICE} AS listed,
    CASE WHEN {num.format('purchase_price')} AND TRY_CAST(purchase_price AS DOUBLE) > 0
      THEN TRY_CAST(purchase_price AS DOUBLE) END AS paid,
    CASE WHEN estimated_price_usd > 0 THEN round_even(greatest(least(estimated_price_usd, 5000), 3), 0)::DOUBLE END AS est0,
    coalesce({o.rules("nullif(subcategory, '')", fixed.PRICE_RULES)}, {o.rules("nullif(label, '')", fixed.PRICE_RULES)},
             {o.rules("nullif(description, '')", fixed.PRICE_RULES)},
             {o.case("lower(category)", fixed.PRICE_CATEGORY_DEFAULTS, str(fixed.PRICE_OTHER))})::DOUBLE AS table_price,
    CASE WHEN {conf} IN ('high', 'medium', 'low') THEN {conf} WHEN brand IS NOT NULL THEN 'medium' ELSE 'low' END AS conf0
  FROM {src}),
{name} AS (SELECT * EXCLUDE (price, price_source, price_confidence), price AS stated,
    coalesce(listed, paid) AS known_price,
    coalesce(est0, table_price) AS estimated_price,
    coalesce(listed, paid, est0, table_price) AS price,
    CASE WHEN listed IS NOT NULL THEN CASE WHEN price_source IN ('user', 'seed') THEN 'user' ELSE 'tag' END
         WHEN paid IS NOT NULL THEN 'user' ELSE 'estimated' END AS price_source,
    CASE WHEN coalesce(listed, paid) IS NULL THEN CASE WHEN est0 IS NULL THEN 'low'
         WHEN conf0 = 'high' AND brand IS NULL THEN 'medium' ELSE conf0 END END AS price_confidence,
    CASE WHEN est0 IS NULL THEN 'table' ELSE coalesce(nullif(price_estimate_source, ''), 'gemini') END AS estimate_source
  FROM {name}_r)"""


def typed(category: str, text: list[str]) -> str:
    """SQL of the garment type within a category."""
    out = []
    for c, allowed in fixed.TYPES_BY_CATEGORY.items():
        rs = [r for r in fixed.TYPE_RULES if r[1] in allowed]
        inner = ", ".join(o.rules(f"lower({x})", rs) for x in text)
        out.append(f"WHEN {category} = '{c}' THEN coalesce({inner}, '{fixed.DEFAULT_TYPE[c]}')")
    return "CASE " + " ".join(out) + " END"


TEXTS = ["subcategory", "label", "description"]
WEARS = o.case("gtype", {k: v[2] for k, v in fixed.GARMENTS.items()})
CONTEXT = prices("closet_priced", "closet_items") + f""",
facts AS MATERIALIZED (SELECT *, {typed('category', TEXTS)} AS gtype FROM closet_priced),
per_wear AS MATERIALIZED (SELECT user_id, known_price IS NOT NULL AS real, coalesce(known_price, estimated_price) / {WEARS} AS v
  FROM facts),
bars AS MATERIALIZED (
  SELECT user_id, count(*) FILTER (real) AS priced, count(*) FILTER (NOT real) AS estimated,
    median(v) FILTER (real) AS real_bar,
    (SELECT median(w.v) FROM (SELECT v FROM per_wear x WHERE x.user_id = p.user_id UNION ALL
       SELECT v FROM per_wear x WHERE x.user_id = p.user_id AND real) w) AS mixed_bar
  FROM per_wear p GROUP BY user_id),
context AS MATERIALIZED (SELECT user_id, priced, estimated,
    {o.rnd('least(greatest(CASE WHEN priced >= 3 THEN real_bar ELSE mixed_bar END, 0.1), 10.0)', 4)} AS bar,
    CASE WHEN priced >= 3 THEN 'closet_median' ELSE 'closet_estimates' END AS bar_source FROM bars)"""


@query("price_bars", "VAL-7", "AGG-4", "VAL-1", "PRC-2", "PRC-5",
       sql=o.with_(o.CLOSET, CONTEXT) + """SELECT user_id, priced AS priced_items, estimated AS estimated_items,
         bar AS price_bar, bar_source AS price_bar_source FROM context""")
def _(t):
    from capsule.operators.value import price_bar
    from capsule.plans.evaluate import closet_facts
    return price_bar(closet_facts(t.kinded_closet()))


def money(x: str) -> str:
    return f"('$' || CASE WHEN {x} < 100 THEN printf('%.2f', {x}) ELSE printf('%.0f', {x}) END)"


_VERDICT = CONTEXT + prices("cand_priced", "candidate_items") + f""",
per_look AS MATERIALIZED (SELECT item_id, count(*) AS n, max(score) AS best, sum(score) AS weighted,
    (SELECT avg(x.score) FROM (SELECT score FROM looks y WHERE y.item_id = l.item_id ORDER BY score DESC LIMIT 5) x) AS q
  FROM looks l GROUP BY item_id),
pools AS (SELECT c.item_id,
    count(*) FILTER (i.category = 'top') AS t, count(*) FILTER (i.category = 'bottom') AS b,
    count(*) FILTER (i.category = 'outerwear') AS w, count(*) FILTER (i.category = 'dress') AS d,
    count(*) FILTER (i.category = c.category) AS same
  FROM ca c LEFT JOIN ci i ON i.user_id = c.user_id AND (c.loose OR (i.mask & c.mask) <> 0) GROUP BY c.item_id),
pair_n AS (SELECT c.item_id, count(*) AS pairs FROM ca c
    JOIN ci t ON t.user_id = c.user_id AND t.category = 'top' AND (c.loose OR (t.mask & c.mask) <> 0)
    JOIN ci b ON b.user_id = c.user_id AND b.category = 'bottom' AND (c.loose OR ((b.mask & c.mask) <> 0 AND (b.mask & t.mask) <> 0))
  GROUP BY c.item_id),
cand_typed AS MATERIALIZED (SELECT *, {typed('category', TEXTS)} AS gtype FROM cand_priced),
type_n AS MATERIALIZED (SELECT c.item_id, count(f.item_id) AS tn FROM cand_typed c JOIN ca USING (item_id)
  LEFT JOIN (SELECT user_id, item_id, gtype, {MASK} AS mask FROM facts) f
    ON f.user_id = c.user_id AND f.gtype = c.gtype AND (ca.loose OR (f.mask & ca.mask) <> 0) GROUP BY c.item_id),
v0 AS (
  SELECT c.item_id, c.user_id, c.category, c.gtype, c.price, c.price_source, c.price_confidence, coalesce(l.n, 0) AS n,
    coalesce(l.q, 0.0) AS q, coalesce(l.weighted, 0.0) AS weighted, v.level, v.other, {o.rnd('v.sim', 4)} AS sim,
    same, tn, coalesce(x.bar, 0.75) AS bar, coalesce(x.bar_source, 'default') AS bar_source,
    CASE c.category WHEN 'top' THEN b * (1 + w) WHEN 'bottom' THEN t * (1 + w)
      WHEN 'outerwear' THEN least(coalesce(pairs, 0), ca.most) + d WHEN 'dress' THEN 1 + w
      ELSE coalesce(pairs, 0) + d END AS m
  FROM cand_typed c JOIN (SELECT item_id, most FROM ca) ca USING (item_id) LEFT JOIN per_look l USING (item_id) JOIN levels v USING (item_id) JOIN pools USING (item_id)
  LEFT JOIN pair_n USING (item_id) JOIN type_n USING (item_id) LEFT JOIN context x ON x.user_id = c.user_id),
v1 AS (
  SELECT *, {WEARS} * least(2.0, 0.5 + 0.25 * log2(1 + n)) * CASE level WHEN 'similar' THEN 0.75
      WHEN 'near_duplicate' THEN 0.5 ELSE 1 END AS wears,
    CASE WHEN n <= 0 OR m <= 0 THEN 0.0 ELSE 0.5 * least(1, ln(1.0 + n) / ln(1.0 + greatest(m, 2)))
      + 0.5 * least(1, ln(1.0 + n) / ln(1.0 + least(8, greatest(m, 2)))) END AS vers,
    {o.rnd("0.4 * CASE WHEN price_source <> 'estimated' THEN 1 WHEN price_confidence = 'high' THEN 1.0 WHEN price_confidence = 'medium' THEN 0.75 ELSE 0.5 END", 3)} AS wc
  FROM v0),
v2 AS (
  SELECT *, price / wears AS cpw, round_even(100 * vers, 0)::BIGINT AS pv, round_even(100 * q, 0)::BIGINT AS pq,
    round_even(100 * CASE WHEN price / wears <= 0 THEN 1.0 ELSE
      greatest(-0.5, least(1.0, 0.6 + 0.3 * log2(bar / (price / wears)))) END, 0)::BIGINT AS pc,
    CASE WHEN same = 0 THEN 12 WHEN tn = 0 THEN 6 WHEN tn >= 5 THEN -6 ELSE 0 END AS gap,
    CASE WHEN level = 'similar' THEN -5 ELSE 0 END AS simp, 0.4::DOUBLE + 0.2::DOUBLE + wc AS w
  FROM v1),
v3 AS (
  SELECT *, round_even(greatest(0.0, least(100.0, (0.4::DOUBLE * pv + 0.2::DOUBLE * pq + wc * pc) / w + gap + simp)), 0)::BIGINT AS raw,
    CASE WHEN level = 'near_duplicate' THEN 'near_duplicate' WHEN n = 0 AND m > 0 THEN 'no_outfits'
      WHEN n = 0 THEN 'nothing_to_pair_with_yet' END AS capped
  FROM v2),
v4 AS (
  SELECT *, least(raw, CASE capped WHEN 'near_duplicate' THEN 44 WHEN 'no_outfits' THEN 44
    WHEN 'nothing_to_pair_with_yet' THEN 64 ELSE 100 END) AS score FROM v3),
verdicts AS MATERIALIZED (
  SELECT *, CASE WHEN score >= 65 THEN 'BUY' WHEN score >= 45 THEN 'CONSIDER' ELSE 'SKIP' END AS decision FROM v4)"""


def verdict_sql(looks: str) -> str:
    return o.with_(looks + _VERDICT) + f"""
       SELECT item_id, n AS n_outfits, m AS max_possible, pv AS versatility_points, pq AS quality_points,
         pc AS cost_points, gap AS gap_points, raw AS uncapped_score, capped AS capped_by, score, decision,
         {o.rnd('cpw', 2)} AS cost_per_wear, {o.rnd('wears', 1)} AS expected_wears, bar AS price_bar,
         {o.rnd('weighted', 3)} AS weighted_outfits FROM verdicts"""


def verdict_columns(results):
    return results.select(
        "item_id", "n_outfits", "max_possible", "versatility_points", "quality_points", "cost_points",
        col("gap.points").alias("gap_points"), "uncapped_score", "capped_by", "score", "decision", "cost_per_wear",
        "expected_wears", "price_bar", exact_round(col("weighted_outfits"), 3).alias("weighted_outfits"))


VERDICT = LOOKS + _VERDICT


@query("candidate_verdicts", "VAL-2", "VAL-3", "VAL-4", "VAL-5", "VAL-6", "VAL-8", "VAL-9", "AGG-3", "AGG-12", "STA-5",
       sql=verdict_sql(LOOKS))
def _(t):
    return verdict_columns(t.evaluation().results)


@query("varied_verdicts", "CMB-4", "TOP-1", "VAL-8", "PRJ-5", sql=verdict_sql(looks_sql(settings=VARIED)))
def _(t):
    """Verdicts where owners differ in strictness, layers, matching and the number of pairs."""
    from capsule.operators.attributes import default_settings
    u = col("user_id")
    settings = default_settings(t.candidates().select("user_id").distinct()).withColumns({
        "compat_threshold": F.element_at(F.array(*[F.lit(x) for x in (0.4, 0.5, 0.55, 0.6)]), (u % 4 + 1).cast("int")),
        "match_gender_presentation": u % 5 != 0, "use_shoes_layer": u % 3 != 0,
        "max_pairs_for_layering": F.element_at(F.array(*[F.lit(x) for x in (3, 40, 100)]), (u % 7 % 3 + 1).cast("int"))})
    return verdict_columns(t.evaluate(t.candidates(), settings).results)


@query("owned_verdicts", "CMB-6", "VAL-8", "AGG-3", sql=verdict_sql(looks_sql(OWNED, OWNED_DEFAULTS)))
def _(t):
    """Verdicts of items that are owned already: every item of every closet, against the rest of it."""
    return verdict_columns(t.evaluate(t.closet()).results)


@query("display_orders", "CMB-11",
       sql=o.with_(LOOKS) + f""", cats AS (SELECT item_id AS m, category AS c FROM closet_items UNION ALL SELECT item_id, category FROM candidate_items)
       SELECT item_id, outfit_key, string_agg(m, ' > ' ORDER BY {o.case('c', fixed.DISPLAY_ORDER, '9')}) AS shown
       FROM (SELECT item_id, outfit_key, unnest(string_split(outfit_key, '|')) AS m FROM looks) JOIN cats USING (m) GROUP BY item_id, outfit_key""")
def _(t):
    items = t.closet().select("item_id", "category").unionByName(t.candidates().select("item_id", "category"))
    worn = t.evaluation().outfits.select("item_id", looks.set_key(col("members")).alias("outfit_key"), F.explode("members").alias("m"))
    sets = (worn.join(items.select(col("item_id").alias("m"), col("category").alias("c")), "m")
            .groupBy("item_id", "outfit_key").agg(F.collect_list(F.struct("m", "c")).alias("s")))
    return sets.select("item_id", "outfit_key", joined(looks.display_order(col("s.m"), col("s.c")), " > ").alias("shown"))


_NOUN = o.case("category", fixed.NOUNS)
_MATCH = "' (' || printf('%.2f', sim) || ' match)'"
REASONS = VERDICT + f""",
reasons AS MATERIALIZED (
  SELECT item_id, 0 AS ord, 0.4::DOUBLE / w * (pv - 50) - CASE WHEN n = 0 THEN 10 ELSE 0 END AS p,
    CASE WHEN n = 0 AND m > 0 THEN 'Doesn''t go with anything in your closet yet'
      WHEN n = 0 THEN 'Nothing in your closet to wear a ' || {_NOUN} || ' with yet'
      WHEN vers >= 0.5 AND n >= 0.5 * m THEN 'Makes ' || n || ' of the ' || m || ' outfits a ' || {_NOUN} || ' can make with your closet'
      WHEN vers >= 0.5 THEN 'Makes ' || n || ' new outfits with your closet (' || m || ' possible for a ' || {_NOUN} || ')'
      ELSE 'Only makes ' || n || ' of the ' || m || ' outfits a ' || {_NOUN} || ' could make with your closet' END AS txt
  FROM verdicts
  UNION ALL SELECT item_id, 1, 0.2::DOUBLE / w * (pq - 50), 'Its best outfits are ' || CASE WHEN q >= 0.8 THEN 'strong'
      WHEN q >= 0.65 THEN 'good' ELSE 'only borderline' END || ' matches (' || printf('%.2f', q) || ' average score)'
  FROM verdicts WHERE n > 0
  UNION ALL SELECT item_id, 2, wc / w * (pc - 50), 'About ' || {money('cpw')} || ' per wear'
      || CASE WHEN price_source = 'estimated' THEN ' (est. price ~$' || printf('%.0f', price) || ')' ELSE '' END || ', '
      || CASE WHEN cpw / bar BETWEEN 0.9 AND 1.1 THEN 'in line with' WHEN cpw / bar < 1 THEN 'below' ELSE 'above' END
      || CASE bar_source WHEN 'closet_median' THEN ' your usual ' WHEN 'closet_estimates' THEN ' your usual ~' ELSE ' a typical ' END
      || {money('bar')} FROM verdicts
  UNION ALL SELECT item_id, 3, gap, CASE WHEN same = 0 THEN 'Would be your first ' || {o.case('category', fixed.CATEGORY_NAMES)}
      WHEN tn = 0 THEN 'Would be your first ' || {o.case('gtype', fixed.TYPE_SINGULAR)}
      ELSE 'You already own ' || tn || ' ' || {o.case('gtype', fixed.TYPE_PLURAL)} END FROM verdicts WHERE gap <> 0
  UNION ALL SELECT v.item_id, 4, -5, 'Similar to your ' || i.primary_color || ' ' || i.subcategory || {_MATCH}
  FROM verdicts v JOIN closet_items i ON i.item_id = v.other WHERE level = 'similar'),
lists AS MATERIALIZED (
  SELECT item_id, list(txt ORDER BY abs(p) DESC, ord) AS every,
    coalesce(list(txt ORDER BY abs(p) DESC, ord) FILTER (p > 0), []) AS up,
    coalesce(list(txt ORDER BY abs(p) DESC, ord) FILTER (p < 0), []) AS down FROM reasons GROUP BY item_id),
picked AS (
  SELECT v.item_id, CASE
      WHEN level = 'near_duplicate' THEN list_concat(['Very similar to your ' || i.primary_color || ' ' || i.subcategory || {_MATCH}],
        CASE WHEN len(down) > 0 THEN down ELSE every END)
      WHEN decision = 'BUY' THEN list_concat(up, down) WHEN decision = 'SKIP' THEN list_concat(down, up)
      ELSE list_concat(up[1:1], down[1:1], list_filter(every, lambda x: NOT list_contains(list_concat(up[1:1], down[1:1]), x)))
    END AS p, every, v.price_source
  FROM verdicts v JOIN lists USING (item_id) LEFT JOIN closet_items i ON i.item_id = v.other)"""


@query("verdict_reasons", "VAL-10", "PRJ-2",
       sql=o.with_(REASONS) + """
       SELECT item_id, p[1] AS reason_1, p[2] AS reason_2, array_to_string(every, ' / ') || CASE WHEN price_source = 'estimated'
         THEN ' / Price estimated from brand and type — enter the price for a more accurate verdict' ELSE '' END AS all_reasons
       FROM picked""")
def _(t):
    return t.evaluation().results.select("item_id", "reason_1", "reason_2",
                                         joined(col("all_reasons"), " / ").alias("all_reasons"))


@query("outfit_counts", "AGG-2", "CMB-1",
       sql=o.with_(LOOKS) + """
       , names AS (SELECT item_id, unnest([0, 1]) AS tord FROM ca)
       SELECT n.item_id, n.tord AS template_ord, count(l.item_id) AS n FROM names n LEFT JOIN looks l
         ON l.item_id = n.item_id AND l.tord = n.tord GROUP BY ALL""")
def _(t):
    r = t.evaluation().results
    each = F.inline(F.array(F.struct(F.lit(0).alias("template_ord"), col("n_first").alias("n")),
                            F.struct(F.lit(1).alias("template_ord"), col("n_second").alias("n"))))
    return r.select("item_id", each)


@query("shown_outfits", "WIN-2",
       sql=o.with_(LOOKS) + """
       SELECT item_id, template, count(*) AS n, least(count(*), 5) AS shown, count(*) > 5 AS truncated FROM looks
       GROUP BY ALL""")
def _(t):
    from capsule.plans.evaluate import shown_outfits
    s = shown_outfits(t.evaluation().outfits, 5)
    return s.groupBy("item_id", "template").agg(F.max("n_template").alias("n"), F.count("*").alias("shown"),
                                                F.bool_or("truncated").alias("truncated"))


@query("partner_pieces", "AGG-10", "AGG-11",
       sql=o.with_(LOOKS) + """
       SELECT item_id, count(DISTINCT m) FILTER (m <> item_id) AS pieces, count(DISTINCT outfit_key) AS outfits_with_item
       FROM (SELECT item_id, outfit_key, unnest(string_split(outfit_key, '|')) AS m FROM looks) GROUP BY item_id""")
def _(t):
    x = t.evaluation().outfits.select("item_id", looks.set_key(col("members")).alias("k"), F.explode("members").alias("m"))
    return x.groupBy("item_id").agg(F.count_distinct(F.when(col("m") != col("item_id"), col("m"))).alias("pieces"),
                                    F.count_distinct("k").alias("outfits_with_item"))
