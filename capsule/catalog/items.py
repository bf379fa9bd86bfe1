"""Scans, attributes, filters, prices, footprint and profile queries."""

from pyspark.sql import functions as F

from capsule import fixed
from capsule.catalog import oracle as o
from capsule.catalog.evaluation import TEXTS, VERDICT, prices, typed
from capsule.catalog.looks_sql import MASK
from capsule.catalog.registry import joined, query
from capsule.functions import words
from capsule.functions.numbers import exact_round, fixed as text
from capsule.operators import attributes as at
from capsule.operators import asof, filters, footprint, lifecycle, pricing, profile, ranking, value
from capsule.sources import closet as src
from capsule.sources import driver_tables as dt
from capsule.sources.staging import stage

col = F.col
CLOSET = o.with_(o.CLOSET)
BOTH = o.with_(o.CLOSET, o.CANDIDATES)


# ------------------------------------------------------------------ sources
@query("closet_scan", "SRC-1", "WIN-7",
       sql=CLOSET + "SELECT user_id, item_id, category, status, epoch(created_at)::BIGINT AS created FROM closet_items ORDER BY 1")
def _(t):
    return src.list_items(t.closet(), status="closet").select("user_id", "item_id", "category", "status",
                                                              F.unix_timestamp("created_at").alias("created"))


@query("keyed_lookup", "SRC-2",
       sql=BOTH + """SELECT user_id, item_id, label FROM closet_items c WHERE EXISTS (
         SELECT 1 FROM candidate_items x WHERE x.user_id = c.user_id AND x.part = c.part)""")
def _(t):
    return src.keyed(t.closet(), t.candidates(), ["user_id", "part"]).select("user_id", "item_id", "label")


@query("embedding_fetch", "SRC-3",
       sql=o.with_(o.CLOSET, o.VECTORS) + f"""SELECT user_id, item_id, len(v) AS dim, {o.rnd('v[1]', 6)} AS head
         FROM closet_items, vec_count JOIN vecs ON vec_id = text_key % n WHERE category = 'top'""")
def _(t):
    e = dt.item_embeddings(t.spark, t.root)
    tops = t.closet().where(col("category") == "top")
    return src.embeddings_for(e, tops, "text", "m1").select(
        "user_id", "item_id", F.size("vector").cast("bigint").alias("dim"),
        exact_round(F.get("vector", 0).cast("double"), 6).alias("head"))


@query("vector_codec", "SRC-4", "VEC-1",
       sql=f"""SELECT vec_id, {o.rnd('list_sum(v)', 6)} AS total,
         {o.rnd('list_sum(list_transform(v, lambda x: x * x)) / list_sum(list_transform(v, lambda x: x * x))', 6)} AS unit
         FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)""")
def _(t):
    from capsule.operators.similarity import dot, normalise
    v = src.decode_vectors(src.encode_vectors(dt.vectors(t.spark, t.root), "vector", "blob"), "blob", "vector")
    v = v.withColumns({"_t": F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")),
                       "_u": normalise(col("vector"))})
    v = v.withColumn("_d", dot(col("_u"), col("_u")))
    return v.select("vec_id", exact_round(col("_t"), 6).alias("total"), exact_round(col("_d"), 6).alias("unit"))


@query("shard_scan", "SRC-6",
       sql="""SELECT p_partkey, p_name, 'part.parquet' AS shard FROM part
         WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')""")
def _(t):
    returned = t.lineitem.where(col("l_returnflag") == "R").select(col("l_partkey").alias("p_partkey"))
    return src.scan_shards(t.spark, f"{t.root}/part.parquet", ["p_partkey", "p_name"], returned, "p_partkey")


@query("price_rule_hits", "SRC-7", "JN-8", "PRC-1",
       sql=CLOSET + f"""SELECT subcategory, category, coalesce({o.rules('subcategory', fixed.PRICE_RULES)},
         {o.case('category', fixed.PRICE_CATEGORY_DEFAULTS)})::DOUBLE AS table_price, count(*) AS n
         FROM closet_items GROUP BY ALL""")
def _(t):
    p = pricing.table_price([words.filled(col("subcategory"))], col("category"))
    return t.closet().groupBy("subcategory", "category", p.alias("table_price")).agg(F.count("*").alias("n"))


@query("factor_join", "SRC-8", "JN-7", "VAL-13",
       sql=CLOSET + f""", t AS (SELECT user_id, {typed('category', TEXTS)} AS garment_type FROM closet_items),
       {o.values('g', 'garment_type, weight, pair, wears', [(k, *v) for k, v in fixed.GARMENTS.items()])}
       SELECT garment_type, count(*) AS n, {o.rnd('sum(coalesce(weight, pair))', 3)} AS amount, sum(wears)::DOUBLE AS wears
       FROM t JOIN g USING (garment_type) GROUP BY garment_type""")
def _(t):
    kind = value.type_of(value.garment_type(col("category"), *[col(c) for c in TEXTS]))
    typed_ = t.closet().select(kind.alias("garment_type"))
    j = typed_.join(src.garment_factors(t.spark), "garment_type").groupBy("garment_type").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("weight_kg", "per_pair_co2e_kg")).alias("_a"),
        F.sum("base_wears").alias("wears"))
    return j.select("garment_type", "n", exact_round(col("_a"), 3).alias("amount"), "wears")


@query("labelled_sets", "SRC-9", "JN-16", "CUR-1",
       sql=o.with_(o.PARTS) + """SELECT l_orderkey AS set_id, count(*) FILTER (category = 'top') AS n_top,
         count(*) FILTER (category = 'shoes') AS n_shoes, count(*) AS members
         FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) JOIN parts ON part = l_partkey GROUP BY ALL""")
def _(t):
    from capsule.operators.curation import set_members, set_profile
    docs = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").distinct().groupBy("l_orderkey").agg(
        F.to_json(F.struct(col("l_orderkey").cast("string").alias("set_id"), F.collect_list(F.struct(
            col("l_partkey").cast("string").alias("item_id"), col("l_linenumber").alias("index"))).alias("items")))
        .alias("doc"))
    sets = src.labelled_sets(docs, col("doc"))
    meta = t.parts().select(col("part").cast("string").alias("item_id"), "category", col("label").alias("title"))
    p = set_profile(set_members(sets, meta), fixed.CATEGORIES)
    return p.select(col("set_id").cast("bigint").alias("set_id"), "n_top", "n_shoes",
                    (col("n_top") + col("n_bottom") + col("n_dress") + col("n_outerwear") + col("n_shoes")).alias("members"))


# ------------------------------------------------------------------ attributes
@query("item_texts", "PRJ-2", "PRJ-3", "PRJ-4",
       sql=o.with_(o.PARTS) + """SELECT part, primary_color || ' ' || subcategory AS name,
         'a photo of a ' || primary_color || ' ' || CASE WHEN pattern = 'solid' THEN '' ELSE pattern || ' ' END || subcategory AS prompt,
         array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS model_text FROM (
         SELECT *, list_filter(string_split(primary_color || ' ' || CASE WHEN pattern = 'solid' THEN '' ELSE pattern END || ' '
           || CASE WHEN fabric_guess = 'unknown' THEN '' ELSE coalesce(fabric_guess, '') END || ' ' || subcategory, ' '),
           lambda x: x <> '') AS w FROM parts)""")
def _(t):
    c = {k: col(k) for k in ("primary_color", "pattern", "fabric_guess", "subcategory", "category", "label")}
    return t.parts().select(
        "part", at.item_name(c["primary_color"], c["subcategory"], c["category"]).alias("name"),
        at.similarity_text(c["primary_color"], c["pattern"], c["subcategory"], c["category"]).alias("prompt"),
        at.model_text(*c.values()).alias("model_text"))


@query("api_projection", "PRJ-1",
       sql=CLOSET + """SELECT user_id, item_id, CASE WHEN part % 3 = 0 THEN 'attr' ELSE category END AS category,
         CASE WHEN part % 2 = 0 THEN 'clean' WHEN part % 5 = 1 THEN 'white' ELSE 'crop' END AS image FROM closet_items""")
def _(t):
    c = t.closet().withColumns({
        "category": F.when(col("part") % 3 != 0, col("category")).otherwise(""), "attr_category": F.lit("attr"),
        "clean_path": F.when(col("part") % 2 == 0, "clean"), "white_path": F.when(col("part") % 5 == 1, "white").otherwise(""),
        "crop_path": F.lit("crop"), "cutout_path": F.lit(None).cast("string")})
    return at.project_for_api(c).select("user_id", "item_id", "category", "image")



@query("settings_merge", "PRJ-5",
       sql="""SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN round(c_custkey % 10 / 10.0, 1) ELSE 0.5 END::DOUBLE AS strictness,
         CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 2 = 0 ELSE true END AS shoes, 40 AS pairs, 0.88::DOUBLE AS duplicate
         FROM customer""")
def _(t):
    users = t.customer.select(col("c_custkey").alias("user_id"))
    k = col("user_id")
    stored = users.where(k % 3 == 0).withColumn("data", F.to_json(F.struct(
        F.round(k % 10 / 10, 1).alias("compat_threshold"), (k % 2 == 0).alias("use_shoes_layer"),
        F.lit(7).alias("retired_limit"))))
    s = at.resolve_settings(users, stored)
    return s.select("user_id", col("compat_threshold").alias("strictness"), col("use_shoes_layer").alias("shoes"),
                    col("max_pairs_for_layering").alias("pairs"), col("redundancy_duplicate_threshold").alias("duplicate"))


def _patched(t):
    c = t.closet()
    attrs = F.create_map(F.lit("category"), col("category"), F.lit("price"), F.coalesce("price", F.lit("")),
                         F.lit("price_source"), F.coalesce("price_source", F.lit("tag")), F.lit("formality"),
                         col("formality").cast("string"))
    k = col("part") % 4
    patch = (F.when(k == 0, F.create_map(F.lit("formality"), F.lit("9")))
             .when(k == 1, F.create_map(F.lit("price"), F.lit("12.5"), F.lit("color"), F.lit("teal")))
             .when(k == 2, F.create_map(F.lit("price"), F.lit(""))))
    items = c.select("user_id", "item_id", attrs.alias("attributes"))
    return items, c.select("item_id", patch.alias("patch")).where(col("patch").isNotNull())


@query("attribute_patch", "PRJ-6", "PRJ-8",
       sql=CLOSET + """SELECT item_id, CASE WHEN part % 4 = 0 THEN '5' ELSE formality::VARCHAR END AS formality,
         CASE WHEN part % 4 = 0 THEN 'formal' END AS formality_label,
         CASE part % 4 WHEN 1 THEN '12.5' WHEN 2 THEN '' ELSE coalesce(price, '') END AS price,
         CASE part % 4 WHEN 1 THEN 'user' WHEN 2 THEN NULL ELSE coalesce(price_source, 'tag') END AS price_source,
         CASE WHEN part % 4 < 3 THEN 'true' END AS edited,
         CASE part % 4 WHEN 0 THEN 2 + CASE WHEN formality <> 5 THEN 1 ELSE 0 END
           WHEN 1 THEN 2 + CASE WHEN coalesce(price, '') <> '12.5' THEN 1 ELSE 0 END + CASE WHEN coalesce(price_source, 'tag') <> 'user' THEN 1 ELSE 0 END
           WHEN 2 THEN 1 + CASE WHEN coalesce(price, '') <> '' THEN 1 ELSE 0 END ELSE 0 END AS changed FROM closet_items""")
def _(t):
    items, patches = _patched(t)
    out = at.patch_attributes(items, patches, ["item_id"]).join(
        items.select("item_id", col("attributes").alias("before")), "item_id")
    return out.select("item_id", *[F.try_element_at("attributes", F.lit(k)).alias(k) for k in (
        "formality", "formality_label", "price", "price_source", "edited")],
        F.size(at.changed_attributes(col("before"), col("attributes"))).alias("changed"))


@query("stale_after_patch", "PRJ-7",
       sql=CLOSET + """SELECT what, kind, count(*) AS n FROM closet_items CROSS JOIN
         (VALUES ('embedding', 'compat'), ('set_scores', NULL)) v(what, kind) WHERE part % 4 < 3 GROUP BY ALL""")
def _(t):
    _, patches = _patched(t)
    return at.stale_after_patch(patches, ["item_id"]).groupBy("what", "kind").agg(F.count("*").alias("n"))


@query("category_check", "FLT-5",
       sql=o.with_(o.PARTS) + f"""SELECT part, CASE WHEN acc THEN 'accessory'
           WHEN cat NOT IN {o.in_list(fixed.CATEGORIES)} THEN 'category must be one of: top, bottom, dress, outerwear, shoes' END AS problem
         FROM (SELECT part, CASE WHEN part % 6 = 0 THEN 'swimwear' ELSE category END AS cat,
           regexp_extract(part_name, '([a-z]+)[^a-z]*$', 1) IN {o.in_list(fixed.ACCESSORY_WORDS)} AS acc FROM parts)""")
def _(t):
    p = t.parts().withColumn("cat", F.when(col("part") % 6 == 0, "swimwear").otherwise(col("category")))
    acc = filters.is_accessory(col("cat"), col("part_name"), col("label"))
    return p.select("part", at.category_problem(col("cat"), acc).alias("problem"))


@query("purchase_to_closet", "PRJ-11",
       sql=BOTH + """SELECT item_id, 'closet' AS status, CASE WHEN part % 2 = 0 THEN epoch(TIMESTAMP '2003-01-01')::BIGINT END AS at,
         CASE WHEN part % 2 = 0 AND price IS NOT NULL THEN price ELSE purchase_price END AS purchase_price FROM candidate_items""")
def _(t):
    out = at.move_to_closet(t.candidates(), purchased=col("part") % 2 == 0, now=F.lit("2003-01-01").cast("timestamp"))
    return out.select("item_id", "status", F.unix_timestamp("purchased_at").alias("at"), "purchase_price")


# ------------------------------------------------------------------ filters
@query("accessory_items", "FLT-1",
       sql=o.with_(o.PARTS) + f"""SELECT part_name, count(*) AS n,
         regexp_extract(part_name, '([a-z]+)[^a-z]*$', 1) IN {o.in_list(fixed.ACCESSORY_WORDS)} AS accessory FROM parts GROUP BY ALL""")
def _(t):
    a = filters.is_accessory(col("category"), col("part_name"), col("label"))
    return t.parts().groupBy("part_name", a.alias("accessory")).agg(F.count("*").alias("n"))


@query("supported_gate", "FLT-3",
       sql=BOTH + """SELECT item_id, CASE WHEN part % 11 = 0 THEN 'UNSUPPORTED' END AS decision FROM candidate_items""")
def _(t):
    c = t.candidates().withColumn("category", F.when(col("part") % 11 == 0, "bag").otherwise(col("category")))
    ok = filters.is_supported(col("category"))
    return value.unsupported(c).select("item_id", F.when(~ok, col("decision")).alias("decision"))


@query("batch_gate", "FLT-4",
       sql=o.with_(o.PARTS) + f"""SELECT l_orderkey, l_linenumber, bool_or(bad) OVER (PARTITION BY l_orderkey) AS refused FROM (
         SELECT l_orderkey, l_linenumber, regexp_extract(part_name, '([a-z]+)[^a-z]*$', 1) IN {o.in_list(fixed.ACCESSORY_WORDS)} AS bad
         FROM lineitem JOIN parts ON part = l_partkey)""")
def _(t):
    rows = t.lineitem.join(t.parts(), col("l_partkey") == col("part"))
    bad = filters.is_accessory(col("category"), col("part_name"), col("label"))
    return filters.accept_whole_batches(rows, ["l_orderkey"], bad).select("l_orderkey", "l_linenumber",
                                                                          col("batch_refused").alias("refused"))


def _boxes(t):
    k, q = col("l_linenumber"), col("l_quantity").cast("int")
    box = F.array((q * 17) % 900 - 20, (col("l_partkey") * 13 % 900).cast("int"),
                  (q * 17) % 900 + q * 11, (col("l_partkey") * 13 % 900).cast("int") + (col("l_suppkey") % 40 * 9).cast("int"))
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min(
        "l_quantity").alias("l_quantity"), F.min("l_suppkey").alias("l_suppkey")).select(
        col("l_orderkey").alias("photo_id"), (k - 1).cast("int").alias("pos"), box.alias("box"))


_BOXES = """, raw AS (SELECT l_orderkey AS photo_id, l_linenumber - 1 AS pos, min(l_quantity)::INT AS q, min(l_partkey) AS pk,
    min(l_suppkey) AS sk FROM lineitem GROUP BY l_orderkey, l_linenumber),
  b0 AS (SELECT photo_id, pos, greatest(0, least(1000, q * 17 % 900 - 20)) AS y0, greatest(0, least(1000, pk * 13 % 900)) AS x0,
    greatest(0, least(1000, q * 17 % 900 + q * 11)) AS y1, greatest(0, least(1000, pk * 13 % 900 + sk % 40 * 9)) AS x1 FROM raw),
  boxes AS (SELECT * FROM b0 WHERE y1 > y0 AND x1 > x0 AND (y1 - y0) * (x1 - x0) >= 400)"""


@query("detection_boxes", "FLT-13",
       sql=o.with_(o.PARTS, _BOXES) + "SELECT photo_id, pos, y0 || ',' || x0 || ',' || y1 || ',' || x1 AS box FROM boxes")
def _(t):
    return filters.keep_boxes(_boxes(t)).select("photo_id", "pos", joined(col("box"), ",").alias("box"))


@query("box_overlaps", "JN-12",
       sql=o.with_(o.PARTS, _BOXES) + """, p AS (SELECT *, (y1 - y0) * 0.06::DOUBLE + 4 AS py, (x1 - x0) * 0.06::DOUBLE + 4 AS px,
           (y1 - y0) * (x1 - x0) AS area FROM boxes)
         SELECT a.photo_id, a.pos, b.pos AS other FROM p a JOIN p b ON a.photo_id = b.photo_id AND a.pos <> b.pos
           AND b.area < 0.8::DOUBLE * a.area AND b.x1 > a.x0 - a.px AND b.x0 < a.x1 + a.px AND b.y1 > a.y0 - a.py AND b.y0 < a.y1 + a.py""")
def _(t):
    return filters.smaller_overlaps(filters.keep_boxes(_boxes(t)))


@query("detection_payloads", "EXT-11",
       sql="""SELECT photo_id, pos, label, formality FROM (SELECT l_orderkey AS photo_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey % 8) - 1 AS pos, CASE WHEN l_partkey % 4 = 0 THEN 'd' || l_partkey ELSE 'part ' || l_partkey END AS label,
         CASE WHEN l_suppkey % 8 = 0 THEN 2 ELSE least(5, l_suppkey % 8) END AS formality FROM lineitem)""")
def _(t):
    from capsule.operators.extract import detections
    item = F.struct("l_linenumber", "l_partkey", F.array(F.lit(1), F.lit(2), F.lit(900), F.lit(901)).alias("box_2d"),
                    F.when(col("l_partkey") % 4 != 0, F.concat(F.lit(" part "), "l_partkey")).otherwise(" ").alias("label"),
                    F.concat(F.lit("d"), "l_partkey").alias("description"), (col("l_suppkey") % 8).alias("formality"))
    p = t.lineitem.groupBy(col("l_orderkey").alias("photo_id")).agg(F.to_json(F.struct(
        F.sort_array(F.collect_list(item)).alias("items"))).alias("payload"))
    return detections(p).select("photo_id", col("pos").cast("bigint").alias("pos"), "label",
                                col("formality").cast("bigint").alias("formality"))


# ------------------------------------------------------------------ prices
@query("effective_prices", "PRC-2", "PRC-3", "PRC-4", "PRC-5",
       sql=o.with_(o.PARTS, prices("pp", "parts")) + """SELECT part, price, price_source, price_confidence, estimated_price,
         estimate_source FROM pp""")
def _(t):
    return pricing.effective_price(t.parts()).select(
        "part", col("price_used").alias("price"), col("price_used_source").alias("price_source"),
        col("price_used_confidence").alias("price_confidence"), "estimated_price", "estimate_source")


_BACKFILL = prices("pp", "stock") + """,
  todo AS (SELECT *, CASE WHEN part % 3 = 1 THEN part % 50 + 0.5 WHEN part % 3 = 2 THEN -1.0 END::DOUBLE AS m FROM pp_r
    WHERE listed IS NULL AND paid IS NULL AND est0 IS NULL)"""


@query("estimate_backfill", "PRC-6", "AGG-9", "SET-2", "JN-14", "FLT-16", "EXT-13",
       sql=BOTH.rstrip() + """, stock AS (SELECT user_id, item_id, status, p.* FROM (SELECT user_id, item_id, status, part FROM closet_items
         UNION ALL SELECT user_id, item_id, status, part FROM candidate_items) JOIN parts p USING (part))""" + _BACKFILL + """
       SELECT status, count(*) AS items_needing_estimate, count(*) FILTER (m > 0) AS model_estimates,
         count(*) FILTER (m IS NULL OR m <= 0) AS table_estimates,
         sum(CASE WHEN m > 0 THEN round_even(greatest(least(m, 5000), 3), 0)::DOUBLE ELSE table_price END)::DOUBLE AS total FROM todo GROUP BY status""")
def _(t):
    items = t.closet().unionByName(t.candidates(), allowMissingColumns=True)
    todo = items.where(pricing.needs_estimate())
    # answers come per batch, by position: here one batch per user and status
    from pyspark.sql import Window
    w = Window.partitionBy("user_id", "status").orderBy("created_at", "item_id")
    batches = todo.select(F.concat_ws("|", "user_id", "status").alias("batch_id"), F.row_number().over(w).alias("position"),
                          "item_id", "part")
    replies = batches.where(col("part") % 3 != 0).select(
        "batch_id", F.concat(F.lit(" "), col("position").cast("string")).alias("id"),
        F.when(col("part") % 3 == 1, (col("part") % 50 + 0.5)).otherwise(-1.0).alias("estimated_price_usd"),
        F.lit("low").alias("price_confidence"))
    answered = pricing.estimate_replies(replies, batches).select(
        "item_id", col("estimated_price_usd").alias("m_price"), col("price_confidence").alias("m_confidence"))
    done = pricing.backfill_estimates(items, answered)
    total = done.groupBy("status").agg(F.sum("estimated_price_usd").alias("total"))
    return pricing.backfill_summary(done).join(total, "status")


@query("page_price_sanity", "FLT-14",
       sql=f"SELECT p_partkey, (p_retailprice / (p_size * 30) BETWEEN 1 / {fixed.PRICE_RATIO}::DOUBLE AND {fixed.PRICE_RATIO}::DOUBLE) AS sane FROM part")
def _(t):
    return t.part.select("p_partkey", pricing.sane_page_price((col("p_size") * 30).cast("double"), col("p_retailprice")).alias("sane"))


# ------------------------------------------------------------------ materials and footprint
_MIXES = [("95% cotton 5% elastane", "percentages", "cotton:0.95 polyurethane:0.05"),
          ("cotton 60%, polyester 40%", "percentages", "cotton:0.60 polyester:0.40"),
          ("cotton and linen", "keywords", "cotton:0.50 linen:0.50"),
          ("cotton blend", "blend_assumption", "cotton:0.50 unknown:0.50"),
          ("poly-cotton", "keywords", "cotton:0.50 polyester:0.50"), ("merino wool", "keywords", "wool:1.00"),
          ("unknown", "fallback", "unknown:1.00"), ("", "fallback", "unknown:1.00"),
          ("recycled polyester", "keywords", "recycled_polyester:1.00"), ("rubber", "fallback", "unknown:1.00"),
          ("silk satin", "keywords", "silk:0.50 polyester:0.50"), ("vegan leather", "keywords", "polyurethane:1.00"),
          ("60% cotton", "percentages", "cotton:0.60 unknown:0.40")]


@query("material_mixes", "VAL-11", "UDF-4",
       sql=o.with_(o.PARTS) + ", " + o.values("m", "txt, method, mix", _MIXES) + """
       SELECT part, method, mix FROM parts JOIN m ON txt = coalesce(material, '')""")
def _(t):
    p = footprint.parse_mixes(t.parts().select("part", "material"), "material")
    return p.select("part", "method", F.array_join(F.transform("mix", lambda c: F.concat(
        c["material"], F.lit(":"), F.format_string("%.2f", c["share"]))), " ").alias("mix"))


@query("share_merge", "AGG-15",
       sql=o.with_(o.PARTS) + f"""SELECT s.o_custkey AS user_id, category AS material, {o.rnd('q / sum(q) OVER (PARTITION BY s.o_custkey)', 4)} AS share
         FROM (SELECT o_custkey, category, sum(l_quantity) AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN parts ON part = l_partkey GROUP BY ALL) s""")
def _(t):
    rows = t.lineitem.join(t.orders, col("l_orderkey") == col("o_orderkey")).join(t.parts(), col("l_partkey") == col("part")).select(
        col("o_custkey").alias("user_id"), col("category").alias("material"), col("l_quantity").alias("share"))
    return footprint.merge_shares(rows, ["user_id"])


def materials_sql(source: str, key: str) -> str:
    """CTE `sums`: factor of the material mix of each row of `source`."""
    return o.values("mx", "txt, method, mix", _MIXES) + ",\n" + o.values(
        "mat", "material, co2, water", [(k, *v) for k, v in fixed.MATERIALS.items()]) + ",\n" + o.values(
        "gar", "gtype, weight, pair, base", [(k, *v) for k, v in fixed.GARMENTS.items()]) + f""",
stated AS (SELECT i.{key}, CASE WHEN lower(trim(coalesce(material, ''))) NOT IN {o.in_list(fixed.UNKNOWN_MATERIAL_TEXT)} THEN material
    WHEN coalesce(fabric_guess, '') NOT IN {o.in_list(fixed.UNKNOWN_MATERIAL_TEXT)} THEN fabric_guess END AS txt,
    description || ' ' || label || ' ' || subcategory AS d FROM {source} i),
parts_of AS (
  SELECT {key}, string_split(p, ':')[1] AS material, string_split(p, ':')[2]::DOUBLE AS share
  FROM (SELECT {key}, unnest(string_split(CASE
      WHEN txt IN ('cotton twill', 'denim') THEN 'cotton:1' WHEN txt = 'wool' THEN 'wool:1'
      WHEN txt IS NOT NULL THEN (SELECT mix FROM mx WHERE mx.txt = stated.txt)
      WHEN regexp_matches(d, 'denim') THEN 'cotton:1' WHEN regexp_matches(d, '\\bwool') THEN 'wool:1'
      ELSE 'unknown:1' END, ' ')) AS p FROM stated)),
sums AS (SELECT {key}, sum(share * co2) AS mixf, sum(share * water) AS wsum, sum(share) FILTER (water IS NOT NULL) AS wshare
  FROM parts_of JOIN mat USING (material) GROUP BY {key})"""


_GRADE = """CASE WHEN fscore >= 80 THEN 'A' WHEN fscore >= 65 THEN 'B' WHEN fscore >= 50 THEN 'C' WHEN fscore >= 35 THEN 'D' ELSE 'E' END"""
_FOOT = VERDICT + ",\n" + materials_sql("candidate_items", "item_id") + """,
foot AS (SELECT v.item_id, v.gtype, v.n, v.wears, coalesce(pair, weight * mixf) AS co2,
    coalesce(pair, weight * 21.6::DOUBLE) / base AS typical, CASE WHEN pair IS NULL AND wshare > 0 THEN weight * wsum END AS litres
  FROM verdicts v JOIN gar USING (gtype) JOIN sums USING (item_id)),
foot2 AS (SELECT *, greatest(0, least(100, round_even(50 - 30 * log2(co2 / wears / typical), 0)))::BIGINT AS fscore FROM foot)"""


@query("candidate_footprints", "VAL-14", "VAL-15", "VAL-16", "VAL-12",
       sql=o.with_(_FOOT) + f"""SELECT item_id, {o.rnd('co2', 2)} AS footprint_kg, round_even(litres, 0)::BIGINT AS water_l,
         {o.rnd('co2 / wears', 4)} AS per_wear_kg, fscore AS footprint_score,
         {_GRADE} AS grade FROM foot2""")
def _(t):
    return _foot(t).select("item_id", "footprint_kg", "water_l", "per_wear_kg", "footprint_score", "grade")


def _foot(t):
    r = t.evaluation().results.withColumn("similarity", col("top_similarity"))
    return footprint.footprint(r)


@query("footprint_sentences", "VAL-17", "VAL-21",
       sql=o.with_(_FOOT) + """SELECT item_id, CASE WHEN fscore >= 75 THEN 'Great choice' WHEN fscore >= 58 THEN 'Pretty good'
           WHEN fscore >= 42 THEN 'Okay' ELSE 'Not great' END AS rating,
         CASE WHEN v.level = 'near_duplicate' THEN 'Near-duplicate' WHEN n = 0 THEN 'Doesn''t unlock' ELSE 'Unlocks ' || n END AS opening,
         CASE WHEN gtype IN ('sneakers', 'boots', 'sandals') THEN 'Footwear' ELSE 'other' END AS material_kind
         FROM foot2 JOIN levels v USING (item_id)""")
def _(t):
    f = _foot(t)
    opening = F.regexp_extract("footprint_reason", r"^(Near-duplicate|Doesn't unlock|Unlocks \d+)", 1)
    return f.select("item_id", footprint.plain_rating(col("footprint_score")).alias("rating"), opening.alias("opening"),
                    F.when(col("material_reason").startswith("Footwear"), "Footwear").otherwise("other").alias("material_kind"))


# what was known of an item each time it was bought, and moments at which its footprint is asked for
_MOMENTS = ("1996-06-01", "1998-11-05", "2100-01-01")
_SEEN = f"""ev AS (SELECT 'i' || o_custkey || '_' || l_partkey AS item_id, o_orderdate AS moment, o_orderkey AS evaluation_id,
    CASE WHEN o_orderkey % 9 > 0 THEN sum(l_quantity)::BIGINT % 12 END AS n, CASE WHEN o_orderkey % 7 > 0 THEN max(l_discount) * 10 END AS sim,
    CASE WHEN o_orderkey % 4 > 0 THEN max(l_extendedprice) END AS paid
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey, o_orderdate, o_orderkey),
last_ev AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY item_id, moment ORDER BY evaluation_id DESC) = 1),
asked AS (SELECT item_id, part, m.moment FROM closet_items CROSS JOIN (VALUES {", ".join(f"(TIMESTAMP '{m}')" for m in _MOMENTS)}) m(moment)),
known AS (SELECT a.item_id, a.part, a.moment, e.evaluation_id, coalesce(n, 0) AS n, paid,
    CASE WHEN sim >= 0.88 THEN 0.5 WHEN sim >= 0.8 THEN 0.75 ELSE 1 END AS trims
  FROM asked a ASOF LEFT JOIN last_ev e ON e.item_id = a.item_id AND a.moment >= e.moment),
typed_parts AS (SELECT *, {typed("category", TEXTS)} AS gtype FROM parts)"""


@query("footprints_as_of", "VAL-20", "JN-15",
       sql=o.with_(o.CLOSET, _SEEN, materials_sql("parts", "part")) + f""", f AS (SELECT k.*, coalesce(pair, weight * mixf) AS co2,
           coalesce(pair, weight * 21.6::DOUBLE) / base AS typical, CASE WHEN pair IS NULL AND wshare > 0 THEN weight * wsum END AS litres,
           base * least(2.0, 0.5 + 0.25 * log2(1 + n)) * trims AS wears, coalesce(paid, TRY_CAST(price AS DOUBLE)) AS cost
         FROM known k JOIN typed_parts p USING (part) JOIN gar USING (gtype) JOIN sums USING (part) WHERE evaluation_id IS NOT NULL),
         g AS (SELECT *, greatest(0, least(100, round_even(50 - 30 * log2(co2 / wears / typical), 0)))::BIGINT AS fscore FROM f)
         SELECT k.item_id, k.moment, k.evaluation_id, {o.rnd("co2", 2)} AS footprint_kg, round_even(litres, 0)::BIGINT AS water_l,
           {o.rnd("wears", 1)} AS wears, fscore AS footprint_score, CASE WHEN fscore IS NOT NULL THEN {_GRADE} END AS grade,
           {o.rnd("cost / wears", 2)} AS cost_per_wear
         FROM known k LEFT JOIN g ON g.item_id = k.item_id AND g.moment = k.moment""")
def _(t):
    """Every owned item's footprint at three moments: its attributes of today with what its latest evaluation found."""
    k = col("o_orderkey")
    seen = (t.lineitem.join(t.orders, col("l_orderkey") == k)
            .groupBy(F.concat(F.lit("i"), "o_custkey", F.lit("_"), "l_partkey").alias("item_id"), col("o_orderdate").cast("timestamp").alias("evaluated_at"),
                     k.alias("evaluation_id"))
            .agg(F.when(k % 9 > 0, F.sum("l_quantity").cast("long") % 12).alias("n_outfits"), F.when(k % 7 > 0, F.max("l_discount") * 10).alias("similarity"),
                 F.when(k % 4 > 0, F.max("l_extendedprice")).alias("paid")))
    seen = stage(seen, "seen")  # read by the count of the keys and by the run
    moments = F.array(*[F.lit(m).cast("timestamp") for m in _MOMENTS])
    asked = t.closet().select("item_id", "part", F.explode(moments).alias("moment"))
    known = stage(asof.as_of(asked, seen, ["item_id"], "moment", "evaluated_at", "evaluation_id"), "known")
    kinds = t.kinded_parts().select("part", "garment_type", "material", "fabric_guess", "description", "label", "subcategory", col("price").alias("own_price"))
    kinds = stage(footprint.with_mixes(kinds), "part-mixes")  # once a part, not once an evaluated item
    evaluated = footprint.at_evaluation(known.where("fact is not null").join(kinds, "part"))
    never = known.where("fact is null").select("item_id", "moment")
    return (evaluated.select("item_id", "moment", "evaluation_id", "footprint_kg", "water_l", col("footprint_wears").alias("wears"), "footprint_score", "grade",
                             col("footprint_cost_per_wear").alias("cost_per_wear"))
            .unionByName(never, allowMissingColumns=True))


@query("latest_footprint", "WIN-1",
       sql=o.with_(o.PARTS) + f""", ev AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderkey % 50 AS n FROM orders
           QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
         SELECT o_custkey AS user_id, o_orderkey AS evaluation_id, {o.rnd('70 * least(2.0, 0.5 + 0.25 * log2(1 + n))', 1)} AS wears FROM ev""")
def _(t):
    ev = t.orders.select(col("o_custkey").alias("user_id"), col("o_orderkey").alias("id"),
                         col("o_orderdate").alias("created_at"), (col("o_orderkey") % 50).alias("n"))
    last = ranking.latest(ev, ["user_id"]).withColumn("_w", value.expected_wears(F.lit("trousers"), col("n"), F.lit("none")))
    return last.select("user_id", col("id").alias("evaluation_id"), exact_round(col("_w"), 1).alias("wears"))


# ------------------------------------------------------------------ profiles


def _common(value_sql: str, keys: str, k: int) -> str:
    return f"""(SELECT {keys}, string_agg(v, ', ' ORDER BY r) AS txt FROM (
      SELECT {keys}, v, row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, min(created_at || '#' || item_id)) AS r
      FROM (SELECT *, {value_sql} AS v FROM closet_items) GROUP BY {keys}, v) WHERE r <= {k} GROUP BY {keys})"""


@query("closet_profile", "AGG-5",
       sql=CLOSET + f"""SELECT p.user_id, p.category, p.items, c.txt AS colors, s.txt AS types
         FROM (SELECT user_id, category, count(*) AS items FROM closet_items GROUP BY ALL) p
         JOIN {_common('primary_color', 'user_id, category', 4)} c ON c.user_id = p.user_id AND c.category = p.category
         JOIN {_common('subcategory', 'user_id, category', 3)} s ON s.user_id = p.user_id AND s.category = p.category""")
def _(t):
    return profile.closet_profile(t.closet())


@query("profile_summary", "AGG-18",
       sql=CLOSET + f"""SELECT p.user_id, string_agg(p.category || ': ' || p.items || ' (' || s.txt || '; colors ' || c.txt || ')', '; ' ORDER BY p.category) AS summary
         FROM (SELECT user_id, category, count(*) AS items FROM closet_items GROUP BY ALL) p
         JOIN {_common('primary_color', 'user_id, category', 4)} c ON c.user_id = p.user_id AND c.category = p.category
         JOIN {_common('subcategory', 'user_id, category', 3)} s ON s.user_id = p.user_id AND s.category = p.category GROUP BY p.user_id""")
def _(t):
    return profile.profile_text(profile.closet_profile(t.closet()))


@query("closet_gender", "AGG-6",
       sql=CLOSET + """SELECT user_id, count(*) FILTER (gender = 'mens') AS mens, count(*) FILTER (gender = 'womens') AS womens,
         count(*) FILTER (gender = 'unisex') AS unisex, CASE WHEN bool_or(gender = 'mens') AND NOT bool_or(gender = 'womens') THEN 'mens'
         WHEN bool_or(gender = 'womens') AND NOT bool_or(gender = 'mens') THEN 'womens' ELSE 'unisex' END AS closet_gender
         FROM closet_items GROUP BY user_id""")
def _(t):
    return profile.dominant_gender(t.closet())


@query("closet_styles", "AGG-7",
       sql=CLOSET + """SELECT user_id, string_agg(v, ', ' ORDER BY r) AS styles FROM (
         SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(created_at || '#' || item_id || '#' || i)) AS r
         FROM (SELECT user_id, created_at, item_id, unnest(style_tags) AS v, unnest([1, 2]) AS i FROM closet_items) GROUP BY user_id, v) WHERE r <= 6 GROUP BY user_id""")
def _(t):
    return profile.style_tags(t.closet())


@query("closet_formality", "AGG-8",
       sql=CLOSET + f"SELECT user_id, {o.rnd('avg(formality)', 1)} AS mean_formality FROM closet_items GROUP BY user_id")
def _(t):
    return profile.mean_formality(t.closet())


@query("missing_categories", "SET-4",
       sql=CLOSET + """, g AS (SELECT user_id, list(DISTINCT category) AS owned, bool_or(gender = 'mens') AND NOT bool_or(gender = 'womens') AS mens
           FROM closet_items WHERE category <> coalesce(['top', 'bottom', 'outerwear', 'dress', 'shoes'][user_id % 6 + 1], '') GROUP BY user_id)
         SELECT user_id, array_to_string(list_filter(['top', 'bottom', 'outerwear', 'shoes', 'dress'],
           lambda c: NOT list_contains(owned, c) AND NOT (mens AND c = 'dress')), '|') AS missing FROM g""")
def _(t):
    """Five of six owners have put one whole category away."""
    away = F.get(F.array(*[F.lit(x) for x in dt.CATEGORY]), (col("user_id") % 6).cast("int"))
    c = t.closet().where(col("category") != F.coalesce(away, F.lit("")))
    own = c.groupBy("user_id").agg(F.collect_set("category").alias("owned"))
    return own.join(profile.dominant_gender(c), "user_id").select(
        "user_id", joined(profile.missing_categories(col("owned"), col("closet_gender"))).alias("missing"))


@query("category_chips", "AGG-14", "TXT-15",
       sql=CLOSET + """SELECT user_id, category, count(*) AS n FROM closet_items GROUP BY ALL UNION ALL
         SELECT user_id, 'all', count(*) FROM closet_items GROUP BY user_id""")
def _(t):
    plural = F.concat(F.upper(col("category")), F.when(col("category") == "top", "S").otherwise(""))
    return profile.category_counts(t.closet(), words.category_key(plural))


_ROW = "concat_ws(chr(1), item_id, category, subcategory, primary_color, gender)"


@query("closet_keys", "AGG-17",
       sql=CLOSET + f"""SELECT user_id, substr(sha1(user_id || '|' || count(*) || '|' || sum(('0x' || substr(md5({_ROW}), 1, 12))::BIGINT) || '|'
         || sum(('0x' || substr(md5({_ROW}), 13, 12))::BIGINT) || '|'), 1, 16) AS closet_key FROM closet_items GROUP BY user_id""")
def _(t):
    return profile.content_key(t.closet())


@query("index_in_step", "SET-5",
       sql=CLOSET + """SELECT user_id, bool_and(part % 97 <> 0) AS in_step FROM closet_items GROUP BY user_id""")
def _(t):
    c = t.closet()
    return lifecycle.same_members(c, c.where(col("part") % 97 != 0), "user_id", "item_id")


@query("variety_count", "AGG-13",
       sql=CLOSET + """SELECT user_id, sum(least(n, 2))::BIGINT AS varied FROM (SELECT user_id, category, count(*) AS n FROM closet_items GROUP BY ALL) GROUP BY user_id""")
def _(t):
    return profile.varied_count(t.closet(), ["user_id"])


@query("accessory_dependents", "AGG-16",
       sql=o.with_(o.PARTS) + f"""SELECT part AS item_id, (SELECT count(*) FROM lineitem WHERE l_partkey = part) AS line_rows,
         (SELECT count(*) FROM lineitem WHERE l_partkey = part AND l_returnflag = 'R') AS returned_rows FROM parts
         WHERE regexp_extract(part_name, '([a-z]+)[^a-z]*$', 1) IN {o.in_list(fixed.ACCESSORY_WORDS)}""")
def _(t):
    acc = t.parts().where(filters.is_accessory(col("category"), col("part_name"), col("label"))).select(col("part").alias("item_id"))
    lines = t.lineitem.select(col("l_partkey").alias("item_id"), "l_returnflag")
    return profile.dependents(acc, {"line_rows": lines, "returned_rows": lines.where(col("l_returnflag") == "R")})
