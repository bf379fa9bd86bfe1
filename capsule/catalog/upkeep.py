"""Table changes, curation, statistics, colours, zero-shot labels and time rules."""

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from capsule import fixed
from capsule.catalog import oracle as o
from capsule.catalog.evaluation import VERDICT
from capsule.catalog.registry import CENTER, QUERIES, query
from capsule.functions import colors
from capsule.functions.numbers import exact_round
from capsule.operators import curation, lifecycle, looks, similarity, statistics
from capsule.operators.value import price_bar
from capsule.plans.evaluate import closet_facts
from capsule.sources.staging import shared_folder, stage
from capsule.sources.written import WrittenTable
from capsule.streaming import batch, rules, stateful, stream

col = F.col
PARTS = o.with_(o.PARTS)
CLOSET = o.with_(o.CLOSET)
BOTH = o.with_(o.CLOSET, o.CANDIDATES)


# ------------------------------------------------------------------ table changes
@query("append_rows", "SNK-1",
       sql="""SELECT 'it_' || substr(sha1(l_orderkey || '|' || l_linenumber), 1, 16) AS id, count(*) AS n FROM (
         SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY ALL""")
def _(t):
    parts, keys = lifecycle.partitions(t.lineitem.count()), ["l_orderkey", "l_linenumber"]
    rows = t.lineitem.select(*keys).repartition(parts, *keys).distinct().withColumn(
        "id", lifecycle.natural_id("it_", col("l_orderkey"), col("l_linenumber")))
    half = rows.where(col("l_orderkey") % 2 == 0)
    return lifecycle.append_rows(half, rows, "id", parts).repartition(parts, "id").groupBy("id").agg(F.count("*").alias("n"))


@query("upsert_rows", "SNK-2",
       sql="""WITH inc AS (SELECT o_custkey AS k, arg_max(o_totalprice, struct_pack(d := o_orderdate, k := o_orderkey)) AS bal FROM orders GROUP BY 1)
         SELECT coalesce(c_custkey, k) AS k, CASE WHEN c_custkey IS NULL THEN bal WHEN k IS NOT NULL THEN bal ELSE c_acctbal END AS bal,
         c_mktsegment AS segment FROM (SELECT * FROM customer WHERE c_custkey % 3 <> 0) FULL JOIN inc ON k = c_custkey""")
def _(t):
    table = t.customer.where(col("c_custkey") % 3 != 0).select(col("c_custkey").alias("k"), col("c_acctbal").alias("bal"),
                                                               col("c_mktsegment").alias("segment"))
    rows = t.orders.select(col("o_custkey").alias("k"), col("o_totalprice").alias("bal"), F.lit(None).cast("string").alias("segment"),
                           F.struct("o_orderdate", "o_orderkey").alias("at"))
    return lifecycle.upsert(table, rows, ["k"], "at", update=["bal"])


@query("header_detail", "SNK-3", "SET-3",
       sql="SELECT l_orderkey AS outfit_id, l_partkey % 7 AS item_id, min(l_linenumber) - 1 AS position FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS l_linenumber FROM lineitem) GROUP BY ALL")
def _(t):
    ids = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda e: e["l_partkey"] % 7)
    outfits = t.lineitem.groupBy(col("l_orderkey").alias("outfit_id")).agg(ids.alias("item_ids")).withColumn("user_id", F.lit(1))
    return lifecycle.header_and_detail(outfits)[1].select("outfit_id", "item_id", col("position").cast("bigint").alias("position"))


@query("replace_content", "SNK-4",
       sql="""SELECT c_custkey AS user_id, CASE WHEN c_custkey % 4 = 0 THEN 'new' || c_nationkey ELSE 'old' || v END AS closet_key FROM customer
         CROSS JOIN (VALUES (1), (2)) x(v) WHERE c_custkey % 4 <> 0 OR v = 1""")
def _(t):
    u = t.customer.select(col("c_custkey").alias("user_id"), "c_nationkey")
    old = u.select("user_id", F.explode(F.array(F.lit("old1"), F.lit("old2"))).alias("closet_key"))
    fresh = u.where(col("user_id") % 4 == 0).select("user_id", F.concat(F.lit("new"), "c_nationkey").alias("closet_key"))
    return lifecycle.replace_content(old, fresh)


def _written(t, first, keys):
    """A new written table with the rows of `first`."""
    path = f"{shared_folder(t.spark)}/written-{uuid.uuid4().hex[:12]}"
    table = WrittenTable(t.spark, path, first.schema, keys, 16).create()
    table.change(first, lambda _: first)
    return table


def _sql_of(name):
    return QUERIES[name].sql


@query("written_rows", "SNK-1", sql=_sql_of("append_rows"))
def _(t):
    """Rows appended to a written table twice; the second time only new ids stay."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber").distinct().withColumn(
        "id", lifecycle.natural_id("it_", col("l_orderkey"), col("l_linenumber")))
    table = _written(t, rows.where(col("l_orderkey") % 2 == 0), ["id"])
    table.change(rows, lambda kept: lifecycle.append_rows(kept, rows, "id"))
    return table.read().groupBy("id").agg(F.count("*").alias("n"))


@query("written_upserts", "SNK-2", sql=_sql_of("upsert_rows"))
def _(t):
    """Balances updated in a written table: only the buckets of changed customers are read and written."""
    first = t.customer.where(col("c_custkey") % 3 != 0).select(col("c_custkey").alias("k"), col("c_acctbal").alias("bal"), col("c_mktsegment").alias("segment"))
    table = _written(t, first, ["k"])
    rows = t.orders.select(col("o_custkey").alias("k"), col("o_totalprice").alias("bal"), F.lit(None).cast("string").alias("segment"),
                           F.struct("o_orderdate", "o_orderkey").alias("at"))
    table.change(rows, lambda kept: lifecycle.upsert(kept, rows, ["k"], "at", update=["bal"]))
    return table.read()


@query("written_sets", "SNK-3", "SET-3", sql=_sql_of("header_detail"))
def _(t):
    """Set members written below their headers; a set that is saved again has only its new members."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda e: e["l_partkey"] % 7)
    sets = t.lineitem.groupBy(col("l_orderkey").alias("outfit_id")).agg(ids.alias("item_ids")).withColumn("user_id", F.lit(1))
    old = lifecycle.header_and_detail(sets.withColumn("item_ids", F.reverse("item_ids")))[1]
    table = _written(t, old, ["outfit_id"])
    fresh = lifecycle.header_and_detail(sets)[1]
    table.change(sets, lambda kept: kept.join(sets.select("outfit_id"), "outfit_id", "left_anti").unionByName(fresh))
    return table.read().select("outfit_id", "item_id", col("position").cast("bigint").alias("position"))


@query("written_content", "SNK-4", sql=_sql_of("replace_content"))
def _(t):
    """Content keys replaced in a written table, twice under one name: the repetition changes nothing."""
    u = t.customer.select(col("c_custkey").alias("user_id"), "c_nationkey")
    table = _written(t, u.select("user_id", F.explode(F.array(F.lit("old1"), F.lit("old2"))).alias("closet_key")), ["user_id"])
    fresh = u.where(col("user_id") % 4 == 0).select("user_id", F.concat(F.lit("new"), "c_nationkey").alias("closet_key"))
    for keys in (fresh, fresh.withColumn("closet_key", F.lit("again"))):
        table.change(keys, lambda kept, keys=keys: lifecycle.replace_content(kept, keys), "replace-1")
    return table.read()


@query("delete_items", "SNK-5", "SNK-7",
       sql="""SELECT o_custkey AS user_id, l_orderkey AS outfit_key, count(*) AS members FROM lineitem JOIN orders ON o_orderkey = l_orderkey
         WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 50 = 0) GROUP BY ALL""")
def _(t):
    sets = t.lineitem.join(t.orders, col("l_orderkey") == col("o_orderkey")).groupBy(
        col("o_custkey").alias("user_id"), col("l_orderkey").alias("outfit_key")).agg(F.collect_list("l_partkey").alias("item_ids"))
    gone = t.part.where(col("p_partkey") % 50 == 0).select(col("p_partkey").alias("item_id"))
    return lifecycle.delete_edges(sets, gone).select("user_id", "outfit_key", F.size("item_ids").cast("bigint").alias("members"))


@query("erase_users", "SNK-6",
       sql="""SELECT 'customers' AS tbl, count(*) AS n FROM customer WHERE c_custkey % 10 <> 3 UNION ALL
         SELECT 'orders', count(*) FROM orders WHERE o_custkey % 10 <> 3 UNION ALL SELECT 'events', count(*) FROM events WHERE user_id % 10 <> 3 OR user_id NOT IN (SELECT c_custkey FROM customer)""")
def _(t):
    users = t.customer.where(col("c_custkey") % 10 == 3).select(col("c_custkey").alias("user_id"))
    left = lifecycle.erase_users({"customers": t.customer.withColumnRenamed("c_custkey", "user_id"),
                                  "orders": t.orders.withColumnRenamed("o_custkey", "user_id"), "events": t.events}, users)
    out = None
    for name, df in left.items():
        n = df.groupBy(F.lit(name).alias("tbl")).agg(F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@query("import_missing", "SNK-8",
       sql="""SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'kept' ELSE 'imported' END AS user_id FROM supplier""")
def _(t):
    target = t.supplier.where(col("s_suppkey") % 2 == 0).select(col("s_suppkey").alias("id"), col("s_name").alias("name"), F.lit("kept").alias("user_id"))
    source = t.supplier.select(col("s_suppkey").alias("id"), col("s_name").alias("name"), col("s_acctbal").alias("retired"))
    return lifecycle.import_missing(target, source, ["id"], F.lit("imported"))


@query("manifest_diff", "SNK-9",
       sql="""SELECT user_id, path, action FROM (SELECT o_custkey AS user_id, o_orderkey::VARCHAR AS path,
         CASE WHEN o_orderkey % 5 = 0 THEN 'delete' WHEN o_orderkey % 5 = 1 OR o_orderkey % 5 = 2 THEN 'upload' END AS action FROM orders) WHERE action IS NOT NULL""")
def _(t):
    f = t.orders.select(col("o_custkey").alias("user_id"), col("o_orderkey").cast("string").alias("path"), "o_orderkey",
                        col("o_totalprice").alias("size"), F.unix_timestamp(col("o_orderdate").cast("timestamp")).alias("mtime"))
    k = col("o_orderkey") % 5
    local = f.where(k != 0).withColumn("mtime", F.when(k == 2, col("mtime") + 1).otherwise(col("mtime")))
    return lifecycle.manifest_diff(local.drop("o_orderkey"), f.where(k != 1).drop("o_orderkey"))


@query("stale_suggestions", "JN-13", "SET-1",
       sql=BOTH + """SELECT c.item_id FROM candidate_items c WHERE part % 3 = 0 AND part % 2 = 0 AND c.part NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)""")
def _(t):
    c = t.candidates()
    items = c.select("user_id", "item_id", F.lit("suggestion").alias("status"), F.concat(
        F.when(col("part") % 3 == 0, "wardrobe_").otherwise("eval_"), F.when(col("part") % 2 == 0, "old").otherwise("now")).alias("suggestion_for"))
    current = c.select("user_id", F.lit("now").alias("closet_key")).distinct()
    hot = t.lineitem.where(col("l_quantity") == 50).select(col("l_partkey").alias("part")).distinct()
    used = c.join(hot, "part").select("user_id", "item_id")
    ref = lifecycle.referenced_items(used.withColumnRenamed("item_id", "candidate_item_id"), used)
    return lifecycle.stale_suggestions(items, current, ref, "wardrobe_").select("item_id")


@query("stale_verdicts", "VAL-18",
       sql="""SELECT o_orderkey, o_orderkey % 3 AS formula, o_orderstatus AS original_decision FROM orders WHERE o_orderkey % 3 <> 2""")
def _(t):
    ev = t.orders.select("o_orderkey", (col("o_orderkey") % 3).alias("formula_version"), col("o_orderstatus").alias("decision"))
    return lifecycle.refresh_needed(ev).select("o_orderkey", col("formula_version").alias("formula"), col("decision").alias("original_decision"))


@query("recomputed_verdicts", "VAL-18",
       sql=o.with_(VERDICT) + """SELECT item_id, 'OLD' AS original_decision, v.decision, v.score, TRUE AS recomputed_on_read
         FROM verdicts v JOIN candidate_items c USING (item_id) WHERE c.part % 3 <> 2""")
def _(t):
    """Saved verdicts of older formulas judged again by their stored counts and the closets of today."""
    saved = t.evaluation().results.withColumns({"formula_version": (col("part") % 3).cast("int"), "decision": F.lit("OLD")})
    bars = price_bar(closet_facts(t.kinded_closet())).select("user_id", "price_bar", "price_bar_source")
    return lifecycle.recompute(saved, bars).select("item_id", "original_decision", "decision", "score", "recomputed_on_read")


@query("pairing_pools", "SET-7", "FLT-2",
       sql=BOTH + """SELECT c.item_id AS pool_id, count(*) FILTER (i.gender = 'unisex' OR c.gender = 'unisex' OR i.gender = c.gender) + 1 AS wearable
         FROM candidate_items c JOIN closet_items i ON i.user_id = c.user_id GROUP BY c.item_id""")
def _(t):
    c = t.candidates().select("user_id", col("item_id").alias("pool_id"), "gender", F.lit(True).alias("match_gender_presentation"))
    p = looks.with_pools(c, looks.pool_counts(t.closet()))
    return p.select("pool_id", (sum(col(f"pool_{k}") for k in fixed.CATEGORIES) + 1).alias("wearable"))


# ------------------------------------------------------------------ set scores
def _order_sets(t):
    """The distinct parts of an order as a set."""
    ids = F.sort_array(F.collect_set(col("l_partkey")))
    return t.lineitem.groupBy(col("l_orderkey").alias("outfit_key")).agg(ids.alias("ids")).withColumn("user_id", F.lit(0))


@query("set_scores", "VEC-8", "VEC-9", "JN-6", "UDF-1",
       sql=o.with_(o.PARTS, o.VECTORS) + f""", m AS (SELECT l_orderkey AS k, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS r
           FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)),
         x AS (SELECT k, r, v FROM m CROSS JOIN vec_count JOIN vecs ON vec_id = p % n),
         c AS (SELECT a.k, avg(list_inner_product(a.v, b.v)) AS c FROM x a JOIN x b ON a.k = b.k AND a.r < b.r GROUP BY a.k)
         SELECT d.k AS outfit_key, {o.rnd(f"CASE WHEN d.k % 10 = 0 THEN 0.25 WHEN c IS NULL THEN 0.75 ELSE 1 / (1 + exp(-(c - {CENTER}) / 0.05)) END", 6)} AS score
         FROM (SELECT DISTINCT k FROM m) d LEFT JOIN c ON c.k = d.k""")
def _(t):
    sets = _order_sets(t)
    cache = sets.where(col("outfit_key") % 10 == 0).select("user_id", "outfit_key", F.lit("m1").alias("model"), F.lit(0.25).alias("score"))

    def score(missing):
        rows = missing.select("user_id", "outfit_key", F.explode("ids").alias("p"))
        v = looks.sets_with_vectors(t.refs(rows, ref="p"), ["user_id", "outfit_key"], t.referable(), t.lineitem.count())
        return v.select("user_id", "outfit_key", looks.score_sets(v, col("vecs"), center=CENTER).alias("score"))

    known, _new = looks.cached_scores(sets, cache, "m1", score)
    return known.select("outfit_key", exact_round(col("score"), 6).alias("score"))


@query("score_cache", "JN-6", "SNK-1",
       sql="""WITH k AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)
         SELECT 1 AS run, count(*) AS sets, count(*) FILTER (k % 10 > 0) AS scored FROM k UNION ALL SELECT 2, count(*), 0 FROM k""")
def _(t):
    """Two runs over the same sets with a written cache: the first scores and appends what is missing, the second nothing."""
    sets, counts = _order_sets(t), None
    first = sets.where(col("outfit_key") % 10 == 0).select("user_id", "outfit_key", F.lit("m1").alias("model"), F.lit(0.25).alias("score"))
    cache = _written(t, first, ["user_id", "outfit_key"])

    def score(missing):
        rows = missing.select("user_id", "outfit_key", F.explode("ids").alias("p"))
        v = looks.sets_with_vectors(t.refs(rows, ref="p"), ["user_id", "outfit_key"], t.referable(), t.lineitem.count())
        return v.select("user_id", "outfit_key", looks.score_sets(v, col("vecs"), center=CENTER).alias("score"))
    for run in (1, 2):
        known, fresh = looks.scored_with_cache(sets, cache, "m1", score)
        each = [d.select(F.lit(run).alias("run"), F.lit(a).alias("sets"), F.lit(b).alias("scored")) for d, a, b in ((known, 1, 0), (fresh, 0, 1))]
        n = each[0].unionByName(each[1])
        counts = n if counts is None else counts.unionByName(n)
    return counts.groupBy("run").agg(F.sum("sets").alias("sets"), F.sum("scored").alias("scored"))


@F.pandas_udf(DoubleType())
def _weakest(vectors: pd.Series) -> pd.Series:
    """Smallest cosine of any two vectors of a set (unit vectors); 1 for fewer than two."""
    def least(v):
        if len(v) < 2:
            return 1.0
        m = np.stack(v).astype(float)
        return float((m @ m.T)[np.triu_indices(len(m), 1)].min())
    return vectors.map(least)


@query("plugged_scores", "VEC-9", "UDF-1",
       sql=o.with_(o.PARTS, o.VECTORS) + f""", m AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS p FROM lineitem),
         x AS (SELECT k, p, v FROM m CROSS JOIN vec_count JOIN vecs ON vec_id = p % n),
         c AS (SELECT a.k, min(list_inner_product(a.v, b.v)) AS c FROM x a JOIN x b ON a.k = b.k AND a.p < b.p GROUP BY a.k)
         SELECT d.k AS outfit_key, {o.rnd('coalesce(c, 1)', 6)} AS score FROM (SELECT DISTINCT k FROM m) d LEFT JOIN c ON c.k = d.k""")
def _(t):
    """A scorer from outside, registered by name."""
    looks.register_scorer("weakest_pair", _weakest)
    rows = _order_sets(t).select("outfit_key", F.explode("ids").alias("p"))
    v = looks.sets_with_vectors(t.refs(rows, ref="p"), ["outfit_key"], t.referable(), t.lineitem.count())
    return v.select("outfit_key", exact_round(looks.score_sets(v, col("vecs"), "weakest_pair"), 6).alias("score"))


@query("calibration", "CMB-7", "CMB-8",
       sql=f"""SELECT l_orderkey, l_linenumber, n, {o.rnd('least(1.0, greatest(0.0, CASE WHEN raw <= t THEN 0.5 * raw / t ELSE 0.5 + 0.5 * (raw - t) / (1 - t) END))', 9)} AS calibrated,
         {o.rnd('CASE WHEN raw <= 0.5 THEN raw / 0.5 * t ELSE t + (raw - 0.5) / 0.5 * (1 - t) END', 9)} AS cut FROM (
         SELECT l_orderkey, l_linenumber, l_linenumber % 4 + 1 AS n, (l_quantity / 50)::DOUBLE AS raw,
           CASE l_linenumber % 4 + 1 WHEN 1 THEN 0.5 WHEN 2 THEN 0.15 WHEN 3 THEN 0.35 ELSE 0.6 END::DOUBLE AS t FROM lineitem)""")
def _(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", (col("l_linenumber") % 4 + 1).alias("n"), (col("l_quantity") / 50).alias("raw"))
    d = d.withColumns({"c": looks.calibrate(col("raw"), col("n")), "k": looks.raw_cutoff(col("raw"), col("n"))})
    return d.select("l_orderkey", "l_linenumber", "n", exact_round(col("c"), 9).alias("calibrated"), exact_round(col("k"), 9).alias("cut"))


_PAIRS = o.with_(o.CLOSET, o.VECTORS) + """, px AS MATERIALIZED (SELECT item_id, user_id, category, image_key % n AS ik, text_key % n AS tk FROM closet_items, vec_count),
  rows AS MATERIALIZED (SELECT a.item_id AS a, b.item_id AS b, a.ik AS ia, b.ik AS ib, a.tk AS ta, b.tk AS tb FROM px a JOIN px b USING (user_id, category) WHERE a.item_id < b.item_id),
  sims AS MATERIALIZED (SELECT a, b, round(list_inner_product(x.v, y.v), 12) AS i, round(0.7::DOUBLE * round(list_inner_product(x.v, y.v), 12) + 0.3::DOUBLE * round(list_inner_product(z.v, w.v), 12), 12) AS s
    FROM rows LEFT JOIN vecs x ON x.vec_id = ia LEFT JOIN vecs y ON y.vec_id = ib LEFT JOIN vecs z ON z.vec_id = ta LEFT JOIN vecs w ON w.vec_id = tb)
"""


def _pairs(t):
    return similarity.pair_statistics(t.refs(t.closet(), image="image_key", text="text_key"), vectors=t.referable())


@query("pair_quantiles", "VEC-10",
       sql=_PAIRS + f"""SELECT kind, count(*) AS pairs, {o.rnd('quantile_cont(round(v, 5), 0.5)', 4)} AS p50, {o.rnd('quantile_cont(round(v, 5), 0.9)', 4)} AS p90,
         {o.rnd('quantile_cont(round(v, 5), 0.97)', 4)} AS p97, {o.rnd('max(round(v, 5))', 4)} AS top FROM (SELECT 'image' AS kind, i AS v FROM sims UNION ALL SELECT 'blend', s FROM sims) GROUP BY kind""")
def _(t):
    qs = similarity.pair_quantiles(_pairs(t))
    return qs.select("kind", "pairs", *[exact_round(F.get("quantiles", i), 4).alias(n) for i, n in enumerate(("p50", "p90", "p97", "top"))])


@query("closest_pairs", "VEC-10",
       sql=_PAIRS + f"SELECT a, b, {o.rnd('s', 6)} AS similarity FROM sims ORDER BY s DESC, i DESC, a, b LIMIT 15")
def _(t):
    return similarity.closest_pairs(_pairs(t)).select("a", "b", exact_round(col("similarity"), 6).alias("similarity"))


@query("nearest_pool_item", "VEC-11",
       sql=o.with_(o.CLOSET, o.VECTORS) + f""", pool AS (SELECT DISTINCT p.category, image_key % n AS k, min(part) OVER (PARTITION BY category, image_key % n) AS part FROM parts p, vec_count WHERE part % 2 = 1),
         own AS (SELECT category, image_key % n AS k, arg_min(item_id, struct_pack(c := created_at, i := item_id)) AS item_id FROM closet_items, vec_count WHERE part % 2 = 0 GROUP BY ALL),
         prs AS MATERIALIZED (SELECT category, part, item_id, pool.k AS a, own.k AS b FROM pool JOIN own USING (category)),
         sc AS (SELECT category, part, item_id, round(list_inner_product(x.v, y.v), 12) AS s FROM prs LEFT JOIN vecs x ON x.vec_id = a LEFT JOIN vecs y ON y.vec_id = b)
         SELECT category, {o.rnd('max(s)', 6)} AS similarity FROM sc GROUP BY category""")
def _(t):
    pool = t.refs(t.parts().where(col("part") % 2 == 1).withColumns(
        {"item_id": F.concat(F.lit("p"), "part"), "created_at": F.lit("2000-01-01").cast("timestamp")}), image="image_key")
    own = t.refs(t.closet().where(col("part") % 2 == 0), image="image_key")
    best = similarity.closest_to_any(pool, own, vectors=t.referable())
    return best.select("category", exact_round(col("similarity"), 6).alias("similarity"))


@query("zero_shot_labels", "VEC-6", "VEC-7",
       sql=f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), l AS (SELECT label, min(vec_id) AS id FROM embeddings GROUP BY label),
         p AS (SELECT l.label, e.v FROM l JOIN e ON e.vec_id = l.id), s AS (SELECT e.vec_id, p.label, round(list_inner_product(e.v, p.v), 12) AS s FROM e, p),
         m AS (SELECT vec_id, max(s) AS top FROM s GROUP BY vec_id)
         SELECT vec_id, arg_max(s.label, struct_pack(s := s, l := -s.label))::VARCHAR AS label, {o.rnd('1 / sum(exp(100 * (s - top)))', 6)} AS probability FROM s JOIN m USING (vec_id) GROUP BY vec_id""")
def _(t):
    e = t.embeddings.select("vec_id", col("embedding").alias("vector"), "label")
    first = e.groupBy("label").agg(F.min_by("vector", "vec_id").alias("vector")).select(
        col("label").cast("string").alias("label"), col("label").alias("ord"), "vector")
    z = similarity.zero_shot(e.drop("label"), first, item_id="vec_id")
    return z.select("vec_id", "label", exact_round(col("probability"), 6).alias("probability"))


_LEAST = fixed.ACCESSORY_MIN_PROB


@query("zero_shot_items", "VEC-7",
       sql=f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), l AS (SELECT label, min(vec_id) AS id FROM embeddings GROUP BY label),
         p AS (SELECT l.label, label % 3 = 0 AS acc, e.v FROM l JOIN e ON e.vec_id = l.id),
         s AS (SELECT e.vec_id, p.label, acc, round(list_inner_product(e.v, p.v), 12) AS s FROM e, p),
         t AS (SELECT vec_id, arg_max(struct_pack(l := label, a := acc), struct_pack(s := s, l := -label)) AS best, max(s) AS top,
             arg_max(label, struct_pack(s := s, l := -label)) FILTER (NOT acc) AS other FROM s GROUP BY vec_id),
         m AS (SELECT vec_id, any_value(best) AS best, any_value(other) AS other, 1 / sum(exp(100 * (s - top))) AS p FROM s JOIN t USING (vec_id) GROUP BY vec_id),
         f AS (SELECT vec_id, best.a AND p >= {_LEAST} AS accessory, CASE WHEN best.a AND p >= {_LEAST} THEN best.l ELSE other END AS label FROM m),
         g AS (SELECT e.vec_id, round(list_inner_product(e.v, a.v), 12) AS m, round(list_inner_product(e.v, b.v), 12) AS w FROM e
           JOIN e a ON a.vec_id = 0 JOIN e b ON b.vec_id = 1)
         SELECT vec_id, label::VARCHAR AS label, accessory, CASE WHEN accessory THEN NULL WHEN label % 5 = 1 THEN 'womens'
           WHEN abs(m - w) < {fixed.GENDER_TIE} THEN 'unisex' WHEN m > w THEN 'mens' ELSE 'womens' END AS gender FROM f JOIN g USING (vec_id)""")
def _(t):
    """Labels divisible by three stand for accessories, every fifth for dresses; two vectors for the gender prompts."""
    e = t.embeddings.select("vec_id", col("embedding").alias("vector"), "label")
    first = e.groupBy("label").agg(F.min_by("vector", "vec_id").alias("vector")).select(
        col("label").cast("string").alias("label"), col("label").alias("ord"), "vector", (col("label") % 3 == 0).alias("accessory"),
        F.when(col("label") % 5 == 1, "dress").otherwise("top").alias("category"))
    prompt = lambda i: e.where(col("vec_id") == i).select("vector").scalar()
    z = similarity.zero_shot_items(e.drop("label").withColumns({"_m": prompt(0), "_w": prompt(1)}), first, col("_m"), col("_w"), item_id="vec_id")
    return z.select("vec_id", "label", "accessory", "gender")


# ------------------------------------------------------------------ colours
_F = "CASE WHEN {x} > 0.008856 THEN cbrt({x}) ELSE 7.787 * {x} + 16.0 / 116.0 END"


def _lin(c: str) -> str:
    return f"(CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END)"


_XYZ = [f"(({r[0]}::DOUBLE * lr + {r[1]}::DOUBLE * lg + {r[2]}::DOUBLE * lb) / {w}::DOUBLE)" for r, w in zip(fixed.RGB_TO_XYZ, fixed.XYZ_WHITE)]


@query("lab_colors", "VEC-12",
       sql=f"""SELECT l_orderkey, l_linenumber, {o.rnd('116 * fy - 16', 4)} AS l, {o.rnd('500 * (fx - fy)', 4)} AS a, {o.rnd('200 * (fy - fz)', 4)} AS b FROM (
         SELECT *, {_F.format(x=_XYZ[0])} AS fx, {_F.format(x=_XYZ[1])} AS fy, {_F.format(x=_XYZ[2])} AS fz FROM (
         SELECT l_orderkey, l_linenumber, {_lin('(l_partkey % 256)')} AS lr, {_lin('(l_suppkey * 7 % 256)')} AS lg, {_lin('(l_quantity * 5)')} AS lb FROM lineitem))""")
def _(t):
    c = colors.rgb_to_lab(col("l_partkey") % 256, col("l_suppkey") * 7 % 256, col("l_quantity") * 5)
    d = t.lineitem.withColumn("c", c)
    return d.select("l_orderkey", "l_linenumber", *[exact_round(col(f"c.{k}"), 4).alias(k) for k in ("l", "a", "b")])


_LAB = o.values("lab", "nm, l, a, b", [(k, *map(float, v)) for k, v in fixed.NAMED_LAB.items()])


@query("named_colors", "VEC-19",
       sql=PARTS + ", " + _LAB + f""", h AS (SELECT part, nm, l, a, b, row_number() OVER (PARTITION BY part ORDER BY length(nm) DESC) AS r
           FROM parts JOIN lab ON regexp_matches(label, '\\b' || nm || '\\b')) SELECT part, l::DOUBLE AS l, a::DOUBLE AS a, b::DOUBLE AS b FROM h WHERE r = 1""")
def _(t):
    p = t.parts().withColumn("c", colors.named_lab(col("label"))).where(col("c").isNotNull())
    return p.select("part", "c.l", "c.a", "c.b")


@query("color_agreement", "VEC-13",
       sql=PARTS + ", " + _LAB + f""", c AS (SELECT l_orderkey AS k, p.primary_color AS nm, sum(l_quantity) AS w FROM lineitem JOIN parts p ON part = l_partkey GROUP BY ALL),
         t AS (SELECT k, sum(w) AS tw, min(nm) AS render FROM c GROUP BY k),
         d AS (SELECT c.k, c.w / tw AS share, c.nm, w, sqrt(pow((x.l - y.l) * 0.5, 2) + pow(x.a - y.a, 2) + pow(x.b - y.b, 2)) AS d
           FROM c JOIN t USING (k) JOIN lab x ON x.nm = c.nm JOIN lab y ON y.nm = t.render)
         SELECT k, {o.rnd('least(arg_max(d, struct_pack(w := share, n := nm)), min(d) FILTER (share >= 0.25))', 2)} AS distance,
           least(arg_max(d, struct_pack(w := share, n := nm)), min(d) FILTER (share >= 0.25)) <= 15 AS passed FROM d GROUP BY k""")
def _(t):
    c = t.lineitem.join(t.parts(), col("l_partkey") == col("part")).groupBy(col("l_orderkey").alias("k"), "primary_color").agg(F.sum("l_quantity").alias("w"))
    tot = c.groupBy("k").agg(F.sum("w").alias("tw"), F.min("primary_color").alias("render"))
    clusters = c.join(tot, "k").select("k", colors.named_lab(col("primary_color")).alias("lab"), F.struct(
        (col("w") / col("tw")).alias("w"), "primary_color").alias("rank"), (col("w") / col("tw")).alias("weight"))
    main = clusters.groupBy("k").agg(F.max_by("lab", "rank").alias("m"))
    # equal weights: the main cluster is the later name, as in the check
    clusters = clusters.join(main, "k").withColumn("weight", F.when(col("lab") == col("m"), col("weight") + 1e-9).otherwise(col("weight")))
    renders = tot.select("k", colors.named_lab(col("render")).alias("render_lab"))
    return colors.color_agreement(clusters.select("k", "lab", "weight"), renders, ["k"])


# ------------------------------------------------------------------ curation
_SETS = o.with_(o.PARTS) + f""", m AS (SELECT l_orderkey AS set_id, part AS item_id, category, label AS title FROM lineitem JOIN parts ON part = l_partkey),
  prof AS (SELECT set_id, count(*) FILTER (category = 'top') AS t, count(*) FILTER (category = 'bottom') AS b, count(*) FILTER (category = 'dress') AS d,
    count(*) FILTER (category = 'outerwear') AS w, count(*) FILTER (category = 'shoes') AS s FROM m GROUP BY set_id),
  cls AS (SELECT set_id, CASE WHEN s = 1 AND w <= 1 AND t = 1 AND b = 1 AND d = 0 THEN 'separates' WHEN s = 1 AND w <= 1 AND d = 1 AND t = 0 AND b = 0 THEN 'dress' END AS set_class FROM prof)
"""


def _members(t):
    return t.lineitem.join(t.parts(), col("l_partkey") == col("part")).select(
        col("l_orderkey").alias("set_id"), col("part").alias("item_id"), "category", col("label").alias("title"))


def _classes(t):
    return curation.classify_sets(curation.set_profile(_members(t), fixed.CATEGORIES))


@query("set_classes", "CUR-1", "CUR-2", sql=_SETS + "SELECT set_id, set_class FROM cls")
def _(t):
    return _classes(t).select("set_id", "set_class")


@query("class_quota", "CUR-5", "WIN-8", "JN-17",
       sql=_SETS + """SELECT set_class, set_id FROM (SELECT *, row_number() OVER (PARTITION BY set_class ORDER BY md5(set_id || '|11'), set_id) AS r FROM cls
         WHERE set_class IS NOT NULL AND set_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')) WHERE r <= CASE set_class WHEN 'separates' THEN 8 ELSE 4 END""")
def _(t):
    used = t.orders.where(col("o_orderstatus") == "P").select(col("o_orderkey").alias("set_id"))
    free = _classes(t).where(col("set_class").isNotNull()).join(used, "set_id", "left_anti")
    return curation.quota_per_class(free, ["set_class"], {"separates": 8, "dress": 4}, 11, "set_id").select("set_class", "set_id")


def _held_out() -> str:
    picks = []
    for i, slot in enumerate(fixed.CATEGORIES):
        taken = "".join(f" AND set_id NOT IN (SELECT set_id FROM pick{j})" for j in range(i))
        picks.append(f"pick{i} AS MATERIALIZED (SELECT category, set_id, item_id FROM good WHERE category = '{slot}'{taken} ORDER BY md5(set_id || '|11'), set_id LIMIT 1)")
    return ",\n".join(picks) + "\n" + " UNION ALL ".join(f"SELECT * FROM pick{i}" for i in range(len(fixed.CATEGORIES)))


@query("held_out_candidates", "CUR-3",
       sql=o.with_(o.PARTS) + f""", mem AS (SELECT l_orderkey AS set_id, part AS item_id, category, label || CASE part % 11 WHEN 3 THEN ' for men' ELSE ' piece' END AS title
           FROM lineitem JOIN parts ON l_partkey = part WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')),
         good AS (SELECT * FROM (SELECT set_id, category, min(item_id) AS item_id, arg_min(title, item_id) AS title FROM mem
             WHERE set_id NOT IN (SELECT set_id FROM mem WHERE regexp_matches(title, {o.q(fixed.MENS_MARK)})) GROUP BY ALL)
           WHERE len(regexp_split_to_array(trim(title), '\\s+')) >= 3), {_held_out()}""")
def _(t):
    used = t.orders.where(col("o_orderstatus") == "P").select(col("o_orderkey").alias("set_id"))
    mens = F.when(col("item_id") % 11 == 3, " for men").otherwise(" piece")
    members = _members(t).withColumn("title", F.concat("title", mens))
    return curation.held_out(members, used, fixed.CATEGORIES, 11)


@query("sample_pool", "CUR-4", sql="SELECT l_orderkey, l_linenumber FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) ORDER BY md5(l_orderkey || '_' || l_linenumber || '|12'), l_orderkey || '_' || l_linenumber LIMIT 1200")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber").distinct().withColumn("id", F.concat_ws("_", "l_orderkey", "l_linenumber"))
    return curation.sample_pool(rows, 1200, 12, "id").select("l_orderkey", "l_linenumber")


def _drawn(slot: str) -> str:
    return f"""SELECT i AS set_no, part FROM (SELECT unnest(range(200)) AS i) JOIN (SELECT count(*) AS n FROM parts WHERE category = '{slot}') ON true
      JOIN (SELECT part, row_number() OVER (ORDER BY md5(part || '|5'), part) - 1 AS place FROM parts WHERE category = '{slot}')
        ON place = CAST('0x' || substr(md5(i || '|{slot}|6'), 1, 8) AS BIGINT) % n"""


@query("negative_sets", "CUR-6",
       sql=PARTS + f"""SELECT a.set_no, a.part AS top, b.part AS bottom, c.part AS shoes FROM ({_drawn('top')}) a
         JOIN ({_drawn('bottom')}) b USING (set_no) JOIN ({_drawn('shoes')}) c USING (set_no)""")
def _(t):
    pools = t.parts().select("category", col("part").alias("item_id"))
    return curation.negative_sets(pools, 200, ("top", "bottom", "shoes"), 5)


@query("title_attributes", "TXT-14",
       sql=PARTS + f"""SELECT part, CASE {' '.join(f"WHEN category = '{c}' THEN {o.rules('d', r)}" for c, r in fixed.TITLE_TYPES.items())} END AS kind,
         {o.rules('d', [(chr(92) + 'b' + c + chr(92) + 'b', 'grey' if c == 'gray' else c) for c in fixed.TITLE_COLORS])} AS color, {o.rules('d', fixed.TITLE_PATTERNS)} AS pattern
         FROM (SELECT *, lower(description || ' ' || primary_color) AS d FROM parts)""")
def _(t):
    p = curation.title_attributes(t.parts().withColumn("title", F.concat_ws(" ", "description", "primary_color")))
    return p.select("part", col("t_type").alias("kind"), col("t_color").alias("color"), col("t_pattern").alias("pattern"))


@query("seed_rows", "CUR-7",
       sql=PARTS + f"SELECT 'seed_' || part AS seed_id, {o.case('category', fixed.SEED_PRICES)}::DOUBLE AS price FROM parts WHERE part % 4 <> 0")
def _(t):
    p = t.parts().withColumn("item_id", col("part"))
    known = p.where(col("part") % 4 == 0).select(F.concat(F.lit("seed_"), "part").alias("seed_id"))
    return curation.seed_rows(p, known).select("seed_id", col("seed_price").alias("price"))


# ------------------------------------------------------------------ statistics
_LABELS = "WITH s AS (SELECT quality, toxic, lang, n_chars::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"


def _labelled(t):
    return t.labels.join(t.documents, "doc_id").select("quality", "toxic", "lang", col("n_chars").cast("double").alias("score"))


@query("label_auc", "STA-1",
       sql=_LABELS + f"""SELECT count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality <> 1) AS negatives, (SELECT {o.rnd('avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END)', 9)}
         FROM s p, s n WHERE p.quality = 1 AND n.quality <> 1) AS auc FROM s WHERE quality IS NOT NULL""")
def _(t):
    a = statistics.auc(_labelled(t), "quality", "score")
    return a.select("positives", "negatives", exact_round(col("auc"), 9).alias("auc"))


@query("pass_rates", "STA-2",
       sql=_LABELS + f"""SELECT quality, threshold, count(*) AS n, {o.rnd('avg(score / 5000)', 6)} AS mean, {o.rnd('avg(CASE WHEN score / 5000 >= threshold THEN 1.0 ELSE 0 END)', 6)} AS pass_rate
         FROM s, (SELECT unnest([0.3, 0.5, 0.7, 0.8, 0.9, 0.95]::DOUBLE[]) AS threshold) GROUP BY ALL""")
def _(t):
    r = statistics.pass_rates(_labelled(t).withColumn("score", col("score") / 5000), ["quality"], "score", (0.3, 0.5, 0.7, 0.8, 0.9, 0.95))
    return r.select("quality", "threshold", "n", exact_round(col("mean"), 6).alias("mean"), exact_round(col("pass_rate"), 6).alias("pass_rate"))


@query("best_threshold", "STA-3",
       sql=_LABELS + f""", c AS (SELECT x, (avg(CASE WHEN score / 5000 >= x THEN 1.0 ELSE 0 END) FILTER (quality = 1) + avg(CASE WHEN score / 5000 < x THEN 1.0 ELSE 0 END) FILTER (quality <> 1)) / 2 AS acc
         FROM s, (SELECT unnest(range(1, 100)) / 100.0::DOUBLE AS x) GROUP BY x) SELECT x AS threshold, {o.rnd('acc', 6)} AS balanced_accuracy FROM c ORDER BY acc DESC, x LIMIT 1""")
def _(t):
    b = statistics.best_threshold(_labelled(t).withColumn("score", col("score") / 5000), "quality", "score")
    return b.select("threshold", exact_round(col("balanced_accuracy"), 6).alias("balanced_accuracy"))


@query("group_quantiles", "STA-4",
       sql=f"""SELECT lang, 0.1::DOUBLE AS p, {o.rnd('quantile_cont(n_chars::DOUBLE, 0.1)', 4)} AS value FROM documents GROUP BY lang UNION ALL
         SELECT lang, 0.5::DOUBLE, {o.rnd('quantile_cont(n_chars::DOUBLE, 0.5)', 4)} FROM documents GROUP BY lang UNION ALL
         SELECT lang, 0.9::DOUBLE, {o.rnd('quantile_cont(n_chars::DOUBLE, 0.9)', 4)} FROM documents GROUP BY lang""")
def _(t):
    qs = statistics.quantiles(t.documents.withColumn("score", col("n_chars").cast("double")), ["lang"], "score", (0.1, 0.5, 0.9))
    return qs.select("lang", "p", exact_round(col("value"), 4).alias("value"))


# ------------------------------------------------------------------ time rules
def _events(t):
    return t.events.select(col("user_id").alias("key"), col("ts").cast("timestamp").alias("ts"), (col("event_type") != "error").alias("ok"),
                           col("event_id").alias("id"))


_DAY = 24 * 3600 * 1_000_000


def _stepwise(out: str, state: str, start: str, step: str, ok: str = "event_type <> 'error'") -> str:
    """A rule as a recursion along each key's events: `out` and `state` of an event from the state `r` before it.

    `start` gives state columns before the first event, `step` (out, state...) of an event `e` from `r`.
    """
    return f"""WITH RECURSIVE e AS (SELECT event_id AS id, user_id AS key, epoch_us(ts::TIMESTAMP) AS us, {ok} AS ok,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
      r AS (SELECT key, NULL::BIGINT AS id, 0::BIGINT AS n, {out}, {start} FROM (SELECT DISTINCT key FROM e)
        UNION ALL SELECT e.key, e.id, e.n, {step} FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)
      SELECT id, {state} FROM r WHERE n > 0"""


_RECENT = f"list_filter(r.kept, lambda t: t > e.us - {_DAY})"


_LIMIT = _stepwise("NULL::BOOLEAN AS accepted", "accepted", "[]::BIGINT[] AS kept", f"""
        len({_RECENT}) < 3, CASE WHEN len({_RECENT}) < 3 THEN list_append({_RECENT}, e.us) ELSE {_RECENT} END""")


@query("sliding_limit", "STR-1", sql=_LIMIT)
def _(t):
    return batch.apply_rule(_events(t), rules.SlidingLimit(3, 24 * 3600)).select("id", "accepted")


_LOCKS = _stepwise("NULL::VARCHAR AS outcome", "outcome", "0::BIGINT AS fails, 0::BIGINT AS until", f"""
        CASE WHEN r.until > e.us THEN 'locked' WHEN e.ok THEN 'ok' WHEN r.fails + 1 >= 5 THEN 'locked' ELSE 'invalid' END,
        CASE WHEN r.until > e.us THEN r.fails WHEN e.ok OR r.fails + 1 >= 5 THEN 0 ELSE r.fails + 1 END,
        CASE WHEN r.until > e.us THEN r.until WHEN e.ok THEN 0 WHEN r.fails + 1 >= 5 THEN e.us + {_DAY} ELSE r.until END""",
                                          "event_type = 'purchase'")


@query("lockouts", "STR-3", sql=_LOCKS)
def _(t):
    e = t.events.select(col("user_id").alias("key"), col("ts").cast("timestamp").alias("ts"), (col("event_type") == "purchase").alias("ok"),
                        col("event_id").alias("id"))
    return batch.apply_rule(e, rules.Lockout(5, 24 * 3600)).select("id", "outcome")


_FRESH = f"coalesce(e.us - r.at < {_DAY}, false)"


_FETCHES = _stepwise("NULL::BOOLEAN AS fetched", "fetched", "NULL::BIGINT AS at", f"""
        NOT {_FRESH}, CASE WHEN NOT {_FRESH} AND e.ok THEN e.us ELSE r.at END""")


@query("fetch_cache", "STR-5", sql=_FETCHES)
def _(t):
    return batch.apply_rule(_events(t), rules.FetchCache(24 * 3600)).select("id", "fetched")


_RETRIES = _stepwise("NULL::BOOLEAN AS started", "started", "NULL::BIGINT AS at", f"""
        NOT {_FRESH}, CASE WHEN {_FRESH} THEN r.at WHEN e.ok THEN NULL ELSE e.us END""")


@query("retry_gate", "STR-7", sql=_RETRIES)
def _(t):
    return batch.apply_rule(_events(t), rules.RetryGate(24 * 3600)).select("id", "started")


# the same events as a stream: four slices of time, some events of the first half only with the last slice
_HELD, _STREAM_PENDING = 97, 12 * 3600
_ARRIVED = f"""b AS (SELECT epoch_us(min(ts)::TIMESTAMP) AS lo, epoch_us(max(ts)::TIMESTAMP) AS hi FROM events),
s AS (SELECT e.*, epoch_us(ts::TIMESTAMP) AS us, (epoch_us(ts::TIMESTAMP) - lo) * 4 // (hi - lo + 1) AS quarter FROM events e, b),
arrived AS (SELECT *, CASE WHEN event_id % {_HELD} = 0 AND quarter < 2 THEN 3 ELSE quarter END AS slice FROM s),
mark AS (SELECT (max(us) // 1000 - 600000) * 1000 AS mark FROM arrived WHERE slice < 3),
kept AS (SELECT arrived.* FROM arrived, mark WHERE slice < 3 OR us > mark)"""
_STREAMED = {"sliding_limit": ("accepted", _LIMIT), "lockout": ("outcome", _LOCKS), "fetch_cache": ("fetched", _FETCHES), "retry_gate": ("started", _RETRIES)}


def _replayed(t):
    """Events and the outcomes of all rules, from one replay of the stream."""
    def make():
        at = F.unix_micros(col("ts").cast("timestamp"))
        lo, hi = t.events.agg(F.min(at), F.max(at)).first()
        quarter = F.floor((at - lo) * 4 / (hi - lo + 1)) if lo is not None else F.lit(0)
        e = t.events.select(col("user_id").alias("key"), col("ts").cast("timestamp").alias("ts"), col("event_id").alias("id"),
                            (col("event_type") != "error").alias("fine"), (col("event_type") == "purchase").alias("bought"),
                            (col("event_type") != "view").alias("done"),
                            F.when((col("event_id") % _HELD == 0) & (quarter < 2), 3).otherwise(quarter).alias("slice"))
        day = 24 * 3600
        by_name = {"sliding_limit": rules.SlidingLimit(3, day), "lockout": rules.Lockout(5, day), "fetch_cache": rules.FetchCache(day),
                   "retry_gate": rules.RetryGate(day), "pending": stateful.PendingTimeout(_STREAM_PENDING)}
        flags = dict.fromkeys(by_name, "fine") | {"lockout": "bought", "pending": "done"}
        folder = f"{shared_folder(t.spark)}/replay-{uuid.uuid4().hex[:12]}"
        slices = [e.where(col("slice") == n).drop("slice") for n in range(4)]
        return e, stateful.replay(slices, folder, by_name, flags)
    return t._once("replay", make)


@query("streamed_rules", "STR-1", "STR-3", "STR-5", "STR-7",
       sql=f"WITH {_ARRIVED} " + " UNION ALL ".join(
           f"SELECT '{rule}' AS rule, id, {column}::VARCHAR AS outcome FROM ({sql.replace('FROM events', 'FROM kept')})"
           for rule, (column, sql) in _STREAMED.items()))
def _(t):
    return _replayed(t)[1].where("rule <> 'pending'").select("rule", "id", "outcome")


@query("streamed_timeouts", "STR-6",
       sql=f"""WITH {_ARRIVED}, n AS (SELECT *, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS next FROM kept)
         SELECT event_id AS id, user_id, us + {_STREAM_PENDING * 1_000_000} AS failed_at FROM n
         WHERE event_type = 'view' AND coalesce(next > us + {_STREAM_PENDING * 1_000_000}, true)""")
def _(t):
    """Pending turns that a timer failed, without an event."""
    return _replayed(t)[1].where("rule = 'pending'").select("id", col("key").alias("user_id"), F.unix_micros("ts").alias("failed_at"))


@query("late_events", "STR-1",
       sql=f"WITH {_ARRIVED} SELECT event_id AS id, user_id FROM arrived, mark WHERE slice = 3 AND us <= mark")
def _(t):
    """Events that the watermark had passed when they came."""
    events, outcomes = _replayed(t)
    return stateful.late_rows(events, outcomes, "sliding_limit").select("id", col("key").alias("user_id"))


@query("recent_events", "STR-2",
       sql="SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0)")
def _(t):
    e = _events(t)
    last = e.agg(F.max("ts")).scalar()
    gone = t.customer.where(col("c_custkey") % 5 == 0).select(col("c_custkey").alias("key"))
    return batch.clear_keys(batch.retained(e, last), gone).select(col("id").alias("event_id"))


@query("debounced_changes", "STR-4",
       sql="""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
         s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
         SELECT user_id, epoch(max(ts))::BIGINT + 21600 AS run_at, count(*) AS changes FROM s GROUP BY user_id, n""".replace("epoch(max(ts))::BIGINT", "floor(epoch(max(ts)))::BIGINT"))
def _(t):
    d = batch.debounced(_events(t), seconds=6 * 3600)
    return d.select(col("key").alias("user_id"), F.unix_timestamp("run_at").alias("run_at"), "changes")


@query("stale_pending", "STR-6",
       sql="SELECT event_id, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '2024-01-15' - INTERVAL 600 SECOND THEN 'failed' WHEN event_type = 'view' THEN 'pending' ELSE event_type END AS status FROM events")
def _(t):
    from capsule.operators.filters import stale_pending
    status = F.when(col("event_type") == "view", "pending").otherwise(col("event_type"))
    now = F.lit("2024-01-15").cast("timestamp")
    at = F.date_trunc("second", col("ts").cast("timestamp"))
    return t.events.select("event_id", stale_pending(status, at, now).alias("status"))


@query("link_expiry", "STR-8",
       sql="SELECT event_id, (floor(epoch(ts) / 21600)::BIGINT + 2) * 21600 AS expires FROM events")
def _(t):
    return t.events.select("event_id", batch.link_expiry(col("ts").cast("timestamp")).alias("expires"))


@query("index_membership", "STR-9",
       sql="""SELECT user_id, count(*) AS members FROM (SELECT user_id, event_id % 40 AS item_id, arg_max(event_type = 'error', struct_pack(t := ts, o := event_type = 'error')) AS gone
         FROM events GROUP BY ALL) WHERE NOT gone GROUP BY user_id""")
def _(t):
    """Changes in three deliveries through the stream, the second one with changes that are older than the first's."""
    at = F.unix_micros(col("ts").cast("timestamp"))
    c = t.events.select("user_id", (col("event_id") % 40).alias("item_id"), F.when(col("event_type") == "error", "remove").otherwise("add").alias("op"),
                        col("ts").cast("timestamp").alias("ts"), F.array(col("value")).alias("vector"))
    folder = f"{shared_folder(t.spark)}/index-{uuid.uuid4().hex[:12]}"
    index = stream.index_table(t.spark, f"{folder}/table").create()
    middle = c.agg(F.percentile(at, 0.5)).scalar()
    early = at < middle
    held = F.pmod(F.xxhash64("user_id", "item_id", "ts"), F.lit(5)) == 0
    for part in (early & ~held, early & held, ~early):
        c.where(part).write.mode("append").parquet(f"{folder}/changes")
        run = stream.keep_index(t.spark.readStream.schema(c.schema).parquet(f"{folder}/changes"), index, f"{folder}/checkpoint")
        run.awaitTermination()
    return stream.members(index.read()).groupBy("user_id").agg(F.count("*").alias("members"))


@query("stale_closets", "STR-10",
       sql=CLOSET + "SELECT DISTINCT user_id FROM closet_items WHERE user_id IN (SELECT user_id FROM events) AND user_id % 2 = 0")
def _(t):
    from capsule.operators.profile import content_key
    c = t.closet()
    saved = content_key(c).withColumn("closet_key", F.when(col("user_id") % 2 == 0, "outdated").otherwise(col("closet_key")))
    return stream.stale_users(c, saved, t.events.select("user_id")).select("user_id")
