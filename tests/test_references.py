"""Items that refer to vectors give what items that carry them give, and shuffle none of them."""

import pytest
from pyspark.sql import functions as F

from capsule.catalog import Tables
from capsule.catalog.registry import CENTER
from capsule.operators import cells, listings, looks, similarity
from capsule.plans.evaluate import evaluate

VEC = {"image": "image_key", "text": "text_key", "style": "style_key"}


@pytest.mark.parametrize("held", [cells.VECTOR_ROWS, 0], ids=["looked up behind the shuffle", "shuffled"])
def test_outfits_and_matches_by_reference(spark, root, held, monkeypatch):
    monkeypatch.setattr(cells, "VECTOR_ROWS", held)
    t = Tables(spark, root)
    users = F.col("user_id") % 20 == 0
    items, cands = t.closet().where(users), t.candidates().where(users)
    plain = evaluate(t.vectors(cands, **VEC), t.vectors(items, **VEC), center=CENTER)
    by_ref = evaluate(t.refs(cands, **VEC), t.refs(items, **VEC), center=CENTER, vectors=t.referable(), block=16)
    for a, b in ((plain.outfits, by_ref.outfits), (plain.similar, by_ref.similar)):
        a, b = (x.select(*[F.to_json(c).alias(c) if c in ("members", "matches") else F.col(c) for c in x.columns]) for x in (a, b))
        assert a.count() > 0 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_no_vector_crosses_the_shuffle(spark, root):
    t = Tables(spark, root)
    hits = similarity.nearest(t.refs(t.candidates(), image="image_key"), t.refs(t.closet(), image="image_key"), 3, vectors=t.referable())
    plan = hits._jdf.queryExecution().executedPlan().toString()
    below = [line for line in plan.split("\n") if "hashpartitioning(cell" in line]
    assert below and "BroadcastHashJoin" in plan
    assert plan.index("BroadcastHashJoin") < plan.index("hashpartitioning(cell")  # looked up above the exchange


def test_sets_with_vectors(spark):
    vectors = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0]), (9, [0.6, 0.8]), (5, None)], "ref long, vector array<float>")
    rows = spark.createDataFrame([("a", None, 7), ("a", None, 9), ("b", 1, 8), ("a", 2, 8), ("a", 2, 5), ("c", 3, 5)], "u string, k int, ref long")
    got = looks.sets_with_vectors(rows, ["u", "k"], vectors, 4).collect()
    found = {(r.u, r.k): sorted(tuple(round(x, 6) for x in v) for v in r.vecs) for r in got}
    assert found == {("a", None): [(0.6, 0.8), (1.0, 0.0)], ("b", 1): [(0.0, 1.0)], ("a", 2): [(0.0, 1.0)], ("c", 3): []} and len(got) == 4


def test_closest_with_repeats_of_one_vector(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0])], "ref long, vector array<float>")
    kind = "item_id string, category string, created_at timestamp_ntz, image long"
    at = __import__("datetime").datetime(2024, 1, 1)
    pool = spark.createDataFrame([("x", "c", at, 1), ("y", "c", at, 1), ("z", "c", at, 2), ("p", "d", at, 3)], kind)
    own = spark.createDataFrame([("x", "c", at, 1), ("q", "c", at, 3), ("p", "d", at, 3), ("r", "d", at, 1)], kind)
    pool, own = (d.withColumn("created_at", F.col("created_at").cast("timestamp")) for d in (pool, own))
    full = [d.join(vectors.withColumnRenamed("ref", "image"), "image").drop("image").withColumnRenamed("vector", "image") for d in (pool, own)]
    a = {tuple(r) for r in similarity.closest_to_any(pool, own, vectors=vectors).collect()}
    assert a == {tuple(r) for r in similarity.closest_to_any(*full).collect()} and ("c", "y", "x", 1.0) in a


def test_hit_words_found_before_the_join(spark):
    hits = spark.createDataFrame([(1, "Navy slim jeans", "bottom", ["womens"], "navy-jeans", "$40", True),
                                  (2, "Gift card", None, None, None, "", None), (3, "Leather belt", "belt", ["mens"], "belt", "20", True)],
                                 "part int, title string, type string, tags array<string>, handle string, price string, available boolean")
    plans = spark.createDataFrame([(1, "bottom", "jeans", "navy", "cotton", "navy jeans"), (2, "top", "t-shirt", None, None, None)],
                                  "plan int, q_category string, q_subcategory string, q_color string, q_material string, query string")
    limits = {"cand_gender": F.lit("womens"), "price_low": F.lit(5.0), "price_high": F.lit(120.0), "avoid_color": F.lit("black")}
    late = listings.hit_relevance(plans.crossJoin(hits).withColumns(limits))
    early = listings.hit_relevance(listings.query_words(plans).crossJoin(listings.hit_words(hits)).withColumns(limits))
    show = ["plan", "part", "reason", "score", "hit_color", "hit_price"]
    a, b = ({tuple(r) for r in d.select(show).collect()} for d in (late, early))
    assert a == b and len(a) == 6
    assert (1, 1, None, 6.0, "navy", 40.0) in a
