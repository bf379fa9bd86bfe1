"""Golden values of the single rules."""

import pytest
from pyspark.sql import functions as F

from capsule.functions import answers, words
from capsule.functions.materials import mix_of
from capsule.functions.numbers import exact_round
from capsule.operators import filters, listings, looks, pricing, value


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


@pytest.mark.parametrize("text, mix", [
    ("95% cotton 5% elastane", {"cotton": 0.95, "polyurethane": 0.05}), ("cotton 95%, elastane 5%", {"cotton": 0.95, "polyurethane": 0.05}),
    ("60% cotton 60% polyester", {"cotton": 0.5, "polyester": 0.5}), ("60% cotton", {"cotton": 0.6, "unknown": 0.4}),
    ("cotton blend", {"cotton": 0.5, "unknown": 0.5}), ("poly-cotton", {"cotton": 0.5, "polyester": 0.5}),
    ("rubber", {"unknown": 1.0}), (None, {"unknown": 1.0})])
def test_material_mix(text, mix):
    assert {m: s for m, s, _ in mix_of(text)[1]} == mix


@pytest.mark.parametrize("kind, price", [("t-shirt", 25), ("polo shirt", 45), ("hoodie", 55), ("denim shorts", 40), ("blazer", 130),
                                         ("puffer jacket", 160), ("sneakers", 90)])
def test_table_price(spark, kind, price):
    assert one(spark, pricing.table_price([F.lit(kind)], F.lit("top"))) == price


def test_rounding_matches_the_binary_value(spark):
    xs = [0.205, 2.675, 1.005, 0.285, 0.125, 0.375, -2.5, 2.5, 45.675, 1e-9]
    got = [r.r for r in spark.createDataFrame([(x,) for x in xs], "x double").select(exact_round(F.col("x"), 2).alias("r")).collect()]
    assert got == [round(x, 2) for x in xs]


def test_calibration_round_trip(spark):
    for n, t in ((2, 0.15), (3, 0.35), (4, 0.6), (6, 0.6)):
        assert one(spark, looks.calibrate(F.lit(t), F.lit(n))) == pytest.approx(0.5)
        for s in (0.1, 0.3, 0.7, 0.9):
            assert one(spark, looks.calibrate(looks.raw_cutoff(F.lit(s), F.lit(n)), F.lit(n))) == pytest.approx(s)


def test_utility_and_levels(spark):
    got = [one(spark, value.utility(F.lit(n).cast("double"))) for n in (0, 3, None, -5, 10000)]
    assert got == [0.5, 1.0, 1.0, 0.5, 2.0]
    levels = [one(spark, value.redundancy_level(F.lit(s).cast("double"), F.lit(0.8), F.lit(0.88)))
              for s in (0.898, 0.88, 0.85, 0.7981, None, float("nan"))]
    assert levels == ["near_duplicate", "near_duplicate", "similar", "none", None, None]


def test_missing_estimate_stays_missing(spark):
    assert one(spark, pricing.clean_estimate(F.lit("-4"))) is None
    assert one(spark, pricing.clean_estimate(F.lit("9000"))) == 5000


def test_accessory_by_head_word(spark):
    for kind, expected in (("tote bag", True), ("baseball cap", True), ("cap-sleeve top", False), ("tie-dye t-shirt", False)):
        assert one(spark, filters.is_accessory(F.lit("top"), F.lit(kind), F.lit(None).cast("string"))) is expected


def test_titles_and_stores(spark):
    t = words.clean_title(F.lit("Wrangler® Blanket Lined Denim Jacket | COLLECTIONS | Wrangler®"), F.lit("Wrangler"), F.lit("Wrangler"))
    assert one(spark, t) == "Blanket Lined Denim Jacket"
    assert one(spark, listings.blocked_domain(F.lit("https://factory.jcrew.com/p"))) == "jcrew.com"
    assert one(spark, listings.blocked_domain(F.lit("https://notjcrew.com/p"))) is None
    assert one(spark, words.earliest_color(F.lit("Sail/Gum Yellow"))) == "cream"


def test_price_bar(spark):
    rows = [(1, 45.0, 45.0), (1, 140.0, 70.0), (1, 210.0, 70.0), (1, 300.0, 100.0)]
    df = spark.createDataFrame(rows, "user_id int, real_price double, wears double").withColumn("estimated_price", F.lit(1.0))
    r = value.price_bar(df).first()
    assert (r.price_bar, r.price_bar_source, r.priced_items) == (2.5, "closet_median", 4)
    mixed = spark.createDataFrame([(1, 45.0, None, 45.0), (1, None, 140.0, 70.0), (1, None, 25.0, 45.0)],
                                  "user_id int, real_price double, estimated_price double, wears double")
    r = value.price_bar(mixed).first()
    assert (r.price_bar, r.price_bar_source, r.priced_items, r.estimated_items) == (1.0, "closet_estimates", 1, 2)


ANSWER = """Voilà [see below] — "quoted, [1]:
```json
[ {"name": "Sage Rib Tank [2, 5]", "price": "$34", "product_url": "https://a.example.com/p", "tags": [{"x": 1}]},
  {"brand": "nameless"}, {"name": "Línen", "price": 19.99,},
]
```
and {not json} { or [this"""


def test_records_of_an_answer():
    found = answers.product_records(ANSWER)
    assert [r.get("name") for r, *_ in found] == ["Sage Rib Tank [2, 5]", None, "Línen"]
    for r, a, b, x, y in found:
        assert ANSWER[a] == "{" and ANSWER[b - 1] == "}" and ANSWER.encode()[x:y].decode() == ANSWER[a:b]
    wrapped = answers.product_records('noise {"note": [1], "products": [{"name": "X"}, 3, {"name": "Y"}]}')
    assert [(r["name"], a) for r, a, *_ in wrapped] == [("X", 33), ("Y", 51)]
    assert [r for r, *_ in answers.product_records('{"name": "solo"}')] == [{"name": "solo"}]
    assert answers.product_records("no json") == answers.product_records("") == answers.product_records("[1, 2] {}") == []
    assert len(answers.product_records("[" * 50_000 + '{"name": "deep"}')) == 1


@pytest.mark.parametrize("text, method, mix", [
    ("100% organic cotton", "percentages", [("organic_cotton", 1.0)]), ("60,5% wool / 39.5% nylon", "percentages", [("wool", 0.605), ("nylon", 0.395)]),
    ("recycled polyester", "keywords", [("recycled_polyester", 1.0)]), ("cotton and linen", "keywords", [("cotton", 0.5), ("linen", 0.5)]),
    ("vegan leather", "keywords", [("polyurethane", 1.0)]), ("wool mix", "blend_assumption", [("wool", 0.5), ("unknown", 0.5)]),
    ("50% moonstone 50% silk", "percentages", [("unknown", 0.5), ("silk", 0.5)]), ("N/A", "fallback", [("unknown", 1.0)]),
    ("cotton poly blend", "keywords", [("cotton", 0.5), ("polyester", 0.5)]), ("0% cotton", "keywords", [("cotton", 1.0)])])
def test_material_methods(text, method, mix):
    got = mix_of(text)
    assert got[0] == method and sorted((m, s) for m, s, _ in got[1]) == sorted(mix)
