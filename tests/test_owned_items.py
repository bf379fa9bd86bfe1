"""Every owned item is judged, against the rest of its closet; bars without an item equal those of the closet that is left."""

import random

import pytest
from pyspark.sql import functions as F

from capsule.catalog import QUERIES, Tables
from capsule.catalog.evaluation import OWNED
from capsule.operators import value
from capsule.plans import evaluate as plan

SCHEMA = "user_id long, item_id string, wears int, real_price double, estimated_price double"
BARS = ["priced_items", "estimated_items", "price_bar", "price_bar_source"]


def closets(seed):
    """Closets of 1 to 9 items, with ties, unknown prices, items without wears and without any price."""
    r = random.Random(seed)
    return [(u, f"i{u}_{k}", r.choice([None, 50, 50, 100]), r.choice([None, 5.0, 10.0, 20.0, 400.0]) if r.random() < share else None,
             r.choice([None, 5.0, 30.0, 30.0, 80.0])) for u, share in enumerate([0.0, 0.2, 0.5, 1.0] * 10) for k in range(1 + u % 9)]


def judged(spark, facts):
    worn = value.worn_value(F.col("real_price"), F.col("estimated_price"), F.col("wears"))
    bars = "0L priced_items, 0L estimated_items, 0D price_bar, '' price_bar_source".split(", ")
    return facts.select("user_id", "item_id", worn.alias("own_value"),
                        F.when(F.col("wears").isNotNull(), F.col("real_price").isNotNull()).alias("own_real"), *[F.expr(b) for b in bars])


@pytest.mark.parametrize("repeat", [False, True])
def test_bars_without_each_item(spark, repeat):
    rows = closets(3)
    if repeat:
        rows += [r for r in rows if r[0] == 17] + [(8, None, 50, 90.0, 1.0)]
    facts = spark.createDataFrame(rows, SCHEMA)
    owned = judged(spark, facts.where("item_id is not null"))
    got = sorted(map(repr, plan.own_bars(owned, facts).select("user_id", "item_id", *BARS).collect()))
    want = sorted(map(repr, plan.repeated_bars(owned, facts).select("user_id", "item_id", *BARS).collect()))
    assert got == want and len(got) >= len(rows) - 1


def test_no_pair_of_a_closets_items_is_formed(spark):
    facts = spark.createDataFrame([(1, f"i1_{k}", 50, 1.0 * k, 1.0) for k in range(300)], SCHEMA)
    text = plan.own_bars(judged(spark, facts), facts)._jdf.queryExecution().optimizedPlan().toString()
    assert "judged" not in text


def test_every_owned_item_is_judged(spark, root):
    t = Tables(spark, root)
    got = QUERIES["owned_verdicts"].run(t).select("item_id")
    every = t.closet().select("item_id")
    assert "QUALIFY" not in OWNED
    assert got.count() == every.count() and got.exceptAll(every).isEmpty()
