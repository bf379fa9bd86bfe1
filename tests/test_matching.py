"""Point-in-time joins and best detected items against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from capsule.operators import asof, listings


@pytest.mark.parametrize("width", [1, 7, 3600, 10 ** 9])
def test_as_of_is_the_plain_loop(spark, width):
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)

    def times(n):
        return [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(30)]), i) for i in range(n)]
    facts, moments = times(200), times(150)
    when = lambda s: None if s is None else start + dt.timedelta(seconds=s)
    f = spark.createDataFrame([(k, when(s), i, i * 2) for k, s, i in facts], "key string, when timestamp, id int, at int")
    m = spark.createDataFrame([(k, when(s), i) for k, s, i in moments], "key string, at timestamp, id int")
    got = {r.id: r.fact and (r.fact.id, r.fact["at"]) for r in asof.as_of(m, f, ["key"], "at", "when", "id", width).collect()}
    for k, s, i in moments:
        before = [(x, j) for key, x, j in facts if key == k and x is not None and s is not None and x <= s]
        last = max(before, default=None)
        assert got[i] == (last and (last[1], 2 * last[1]))
    assert len(got) == len(moments)
    assert asof.as_of(m, f.limit(0), ["key"], "at", "when", "id").where("fact is not null").count() == 0
    assert asof.as_of(m.limit(0), f, ["key"], "at", "when", "id").count() == 0


def test_best_detected_takes_the_earliest_of_equals(spark):
    box = [0, 0, 500, 500]
    found = spark.createDataFrame(
        [(1, 2, "top", "t-shirt", box), (1, 1, "top", "t-shirt", box), (1, 3, "bottom", "jeans", box), (2, 1, "shoes", "boots", [0, 0, 1000, 1000]),
         (2, 2, "shoes", "boots", None), (None, 1, "top", "t-shirt", box)],
        "photo int, position int, category string, subcategory string, bbox array<int>")
    listed = spark.createDataFrame([(1, "x", "White T-Shirt", None), (1, "y", None, "blue jeans"), (2, "x", "", ""), (3, "x", "boots", None), (None, "x", "t-shirt", None)],
                                   "photo int, shop string, l_title string, l_type string")
    got = {(r.photo, r.shop): (r.position, r.fit) for r in listings.best_detected(found, listed, ["shop"], ["position"]).collect()}
    assert got == {(1, "x"): (1, 16), (1, "y"): (3, 16), (2, "x"): (1, 4), (3, "x"): (None, None), (None, "x"): (None, None)}
    assert listings.best_detected(found.limit(0), listed, ["shop"], ["position"]).where(F.col("position").isNull()).count() == 5
