"""Short keys of a point-in-time join are one run each, long ones are cut into slices; texts are parsed where they stand once."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from capsule.catalog import QUERIES, Tables
from capsule.operators import asof, footprint


def frames(spark):
    rng = random.Random(9)
    start = dt.datetime(2024, 1, 1)

    def times(n):
        return [(rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([None, *range(25)]), i) for i in range(n)]
    facts, moments = times(180), times(120)
    when = lambda s: None if s is None else start + dt.timedelta(seconds=s)
    f = spark.createDataFrame([(k, when(s), i, None if i % 3 else i) for k, s, i in facts], "key string, when timestamp, id int, n int")
    m = spark.createDataFrame([(k, when(s), i) for k, s, i in moments], "key string, at timestamp, id int")
    return facts, moments, f, m


@pytest.mark.parametrize("hot", [0, 60, 10 ** 6])
def test_hot_keys_are_sliced_with_the_same_facts(spark, hot):
    facts, moments, f, m = frames(spark)
    got = asof.as_of(m, f, ["key"], "at", "when", "id", 5, hot)
    assert got.columns == ["key", "at", "id", "fact"] and got.schema["fact"].dataType.fieldNames() == ["key", "when", "id", "n"]
    found = {r.id: (r.key, r.fact) for r in got.collect()}
    assert len(found) == len(moments)
    for k, s, i in moments:
        last = max(((x, j) for key, x, j in facts if key == k and None not in (x, s) and x <= s), default=None)
        key, fact = found[i]
        assert key == k and (fact and (fact.key, fact.id, fact.n)) == (last and (k, last[1], None if last[1] % 3 else last[1]))


def test_short_keys_are_one_run_without_a_join(spark):
    _, _, f, m = frames(spark)
    plan = asof.as_of(m, f, ["key"], "at", "when", "id")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_items_with_mixes_are_not_joined_by_text(spark):
    rows = [("top", "t-shirt", 1, 5, None, "cotton 60%, polyester 40%", "denim", "a", "b", "c", 10.0), ("top", "t-shirt", 2, None, None, None, "unknown", "wool knit", None, "x", None),
            ("shoes", "boots", 3, 0, 0.9, "", None, None, None, None, -1.0)]
    df = spark.createDataFrame(rows, "category string, garment_type string, id int, n_outfits int, similarity double, material string, fabric_guess string, "
                               "description string, label string, subcategory string, price double").withColumn("redundancy_level", F.lit("none"))
    plain = footprint.footprint(df)
    given = footprint.footprint(spark.createDataFrame(footprint.with_mixes(df).collect(), footprint.with_mixes(df).schema))
    assert "Join" not in given._jdf.queryExecution().executedPlan().toString()
    cols = ["id", "materials", "material_method", "footprint_kg", "water_l", "footprint_score", "material_reason"]
    assert sorted(map(str, plain.select(cols).collect())) == sorted(map(str, given.select(cols).collect()))
    assert given.columns == plain.columns


def test_footprints_as_of_parses_each_part_once(spark, root, monkeypatch):
    seen, real = [], footprint.with_mixes
    monkeypatch.setattr(footprint, "with_mixes", lambda df: seen.append(df.columns) or real(df))
    QUERIES["footprints_as_of"].run(Tables(spark, root))
    assert [c for c in seen if "fact" in c or "moment" in c] == [] and len(seen) == 1
