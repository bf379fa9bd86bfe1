"""Vectors are held by size: more than 50,000 short ones cross no shuffle, and a closet gets its references from its parts."""

from pyspark.sql import functions as F

from capsule.catalog import Tables
from capsule.catalog.registry import VECTORS
from capsule.operators import cells
from capsule.sources.staging import stage


def many(spark, n):
    return spark.range(n).select(F.col("id").alias("ref"), F.array((F.col("id") % 7).cast("float"), F.lit(1.0).cast("float")).alias("vector"))


def test_many_short_vectors_are_looked_up_behind_the_shuffle(spark, monkeypatch):
    vectors = stage(many(spark, 60_000), "many")
    rows = spark.createDataFrame([("a", 1, 59_999), ("a", 2, 3), ("b", 1, None)], "cell string, id int, ref long")

    def run():
        return cells.run_cells(rows, ["id"], lambda t, s: t.select(["cell", "id", "vec"]).to_batches()[0], "cell string, id int, vec array<float>",
                               vectors=vectors, columns={"vec": "ref"}, expected=3)

    held = run()
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert plan.index("BroadcastHashJoin") < plan.index("hashpartitioning(cell")
    monkeypatch.setattr(cells, "VECTOR_BYTES", 1 << 20)
    moved = run()
    plan = moved._jdf.queryExecution().executedPlan().toString()
    assert plan.index("hashpartitioning(cell") < plan.index("Join")
    found = sorted((r.cell, r.id, r.vec) for r in held.collect())
    assert found == [("a", 1, [2.0, 1.0]), ("a", 2, [3.0, 1.0]), ("b", 1, None)] == sorted((r.cell, r.id, r.vec) for r in moved.collect())


def test_the_size_of_vectors_counts(spark, monkeypatch):
    monkeypatch.setattr(cells, "VECTOR_BYTES", 1000)
    short = spark.createDataFrame([(1, [0.0] * 4), (2, None)], "ref long, vector array<float>")
    assert cells.few(short) and cells.few(short.limit(0))
    assert not cells.few(spark.createDataFrame([(1, [0.0] * 400)], "ref long, vector array<float>"))


def test_references_by_part_are_those_by_item(spark, root):
    t = Tables(spark, root)
    a, b = t.referring_closet(), t.refs(t.kinded_closet(), **VECTORS)
    a, b = (x.select(*sorted(x.columns)) for x in (a, b))
    assert a.count() > 0 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
