"""Large tables are dealt over as many partitions as they have rows for."""

import tempfile
from collections import Counter

from pyspark.sql import functions as F

from capsule.catalog import QUERIES, Tables
from capsule.operators import lifecycle


def test_appended_rows_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(lifecycle, "PARTITION_ROWS", 10, raising=False)
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    rows = [(i // 3, i % 3) for i in range(150)] * 2 + [(None, 1), (7, None), (None, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int").write.parquet(f"{folder}/lineitem.parquet")
    got = QUERIES["append_rows"].run(Tables(spark, folder))
    assert got.rdd.getNumPartitions() == 31
    ids = spark.createDataFrame(rows, "a long, b int").distinct().select(lifecycle.natural_id("it_", F.col("a"), F.col("b")).alias("id"))
    expected = Counter(r.id for r in ids.collect())
    assert {r.id: r.n for r in got.collect()} == expected and len(expected) == 153
