"""Written tables: whole changes, repeated and failed writes, buckets read; the index kept by a stream."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from capsule.operators import lifecycle, looks
from capsule.sources.written import WrittenTable
from capsule.streaming import stream


def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def files_read(df):
    """Files that the scan of an executed plan opened."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value()


def content(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def table(spark):
    first = spark.createDataFrame([(i, i * 10) for i in range(40)] + [(None, -1)], "k long, v long")
    t = WrittenTable(spark, folder(), first.schema, ["k"], 8).create()
    assert t.read().count() == 0
    t.change(first, lambda kept: first)
    return t


def test_only_touched_buckets_are_read_and_written(spark, table):
    before = content(table.read())
    rows = spark.createDataFrame([(3, 99), (41, 7)], "k long, v long")
    kept = []

    def fold(old):
        kept.append(files_read(old))
        return lifecycle.upsert(old, rows.withColumn("at", F.lit(1)), ["k"], "at")
    written = table.change(rows, fold)
    touched = {r[0] for r in rows.select(table.bucket()).collect()}
    assert written == len(touched) <= 2
    # partition pruning: one file a bucket was written, and only those of touched buckets are opened
    assert kept == [len(touched)] and files_read(table.read()) == 8
    assert content(table.read()) == sorted([r for r in before if r[0] != 3] + [(3, 99), (41, 7)], key=str)


def test_a_failed_write_is_not_seen(spark, table):
    before = content(table.read())
    rows = spark.createDataFrame([(i, 0) for i in range(40)], "k long, v long")

    def broken(old):
        return old.withColumn("v", F.when(F.col("k") == 17, F.raise_error(F.lit("lost")).cast("long")).otherwise(0))
    with pytest.raises(PySparkException):
        table.change(rows, broken, "second")
    assert content(table.read()) == before
    # a write that got as far as its rows, but not to its commit, is not seen either and may be done again
    commit, table._commit = table._commit, lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        table.change(rows, lambda old: old.withColumn("v", F.lit(1).cast("long")), "second")
    assert content(table.read()) == before
    table._commit = commit
    assert table.change(rows, lambda old: old.withColumn("v", F.lit(2).cast("long")), "second") > 0
    after = content(table.read())
    assert {v for k, v in after if k is not None} == {2}
    assert table.change(rows, lambda old: old.limit(0), "second") == 0 and content(table.read()) == after


def test_the_second_run_scores_nothing(spark):
    sets = spark.createDataFrame([(1, f"s{i}") for i in range(20)] + [(1, "s3")], "user_id int, outfit_key string")
    start = spark.createDataFrame([(1, f"s{i}", "m", 0.5) for i in range(5)] + [(1, "s7", "other", 0.9)],
                                  "user_id int, outfit_key string, model string, score double")
    cache = WrittenTable(spark, folder(), start.schema, ["user_id", "outfit_key"], 4).create()
    cache.change(start, lambda kept: start)
    asked = []

    def score(missing):
        asked.append(missing.count())
        return missing.withColumn("score", F.lit(0.25))
    for want in (15, 0):
        known, fresh = looks.scored_with_cache(sets, cache, "m", score)
        assert (known.count(), fresh.count()) == (20, want)
    assert asked == [15, 0] and cache.read().count() == 21


def test_index_follows_the_stream(spark):
    rng, at = random.Random(8), dt.datetime(2024, 1, 1)
    changes = [(rng.randrange(6), rng.randrange(5), rng.choice(["add", "add", "remove"]), at + dt.timedelta(seconds=rng.randrange(60)), [float(i)])
               for i in range(200)]
    schema = "user_id long, item_id long, op string, ts timestamp, vector array<double>"
    where = folder()
    index = stream.index_table(spark, f"{where}/table").create()
    last = {}
    for n in range(0, 200, 50):
        part = spark.createDataFrame(changes[n:n + 50], schema)
        part.write.mode("append").parquet(f"{where}/changes")
        stream.keep_index(spark.readStream.schema(schema).parquet(f"{where}/changes"), index, f"{where}/checkpoint").awaitTermination()
    for user, item, op, ts, vector in changes:
        last[user, item] = max(last.get((user, item), (ts, False)), (ts, op == "remove"))
    want = {k for k, (_, gone) in last.items() if not gone}
    assert {(r.user_id, r.item_id) for r in stream.members(index.read()).collect()} == want
    before = content(index.read())
    # a batch that comes again after a failure
    assert index.change(part, lambda rows: stream.fold_changes(rows, part.withColumn("op", F.lit("remove"))), "batch-000000003") == 0
    assert content(index.read()) == before
