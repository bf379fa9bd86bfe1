"""Debouncing and closet maintenance on Structured Streaming (`stateful` has the time rules)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsule.operators.profile import content_key
from capsule.sources.written import WrittenTable
from capsule.streaming import batch

col = F.col
LATENESS = "10 minutes"


def debounced(changes: DataFrame, key: str = "key", ts: str = "ts", **kw) -> DataFrame:
    return batch.debounced(changes.withWatermark(ts, LATENESS), key, ts, **kw)


INDEX = "user_id long, item_id long, gone boolean, changed timestamp, vector array<double>"


def index_table(spark: SparkSession, path: str) -> WrittenTable:
    """The closet vector table: members, and removed ones with the time of their removal."""
    schema = spark.createDataFrame([], INDEX).schema
    return WrittenTable(spark, path, schema, ["user_id"])


def keep_index(changes: DataFrame, index: WrittenTable, checkpoint: str):
    """Keep the index in step with a change stream (user_id, item_id, op, ts, vector).

    A trigger rewrites the buckets of its users only, under the batch's number: a batch that is repeated after a failure
    changes nothing. An older change that comes in a later batch does not win over a newer one, nor over a removal.
    """
    def fold(frame: DataFrame, number: int) -> None:
        index.change(frame, lambda rows: fold_changes(rows, frame), f"batch-{number:09d}")

    return (changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def fold_changes(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Index rows after a batch of changes: the last change of each item, by time and then `remove` over `add`."""
    new = changes.select("user_id", "item_id", (col("op") == "remove").alias("gone"), col("ts").cast("timestamp").alias("changed"), "vector")
    last = F.max_by(F.struct("gone", "changed", "vector"), F.struct("changed", "gone"))
    return table.unionByName(new).groupBy("user_id", "item_id").agg(last.alias("c")).select("user_id", "item_id", "c.*")


def members(index: DataFrame) -> DataFrame:
    return index.where(~col("gone")).select("user_id", "item_id", "vector")


def stale_users(closet: DataFrame, saved: DataFrame, changed: DataFrame) -> DataFrame:
    """Changed users whose closet key is no longer the saved one, with their new key."""
    mine = closet.join(changed.select("user_id").distinct(), "user_id", "left_semi")
    now = content_key(mine)
    return now.join(saved.select("user_id", col("closet_key").alias("saved_key")), "user_id", "left").where(
        ~col("closet_key").eqNullSafe(col("saved_key"))).drop("saved_key")


__all__ = ["debounced", "fold_changes", "index_table", "keep_index", "members", "stale_users"]
