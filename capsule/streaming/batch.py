"""Time rules over stored events: sorted runs per key, constant state, long keys cut where the state is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from capsule import fixed
from capsule.streaming.rules import Lockout

col = F.col


def segments(events: DataFrame, key: str, ts: str, width: int, fresh: Column | None = None) -> DataFrame:
    """Adds `segment`: runs of a key between which no state survives.

    Events are counted per time bucket first. By default a bucket starts a segment when the one before it is
    empty (a gap longer than `width` seconds). `fresh` instead marks buckets after which the state is the
    starting one; it sees `fails`, `wins` and `calm` (no failure in the bucket before).
    """
    bucket = F.floor(F.unix_micros(ts) / (width * 1_000_000))
    marked = events.withColumn("_bucket", bucket)
    used = marked.groupBy(key, "_bucket").agg(F.count(F.when(~col("ok"), 1)).alias("fails"),
                                              F.count(F.when(col("ok"), 1)).alias("wins"))
    w = Window.partitionBy(key).orderBy("_bucket")
    near = F.lag("_bucket").over(w) == col("_bucket") - 1
    if fresh is None:
        used = used.withColumn("_new", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1))
    else:
        calm = ~F.coalesce(near, F.lit(False)) | (F.lag("fails").over(w) == 0)
        used = used.withColumn("calm", calm).withColumn("_end", F.coalesce(fresh, F.lit(False)).cast("int"))
        used = used.withColumn("_new", F.coalesce(F.lag("_end").over(w), F.lit(1)))
    used = used.withColumn("segment", F.sum("_new").over(w)).select(key, "_bucket", "segment")
    return marked.join(used, [key, "_bucket"]).drop("_bucket")


def apply_rule(events: DataFrame, rule, *, key: str = "key", ts: str = "ts", order: str = "id") -> DataFrame:
    """Run a rule over events (key, ts, ok, order): the events with the rule's output column."""
    if isinstance(rule, Lockout):
        seconds = rule.seconds // 1_000_000
        cut = segments(events, key, ts, seconds, (col("fails") == 0) & (col("wins") > 0) & col("calm"))
    else:
        cut = segments(events, key, ts, rule.idle)
    rows = cut.withColumn("_at", F.unix_micros(ts))
    name, kind = rule.out.split()
    columns = events.columns
    schema = StructType(list(events.schema.fields)).add(name, kind)

    def run(batches):
        at_key, state = None, None
        for pdf in batches:
            out = []
            for k, s, t, ok in zip(pdf[key], pdf["segment"], pdf["_at"], pdf["ok"]):
                if (k, s) != at_key:
                    at_key, state = (k, s), rule.start()
                state, result = rule.step(state, int(t), bool(ok))
                out.append(result)
            yield pdf[columns].assign(**{name: out})

    return (rows.repartition(key, "segment").sortWithinPartitions(key, "segment", "_at", order)
            .mapInPandas(run, schema))


def retained(events: DataFrame, now: Column, ts: str = "ts") -> DataFrame:
    """Events of the last two days."""
    return events.where(F.unix_micros(ts) >= F.unix_micros(now) - fixed.RETENTION_SECONDS * 1_000_000)


def clear_keys(events: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return events.join(keys.select(key).distinct(), key, "left_anti")


def debounced(changes: DataFrame, key: str = "key", ts: str = "ts", seconds: int = fixed.DEBOUNCE_SECONDS) -> DataFrame:
    """One recompute per burst of changes, `seconds` after its last change. Works on batch and streaming frames."""
    return (changes.groupBy(F.session_window(ts, f"{seconds} seconds").alias("w"), key)
            .agg(F.count("*").alias("changes")).select(key, col("w.end").alias("run_at"), "changes"))


def link_expiry(now: Column, bucket: int = fixed.URL_BUCKET_SECONDS) -> Column:
    """Unix second at which a link signed at `now` expires: the end of the next fixed bucket."""
    return (F.floor(F.unix_timestamp(now) / bucket) + 2) * bucket
