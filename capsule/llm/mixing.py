"""Mixing sources to target weights by weighted fair queueing.

Every document of a source waits in a queue in shuffled (hashed) order. Its virtual finish time is the number of its
source's words up to and including it, divided by the source's target. Serving all queues by finish time and stopping
at the total budget gives each source its share, up to one document. A source whose target exceeds its size is queued
again: pass e of a document finishes at (e * source size + words so far) / target.

Running totals never meet in one task: a source is split into hash buckets whose totals are summed first, and the
place where the budget ends is found from a histogram of finish times before the documents of one narrow range are
sorted. Only the table of sources passes through single tasks (one row for each source that a weight is given to).

Defined cases. Null text: size 0, nothing is taken. Null source: a source of its own, last in order. Equal finish times:
served by source, pass, hash, doc_id. Repeated rows: each is a document of its own; equal rows are interchangeable.
Empty table: empty result. Columns of the input stay; input columns named like an added one are
replaced by it (`mixture` keeps them).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from capsule.llm.common import n_words, small, table
from capsule.sources.staging import stage

#: Hash buckets a source is split into.
BUCKETS = 1024
#: Histogram steps per unit of virtual time; all sources' targets end at time 1.
STEPS = 1 << 16


def targets(sized: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Row per source: place (order of sources, nulls last), source_size, weight, target.

    Weights repeat along the sources in code point order. Targets are in proportion to the weights and sum to all
    sizes, except that none exceeds `most` times its source's size; what is cut off there goes to the others.
    """
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy("limit_ratio", "place")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    place = F.row_number().over(by_name)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    limit = F.col("source_size") * F.lit(float(most))
    t = (sized.groupBy("source").agg(F.sum("size").alias("source_size"))
         .withColumn("place", place)
         .withColumn("weight", F.element_at(cycle, F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1))
         .withColumn("limit_ratio", limit / F.col("weight"))
         .withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum(limit).over(before), F.lit(0.0)))
                     / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
         .withColumn("nth", F.row_number().over(by_limit)))
    free = F.when(F.col("limit_ratio") >= F.col("level"), F.struct("nth", "level"))
    return (t.withColumn("level", F.min(free).over(every)["level"])
            .select("source", "place", "source_size", "weight",
                    F.least(limit, F.col("level") * F.col("weight")).alias("target")))


def finish_times(sized: DataFrame, goal: DataFrame, seed: int = 0) -> DataFrame:
    """`sized` (columns doc_id, source, size and any others) with place, target, source_size, weight, `_key` and `_sum`,
    the source's words up to each document in shuffled order."""
    goal = goal.withColumnRenamed("source", "_source")
    d = (sized.drop("source_size", "weight", "target", "place")
         .join(small(goal), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
         .withColumn("_key", F.xxhash64(F.lit(seed), "doc_id", "size"))
         .withColumn("_bucket", F.pmod("_key", F.lit(BUCKETS))))
    ahead = Window.partitionBy("place").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (d.groupBy("place", "_bucket").agg(F.sum("size").alias("_in"))
               .select("place", "_bucket", F.coalesce(F.sum("_in").over(ahead), F.lit(0)).alias("_ahead")))
    up_to = Window.partitionBy("place", "_bucket").orderBy("_key", "doc_id") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (d.withColumn("_sum", F.sum("size").over(up_to)).join(offsets, ["place", "_bucket"])
            .withColumn("_sum", F.col("_sum") + F.col("_ahead")).drop("_ahead", "_bucket"))


def _tickets(most: float) -> Column:
    """Array of one (finish, place, pass, key, doc_id) for each pass of a document, in order of service."""
    def ticket(e: int) -> Column:
        at = (F.lit(e) * F.col("source_size") + F.col("_sum")) / F.col("target")
        return F.struct(at.alias("finish"), F.col("place"), F.lit(e).alias("pass"), F.col("_key").alias("key"),
                        F.col("doc_id").alias("doc_id"))
    passes = F.array(*[ticket(e) for e in range(int(-(-most // 1)))])
    return F.when((F.col("target") > 0) & (F.col("size") > 0), passes)


def last_ticket(timed: DataFrame, most: float) -> Row | None:
    """The last ticket served within the budget (the sum of all sizes).

    Tickets are summed by steps of finish time; only those of the step in which the budget ends are sorted.
    """
    tickets = timed.select("size", F.explode(_tickets(most)).alias("t")) \
        .withColumn("step", F.least(F.floor(F.col("t.finish") * STEPS), F.lit(2 * STEPS)).cast("long"))
    steps = (tickets.groupBy("step").agg(F.sum("size").alias("words"))
             .withColumn("upto", F.sum("words").over(Window.orderBy("step"))))
    budget = timed.agg(F.sum("size")).first()[0] or 0
    end = steps.where(F.col("upto") > budget).agg(F.min(F.struct("step", F.col("upto") - F.col("words")))).first()[0]
    cut, ahead = end or (2 * STEPS + 1, 0)
    run = Window.partitionBy("step").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = (tickets.where(F.col("step") == cut).withColumn("run", F.sum("size").over(run) + ahead)
              .where(F.col("run") <= budget).agg(F.max("t")).first()[0])
    return within or tickets.where(F.col("step") < cut).agg(F.max("t")).first()[0]


def serve(sized: DataFrame, goal: DataFrame, last: Row | None, most: float, seed: int) -> DataFrame:
    """`sized` with source_size, weight, target, `passes` (finish times of the passes taken) and taken."""
    timed = finish_times(sized, goal, seed)
    tickets = _tickets(most)
    if last is None:
        served = F.lit(None).cast("array<double>")
    else:
        kinds = timed.select(F.element_at(tickets, 1).alias("t")).schema["t"].dataType
        end = F.struct(*[F.lit(last[f.name]).cast(f.dataType).alias(f.name) for f in kinds])
        served = F.transform(F.filter(tickets, lambda t: t <= end), lambda t: t["finish"])
    return (timed.withColumn("passes", F.coalesce(served, F.array().cast("array<double>")))
            .withColumn("taken", F.col("size") * F.size("passes")).drop("_key", "_sum", "place"))


def budget_end(narrow: DataFrame, weights: Sequence[float], most: float, seed: int) -> tuple[DataFrame, Row | None]:
    """Targets of the sources of a written narrow table (doc_id, source, size), and the last ticket served."""
    goal = stage(targets(narrow, weights, most), "targets")
    return goal, last_ticket(finish_times(narrow, goal, seed), most)


def mix(docs: DataFrame, size: Column, weights: Sequence[float] = (1, 2, 3), most: float = 3.0,
        seed: int = 0) -> DataFrame:
    """`docs` (doc_id, source and any others) with the columns of `serve`.

    `size` counts the words of a document. Sizes are written once as a narrow table, from which targets and the end of
    the budget are found; the documents themselves are read once more for the result.
    """
    narrow = stage(docs.select("doc_id", "source", size.cast("long").alias("size")), "sizes")
    goal, last = budget_end(narrow, weights, most, seed)
    return serve(docs.withColumn("size", size.cast("long")), goal, last, most, seed)


def mixture(docs: DataFrame, size: Column, weights: Sequence[float] = (1, 2, 3), most: float = 3.0,
            seed: int = 0) -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as it is taken, range-sorted by virtual finish time."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    mixed = mix(docs.select("doc_id", "source", size.alias("size"), own.alias("_row")), F.col("size"), weights, most, seed)
    return mixed.withColumn("_finish", F.explode("passes")).orderBy("_finish", "doc_id").select("_row.*")


def op2_weighted_mixing(spark: SparkSession, sf_dir: str, weights: Sequence[float] = (1, 2, 3),
                        most: float = 3.0) -> DataFrame:
    """Mix of all documents by words; sources weigh 1, 2, 3, repeating, and are taken three times at most."""
    docs = table(spark, sf_dir, "documents")
    narrow = stage(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    goal, last = budget_end(narrow, weights, most, 0)
    return serve(narrow, goal, last, most, 0).select("doc_id", "size", "source_size", "target", "taken")
