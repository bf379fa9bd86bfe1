"""Point-in-time join: each moment with the last fact at or before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capsule.sources.staging import stage

col = F.col
#: Seconds of one slice of a key's time, and the rows from which on a key is cut into slices.
SLICE_SECONDS = 90 * 24 * 3600
HOT_ROWS = 500_000


def as_of(moments: DataFrame, facts: DataFrame, keys: Sequence[str], at: str, when: str, tie: str,
          slice_seconds: int = SLICE_SECONDS, hot_rows: int | None = None) -> DataFrame:
    """`moments` with `fact`, the row of `facts` last by (`when`, `tie`) among those of its keys not after `at`; null
    without one.

    Both sides stand in one ordered run and the last fact is carried forward: one shuffle. Keys of more than `hot_rows` rows
    are counted first; theirs is cut into slices of time, each sorted by itself, and what a slice ends with is handed on to the
    later ones, one row a slice, so a hot key is spread over as many tasks as it has slices. Nulls: a null key meets the null
    key, a fact without time is never in force, a moment without time has none.
    """
    keys = list(keys)
    carried, asked = ([c for c in df.columns if c not in keys] for df in (facts, moments))
    fact, row = F.struct(*carried), F.struct(*asked)
    f = facts.where(col(when).isNotNull()).select(
        *keys, col(when).alias("_at"), F.lit(0).alias("_kind"), col(tie).alias("_tie"), fact.alias("fact"))
    m = moments.select(
        *keys, col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(facts.schema[tie].dataType).alias("_tie"), row.alias("_row"))
    both = f.unionByName(m, allowMissingColumns=True)
    most = HOT_ROWS if hot_rows is None else hot_rows
    hot = f.select(*keys).unionByName(m.select(*keys)).groupBy(*keys).count().where(col("count") > most).drop("count")
    if hot.isEmpty():
        found = _run(both, keys).where(col("_kind") == 1)
    else:  # fewer than one in `most` rows is such a key
        a, b = both.alias("a"), F.broadcast(stage(hot, "hot")).alias("b")
        same = [col(f"a.{k}").eqNullSafe(col(f"b.{k}")) for k in keys]
        found = _run(a.join(b, same, "left_anti"), keys).where(col("_kind") == 1).unionByName(
            _sliced(a.join(b, same, "left_semi"), keys, slice_seconds))
    held = F.when(col("fact").isNotNull(), F.struct(*[col(c) if c in keys else col(f"fact.{c}") for c in facts.columns]))
    return found.select(*[col(c) if c in keys else col(f"_row.{c}") for c in moments.columns], held.alias("fact"))


def _run(both: DataFrame, by: Sequence[str]) -> DataFrame:
    """The last fact carried forward along each run."""
    within = Window.partitionBy(*by).orderBy("_at", "_kind", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("fact", F.when(col("_at").isNotNull(), F.last("fact", ignorenulls=True).over(within)))


def _sliced(both: DataFrame, keys: Sequence[str], slice_seconds: int) -> DataFrame:
    """The moments of `both` with their facts, each slice of time sorted by itself."""
    both = both.withColumn("_slice", F.floor(F.unix_timestamp("_at") / slice_seconds))
    near = _run(both, [*keys, "_slice"]).where(col("_kind") == 1)
    ends = both.groupBy(*keys, "_slice").agg(F.max_by("fact", F.when(col("_kind") == 0, F.struct("_at", "_tie"))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier)).where(col("_carried").isNotNull()).drop("_end")
    a, b = near.alias("a"), ends.alias("b")
    same = [col(f"a.{k}").eqNullSafe(col(f"b.{k}")) for k in [*keys, "_slice"]]
    fact = F.when(col("a._at").isNotNull(), F.coalesce("a.fact", "b._carried"))
    return a.join(b, same, "left").select(*[col(f"a.{c}") for c in both.columns if c not in ("fact", "_slice")], fact.alias("fact"))
