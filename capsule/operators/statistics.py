"""Score statistics over labelled rows: AUC, pass rates, thresholds, quantiles, without all-pairs or global sorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsule.functions.rules import literal_array

col = F.col
SLICES = 64


def value_runs(rows: DataFrame, by: Sequence[str], value: str, weights: dict[str, Column]) -> DataFrame:
    """Distinct values per group with the weight totals of the value itself and of all smaller values.

    Values are counted first. Their order is cut into slices at approximate quantiles; sums run inside a slice
    and over the few slice totals, so no task sorts a whole group.
    """
    by = list(by)
    runs = rows.where(col(value).isNotNull()).groupBy(*by, value).agg(*[F.sum(w).alias(n) for n, w in weights.items()])
    steps = literal_array([i / SLICES for i in range(1, SLICES)])
    cuts = runs.groupBy(*by).agg(F.percentile_approx(col(value), steps, F.lit(1000)).alias("_cuts"))
    placed = (runs.join(cuts, by) if by else runs.withColumn("_cuts", cuts.scalar())).withColumn(
        "_slice", F.size(F.filter(col("_cuts"), lambda c: c < col(value))))
    totals = placed.groupBy(*by, "_slice").agg(*[F.sum(n).alias(f"_t_{n}") for n in weights])
    over = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "_slice", *[F.coalesce(F.sum(f"_t_{n}").over(over), F.lit(0)).alias(f"_s_{n}")
                                            for n in weights])
    inside = Window.partitionBy(*by, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(starts, [*by, "_slice"]).select(
        *by, value, *weights,
        *[(col(f"_s_{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"{n}_before") for n in weights])


def auc(rows: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Chance that a positive scores above a negative, ties counting half."""
    runs = value_runs(rows.where(col(label).isNotNull()), by, score, {
        "pos": F.when(col(label) == 1, 1).otherwise(0), "neg": F.when(col(label) == 1, 0).otherwise(1)})
    won = F.sum(col("pos") * (col("neg_before") + 0.5 * col("neg")))
    return runs.groupBy(*by).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
                                 (won / (F.sum("pos").cast("double") * F.sum("neg"))).alias("auc"))


def pass_rates(rows: DataFrame, by: Sequence[str], score: str, thresholds: Sequence[float]) -> DataFrame:
    """Share of rows at or above each threshold, all in one pass."""
    rates = [F.avg((col(score) >= t).cast("double")).alias(f"_{i}") for i, t in enumerate(thresholds)]
    wide = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), *rates)
    each = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), col(f"_{i}").alias("pass_rate"))
                               for i, t in enumerate(thresholds)])).alias("e")
    return wide.select(*by, "n", "mean", each).select(*by, "n", "mean", "e.threshold", "e.pass_rate")


def best_threshold(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Cut among 0.01..0.99 with the best mean of both classes' hit rates, the lowest one among equals."""
    cuts = [i / 100 for i in range(1, 100)]
    wide = rows.agg(*[((F.avg(F.when(col(label) == 1, (col(score) >= t).cast("double")))
                        + F.avg(F.when(col(label) != 1, (col(score) < t).cast("double")))) / 2).alias(f"_{i}")
                      for i, t in enumerate(cuts)])
    best = F.array_max(F.array(*[F.struct(col(f"_{i}").alias("accuracy"), F.lit(-t).alias("t"))
                                 for i, t in enumerate(cuts)]))
    return wide.select((-best["t"]).alias("threshold"), best["accuracy"].alias("balanced_accuracy"))


def quantiles(rows: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """Exact quantiles per group, linear between neighbours: one row per group and probability."""
    runs = value_runs(rows, by, value, {"n": F.lit(1)})
    total = runs.groupBy(*by).agg(F.sum("n").alias("total"))
    asked = total.select(*by, "total", F.explode(literal_array([float(p) for p in probabilities])).alias("p"))
    at = asked.withColumn("h", col("p") * (col("total") - 1))
    ends = at.select(*by, "p", "h", F.explode(F.array(F.floor("h"), F.ceil("h"))).alias("k")).distinct()
    hit = ends.join(runs, list(by)).where((col("n_before") <= col("k")) & (col("k") < col("n_before") + col("n")))
    lo = F.max(F.when(col("k") == F.floor("h"), col(value)))
    hi = F.max(F.when(col("k") == F.ceil("h"), col(value)))
    return (hit.groupBy(*by, "p", "h").agg(lo.alias("lo"), hi.alias("hi"))
            .select(*by, "p", (col("lo") + (col("h") - F.floor("h")) * (col("hi") - col("lo"))).alias("value")))
