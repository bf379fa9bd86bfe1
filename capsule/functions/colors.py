"""LAB colours: conversion, distance, named colours, agreement of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capsule import fixed
from capsule.functions.numbers import exact_round
from capsule.functions.words import any_of

col = F.col


def rgb_to_lab(r: Column, g: Column, b: Column) -> Column:
    """Struct(l, a, b) of an sRGB colour with channels 0-255."""
    linear = [F.when(c / 255.0 <= 0.04045, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4)))
              for c in (r, g, b)]
    xyz = [sum((w * c for w, c in zip(row[1:], linear[1:])), row[0] * linear[0]) / white
           for row, white in zip(fixed.RGB_TO_XYZ, fixed.XYZ_WHITE)]
    fx, fy, fz = (F.when(v > 0.008856, F.cbrt(v)).otherwise(7.787 * v + 16.0 / 116.0) for v in xyz)
    return F.struct((116 * fy - 16).alias("l"), (500 * (fx - fy)).alias("a"), (200 * (fy - fz)).alias("b"))


def lab_distance(p: Column, q: Column) -> Column:
    """Distance with lightness at half weight."""
    d = [(p[k] - q[k]) * w for k, w in (("l", 0.5), ("a", 1.0), ("b", 1.0))]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def named_lab(name: Column) -> Column:
    """LAB of a colour name: the whole name when listed, else the longest listed name that stands in it."""
    s = F.lower(F.trim(name))
    ranked = sorted(fixed.NAMED_LAB, key=len, reverse=True)
    exact, inside = None, None
    for k in ranked:
        v = F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(fixed.NAMED_LAB[k], ("l", "a", "b"))])
        whole, part = s == k, s.rlike(rf"\b{any_of([k])}\b")
        exact = F.when(whole, v) if exact is None else exact.when(whole, v)
        inside = F.when(part, v) if inside is None else inside.when(part, v)
    return F.coalesce(exact, inside)


def color_agreement(clusters: DataFrame, renders: DataFrame, keys: list[str]) -> DataFrame:
    """Whether a picture's dominant colour fits the original's clusters.

    `clusters` (keys, lab, weight) of the original, `renders` (keys, render_lab). The heaviest cluster always
    counts, the others from a quarter of the area on.
    """
    heaviest = clusters.groupBy(*keys).agg(F.max_by("lab", "weight").alias("main"))
    j = clusters.join(renders, keys)
    other = j.groupBy(*keys).agg(F.min(F.when(col("weight") >= fixed.COLOR_MIN_WEIGHT,
                                              lab_distance(col("lab"), col("render_lab")))).alias("alt"))
    best = heaviest.join(renders, keys).join(other, keys).withColumn(
        "d", F.least(lab_distance(col("main"), col("render_lab")), col("alt")))
    return best.select(*keys, exact_round(col("d"), 2).alias("distance"),
                       (col("d") <= fixed.COLOR_MAX_DISTANCE).alias("passed"))
