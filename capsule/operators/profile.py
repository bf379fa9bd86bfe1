"""Closet profiles: counts, colours, types, styles, gaps, content keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsule import fixed
from capsule.functions.numbers import exact_round
from capsule.functions.rules import filled, literal_array
from capsule.functions.words import blank

col = F.col


def most_common(items: DataFrame, keys: Sequence[str], value: Column, k: int, name: str) -> DataFrame:
    """The k most frequent values per key, joined by ', '; among equals the one seen first in closet order."""
    counted = (items.select(*keys, value.alias("_v"), "created_at", "item_id").where(col("_v").isNotNull())
               .groupBy(*keys, "_v").agg(F.count("*").alias("_n"),
                                         F.min(F.struct("created_at", "item_id")).alias("_first")))
    w = Window.partitionBy(*keys).orderBy(col("_n").desc(), "_first")
    return (counted.withColumn("_r", F.row_number().over(w)).where(col("_r") <= k).groupBy(*keys)
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "_v"))), lambda e: e["_v"]), ", ")
                 .alias(name)))


def closet_profile(items: DataFrame) -> DataFrame:
    """Per user and category: items, the four most common colours and the three most common types."""
    items = items.withColumn("category", F.coalesce(filled(col("category")), F.lit("other")))
    keys = ["user_id", "category"]
    size = items.groupBy(*keys).agg(F.count("*").alias("items"))
    color = F.lower(F.coalesce(filled(col("primary_color")), F.lit("unknown")))
    kind = F.lower(F.coalesce(filled(col("subcategory")), col("category")))
    return (size.join(most_common(items, keys, color, 4, "colors"), keys)
            .join(most_common(items, keys, kind, 3, "types"), keys))


def profile_text(profile: DataFrame) -> DataFrame:
    """One line per user: 'bottom: 3 (jeans, chinos; colors navy, black); ...' in category order."""
    line = F.concat(col("category"), F.lit(": "), col("items").cast("string"), F.lit(" ("), col("types"),
                    F.lit("; colors "), col("colors"), F.lit(")"))
    return profile.groupBy("user_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("category", line.alias("l")))),
                                 lambda e: e["l"]), "; ").alias("summary"))


def dominant_gender(items: DataFrame) -> DataFrame:
    """'mens' or 'womens' when the closet has items of one and none of the other."""
    g = F.coalesce(filled(col("gender")), F.lit("unisex"))
    n = items.groupBy("user_id").agg(F.count(F.when(g == "mens", 1)).alias("mens"),
                                     F.count(F.when(g == "womens", 1)).alias("womens"),
                                     F.count(F.when(g == "unisex", 1)).alias("unisex"))
    return n.withColumn("closet_gender", F.when((col("mens") > 0) & (col("womens") == 0), "mens")
                        .when((col("womens") > 0) & (col("mens") == 0), "womens").otherwise("unisex"))


def style_tags(items: DataFrame, k: int = 6) -> DataFrame:
    """The most frequent style tags of a closet; among equals the one met first."""
    tags = items.select("user_id", "created_at", "item_id", F.posexplode("style_tags").alias("pos", "tag"))
    ordered = tags.withColumn("item_id", F.concat_ws("#", "item_id", F.lpad(col("pos").cast("string"), 4, "0")))
    return most_common(ordered, ["user_id"], F.lower("tag"), k, "styles")


def mean_formality(items: DataFrame) -> DataFrame:
    return (items.groupBy("user_id").agg(F.avg(col("formality").cast("double")).alias("_f"))
            .select("user_id", exact_round(col("_f"), 1).alias("mean_formality")))


def missing_categories(owned: Column, gender: Column) -> Column:
    """Wanted categories a closet lacks; no dress for mens."""
    wanted = literal_array(fixed.WANTED_CATEGORIES)
    return F.array_except(F.when(gender == "mens", F.array_remove(wanted, "dress")).otherwise(wanted), owned)


def category_counts(items: DataFrame, category: Column) -> DataFrame:
    """Chip counts per user and category with the grand total as 'all'."""
    return (items.withColumn("_c", category).rollup("user_id", "_c").agg(F.count("*").alias("n"))
            .where(col("user_id").isNotNull())
            .select("user_id", F.coalesce("_c", F.lit("all")).alias("category"), "n"))


def content_key(items: DataFrame, settings: Column | None = None) -> DataFrame:
    """Key of a closet's content: changes when an item, a shown attribute or a setting does; order plays no part.

    Row digests are summed instead of collected, so a closet of any size needs no single large row.
    """
    row = F.md5(F.concat_ws("\u0001", *[blank(col(c).cast("string")) for c in (
        "item_id", "category", "subcategory", "primary_color", "gender")]))
    half = [F.conv(F.substring(row, a, 12), 16, 10).cast("decimal(38,0)") for a in (1, 13)]
    sums = items.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(half[0]).alias("a"), F.sum(half[1]).alias("b"))
    extra = settings if settings is not None else F.lit("")
    return sums.select("user_id", F.substring(F.sha1(F.concat_ws("|", col("user_id").cast("string"),
                                                                 col("n").cast("string"), col("a").cast("string"),
                                                                 col("b").cast("string"), extra)), 1, 16)
                       .alias("closet_key"))


def varied_count(picks: DataFrame, keys: Sequence[str], cap: int = 2) -> DataFrame:
    """Picks that count as variety: at most `cap` per category."""
    return (picks.groupBy(*keys, "category").agg(F.least(F.count("*"), F.lit(cap)).alias("n"))
            .groupBy(*keys).agg(F.sum("n").alias("varied")))


def dependents(items: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of other tables that hang on each item: one count column per table (each has `item_id`)."""
    out = items
    for name, t in tables.items():
        n = t.groupBy("item_id").agg(F.count("*").alias(name))
        out = out.join(n, "item_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out
