"""Curating labelled sets: profiles, classes, samples, candidates, attributes from titles, negative sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsule import fixed
from capsule.functions.rules import first_match, literal_array, lookup
from capsule.functions.words import blank
from capsule.sources.staging import stage

col = F.col


def draw(seed: int, *ids: Column) -> Column:
    """Reproducible pseudo-random order: the same ids and seed always sort the same way, here and elsewhere."""
    return F.md5(F.concat_ws("|", *[i.cast("string") for i in ids], F.lit(str(seed))))


def set_members(sets: DataFrame, items: DataFrame) -> DataFrame:
    """Members of sets whose metadata is known."""
    return sets.join(items, "item_id")


def set_profile(members: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Members per category of each set, with flags for unnamed members and men's marks."""
    named = F.trim(blank(col("title"))) != ""
    return members.groupBy("set_id").agg(
        *[F.count(F.when(col("category") == c, 1)).alias(f"n_{c}") for c in categories],
        F.bool_and(named).alias("all_named"), F.bool_or(blank(col("title")).rlike(fixed.MENS_MARK)).alias("mens"))


def classify_sets(profile: DataFrame) -> DataFrame:
    """'separates' (one top, bottom, shoes) or 'dress' (one dress, shoes) sets with at most one layer."""
    ok = col("all_named") & ~col("mens") & (col("n_shoes") == 1) & (col("n_outerwear") <= 1)
    two = (col("n_top") == 1) & (col("n_bottom") == 1) & (col("n_dress") == 0)
    one = (col("n_dress") == 1) & (col("n_top") == 0) & (col("n_bottom") == 0)
    return profile.withColumn("set_class", F.when(ok & two, "separates").when(ok & one, "dress"))


def quota_per_class(rows: DataFrame, by: Sequence[str], quota: Mapping[str, int] | int, seed: int,
                    row_id: str) -> DataFrame:
    """The first rows of each class in drawn order, up to its quota."""
    w = Window.partitionBy(*by).orderBy(draw(seed, col(row_id)), row_id)
    most = quota if isinstance(quota, int) else max(quota.values())
    out = rows.withColumn("pick", F.row_number().over(w)).where(col("pick") <= most)
    if isinstance(quota, int):
        return out
    return out.where(col("pick") <= lookup(col(by[0]), quota))


def held_out(members: DataFrame, used: DataFrame, slots: Sequence[str], seed: int, least_words: int = 3) -> DataFrame:
    """One candidate per slot from sets not used so far and without men's marks, each set giving at most one.

    A set offers the first item it has for a slot, if its title has words enough. Sets are taken in drawn order. For
    every slot its first |slots| sets are enough, as earlier slots can claim at most one each; that short list is
    written, and each slot takes its first set that no earlier slot took.
    """
    mens = members.where(blank(col("title")).rlike(fixed.MENS_MARK)).select("set_id").distinct()
    first = (members.join(used.select("set_id").distinct(), "set_id", "left_anti").join(mens, "set_id", "left_anti")
             .where(col("category").isin(*slots)).groupBy("set_id", "category")
             .agg(F.min(F.struct("item_id", "title")).alias("i")).select("set_id", "category", "i.*")
             .where(F.size(F.split(F.trim(blank(col("title"))), r"\s+")) >= least_words))
    w = Window.partitionBy("category").orderBy(draw(seed, col("set_id")), "set_id")
    short = stage(first.withColumn("n", F.row_number().over(w)).where(col("n") <= len(slots)).drop("title"), "held-out")
    taken = None
    for s in slots:
        free = short.where(col("category") == s)
        free = free if taken is None else free.join(taken.select("set_id"), "set_id", "left_anti")
        pick = free.orderBy("n").limit(1).select("category", "set_id", "item_id")
        taken = pick if taken is None else taken.unionByName(pick)
    return taken


def sample_pool(rows: DataFrame, n: int, seed: int, row_id: str) -> DataFrame:
    """n rows in drawn order (partial top-n per partition, then merged)."""
    return rows.orderBy(draw(seed, col(row_id)), row_id).limit(n)


def negative_sets(pools: DataFrame, n: int, slots: Sequence[str], seed: int) -> DataFrame:
    """n sets of one random item per slot: set i takes the item whose place in the slot's drawn order is a hash of i.

    Places are counted over the whole pool: per hash bucket first, then inside the buckets, so a large pool is never
    sorted in one task.
    """
    spark = pools.sparkSession
    pool = pools.where(col("category").isin(*slots)).withColumn("drawn", draw(seed, col("item_id")))
    pool = pool.withColumn("bucket", F.substring("drawn", 1, 3))
    counts = pool.groupBy("category", "bucket").agg(F.count("*").alias("size"))
    ahead = Window.partitionBy("category").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("ahead", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    w = Window.partitionBy("category", "bucket").orderBy("drawn", "item_id")
    ranked = (pool.withColumn("inside", F.row_number().over(w) - 1).join(counts, ["category", "bucket"])
              .select("category", (col("ahead") + col("inside")).alias("at"), "item_id"))
    sizes = counts.groupBy("category").agg(F.sum("size").alias("size"))
    asked = spark.range(n).select(col("id").alias("set_no"), F.explode(literal_array(slots)).alias("category")).join(
        sizes, "category")
    number = F.conv(F.substring(draw(seed + 1, col("set_no"), col("category")), 1, 8), 16, 10).cast("bigint")
    placed = asked.withColumn("at", number % col("size"))
    return placed.join(ranked, ["category", "at"]).groupBy("set_no").agg(
        *[F.max(F.when(col("category") == s, col("item_id"))).alias(s) for s in slots])


def title_attributes(items: DataFrame, title: str = "title") -> DataFrame:
    """Type, colour, pattern, fabric and formality out of a product title (column category given)."""
    t = F.lower(blank(col(title)))
    kind = F.coalesce(*[F.when(col("category") == c, first_match([t], r, ignore_case=False))
                        for c, r in fixed.TITLE_TYPES.items()])
    color = first_match([t], [(rf"\b{c}\b", "grey" if c == "gray" else c) for c in fixed.TITLE_COLORS],
                        ignore_case=False)
    fabric = first_match([t], [(f, f) for f in fixed.TITLE_FABRICS], ignore_case=False)
    out = items.withColumns({"t_type": kind, "t_color": color,
                             "t_pattern": first_match([t], fixed.TITLE_PATTERNS, ignore_case=False),
                             "t_fabric": fabric,
                             "t_formality": first_match([t], fixed.TITLE_FORMALITY, ignore_case=False)})
    return out.withColumns({
        "t_fabric": F.coalesce("t_fabric", F.when(col("t_type").isin("jeans", "denim jacket"), "denim")),
        "t_formality": F.coalesce("t_formality", lookup(blank(col("t_type")),
                                                        {k: v[1] for k, v in fixed.ZERO_SHOT_TYPES.items()}), F.lit(2))})


def seed_rows(items: DataFrame, existing: DataFrame, prefix: str = "seed_") -> DataFrame:
    """Seed items with ids from their source id and category default prices; known ids are skipped."""
    rows = items.withColumns({
        "seed_id": F.concat(F.lit(prefix), col("item_id").cast("string")),
        "seed_price": F.coalesce(lookup(col("category"), fixed.SEED_PRICES), F.lit(fixed.SEED_PRICE_OTHER)),
        "price_source": F.lit("seed")})
    return rows.join(existing.select("seed_id"), "seed_id", "left_anti")
