"""Evaluate every candidate of every user in one job: similarity, outfits, price, verdict, footprint."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capsule import fixed
from capsule.operators import cells, looks, pricing, similarity, value
from capsule.operators.attributes import default_settings, item_name
from capsule.sources.staging import stage

col = F.col


@dataclass
class Evaluation:
    """Tables of one evaluation run. `similar` and `outfits` are written, `results` is lazy on top of them."""

    candidates: DataFrame
    similar: DataFrame
    outfits: DataFrame
    results: DataFrame


KIND = ("category", "subcategory", "label", "description")
RESOLVED = ("garment_type", "table_price")
#: What the price bars read of an item.
WORTH = ("wears", "real_price", "estimated_price")
#: What is read of a closet once its facts are known, and the facts among it.
FACTS = ("user_id", "item_id", "category", "gender", "garment_type", "wears", "real_price", "estimated_price")
READ = (*FACTS, "created_at", "primary_color", "subcategory", "image", "text", "style")


def kinds_of(items: DataFrame) -> DataFrame:
    """Garment type and table price of each distinct category and texts: the rule tables run once per kind, not per
    item. Written before and after, so that no aggregate or join is compiled together with the rules."""
    kinds = stage(items.select(*KIND).distinct(), "kinds")
    return stage(kinds.select(*KIND, value.type_of(value.garment_type(*[col(c) for c in KIND])).alias("garment_type"),
                              pricing.item_table_price().alias("table_price")), "kinds-resolved")


def with_kind(items: DataFrame, kinds: DataFrame) -> DataFrame:
    """`items` with garment_type and table_price."""
    named = kinds.select(*[col(c).alias(f"_{c}") for c in KIND], "garment_type", "table_price")
    same = [col(c).eqNullSafe(col(f"_{c}")) for c in KIND]
    return items.join(named, same).drop(*[f"_{c}" for c in KIND])


def closet_facts(closet: DataFrame) -> DataFrame:
    """Closet items with garment type, wears, known price and estimate. A closet whose kinds are resolved already keeps them, one
    with all of these stays as it is."""
    if {*RESOLVED, *WORTH} <= set(closet.columns):
        return closet
    typed = closet if set(RESOLVED) <= set(closet.columns) else with_kind(closet, kinds_of(closet))
    priced = pricing.effective_price(typed, table=col("table_price"))
    known = col("price_used_source") != "estimated"
    return priced.withColumns({
        "wears": value.base_wears(col("garment_type")),
        "real_price": F.when(known, col("price_used")),
    })


def type_counts(facts: DataFrame) -> DataFrame:
    """Per owner a map '<type>|<gender bits>' to count; at most three entries per garment type."""
    key = F.concat_ws("|", "garment_type", looks.gender_mask(col("gender")).cast("string"))
    return (facts.where(col("garment_type").isNotNull()).groupBy("user_id", key.alias("k")).count()
            .groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "count"))).alias("types")))


def closet_context(closet: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per owner: pool counts, type counts and the personal price bar. `facts` comes from `closet_facts`."""
    return (looks.pool_counts(closet).join(type_counts(facts), "user_id", "left")
            .join(value.price_bar(facts), "user_id", "left"))


BARS = ("priced_items", "estimated_items", "price_bar", "price_bar_source")


def repeated_bars(owned: DataFrame, facts: DataFrame) -> DataFrame:
    """Owned candidates whose ids repeat, with the bars over their owners' closets without any item of that id. Costs a
    closet's distinct values for each of them."""
    named = owned.select("user_id", col("item_id").alias("judged"))
    rest = facts.select("user_id", "item_id", "wears", "real_price", "estimated_price").join(named, "user_id")
    found = value.price_bar(rest.where(col("item_id") != col("judged")), "judged")
    without = named.select("judged").join(found, "judged", "left").withColumnRenamed("judged", "item_id")
    return owned.drop(*BARS).join(without, "item_id")


def own_bars(owned: DataFrame, facts: DataFrame) -> DataFrame:
    """Owned candidates, with own_value and own_real, with price bars over their owners' closets without them; none for the
    only item of a closet. An owner's closet is ranked once, however many of its items are judged."""
    often = stage(owned.groupBy("item_id").count().where(col("count") > 1).select("item_id"), "repeated")
    middles = value.middle_values(facts.where(col("item_id").isNotNull()))
    if not often.limit(1).count():
        return value.bars_without_item(owned.join(middles, "user_id", "left")).select(*owned.columns)
    once = value.bars_without_item(owned.join(often, "item_id", "left_anti").join(middles, "user_id", "left"))
    more = repeated_bars(owned.join(often, "item_id", "left_semi"), facts)
    return once.select(*owned.columns).unionByName(more.select(*owned.columns))


def type_count(typ, mask, free, own_type, own_mask):
    """Owned items of a type that a candidate's wearer would wear, itself not counted."""
    own = (own_type == typ) & (free | (mask.bitwiseAND(own_mask) != 0))
    total = F.when(own, -1).otherwise(0).cast("bigint")
    for m in (1, 2, 3):
        n = F.coalesce(F.try_element_at(col("types"), F.concat_ws("|", typ, F.lit(str(m)))), F.lit(0))
        total = total + F.when(free | (mask.bitwiseAND(F.lit(m)) != 0), n).otherwise(F.lit(0))
    return total


def outfit_totals(outfits: DataFrame) -> DataFrame:
    """Per candidate: outfits per template, best and summed score, mean of the best five scores, partner pieces."""
    best = Window.partitionBy("item_id").orderBy(col("score").desc())
    quality = (outfits.select("item_id", "score").withColumn("r", F.row_number().over(best))
               .where(col("r") <= fixed.QUALITY_TOP_K).groupBy("item_id").agg(F.avg("score").alias("quality")))
    totals = outfits.groupBy("item_id").agg(
        F.count("*").alias("n_outfits"),
        F.count(F.when(col("template_ord") == 0, 1)).alias("n_first"),
        F.count(F.when(col("template_ord") == 1, 1)).alias("n_second"),
        F.max("score").alias("best_outfit"), F.sum("score").alias("weighted_outfits"))
    return totals.join(quality, "item_id")


def evaluate(candidates: DataFrame, closet: DataFrame, settings: DataFrame | None = None, *,
             center: float = fixed.SCORE_CENTER, tau: float = fixed.SCORE_TAU,
             cutoffs: Mapping[int, float] | None = None, long: float = 0.5, block: int = cells.BLOCK,
             vectors: DataFrame | None = None) -> Evaluation:
    """Verdicts of all candidates against their owners' closets. A candidate that is in the closet already is judged
    against the rest of it.

    Items need user_id, item_id, category, gender, created_at, the attribute columns and the vectors `image`,
    `text`, `style`. `settings` is one row per user (the defaults when missing). With `vectors` (ref, vector) the vector
    columns hold references to it, and no vector is shuffled or written for an item. A closet with garment_type and
    table_price (see `with_kind`) is not joined with its kinds again.
    """
    if settings is None:
        settings = default_settings(candidates.select("user_id").distinct())
    supported = candidates.where(col("category").isin(*fixed.SUPPORTED)).join(settings, "user_id")
    resolved = set(RESOLVED) <= set(closet.columns)
    if resolved:
        closet = closet_facts(closet).select(*READ)
    if vectors is not None:
        supported, closet = stage(supported, "supported"), stage(closet, "referring")
    sim = stage(similarity.redundancy(supported, closet, weight="redundancy_text_weight", block=block, vectors=vectors).select(
        "item_id", "redundancy_level", "top_similarity", "top_item_id", "matches"), "similar")
    # both sides are read many times from here on
    closet = closet.drop("image", "text")
    if vectors is None:
        closet = stage(closet, "closet")
    facts = closet if resolved else stage(closet_facts(closet).select(*FACTS), "facts")
    own = facts.select("user_id", "item_id", col("category").alias("own_category"),
                       looks.gender_mask(col("gender")).alias("own_mask"), col("garment_type").alias("own_type"),
                       value.worn_value(col("real_price"), col("estimated_price"), col("wears")).alias("own_value"),
                       F.when(col("wears").isNotNull(), col("real_price").isNotNull()).alias("own_real"))
    supported = supported.drop("image", "text", *RESOLVED)
    supported = with_kind(supported, kinds_of(supported)).join(own, ["user_id", "item_id"], "left")
    # an owner's counts by type are summed up here: the whole map goes no further with each candidate
    supported = stage(looks.prepare(supported, closet_context(closet, facts)).withColumn("type_count", type_count(
        col("garment_type"), col("mask"), col("free"), col("own_type"), col("own_mask"))).drop("types", "own_mask", "own_type"), "prepared")
    cands, is_owned = supported, col("own_category").isNotNull()
    if supported.where(is_owned).limit(1).count():
        cands = stage(supported.where(~is_owned).unionByName(own_bars(supported.where(is_owned), facts)), "candidates")
    cands = cands.drop("own_value", "own_real")
    made = stage(looks.outfits(cands, closet, center=center, tau=tau, cutoffs=cutoffs, long=long, levels=sim,
                               block=block, vectors=vectors), "outfits")
    names = closet.select(col("item_id").alias("top_item_id"),
                          item_name(col("primary_color"), col("subcategory"), col("category")).alias("top_match_name"))
    # the name comes by the candidate's id, as the rest: no whole candidate is shuffled by the item it is closest to
    named = (sim.select("item_id", "top_item_id").where(col("top_item_id").isNotNull()).distinct()
             .join(names, "top_item_id").drop("top_item_id"))
    priced = pricing.effective_price(cands, table=col("table_price")).drop("table_price").withColumns({
        "max_possible": looks.most_outfits(col("category"), col("max_pairs_for_layering")),
    })
    count = F.lit(0).cast("bigint")
    for c in fixed.CATEGORIES:
        count = F.when(col("category") == c, col(f"pool_{c}")).otherwise(count)
    full = (priced.join(outfit_totals(made), "item_id", "left").join(sim, "item_id")
            .join(named, "item_id", "left")
            .withColumns({
                "n_outfits": F.coalesce("n_outfits", F.lit(0)),
                "n_first": F.coalesce("n_first", F.lit(0)), "n_second": F.coalesce("n_second", F.lit(0)),
                "quality": F.coalesce("quality", F.lit(0.0)),
                "weighted_outfits": F.coalesce("weighted_outfits", F.lit(0.0)),
                "category_count": count,
                "stated_price": col("price"),
                "price": col("price_used"), "price_source": col("price_used_source"),
                "price_confidence": col("price_used_confidence"),
                "price_bar_source": F.coalesce("price_bar_source", F.lit("default")),
                "templates": looks.templates(col("category"), col("shoes_layer")),
            }))
    return Evaluation(cands, sim, made, value.verdict(full).drop("style", "own_category"))


def shown_outfits(outfits: DataFrame, per_template: int = fixed.OUTFITS_PER_TEMPLATE) -> DataFrame:
    """The outfits returned to a client: the best of each template, ranked, with a flag when some are left out."""
    by = Window.partitionBy("item_id", "template").orderBy(col("score").desc(), F.array_join("members", "|"))
    totals = outfits.groupBy("item_id", "template").agg(F.count("*").alias("n_template"))
    return (outfits.withColumn("rank", F.row_number().over(by)).where(col("rank") <= per_template)
            .join(totals, ["item_id", "template"]).withColumn("truncated", col("n_template") > per_template))
