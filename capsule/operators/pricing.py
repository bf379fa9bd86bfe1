"""Price of an item: what the user or a tag says, else a stored estimate, else the rule table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capsule import fixed
from capsule.functions.numbers import clamp, positive, to_double
from capsule.functions.rules import filled, first_match, lookup
from capsule.functions.words import blank

col = F.col


def table_price(texts: Sequence[Column], category: Column, rules=fixed.PRICE_RULES,
                defaults: Mapping[str, float] = fixed.PRICE_CATEGORY_DEFAULTS,
                other: float = fixed.PRICE_OTHER) -> Column:
    """Typical price by the first rule that matches type, label or description, else by category."""
    return F.coalesce(first_match(texts, rules), lookup(F.lower(blank(category)), defaults), F.lit(other))


def real_price(price: Column, source: Column, purchase_price: Column) -> Column:
    """Struct(price, source) of a price that is known: typed (0 counts), read off a tag, or paid."""
    p = positive(price)
    gift = F.when((source == "user") & (to_double(price) == 0), F.lit(0.0))
    listed = F.coalesce(p, gift)
    origin = F.when(source.isin("user", "seed"), "user").otherwise("tag")
    paid = positive(purchase_price)
    return F.coalesce(
        F.when(listed.isNotNull(), F.struct(listed.alias("price"), origin.alias("source"))),
        F.when(paid.isNotNull(), F.struct(paid.alias("price"), F.lit("user").alias("source"))))


def clean_estimate(v: Column) -> Column:
    """A stored estimate within bounds, in whole dollars (ties to even)."""
    return F.rint(clamp(positive(v), fixed.ESTIMATE_MIN, fixed.ESTIMATE_MAX))


def clean_confidence(confidence: Column, brand: Column) -> Column:
    """'high' needs a brand; anything unknown is 'medium' with a brand and 'low' without."""
    c = F.lower(F.trim(blank(confidence)))
    known = F.when(c.isin(*fixed.CONFIDENCES), c).when(blank(brand) != "", "medium").otherwise("low")
    return F.when((known == "high") & (F.trim(blank(brand)) == ""), "medium").otherwise(known)


def estimate(stored: Column, confidence: Column, source: Column, brand: Column, table: Column) -> Column:
    """Struct(price, confidence, source): the stored estimate when valid, else the rule table."""
    v = clean_estimate(stored)
    return (F.when(v.isNotNull(), F.struct(
        v.alias("price"), clean_confidence(confidence, brand).alias("confidence"),
        F.coalesce(filled(source), F.lit("gemini")).alias("source")))
        .otherwise(F.struct(table.alias("price"), F.lit("low").alias("confidence"), F.lit("table").alias("source"))))


def item_table_price() -> Column:
    """Table price of an item from its category, subcategory, label and description."""
    return table_price([filled(col("subcategory")), filled(col("label")), filled(col("description"))], col("category"))


def _item_estimate(table: Column) -> Column:
    return estimate(col("estimated_price_usd"), col("price_confidence"), col("price_estimate_source"), col("brand"),
                    table)


def _item_real() -> Column:
    return real_price(col("price"), col("price_source"), col("purchase_price"))


def effective_price(items: DataFrame, argument: Column | None = None, table: Column | None = None) -> DataFrame:
    """Adds price_used, price_used_source, price_used_confidence, estimated_price and estimate_source. `table` is the
    items' table price where it is known already."""
    up = positive(argument) if argument is not None else F.lit(None).cast("double")
    staged = items.withColumns({"_real": _item_real(), "_est": _item_estimate(item_table_price() if table is None else table)})
    estimated = up.isNull() & col("_real").isNull()
    return staged.withColumns({
        "price_used": F.coalesce(up, col("_real.price"), col("_est.price")),
        "price_used_source": F.when(up.isNotNull(), "user").when(estimated, "estimated").otherwise(col("_real.source")),
        "price_used_confidence": F.when(estimated, col("_est.confidence")),
        "estimated_price": col("_est.price"),
        "estimate_source": col("_est.source"),
    }).drop("_real", "_est")


def needs_estimate() -> Column:
    """Neither a known price nor a valid stored estimate."""
    return _item_real().isNull() & clean_estimate(col("estimated_price_usd")).isNull()


def estimate_replies(replies: DataFrame, batches: DataFrame) -> DataFrame:
    """Model replies keyed by a 1-based position to item ids; positions off the list are dropped."""
    pos = F.trim(col("id").cast("string")).try_cast("int")
    return (replies.withColumn("position", pos).join(batches, ["batch_id", "position"])
            .select("item_id", "estimated_price_usd", "price_confidence"))


def backfill_estimates(items: DataFrame, model: DataFrame) -> DataFrame:
    """Estimates for the items that have none: the model's where valid, else the rule table.

    `model` has (item_id, m_price, m_confidence). Running it again on its own output changes nothing.
    """
    todo = items.where(needs_estimate()).join(model, "item_id", "left")
    v = clean_estimate(col("m_price"))
    table = table_price([filled(col("subcategory")), filled(col("label")), filled(col("description"))],
                        col("category"))
    return todo.withColumns({
        "estimated_price_usd": F.coalesce(v, table),
        "price_confidence": F.when(v.isNotNull(), clean_confidence(col("m_confidence"), col("brand"))).otherwise("low"),
        "price_estimate_source": F.when(v.isNotNull(), "gemini_text").otherwise("table"),
    }).drop("m_price", "m_confidence")


def backfill_summary(filled_items: DataFrame) -> DataFrame:
    """Counters of a backfill run per status."""
    source = col("price_estimate_source")
    return filled_items.groupBy("status").agg(
        F.count("*").alias("items_needing_estimate"),
        F.count(F.when(source == "gemini_text", 1)).alias("model_estimates"),
        F.count(F.when(source == "table", 1)).alias("table_estimates"))


def sane_page_price(listed: Column, page: Column) -> Column:
    """The page's price is within the allowed ratio of the listed one (or nothing is listed)."""
    ratio = page / F.when(listed != 0, listed)
    return F.coalesce(ratio.between(1 / fixed.PRICE_RATIO, fixed.PRICE_RATIO), F.lit(True))
