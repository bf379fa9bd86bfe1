"""Item attributes: names, texts, settings, patches, diffs, status changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capsule import fixed
from capsule.functions.numbers import clamp, to_double
from capsule.functions.rules import filled, lookup
from capsule.functions.words import blank

NO_PATTERN = ("solid", "plain", "none", "unknown")
NO_FABRIC = ("unknown", "none", "n/a")


def item_name(color: Column, subcategory: Column, category: Column) -> Column:
    """Short name such as 'navy chinos'."""
    kind = F.coalesce(filled(subcategory), filled(category), F.lit("item"))
    return F.trim(F.concat(blank(color), F.lit(" "), kind))


def similarity_text(color: Column, pattern: Column, subcategory: Column, category: Column) -> Column:
    """Prompt whose embedding tells items of one type apart; a plain pattern is left out."""
    shown = F.when(blank(pattern).isin("", "solid"), "").otherwise(F.concat(pattern, F.lit(" ")))
    kind = F.coalesce(filled(subcategory), filled(category), F.lit("garment"))
    return F.replace(F.concat(F.lit("a photo of a "), blank(color), F.lit(" "), shown, kind), F.lit("  "), F.lit(" "))


def model_text(color: Column, pattern: Column, fabric: Column, subcategory: Column, category: Column,
               label: Column, fabric_words: int | None = None) -> Column:
    """Product-name style text: colour, pattern, fabric (all its words, or the first few), type; every word once, in
    order."""
    def words(c: Column) -> Column:
        return F.regexp_extract_all(F.lower(blank(c)), F.lit(r"(\S+)"), F.lit(1))

    pat = F.when(~F.lower(blank(pattern)).isin(*NO_PATTERN), pattern)
    fab = F.when(~F.lower(blank(fabric)).isin(*NO_FABRIC), fabric)
    kind = F.coalesce(filled(subcategory), filled(category))
    fabric_ = words(fab) if fabric_words is None else F.slice(words(fab), 1, fabric_words)
    text = F.array_join(F.array_distinct(F.concat(words(color), words(pat), fabric_, words(kind))), " ")
    return F.coalesce(filled(text), F.lower(F.coalesce(filled(label), F.lit("clothing item"))))


SETTINGS_TYPES = {
    "compat_threshold": "double", "redundancy_similar_threshold": "double", "redundancy_duplicate_threshold": "double",
    "redundancy_text_weight": "double", "style_goal": "string", "occasions": "array<string>",
    "match_gender_presentation": "boolean", "max_pairs_for_layering": "int", "use_shoes_layer": "boolean",
}


def resolve_settings(users: DataFrame, stored: DataFrame, *, data: str = "data") -> DataFrame:
    """Settings per user: the defaults overlaid by the known keys of the stored JSON; other keys are dropped."""
    schema = ", ".join(f"{k} {t}" for k, t in SETTINGS_TYPES.items())
    parsed = stored.select("user_id", F.from_json(data, schema).alias("s"))
    out = users.select("user_id").join(parsed, "user_id", "left")
    cols = ["user_id"]
    for k, t in SETTINGS_TYPES.items():
        default = fixed.DEFAULT_SETTINGS[k]
        lit = F.array().cast(t) if isinstance(default, list) else F.lit(default).cast(t)
        cols.append(F.coalesce(F.col(f"s.{k}"), lit).alias(k))
    return out.select(*cols)


def default_settings(users: DataFrame, **changed) -> DataFrame:
    """The defaults for every user, with changes that hold for all of them."""
    known = {**fixed.DEFAULT_SETTINGS, **changed}
    return users.select("user_id", *[(F.array().cast(t) if isinstance(known[k], list) else F.lit(known[k]).cast(t)).alias(k)
                                     for k, t in SETTINGS_TYPES.items()])


def project_for_api(items: DataFrame) -> DataFrame:
    """Columns shown to a client: category falls back to the attribute, image to the first one there is."""
    return items.select(
        "user_id", "item_id", "status",
        F.coalesce(filled(F.col("category")), F.col("attr_category")).alias("category"),
        F.coalesce(filled(F.col("clean_path")), filled(F.col("white_path")), filled(F.col("crop_path"))).alias("image"),
        F.coalesce(filled(F.col("white_path")), filled(F.col("crop_path"))).alias("original_image"),
        F.coalesce(filled(F.col("cutout_path")), filled(F.col("white_path"))).alias("cutout_image"), "label")


def patch_attributes(items: DataFrame, patches: DataFrame, keys: list[str], *, attributes: str = "attributes",
                     patch: str = "patch") -> DataFrame:
    """Overlay a partial attribute map (values as text, '' or NULL clear a price).

    Formality is forced into 1-5 and relabelled; a typed price becomes the user's, a cleared price loses its
    source; a non-empty patch marks the item as edited.
    """
    joined = items.join(patches, keys, "left")
    old = F.coalesce(F.col(attributes), F.create_map().cast("map<string,string>"))
    new = F.coalesce(F.col(patch), F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)
    level = F.floor(clamp(to_double(F.try_element_at(new, F.lit("formality"))), 1, 5)).cast("int")
    price_set = filled(F.try_element_at(new, F.lit("price"))).isNotNull()
    touches_price = F.map_contains_key(new, F.lit("price"))
    extra = F.filter(F.array(
        F.when(level.isNotNull(), F.struct(F.lit("formality").alias("k"), level.cast("string").alias("v"))),
        F.when(level.isNotNull(), F.struct(F.lit("formality_label").alias("k"),
                                           lookup(level, fixed.FORMALITY_LABELS).alias("v"))),
        F.when(price_set, F.struct(F.lit("price_source").alias("k"), F.lit("user").alias("v"))),
        F.when(F.size(new) > 0, F.struct(F.lit("edited").alias("k"), F.lit("true").alias("v"))),
    ), lambda e: e.isNotNull())
    over = F.map_from_entries(extra)
    kept = F.map_filter(merged, lambda k, v: ~F.map_contains_key(over, k)
                        & ~((k == "price_source") & touches_price & ~price_set))
    return joined.withColumn(attributes, F.map_concat(kept, over)).drop(patch)


def stale_after_patch(patches: DataFrame, keys: list[str]) -> DataFrame:
    """What a patch makes stale: the text-dependent item vector and every cached set score with the item."""
    kinds = F.array(F.struct(F.lit("embedding").alias("what"), F.lit("compat").alias("kind")),
                    F.struct(F.lit("set_scores").alias("what"), F.lit(None).cast("string").alias("kind")))
    return patches.select(*keys, F.inline(kinds)).distinct()


def category_problem(category: Column, accessory: Column) -> Column:
    """Why merged attributes cannot be kept, NULL when they can."""
    allowed = ", ".join(fixed.CATEGORIES)
    return (F.when(accessory, "accessory")
            .when((blank(category) != "") & ~category.isin(*fixed.CATEGORIES), f"category must be one of: {allowed}"))


def changed_attributes(before: Column, after: Column) -> Column:
    """Entries of `after` that are new or differ."""
    return F.map_filter(after, lambda k, v: ~v.eqNullSafe(F.try_element_at(before, k)))


def attributes_from_listing(p: DataFrame) -> DataFrame:
    """Product listing to item attributes, gaps filled from the candidate (columns `cand_formality`, `cand_gender`)."""
    level = F.floor(clamp(to_double(F.col("formality")), 1, 5)).cast("int")
    own = to_double(F.col("cand_formality"))
    formality = F.coalesce(level, F.when(own != 0, own).cast("int"), F.lit(2))
    gender = (F.when(F.col("gender").isin("mens", "womens", "unisex"), F.col("gender"))
              .otherwise(F.coalesce(filled(F.col("cand_gender")), F.lit("unisex"))))
    return p.withColumns({
        "subcategory": F.coalesce(filled(F.col("subcategory")), F.col("category")),
        "primary_color": F.coalesce(filled(F.col("color")), F.lit("unknown")),
        "pattern": F.coalesce(filled(F.col("pattern")), F.lit("solid")),
        "fabric_guess": F.coalesce(filled(F.col("material")), F.lit("unknown")),
        "formality": formality,
        "formality_label": lookup(formality, fixed.FORMALITY_LABELS),
        "gender": gender,
        "price_source": F.lit("retailer"),
        "description": F.col("name"),
    })


def merge_listing(items: DataFrame) -> DataFrame:
    """Scraped listing columns (`l_*`) into item columns: brand and price only where missing, colour if unsure."""
    from capsule.functions.words import longest_color
    no_price = F.coalesce(F.col("price").cast("string"), F.lit("")) == ""
    takes = F.col("l_price").isNotNull() & no_price
    better = F.when(F.coalesce(F.col("source"), F.lit("")) != "gemini", longest_color(F.lower(F.col("l_color"))))
    return items.withColumns({
        "listing_title": filled(F.col("l_title")), "listing_color": filled(F.col("l_color")),
        "listing_price": F.col("l_price"),
        "brand": F.coalesce(filled(F.col("brand")), filled(F.col("l_brand"))),
        "price": F.when(takes, F.col("l_price").cast("string")).otherwise(F.col("price")),
        "price_source": F.when(takes, "listing").otherwise(F.col("price_source")),
        "primary_color": F.coalesce(better, F.col("primary_color")),
    })


def move_to_closet(items: DataFrame, *, purchased: Column, now: Column) -> DataFrame:
    """Status to closet; a purchase stamps its time and copies the price to the purchase price."""
    return items.withColumns({
        "status": F.lit("closet"),
        "purchased_at": F.when(purchased, now),
        "purchase_price": F.when(purchased & F.col("price").isNotNull(), F.col("price"))
        .otherwise(F.col("purchase_price")),
    })
