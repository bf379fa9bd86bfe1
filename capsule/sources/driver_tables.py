"""Closets, candidates and vectors projected from the TPC-H-like tables, by plain rules on part keys.

The given tables hold no wardrobe. What a person ordered becomes their closet; every part carries clothing
attributes derived from its columns. The same rules are written as SQL in `capsule.catalog.oracle`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capsule.functions.rules import literal_array

# ---- fixed values: what the projection hands out --------------------------------------------------
CATEGORY = ("top", "bottom", "outerwear", "dress", "shoes")
TYPES = {
    "top": ("t-shirt", "polo shirt", "blouse", "wool sweater", "hoodie", "tank top", "button-down shirt", "tunic"),
    "bottom": ("jeans", "chinos", "denim shorts", "pleated skirt", "leggings", "trousers", "cargo pants", "culottes"),
    "outerwear": ("blazer", "denim jacket", "puffer jacket", "trench coat", "cardigan", "vest", "bomber jacket",
                  "parka"),
    "dress": ("maxi dress", "jumpsuit", "shirt dress", "gown", "romper", "midi dress", "wrap dress", "slip dress"),
    "shoes": ("sneakers", "ankle boots", "loafers", "heels", "sandals", "flats", "running shoes", "mules"),
}
COLOR = ("black", "white", "navy", "red", "olive", "beige", "light blue", "grey", "pink", "green", "brown",
         "burgundy")
PATTERN = ("solid", "striped", "floral", "plaid", "graphic")
MATERIAL = ("95% cotton 5% elastane", "cotton 60%, polyester 40%", "cotton and linen", "cotton blend", "poly-cotton",
            "merino wool", "unknown", "", "recycled polyester", "rubber", "silk satin", "vegan leather",
            "60% cotton", None)
FABRIC = ("cotton twill", "denim", "unknown", "wool", None)
GENDER = ("unisex", "mens", "womens")
PRICE_SOURCE = (None, "user", "seed", "listing")
CONFIDENCE = ("high", "medium", "LOW ", "sure", None)
ESTIMATE_SOURCE = ("model", "", None)
STYLE = ("minimalist", "streetwear", "preppy", "athleisure", "classic", "boho")

ATTRIBUTES = ("category", "subcategory", "primary_color", "pattern", "material", "fabric_guess", "gender", "brand",
              "price", "price_source", "purchase_price", "estimated_price_usd", "price_confidence",
              "price_estimate_source", "formality", "style_tags", "label", "description")


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def _pick(values, index: Column) -> Column:
    return F.get(literal_array(values), index.cast("int"))


def _div(c: Column, n: int) -> Column:
    return F.floor(c / n)


def part_items(spark: SparkSession, root: str) -> DataFrame:
    """One row per part with clothing attributes and the keys of its three vectors."""
    p = read(spark, root, "part")
    k = F.col("p_partkey")
    kind = _div(k, 5) % 8
    subcategory = F.get(F.get(F.array(*[literal_array(TYPES[c]) for c in CATEGORY]), (k % 5).cast("int")),
                        kind.cast("int"))
    cents = F.round(F.col("p_retailprice") - 880, 2).cast("decimal(10,2)").cast("string")
    color, pattern = _pick(COLOR, F.col("p_size") % 12), _pick(PATTERN, _div(k, 11) % 5)
    return p.select(
        k.alias("part"),
        _pick(CATEGORY, k % 5).alias("category"),
        subcategory.alias("subcategory"),
        color.alias("primary_color"),
        pattern.alias("pattern"),
        _pick(MATERIAL, _div(k, 3) % 14).alias("material"),
        _pick(FABRIC, _div(k, 13) % 5).alias("fabric_guess"),
        _pick(GENDER, k % 3).alias("gender"),
        F.when(k % 4 != 0, F.col("p_brand")).alias("brand"),
        F.when(k % 7 == 1, "").when(k % 7 == 2, "0").when(k % 7 == 3, "n/a").when(k % 7 > 3, cents).alias("price"),
        _pick(PRICE_SOURCE, _div(k, 7) % 4).alias("price_source"),
        F.when(k % 10 == 0, F.concat(F.col("p_size").cast("string"), F.lit(".50"))).alias("purchase_price"),
        F.when(k % 6 == 1, 1.5).when(k % 6 == 2, 9000.0).when(k % 6 == 3, -4.0)
        .when(k % 6 > 3, F.col("p_size") + 20.5).alias("estimated_price_usd"),
        _pick(CONFIDENCE, _div(k, 2) % 5).alias("price_confidence"),
        _pick(ESTIMATE_SOURCE, _div(k, 6) % 3).alias("price_estimate_source"),
        (1 + F.col("p_size") % 5).cast("int").alias("formality"),
        F.array(_pick(STYLE, k % 6), _pick(STYLE, _div(k, 6) % 6)).alias("style_tags"),
        F.concat_ws(" ", color, subcategory).alias("label"),
        F.concat_ws(" ", F.col("p_name"), pattern, subcategory).alias("description"),
        F.col("p_name").alias("part_name"),
        k.alias("image_key"),
        (((F.col("p_size") % 12) * 5 + _div(k, 11) % 5) * 40 + kind * 5 + k % 5).cast("bigint").alias("text_key"),
        (k * 7 + 3).alias("style_key"),
    )


def owned(spark: SparkSession, root: str) -> DataFrame:
    """Everything each customer ever ordered, one row per (customer, part)."""
    lines = read(spark, root, "lineitem").select("l_orderkey", "l_partkey")
    orders = read(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("part"))
            .agg(F.min("o_orderdate").cast("timestamp").alias("created_at"), F.count("*").alias("times_bought")))


def closet(owned: DataFrame, parts: DataFrame) -> DataFrame:
    """The items of `owned` with the attributes of their parts; a query that needs few of them joins only those."""
    return (owned.join(parts, "part")
            .withColumn("item_id", F.concat(F.lit("i"), F.col("user_id"), F.lit("_"), F.col("part")))
            .withColumn("status", F.lit("closet")))


def candidates(spark: SparkSession, root: str) -> DataFrame:
    """One candidate per (customer with a closet, category), spread over the parts by customer key."""
    users = read(spark, root, "orders").select(F.col("o_custkey").alias("user_id")).distinct()
    n_parts = read(spark, root, "part").agg(F.max("p_partkey") + 1).scalar()
    slot = F.col("slot")
    part = 5 * ((F.col("user_id") * 31 + slot * 17) % F.floor(n_parts / 5)) + slot
    return (users.withColumn("slot", F.explode(F.expr("sequence(0L, 4L)")))
            .select("user_id", part.alias("part"), F.lit("2002-01-01").cast("timestamp").alias("created_at"))
            .join(part_items(spark, root), "part")
            .withColumn("item_id", F.concat(F.lit("c"), F.col("user_id"), F.lit("_"), F.col("part")))
            .withColumn("status", F.lit("candidate")))


def vectors(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "embeddings").select("vec_id", F.col("embedding").alias("vector"))


def with_vectors(items: DataFrame, spark: SparkSession, root: str, **columns: str) -> DataFrame:
    """Attach vectors: `image="image_key"` adds column `image` with the vector of that key."""
    vec = vectors(spark, root)
    n = vec.agg(F.count("*")).scalar()
    out = items
    for name, key in columns.items():
        v = vec.select(F.col("vec_id").alias(f"_{name}"), F.col("vector").alias(name))
        out = out.withColumn(f"_{name}", F.col(key) % n).join(v, f"_{name}").drop(f"_{name}")
    return out


def referable(spark: SparkSession, root: str) -> DataFrame:
    """The vectors (vec_id, ref, vector) with a reference for each row; to be written before it is used."""
    return vectors(spark, root).withColumn("ref", F.monotonically_increasing_id())


def with_refs(items: DataFrame, refs: DataFrame, **columns: str) -> DataFrame:
    """Attach references to the rows of a written `referable` table, where `with_vectors` attaches their vectors."""
    n = refs.agg(F.count("*")).scalar()
    out = items
    for name, key in columns.items():
        v = refs.select(F.col("vec_id").alias(f"_{name}"), F.col("ref").alias(name))
        out = out.withColumn(f"_{name}", F.col(key) % n).join(v, f"_{name}").drop(f"_{name}")
    return out


def item_embeddings(spark: SparkSession, root: str) -> DataFrame:
    """The embedding table of the closet: one row per (item, kind)."""
    items = closet(owned(spark, root), part_items(spark, root)).select("user_id", "item_id", "image_key", "text_key", "style_key")
    kinds = F.explode(F.array(
        F.struct(F.lit("fclip").alias("kind"), F.col("image_key").alias("key")),
        F.struct(F.lit("text").alias("kind"), F.col("text_key").alias("key")),
        F.struct(F.lit("compat").alias("kind"), F.col("style_key").alias("key"))))
    long = items.select("user_id", "item_id", kinds.alias("k")).select("user_id", "item_id", "k.kind", "k.key")
    return (with_vectors(long, spark, root, vector="key")
            .select("user_id", "item_id", "kind", F.lit("m1").alias("model"), "vector"))
