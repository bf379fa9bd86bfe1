"""Product listings: blocked stores, link checks, relevance, vetting, colour and reason texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsule import fixed
from capsule.functions import urls, words
from capsule.functions.numbers import fixed as text
from capsule.functions.rules import filled, literal_array, lookup
from capsule.functions.words import blank
from capsule.operators.filters import is_accessory
from capsule.operators.value import garment_type, how_of, type_of

col = F.col


def _plain(name: str) -> str:
    return "".join(ch for ch in name.lower() if ch.isalnum())


# ------------------------------------------------------------------ stores
def blocked_domain(u: Column, stores: Mapping[str, Sequence[str]] = fixed.BLOCKED_STORES) -> Column:
    h = urls.host(u)
    return F.coalesce(*[F.when(urls.on_domain(h, [d]), d) for d in stores])


def blocked_name(name: Column, stores: Mapping[str, Sequence[str]] = fixed.BLOCKED_STORES) -> Column:
    """Blocked seller whose name the text starts with, marks and spaces aside."""
    key = words.store_key(name)
    return F.coalesce(*[F.when(key.startswith(_plain(n)), n) for ns in stores.values() for n in ns])


def mentions_blocked(title: Column, stores: Mapping[str, Sequence[str]] = fixed.BLOCKED_STORES) -> Column:
    """Blocked seller named inside a title, with or without dots and spaces between its letters."""
    t = F.lower(blank(title))
    return F.coalesce(*[F.when(t.rlike(r"(?<![a-z0-9])" + r"\.?\s*".join(_plain(n)) + r"(?![a-z0-9])"), n)
                        for ns in stores.values() for n in ns])


def blocked_store(link: Sequence[Column], sellers: Sequence[Column], titles: Sequence[Column]) -> Column:
    """Why a product comes from a blocked store, NULL when it does not."""
    why = F.coalesce(*[blocked_domain(u) for u in link], *[blocked_name(s) for s in sellers],
                     *[mentions_blocked(t) for t in titles])
    return F.when(why.isNotNull(), F.concat(F.lit("blocked store ("), why, F.lit(")")))


def product_category(category: Column, subcategory: Column, name: Column) -> Column:
    """Slot of a product: its category or an alias of it, else what type and name hint at; NULL for accessories."""
    c = F.lower(F.trim(blank(category)))
    c = F.coalesce(lookup(c, fixed.CATEGORY_ALIASES), c)
    hint = words.category_hint(F.concat_ws(" ", blank(subcategory), blank(name)))
    return F.when(~is_accessory(category, subcategory, F.lit(None).cast("string"), name),
                  F.when(c.isin(*fixed.SUPPORTED), c).when(hint.isin(*fixed.SUPPORTED), hint))


# ------------------------------------------------------------------ links
def matches_product(body: Column, *, name: Column, brand: Column, retailer: Column, subcategory: Column,
                    category: Column) -> Column:
    """Why a page title or address does not describe the product, '' when it does."""
    t = F.translate(F.lower(blank(body)), "-_", "  ")
    found = words.tokens(t)
    other = words.category_hint(t)
    own = words.category_hint(F.concat_ws(" ", blank(subcategory), blank(name)))
    sellers = words.tokens(F.concat_ws(" ", blank(brand), blank(retailer)))
    key = F.array_except(words.tokens(name), sellers)
    kind = F.array_except(words.tokens(subcategory), literal_array(["top", "bottom"]))
    conflict = (F.coalesce(other.isin(*fixed.SUPPORTED) & (other != category), F.lit(False))
                & F.coalesce(own != other, F.lit(True)))
    hit = F.arrays_overlap(key, found) | F.arrays_overlap(kind, found)
    return (F.when(conflict, F.concat(F.lit("page is about "), other, F.lit(", not "), category))
            .when(hit, "").otherwise("page doesn't mention the product"))


def link_verdict(url: Column, status: Column, title: Column, **product: Column) -> Column:
    """Struct(ok, reason) for a resolved link of a product."""
    slug = matches_product(urls.path(url), **product)
    named = matches_product(title, **product)
    readable = (status == 200) & (blank(title) != "")
    by_slug = (slug == "") & words.category_hint(title).isNull()

    def out(ok, reason) -> Column:
        return F.struct((ok if isinstance(ok, Column) else F.lit(ok)).alias("ok"),
                        (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))

    return (F.when(F.contains(urls.host(url), F.lit(fixed.REDIRECT_HOST)),
                   out(False, "grounding redirect didn't resolve"))
            .when(urls.is_non_shopping(url), out(False, F.concat(F.lit("not a store page ("), urls.host(url),
                                                                  F.lit(")"))))
            .when(urls.is_bad_landing(url), out(False, "search / error page"))
            .when(readable & (named == ""), out(True, ""))
            .when(readable, out(by_slug, named))
            .otherwise(out(slug == "", slug)))


def on_store_host(u: Column, retailer: Column, brand: Column) -> Column:
    """Host belongs to the seller: it holds the first letters of retailer or brand (no names: any host does)."""
    h = F.regexp_replace(urls.host(u), "[^a-z0-9]", "")
    tokens = F.filter(F.array(words.store_token(retailer), words.store_token(brand)), lambda t: F.length(t) >= 2)
    return (h != "") & ((F.size(tokens) == 0) | F.exists(tokens, lambda t: F.contains(h, t)))


def trusted_image(u: Column, retailer: Column, brand: Column) -> Column:
    h = urls.host(u)
    return (h != "") & (on_store_host(u, retailer, brand) | urls.trusted_host(h))


def image_names_product(image: Column, url: Column, name: Column, brand: Column, retailer: Column) -> Column:
    """The photo address names the product or carries the product code of the page address."""
    img = F.lower(blank(image))
    sellers = words.tokens(F.concat_ws(" ", blank(brand), blank(retailer)))
    key = F.array_except(words.tokens(name), sellers)
    parts = F.regexp_extract_all(F.translate(img, "_", " "), F.lit("([a-z0-9]+)"), F.lit(1))
    codes = F.filter(F.regexp_extract_all(F.lower(urls.path(url)), F.lit("([a-z0-9]{5,})"), F.lit(1)),
                     lambda c: c.rlike("[0-9]") & c.rlike("[a-z]"))
    return F.arrays_overlap(key, parts) | F.exists(codes, lambda c: F.contains(img, c))


def vet(p: DataFrame) -> Column:
    """First reason a listing is refused, NULL when it is solid.

    Columns: link_ok (NULL = page could not be read), product_page, page_name, page_price, page_types, image,
    photo_kind, product_url, name, brand, retailer, category.
    """
    body = F.lower(F.concat_ws(" ", blank(col("name")), F.array_join(F.coalesce(col("page_types"), F.array()), " "),
                               F.translate(urls.path(col("product_url")), "-_", "  ")))
    kind = words.category_hint(body)
    unread = col("link_ok").isNull()
    return F.coalesce(
        F.when(~col("link_ok"), "product link broken"),
        F.when(col("link_ok") & ~F.coalesce(col("product_page"), F.lit(False)),
               "page isn't a product page (no product data / add to cart)"),
        F.when(col("link_ok") & (blank(col("page_name")) == ""), "page doesn't name the product"),
        F.when(col("link_ok") & (F.coalesce(col("page_price"), F.lit(0.0)) == 0), "page shows no price"),
        F.when(unread & ~trusted_image(col("image"), col("retailer"), col("brand")),
               "store page blocks readers and the photo isn't from the store"),
        F.when(unread & ~image_names_product(col("image"), col("product_url"), col("name"), col("brand"),
                                             col("retailer")),
               "store page blocks readers and the photo can't be tied to this product"),
        F.when(blank(col("photo_kind")) != "product_only",
               "only on-model / lifestyle photos (no photo of the item alone)"),
        F.when(kind.isNull(), F.concat(F.lit("page doesn't say it's "),
                                       F.coalesce(lookup(col("category"), fixed.CATEGORY_PLURALS), col("category")))),
        F.when(kind != col("category"), F.concat(F.lit("page is for "), kind, F.lit(", not "), col("category"))))


# ------------------------------------------------------------------ intake
def intake_reason(mode: Column, slot: Column, cand_category: Column, slots: Column, cand_gender: Column,
                  gender: Column, price: Column, blocked: Column, accessory: Column) -> Column:
    """Why a product is not considered for a candidate, NULL when it is."""
    clash = cand_gender.isin("mens", "womens") & gender.isin("mens", "womens") & (cand_gender != gender)
    return F.coalesce(
        blocked,
        F.when(accessory, "accessory"),
        F.when((mode == "alternatives") & ~slot.eqNullSafe(cand_category), F.concat(F.lit("not a "), cand_category)),
        F.when((mode == "pairings") & ~F.coalesce(F.array_contains(slots, slot), F.lit(False)),
               F.concat(F.lit("category "), F.coalesce(slot, F.lit("None")), F.lit(" doesn't pair"))),
        F.when(clash, F.concat(gender, F.lit(" item"))),
        F.when(price.isNull(), "no price"))


def pairing_slots(category: Column, gender: Column) -> Column:
    """Slots that go with a category; no dresses for mens."""
    slots = F.coalesce(*[F.when(category == c, literal_array(s)) for c, s in fixed.PAIRING_SLOTS.items()],
                       F.array().cast("array<string>"))
    return F.when(gender == "mens", F.array_remove(slots, "dress")).otherwise(slots)


def suggestion_mode(decision: Column) -> Column:
    d = F.upper(blank(decision))
    return F.when(d.isin("SKIP", "CONSIDER"), "alternatives").when(d == "BUY", "pairings")


def first_seen(rows: DataFrame, key: Column, by: Sequence[str], order: Sequence[str], reason: str,
               why: str = "listed twice") -> DataFrame:
    """Rows that already have a reason claim nothing; among the others only the first of a key stays free."""
    claims = Window.partitionBy(*by, "_key", "_free").orderBy(*order)
    return (rows.withColumns({"_key": key, "_free": col(reason).isNull()})
            .withColumn("_n", F.row_number().over(claims))
            .withColumn(reason, F.when(col("_free") & (col("_n") > 1), why).otherwise(col(reason)))
            .drop("_key", "_free", "_n"))


def clean_cached(listings: Column, *, accessory, blocked) -> Column:
    """Cached array of product structs without accessories and blocked stores."""
    return F.filter(listings, lambda s: ~accessory(s) & blocked(s).isNull())


# ------------------------------------------------------------------ relevance of a store hit
def hit_words(hits: DataFrame) -> DataFrame:
    """Adds what a store hit says by itself, once a hit: its texts, price, category hint, colour, gender and flaws."""
    title, kind = F.lower(blank(col("title"))), F.lower(blank(col("type")))
    tags = F.lower(F.array_join(F.coalesce(col("tags"), F.array()), " "))
    spaced = F.concat(F.lit(" "), title, F.lit(" "))
    h = hits.withColumns({
        "_title": title, "_kind": kind,
        "_text": F.concat_ws(" ", title, kind, tags, F.translate(blank(col("handle")), "-", " ")),
        "_price": F.coalesce(words.price_in_text(col("price"))),
        "_hint": words.category_hint(F.concat_ws(" ", title, kind)),
        "_color": words.longest_color(F.concat_ws(" ", title, tags)),
        "_flaw": F.when(spaced.rlike(words.any_of(fixed.NEGATIVE_WORDS)), "not a garment")
                 .when(words.head_word(col("title")).isin(*fixed.ACCESSORY_WORDS)
                       | words.head_word(col("type")).isin(*fixed.ACCESSORY_WORDS), "accessory"),
    })
    return h.withColumn("_said", words.gender_words(col("_text")))


def query_words(plans: DataFrame) -> DataFrame:
    """Adds the words a plan query asks for, once a query."""
    sub = F.lower(blank(col("q_subcategory")))
    parts = F.filter(F.split(sub, r"[\s/-]+"), lambda t: (F.length(t) > 2) & ~t.isin("top", "shirt"))
    wanted = F.lower(blank(col("q_color")))
    return plans.withColumns({
        "_parts": F.when(F.size(parts) > 0, parts).otherwise(F.array(sub)),
        "_wanted": F.coalesce(lookup(wanted, fixed.COLOR_WORDS), wanted),
        "_material": F.get(F.regexp_extract_all(F.lower(blank(col("q_material"))), F.lit(r"(\S+)"), F.lit(1)), 0),
        "_asked": F.filter(F.regexp_extract_all(F.lower(blank(col("query"))), F.lit(r"(\S+)"), F.lit(1)),
                           lambda t: F.length(t) > 2)})


def hit_relevance(h: DataFrame) -> DataFrame:
    """Adds `reason` (NULL = relevant) and `score` for store hits joined with their plan query.

    Hit: title, type, tags (array), handle, price (dirty), available, pos, and the columns of `hit_words`. Query: q_category,
    q_subcategory, q_color, q_material, query, and the columns of `query_words`. Either is added here when the caller joined
    without it. Context: cand_gender, price_low, price_high, avoid_color.
    """
    h = h if "_said" in h.columns else hit_words(h)
    h = h if "_asked" in h.columns else query_words(h)
    h = h.withColumn("_typed", F.exists("_parts", lambda t: (t != "") & (F.contains(col("_title"), t) | F.contains(col("_kind"), t))))
    reason = F.coalesce(
        F.when(~F.coalesce(col("available"), F.lit(True)), "sold out"),
        F.when(col("_price").isNull(), "no price"),
        F.when(~col("_price").between(col("price_low"), col("price_high")), F.concat(
            F.lit("price $"), text(col("_price"), 0), F.lit(" outside $"), text(col("price_low"), 0), F.lit("-$"),
            text(col("price_high"), 0))),
        col("_flaw"),
        F.when(col("cand_gender").isin("mens", "womens") & (col("_said") != col("cand_gender")),
               F.concat(col("_said"), F.lit(" item"))),
        F.when(col("_hint") != col("q_category"), F.concat(F.lit("looks like "), col("_hint"))),
        F.when(~col("_typed") & col("_hint").isNull(), "type not in title"),
        F.when(col("_color") == col("avoid_color"), F.concat(
            F.lit("same color ("), col("_color"), F.lit(") as the item you're skipping"))))
    named = F.filter("_asked", lambda t: F.contains(col("_title"), t))
    score = (F.when(col("_typed"), 3.0).otherwise(0.0)
             + F.when(col("_color").isNull(), 0.0).when(col("_color") == col("_wanted"), 2.0).otherwise(-2.0)
             + F.when(F.contains(col("_text"), col("_material")), 1.0).otherwise(0.0) + 0.5 * F.size(named))
    return (h.withColumns({"reason": reason, "score": score, "hit_color": col("_color"), "hit_price": col("_price")})
            .drop("_title", "_kind", "_text", "_price", "_hint", "_color", "_typed", "_flaw", "_said", "_parts", "_wanted", "_material", "_asked"))


def placed_score(score: Column, pos: Column) -> Column:
    """Relevance minus a little per position in the store's own ranking (0-based)."""
    return score - 0.15 * pos


def title_material(title: Column) -> Column:
    return words.first_listed(title, fixed.MATERIAL_WORDS)


def title_pattern(title: Column) -> Column:
    return F.coalesce(lookup(words.first_listed(title, list(fixed.PATTERN_WORDS)), fixed.PATTERN_WORDS),
                      F.lit("solid"))


def price_window(price: Column, mode: Column) -> tuple[Column, Column]:
    """Price range searched: around the candidate's price for alternatives, 5 to 120 otherwise."""
    near = (mode == "alternatives") & (F.coalesce(price, F.lit(0.0)) != 0)
    return (F.when(near, F.greatest(F.lit(5.0), price * 0.3)).otherwise(5.0),
            F.when(near, F.greatest(F.lit(40.0), price * 2.0)).otherwise(120.0))


# ------------------------------------------------------------------ colours and texts of a suggestion
def settle_color(claimed: Column, page_color: Column, url: Column, page_name: Column, image_color: Column) -> Column:
    """Struct(color, verified, replaced): the page, its link or its name decides; a black photo overrules."""
    c = filled(F.lower(claimed))
    page = F.coalesce(words.earliest_color(page_color), urls.variant_color(url), words.earliest_color(page_name))
    black = F.coalesce(image_color == "black", F.lit(False))
    by_page = page.isNotNull() & ~(black & ~page.isin(*fixed.DARK_COLORS))
    by_photo = black & ~F.coalesce(c.isin(*fixed.DARK_COLORS), F.lit(False))
    color = F.when(by_page, page).when(by_photo, "black").otherwise(c)
    verified = by_page | by_photo | F.coalesce(image_color == c, F.lit(False))
    return F.struct(color.alias("color"), verified.alias("verified"),
                    F.when(c.isNotNull() & ~c.eqNullSafe(color), c).alias("replaced"))


def headline(category: Column, owned: Column, owned_colors: Column, why: Column, color: Column) -> Column:
    """Reason shown first: a gap in the closet, else the given phrase when usable, else a new colour."""
    phrase = F.regexp_replace(F.trim(F.regexp_replace(blank(why), r"\s+", " ")), r"\.+$", "")
    usable = (phrase != "") & (F.length(phrase) <= 70) & ~phrase.rlike(r"\d")
    c = F.lower(blank(color))
    return (F.when(~owned, F.coalesce(lookup(category, fixed.GAP_PHRASES), F.lit("Fills a gap in your closet")))
            .when(usable, F.concat(F.upper(F.substring(phrase, 1, 1)), F.substr(phrase, F.lit(2))))
            .when((c != "") & ~F.array_contains(F.coalesce(owned_colors, F.array().cast("array<string>")), c), F.concat(
                F.lit("A new color for your "), F.coalesce(lookup(category, fixed.CATEGORY_PLURALS), category)))
            .otherwise("Works with a lot of what you own"))


def honest_headline(reason: Column, category: Column, verified_color: Column) -> Column:
    """A reason that claims a colour keeps it only when that colour was verified."""
    said = words.longest_color(F.lower(blank(reason)))
    false_claim = said.isNotNull() & (said != F.lower(blank(verified_color)))
    generic = F.concat(F.lit("A new "), F.coalesce(lookup(category, fixed.CATEGORY_NOUN), F.lit("piece")),
                       F.lit(" to mix with your clothes"))
    return F.when(false_claim & ~reason.isin(*fixed.GAP_PHRASES.values()), generic).otherwise(reason)


def title_type(title: Column, subcategory: Column, category: Column) -> Column:
    """Type text of a product: its title when that names a garment type of the category, else the planned type."""
    resolved = garment_type(category, filled(title))
    named = type_of(resolved).isNotNull() & (how_of(resolved) == "subcategory")
    return F.when(named, title).otherwise(subcategory)


def listing_words(listings: DataFrame) -> DataFrame:
    """Adds what a listing's title and type say: `l_body`, its text, and `l_want`, the category hinted at."""
    body = F.concat_ws(" ", filled(col("l_title")), filled(col("l_type")))
    return listings.withColumns({"l_body": body, "l_want": words.category_hint(body)})


def listing_match(item: DataFrame) -> Column:
    """How well a detected item fits a listing (`l_body`, `l_want`): category, type text and box size."""
    body = col("l_body")
    b = F.coalesce(col("bbox"), F.array(*[F.lit(0)] * 4))
    area = (F.get(b, 2) - F.get(b, 0)) * (F.get(b, 3) - F.get(b, 1))
    sub = F.lower(blank(col("subcategory")))
    return (F.when(col("l_want") == col("category"), 10).otherwise(0)
            + F.when((sub != "") & F.contains(F.lower(body), sub), 5).otherwise(0)
            + F.floor(area / 250000).cast("int"))


def best_detected(detections: DataFrame, listings: DataFrame, listing: Sequence[str], position: Sequence[str],
                  photo: str = "photo") -> DataFrame:
    """Every listing (identified by `listing` and its photo) with the detected item that fits it best, and how well (`fit`).

    Of equal fits the earliest detection by `position` counts. A listing whose photo has no detection, or that has no photo,
    keeps its row without an item. A photo's boxes are few (`filters.boxes` bounds them), so are the pairs.
    """
    keys, mine = [*listing, photo], [c for c in detections.columns if c != photo]
    pairs = listing_words(listings).select(*keys, "l_body", "l_want").join(detections, photo)
    rank = F.struct("fit", *[(-col(c)).alias(f"_{c}") for c in position])
    best = (pairs.withColumn("fit", listing_match(pairs)).groupBy(*keys)
            .agg(F.max_by(F.struct(*mine, "fit"), rank).alias("_best")))
    a, b = listings.alias("a"), best.alias("b")
    same = [col(f"a.{k}").eqNullSafe(col(f"b.{k}")) for k in keys]
    return a.join(b, same, "left").select("a.*", "b._best.*")
