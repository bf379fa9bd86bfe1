"""Listings, links, text, page extraction, suggestions and ranking queries."""

from pyspark.sql import functions as F

from capsule import fixed
from capsule.catalog import oracle as o
from capsule.catalog.looks_sql import LOOKS
from capsule.catalog.evaluation import VERDICT
from capsule.catalog.registry import joined, query
from capsule.functions import urls, words
from capsule.operators import attributes as at
from capsule.operators import extract, filters, listings, ranking
from capsule.sources.staging import stage

col = F.col
PARTS = o.with_(o.PARTS)
HINTS = [("|".join(w), c) for w, c in fixed.CATEGORY_HINTS]


def hint(x: str) -> str:
    return o.rules(x, HINTS)


def alternatives(ws) -> str:
    return "|".join(sorted(ws, key=len, reverse=True))


def color_of(x: str) -> str:
    """Longest colour word of a text: one test per word, longest first."""
    ranked = sorted(fixed.COLOR_WORDS, key=len, reverse=True)
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '(^|[^a-z]){w}($|[^a-z])') THEN '{fixed.COLOR_WORDS[w]}'" for w in ranked) + " END"


# ------------------------------------------------------------------ urls and pages
HOST = "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\\.', '')"
PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


@query("page_urls", "URL-1", "FLT-7", "FLT-8",
       sql=f"""SELECT page_id, {HOST} AS host, {HOST} IN {o.in_list(fixed.NON_SHOPPING_HOSTS)}
           OR regexp_matches({HOST} || '.', {o.q(fixed.EDITORIAL_HOST)}) OR regexp_matches({PATH}, {o.q(fixed.EDITORIAL_PATH)}) AS non_shopping,
         regexp_matches(url, {o.q(fixed.BAD_LANDING)}) OR trim({PATH}, '/') = '' AS bad_landing,
         regexp_matches(url, {o.q(fixed.BAD_LANDING_STRICT)}) OR {PATH} IN ('', '/') AS bad_strict FROM pages""")
def _(t):
    u = col("url")
    return t.pages.select("page_id", urls.host(u).alias("host"), urls.is_non_shopping(u).alias("non_shopping"),
                          urls.is_bad_landing(u).alias("bad_landing"), urls.is_bad_landing_strict(u).alias("bad_strict"))


@query("url_cleanup", "URL-2",
       sql=f"""SELECT page_id, CASE WHEN page_id % 5 = 1 THEN NULL WHEN page_id % 5 = 2 THEN NULL
           ELSE CASE WHEN page_id % 5 = 3 THEN 'https://' ELSE regexp_extract(url, '^([a-z]+://)', 1) END || regexp_extract(url, '^[a-z]+://([^#]*)', 1) END AS url,
         CASE page_id % 5 WHEN 1 THEN 'Only standard web links are supported (no custom ports).'
           WHEN 2 THEN 'Only web links (http or https) are supported.' END AS error FROM pages""")
def _(t):
    k = col("page_id") % 5
    raw = (F.when(k == 1, F.regexp_replace("url", "^([a-z]+://[^/]*)", "$1:8080")).when(k == 2, F.concat(F.lit("mailto:"), "url"))
           .when(k == 3, F.regexp_replace("url", "^[a-z]+://", " ")).otherwise(F.col("url")))
    c = listings.urls.classify_url(raw)
    return t.pages.select("page_id", c["url"].alias("url"), c["error"].alias("error"))


@query("variant_links", "URL-3", "URL-4", "TXT-4",
       sql=PARTS + """SELECT part, CASE WHEN part % 3 = 0 THEN CASE primary_color WHEN 'light blue' THEN 'light blue' ELSE primary_color END END AS color,
         CASE WHEN part % 2 = 0 THEN part::VARCHAR END AS variant, 'https://s.example.com/products/p-' || part || '.js' AS js FROM parts""")
def _(t):
    q = F.concat(F.when(col("part") % 2 == 0, F.concat(F.lit("variant="), "part", F.lit("&"))).otherwise(""),
                 F.when(col("part") % 3 == 0, F.concat(F.lit("Color="), F.replace("primary_color", F.lit(" "), F.lit("-")))).otherwise("x=1"))
    u = F.concat(F.lit("https://s.example.com/products/p-"), "part", F.lit("?"), q)
    return t.parts().select("part", urls.variant_color(u).alias("color"), urls.variant_id(u).alias("variant"),
                            urls.product_json_url(u).alias("js"))


@query("page_titles", "EXT-1", "TXT-8",
       sql="""SELECT page_id, x AS title FROM (
         SELECT page_id, replace(replace(replace(replace(replace(trim(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS x FROM pages)""")
def _(t):
    return t.pages.select("page_id", extract.page_titles(col("html")).alias("title"))


def _product_pages(t):
    """Pages with product data of a part put into their head."""
    p = t.parts()
    n = t.part.agg(F.count("*")).scalar()
    pages = t.pages.withColumn("part", col("page_id") % n)
    j = pages.join(p.select("part", "label", "brand", "primary_color", "category", col("estimated_price_usd").alias("est")), "part")
    name = F.concat(col("label"), F.lit(" "), col("part").cast("string"))
    ld = F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.array(
        F.to_json(F.struct(F.lit("Thing").alias("@type")))).alias("ignored"),
        F.struct(F.lit("Product").alias("@type"), name.alias("name"), F.struct(col("brand").alias("name")).alias("brand"),
                 F.struct((col("part") % 90 + 10.5).alias("price"), F.when(col("part") % 4 == 0, "EUR").otherwise("USD").alias("priceCurrency")).alias("offers"),
                 col("primary_color").alias("color"), F.concat(F.lit("/img/"), col("part").cast("string"), F.lit(".jpg")).alias("image")).alias("mainEntity")))
    meta = F.concat(F.lit('<meta property="og:title" content="Meta '), col("part").cast("string"),
                    F.lit('"><meta property="product:price:amount" content="'), (col("part") % 70 + 5).cast("string"),
                    F.lit('.00"><meta property="og:image" content="https://cdn.example.com/'), col("part").cast("string"), F.lit('.png">'))
    block = F.when(col("part") % 2 == 0, F.concat(F.lit('<script type="application/ld+json">'), ld, F.lit("</script>"))).otherwise(meta)
    return j.withColumn("html", F.replace("html", F.lit("</head>"), F.concat(block, F.lit("</head>"))))


_PP = o.PARTS + """, pp AS (SELECT page_id, url, parts.* FROM pages JOIN parts ON part = page_id % (SELECT count(*) FROM part))"""


@query("product_pages", "EXT-2", "EXT-3", "EXT-4", "EXT-5", "EXT-6",
       sql=o.with_(_PP) + """SELECT page_id, CASE WHEN part % 2 = 0 THEN label || ' ' || part ELSE 'Meta ' || part END AS name,
         CASE WHEN part % 2 = 0 THEN brand END AS brand, CASE WHEN part % 2 = 0 THEN CASE WHEN part % 4 <> 0 THEN part % 90 + 10.5 END ELSE part % 70 + 5 END::DOUBLE AS price,
         CASE WHEN part % 4 = 0 THEN 'EUR' WHEN part % 2 = 0 THEN 'USD' END AS currency, CASE WHEN part % 2 = 0 THEN primary_color END AS color,
         CASE WHEN part % 2 = 0 THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/img/' || part || '.jpg' ELSE 'https://cdn.example.com/' || part || '.png' END AS image,
         part % 2 = 0 AS product_page FROM pp""")
def _(t):
    pages = _product_pages(t)
    info = extract.product_info(pages)
    is_product = pages.select("page_id", extract.is_product_page(col("html")).alias("product_page"))
    return info.join(is_product, "page_id").select("page_id", "name", "brand", "price", "currency", "color",
                                                   F.get("images", 0).alias("image"), "product_page")


def _storefronts(t):
    p = t.parts()
    k = col("part")
    variant = [F.struct((k * 10 + i).cast("string").alias("id"), (k * 100 + i).cast("string").alias("price"),
                        F.lit(s).alias("option1"), F.element_at(F.array("primary_color", F.lit("ash")), i + 1).alias("option2"))
               for i, s in enumerate(("S", "M"))]
    js = F.to_json(F.struct(col("label").alias("title"), F.lit(" Shop ").alias("vendor"), F.array(F.lit("Size"), F.lit("Color")).alias("options"),
                            F.array(*variant).alias("variants"), F.array(F.lit("//cdn.example.com/a.jpg"), F.lit("/b.jpg")).alias("images")))
    u = F.concat(F.lit("https://s.example.com/products/p-"), k.cast("string"), F.when(k % 3 == 0, F.concat(
        F.lit("?variant="), (k * 10 + 1).cast("string"))).otherwise(""))
    return p.select(k.alias("page_id"), u.alias("url"), js.alias("js"), F.lit("<title>x</title>").alias("html"))


@query("storefront_listings", "EXT-7", "EXT-8",
       sql=PARTS + """SELECT part AS page_id, label AS title, 'Shop' AS brand, 's.example.com' AS retailer,
         CASE WHEN part % 3 = 0 THEN part + 0.01 WHEN part > 0 THEN part END::DOUBLE AS price,
         CASE WHEN part % 3 = 0 THEN 'ash' ELSE primary_color END AS color, 'https://cdn.example.com/a.jpg|https://s.example.com/b.jpg' AS images, 'shopify' AS source FROM parts""")
def _(t):
    s = _storefronts(t)
    out = extract.listings(extract.product_info(s), extract.storefront(s))
    return out.select("page_id", "title", "brand", "retailer", "price", "color", joined(col("images")).alias("images"), "source")


def _answers(t):
    """Model-like answers: prose, a fence, an array with a trailing comma and a citation mark per group of parts."""
    p = t.parts()
    item = F.concat(F.lit('{"name": "'), col("label"), F.lit(" "), col("part").cast("string"), F.lit(' [1]", "price": "$'),
                    (col("part") % 200 + 1).cast("string"), F.lit('.50", "product_url": "https://st'), (col("part") % 5).cast("string"),
                    F.lit(".example.com/p/"), col("part").cast("string"), F.lit('", "retailer": "St'), (col("part") % 5).cast("string"),
                    F.lit(' Shop", "category": "'), col("category"), F.lit('", "why": "né '), col("pattern"), F.lit('", "formality": '), (col("part") % 5 + 1).cast("string"),
                    F.lit(', "style_tags": ["'), F.get("style_tags", 0), F.lit('", "", "x"]}'))
    rows = p.select((F.floor(col("part") / 8)).alias("response_id"), F.struct("part", item.alias("j")).alias("s"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda e: e["j"]), ", ")
    return rows.groupBy("response_id").agg(F.concat(F.lit("Voilà [see] these:\n```json\n["), body, F.lit(",]\n```\nEnjoy.")).alias("text"))


@query("answer_products", "EXT-9", "TXT-7", "UDTF-1",
       sql=PARTS + """SELECT part // 8 AS response_id, part % 8 AS pos, label || ' ' || part AS name, (part % 200 + 1.5)::DOUBLE AS price,
         'https://st' || part % 5 || '.example.com/p/' || part AS product_url, 'St' || part % 5 || ' Shop' AS retailer, category,
         (part % 5 + 1)::INT AS formality, style_tags[1] || '|x' AS style_tags FROM parts""")
def _(t):
    return extract.products(_answers(t)).select("response_id", col("pos").cast("bigint").alias("pos"), "name", "price", "product_url", "retailer", "category",
                                                 "formality", joined(col("style_tags")).alias("style_tags"))


@query("answer_reasons", "EXT-10",
       sql=PARTS + "SELECT part // 8 AS response_id, label || ' ' || part AS name, 'né ' || pattern AS why FROM parts")
def _(t):
    return extract.phrases(extract.products(_answers(t)))


@query("citations", "JN-9", "JN-10", "EXT-12",
       sql=PARTS + """SELECT part // 8 AS response_id, part % 8 AS pos, chunk AS chunk_pos, CASE WHEN chunk = part % 8 THEN 'span' ELSE 'retailer' END AS via
         FROM parts, (SELECT unnest(range(8)) AS chunk) WHERE chunk = part % 8 OR (chunk < 5 AND chunk = part % 5)""")
def _(t):
    p = extract.products(_answers(t))
    # the metadata of an answer: a support for each product's place, the first without a start
    place = F.struct(F.when(col("pos") > 0, col("start_byte") + 2).alias("start_index"), (col("end_byte") - 2).alias("end_index"))
    support = F.struct("pos", F.struct(place.alias("segment"), F.array("pos").alias("chunk_indices")).alias("s"))
    page = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct(F.struct(
        F.concat(F.lit("redirect/"), i.cast("string")).alias("uri"), F.lit("page").alias("title"),
        F.when(i < 5, F.concat(F.lit("st"), i.cast("string"), F.lit("shop.example.com"))).alias("domain")).alias("web")))
    responses = p.groupBy("response_id").agg(F.sort_array(F.collect_list(support)).alias("places")).select(
        "response_id", F.to_json(F.struct(page.alias("chunks"), F.transform("places", lambda x: x["s"]).alias("supports"))).alias("metadata"))
    chunks, supports = extract.grounding(responses)
    return extract.citations(p, supports, chunks).select("response_id", col("pos").cast("bigint").alias("pos"),
                                                         col("chunk_pos").cast("bigint").alias("chunk_pos"), "via")


# ------------------------------------------------------------------ text
@query("text_words", "TXT-1", "TXT-3", "TXT-5", "TXT-9", "TXT-11",
       sql=PARTS + f"""SELECT part, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(d, '[a-z0-9]+'),
           lambda w: length(w) >= 3 AND NOT list_contains({o.items(fixed.STOP_WORDS)}, w)))), ' ') AS tokens,
         {color_of('d')} AS color, CASE WHEN gender = 'womens' THEN 'womens' WHEN gender = 'mens' THEN 'mens' END AS said,
         CASE WHEN brand IS NULL THEN '' ELSE 'bran' END AS token,
         CASE {' '.join(f"WHEN regexp_matches(d, '(^|[^a-z]){w}($|[^a-z])') THEN '{w}'" for w in fixed.MATERIAL_WORDS)} END AS material,
         coalesce(CASE {' '.join(f"WHEN regexp_matches(d, '(^|[^a-z]){w}($|[^a-z])') THEN '{v}'" for w, v in fixed.PATTERN_WORDS.items())} END, 'solid') AS pattern
         FROM (SELECT *, lower(description || ' ' || primary_color || ' for ' || CASE gender WHEN 'womens' THEN 'women''s' WHEN 'mens' THEN 'men''s' ELSE 'all' END) AS d FROM parts)""")
def _(t):
    who = F.when(col("gender") == "womens", "women's").when(col("gender") == "mens", "men's").otherwise("all")
    d = F.lower(F.concat_ws(" ", "description", "primary_color", F.lit("for"), who))
    p = t.parts().withColumn("d", d)
    tok = words.tokens(F.regexp_replace("d", "'s", " s"))
    return p.select("part", F.array_join(F.array_sort(tok), " ").alias("tokens"), words.longest_color(col("d")).alias("color"),
                    words.gender_words(col("d")).alias("said"), words.store_token(col("brand")).alias("token"),
                    listings.title_material(col("d")).alias("material"), listings.title_pattern(col("d")).alias("pattern"))


@query("category_hints", "TXT-2",
       sql=f"SELECT doc_id, {hint('lower(text)')} AS hint FROM documents")
def _(t):
    return t.documents.select("doc_id", words.category_hint(col("text")).alias("hint"))


@query("document_colors", "TXT-3", "TXT-4",
       sql=f"SELECT doc_id, {color_of('lower(text)')} AS longest FROM documents")
def _(t):
    return t.documents.select("doc_id", words.longest_color(F.lower("text")).alias("longest"))


@query("clean_titles", "TXT-6",
       sql=PARTS + "SELECT part, label AS title FROM parts")
def _(t):
    b = F.coalesce(col("brand"), F.lit("Acme"))
    raw = F.concat(b, F.lit("® "), "label", F.lit(" | COLLECTIONS | "), b, F.lit("®"))
    return t.parts().select("part", words.clean_title(raw, b, F.lit("Shop &amp; Co")).alias("title"))


@query("template_labels", "TXT-15",
       sql=o.with_(LOOKS) + """SELECT template, CASE template WHEN 'top+bottom' THEN 'Top + Bottom' ELSE
         array_to_string(list_transform(string_split(template, '+'), lambda p: upper(p[1]) || p[2:]), ' + ') END AS label, count(*) AS n FROM looks GROUP BY ALL""")
def _(t):
    return t.evaluation().outfits.groupBy("template", words.template_label(col("template")).alias("label")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ stores and intake
@query("blocked_stores", "FLT-6",
       sql="""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'blocked store (jcrew.com)' WHEN 1 THEN 'blocked store (J.Crew)' WHEN 2 THEN 'blocked store (J.Crew)' END AS why FROM supplier""")
def _(t):
    k = col("s_suppkey") % 5
    link = F.when(k == 0, "https://factory.jcrew.com/p/1").when(k == 3, "https://notjcrew.com/p").otherwise("https://gap.com/p")
    brand = F.when(k == 1, F.concat(F.lit("J. Crew "), "s_name")).otherwise(col("s_name"))
    title = F.when(k == 2, F.concat(F.lit("Ludlow by J.Crew "), "s_name")).otherwise(col("s_name"))
    return t.supplier.select("s_suppkey", listings.blocked_store([link], [brand], [title]).alias("why"))


def _links(t):
    k = col("part") % 6
    slug = F.replace("label", F.lit(" "), F.lit("-"))
    url = (F.when(k == 0, "https://www.youtube.com/watch?v=1").when(k == 1, "https://shop.example.com/search?q=x")
           .when(k == 2, F.concat(F.lit("https://shop.example.com/products/"), slug)).when(k == 3, "https://shop.example.com/p/1")
           .when(k == 4, F.concat(F.lit(f"https://{fixed.REDIRECT_HOST}/r/"), "part")).otherwise(F.concat(F.lit("https://shop.example.com/p/"), slug)))
    title = F.when(k == 3, F.concat(F.lit("Buy "), "label")).when(k == 5, "Nothing here").otherwise("")
    return t.parts().select("*", url.alias("url"), title.alias("page_title"), F.when(k == 2, 403).otherwise(200).alias("link_status"))


@query("link_verdicts", "FLT-9", "SET-6",
       sql=PARTS + """SELECT part, part % 6 IN (2, 3, 5) AS ok, CASE part % 6 WHEN 0 THEN 'not a store page (youtube.com)' WHEN 1 THEN 'search / error page'
         WHEN 4 THEN 'grounding redirect didn''t resolve' WHEN 5 THEN 'page doesn''t mention the product' ELSE '' END AS reason FROM parts""")
def _(t):
    p = _links(t)
    v = listings.link_verdict(col("url"), col("link_status"), col("page_title"), name=col("label"), brand=col("brand"),
                              retailer=F.lit("Shop"), subcategory=col("subcategory"), category=col("category"))
    return p.select("part", v["ok"].alias("ok"), v["reason"].alias("reason"))


@query("listing_vetting", "FLT-10", "FLT-11",
       sql=PARTS + f"""SELECT part, CASE part % 7 WHEN 0 THEN 'product link broken' WHEN 1 THEN 'page isn''t a product page (no product data / add to cart)'
         WHEN 2 THEN 'page shows no price' WHEN 3 THEN 'store page blocks readers and the photo isn''t from the store'
         WHEN 4 THEN 'only on-model / lifestyle photos (no photo of the item alone)'
         ELSE CASE WHEN h IS NULL THEN 'page doesn''t say it''s ' || {o.case('category', fixed.CATEGORY_PLURALS)} WHEN h <> category THEN 'page is for ' || h || ', not ' || category END END AS reason
         FROM (SELECT *, {hint("lower(label || ' p ' || part)")} AS h FROM parts)""")
def _(t):
    k = col("part") % 7
    p = t.parts().select(
        "part", "category", col("label").alias("name"), "brand", F.lit("Everlane").alias("retailer"),
        F.when(k == 0, False).when(k != 3, True).alias("link_ok"), (k != 1).alias("product_page"), col("label").alias("page_name"),
        F.when(k != 2, 10.0).alias("page_price"), F.array().cast("array<string>").alias("page_types"),
        F.lit("https://pics.example.com/1.jpg").alias("image"), F.when(k == 4, "on_model").otherwise("product_only").alias("photo_kind"),
        F.concat(F.lit("https://everlane.com/p/"), "part").alias("product_url"))
    return p.select("part", listings.vet(p).alias("reason"))


@query("listing_intake", "FLT-12", "CMB-12", "WIN-6",
       sql=o.with_(o.CLOSET, o.CANDIDATES) + f"""
       , slots(cat, s) AS (VALUES {', '.join(f"('{c}', {o.items(s)})" for c, s in fixed.PAIRING_SLOTS.items())}),
       j AS (SELECT c.item_id, p.part, p.category AS slot, CASE WHEN p.part % 7 = 1 THEN NULL ELSE p.part END AS price, c.gender AS cg, p.gender AS pg,
           list_filter(s, lambda x: NOT (c.gender = 'mens' AND x = 'dress')) AS s, p.label
         FROM candidate_items c JOIN parts p ON p.part // 40 = c.part // 40 JOIN slots ON cat = c.category),
       r AS (SELECT *, CASE WHEN NOT list_contains(s, slot) THEN 'category ' || slot || ' doesn''t pair'
           WHEN cg IN ('mens', 'womens') AND pg IN ('mens', 'womens') AND cg <> pg THEN pg || ' item' WHEN price IS NULL THEN 'no price' END AS reason FROM j)
       SELECT item_id, part, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY item_id, label, reason IS NULL ORDER BY part) > 1 THEN 'listed twice' END) AS reason FROM r""")
def _(t):
    none = F.lit(None).cast("string")
    c = t.candidates().select("item_id", col("category").alias("cand_category"), col("gender").alias("cand_gender"), F.floor(col("part") / 40).alias("g"),
                              listings.pairing_slots(col("category"), col("gender")).alias("slots"))
    p = t.parts().select("part", "gender", F.floor(col("part") / 40).alias("g"), F.when(col("part") % 7 != 1, col("part").cast("double")).alias("price"),
                         listings.product_category(col("category"), col("subcategory"), F.lit("x")).alias("slot"),
                         filters.is_accessory(col("category"), col("subcategory"), none).alias("accessory"), words.store_key(col("label")).alias("key"))
    # what a product says by itself is found once, and written: it is not found again for every candidate
    j = c.join(stage(p, "products"), "g")
    r = j.withColumn("reason", listings.intake_reason(
        F.lit("pairings"), col("slot"), col("cand_category"), col("slots"), col("cand_gender"), col("gender"), col("price"), none, col("accessory")))
    return listings.first_seen(r, col("key"), ["item_id"], ["part"], "reason").select("item_id", "part", "reason")


@query("page_repeats", "WIN-6",
       sql="""SELECT page_id, CASE WHEN row_number() OVER (PARTITION BY regexp_replace(regexp_replace(lower(url), '[?#].*$', ''), '/+$', '') ORDER BY page_id) > 1
         THEN 'listed twice' END AS reason FROM (SELECT page_id, regexp_replace(url, '^([^0-9]*)[0-9]+', '\\1') AS url FROM pages)""")
def _(t):
    """Pages that lead to one address, told apart by a number only."""
    p = t.pages.select("page_id", F.regexp_replace("url", "^([^0-9]*)[0-9]+", "$1").alias("url"), F.lit(None).cast("string").alias("reason"))
    return listings.first_seen(p, urls.page_key(col("url")), [], ["page_id"], "reason").select("page_id", "reason")


@query("cached_cleaning", "FLT-15",
       sql=PARTS + f"""SELECT part // 10 AS g, count(*) FILTER (regexp_extract(part_name, '([a-z]+)[^a-z]*$', 1) NOT IN {o.in_list(fixed.ACCESSORY_WORDS)}
           AND part % 9 <> 0) AS kept FROM parts GROUP BY ALL""")
def _(t):
    p = t.parts().select(F.floor(col("part") / 10).alias("g"), F.struct(col("part_name").alias("name"), F.when(
        col("part") % 9 == 0, "J.Crew").otherwise("Gap").alias("brand")).alias("s")).groupBy("g").agg(F.collect_list("s").alias("l"))
    none = F.lit(None).cast("string")
    kept = listings.clean_cached(col("l"), accessory=lambda s: filters.is_accessory(none, s["name"], none),
                                 blocked=lambda s: listings.blocked_name(s["brand"]))
    return p.select("g", F.size(kept).cast("bigint").alias("kept"))


@query("listing_attributes", "PRJ-9",
       sql=PARTS + """SELECT part, subcategory, primary_color, CASE WHEN part % 3 = 0 THEN 'solid' ELSE pattern END AS pattern,
         CASE WHEN part % 4 = 0 THEN formality WHEN part % 4 = 1 THEN 5 ELSE 2 END::INT AS formality, CASE WHEN part % 3 = 0 THEN 'womens' ELSE gender END AS gender FROM parts""")
def _(t):
    k = col("part")
    p = t.parts().select("part", "category", "subcategory", col("primary_color").alias("color"), F.when(k % 3 != 0, col("pattern")).alias("pattern"),
                         "material", F.when(k % 4 == 0, "x").when(k % 4 == 1, "17").when(k % 4 == 2, "2").otherwise("2.0").alias("formality"),
                         F.when(k % 3 != 0, col("gender")).otherwise("kids").alias("gender"), col("formality").alias("cand_formality"),
                         F.lit("womens").alias("cand_gender"), col("label").alias("name"))
    return at.attributes_from_listing(p).select("part", "subcategory", "primary_color", "pattern", "formality", "gender")


_LISTED = """n AS (SELECT max(p_partkey) + 1 AS n FROM part),
listed AS (SELECT o_orderkey AS photo, slot, label AS title, primary_color AS l_color, CASE WHEN slot = 0 THEN 19.5 END AS l_price
  FROM orders CROSS JOIN n JOIN (SELECT unnest(range(3)) AS slot) s ON slot <= o_orderkey % 3
  JOIN parts ON part = (o_orderkey * 7 + slot * 13) % n)"""


@query("best_detected", "JN-18", "PRJ-10",
       sql=o.with_(o.PARTS, _LISTED) + f""", said AS (SELECT *, {hint("lower(title)")} AS want FROM listed),
         scored AS (SELECT s.photo, s.slot, l_linenumber AS position, part,
             CASE WHEN want = category THEN 10 ELSE 0 END + CASE WHEN contains(lower(title), subcategory) THEN 5 ELSE 0 END
             + floor(l_quantity * 20000 / 250000)::INT AS fit FROM said s JOIN lineitem ON l_orderkey = s.photo JOIN parts ON part = l_partkey),
         best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY photo, slot ORDER BY fit DESC, position, part) = 1)
         SELECT s.photo, s.slot, b.position, b.part, b.fit, CASE WHEN b.part IS NOT NULL THEN coalesce(brand, 'Listed') END AS brand,
           CASE WHEN b.part IS NULL THEN NULL WHEN l_price IS NOT NULL AND coalesce(price, '') = '' THEN '19.5' ELSE price END AS price,
           CASE WHEN b.part IS NULL THEN NULL WHEN l_price IS NOT NULL AND coalesce(price, '') = '' THEN 'listing' ELSE price_source END AS price_source,
           CASE WHEN b.part IS NOT NULL THEN {color_of("lower(l_color)")} END AS primary_color
         FROM said s LEFT JOIN best b USING (photo, slot) LEFT JOIN parts p ON p.part = b.part""")
def _(t):
    """Order lines as detections of a photo; up to three listings pasted for it, each merged into the item it fits best."""
    n = t.part.agg(F.max("p_partkey") + 1).scalar()
    slots = t.orders.select(col("o_orderkey").alias("photo"), F.explode(F.sequence(F.lit(0).cast("long"), col("o_orderkey") % 3)).alias("slot"))
    titles = t.parts().select(col("part").alias("_p"), col("label").alias("l_title"), col("primary_color").alias("l_color"))
    listed = (slots.withColumn("_p", (col("photo") * 7 + col("slot") * 13) % n).join(titles, "_p").drop("_p")
              .withColumns({"l_type": F.lit(None).cast("string"), "l_brand": F.lit("Listed"), "l_price": F.when(col("slot") == 0, 19.5)}))
    box = F.array(F.lit(0), F.lit(0), (col("l_quantity") * 20).cast("int"), F.lit(1000))
    found = (t.lineitem.select(col("l_orderkey").alias("photo"), col("l_linenumber").alias("position"), col("l_partkey").alias("part"), box.alias("bbox"))
             .join(t.parts().select("part", "category", "subcategory", "brand", "price", "price_source", "primary_color"), "part").withColumn("source", F.lit("upload")))
    best = listings.best_detected(found, listed, ["slot"], ["position", "part"])
    merged = at.merge_listing(best.where("part is not null"))
    columns = ["photo", "slot", "position", "part", "fit", "brand", "price", "price_source", "primary_color"]
    return merged.select(columns).unionByName(best.where("part is null").select(columns))


@query("listing_merge", "PRJ-10",
       sql=PARTS + """SELECT part, coalesce(brand, 'Listed') AS brand, CASE WHEN coalesce(price, '') = '' THEN '19.5' ELSE price END AS price,
         CASE WHEN coalesce(price, '') = '' THEN 'listing' ELSE price_source END AS price_source, 'navy' AS primary_color,
         CASE WHEN category = 'bottom' THEN 10 ELSE 0 END + CASE WHEN subcategory = 'jeans' THEN 5 ELSE 0 END + 3 AS fit FROM parts""")
def _(t):
    p = t.parts().withColumns({"l_title": F.lit("Navy jeans"), "l_type": F.lit(""), "l_color": F.lit("Navy"), "l_brand": F.lit("Listed"),
                               "l_price": F.lit(19.5), "source": F.lit("upload"), "bbox": F.array(*[F.lit(x) for x in (0, 0, 1000, 900)])})
    p = listings.listing_words(p)
    return at.merge_listing(p.withColumn("fit", listings.listing_match(p))).select("part", "brand", "price", "price_source", "primary_color", "fit")


# ------------------------------------------------------------------ store search
def _plans(t):
    """Plan queries per customer: three wanted parts each; hits: parts offered by suppliers."""
    c = t.candidates().where(col("category").isin("top", "bottom", "shoes"))
    return c.select(col("user_id").alias("plan"), F.when(col("category") == "top", 0).when(col("category") == "bottom", 1).otherwise(2).alias("query_pos"),
                    col("category").alias("q_category"), col("subcategory").alias("q_subcategory"), col("primary_color").alias("q_color"),
                    F.lit("cotton").alias("q_material"), col("label").alias("query"), F.lit("womens").alias("cand_gender"),
                    F.floor(col("part") / 100).alias("g"))


def _hits(t):
    p = t.parts().select(F.floor(col("part") / 100).alias("g"), "part", F.concat_ws(" ", "label", "pattern").alias("title"), col("category").alias("type"),
                         F.array("gender").alias("tags"), F.concat(F.lit("h-"), "part").alias("handle"), (col("part") % 130 + 1).cast("string").alias("price"),
                         (col("part") % 17 != 0).alias("available"), (col("part") % 5).cast("int").alias("store_ord"), (F.floor(col("part") / 5) % 20).cast("int").alias("pos"))
    # the words of a hit and of a query are found once each, and written: they are not found again for every pair
    p, q = stage(listings.hit_words(p), "hits"), stage(listings.query_words(_plans(t)), "queries")
    j = q.join(p, "g").withColumns({"price_low": F.lit(5.0), "price_high": F.lit(120.0), "avoid_color": F.lit("black")})
    return listings.hit_relevance(j)


_HITS = o.with_(o.CLOSET, o.CANDIDATES) + f"""
, plans AS (SELECT user_id AS plan, CASE category WHEN 'top' THEN 0 WHEN 'bottom' THEN 1 ELSE 2 END AS query_pos, category AS q_category, subcategory AS q_sub,
    primary_color AS q_color, label AS query, part // 100 AS g FROM candidate_items WHERE category IN ('top', 'bottom', 'shoes')),
hits AS (SELECT part // 100 AS g, part, lower(label || ' ' || pattern) AS title, category AS type, gender, part % 130 + 1 AS price,
    part % 17 <> 0 AS available, part % 5 AS store, part // 5 % 20 AS pos, {hint("lower(label || ' ' || pattern || ' ' || category)")} AS guess, {color_of("lower(label || ' ' || pattern || ' ' || gender)")} AS hcolor FROM parts),
j AS (SELECT *, len(list_filter(CASE WHEN len(list_filter(string_split(replace(q_sub, '-', ' '), ' '), lambda w: length(w) > 2 AND w NOT IN ('top', 'shirt'))) > 0
    THEN list_filter(string_split(replace(q_sub, '-', ' '), ' '), lambda w: length(w) > 2 AND w NOT IN ('top', 'shirt')) ELSE [q_sub] END,
    lambda w: contains(title, w) OR contains(type, w))) > 0 AS typed FROM plans JOIN hits USING (g)),
scored AS (SELECT *, CASE WHEN NOT available THEN 'sold out' WHEN price NOT BETWEEN 5 AND 120 THEN 'price $' || price || ' outside $5-$120'
    WHEN regexp_matches(' ' || title || ' ', '{alternatives(fixed.NEGATIVE_WORDS)}') THEN 'not a garment' WHEN gender = 'mens' AND regexp_matches(title || ' ' || type || ' mens', '\\bmens\\b') THEN 'mens item'
    WHEN guess <> q_category THEN 'looks like ' || guess WHEN NOT typed AND guess IS NULL THEN 'type not in title'
    WHEN hcolor = 'black' THEN 'same color (black) as the item you''re skipping' END AS reason,
  CASE WHEN typed THEN 3 ELSE 0 END + CASE WHEN hcolor IS NULL THEN 0 WHEN hcolor = q_color THEN 2 ELSE -2 END
    + 0.5::DOUBLE * len(list_filter(string_split(query, ' '), lambda w: length(w) > 2 AND contains(title, w))) AS score FROM j)
"""


@query("hit_relevance", "TXT-10", "TXT-11", "JN-11",
       sql=_HITS + "SELECT plan, query_pos, part, reason, CASE WHEN reason IS NULL THEN score END::DOUBLE AS score FROM scored")
def _(t):
    return _hits(t).select("plan", "query_pos", "part", "reason", F.when(col("reason").isNull(), col("score")).alias("score"))


@query("store_spread", "TOP-6", "TOP-9")
def _(t):
    h = _hits(t).where(col("reason").isNull() & (col("score") >= 0))
    s = h.select("plan", "query_pos", col("store_ord").cast("string").alias("store"), col("handle").alias("product"),
                 listings.placed_score(col("score"), col("pos")).alias("score"), (col("store_ord") * 1000 + col("pos")).alias("ord"))
    return ranking.spread_over_stores(s, ["plan"])


@query("plan_stores", "JN-11",
       sql=f"""SELECT c_custkey, count(*) AS stores FROM customer, (VALUES {', '.join(str((d, n, g)) if "'" not in n else '' for d, n, g in fixed.STORES)}) s(d, n, g)
         WHERE contains(g, CASE WHEN c_custkey % 2 = 0 THEN 'w' ELSE 'm' END) GROUP BY c_custkey""")
def _(t):
    stores = F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(n).alias("store"), F.lit(g).alias("genders")) for d, n, g in fixed.STORES])
    who = F.when(col("c_custkey") % 2 == 0, "w").otherwise("m")
    each = t.customer.select("c_custkey", F.explode(F.filter(stores, lambda s: F.contains(s["genders"], who))).alias("s"))
    return each.groupBy("c_custkey").agg(F.count("*").alias("stores"))


# ------------------------------------------------------------------ picks
def _scored(t):
    return t.evaluation().results.where(col("n_outfits") > 0)


_PICKS = VERDICT + """, sc AS (SELECT v.item_id, v.user_id, v.category, v.n, v.score, v.decision, l.best FROM verdicts v JOIN per_look l USING (item_id) WHERE v.level <> 'near_duplicate'),
  gp AS (SELECT *, part // 10 AS shop FROM sc JOIN (SELECT item_id, part FROM candidate_items) USING (item_id))"""


@query("gap_picks", "WIN-3", "TOP-4",
       sql=o.with_(_PICKS) + """
       , r AS (SELECT *, row_number() OVER (PARTITION BY shop, category ORDER BY n DESC, score DESC, round(best, 9) DESC, item_id) AS r FROM gp),
       p AS (SELECT *, row_number() OVER (PARTITION BY shop ORDER BY least(r, 3), n DESC, score DESC, round(best, 9) DESC, item_id) AS pos FROM r),
       k AS (SELECT * FROM p WHERE (r <= 2 AND pos <= 5) OR (r > 2 AND pos <= 3))
       SELECT shop, item_id, row_number() OVER (PARTITION BY shop ORDER BY n DESC, score DESC, round(best, 9) DESC, item_id) AS rank FROM k""")
def _(t):
    s = _scored(t).where(col("redundancy_level") != "near_duplicate").withColumn("shop", F.floor(col("part") / 10))
    order = [col("n_outfits").desc(), col("score").desc(), F.round("best_outfit", 9).desc(), col("item_id")]
    return ranking.varied_picks(s, ["shop"], order).select("shop", "item_id", col("rank").cast("bigint").alias("rank"))


@query("pairing_picks", "WIN-4", "TOP-3",
       sql=o.with_(_PICKS) + """
       , r AS (SELECT *, row_number() OVER (PARTITION BY shop, category ORDER BY n DESC, score DESC, item_id) AS r FROM gp WHERE decision = 'BUY')
       SELECT shop, item_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY shop ORDER BY CASE WHEN r <= 2 THEN 1 ELSE 2 END, n DESC, score DESC, item_id) AS rank FROM r) WHERE rank <= 3""")
def _(t):
    s = _scored(t).where((col("redundancy_level") != "near_duplicate") & (col("decision") == "BUY")).withColumn("shop", F.floor(col("part") / 10))
    order = [col("n_outfits").desc(), col("score").desc(), col("item_id")]
    return ranking.filled_picks(s, ["shop"], order).select("shop", "item_id", col("rank").cast("bigint").alias("rank"))


@query("alternative_picks", "TOP-2", "TOP-8",
       sql=o.with_(_PICKS) + """
       , a AS (SELECT v.item_id, c.part // 10 AS shop, CASE WHEN v.level = 'near_duplicate' THEN 'near-duplicate of your ' || i.primary_color || ' ' || i.subcategory
           WHEN v.n = 0 THEN 'forms no outfits with your closet' WHEN NOT (v.n > 5 OR v.score > 60) THEN 'doesn''t beat the considered item' END AS reason,
           CASE v.decision WHEN 'BUY' THEN 2 WHEN 'CONSIDER' THEN 1 ELSE 0 END AS dr, v.score, v.n
         FROM verdicts v JOIN candidate_items c USING (item_id) LEFT JOIN closet_items i ON i.item_id = v.other)
       SELECT item_id, shop, CASE WHEN reason IS NULL AND rk <= 3 THEN rk END AS rank, coalesce(reason, CASE WHEN rk > 3 THEN 'ranked below the top 3' END) AS reason
       FROM (SELECT *, row_number() OVER (PARTITION BY shop, reason IS NULL ORDER BY dr DESC, score DESC, n DESC, item_id) AS rk FROM a)""")
def _(t):
    s = t.evaluation().results.withColumns({
        "shop": F.floor(col("part") / 10), "similarity_to_candidate": F.lit(None).cast("double"), "cand_color": F.lit(""),
        "color": col("primary_color"), "cand_n_outfits": F.lit(5), "cand_score": F.lit(60), "with_candidate": F.lit(0)})
    s = s.withColumn("reason", ranking.reject_reason(F.lit("alternatives"), duplicate_threshold=F.lit(0.88)))
    order = [ranking.decision_rank(col("decision")).desc(), col("score").desc(), col("n_outfits").desc(), col("item_id")]
    picked = ranking.top(s.where(col("reason").isNull()), ["shop"], order, 3)
    out = ranking.keep_and_reject(s, picked, ["shop", "item_id"], "ranked below the top 3")
    return out.select("item_id", "shop", col("rank").cast("bigint").alias("rank"), "reason")


@query("result_outfits", "TOP-5", "WIN-5",
       sql=o.with_(LOOKS) + f""", t AS (SELECT item_id, tord, count(*) AS n FROM looks GROUP BY ALL)
       SELECT item_id, tord AS template_ord, n, coalesce(sum(n) OVER (PARTITION BY item_id ORDER BY tord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM t""")
def _(t):
    g = t.evaluation().outfits.groupBy("item_id", "template_ord").agg(F.count("*").alias("n"))
    return ranking.running_offsets(g, ["item_id"], ["template_ord"])


@query("preset_choice", "TOP-7",
       sql="SELECT c_custkey, CASE WHEN x <= 0.375 THEN 'chill' WHEN x <= 0.6 THEN 'balanced' ELSE 'picky' END AS preset FROM (SELECT c_custkey, c_custkey % 9 / 8.0::DOUBLE AS x FROM customer)")
def _(t):
    return t.customer.select("c_custkey", ranking.nearest_preset(col("c_custkey") % 9 / 8.0).alias("preset"))


@query("photo_choice", "TOP-10",
       sql="""SELECT l_orderkey, arg_min(l_partkey, struct_pack(o := CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE 1 END, p := l_linenumber, k := l_partkey)) AS image
         FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey""")
def _(t):
    im = t.lineitem.select("l_orderkey", (col("l_linenumber") - 1).alias("pos"), col("l_partkey").alias("image"),
                           (col("l_suppkey") % 3 == 0).alias("product_only"), (col("l_returnflag") != "R").alias("usable"))
    return ranking.choose_photo(im, ["l_orderkey"]).select("l_orderkey", "image")


@query("settled_colors", "TXT-12",
       sql=PARTS + """SELECT part, CASE WHEN part % 4 = 0 THEN 'cream' WHEN part % 4 = 1 THEN 'black' ELSE primary_color END AS color,
         part % 4 IN (0, 1) AS verified FROM parts""")
def _(t):
    k = col("part") % 4
    c = listings.settle_color(col("primary_color"), F.when(k == 0, "Sail/Gum Yellow"), F.when(k == 1, "https://x.example.com/p?colour=jet"),
                              F.lit("Plain thing"), F.lit(None).cast("string"))
    return t.parts().select("part", c["color"].alias("color"), c["verified"].alias("verified"))


@query("headlines", "TXT-13", "VAL-19",
       sql=PARTS + f"""SELECT part, CASE WHEN part % 5 = 0 THEN {o.case('category', fixed.GAP_PHRASES)} WHEN part % 5 = 1 THEN 'Goes with jeans'
         WHEN part % 5 = 2 THEN 'A new ' || {o.case('category', fixed.CATEGORY_NOUN)} || ' to mix with your clothes'
         WHEN primary_color IN ('navy', 'black') THEN 'Works with a lot of what you own' ELSE 'A new color for your ' || {o.case('category', fixed.CATEGORY_PLURALS)} END AS reason,
         CASE WHEN category = 'top' THEN 'Boatneck Sweater' ELSE subcategory END AS type_text FROM parts""")
def _(t):
    k = col("part") % 5
    why = F.when(k == 1, "goes with  jeans.").when(k == 2, "olive adds depth").when(k == 3, "3 new looks")
    h = listings.headline(col("category"), k != 0, F.array(F.lit("navy"), F.lit("black")), why, col("primary_color"))
    kind = listings.title_type(F.lit("Boatneck Sweater"), col("subcategory"), col("category"))
    kind = F.when(col("category") == "outerwear", col("subcategory")).otherwise(kind)
    return t.parts().select("part", listings.honest_headline(h, col("category"), F.lit("navy")).alias("reason"), kind.alias("type_text"))


@query("suggestion_modes", "CMB-12",
       sql=o.with_(VERDICT) + "SELECT decision, CASE WHEN decision = 'BUY' THEN 'pairings' ELSE 'alternatives' END AS mode, count(*) AS n FROM verdicts GROUP BY ALL")
def _(t):
    return t.evaluation().results.groupBy("decision", listings.suggestion_mode(col("decision")).alias("mode")).agg(F.count("*").alias("n"))
