"""URL expressions. Plain patterns rather than a URL parser: bad input gives NULL or '' and never fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from capsule import fixed
from capsule.functions.rules import filled, literal_array
from capsule.functions.words import blank, longest_color

_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"


def host(u: Column, *, strip_www: bool = True) -> Column:
    """Lower-case host without port and user info, '' when there is none."""
    authority = F.regexp_extract(blank(u), _AUTHORITY, 1)
    h = F.lower(F.regexp_extract(authority, r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1))
    return F.regexp_replace(h, r"^www\.", "") if strip_www else h


def path(u: Column) -> Column:
    p = F.regexp_extract(blank(u), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(p, ";[^/]*$", "")


def clean_url(u: Column) -> Column:
    """A web address without blanks and angle brackets around it, NULL when it is none."""
    t = F.trim(F.regexp_replace(F.trim(u), "^[<>]+|[<>]+$", ""))
    return F.when(t.rlike("^https?://"), t)


def classify_url(raw: Column) -> Column:
    """Struct(url, error): a pasted link normalised, or why it cannot be used."""
    t = F.trim(blank(raw))
    has_scheme = t.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://")
    other_scheme = t.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:") & ~t.rlike(r"^[^/:]+:\d")
    full = F.when(has_scheme, t).otherwise(F.concat(F.lit("https://"), F.regexp_replace(t, "^/+", "")))
    scheme = F.lower(F.regexp_extract(full, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.lower(F.regexp_extract(full, _AUTHORITY, 1))
    port = F.regexp_extract(authority, r":([^:@\]]*)$", 1)
    error = (F.when(t == "", "Paste a link to a product page.")
             .when(F.length(t) > 2048, "That link is too long.")
             .when(~has_scheme & other_scheme, "Only web links (http or https) are supported.")
             .when(~scheme.isin("http", "https"), "Only web links (http or https) are supported.")
             .when(host(full, strip_www=False) == "", "That doesn't look like a valid link.")
             .when(authority.contains("@"), "Links with a username or password aren't supported.")
             .when((port != "") & ~port.rlike(r"^\d{1,5}$"), "That doesn't look like a valid link.")
             .when(~port.isin("", "80", "443"), "Only standard web links are supported (no custom ports)."))
    rest = F.regexp_replace(F.regexp_replace(full, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "#.*$", "")
    rest = F.when(rest == "", "/").when(rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)
    url = F.when(error.isNull(), F.concat(scheme, F.lit("://"), authority, rest))
    return F.struct(url.alias("url"), error.alias("error"))


def on_domain(h: Column, domains) -> Column:
    """Host is one of the domains or below one of them."""
    alternatives = "|".join(d.replace(".", r"\.") for d in domains)
    return h.rlike(rf"(^|\.)({alternatives})$")


def is_non_shopping(u: Column) -> Column:
    h = host(u)
    return ((h == "") | on_domain(h, fixed.NON_SHOPPING_HOSTS)
            | F.concat(h, F.lit(".")).rlike(fixed.EDITORIAL_HOST) | path(u).rlike(fixed.EDITORIAL_PATH))


def is_bad_landing(u: Column) -> Column:
    """Search, error or home page."""
    return (F.coalesce(u, F.lit("")) == "") | u.rlike(fixed.BAD_LANDING) | path(u).rlike("^/*$")


def is_bad_landing_strict(u: Column) -> Column:
    return (F.coalesce(u, F.lit("")) == "") | u.rlike(fixed.BAD_LANDING_STRICT) | path(u).isin("", "/")


def variant_color(u: Column) -> Column:
    """Colour named by the first colour parameter of the query whose value holds a colour word."""
    query = F.regexp_extract(blank(u), r"\?([^#]*)", 1)
    pairs = F.transform(F.split(query, "&"), lambda p: F.struct(
        F.lower(F.regexp_extract(p, "^([^=]*)=", 1)).alias("k"), F.regexp_extract(p, "=(.*)$", 1).alias("v")))
    wanted = F.filter(pairs, lambda p: p["k"].isin(*fixed.VARIANT_COLOR_KEYS) & (p["v"] != ""))
    colors = F.transform(wanted, lambda p: longest_color(
        F.translate(F.lower(F.coalesce(F.try_url_decode(p["v"]), p["v"])), "-_+", "   ")))
    return F.get(F.filter(colors, lambda c: c.isNotNull()), 0)


def variant_id(u: Column) -> Column:
    return filled(F.regexp_extract(blank(u), r"[?&]variant=(\d+)", 1))


def product_json_url(u: Column) -> Column:
    """Storefront product JSON address of a `/products/<handle>` page, NULL for other pages."""
    handle = F.regexp_extract(path(u), r"^(.*?/products/[^/?#]+?)(?:\.js|\.json|\.oembed)?/?$", 1)
    origin = F.regexp_extract(blank(u), r"^((?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)", 1)
    return F.when(handle != "", F.concat(origin, handle, F.lit(".js")))


def page_key(u: Column) -> Column:
    """Address of the page itself: lower case, no query or fragment, no closing slash."""
    return F.regexp_replace(F.regexp_replace(F.lower(blank(u)), "[?#].*$", ""), "/+$", "")


def absolute(u: Column, base: Column) -> Column:
    """Address resolved against the page it stands on (scheme-relative, root-relative or sibling)."""
    t = F.trim(u)
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    return (F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), t)
            .when(t.startswith("//"), F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit(":"), t))
            .when(t.startswith("/"), F.concat(origin, t))
            .otherwise(F.concat(origin, folder, t)))


def trusted_host(h: Column) -> Column:
    return F.exists(literal_array(fixed.TRUSTED_IMAGE_HOSTS), lambda x: F.contains(h, x))
