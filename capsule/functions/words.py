"""Text expressions: tokens, head words, dictionary words, categories, colours, titles."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from capsule import fixed
from capsule.functions.entities import unescape
from capsule.functions.rules import filled, literal_array, lookup


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def head_word(text: Column) -> Column:
    """Last run of letters of a short phrase, '' when there is none."""
    return F.regexp_extract(F.lower(blank(text)), "([a-z]+)[^a-z]*$", 1)


def tokens(text: Column) -> Column:
    """Distinct words of three characters or more that are no stop words."""
    plain = F.regexp_replace(F.lower(blank(text)), "'", "")
    words = F.regexp_extract_all(plain, F.lit("([a-z0-9]{3,})"), F.lit(1))
    return F.array_except(words, literal_array(fixed.STOP_WORDS))


def any_of(words: Iterable[str]) -> str:
    """Alternation of literal words, longest first so that the longest wins at one position."""
    ranked = sorted(words, key=len, reverse=True)
    return "|".join(re.escape(w).replace(r"\ ", " ").replace(r"\-", "-") for w in ranked)


def standalone(words: Iterable[str]) -> str:
    """Pattern for a dictionary word that is not part of a longer run of letters; group 1 is the word."""
    return f"(?<![a-z])({any_of(words)})(?![a-z])"


def first_listed(text: Column, words: Sequence[str]) -> Column:
    """First word of the list (list order, not text order) that stands in the text."""
    chain = None
    for w in words:
        hit = text.rlike(standalone([w]))
        chain = F.when(hit, F.lit(w)) if chain is None else chain.when(hit, F.lit(w))
    return chain


def longest_color(text: Column, colors: Mapping[str, str] = fixed.COLOR_WORDS) -> Column:
    """Simple colour of the longest dictionary word present; among equal lengths the one listed first."""
    ranked = sorted(colors, key=len, reverse=True)
    rank = {w: i for i, w in enumerate(ranked)}
    names = literal_array([colors[w] for w in ranked])
    found = F.regexp_extract_all(blank(text), F.lit(standalone(colors)), F.lit(1))
    best = F.array_min(F.transform(found, lambda w: lookup(w, rank)))
    return F.get(names, best)


def earliest_color(text: Column, colors: Mapping[str, str] | None = None) -> Column:
    """Simple colour of the first dictionary word in the text; the longest one where several start there."""
    table = dict(colors) if colors is not None else {**fixed.COLOR_WORDS, **fixed.VARIANT_COLOR_WORDS}
    word = filled(F.regexp_extract(F.lower(blank(text)), standalone(table), 1))
    return lookup(word, table)


def category_hint(text: Column) -> Column:
    """Category whose hint words occur anywhere in the text; hint groups are tried in order."""
    t = F.lower(blank(text))
    chain = None
    for words, category in fixed.CATEGORY_HINTS:
        hit = reduce(or_, [F.contains(t, F.lit(w)) for w in words])
        chain = F.when(hit, F.lit(category)) if chain is None else chain.when(hit, F.lit(category))
    return chain


def gender_words(text: Column) -> Column:
    """'womens' or 'mens' when exactly one of them is named."""
    women = text.rlike(r"\bwomen'?s?\b|\bfemale\b|\bladies\b")
    men = text.rlike(r"\bmen'?s?\b|\bmale\b")
    return F.when(women & ~men, F.lit("womens")).when(men & ~women, F.lit("mens"))


def category_key(c: Column) -> Column:
    """Free category values folded onto the five categories, else 'other'."""
    s = F.lower(F.trim(blank(c)))
    return (F.when(s.startswith("top") | s.isin("shirt", "t-shirt", "tee", "blouse", "sweater", "knit"), "top")
            .when(s.startswith("bottom") | s.isin("pants", "jeans", "skirt", "shorts", "trousers"), "bottom")
            .when(s.startswith("outer") | s.isin("jacket", "coat", "blazer"), "outerwear")
            .when(s.startswith("dress") | s.isin("jumpsuit", "one-piece", "onepiece"), "dress")
            .when(s.startswith("shoe") | s.isin("footwear", "sneakers", "boots"), "shoes")
            .otherwise("other"))


def template_label(t: Column) -> Column:
    parts = F.transform(F.split(t, r"\+"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))
    return F.coalesce(lookup(t, fixed.TEMPLATE_LABELS), F.array_join(parts, " + "))


def strip_tags(text: Column, limit: int | None = None) -> Column:
    """Text without tags, spaces folded; with a `limit`, cut at a word boundary with an ellipsis beyond it."""
    t = F.regexp_replace(blank(text), "<[^>]+>", " ")
    t = filled(F.trim(F.regexp_replace(unescape(t), r"[\s ]+", " ")))
    if limit is None:
        return t
    head = F.substring(t, 1, limit)
    cut = F.when(head.contains(" "), F.regexp_replace(head, r"(?s) [^ ]*$", "")).otherwise(head)
    return F.when(F.length(t) <= limit, t).when(t.isNotNull(), F.concat(cut, F.lit("…")))


def store_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(blank(c)), "[^a-z0-9]", "")


def store_token(c: Column, letters: int = 4) -> Column:
    """First letters or digits of a store name, by which hosts and titles are matched (fewer when it is shorter)."""
    return F.substring(store_key(c), 1, letters)


def price_in_text(c: Column) -> Column:
    """First amount in a text, thousands separators dropped; NULL for none or zero."""
    m = filled(F.regexp_extract(c.cast("string"), r"(\d{1,5}(?:[.,]\d{3})*(?:\.\d{1,2})?)", 1))
    v = F.replace(m, F.lit(","), F.lit("")).try_cast("double")
    return F.when(v > 0, v)


def clean_title(name: Column, brand: Column, retailer: Column) -> Column:
    """Product name without marks, store parts, generic parts and a leading brand."""
    bare = F.trim(F.regexp_replace(unescape(blank(name)), "[®™]", ""))
    store = F.array_union(tokens(retailer), tokens(brand))
    parts = F.filter(F.transform(F.split(bare, r"\s+[|–—-]\s+|\s*\|\s*"), lambda p: F.trim(p)), lambda p: p != "")
    own = F.filter(parts, lambda p: ~p.rlike(fixed.GENERIC_TITLE_PART)
                   & ~((F.size(tokens(p)) > 0) & (F.size(F.array_except(tokens(p), store)) == 0)))
    out = F.coalesce(F.get(own, 0), F.get(parts, 0), bare)
    names = F.array_sort(F.array(blank(brand), blank(retailer)),
                         lambda a, b: (F.length(b) - F.length(a)).cast("int"))
    for i in (0, 1):
        b = F.get(names, i)
        leads = ((b != "") & F.startswith(F.lower(out), F.concat(F.lower(b), F.lit(" ")))
                 & (F.length(out) > F.length(b) + 3))
        rest = F.regexp_replace(F.substr(out, F.length(b) + 1), "^[ :-]+|[ :-]+$", "")
        out = F.when(leads, rest).otherwise(out)
    return out
