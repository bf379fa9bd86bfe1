"""HTML character references, all of them, as column expressions.

A text is cut at `&`; what follows is a number, a name, or neither. Names are looked up in a prefix table (first two
characters, then the whole name) that is folded into one constant; a name without `;` may also be the longest of those that
need none. The table is that of the standard library.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?"
NAME = r"^[^\t\n\f <&#;]{1,32};?"
LAST = 0x10FFFF


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with `value` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _table() -> Column:
    nested: dict[str, dict[str, str]] = {}
    for name, value in html5.items():
        nested.setdefault(name[:2], {})[name] = value
    return F.from_json(F.lit(json.dumps(nested)), "map<string,map<string,string>>")


#: Names that are read without `;`, longest first.
BARE = "^(?:" + "|".join(re.escape(n) for n in sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"


def _windows(n: int) -> str:
    try:
        return bytes([n]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(n)


def character(n: Column) -> Column:
    """The character of a numeric reference: some numbers mean others, some mean nothing."""
    special = F.create_map(*[F.lit(x) for b in range(0x80, 0xA0) for x in (b, _windows(b))])
    nothing = (n.between(0x1, 0x8) | n.between(0xE, 0x1F) | (n == 0xB) | (n == 0x7F) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE))
    plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return (F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > LAST), "�").when(n.between(0x80, 0x9F), F.try_element_at(special, n.cast("int")))
            .when(nothing, "").otherwise(plain))


def _numeric(p: Column) -> Column:
    def decoded(m: Column) -> Column:
        digits = F.regexp_replace(F.regexp_replace(m, "[#xX;]", ""), "^0+(?=.)", "")
        base16 = F.lower(F.substring(m, 2, 1)) == "x"
        n = (F.when(F.length(digits) > 7, F.lit(LAST + 1)).when(base16, F.conv(digits, 16, 10)).otherwise(digits)).cast("bigint")
        return F.when(m == "", F.concat(F.lit("&"), p)).otherwise(F.concat(_let(n, character), F.substr(p, F.length(m) + 1)))
    return _let(F.regexp_extract(p, NUMBER, 0), decoded)


def _named(p: Column, table: Column) -> Column:
    def value(name: Column) -> Column:
        return F.try_element_at(F.try_element_at(table, F.left(name, F.lit(2))), name)

    def decoded(m: Column) -> Column:
        def longest(bare: Column) -> Column:
            return F.when(bare != "", F.concat(value(bare), F.substr(p, F.length(bare) + 1)))
        return F.coalesce(F.concat(value(m), F.substr(p, F.length(m) + 1)), _let(F.regexp_extract(m, BARE, 0), longest), F.concat(F.lit("&"), p))
    return _let(F.regexp_extract(p, NAME, 0), decoded)


def unescape(text: Column) -> Column:
    """Text with every named and numeric character reference decoded, once."""
    table = _table()
    one = lambda p: F.when(F.startswith(p, F.lit("#")), _numeric(p)).otherwise(_named(p, table))

    def decoded(t: Column) -> Column:
        parts = _let(F.split(t, "&", -1), lambda x: F.concat(F.get(x, F.lit(0)), F.array_join(F.transform(F.slice(x, 2, F.size(x)), one), "")))
        return F.when(F.contains(t, F.lit("&")), parts).otherwise(t)
    return _let(text, decoded)
