"""Ordered rule tables compiled to one native expression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(c: Column) -> Column:
    """NULL for the empty string: an empty text counts as missing."""
    return F.when(c != "", c)


def first_match(texts: Sequence[Column], rules: Sequence[tuple[str, Any]], *, ignore_case: bool = True) -> Column:
    """Value of the first rule that matches, trying the texts in order (all rules on one text before the next)."""
    if not rules:
        return F.lit(None)
    prefix = "(?i)" if ignore_case else ""

    def one(text: Column) -> Column:
        chain = None
        for pattern, value in rules:
            hit = text.rlike(prefix + pattern)
            chain = F.when(hit, F.lit(value)) if chain is None else chain.when(hit, F.lit(value))
        return chain

    return F.coalesce(*[one(t) for t in texts])


def lookup(c: Column, table: Mapping[str, Any]) -> Column:
    """Value for a key out of a small fixed table, NULL when absent."""
    entries = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*entries), c)


def literal_array(values: Sequence[Any]) -> Column:
    return F.array(*[F.lit(v) for v in values])
