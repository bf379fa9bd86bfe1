"""Boolean trigram queries from regular expressions.

A query is a list of clauses that must all hold; a clause is a list of alternatives of which one must hold; an
alternative is a set of trigrams that must all occur. Trigrams are in lower case, so a query may let through texts that
the expression rejects, never the reverse. An expression without a mandatory trigram has an empty query.
"""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser

Clause = list[frozenset[str]]
#: Strings that a part of an expression may stand for before it is cut there.
MOST_STRINGS = 64
#: Characters of a class that are still spelled out.
MOST_CHARACTERS = 4


def _grams(s: str) -> frozenset[str]:
    return frozenset(s[i:i + 3] for i in range(len(s) - 2))


def _clause(strings: set[str]) -> Clause | None:
    options = {_grams(s) for s in strings}
    if frozenset() in options:
        return None
    return sorted((o for o in options if not any(p < o for p in options)), key=sorted)


def _characters(items) -> set[str] | None:
    out: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < MOST_CHARACTERS:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_CHARACTERS else None


def _exact(items) -> set[str] | None:
    """All strings that a part may stand for, if they are few."""
    strings = {""}
    for kind, value in items:
        if kind is op.LITERAL:
            more = {chr(value).lower()}
        elif kind is op.IN:
            more = _characters(value)
        elif kind is op.SUBPATTERN:
            more = _exact(value[3])
        elif kind is op.BRANCH:
            parts = [_exact(x) for x in value[1]]
            more = None if None in parts else set().union(*parts)
        elif kind is op.MAX_REPEAT and value[1] <= 4:
            once = _exact(value[2])
            more = once and {"".join(x) for n in range(value[0], value[1] + 1) for x in _product(once, n)}
        else:
            more = None
        if more is None or len(strings) * len(more) > MOST_STRINGS:
            return None
        strings = {a + b for a in strings for b in more}
    return strings


def _product(options: set[str], n: int) -> list[tuple[str, ...]]:
    out: list[tuple[str, ...]] = [()]
    for _ in range(n):
        out = [(*x, o) for x in out for o in options]
        if len(out) > MOST_STRINGS:
            return out
    return out


def _clauses(items) -> list[Clause]:
    out: list[Clause] = []
    current = {""}

    def cut(then: set[str]) -> None:
        nonlocal current
        found = _clause(current)
        if found:
            out.append(found)
        current = then
    for item in items:
        kind, value = item
        strings = _exact([item])
        if strings is not None and len(current) * len(strings) <= MOST_STRINGS:
            current = {a + b for a in current for b in strings}
            continue
        cut(strings if strings is not None else {""})
        if strings is not None:
            continue
        if kind is op.SUBPATTERN:
            out += _clauses(value[3])
        elif kind is op.MAX_REPEAT and value[0]:
            out += _clauses(value[2])
    cut({""})
    return out


def query(pattern: str) -> list[Clause]:
    return _clauses(_parser.parse(pattern, re.ASCII))
