"""JSON values inside free text: where they are, what they hold, and where their records stand.

One pass over the text finds all bracket pairs. Outside brackets quotes mean nothing; inside, a string ends at its quote
or at the end of the line. A pair whose closing bracket does not fit drops what is open inside it, so a stray bracket in
prose costs nothing but itself.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

_MARK = re.compile(r'[\[\]{}"\n]')
_STRING_END = re.compile(r'(?:[^"\\\n]|\\.)*["\n]?')
_SPARE_COMMA = re.compile(r",(?=\s*[\]}])")
_PAIR = {"]": "[", "}": "{"}

#: Keys under which an answer wraps its list, and keys that make a lone object a product.
WRAPPERS = ("products", "items", "results", "suggestions")
PRODUCT_KEYS = ("name", "product_url")


@dataclass
class Span:
    kind: str
    start: int
    end: int = -1
    inner: list[Span] = field(default_factory=list)


def spans(text: str) -> list[Span]:
    """Bracket pairs in no other pair, in order; each holds those directly inside it."""
    top = Span("", 0)
    opened, at = [top], 0
    while (m := _MARK.search(text, at)) is not None:
        mark, at = m.group(), m.end()
        if mark in "[{":
            opened.append(Span(mark, m.start()))
        elif mark == '"':
            if len(opened) > 1:
                at = _STRING_END.match(text, at).end()
        elif mark != "\n":
            depth = next((i for i in range(len(opened) - 1, 0, -1) if opened[i].kind == _PAIR[mark]), 0)
            if depth:
                done = opened[depth]
                # what was opened inside and never closed gives its finished parts to the pair around it
                for lost in opened[depth + 1:]:
                    done.inner += lost.inner
                del opened[depth:]
                done.end = at
                opened[-1].inner.append(done)
    for lost in opened[1:]:
        top.inner += lost.inner
    return sorted(top.inner, key=lambda s: s.start)


def values(text: str):
    """(value, span) of every outermost JSON array or object, spare commas forgiven. Where a pair is no JSON, the pairs
    inside it are tried."""
    todo = spans(text)[::-1]
    while todo:
        s = todo.pop()
        body = text[s.start:s.end]
        for attempt in (body, _SPARE_COMMA.sub("", body)):
            try:
                yield json.loads(attempt), s
                break
            except ValueError:
                continue
        else:
            todo += s.inner[::-1]


def _records(value, span: Span) -> list[tuple[dict, Span]]:
    """Objects of a list, of a wrapped list, or the object itself if it is a product, with their spans."""
    if isinstance(value, list):
        rows, held = value, span
    else:
        lists = [k for k, v in value.items() if isinstance(v, list)]
        key = next((k for k in WRAPPERS if k in lists), None)
        if key is None:
            return [(value, span)] if any(k in value for k in PRODUCT_KEYS) else []
        arrays = [s for s in span.inner if s.kind == "["]
        if len(arrays) != len(lists):
            return [(r, span) for r in value[key] if isinstance(r, dict)]
        rows, held = value[key], arrays[lists.index(key)]
    found = [r for r in rows if isinstance(r, dict)]
    places = [s for s in held.inner if s.kind == "{"]
    return list(zip(found, places if len(places) == len(found) else [held] * len(found)))


def product_records(text: str) -> list[tuple[dict, int, int, int, int]]:
    """(record, start, end, start byte, end byte) of the first value that holds any product."""
    for value, span in values(text):
        found = _records(value, span)
        if found:
            points, at, size = {}, 0, 0
            for p in sorted({x for _, s in found for x in (s.start, s.end)}):
                size += len(text[at:p].encode())
                points[p], at = size, p
            return [(r, s.start, s.end, points[s.start], points[s.end]) for r, s in found]
    return []
