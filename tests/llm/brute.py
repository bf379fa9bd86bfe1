"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def captures(pages):
    """(page_id, html) -> page_id: (bytes, digest, kind, page it refers to)."""
    first = {}
    for i, html in sorted(pages):
        first.setdefault(html or "", i)
    out = {}
    for i, html in pages:
        raw, at = (html or "").encode(), first[html or ""]
        sha = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out[i] = (len(raw), sha, "response" if at == i else "revisit", None if at == i else at)
    return out


def targets(sizes, weights=(1, 2, 3), most=3.0):
    """source: size -> source: target, resharing what is cut off until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else share[s] for s in names}
        full |= over


SECRETS = (("assign", re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 1, 12),
           ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile(r"[0-9a-f]+"), 0, 16))


def secrets(text):
    found, counts = [], []
    for k, (_, pattern, group, least) in enumerate(SECRETS):
        own = [(m.start(), k, m.end()) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
        counts.append(len(own))
        found += own
    joined = ",".join(f"{SECRETS[k][0]}:{a}:{b}" for a, k, b in sorted(found))
    return (*counts, hashlib.sha256(joined.encode()).hexdigest()), joined


def edits(docs):
    """(doc_id, text) -> doc_id: (n_chars, digest of the edited text)."""
    order, out = sorted(docs, reverse=True), {}
    for k, (i, text) in enumerate(order):
        after, m = order[(k + 1) % len(order)][1] or "", len(text or "") // 3
        edited = (text or "")[:len(text or "") - m] + after[:m]
        out[i] = (len(text or ""), hashlib.sha256(edited.encode()).hexdigest())
    return out


def shingles(text, n):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def classes(docs, n, num, den):
    """(doc_id, text) -> doc_id: (set size, class, links)."""
    sets, holders = {i: shingles(t, n) for i, t in docs}, defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    root, links = {i: i for i in sets}, Counter()

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, s in sets.items():
        for j, common in Counter(j for x in s for j in holders[x]).items():
            if i != j and den * common >= num * (len(s) + len(sets[j]) - common):
                links[i] += 1
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), top(i), links[i]) for i, s in sets.items()}


def base_rules(text):
    w = words(text)
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    times, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if times[x] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


def aligned(texts, a_encode, b_encode, a_bytes, b_bytes):
    """(doc_id, text) -> doc_id: (n_a, n_b, n_groups, n_links, n_best, count_sum, groups), whole texts encoded at once."""
    found, counts = {}, Counter()
    for k, (_, text) in enumerate(texts):
        raw = (" " + (text or "")).encode()
        a, b = (a_encode(" " + text), b_encode(text)) if text else ([], [])
        if not text or b"".join(a_bytes[i] for i in a) != raw or b"".join(b_bytes[i] for i in b) != raw:
            found[k] = None
            continue
        at_a, at_b = [i for i, t in enumerate(a) for _ in a_bytes[t]], [i for i, t in enumerate(b) for _ in b_bytes[t]]
        links = sorted(set(zip(at_a, at_b)))
        cuts = [i for i in range(1, len(raw) + 1) if i == len(raw) or (at_a[i] != at_a[i - 1] and at_b[i] != at_b[i - 1])]
        groups, start = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(ids[i]) for i in sorted(set(at[start:c]))) for ids, at in ((a, at_a), (b, at_b))))
            start = c
        links = [(a[i], b[j]) for i, j in links]
        counts.update(links)
        found[k] = (len(a), len(b), links, groups)
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = []
    for k, (i, _) in enumerate(texts):
        if found[k] is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, links, groups = found[k]
            out.append((i, n_a, n_b, len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), ";".join(groups)))
    return out


def super_min_hash(keys, places, mixed):
    """Signature of a set by the shuffles themselves, one element at a time."""
    least = [(1 << 64) - 1] * places
    for x in keys:
        order = list(range(places))
        for j in range(places):
            drawn = mixed((x + (j + 1) * 0x9E3779B97F4A7C15) % (1 << 64))
            k = j + ((drawn >> 32) * (places - j) >> 32)
            order[j], order[k] = order[k], order[j]
            least[order[j]] = min(least[order[j]], (mixed(drawn) >> 16) | (j << 48))
    return least


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k=20):
    """(doc_id, text), (item_id, text) -> rows (item_id, rank, doc_id, score)."""
    import math
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n, total, df = len(bags), sum(x for _, _, x in bags), Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, bag, size in bags:
            m, score = 75 + 25 * size * n // total, 0
            for t in TERM.findall((text or "").translate(LOWER)):
                if bag[t]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out
