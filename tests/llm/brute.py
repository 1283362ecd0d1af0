"""Plain single-machine versions of the operators, for small fixtures."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORD.findall(text or "")


def shingle_set(text):
    w = words(lower(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def components(docs):
    """{row index: component} under Jaccard of 0.75 or more."""
    sets = [shingle_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    seen = set()
    for group in holders.values():
        for i in group:
            for j in group:
                if i < j and (i, j) not in seen:
                    seen.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                        parent[find(j)] = find(i)
    low = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        low[r] = min(low.get(r, d), d)
    return [low[find(i)] for i in range(len(docs))], [len(s) for s in sets]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def dedup_lines(docs, least=20, t=2):
    """Texts after removing later copies and near copies of lines."""
    strip = " \t\n\x0b\x0c\r"
    first = {}
    for d, text in sorted(docs, key=lambda r: (r[0] is None, r[0])):
        if d is None or text is None:
            continue
        for i, x in enumerate(text.split("\n")):
            k = x.strip(strip)
            if len(k) >= least:
                first.setdefault(k, (d, i))
    by_size = defaultdict(list)
    for k in first:
        by_size[len(k)].append(k)
    near = set()
    for k in first:
        for size in range(len(k) - t, len(k) + t + 1):
            for o in by_size[size]:
                if first[o] < first[k] and edit_distance(k, o) <= t:
                    near.add(k)
                    break
    out = []
    for d, text in docs:
        if d is None or text is None:
            out.append((d, text))
            continue
        kept = []
        for i, x in enumerate(text.split("\n")):
            k = x.strip(strip)
            if len(k) < least or (k not in near and first[k] == (d, i)):
                kept.append(x)
        out.append((d, "\n".join(kept)))
    return out


def quality(text):
    t = text or ""
    w = words(t)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if windows[tuple(w[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    seen, dup = set(), 0
    for x in t.split("\n"):
        if words(x):
            dup += x in seen
            seen.add(x)
    n = len(w)
    return {
        "n_words": n,
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in t),
        "n_dup_lines": dup,
        "n_repeat_words": len(hit),
        "base_failed": n < 10 or 100 * len(hit) > 20 * n,
    }


def leaks(docs, items):
    """(doc, item) pairs whose best item-sized window has a weighted similarity of 0.75 or more."""
    from math import log

    punct = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

    def plain(t):
        return words(lower(t or "").translate(str.maketrans("", "", punct)))

    def grams(w):
        n = min(5, len(w))
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()

    known = [(i, plain(t)) for i, t in items]
    known = [(i, w) for i, w in known if w]
    bags = [grams(w) for _, w in known]
    df = Counter(x for b in bags for x in b)
    n = len(known)
    out = set()
    for d, t in docs:
        w = plain(t)
        for (item, q), bag in zip(known, bags):
            size = min(len(q), len(w))
            for at in range(max(0, len(w) - size) + 1):
                other = grams(w[at : at + size])
                if not (bag.keys() & other.keys()):
                    continue
                both = sum(log(1 + n / df[x]) * min(bag[x], other[x]) for x in bag.keys() & other.keys())
                either = sum((log(1 + n / df[x]) if x in df else log(1 + n)) * max(bag[x], other[x]) for x in bag.keys() | other.keys())
                if both >= 0.75 * either - 1e-9:
                    out.add((d, item))
                    break
    return out
