"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repeat_words(text, window=8):
    w = words(text)
    seen: dict[tuple, list[int]] = {}
    for i in range(len(w) - window + 1):
        seen.setdefault(tuple(w[i : i + window]), []).append(i)
    hit = {i + k for places in seen.values() if len(places) > 1 for i in places for k in range(window)}
    return len(hit)


def shingle_set(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def components(docs):
    """{row number: least id} of rows (id, text) under Jaccard of at least 80 percent."""
    sets = [shingle_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    group: dict[int, list] = {}
    for i in range(len(docs)):
        group.setdefault(find(i), []).append(docs[i][0])
    return [(docs[i][0], len(sets[i]), min((k for k in group[find(i)] if k is not None), default=None)) for i in range(len(docs))]


def nearest(item, text):
    """Least edit distance of item to any stretch of text."""
    before = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (a != b)))
        before = now
    return min(before)
