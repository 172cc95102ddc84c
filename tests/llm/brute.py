"""Plain versions that the tests hold the operators against."""

import re


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingles(text, n):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def components(docs, n, num, den):
    """{doc_id: (size, component)} by comparing all pairs that share a shingle."""
    sets = [(d, shingles(t, n)) for d, t in docs]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for i, (_, s) in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(i)
    tried = set()
    for i, (d, s) in enumerate(sets):
        for j in {j for g in s for j in index[g] if j < i}:
            if (i, j) not in tried:
                tried.add((i, j))
                both = len(s & sets[j][1])
                if den * both >= num * (len(s) + len(sets[j][1]) - both):
                    a, b = sorted((find(d), find(sets[j][0])))
                    parent[b] = a
    return {d: (len(s), find(d)) for d, s in sets}
