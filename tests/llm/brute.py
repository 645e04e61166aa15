"""Brute-force versions that several tests use."""

import re


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def blanks(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def components(texts, k):
    """The least place of each text's component, by comparing all pairs."""
    sets = []
    for t in texts:
        w = blanks(t)
        sets.append({tuple(w[i : i + k]) for i in range(max(len(w) - k, 0) + 1)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(texts))}


def contaminated(text, items, size=13):
    w, hit = words(text), set()
    for item, other in items:
        own = words(other) if item is not None else []
        for s in range(max(len(own) - size, 0) + 1 if own else 0):
            win = own[s : s + size]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
    return len(hit) > 0 and 20 * len(hit) >= len(w)
