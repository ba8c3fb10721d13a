"""Brute-force versions that several tests share."""

import itertools
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(x):
    return re.sub("[A-Z]", lambda m: m.group().lower(), x or "")


def components(texts):
    sets = {}
    for k, x in texts.items():
        w = WORD.findall(lower(x))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    holders = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            holders[x].append(k)
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    overlap = Counter(p for v in holders.values() for p in itertools.combinations(sorted(v), 2))
    for (a, b), o in overlap.items():
        if 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), find(k)) for k in sets}
