"""Plain Python versions of the contracts, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

LOWER = {i: i + 32 for i in range(65, 91)}
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def alnum(text):
    return ALNUM.findall((text or "").translate(LOWER))


def spaced(text):
    return SPACED.findall((text or "").translate(LOWER))


def contamination(docs, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = alnum(text)
        m = min(size, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[i : i + m])].add("" if item is None else str(item))
    lengths = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w, hit, found = alnum(text), set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                own = windows.get(tuple(w[i : i + m]))
                if own:
                    found |= own
                    hit.update(range(i, i + m))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def components(docs, k=5):
    sets = []
    for _, text in docs:
        w = spaced(text)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    shared = Counter((a, b) for v in where.values() for n, a in enumerate(v) for b in v[n + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            root[find(a)] = find(b)
    least = defaultdict(lambda: None)
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[find(i)] = doc if least[find(i)] is None else min(least[find(i)], doc)
    return [(doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(docs)]
