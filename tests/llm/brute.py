"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return BLANK.findall((text or "").translate(LOWER))


def shingles(text, width):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1)))


def components(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[root(a)] = root(b)
    low = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        low[root(k)].append(i)
    return sorted((i, len(s), min(low[root(k)])) for k, (i, s) in enumerate(sets))


def repeats(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + length] for _, b in texts for p in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def shared_runs(later, earlier, block):
    """Places of ``later`` in runs of ``block`` characters or more that ``earlier`` holds."""
    gone = set()
    for p in range(len(later)):
        for q in range(len(earlier)):
            n = 0
            while p + n < len(later) and q + n < len(earlier) and later[p + n] == earlier[q + n]:
                n += 1
            if sum(map(len, later[p : p + n])) >= block:
                gone |= set(range(p, p + n))
    return gone


def aligned(later, earlier, block):
    """Places of ``later`` in blocks shared with ``earlier``, found by alignment alone: a longest common sequence of lines;
    its stretches of ``block`` characters go, and what is left is aligned again, until an alignment has no such stretch.

    Lines that are in no stretch of ``block`` characters with the other text are set aside first, as nothing else could be
    deleted by them. A place may be aligned with any equal stretch of the earlier text.
    """
    gone = set()
    pairs = [(p, q, n) for p in range(len(later)) for q in range(len(earlier)) for n in [run(later, earlier, p, q)] if sum(map(len, later[p : p + n])) >= block]
    while True:
        left = [(p, q, n) for p, q, n in pairs if not set(range(p, p + n)) <= gone]
        best = {}
        for k, (p, q, n) in enumerate(left):  # in order of p; the longest chain of stretches that grow in both texts
            best[k] = max((best[j] for j in range(k) if left[j][0] < p and left[j][1] < q), key=len, default=[]) + [k]
        chain = max(best.values(), key=len, default=[])
        if not chain:
            return gone
        for k in chain:
            gone |= set(range(left[k][0], left[k][0] + left[k][2]))


def run(a, b, p, q):
    n = 0
    while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]:
        n += 1
    return n


def line_dedup(rows, block=50):
    """{row number: removed places, None for all}: every pair of a document and an earlier one is compared."""
    lines = [[x.strip(" ") for x in t.split("\n")] if t else None for _, t in rows]
    reps = {}
    for k, (i, t) in enumerate(rows):
        if t and i is not None:
            reps[t] = min(reps.get(t, i), i)
    own = {}
    for k, (i, t) in enumerate(rows):
        if t and reps.get(t) == i:
            own.setdefault(i, lines[k])
    # documents without a common line have no common block
    holders = defaultdict(set)
    for i, ls in own.items():
        for x in set(ls) - {""}:
            holders[x].add(i)
    gone = defaultdict(set)
    for later, earlier in {(b, a) for h in holders.values() for a in h for b in h if a < b}:
        gone[later] |= aligned(own[later], own[earlier], block)
    out = {}
    for k, (i, t) in enumerate(rows):
        if t and i is not None:
            rep = reps[t]
            if i != rep and sum(map(len, lines[k])) >= block:
                out[k] = None
            elif gone[rep]:
                out[k] = sorted(gone[rep])
    return out


def contaminated(docs, items, least=0.8):
    """{(doc, item): best similarity} over all windows."""
    own = {i: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, t in items for w in [words(t)]}
    own = {i: c for i, c in own.items() if c}
    df = Counter(s for c in own.values() for s in c)
    weight = lambda s: round(16 * (1 + math.log(max(1, len(own)) / df.get(s, 1))))
    out = {}
    for d, t in docs:
        w = words(t)
        s = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        hits = {x for x in s if x in df}
        for i, c in own.items():
            if not hits & c.keys():
                continue
            n = sum(c.values())
            for p in range(max(1, len(s) - n + 1)):
                win = Counter(s[p : p + n])
                low = sum(min(win[x], c[x]) * weight(x) for x in c)
                high = sum(max(win[x], c[x]) * weight(x) for x in win.keys() | c.keys())
                if low / high >= least:
                    out[d, i] = max(out.get((d, i), 0), low / high)
    return out
