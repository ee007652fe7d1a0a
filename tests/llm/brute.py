"""Plain versions of operators, for small inputs."""

import math
import re
from collections import defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


class Groups:
    """Links between ids; the least id reachable."""

    def __init__(self):
        self.parent = {}

    def find(self, x):
        while self.parent.get(x, x) != x:
            x = self.parent[x]
        return x

    def link(self, x, y):
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)


def shingles(text, n=5):
    w = WORD.findall(lowered(text))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def jaccard(rows, percent=75):
    """{id: (set size, component)} of (id, text) rows."""
    sets, groups, held = {k: shingles(t) for k, t in rows}, Groups(), defaultdict(list)
    for k, s in sets.items():
        both = defaultdict(int)
        for g in s:
            for j in held[g]:
                both[j] += 1
            held[g].append(k)
        for j, b in both.items():
            if 100 * b >= percent * (len(s) + len(sets[j]) - b):
                groups.link(k, j)
    return {k: (len(s), groups.find(k)) for k, s in sets.items()}


def vectors(rows, threshold=0.98):
    """{id: (links, component)} of (id, vector, label) rows."""
    unit, links, groups = {}, defaultdict(int), Groups()
    for k, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, float) / np.abs(np.array(v, float)).max()
            unit[k] = (label, x / np.linalg.norm(x))
    seen = []
    for k, (label, x) in unit.items():
        for j in seen:
            if unit[j][0] == label and len(unit[j][1]) == len(x) and unit[j][1] @ x >= threshold:
                links[k] += 1
                links[j] += 1
                groups.link(k, j)
        seen.append(k)
    return {k: (links[k], groups.find(k)) for k, _, _ in rows}


def lines(rows, least=50):
    """{id: text without later copies, or None where nothing is left} of (id, text) rows."""
    held, gone = set(), defaultdict(set)
    for k, t in sorted(rows):
        if t is None:
            continue
        ls = t.split("\n")
        n = [len(WORD.findall(x)) for x in ls]
        spans = set()
        for i in range(len(ls)):
            j, total = i, n[i]
            while total < least and j + 1 < len(ls):
                j += 1
                total += n[j]
            if total >= least:
                spans.add((i, j))
            j, total = i, n[i]
            while total < least and j > 0:
                j -= 1
                total += n[j]
            if total >= least:
                spans.add((j, i))
        for i, j in sorted(spans):
            run = "\n".join(ls[i : j + 1])
            if run in held:
                gone[k].update(range(i, j + 1))
            held.add(run)
    out = {}
    for k, t in rows:
        ls = (t or "").split("\n")
        left = [x for i, x in enumerate(ls) if i not in gone[k]]
        out[k] = t if not gone[k] else "\n".join(left) if left else None
    return out


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Caps and reshares over and over; sizes by source, None last."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        got = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if got[s] > cap * sizes[s] + 1e-9]
        if not over:
            return capped | got
        capped |= {s: cap * sizes[s] for s in over}
