"""Plain versions of the operators, one row at a time, for small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

LAST = (1 << 63) - 1
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOW = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def low(text: str) -> str:
    return text.translate(_LOW)


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def substrings(rows, window=35):
    words = [SPACE.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def contaminated(rows, items, window=10):
    keys = defaultdict(set)
    for item, t in items:
        w = ALNUM.findall(low(t or ""))
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            keys[tuple(w[i : i + m])].add(item)
    out = []
    for doc, t in rows:
        w = ALNUM.findall(low(t or ""))
        hit, found = set(), set()
        for m in {len(k) for k in keys}:
            for i in range(len(w) - m + 1):
                if k := keys.get(tuple(w[i : i + m])):
                    hit.update(range(i, i + m))
                    found |= k
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(names), ",".join(names), bool(hit)))
    return out


def shingles(text, size):
    w = SPACE.findall(low(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def near(rows, size=4, percent=80):
    """doc_id -> (n_shingles, component); ids are unique here."""
    sets = {d: shingles(t, size) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a2, b2 = find(a), find(b)
                root[max(a2, b2)] = min(a2, b2)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def lines(rows, min_lines=3, min_chars=60):
    """For unique ids: doc, n_lines, n_removed, n_runs, kept text."""
    order = sorted(range(len(rows)), key=lambda i: LAST if rows[i][0] is None else rows[i][0])
    held = [None if t is None else t.split("\n") for _, t in rows]
    gone = [set() for _ in rows]
    first: set = set()
    for i in order:
        for p, line in enumerate(held[i] or ()):
            if len(line) >= min_chars:
                if line in first:
                    gone[i].add(p)
                first.add(line)
    first = set()
    for i in order:
        for p in range(len(held[i] or ()) - min_lines + 1):
            run = tuple(held[i][p : p + min_lines])
            if run in first:
                gone[i].update(range(p, p + min_lines))
            first.add(run)
    out = []
    for (doc, t), h, g in zip(rows, held, gone, strict=True):
        kept = t if not g else "\n".join(x for p, x in enumerate(h) if p not in g)
        out.append((doc, len(h or ()), len(g), sum(p - 1 not in g for p in g), kept))
    return out


def byte_strings(rows, length=50):
    first: dict[bytes, int] = {}
    for doc, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, LAST), LAST if doc is None else doc)
    out = []
    for doc, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (LAST if doc is None else doc):
                gone[i : i + length] = True
        spans = int((gone[:-1] & ~gone[1:]).sum())
        out.append((doc, len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])))
    return out


def urls(rows, rules, default="allow"):
    out = []
    for page, url in rows:
        host, path = "", ""
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            host = low(re.split(r"[/?#]", rest, maxsplit=1)[0])
            path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        fit = [(len(h) + len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fit, default=(0, None, default))
        out.append((page, host, path, rule, verdict))
    return out


class Bayes:
    """Multinomial naive Bayes over exact letter n-grams of orders 2 and 3 with word edges."""

    def __init__(self, rows, alpha=0.1, slots=1 << 16):
        self.counts, self.docs, self.alpha, self.slots = defaultdict(Counter), Counter(), alpha, slots
        for text, lang in rows:
            if text is not None and lang is not None:
                self.docs[lang] += 1
                self.counts[lang].update(self.grams(text))

    @staticmethod
    def grams(text):
        s = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        s = re.sub(" +", " ", s)
        return [s[i : i + n] for n in (2, 3) for i in range(len(s) - n + 1)]

    def predict(self, text):
        if text is None or not any(c.isalpha() for c in text) or not self.docs:
            return "und", 0.0
        total = {}
        for lang in sorted(self.docs):
            c, n = self.counts[lang], sum(self.counts[lang].values())
            p = np.log(self.docs[lang] / sum(self.docs.values()))
            total[lang] = p + sum(np.log((c[g] + self.alpha) / (n + self.alpha * self.slots)) for g in self.grams(text))
        best = max(total, key=lambda k: total[k])
        return best, 1 / sum(np.exp(v - total[best]) for v in total.values())


def nearest(rows, queries, k=5):
    """Exact neighbours by cosine in double precision; rows are (id, vector)."""
    fine = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    if not fine:
        return {}
    ids, m = np.array([i for i, _ in fine]), np.array([v for _, v in fine])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for i, v in zip(ids, m, strict=True):
        if i in queries:
            order = sorted((-round(float(s), 12), int(j)) for j, s in zip(ids, m @ v, strict=True) if j != i)[:k]
            out[int(i)] = [j for _, j in order]
    return out


def fitted(cells, targets, rounds):
    """Iterative proportional fitting over {(source, lang, topic): tokens}."""
    mass = {c: float(n) for c, n in cells.items()}
    total = sum(cells.values())
    for _ in range(rounds):
        for k, target in enumerate(targets):
            held = defaultdict(float)
            for c, m in mass.items():
                held[c[k]] += m
            mass = {c: m * target.get(c[k], 0) * total / held[c[k]] if held[c[k]] else 0.0 for c, m in mass.items()}
    return {c: mass[c] / n if n else 1.0 for c, n in cells.items()}
