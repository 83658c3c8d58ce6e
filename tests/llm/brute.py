"""The operators' results in plain Python, for small tables of (doc_id, text) rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(text):
    return (text or "").encode()


def shingles(text, k):
    w = utf8(text).lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near(rows, k):
    """{doc_id: (n, component)} by comparing all pairs."""
    sets = defaultdict(list)
    for i, t in rows:
        if i is not None:
            sets[i].append(shingles(t, k))
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and any(s and t and 100 * len(s & t) >= 80 * len(s | t) for s in sets[x] for t in sets[y]):
                a, b = root(x), root(y)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def quality(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(runs)
    cover = {j for i, r in enumerate(runs) if n[r] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)


def kept_by_rules(text):
    n, chars, symbols, dup, _, failed = quality(text)
    t = text or ""
    caps, small = (sum(c in x for c in t) for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    bad = 100 * symbols > 10 * n or 100 * chars < 200 * n or 100 * chars > 1500 * n or (dup >= 3 and 100 * dup > 50 * (t.count("\n") + 1)) or 100 * caps > 60 * (caps + small)
    return not failed and not bad


def repeated_bytes(rows):
    """rows in the order that counts; [(n_bytes, n_removed, n_spans, sha)]."""
    seen, out = set(), []
    for _, t in rows:
        b, cover = utf8(t), set()
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                cover.update(range(i, i + 100))
            seen.add(b[i : i + 100])
        spans = sum(i in cover and i - 1 not in cover for i in range(len(b)))
        out.append((len(b), len(cover), spans, hashlib.sha256(bytes(c for i, c in enumerate(b) if i not in cover)).hexdigest()))
    return out


def repeated_words(rows):
    first, out = {}, []
    for i, (_, t) in enumerate(rows):
        w = utf8(t).split()
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    for i, (_, t) in enumerate(rows):
        w = utf8(t).split()
        cover = {x for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < i for x in range(j, j + 13)}
        out.append((len(w), len(cover), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in cover)).hexdigest()))
    return out


def contaminated(rows, items):
    gap = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, t in items:
        w = gap.findall((t or "").translate(UPPER))
        size = min(13, len(w))
        for j in range(len(w) - size + 1 if size else 0):
            if item is not None:
                windows[tuple(w[j : j + size])].add(str(item))
    sizes, out = {len(x) for x in windows}, []
    for _, t in rows:
        w = gap.findall((t or "").translate(UPPER))
        hit, met = set(), set()
        for size in sizes:
            for j in range(len(w) - size + 1):
                if (k := tuple(w[j : j + size])) in windows:
                    hit.update(range(j, j + size))
                    met |= windows[k]
        out.append((len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def trained(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 != 1


def base_scores(rows):
    c = Counter()
    for i, t in rows:
        if trained(i):
            c.update([*utf8(t).lower().split(), b""])
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        w = [*utf8(t).lower().split(), b""]
        out.append((not trained(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    return out


def tree_scores(rows, depth=5):
    """log10 probabilities by the definition, node by node."""
    counts = defaultdict(lambda: [0, 0])

    def events(t):
        b = b"\0" * depth + utf8(t).lower() + b"\xff"
        for p in range(depth, len(b)):
            context, node = b[p - depth : p][::-1], 1
            for j in range(7, -1, -1):
                bit = b[p] >> j & 1
                yield context, node, bit
                node = node * 2 + bit

    for i, t in rows:
        if trained(i):
            for context, node, bit in events(t):
                for d in range(depth + 1):
                    counts[context[:d], node][bit] += 1
    beta, below = {}, defaultdict(float)
    for d in range(depth, -1, -1):
        for (context, node), (a, b) in list(counts.items()):
            if len(context) == d:
                k = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
                w = k
                if d < depth:
                    s = below[context, node]
                    beta[context, node] = k - s
                    w = max(k, s) + math.log1p(math.exp(-abs(k - s))) - math.log(2)
                if d:
                    below[context[:-1], node] += w
    out = []
    for _, t in rows:
        total = 0.0
        for context, node, bit in events(t):
            q = 0.5
            for d in range(depth, -1, -1):
                n = counts.get((context[:d], node), [0, 0])
                own = (n[bit] + 0.5) / (sum(n) + 1)
                stop = 1 / (1 + math.exp(-max(-700, min(700, beta.get((context[:d], node), 0.0)))))
                q = own if d == depth else stop * own + (1 - stop) * q
            total += math.log10(q)
        out.append(total)
    return out
