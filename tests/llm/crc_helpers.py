"""Brute-force versions of the operators, as plain as can be."""

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = r"[^\x20\x09-\x0D]+"


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def cut_windows(rows, width=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        words = re.findall(WORD, t or "")
        covered = set()
        for p in range(len(words) - width + 1):
            key = tuple(words[p : p + width])
            if key in seen:
                covered.update(range(p, p + width))
            seen.add(key)
        out[i] = (len(words), len(covered), " ".join(w for p, w in enumerate(words) if p not in covered))
    return out


def top_k(vectors, k, every=50):
    usable = []
    width = max(len(x) for _, x, _ in vectors if x)
    for i, x, _ in vectors:
        if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            usable.append((i, tuple([math.floor(256 * c) for c in x] + [0] * (width - len(x)))))
    out = []
    for q, x in set(usable):
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i) for i, v in usable if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def targets(sizes, weights, cap):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(cap * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s for s in rest if share[s] > cap * sizes[s] + 1e-9}
        if not over:
            return {s: cap * sizes[s] if s in full else share[s] for s in order}
        full |= over


def sainte_lague(parties, n):
    got = dict.fromkeys(parties, 0)
    for _ in range(n):
        best = max((p for p in parties if parties[p] > 0), key=lambda p: (parties[p] / (2 * got[p] + 1), [-ord(c) for c in p]))
        got[best] += 1
    return got


def media_digest(i, text):
    data = (text or "").encode()
    payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
    return (i is None, i or 0), len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])


def roots(items, linked):
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in items}


def near_classes(rows, width, least):
    bags = {}
    for i, t in rows:
        w = re.findall(WORD, t)
        bags[i] = Counter(tuple(w[j : j + width]) for j in range(len(w) - width + 1)) if len(w) >= width else Counter([tuple(w)])
    links = [(a, b) for a in bags for b in bags if a < b and sum((bags[a] & bags[b]).values()) >= least * sum((bags[a] | bags[b]).values())]
    return roots(bags, links)


def line_dedup(rows, width, least):
    first, places = {}, []
    for i, t in sorted(rows):
        for p, line in enumerate(t.split("\n")):
            if key := line.strip(" \t\r"):
                first.setdefault(key, (i, p))
                places.append((i, p, key))
    sets = {k: {k[j : j + width] for j in range(len(k) - width + 1)} for k in first}
    links = [(first[a], first[b]) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    root = roots(first.values(), links)
    gone = {(i, p) for i, p, k in places if (i, p) != root[first[k]]}
    out = {}
    for i, t in rows:
        lines = t.split("\n")
        kept = [x for p, x in enumerate(lines) if (i, p) not in gone]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def language_model(rows, steps, discount, folds=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: [*re.findall(WORD, t.translate(lower)), None] for i, t in rows}
    single, double = Counter(), Counter()
    for i, t in tokens.items():
        if crc(i) % folds:
            single.update(t)
            double.update(zip(["<start>", *t[:-1]], t, strict=True))
    n, v = sum(single.values()), len(single)
    context = Counter(single)
    context["<start>"] = single[None]
    stored, mass = {}, Counter()
    for (a, w), c in double.items():
        down = math.ceil(-steps * math.log10((c - discount) / context[a]) - 1e-9)
        stored[a, w] = 10 ** (-down / steps) if down < 255 else 0.0
        mass[a] += stored[a, w]
    share = lambda w: (single[w] + 0.1) / (n + 0.1 * (v + 1))
    model = lambda a, w: stored.get((a, w), 0.0) + (1 - mass[a]) * share(w)
    for a in list(context)[:50]:
        assert abs(sum(model(a, w) for w in [*single, "a word never seen"]) - 1) < 1e-9
    out = {}
    for i, t in tokens.items():
        score = sum(math.log10(model(a, w)) for a, w in zip(["<start>", *t[:-1]], t, strict=True))
        out[i] = (crc(i) % folds == 0, len(t), sum(single[w] > 0 for w in t), n, sum(math.log10(share(w)) for w in t), score)
    return out
