"""Plain reference computations for small tables."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import xxhash


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def groups(n, pairs):
    parent = list(range(n))
    for a, b in pairs:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return [find(parent, i) for i in range(n)]


def fingerprint(text, words=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def shingles(words, k=5):
    return {tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def paragraphs(text, least=20, cut=4):
    """[(first word, end, words)]: long lines, and pieces of runs of short ones."""
    out, run, at = [], [], 0

    def close():
        words = [w for _, own in run for w in own]
        if len(words) >= least:
            out.append((run[0][0], run[0][0] + len(words), words))
            run.clear()

    for line in (text or "").split("\n"):
        w = line.encode().lower().split()
        if len(w) >= least:
            close()
            run.clear()
            out.append((at, at + len(w), w))
        elif w:
            run.append((at, w))
            if xxhash.xxh32_intdigest(b" ".join(w), 3) % cut == 0:
                close()
        at += len(w)
    close()
    return out


def similar_paragraphs(docs, similar=0.8):
    """{(doc_id, first word, end): (first place of its cluster, places, kept)} of repeated paragraphs."""
    places, sets = {}, {}
    for i, text in docs:
        for a, b, w in paragraphs(text):
            places[i, a, b] = b" ".join(w)
            sets.setdefault(b" ".join(w), shingles(w))
    keys = list(sets)
    by = defaultdict(list)
    for n, k in enumerate(keys):
        for s in sets[k]:
            by[s].append(n)
    near = set()
    for n, k in enumerate(keys):
        for m in Counter(m for s in sets[k] for m in by[s] if m > n):
            if jaccard(sets[k], sets[keys[m]]) >= similar:
                near.add((n, m))
    label = groups(len(keys), near)
    clusters = defaultdict(list)
    number = {k: label[n] for n, k in enumerate(keys)}
    for place, k in places.items():
        clusters[number[k]].append(place)
    return {p: (min(c), len(c), p == min(c)) for c in clusters.values() if len(c) > 1 for p in c}


def runs(texts, n):
    """{run of n words: places}, of those in more than one place."""
    seen = defaultdict(list)
    for i, text in texts:
        w = (text or "").encode().lower().split()
        for k in range(len(w) - n + 1):
            seen[hash(tuple(w[k : k + n]))].append((i, k))
    return {k: v for k, v in seen.items() if len(v) > 1}


def repeated_bytes(docs, length):
    """{id: (bytes, removed, spans, digest of the rest)}."""
    seen = Counter(b[k : k + length] for _, b in docs for k in range(len(b) - length + 1))
    out = {}
    for i, b in docs:
        covered = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                covered[k : k + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~covered])
        spans = int((np.diff(np.concatenate(([0], covered.astype(int)))) == 1).sum())
        out[i] = (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def edits(a, b):
    """Edit distance of two word lists."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i] + [0] * len(b), row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]
