"""Plain, quadratic or dictionary-based versions of the operators."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeated_cover(seqs, w):
    """Per sequence a list of flags: covered by a window of ``w`` symbols
    that also starts elsewhere."""
    seen = defaultdict(int)
    for s in seqs:
        for i in range(len(s) - w + 1):
            seen[s[i:i + w]] += 1
    out = []
    for s in seqs:
        cover = [0] * (len(s) + 1)
        for i in range(len(s) - w + 1):
            if seen[s[i:i + w]] > 1:
                cover[i] += 1
                cover[i + w] -= 1
        flags, run = [], 0
        for c in cover[:-1]:
            run += c
            flags.append(run > 0)
        out.append(flags)
    return out


def suffix(docs, w):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of (doc_id, text)."""
    raw = [(t or "").encode() for _, t in docs]
    out = []
    for (d, _), b, flags in zip(docs, raw, repeated_cover(raw, w)):
        spans = sum(1 for i, f in enumerate(flags) if f and (i == 0 or not flags[i - 1]))
        kept = bytes(x for x, f in zip(b, flags) if not f)
        out.append((d, len(b), sum(flags), spans, hashlib.sha256(kept).hexdigest()))
    return out


def phrases(docs, w):
    """(doc_id, n_words, n_removed, kept_sha256) of (doc_id, text)."""
    words = [tuple(WORD.findall(t or "")) for _, t in docs]
    out = []
    for (d, _), ws, flags in zip(docs, words, repeated_cover(words, w)):
        kept = " ".join(x for x, f in zip(ws, flags) if not f)
        out.append((d, len(ws), sum(flags), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, k):
    w = WORD.findall((text or "").translate(AZ))
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def components(docs, k, num, den):
    """(doc_id, n_shingles, component) per row, by comparing all pairs."""
    sets = [shingles(t, k) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return [(d, len(sets[i]), low.get(root(i))) for i, (d, _) in enumerate(docs)]
