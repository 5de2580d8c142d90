"""Plain Python forms of the contracts, for small tables."""

from __future__ import annotations

import collections
import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def spaced_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, width=4):
    words = spaced_words((text or "").translate(LOWER))
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def joined(n, links):
    """Smallest member that every one of 0..n-1 reaches."""
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def near_duplicates(texts):
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
             and 100 * (m := len(sets[i] & sets[j])) >= 80 * (len(sets[i]) + len(sets[j]) - m)]
    return [len(s) for s in sets], joined(len(sets), links)


def contamination(text, items):
    windows = collections.defaultdict(set)
    for item, body in items:
        words = alnum_words(body)
        for i in range(max(1, len(words) - 12) if words and item is not None else 0):
            windows[tuple(words[i:i + 13])].add(str(item))
    words, hit, held = alnum_words(text), set(), set()
    for n in {len(w) for w in windows}:
        for i in range(len(words) - n + 1):
            if (found := windows.get(tuple(words[i:i + n]))):
                hit.update(range(i, i + n))
                held |= found
    digest = hashlib.sha256(",".join(sorted(held)).encode()).hexdigest()
    return len(words), len(hit), len(held), digest, bool(hit) and 20 * len(hit) >= len(words)


def smallest_capacity(sizes, shards):
    def fits(capacity):
        used, room = 1, capacity
        for s in sizes:
            if s > capacity:
                return False
            if s > room:
                used, room = used + 1, capacity
            room -= s
        return used <= shards
    return next(c for c in range(-(-sum(sizes) // shards), sum(sizes) + 1) if fits(c))


def targets(sizes, weights, epochs=3):
    """Sizes by source in order, dealt again until none is above its limit."""
    total, full = sum(sizes), [False] * len(sizes)
    while True:
        left = total - sum(epochs * s for s, f in zip(sizes, full) if f)
        weight = sum(w for w, f in zip(weights, full) if not f)
        share = [epochs * s if f else left * w / weight for s, w, f in zip(sizes, weights, full)]
        over = [not f and x > epochs * s + 1e-9 for s, x, f in zip(sizes, share, full)]
        if not any(over):
            return share
        full = [f or o for f, o in zip(full, over)]
