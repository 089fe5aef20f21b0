"""Plain versions of the operators, for small tables."""

import re
from collections import Counter, defaultdict

import numpy as np

ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(ASCII_LOWER))


def shingles(ws):
    return frozenset(tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))) if ws else frozenset()


def components(sets, percent):
    """Least index in reach of each index; empty sets are alone."""
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    meet = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            meet[g].append(i)
    for a, b in {(x, y) for held in meet.values() for i, x in enumerate(held) for y in held[i + 1 :]}:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def repeated_bytes(texts, length):
    """A mask for each text of the bytes that a repeated string covers."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[k : k + length] for r in raws for k in range(len(r) - length + 1))
    masks = []
    for r in raws:
        mask = np.zeros(len(r), bool)
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                mask[k : k + length] = True
        masks.append(mask)
    return masks


def within_one(a, b):
    """Whether the word lists differ by one word at most."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    short, long = sorted((a, b), key=len)
    return any(short == long[:i] + long[i + 1 :] for i in range(len(long)))
