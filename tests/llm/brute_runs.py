"""Runs of a sequence, word by word."""


def runs(words, min_length=12):
    """(start, length, period) of every maximal stretch, by its smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            e = i
            while e + q < n and words[e] == words[e + q]:
                e += 1
            length = e - i + q
            if length >= max(min_length, 2 * q):
                found.setdefault((i, length), q)
            i = e
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(words, found):
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    return [w for k, w in enumerate(words) if k not in gone]
