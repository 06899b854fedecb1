"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re

import numpy as np
import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def drop_lines(docs, min_chars=40, min_docs=5):
    """{(doc_id, text): kept text}; ids compare with null as the smallest."""
    rank = lambda i: -(10**18) if i is None else i
    holders: dict[str, set] = {}
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(LOWER)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(rank(i))
    lost = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    return {
        (i, text): "\n".join(x for x in (text or "").split("\n") if key(x) not in lost or lost[key(x)] == rank(i))
        for i, text in docs}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(docs, items, window=10):
    """Rows (doc_id, n_words, hit places, item ids) for every document."""
    wins: dict[tuple, set] = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for i, text in docs:
        w = words(text)
        places, found = set(), set()
        for n in {len(x) for x in wins}:
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) in wins:
                    places |= set(range(at, at + n))
                    found |= wins[tuple(w[at : at + n])]
        out.append((i, len(w), len(places), tuple(sorted(found))))
    return out


def fingerprint(text, size=4):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if x]
    shingles = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints: dict[int, int], radius=4):
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    a = np.array([prints[i] for i in ids], np.uint64)
    for n, i in enumerate(ids):
        for m in np.flatnonzero(np.bitwise_count(a[n + 1 :] ^ a[n]) <= radius):
            x, y = find(i), find(ids[n + 1 + m])
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def best_fit(lengths, size, open_bins):
    """Online best fit by search over a list of open bins: [(bin, offset)]."""
    bins: list[list[int]] = []  # [free, number]
    made, out = 0, []
    for n in lengths:
        fits = [b for b in bins if b[0] >= n]
        if fits:
            least = min(b[0] for b in fits)
            chosen = [b for b in fits if b[0] == least][-1]
            bins.remove(chosen)
        else:
            if len(bins) >= open_bins and n < size:
                fullest = min(b[0] for b in bins)
                bins.remove([b for b in bins if b[0] == fullest][-1])
            chosen, made = [size, made], made + 1
        out.append((chosen[1], size - chosen[0]))
        chosen[0] -= n
        if chosen[0]:
            bins.append(chosen)
    return out
