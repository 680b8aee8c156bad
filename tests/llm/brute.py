"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def removed_words(texts: list[str | None], width: int = 35) -> list[tuple[int, int, str]]:
    """(words, removed words, digest of what is kept) by counting every window."""
    docs = [WORD.findall((t or "").encode()) for t in texts]
    windows = Counter(tuple(d[i : i + width]) for d in docs for i in range(len(d) - width + 1))
    out = []
    for d in docs:
        gone = [False] * len(d)
        for i in range(len(d) - width + 1):
            if windows[tuple(d[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((len(d), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def removed_bytes(texts: list[str | None], length: int = 400) -> list[tuple[int, int, int, bytes]]:
    """(bytes, removed bytes, removed runs, what is kept) by counting every string of `length` bytes."""
    docs = [(t or "").encode() for t in texts]
    seen: Counter = Counter()
    for d in docs:
        seen.update(hash(d[i : i + length]) for i in range(len(d) - length + 1))
    out = []
    for d in docs:
        gone, upto = bytearray(len(d)), 0
        for i in range(len(d) - length + 1):
            if seen[hash(d[i : i + length])] > 1:
                gone[max(i, upto) : i + length] = b"\1" * (i + length - max(i, upto))
                upto = i + length
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(d), sum(gone), runs, bytes(b for b, g in zip(d, gone, strict=True) if not g)))
    return out


def shingles(text: str | None) -> frozenset:
    words = WORD.findall(bytes((text or "").encode()).lower() if (text or "").isascii() else re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)])


def linked(texts: list[str | None]) -> list[int]:
    """The least index reachable from each text, by comparing all pairs."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)):
                same = len(a & b)
                if 100 * same >= 75 * (len(a) + len(b) - same):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def tile_coverage(doc: list, item: list, tile: int) -> float:
    """Greedy string tiling by scanning all pairs of places for the longest unmarked common run."""
    in_doc, in_item, total = [False] * len(doc), [False] * len(item), 0
    while item:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not in_doc[i + n] and not in_item[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < tile:
            break
        in_doc[i : i + n] = in_item[j : j + n] = [True] * n
        total += n
    return total / len(item) if item else 0.0


def auc(scores: list[float], good: list[int]) -> float:
    order = sorted(zip(scores, good, strict=True))
    rank, total = 0, 0.0
    while rank < len(order):
        end = rank
        while end < len(order) and order[end][0] == order[rank][0]:
            end += 1
        total += (rank + end + 1) / 2 * sum(g for _, g in order[rank:end])
        rank = end
    p = sum(good)
    return (total - p * (p + 1) / 2) / (p * (len(good) - p))
