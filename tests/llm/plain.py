"""Plain Python versions of what the operators compute, for small fixtures."""

from __future__ import annotations

from collections import Counter

import numpy as np
import xxhash


def near_lines(a: list[str], b: list[str], least: int = 5) -> bool:
    """Whether two lines, as words, are one edit apart and long enough."""
    if max(len(a), len(b)) < least:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def dedup_lines(docs: list[tuple[int, str]]) -> dict[int, list[str]]:
    """Lines that stay, by document."""
    seen: list[list[str]] = []
    out = {}
    for name, text in sorted(docs):
        out[name] = []
        for line in (text or "").split("\n") if text is not None else []:
            words = [w.decode() for w in line.encode().split()]
            if words and (words in seen or any(near_lines(words, s) for s in seen)):
                if words not in seen:
                    seen.append(words)
                continue
            if words:
                seen.append(words)
            out[name].append(line)
    return out


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_groups(docs: list[tuple[int, str]], distance: int = 3) -> dict[int, int]:
    fps = {k: fingerprint(t) for k, t in docs}
    at = {k: k for k in fps}

    def root(i: int) -> int:
        while at[i] != i:
            i = at[i]
        return i

    names = sorted(fps)
    for x in names:
        for y in names:
            if x < y and (fps[x] ^ fps[y]).bit_count() <= distance:
                a, b = root(x), root(y)
                at[max(a, b)] = min(a, b)
    return {k: root(k) for k in names}


def without_repeats(texts: list[str | None], length: int = 200) -> list[tuple[bytes, int, int]]:
    """(kept bytes, removed, runs) of every text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((bytes(b for b, g in zip(t, gone) if not g), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0])))
    return out
