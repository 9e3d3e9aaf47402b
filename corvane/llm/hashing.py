"""Vectorised 64-bit hashing shared by the text operators (NumPy, one Arrow batch at a time)."""

from __future__ import annotations

import numpy as np
import pandas as pd

U = np.uint64
# The finaliser constants of the public splitmix64 generator.
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: a bijection on 64-bit words."""
    x = x ^ (x >> U(30))
    x = x * _M1
    x = x ^ (x >> U(27))
    x = x * _M2
    return x ^ (x >> U(31))


def split_tokens(text: str) -> list[str]:
    """Non-empty parts between blanks, tabs, CR and LF (no other white space)."""
    return [t for t in text.replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if t]


def shingle_batch(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of ``k`` tokens of every text.

    Returns (owner, hash, token counts): ``hash`` is sorted within ``owner`` and
    holds every shingle of a text once.
    """
    tokens: list[str] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        own = split_tokens(t)
        counts[i] = len(own)
        tokens.extend(own)
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0, U), counts
    h = pd.util.hash_array(np.array(tokens, dtype=object), categorize=True).astype(U)
    owner = np.repeat(np.arange(len(texts)), counts)
    end = np.cumsum(counts)
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U), counts
    s = h[:n].copy()
    for j in range(1, k):
        s = mix(s) + h[j : n + j]
    s = mix(s)
    inside = np.arange(n) + k <= end[owner[:n]]
    o, s = owner[:n][inside], s[inside]
    order = np.lexsort((s, o))
    o, s = o[order], s[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (s[1:] != s[:-1])
    return o[new], s[new], counts


def slabs(sizes: np.ndarray, limit: int):
    """Index ranges whose summed sizes stay under ``limit`` (single larger items stand alone)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)
