"""Vector expressions: norms, cosine, projections for bucketed search."""

from __future__ import annotations

from itertools import combinations
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TABLES, BITS, DIMS = 12, 12, 8
# Fixed value: the version that leads every bucket key.
INDEX_VERSION = "sparse-rp-lsh-v2-scoped"
MIN_COSINE = 0.22
PROBES = 128  #: buckets a query asks per table; a stored vector is filed under two
_UNESCAPED = "!'()*-._~"  # what stays as it is in a component of an address


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the common length; 0 for null, empty and zero vectors."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, F.greatest(n, F.lit(0))), F.slice(b, 1, F.greatest(n, F.lit(0)))
    length = norm(x) * norm(y)
    return F.coalesce(F.when(length > 0, dot(x, y) / length), F.lit(0.0))


def normalize(a: Column) -> Column:
    """Unit length; zero vectors unchanged."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def is_finite(a: Column) -> Column:
    return F.coalesce(F.forall(a, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def _stream(seed: int):
    """The 32-bit generator that fixes the planes (public-domain mulberry32)."""
    word = 0xFFFFFFFF
    while True:
        seed = (seed + 0x6D2B79F5) & word
        v = seed
        v = ((v ^ (v >> 15)) * (v | 1)) & word
        v ^= (v + ((v ^ (v >> 7)) * (v | 61) & word)) & word
        yield ((v ^ (v >> 14)) & word) / 4294967296


def planes(dimension: int) -> list[list[list[tuple[int, int]]]]:
    """Per table and bit the sampled coordinates with their signs."""
    out = []
    for table in range(TABLES):
        row = []
        for bit in range(BITS):
            r = _stream(0x51F15E + dimension * 97 + table * 7919 + bit * 104729)
            row.append([(int(next(r) * dimension), -1 if next(r) < 0.5 else 1) for _ in range(DIMS)])
        out.append(row)
    return out


def projections(x: np.ndarray) -> np.ndarray:
    """n x TABLES x BITS sums of signed coordinates, added in the order they are drawn (sums near zero decide bits)."""
    drawn = np.array(planes(x.shape[1]))
    out = np.zeros((len(x), TABLES, BITS))
    for k in range(DIMS):
        out += x[:, drawn[:, :, k, 0]] * drawn[:, :, k, 1]
    return out


def signatures(x: np.ndarray) -> np.ndarray:
    """n x TABLES x 2 signatures: the exact one and the one with the least certain bit (the first on ties) flipped."""
    p = projections(x)
    weights = 1 << np.arange(BITS)
    sig = ((p >= 0) * weights).sum(2)
    return np.stack([sig, sig ^ weights[np.abs(p).argmin(2)]], axis=2)


#: Sets of up to three bits that a query may flip in a signature.
_FLIPS = np.array([[b in s for b in range(BITS)] for n in range(4) for s in combinations(range(BITS), n)], dtype=float)


def probes(x: np.ndarray, count: int) -> np.ndarray:
    """n x TABLES x ``count`` signatures a query asks: its own, then those whose flipped bits are the least certain together."""
    p = projections(x)
    weights = 1 << np.arange(BITS)
    best = np.argsort(np.abs(p) @ _FLIPS.T, axis=2, kind="stable")[:, :, :count]
    return ((p >= 0) * weights).sum(2)[:, :, None] ^ (_FLIPS @ weights).astype(np.int64)[best]


def _keys(vectors: list, scopes: list, dimension: int, asked: int | None = None) -> list[list[str]]:
    ok = [i for i, v in enumerate(vectors) if v is not None and len(v) == dimension and np.isfinite(np.asarray(v, float)).all()]
    out: list[list[str]] = [[] for _ in vectors]
    if ok:
        x = np.stack([np.asarray(vectors[i], float) for i in ok])
        sig = signatures(x) if asked is None else probes(x, asked)
        for row, i in zip(sig, ok):
            head = f"{INDEX_VERSION}:{quote(scopes[i] or '', safe=_UNESCAPED)}:"
            out[i] = [f"{head}{t}:{s}" for t in range(TABLES) for s in row[t]]
    return out


def bucket_keys(v: Column, scope: Column, dimension: int) -> Column:
    """24 bucket keys of a vector, two per table; empty for another length or non-finite values.

    One matrix product per Arrow batch.
    """

    @F.pandas_udf("array<string>")
    def keys(vec: pd.Series, sc: pd.Series) -> pd.Series:
        return pd.Series(_keys(vec.tolist(), sc.tolist(), dimension))

    return keys(v, scope)


def query_keys(v: list[float], scope: str, asked: int = PROBES) -> list[str]:
    """The buckets one query vector asks: ``asked`` per table."""
    return _keys([v], [scope], len(v), asked)[0]


def probe_keys(v: Column, scope: Column, dimension: int, asked: int = PROBES) -> Column:
    """``query_keys`` for a column of query vectors."""

    @F.pandas_udf("array<string>")
    def keys(vec: pd.Series, sc: pd.Series) -> pd.Series:
        return pd.Series(_keys(vec.tolist(), sc.tolist(), dimension, asked))

    return keys(v, scope)
