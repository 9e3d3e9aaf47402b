"""Long exact spans shared between records (problem 10).

Level-wise doubling. Level 1 takes windows of 64 characters; those whose hash
occurs in one text alone are dropped, the others are extended to twice their
length, to the right and to the left, and again only those repeated in different
texts survive. A window inside a span of ``least`` characters has a side that holds
windows of up to ``(least + 65) / 2``, so doubling goes on to the longest such length
(128 for 200); beyond it a span could be lost. Then no candidate is left to
extend: two occurrences are compared character by character, within the
surroundings that decide about a span of ``least`` (136 before, 200 after).

Not every window has to be tried: in any run of 137 window starts, the one with
the smallest hash is taken. A shared span of 200 characters contains exactly
such a run in either text, so both texts pick the same windows in it, no span is
lost, and the surroundings of its windows cover it. (For another ``least`` length
the run is ``least - 63`` long.) Of places with equal surroundings in one text only
the first takes part, and what is found there holds for all of them.

A last-level window that occurs more than ``WIDE`` times is not paired up: the
neighbourhoods of its occurrences are cut into all windows of ``least``
characters, and those repeated in different texts (by 128 bits of hash) are kept as
(text, position) rows. They give the shared share of a text without any pairs.
Where pairs are asked for, windows that stand in the same set of texts (recognised
by count, sum and exclusive or of id hashes) are represented by one, so the work
follows the result. Equal texts are one class, and only its smallest id takes part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.hashing import U, mix
from corvane.session import hot_join, stage

BASE = 64
WIDE = 48
HOT = 20_000  #: rows of one key that are joined apart
SEGMENT = 400_000
_ODD = 0x9E3779B97F4A7C15
_TOP = np.iinfo(np.uint64).max


class Rolling:
    """Hashes of arbitrary windows of one code point array in O(1) each (prefix sums modulo 2^64)."""

    powers = np.ones(1, U)
    inverse = np.ones(1, U)

    def __init__(self, cp: np.ndarray, salt: int = 1):
        n = len(cp) + 1
        if len(Rolling.powers) < n:
            with np.errstate(over="ignore"):
                Rolling.powers = np.cumprod(np.concatenate(([U(1)], np.full(n, U(_ODD)))), dtype=U)
                Rolling.inverse = np.cumprod(np.concatenate(([U(1)], np.full(n, U(pow(_ODD, -1, 1 << 64))))), dtype=U)
        with np.errstate(over="ignore"):
            self.prefix = np.concatenate(([U(0)], np.cumsum(mix(cp.astype(U) + U(salt)) * Rolling.powers[: n - 1], dtype=U)))

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.prefix[end] - self.prefix[start]) * Rolling.inverse[start])


def _extreme(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every ``width`` consecutive values, by doubling; result[i] covers x[i : i + width]."""
    step = 1
    out = x
    while step * 2 <= width:
        out = op(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return op(out[: len(out) - rest], out[rest:]) if rest else out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def segments(texts: list[str], least: int):
    """(text index, offset, text piece, first window start, last window start) of long texts cut with margins."""
    margin = least - BASE
    for i, t in enumerate(texts):
        starts = len(t) - least + 1
        for lo in range(0, max(starts, 0), SEGMENT):
            hi = min(lo + SEGMENT, starts)
            a, b = max(0, lo - margin), min(len(t), hi + margin + least)
            yield i, a, t[a:b], lo - a, hi - a


def levels_of(least: int) -> int:
    """Doublings after level 1 that no span of ``least`` characters can miss."""
    return ((least + 65) // (2 * BASE)).bit_length() - 1


def select_windows(texts: list[str], least: int):
    """Chosen 64-character windows: (text index, position, hash, surroundings, left keys, right keys), keys by level."""
    steps = [BASE << j for j in range(1, levels_of(least) + 1)]
    width = least - BASE + 1
    pend, size, out = [], 0, []

    def flush():
        if not pend:
            return
        cps = [code_points(p[2]) for p in pend]
        lens = np.array([len(c) for c in cps])
        base = np.concatenate(([0], np.cumsum(lens)))
        cp = np.concatenate(cps)
        roll = Rolling(cp)
        n = len(cp)
        h = roll.at(np.arange(n - BASE + 1), np.arange(BASE, n + 1))
        h = np.concatenate((h, np.full(BASE - 1, _TOP)))
        low = _extreme(h, width, np.minimum)
        valid = np.zeros(len(low), bool)
        for k, p in enumerate(pend):
            valid[base[k] + p[3] : base[k] + p[4]] = True
        low = np.where(valid, low, U(0))
        high = _extreme(np.concatenate((np.zeros(width - 1, U), low, np.zeros(width - 1, U))), width, np.maximum)[: n]
        pos = np.nonzero((h[: len(high)] == high) & (high > 0))[0]
        if not len(pos):
            return
        seg = np.searchsorted(base, pos, side="right") - 1
        s0, s1 = base[seg], base[seg + 1]
        left = np.maximum(pos - (least - BASE), s0)
        right = np.minimum(pos + least, s1)
        around = roll.at(left, right) ^ mix((pos - left).astype(U) * U(1 << 20) + (right - pos).astype(U))
        mine = h[pos]
        with np.errstate(over="ignore"):
            kr = np.stack([np.where(pos + w <= s1, roll.at(pos, np.minimum(pos + w, s1)), U(0)) for w in steps], axis=1)
            kl = np.stack([np.where(pos + BASE - w >= s0, roll.at(np.maximum(pos + BASE - w, s0), pos + BASE), U(0)) for w in steps], axis=1)
        own = np.array([p[0] for p in pend])[seg]
        off = np.array([p[1] for p in pend])[seg]
        out.append((own, pos - s0 + off, mine, around, kl, kr))

    for s in segments(texts, least):
        pend.append(s)
        size += len(s[2])
        if size >= SEGMENT:
            flush()
            pend, size = [], 0
    flush()
    if not out:
        return tuple(np.zeros((0, len(steps)) if j > 3 else 0, np.int64 if j < 2 else U) for j in range(6))
    own, pos, *rest = (np.concatenate(c) for c in zip(*out))
    # Segments of long texts overlap.
    keep = np.unique(np.stack((own, pos), axis=1), axis=0, return_index=True)[1]
    return own[keep], pos[keep], *(c[keep] for c in rest)


WINDOWS = "doc_id bigint, pos int, h bigint, around bigint, lone boolean, kl array<bigint>, kr array<bigint>"


def _windows(least: int):
    """Batches of (doc_id, text) to windows; ``lone`` marks the first of places with equal surroundings in one text."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            own, pos, h, around, kl, kr = select_windows(texts, least)
            order = np.lexsort((pos, around, own))
            new = np.ones(len(own), bool)
            new[1:] = (own[order][1:] != own[order][:-1]) | (around[order][1:] != around[order][:-1])
            first = np.zeros(len(own), bool)
            first[order] = new
            offs = pa.array(np.arange(len(own) + 1, dtype=np.int32) * kl.shape[1])
            keys = [pa.ListArray.from_arrays(offs, pa.array(np.ascontiguousarray(c).reshape(-1).view(np.int64))) for c in (kl, kr)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[own]), pa.array(pos.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(around.view(np.int64)), pa.array(first), *keys],
                ["doc_id", "pos", "h", "around", "lone", "kl", "kr"])

    return run


def common(a: str, b: str, back: bool = False) -> int:
    """Length of the common start (or end) of two strings."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        same = a[len(a) - mid :] == b[len(b) - mid :] if back else a[:mid] == b[:mid]
        lo, hi = (mid, hi) if same else (lo, mid - 1)
    return lo


def _surroundings(least: int):
    """Batches of (doc_id, text, places) to one row per place with the text that decides about it."""

    def run(batches):
        for batch in batches:
            for doc, text, places in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for lo in range(0, len(places), 4096):
                    part = places[lo : lo + 4096]
                    before = [text[max(0, p["pos"] - least + BASE) : p["pos"]] for p in part]
                    behind = [text[p["pos"] : p["pos"] + least] for p in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p["k"] for p in part], pa.int64()), pa.array([doc] * len(part), pa.int64()), pa.array([p["around"] for p in part], pa.int64()), pa.array(before, pa.string()), pa.array(behind, pa.string())],
                        ["k", "doc_id", "around", "before", "behind"])

    return run


def _meet(least: int):
    """Batches of two places with one key to their common stretch, if it is ``least`` long: (a, around_a, b, around_b, left, right)."""

    def run(batches):
        for batch in batches:
            a, ra, la, ba, b, rb, lb, bb = (batch.column(i).to_pylist() for i in range(8))
            rows = []
            for i in range(len(a)):
                right = common(ba[i], bb[i])
                left = common(la[i], lb[i], True) if right >= BASE else 0
                if left + right >= least:
                    rows.append((a[i], ra[i], b[i], rb[i], left, right))
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if j < 4 else pa.int32()) for j, c in enumerate(cols)], ["a", "around_a", "b", "around_b", "left", "right"])

    return run


def _cut(least: int):
    """Batches of (doc_id, text, positions) to all ``least``-windows around the positions."""

    def run(batches):
        for batch in batches:
            for doc, text, at in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if len(text) < least:
                    continue
                want = np.unique(np.concatenate([np.arange(max(0, p - least + BASE), min(p, len(text) - least) + 1) for p in at]))
                for lo in range(0, len(want), SEGMENT):
                    w = want[lo : lo + SEGMENT]
                    if not len(w):
                        continue
                    cp = code_points(text[w[0] : w[-1] + least])
                    h, h2 = (Rolling(cp, salt).at(w - w[0], w - w[0] + least) for salt in (1, 1 << 40))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), doc)), pa.array(w.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(h2.view(np.int64))], ["doc_id", "pos", "h", "h2"])

    return run


def _repeated(df: DataFrame, *key: str) -> DataFrame:
    """Rows whose key occurs in different texts (counts are combined before their shuffle)."""
    many = stage(df.groupBy(*key).agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi"), F.count("*").alias("_n")).where("_lo <> _hi").select(*key, "_n"))
    return hot_join(df, many, list(key), "_n", HOT).drop("_n")


@dataclass
class SharedSpans:
    """``spans``: a, around_a, b, around_b, left, right: a stretch from ``left`` before to ``right`` behind places of two class
    representatives; ``places``: doc_id, around, pos of the places; ``windows``: doc_id, pos, h, h2 of repeated
    ``least``-windows around crowded places; ``members``: doc_id, rep, n_chars."""

    spans: DataFrame
    places: DataFrame
    windows: DataFrame
    members: DataFrame
    least: int


def shared_spans(documents: DataFrame, least: int = 200) -> SharedSpans:
    """Verbatim spans of at least ``least`` (>= 191) code points in two different texts.

    Case and white space count. Null texts and texts under ``least`` characters take
    no part; rows with a null ``doc_id`` are ignored; other columns are not read.
    """
    if least < 3 * BASE - 1:
        raise ValueError(f"least must be {3 * BASE - 1} or more")
    docs = documents.select("doc_id", "text").where((F.length("text") >= least) & F.col("doc_id").isNotNull())
    alike = ["t1", "t2", "n_chars"]
    keys = docs.select("doc_id", F.xxhash64("text").alias("t1"), F.hash("text").alias("t2"), F.length("text").alias("n_chars"))
    classes = stage(keys.groupBy(*alike).agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")))
    members = stage(hot_join(keys, classes, alike, "c", HOT).select("doc_id", "rep", "n_chars"))
    copies = members.where("doc_id <> rep").select("doc_id")
    texts = docs.join(copies, "doc_id", "left_anti")
    every = stage(texts.mapInArrow(_windows(least), WINDOWS))
    level = _repeated(every.where("lone").select("doc_id", "pos", "around", "h", "kl", "kr"), "h")
    level = stage(level.select("doc_id", "pos", "around", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("kl").alias("ks")), F.struct(F.lit(1).alias("side"), F.col("kr").alias("ks")))).alias("s")).select("doc_id", "pos", "around", "s.side", "s.ks"))
    for j in range(levels_of(least)):
        at = level.withColumn("k", F.get("ks", F.lit(j))).where("k <> 0").withColumn("k", F.xxhash64("side", "k"))
        level = stage(_repeated(at, "k"))
    wide = stage(level.groupBy("k").agg(F.count("*").alias("m")).where(F.col("m") > WIDE).select("k", "m"))
    usual = level.join(wide.select("k"), "k", "left_anti")
    near = usual.groupBy("doc_id").agg(F.collect_list(F.struct("k", "pos", "around")).alias("places"))
    seen = stage(docs.join(near, "doc_id").select("doc_id", "text", "places").mapInArrow(_surroundings(least), "k bigint, doc_id bigint, around bigint, before string, behind string"))
    x = seen.select("k", F.col("doc_id").alias("a"), F.col("around").alias("around_a"), F.col("before").alias("la"), F.col("behind").alias("ba"))
    y = seen.select("k", F.col("doc_id").alias("b"), F.col("around").alias("around_b"), F.col("before").alias("lb"), F.col("behind").alias("bb"))
    grown = x.join(y.hint("merge"), "k").where("a < b").drop("k").mapInArrow(_meet(least), "a bigint, around_a bigint, b bigint, around_b bigint, left int, right int")
    windows = documents.sparkSession.createDataFrame([], "doc_id bigint, pos int, h bigint, h2 bigint")
    places = every.select("doc_id", "around", "pos")
    if not wide.isEmpty():
        crowded = hot_join(level, wide, ["k"], "m", HOT).select("doc_id", "around").distinct()
        at = places.join(crowded, ["doc_id", "around"]).groupBy("doc_id").agg(F.collect_set("pos").alias("at"))
        cut = stage(docs.join(at, "doc_id").select("doc_id", "text", "at").mapInArrow(_cut(least), "doc_id bigint, pos int, h bigint, h2 bigint"))
        windows = stage(_repeated(cut, "h", "h2").select("doc_id", "pos", "h", "h2"))
    return SharedSpans(grown, places, windows, members, least)


def window_pairs(windows: DataFrame) -> DataFrame:
    """``a, b`` of texts with an equal window, each set of texts expanded once."""
    one = windows.select(F.xxhash64("h", "h2").alias("h"), "doc_id").distinct()
    sets = one.groupBy("h").agg(F.count("*").alias("c"), F.sum(F.xxhash64("doc_id") % 1_000_000_007).alias("s"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("x"))
    lead = sets.groupBy("c", "s", "x").agg(F.min("h").alias("h")).select("h")
    some = one.join(lead, "h")
    return some.select("h", F.col("doc_id").alias("a")).join(some.select("h", F.col("doc_id").alias("b")), "h").where("a < b").select("a", "b")


def shared_pairs(found: SharedSpans) -> DataFrame:
    """``doc_id_a, doc_id_b`` of all documents that share a span, copies included."""
    m = found.members.select("doc_id", "rep")
    reps = found.spans.select("a", "b").unionByName(window_pairs(found.windows)).distinct()
    across = reps.join(m.select(F.col("doc_id").alias("x"), F.col("rep").alias("a")), "a").join(m.select(F.col("doc_id").alias("y"), F.col("rep").alias("b")), "b")
    many = m.groupBy("rep").agg(F.count("*").alias("c")).where("c > 1").select("rep")
    inside = m.join(many, "rep").select("rep", F.col("doc_id").alias("x")).join(m.select("rep", F.col("doc_id").alias("y")), "rep").where("x < y")
    pick = [F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")]
    return across.select(*pick).unionByName(inside.select(*pick)).distinct()


def shared_share(found: SharedSpans) -> DataFrame:
    """``doc_id, n_chars, shared_chars, share``: how much of each text stands elsewhere too."""
    from pyspark.sql import Window as W

    ends = [found.spans.select(F.col(x).alias("doc_id"), F.col(f"around_{x}").alias("around"), "left", "right") for x in "ab"]
    widest = ends[0].unionByName(ends[1]).distinct()
    s = widest.join(found.places, ["doc_id", "around"]).select(F.col("doc_id").alias("rep"), (F.col("pos") - F.col("left")).alias("lo"), (F.col("pos") + F.col("right")).alias("hi"))
    s = s.unionByName(found.windows.select(F.col("doc_id").alias("rep"), F.col("pos").alias("lo"), (F.col("pos") + found.least).alias("hi")))
    s = s.groupBy("rep", "lo").agg(F.max("hi").alias("hi"))
    before = W.partitionBy("rep").orderBy("lo").rowsBetween(W.unboundedPreceding, -1)
    own = s.withColumn("top", F.coalesce(F.max("hi").over(before), F.lit(0))).groupBy("rep").agg(F.sum(F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", "top"))).alias("own"))
    sizes = found.members.groupBy("rep").agg(F.count("*").alias("c"))
    chars = F.when(F.col("c") > 1, F.col("n_chars")).otherwise(F.coalesce("own", F.lit(0)))
    facts = sizes.join(own, "rep", "left")
    return hot_join(found.members, facts, ["rep"], "c", HOT).select("doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), chars.cast("bigint").alias("shared_chars"), F.round(chars / F.col("n_chars"), 6).alias("share"))
