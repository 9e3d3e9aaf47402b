"""Near-duplicate records with small edits (problem 2).

Every text becomes its set of word shingles. One-permutation hashing drops each
shingle hash into one of ``bands * rows`` bins and keeps the smallest per bin;
empty bins are filled by optimal densification (each probes bins along its own
hash sequence until one is occupied). Bands of ``rows`` bins are buckets, with
64-bit keys. In a bucket nobody is compared with everybody: one member, the
smallest under a hash that differs from band to band, is the centre of a star, so
a bucket of m texts gives m - 1 candidate edges, verified with exact Jaccard
similarity. Members that turn out far from their centre (under ``PIVOT`` of the
threshold) form a star of their own, under a new centre, ``ROUNDS`` times.

Two leaves close to one centre are compared unless their distances to it rule the
pair out (Jaccard distance obeys the triangle inequality). For groups, leaves
that both reach the threshold are linked through their centre already and are not
compared, so the candidate pairs of a group of alike texts grow with its size. For
pairs and link counts every link must be looked at, and the work follows their number.

What can be missed, beside texts that share no bucket: a pair whose members are
far from the centre in every bucket they share, and are left over after the last
round too. Buckets of up to ``ROUNDS`` + 2 texts are whole, larger ones that are
held together by common boilerplate only are not; see the README for measured recall.

Texts with equal shingle sets are one class and only its smallest id takes part,
so a group of copies that holds a third of all rows costs one row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.hashing import U, mix, shingle_batch, slabs
from corvane.operators.components import connected_components
from corvane.session import hot_join, restage, stage, unstage

SLAB = 2_000_000
BANDS, ROWS = 48, 4
PIVOT = 0.75  #: share of the threshold from which a text counts as close to its centre
ROUNDS = 2  #: further stars of texts that are far from their centre
HOT, WEDGE = 20_000, 1_000  #: rows of one key that are joined apart; leaves of a star in one block of leaf pairs


def densified(owner: np.ndarray, hashes: np.ndarray, n: int, bins: int) -> np.ndarray:
    """n x bins one-permutation signature with optimal densification.

    Rows without any shingle come back as zeros; callers leave them out.
    """
    sig = np.full(n * bins, np.iinfo(np.uint64).max, dtype=U)
    place = owner * bins + (hashes % U(bins)).astype(np.int64)
    np.minimum.at(sig, place, hashes // U(bins))
    sig = sig.reshape(n, bins)
    empty = sig == np.iinfo(np.uint64).max
    some = ~empty.all(axis=1)
    r, b = np.nonzero(empty & some[:, None])
    full = sig.copy()
    step = 0
    while len(r):
        step += 1
        with np.errstate(over="ignore"):
            probe = (mix(b.astype(U) * U(0x9E3779B97F4A7C15) + U(step)) % U(bins)).astype(np.int64)
        ok = ~empty[r, probe]
        full[r[ok], b[ok]] = sig[r[ok], probe[ok]]
        r, b = r[~ok], b[~ok]
    full[~some] = 0
    return full


def _features(k: int, min_tokens: int, bands: int, rows: int):
    """Batches of (doc_id, text) to (doc_id, n, set hash, band hashes)."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for lo, hi in slabs(np.array([len(t) for t in texts]), SLAB):
                owner, h, counts = shingle_batch(texts[lo:hi], k)
                n = hi - lo
                size = np.bincount(owner, minlength=n)
                keep = (counts >= min_tokens) & (size > 0)
                with np.errstate(over="ignore"):
                    s1, s2 = np.zeros(n, U), np.zeros(n, U)
                    np.add.at(s1, owner, mix(h))
                    np.add.at(s2, owner, mix(h ^ U(0xA5A5A5A5A5A5A5A5)))
                    sig = densified(owner, h, n, bands * rows)[keep].reshape(-1, bands, rows)
                    key = np.zeros(sig.shape[:2], U)
                    for j in range(rows):
                        key = mix(key * U(31) + sig[:, :, j])
                    key = mix(key + np.arange(bands, dtype=U))  # a key says which band it is of
                key = key.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo:hi][keep]), pa.array(size[keep].astype(np.int32)), pa.array(s1[keep].view(np.int64)), pa.array(s2[keep].view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1, dtype=np.int32) * bands), pa.array(key.reshape(-1)))],
                    ["doc_id", "n", "set_a", "set_b", "bands"])

    return run


def _sets(k: int):
    """Batches of (doc_id, text) to (doc_id, sorted distinct shingle hashes)."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slabs(np.array([len(t) for t in texts]), SLAB):
                owner, h, _ = shingle_batch(texts[lo:hi], k)
                off = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=hi - lo)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.ListArray.from_arrays(pa.array(off), pa.array(h.view(np.int64)))], ["doc_id", "sh"])

    return run


@dataclass
class NearDuplicates:
    """``pairs``: rep_a, rep_b, similarity of different texts; ``members``: doc_id, rep."""

    pairs: DataFrame
    members: DataFrame


def near_duplicates(documents: DataFrame, k: int = 5, threshold: float = 0.8, min_tokens: int | None = None, bands: int = BANDS, rows: int = ROWS, groups: bool = False) -> NearDuplicates:
    """Pairs of class representatives with Jaccard >= ``threshold``, and class membership.

    ``documents`` needs ``doc_id`` and ``text``; other columns are ignored. Null and
    blank texts, and texts under ``min_tokens`` tokens (default ``k``), take no part
    and have no class. Texts are compared whole, lower-cased. With ``groups`` the
    pairs are only as many as connect the groups.
    """
    min_tokens = min_tokens or k
    low = documents.select("doc_id", F.lower("text").alias("text")).where("text is not null and doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text")) if not _unique(documents) else documents.select("doc_id", F.lower("text").alias("text")).where("text is not null and doc_id is not null")
    feats = stage(low.mapInArrow(_features(k, min_tokens, bands, rows), "doc_id bigint, n int, set_a bigint, set_b bigint, bands array<bigint>"))
    alike = ["set_a", "set_b", "n"]
    keys = feats.select("doc_id", *alike)
    classes = stage(keys.groupBy(*alike).agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")))
    members = stage(hot_join(keys, classes, alike, "c", HOT).select("doc_id", "rep", "n"))
    reps = feats.select("doc_id", "n", "bands").join(members.where("doc_id <> rep").select("doc_id"), "doc_id", "left_anti")
    entries = reps.select("doc_id", "n", F.explode("bands").alias("key"))
    done: list[DataFrame] = []
    for turn in range(ROUNDS + 1):
        stars = entries.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct(F.hash("doc_id", "key").alias("o"), "doc_id", "n")).alias("c")).where("m > 1")
        stars = stage(stars.select("key", "m", F.col("c.doc_id").alias("centre"), F.col("c.n").alias("cn")))
        spokes = hot_join(entries, stars, ["key"], "m", HOT).where("doc_id <> centre")
        spokes = stage(spokes.select("key", "doc_id", "n", "cn", F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b")))
        # Close texts have sizes close to each other.
        edges = spokes.where(F.least("n", "cn") >= F.greatest("n", "cn") * F.lit(PIVOT * threshold)).select("a", "b").distinct()
        seen = restage(done).select("a", "b") if done else None
        done.append(_verify(low, stage(edges.join(seen, ["a", "b"], "left_anti") if seen is not None else edges), k))
        if turn < ROUNDS:
            near = restage(done).where(F.col("sim") >= threshold * PIVOT).select("a", "b")
            entries = stage(spokes.join(near, ["a", "b"], "left_anti").select("doc_id", "n", "key"))
            if entries.isEmpty():
                break
    first = restage(done)
    # Leaves of one centre: |d(c,x) - d(c,y)| > 1 - threshold rules a pair out.
    half = first.where(F.col("sim") >= threshold * PIVOT)
    ends = half.select(F.col("a").alias("c"), F.col("b").alias("x"), "sim", F.col("nb").alias("nx")).unionByName(half.select(F.col("b").alias("c"), F.col("a").alias("x"), "sim", F.col("na").alias("nx")))
    ends = stage(ends)
    # Pairs of leaves meet in pairs of blocks, so a star of any size is spread over tasks.
    size = ends.groupBy("c").agg(F.count("*").alias("deg")).where("deg > 1").withColumn("nb", F.ceil(F.col("deg") / WEDGE).cast("int"))
    ends = hot_join(ends, size, ["c"], "deg", HOT).withColumn("own", F.pmod(F.xxhash64("x"), F.col("nb")).cast("int")).withColumn("far", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    left = ends.select("c", F.col("own").alias("i"), F.col("far").alias("j"), "x", "sim", "nx")
    other = ends.select("c", F.col("far").alias("i"), F.col("own").alias("j"), F.col("x").alias("y"), F.col("sim").alias("sim2"), F.col("nx").alias("ny"))
    unlinked = (F.col("sim") < threshold) | (F.col("sim2") < threshold) if groups else F.lit(True)
    wedge = (
        left.join(other, ["c", "i", "j"])
        .where((F.col("x") < F.col("y")) & unlinked & (F.abs(F.col("sim") - F.col("sim2")) <= 1 - threshold + 1e-9) & (F.least("nx", "ny") >= F.greatest("nx", "ny") * F.lit(threshold)))
        .select(F.col("x").alias("a"), F.col("y").alias("b")).distinct().join(first.select("a", "b"), ["a", "b"], "left_anti")
    )
    second = _verify(low, stage(wedge), k)
    pairs = first.unionByName(second).where(F.col("sim") >= threshold).select(F.col("a").alias("rep_a"), F.col("b").alias("rep_b"), F.col("sim").alias("similarity"))
    return NearDuplicates(pairs, members.select("doc_id", "rep"))


def _unique(documents: DataFrame) -> bool:
    """True if ``doc_id`` is declared unique by the caller through column metadata."""
    return bool(next(f for f in documents.schema.fields if f.name == "doc_id").metadata.get("unique"))


def unique_ids(documents: DataFrame) -> DataFrame:
    """Declare ``doc_id`` unique, which saves a shuffle of the texts."""
    return documents.withMetadata("doc_id", {"unique": True})


def _verify(low: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Exact Jaccard similarity of candidate pairs, from the whole texts."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = whole = stage(low.join(ids, "doc_id", "left_semi").mapInArrow(_sets(k), "doc_id bigint, sh array<bigint>"))
    # A centre may have a third of all texts as leaves, on either side.
    deg = pairs.select(F.explode(F.array(F.struct(F.lit(0).alias("s"), F.col("a").alias("doc_id")), F.struct(F.lit(1).alias("s"), F.col("b").alias("doc_id")))).alias("e")).groupBy("e.doc_id").agg(
        F.sum(1 - F.col("e.s")).alias("da"), F.sum("e.s").alias("db"))
    sets = sets.join(stage(deg), "doc_id")
    met = hot_join(pairs, sets.where("da > 0").select(F.col("doc_id").alias("a"), F.col("sh").alias("sa"), "da"), ["a"], "da", HOT)
    met = hot_join(met, sets.where("db > 0").select(F.col("doc_id").alias("b"), F.col("sh").alias("sb"), "db"), ["b"], "db", HOT)
    inter = F.size(F.array_intersect("sa", "sb"))
    out = stage(met.select(
        "a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), (inter / (F.size("sa") + F.size("sb") - inter)).alias("sim")))
    unstage(whole)
    return out


def expand_pairs(found: NearDuplicates) -> DataFrame:
    """``doc_id_a, doc_id_b`` of all members: across linked classes and within classes."""
    m = found.members
    ma, mb = m.select(F.col("doc_id").alias("x"), F.col("rep").alias("rep_a")), m.select(F.col("doc_id").alias("y"), F.col("rep").alias("rep_b"))
    across = found.pairs.join(ma, "rep_a").join(mb, "rep_b").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
    many = m.groupBy("rep").agg(F.count("*").alias("c")).where("c > 1").select("rep")
    inside = m.join(many, "rep").select("rep", F.col("doc_id").alias("x")).join(m.select("rep", F.col("doc_id").alias("y")), "rep").where("x < y").select(F.col("x").alias("doc_id_a"), F.col("y").alias("doc_id_b"))
    return across.unionByName(inside)


def link_counts(found: NearDuplicates) -> DataFrame:
    """One row per document: ``doc_id, class_id, links`` (number of similar documents, copies included)."""
    sizes = found.members.groupBy("rep").agg(F.count("*").alias("c"))
    both = found.pairs.select(F.col("rep_a").alias("rep"), F.col("rep_b").alias("o")).unionByName(found.pairs.select(F.col("rep_b").alias("rep"), F.col("rep_a").alias("o")))
    across = both.join(sizes.withColumnRenamed("rep", "o"), "o").groupBy("rep").agg(F.sum("c").alias("across"))
    facts = sizes.join(across, "rep", "left").select("rep", "c", (F.col("c") - 1 + F.coalesce("across", F.lit(0))).alias("links"))
    return hot_join(found.members, facts, ["rep"], "c", HOT).select("doc_id", F.col("rep").alias("class_id"), "links")


def duplicate_groups(documents: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """``doc_id, group_id``: texts linked directly or through others; the group is its smallest document.

    Texts without links are groups of their own; the rest as in ``near_duplicates``.
    """
    found = near_duplicates(documents, k, threshold, groups=True)
    comp = connected_components(found.pairs, "rep_a", "rep_b")
    return found.members.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("group_id"))
