"""Semantic near-duplicates of files from their chunk vectors, and folder suggestions.

Centroids shortlist pairs, then chunks are matched one to one and in order. The
shortlist is exact: all profiles are compared with all profiles. A task holds one block of
askers and reads the profiles in slices from the shared folder, where they are
written once, so disk grows with the number of files and work with its square; the
similarity search of problem 1 is the operator for large collections.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions import vectors as V
from corvane.functions.catalog import millis
from corvane.operators.components import connected_components
from corvane.session import batches_of, stage

PROFILE, SHORTLIST, MAX_FILES, MARGIN = 12, 8, 500, 0.05
BLOCK = 4096
SLICE = 4096  #: profiles read at a time
PAIRS = 25_000  #: pairs scored by a task, which holds the chunks of their files
CLOSE = 1e-5  #: more than single precision errs in the product of two unit vectors


def representatives(vectors: DataFrame, count: int = PROFILE) -> DataFrame:
    """At most ``count`` evenly spread chunk vectors per file: ``file_id, pos, idx, embedding`` (pos from 0)."""
    w = W.partitionBy("file_id")
    ranked = vectors.select("file_id", "id", "idx", "embedding").withColumn("r", F.row_number().over(w.orderBy("idx", "id")) - 1).withColumn("n", F.count("*").over(w))
    slots = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: T.half_up(i * (F.col("n") - 1) / (count - 1)))
    pos = F.when(F.col("n") <= count, F.col("r") + 1).otherwise(F.array_position(slots, F.col("r").cast("bigint")))
    return ranked.withColumn("pos", pos.cast("int") - 1).where("pos >= 0").select("file_id", "pos", "idx", "embedding")


def _mean(rows, n):
    """Normalised mean of ``n`` vectors, added one after the other."""
    double = lambda v: F.transform(v, lambda x: x.cast("double"))
    total = F.aggregate(F.slice(rows, 2, 1 << 30), double(F.get(rows, F.lit(0))), lambda acc, r: F.zip_with(acc, double(r), lambda x, y: x + y))
    return V.normalize(F.transform(total, lambda x: x / n))


def centroids(reps: DataFrame) -> DataFrame:
    """``file_id, centroid``: normalised mean of a file's representative chunks, added in order, so equal profiles have equal centroids."""
    rows = reps.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "embedding"))), lambda s: s["embedding"]).alias("l"))
    return rows.select("file_id", _mean(F.col("l"), F.size("l")).alias("centroid"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def shortlist(profiles: DataFrame, top: int = SHORTLIST, blocks: int = 1) -> DataFrame:
    """``file_id, other, similarity``: per profile its ``top`` nearest others by centroid cosine (ties: smaller id).

    Exact, so every profile meets every other. Equal centroids are one class, with its ``top`` + 1
    smallest ids; askers are cut into ``blocks``, and a task reads all classes in slices. Products in
    single precision rule out what cannot be near enough, the rest is taken in double.
    """
    grouped = profiles.groupBy("centroid").agg(F.array_sort(F.collect_list("file_id")).alias("ids"))
    classes = stage(grouped.select(F.col("ids")[0].alias("rep"), "centroid", F.slice("ids", 1, top + 1).alias("heads"), "ids"))
    files, keep = classes.inputFiles(), top + 1

    def merged(best, more):
        best = pd.concat([best, *more], ignore_index=True).sort_values(["i", "s", "id"], ascending=[True, False, True])
        return best[best.groupby("i").cumcount() < keep]

    def near(batches):
        mine = [b for b in batches if b.num_rows]
        if not mine:
            return
        q = np.concatenate([_matrix(b.column(1)) for b in mine])
        q32, least = q.astype(np.float32), np.full(len(q), -np.inf)
        best, more = pd.DataFrame({"i": np.zeros(0, int), "s": np.zeros(0), "id": np.zeros(0, object)}), []
        for b in batches_of(files, ["centroid", "heads"], SLICE):
            d, heads = _matrix(b.column(0)), b.column(1)
            s = q32 @ d.astype(np.float32).T
            if len(d) >= keep and np.isinf(least).any():
                least = np.maximum(least, np.partition(s, -keep, axis=1)[:, -keep] - CLOSE)
            i, j = np.divmod(np.flatnonzero(s >= (least - CLOSE)[:, None].astype(np.float32)), len(d))
            if not len(i):
                continue
            exact = np.concatenate([np.round(np.einsum("ij,ij->i", q[i[k : k + 100_000]], d[j[k : k + 100_000]]), 12) for k in range(0, len(i), 100_000)])
            ok = exact >= least[i]
            i, j, exact = i[ok], j[ok], exact[ok]
            sizes = np.diff(heads.offsets.to_numpy())[j]
            ids = heads.take(pa.array(j)).flatten().to_numpy(zero_copy_only=False)
            more.append(pd.DataFrame({"i": np.repeat(i, sizes), "s": np.repeat(exact, sizes), "id": ids}))
            if sum(map(len, more)) > len(q) // 2:
                best, more = merged(best, more), []
                full = best.groupby("i")["s"].agg(["size", "min"])
                full = full[full["size"] == keep]
                least[full.index] = full["min"]
        best = merged(best, more)
        reps = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in mine])
        ends = np.searchsorted(best["i"].to_numpy(), np.arange(len(q) + 1)).astype(np.int32)
        found = pa.StructArray.from_arrays([pa.array(best["id"], pa.string()), pa.array(best["s"], pa.float64())], ["other", "similarity"])
        yield pa.RecordBatch.from_arrays([pa.array(reps, pa.string()), pa.ListArray.from_arrays(pa.array(ends), found)], ["rep", "best"])

    got = classes.select("rep", "centroid").repartition(blocks).mapInArrow(near, "rep string, best array<struct<other:string,similarity:double>>")
    each = stage(got).join(classes.select("rep", "ids"), "rep").select(F.explode("ids").alias("file_id"), "best")
    others = F.slice(F.filter("best", lambda x: x["other"] != F.col("file_id")), 1, top)
    return each.select("file_id", F.explode(others).alias("o")).select("file_id", "o.other", "o.similarity")


def ordered_overlap(left: np.ndarray, right: np.ndarray, threshold: float) -> float | None:
    """Score of two chunk profiles: greedy one-to-one matches, longest in-order run, coverage times mean similarity."""
    norm = lambda m: m / np.maximum(np.sqrt((m**2).sum(1)), 1e-300)[:, None]
    sim = norm(left) @ norm(right).T
    if sim.max(initial=-1.0) < max(0.55, threshold - 0.15):
        return None
    near = [(-round(float(sim[i, j]), 12), i, j) for i, j in zip(*np.nonzero(sim >= max(0.55, threshold - 0.15)))]
    rows, cols, kept = set(), set(), []
    for s, i, j in sorted(near):
        if i not in rows and j not in cols:
            rows.add(i), cols.add(j), kept.append((i, j, -s))
    kept.sort()
    ends: list[int] = []
    chain: list[int] = []
    back: dict[int, int] = {}
    for k, (_, j, _s) in enumerate(kept):
        at = bisect_left(ends, j)
        ends[at : at + 1] = [j]
        chain[at : at + 1] = [k]
        back[k] = chain[at - 1] if at else -1
    run, k = [], chain[-1] if chain else -1
    while k >= 0:
        run.append(kept[k][2])
        k = back[k]
    smaller = min(len(left), len(right))
    if len(run) < min(2, smaller) or not run:
        return None
    return min(1.0, max(0.0, len(run) / smaller * (sum(run) / len(run))))


def pair_scores(vectors: DataFrame, threshold: float = 0.9, max_files: int | None = MAX_FILES) -> DataFrame:
    """``a, b, similarity`` of shortlisted file pairs (a < b).

    ``max_files`` keeps the first files by id, as a bound on interactive reviews;
    None compares all. Needs valid vectors of one dimension; one row per id.
    """
    reps = representatives(vectors)
    if max_files is not None:
        files = reps.select("file_id").distinct().orderBy("file_id").limit(max_files)
        reps = reps.join(files, "file_id", "left_semi")
    whole = reps.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("pos", "embedding"))).alias("l"))
    whole = stage(whole.select("file_id", F.size("l").alias("n"), F.flatten(F.transform("l", lambda r: F.transform(r["embedding"], lambda x: x.cast("double")))).alias("flat")))
    width = (F.size("flat") / F.col("n")).cast("int")
    rows = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda p: F.slice("flat", p * width + 1, width))
    cents = stage(whole.select("file_id", _mean(rows, F.col("n")).alias("centroid")))
    blocks = max(1, math.ceil(cents.count() / BLOCK))
    pairs = stage(shortlist(cents, blocks=blocks).select(F.least("file_id", "other").alias("a"), F.greatest("file_id", "other").alias("b")).distinct())
    stored = whole.inputFiles()

    def score(batches):
        mine = [b for b in batches if b.num_rows]
        if not mine:
            return
        a, b = (pa.concat_arrays([x.column(k) for x in mine]) for k in (0, 1))
        need, chunks = pa.compute.unique(pa.concat_arrays([a, b])), {}
        for t in batches_of(stored, ["file_id", "n", "flat"], SLICE):
            t = t.filter(pa.compute.is_in(t.column(0), value_set=need))
            for f, n, v in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), t.column(2)):
                chunks[f] = v.values.to_numpy(zero_copy_only=False).reshape(n, -1).copy()
        s = [ordered_overlap(chunks[x], chunks[y], threshold) for x, y in zip(a.to_pylist(), b.to_pylist())]
        yield pa.RecordBatch.from_arrays([a, b, pa.array(s, pa.float64())], ["a", "b", "similarity"])

    spread = pairs.repartition(max(1, math.ceil(pairs.count() / PAIRS)), "a")
    return spread.mapInArrow(score, "a string, b string, similarity double").where("similarity is not null and not isnan(similarity)")


def semantic_groups(vectors: DataFrame, threshold: float = 0.9, max_files: int | None = MAX_FILES) -> DataFrame:
    """``component, file_id, best_similarity`` of groups linked by pairs of at least ``threshold``."""
    pairs = stage(pair_scores(vectors, threshold, max_files).where(F.col("similarity") >= threshold))
    comp = connected_components(pairs)
    best = pairs.join(comp.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.greatest(F.max("similarity"), F.lit(threshold)).alias("best_similarity"))
    return comp.join(best, "component").select("component", F.col("node").alias("file_id"), "best_similarity")


def uncertain_pairs(vectors: DataFrame, threshold: float = 0.9, max_files: int | None = MAX_FILES) -> DataFrame:
    """``a, b, similarity`` just below the threshold, most similar first."""
    return pair_scores(vectors, threshold, max_files).where((F.col("similarity") < threshold) & (F.col("similarity") >= threshold - MARGIN)).orderBy(F.desc("similarity"), "a", "b")


def ordered_semantic_groups(groups: DataFrame, files: DataFrame) -> DataFrame:
    """Members of ``semantic_groups``, best groups first; within one by modification (missing instants last), then id."""
    known = files.select(F.col("id").alias("file_id"), millis("modified_time").alias("_m"))
    return groups.join(known, "file_id", "left").orderBy(F.desc("best_similarity"), "component", F.col("_m").asc_nulls_last(), "file_id").drop("_m")


def mean_embedding(vectors: DataFrame, key: str = "file_id") -> DataFrame:
    """``key, embedding``: normalised mean of valid vectors per key."""
    mean = vectors.where(V.is_finite(F.col("embedding"))).select(key, F.posexplode("embedding").alias("d", "x")).groupBy(key, "d").agg(F.avg("x").alias("x"))
    vec = mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("v"))
    return vec.select(key, V.normalize(F.col("v")).alias("embedding"))


def suggest_folders(document: list[float], labels: DataFrame, embeddings: DataFrame, limit: int = 3) -> DataFrame:
    """``folder_id, label, score``: folders whose vectors are closest to a document's (same length only)."""
    q = F.array(*[F.lit(float(x)) for x in document])
    near = embeddings.where(F.size("embedding") == len(document)).select("folder_id", V.cosine(F.col("embedding"), q).alias("score"))
    return near.join(labels, "folder_id").orderBy(F.desc("score"), "label", "folder_id").limit(limit).select("folder_id", "label", "score")


def folder_labels(folders: DataFrame, levels: int = 20) -> DataFrame:
    """``folder_id, label``: up to ``levels`` trimmed names from the top, joined by `` / ``, blanks dropped.

    Ancestor lists double in every join (1, 2, 4 ... parents up), so twenty levels
    take five joins on the parent. A loop repeats itself, and what repeats is dropped, so
    folders on a loop get each of its names once. Labels without any name fall back
    to the folder's own.
    """
    from corvane.operators.hierarchy import links

    state = stage(links(folders).select("id", F.array(F.struct("id", F.coalesce("name", F.lit("")).alias("name"))).alias("up"), F.col("parent").alias("next"), "name"))
    reach = 1
    while reach < levels:
        above = state.select(F.col("id").alias("next"), F.col("up").alias("more"), F.col("next").alias("far"))
        state = stage(state.join(above, "next", "left").select("id", F.concat("up", F.coalesce("more", F.array().cast("array<struct<id:string,name:string>>"))).alias("up"), F.col("far").alias("next"), "name"))
        reach *= 2
    names = F.filter(F.transform(F.reverse(F.slice(F.array_distinct("up"), 1, levels)), lambda s: F.trim(s["name"])), lambda x: x != "")
    label = F.array_join(names, " / ")
    return state.select(F.col("id").alias("folder_id"), F.when(label == "", F.coalesce("name", F.lit(""))).otherwise(label).alias("label"))


def folder_prompts(labels: DataFrame, prefix: str = "Existing category folder names: ") -> DataFrame:
    """``folder_id, text``: what an embedding model is given for a folder."""
    return labels.select("folder_id", F.concat(F.lit(prefix), "label").alias("text"))
