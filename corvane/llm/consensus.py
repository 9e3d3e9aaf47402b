"""Best representative of each duplicate group (problem 4).

The kept file has the highest keep score. Its descriptive texts (``name``,
``semantic_summary``) are chosen field by field by token-level consensus: the
distinct values of a group are aligned progressively, tokens and gaps vote per
column with the weight of their files, and the existing value closest to the
heaviest entries of the columns is emitted. Other fields keep the kept file's
value; gaps are filled from the best-scored peer that has one.

Progressive alignment works on profiles, and merging two profiles is again an
alignment, so a group is folded as a tree: about ``FAN_IN`` values or profiles
meet in one task, whatever the size of the group. The folded profile only says
which columns there are; every value is then aligned to it once more and the
votes are counted exactly, by an aggregation over (group, column, token).
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.changefeed import current_rows
from corvane.operators.duplicates import keep_order, scored_files
from corvane.session import hot_join, stage

FAN_IN = 32
GUIDE = 16  #: heaviest tokens by which a profile column is recognised in later alignments (votes are counted on all)
SUBSTITUTE, GAP = 0.4, 0.3  #: costs of two different tokens in one column and of a token facing a gap; an agreement earns 1
CELLS = 4_000_000  #: table size from which an alignment is halved first; the best score is the same either way
HOT = 20_000  #: values from which a group is joined apart
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]")
Column = dict  # token -> weight


def tokens_of(value: str) -> list[str]:
    """Words and single marks."""
    return _TOKEN.findall(value)


class _Scores:
    """Expected gain of putting a column of one profile over a column of another, row by row."""

    def __init__(self, p: list[Column], wp: float, q: list[Column], wq: float):
        self.p, self.wp, self.wq = p, wp, wq
        self.fp = np.array([sum(c.values()) / wp for c in p])
        self.fq = np.array([sum(c.values()) / wq for c in q])
        self.where: dict[str, list[tuple[int, float]]] = {}
        for j, c in enumerate(q):
            for t, w in c.items():
                self.where.setdefault(t, []).append((j, w))

    def row(self, i: int) -> np.ndarray:
        f = self.fp[i]
        out = -SUBSTITUTE * f * self.fq - GAP * (f * (1 - self.fq) + self.fq * (1 - f))
        for t, w in self.p[i].items():
            for j, v in self.where.get(t, ()):
                out[j] += (1 + SUBSTITUTE) * w * v / (self.wp * self.wq)
        return out


def _sweep(s: _Scores, rows, lo: int, hi: int, back: bool, steps: np.ndarray | None = None) -> np.ndarray:
    """Best scores of the given rows against every start of q[lo:hi] (every end, if ``back``)."""
    fq = s.fq[lo:hi][::-1] if back else s.fq[lo:hi]
    left = np.concatenate(([0.0], np.cumsum(GAP * fq)))
    line = -left
    for k, i in enumerate(rows):
        v = s.row(i)[lo:hi]
        diagonal, up = line[:-1] + (v[::-1] if back else v), line - GAP * s.fp[i]
        best = up.copy()
        best[1:] = np.maximum(up[1:], diagonal)
        new = np.maximum.accumulate(best + left) - left
        if steps is not None:
            took = best >= new - 1e-12
            steps[k, 0] = 1
            steps[k, 1:] = np.where(took[1:], np.where(diagonal >= up[1:], 0, 1), 2)
        line = new
    return line


def _matches(s: _Scores, a: int, b: int, lo: int, hi: int, out: list) -> None:
    """Pairs (row, column) of the best global alignment of p[a:b] and q[lo:hi]."""
    n, m = b - a, hi - lo
    if not n or not m:
        return
    if n > 1 and n * m > CELLS:
        mid = (a + b) // 2
        cut = lo + int((_sweep(s, range(a, mid), lo, hi, False) + _sweep(s, range(b - 1, mid - 1, -1), lo, hi, True)[::-1]).argmax())
        _matches(s, a, mid, lo, cut, out)
        _matches(s, mid, b, cut, hi, out)
        return
    steps = np.zeros((n, m + 1), np.int8)
    _sweep(s, range(a, b), lo, hi, False, steps)
    i, j, found = n, m, []
    while i and j:
        step = steps[i - 1, j]
        if step == 0:
            found.append((a + i - 1, lo + j - 1))
        i, j = i - (step != 2), j - (step != 1)
    out += found[::-1]


def matches(p: list[Column], wp: float, q: list[Column], wq: float) -> list[tuple[int, int]]:
    """Columns of two profiles that belong together (global alignment of least expected disagreement)."""
    head, short = 0, min(len(p), len(q))
    while head < short and len(p[head]) == 1 and p[head].keys() == q[head].keys():
        head += 1
    out = [(i, i) for i in range(head)]
    _matches(_Scores(p, wp, q, wq), head, len(p), head, len(q), out)
    return out


def _merge(a: Column, b: Column) -> Column:
    out = dict(a)
    for t, w in b.items():
        out[t] = out.get(t, 0.0) + w
    return out if len(out) <= GUIDE else dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:GUIDE])


def align(p: list[Column], wp: float, q: list[Column], wq: float) -> list[Column]:
    """Merge two profiles along their best alignment; different tokens may share a column."""
    out, i, j = [], 0, 0
    for a, b in [*matches(p, wp, q, wq), (len(p), len(q))]:
        out += p[i:a] + q[j:b]
        if a < len(p) and b < len(q):
            out.append(_merge(p[a], q[b]))
        i, j = a + 1, b + 1
    return out


def fold(profiles: list[tuple[list[Column], float]]) -> tuple[list[Column], float]:
    """Progressive alignment, heaviest first.

    Columns under 1/64 of the weight are left out: a column needs half of the whole
    weight to win against its gap, so it stays in some part of the tree at least.
    """
    profiles = sorted(profiles, key=lambda x: -x[1])
    out, total = profiles[0]
    for prof, w in profiles[1:]:
        out, total = align(out, total, prof, w), total + w
    return [c for c in out if sum(c.values()) * 64 >= total], total


def placed(tokens: list[str], weight: float, profile: list[Column], total: float) -> list[str | None]:
    """Per column of the profile the value's token, None for a gap."""
    out: list[str | None] = [None] * len(profile)
    for i, j in matches(profile, total, [{t: weight} for t in tokens], weight):
        out[i] = tokens[j]
    return out


def token_distance(a: list[str], b: list[str]) -> float:
    """Edit distance on tokens divided by the longer length."""
    size = max(len(a), len(b))
    if not size:
        return 0.0
    names = {t: i for i, t in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([names[t] for t in a], np.int64), np.array([names[t] for t in b], np.int64)
    step = np.arange(len(y) + 1)
    line = step.copy()
    for i, t in enumerate(x, 1):
        best = line + 1
        best[1:] = np.minimum(best[1:], line[:-1] + (y != t))
        best[0] = i
        line = np.minimum.accumulate(best - step) + step
    return float(line[-1]) / size


def consensus_values(votes: DataFrame) -> DataFrame:
    """``dup_key, field, value``: per (dup_key, field) the existing value closest to the consensus.

    ``votes`` has ``dup_key, field, value, weight``; null values have no vote. In a column
    the heaviest entry wins, a gap included; equal entries go to the one of the heavier
    value, then the smaller value. Equally close values likewise.
    """
    key = ["dup_key", "field"]
    distinct = stage(votes.where("value is not null").groupBy(*key, "value").agg(F.sum("weight").alias("weight")))
    counts = stage(distinct.groupBy(*key).agg(F.count("*").alias("n"), F.sum("weight").alias("whole")))
    # A field with one distinct value needs no vote.
    many = counts.where("n > 1")
    most = many.agg(F.max("n")).first()[0] or 0
    voters = stage(hot_join(distinct, many, key, "n", HOT))
    parts = F.ceil(F.col("n") / F.lit(FAN_IN / 2)).cast("bigint")
    level = voters.select(*key, F.pmod(F.xxhash64("value"), parts).alias("part"), "value", "weight", F.lit(None).cast("string").alias("profile"))

    def combine(batches):
        for b in batches:
            prof, weight = [], []
            for group in b.column(3).to_pylist():
                folded, total = fold([([{t: x["weight"]} for t in tokens_of(x["value"])], x["weight"]) if x["profile"] is None else (json.loads(x["profile"]), x["weight"]) for x in group])
                prof.append(json.dumps(folded)), weight.append(total)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.nulls(len(prof), pa.string()), pa.array(weight, pa.float64()), pa.array(prof, pa.string())], ["dup_key", "field", "part", "value", "weight", "profile"])

    def folded(level: DataFrame) -> DataFrame:
        # About FAN_IN items meet in a part: the number of parts follows the number of values.
        met = level.groupBy(*key, "part").agg(F.sort_array(F.collect_list(F.struct("value", "weight", "profile"))).alias("items"))
        return met.mapInArrow(combine, "dup_key string, field string, part bigint, value string, weight double, profile string")

    left = -(-most * 2 // FAN_IN)
    level = folded(level)
    while left > 1:
        left = -(-left // FAN_IN)
        level = folded(level.withColumn("part", F.floor(F.col("part") / FAN_IN)))
    top = stage(level.join(many.select(*key, "n"), key).select(*key, "profile", "n"))

    def place(batches):
        known: tuple[str, list[Column]] = ("", [])
        for b in batches:
            rows = []
            for k, f, v, w, whole, text in zip(*(b.column(i).to_pylist() for i in range(6))):
                if text != known[0]:
                    known = (text, json.loads(text))
                rows += [(k, f, i, t, w, v) for i, t in enumerate(placed(tokens_of(v), w, known[1], whole))]
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.string()))], ["dup_key", "field", "col", "token", "weight", "value"])

    put = hot_join(voters.drop("n"), top, key, "n", HOT).select(*key, "value", "weight", "whole", "profile").mapInArrow(place, "dup_key string, field string, col int, token string, weight double, value string")
    tally = put.groupBy(*key, "col", "token").agg(F.round(F.sum("weight"), 6).alias("w"), F.min(F.struct((-F.col("weight")).alias("w"), "value")).alias("lead"))
    won = tally.groupBy(*key, "col").agg(F.min(F.struct((-F.col("w")).alias("w"), "lead", "token"))["token"].alias("token"))
    said = won.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("col", "token")))), lambda s: s["token"]).alias("said"))
    said = stage(many.select(*key, "n").join(said, key, "left").withColumn("said", F.coalesce("said", F.array().cast("array<string>"))))

    def distances(batches):
        for pdf in batches:
            dist = [token_distance(tokens_of(v), list(s)) for v, s in zip(pdf["value"], pdf["said"])]
            yield pd.DataFrame({"dup_key": pdf["dup_key"], "field": pdf["field"], "value": pdf["value"], "weight": pdf["weight"], "dist": pd.Series(dist, dtype=float)})

    judged = hot_join(voters.drop("n"), said, key, "n", HOT).select(*key, "value", "weight", "said").mapInPandas(distances, "dup_key string, field string, value string, weight double, dist double")
    chosen = judged.groupBy(*key).agg(F.min_by("value", F.struct("dist", -F.col("weight"), "value")).alias("value"))
    single = distinct.join(counts.where("n = 1").select(*key), key).select(*key, "value")
    return chosen.unionByName(single)


def best_representatives(files: DataFrame) -> DataFrame:
    """One row per group of exact duplicates: the kept file with fields filled and voted.

    Takes all listed rows (the newest per id counts). Result: ``dup_key, group_size,
    keep_id, keep_score, name, semantic_summary, mime_type, size, modified_time,
    created_time, folder_id, category, starred, tags``. ``modified_time`` is the latest
    instant of the group, ``tags`` the union, ``starred`` true if any is. Groups have
    two or more files; files with null id, and files with neither hash nor size, form
    none. Extra columns are ignored.
    """
    cols = ["id", "name", "mime_type", "size", "modified_time", "created_time", "category", "folder_id", "is_offline", "content_hash", "content_hash_modified_time", "tags", "semantic_summary", "starred", "listed_at"]
    scored = stage(scored_files(current_rows(files.select(*cols))))
    from corvane.functions.catalog import millis

    fill = lambda c: F.coalesce(F.min_by(c, keep_order()), F.min_by(c, F.when(F.col(c).isNotNull(), keep_order()))).alias(c)
    groups = scored.groupBy("dup_key").agg(
        F.max("group_size").alias("group_size"), F.min_by("id", keep_order()).alias("keep_id"), F.max("score").alias("keep_score"),
        *[fill(c) for c in ("mime_type", "size", "created_time", "folder_id", "category")],
        F.max_by("modified_time", millis("modified_time")).alias("modified_time"), F.max(F.coalesce("starred", F.lit(False))).alias("starred"),
    )
    tags = scored.select("dup_key", F.explode("tags").alias("t")).distinct().groupBy("dup_key").agg(F.array_sort(F.collect_list("t")).alias("tags"))
    weight = F.greatest(F.lit(1.0), F.col("score") + 26.0)
    votes = scored.select("dup_key", weight.alias("weight"), F.explode(F.array(
        F.struct(F.lit("name").alias("field"), F.col("name").alias("value")),
        F.struct(F.lit("semantic_summary").alias("field"), F.col("semantic_summary").alias("value")))).alias("s")).select("dup_key", "s.field", "s.value", "weight")
    voted = consensus_values(votes).groupBy("dup_key").agg(
        F.max(F.when(F.col("field") == "name", F.col("value"))).alias("name"), F.max(F.when(F.col("field") == "semantic_summary", F.col("value"))).alias("semantic_summary"))
    return stage(groups.join(voted, "dup_key", "left").join(tags, "dup_key", "left").select(
        "dup_key", "group_size", "keep_id", "keep_score", "name", "semantic_summary", "mime_type", "size", "modified_time", "created_time", "folder_id", "category", "starred", "tags"))
