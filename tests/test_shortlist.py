"""The shortlist over all files against brute force."""

import numpy as np

from corvane.operators import semantic
from corvane.plans import reference_queries as R


def test_shortlist_of_all_files_equals_brute_force(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(semantic.MAX_FILES + 30, 8))
    ids = [f"f{i:04d}" for i in range(len(x))]
    vectors = spark.createDataFrame([(f, f, 0, v.tolist()) for f, v in zip(ids, x)], "id string, file_id string, idx int, embedding array<double>")
    monkeypatch.setattr(R, "_latest_vectors", lambda spark, d: vectors)
    monkeypatch.setattr(semantic, "BLOCK", 200)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    s = unit @ unit.T
    np.fill_diagonal(s, -np.inf)
    want = {(ids[i], ids[j]) for i in range(len(x)) for j in np.argsort(-s[i])[: semantic.SHORTLIST]}
    got = [(r.file_id, r.other) for r in R.QUERIES["centroid_shortlist"](spark, "").collect()]
    assert len(got) == len(want) and set(got) == want


def test_shortlist_writes_no_profile_twice_per_block(spark):
    """Before, a profile was shuffled once for every block; equal profiles tie by id, also across slices."""
    x = np.repeat(np.random.default_rng(5).normal(size=(40, 4)), 15, axis=0)
    ids = [f"f{i:03d}" for i in np.random.default_rng(6).permutation(len(x))]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    got = semantic.shortlist(spark.createDataFrame(list(zip(ids, unit.tolist())), "file_id string, centroid array<double>"), blocks=6)
    assert "asker" not in got._jdf.queryExecution().toString()
    near = {}
    for r in got.collect():
        near.setdefault(r.file_id, set()).add(r.other)
    want = {f: set(sorted((g for g, u in zip(ids, unit) if u is not None and (u == v).all() and g != f))[: semantic.SHORTLIST]) for f, v in zip(ids, unit)}
    assert near == want


def test_pairs_are_scored_without_shipping_chunks(spark):
    """Before, both chunk lists went through a shuffle with every pair."""
    x = np.random.default_rng(8).normal(size=(12, 3, 4))
    x[6:] = x[:6] + 1e-3
    rows = [(f"f{i}#{k}", f"f{i:02d}", k, v.tolist()) for i, file in enumerate(x) for k, v in enumerate(file)]
    got = semantic.pair_scores(spark.createDataFrame(rows, "id string, file_id string, idx int, embedding array<double>"), 0.9, None)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    high = {(r.a, r.b) for r in got.where("similarity > 0.99").collect()}
    assert {(f"f{i:02d}", f"f{i + 6:02d}") for i in range(6)} <= high
