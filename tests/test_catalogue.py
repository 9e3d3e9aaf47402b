"""Duplicates, semantic review, components, folders, upkeep and validation."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from corvane.operators import components, duplicates, semantic, upkeep, validation

FILE = "id string, name string, mime_type string, size bigint, modified_time string, created_time string, category string, folder_id string, is_offline boolean, content_hash string, content_hash_modified_time string, tags array<string>, semantic_summary string, starred boolean, is_drive_item boolean"


def file(i, name="n", size=10, h=None, rev="r", hrev=None, drive=True):
    return (i, name, None, size, rev, None, None, None, False, h, hrev, None, None, None, drive)


def test_duplicate_keys(spark):
    rows = [file("a"), file("b", "N"), file("c", "z", h="sha256:1", hrev="r"), file("d", "y", h="sha256:1", hrev="r"), file("e", "w", h="sha256:1", hrev="old"), file("f", "v", size=0), file("g", "v", size=0), file("h", "v", h="gdrive-1", size=None)]
    got = {r.keep_id: r.verification for r in duplicates.duplicate_groups(spark.createDataFrame(rows, FILE)).collect()}
    assert got == {"a": "candidate", "d": "sha256"}  # equal scores: the smaller name


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (5, 5), (None, 3), (200, 201), (201, 202), (202, 200)] + [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(120)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {x: find(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "a int, b int")).collect() == []


def test_ordered_overlap():
    e = np.eye(4)
    assert semantic.ordered_overlap(e[:3], e[:3], 0.9) == 1.0
    assert semantic.ordered_overlap(e[:3], e[[0, 3, 3]], 0.9) is None  # one shared chunk only
    assert semantic.ordered_overlap(e[:1], np.array([[0.92, math.sqrt(1 - 0.92**2), 0, 0]]), 0.95) == 0.92
    assert abs(semantic.ordered_overlap(e[:3], e[[2, 1, 0]], 0.9) or 0) == 0  # reversed order


VEC = "id string, file_id string, idx int, embedding array<double>"


def test_semantic_groups_and_sampling(spark):
    rnd = np.random.default_rng(1)
    base = rnd.normal(size=(30, 8))
    rows = [(f"{f}#{i}", f, i, (base[i] + (0 if f == "a" else 0.01) * rnd.normal(size=8)).tolist()) for f in ("a", "b") for i in range(30)] + [(f"c#{i}", "c", i, rnd.normal(size=8).tolist()) for i in range(3)]
    v = spark.createDataFrame(rows, VEC)
    reps = semantic.representatives(v).where("file_id = 'a'").orderBy("pos").collect()
    assert [r.idx for r in reps] == [math.floor(i * 29 / 11 + 0.5) for i in range(12)]
    got = {r.file_id: r.component for r in semantic.semantic_groups(v, 0.9).collect()}
    assert got == {"a": "a", "b": "a"}
    assert semantic.semantic_groups(v.where("false"), 0.9).collect() == []
    assert semantic.shortlist(semantic.centroids(semantic.representatives(v)), blocks=3).count() == 6


def test_folder_labels(spark):
    rows = [("r", " Root ", None), ("a", "A", ["r"]), ("b", " ", ["a"]), ("x", "X", ["y"]), ("y", "Y", ["x"])] + [(f"d{i}", f"n{i}", [f"d{i - 1}"] if i else None) for i in range(30)]
    got = {r.folder_id: r.label for r in semantic.folder_labels(spark.createDataFrame(rows, "id string, name string, parent_ids array<string>")).collect()}
    assert got["a"] == "Root / A" and got["b"] == "Root / A" and got["x"] == "Y / X" and got["y"] == "X / Y"
    assert got["d29"] == " / ".join(f"n{i}" for i in range(10, 30))


def test_staleness_and_pruning(spark):
    f = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", None), ("e", "1")], "id string, modified_time string")
    d = spark.createDataFrame([("a", "1", "p", None), ("b", "2", "p", "user"), ("c", None, "p", "drive:x"), ("d", "1", "q", "user")], "id string, drive_modified_time string, extraction_policy_version string, corpus_key string")
    assert {r.id: r.reason for r in upkeep.stale_documents(f, d, "p").collect()} == {"a": None, "b": "revision", "c": "unknown-revision", "d": "policy", "e": "missing"}
    live = spark.createDataFrame([("b",)], "id string")
    assert {r.id for r in upkeep.prune_missing(d, live, True, "user").collect()} == {"b", "c"}
    assert upkeep.prune_missing(d, live, False, "user").count() == 4 and upkeep.prune_missing(d, live, True).count() == 1
    new = spark.createDataFrame([("b", "9", "p", "user")], d.schema)
    assert {(r.id, r.drive_modified_time) for r in upkeep.replace_rows(d, new, "id").collect()} == {("a", "1"), ("b", "9"), ("c", None), ("d", "1")}


def test_vector_actions_keep_unchanged_rows(spark):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    c = spark.createDataFrame([("f", 0, "x"), ("f", 1, "y"), ("f", 2, " "), ("g", 0, "z")], "file_id string, idx int, text string")
    v = spark.createDataFrame([("f", 0, sha("x"), "m", "1", 2, [1.0, 0.0]), ("f", 1, sha("old"), "m", "1", 2, [1.0, 0.0]), ("f", 7, sha("x"), "m", "1", 2, [1.0, 0.0]), ("g", 0, sha("z"), "m", "1", 2, [1.0]), ("h", 0, sha("z"), "m", "1", 2, [1.0, 0.0])], "file_id string, idx int, content_hash string, embedding_model string, embedding_version string, dimension int, embedding array<double>")
    got = {(r.file_id, r.idx): r.action for r in upkeep.vector_actions(c, v, "m", "1", 2).collect()}
    assert got == {("f", 0): "keep", ("f", 1): "embed", ("f", 7): "delete", ("g", 0): "embed"}
    assert {r.file_id: r.complete for r in upkeep.vector_sets(c, v, "m", "1", 2).collect()} == {"f": False, "g": False}


def test_lru_equals_a_loop(spark):
    rnd = random.Random(2)
    for n, most in ((30, 10), (5, 80)):
        rows = [(f"e{i:02d}", rnd.randrange(50), rnd.randrange(1, 40)) for i in range(n)]
        left = sorted(rows, key=lambda r: (r[1], [-ord(c) for c in r[0]]))
        gone = set()
        while left and (sum(r[2] for r in left) + 25 > 200 or len(left) + 1 > most):
            gone.add(left.pop(0)[0])
        d = spark.createDataFrame(rows, "id string, cached_at int, size int")
        assert {r.id for r in upkeep.lru_evictions(d, 25, None, 200, most).collect()} == gone
    assert upkeep.lru_evictions(d, 25, "e00", 1, 1).where("id = 'e00'").count() == 0


def test_cursor_ring_and_transitions(spark):
    cur = lambda *i: upkeep.contiguous_cursor(spark.createDataFrame([(x,) for x in i], "idx int")).first()[0]
    assert cur(0, 1, 2, 4) == 3 and cur(1, 2) == 0 and cur(0, 0, 1) == 2
    ev = spark.range(200).select(F.col("id").alias("event_id"), F.col("id").alias("ts"))
    assert upkeep.ring_buffer(ev).agg(F.min("ts"), F.count("*")).first()[:] == (80, 120)
    t = spark.createDataFrame([(10, 5, 5, 0, True, False), (10, 5, 10, 0, False, False), (10, 5, 3, 1, False, False), (10, 5, 5, 0, False, False), (10, 10, 8, 0, False, False)], "total int, batch_end int, contiguous_cursor int, failures int, cancelled boolean, aborted boolean")
    assert [tuple(r[0]) for r in t.select(upkeep.batch_transition()).collect()] == [("stopped", None), ("done", None), ("retry", 3), ("continue", 5), ("incomplete", 8)]


def test_cached_hashes(spark):
    f = spark.createDataFrame([file("a", h="sha256:x", hrev="r"), file("b", h="sha256:x", hrev="old"), file("c", h="gdrive-c"), file("d", h="sha256:y", hrev="r"), file("e")], FILE)
    m = spark.createDataFrame([("a", "new", "r"), ("b", "new", "other"), ("c", "new", "r"), ("d", "new", "other")], "id string, sha256 string, drive_modified_time string")
    got = {r.id: (r.content_hash, r.is_offline) for r in upkeep.apply_cache_meta(f, m).collect()}
    assert got == {"a": ("sha256:new", True), "b": ("gdrive-b-10", True), "c": ("sha256:new", True), "d": ("sha256:y", True), "e": (None, False)}
    h = spark.createDataFrame([("a", "1", "r"), ("b", "1", "moved")], "id string, sha256 string, modified_time string")
    assert {r.id: r.verified for r in upkeep.verify_hashes(f, h).collect()} == {"a": True, "b": False, "c": None, "d": None, "e": None}
    listed = f.where("id <> 'e'")
    known = spark.createDataFrame([file("l", drive=False), file("a"), file("z")], FILE)
    assert {r.id for r in upkeep.merge_listing(listed, known).collect()} == {"a", "b", "c", "d", "l"}


def test_rate_limit(spark):
    rows = [(1, 1000 * i, i) for i in range(32)] + [(1, 60_000, 90), (1, 61_000, 91), (2, 5, 99), (None, 5, 98), (2, None, 97)]
    got = {r.request_id: r for r in upkeep.rate_limit_decisions(spark.createDataFrame(rows, "user bigint, ts bigint, request_id bigint")).collect()}
    assert len(got) == 35 and all(got[i].allowed for i in range(30)) and not got[30].allowed and got[30].retry_after == 30 and got[30].log_event and not got[31].log_event
    assert got[90].allowed and got[91].allowed and got[99].allowed
    rnd = random.Random(3)
    rows, t = [], {1: 0, 2: 0}
    for i in range(800):
        u = rnd.choice([1, 1, 1, 2])
        t[u] += rnd.choice([0, 1, 500, 5_000, 40_000, 4_000_000])
        rows.append((u, t[u], i))
    want, state = {}, {}
    for u, ts, i in rows:
        n, reset = state.get(u, (0, -1))
        if reset < 0 or ts >= reset:
            n, reset = 0, ts + 60_000
        want[i] = n < 3
        state[u] = (n + 1 if n < 3 else n, reset)
    got = upkeep.rate_limit_decisions(spark.createDataFrame(rows, "user bigint, ts bigint, request_id bigint"), limit=3).collect()
    assert {r.request_id: r.allowed for r in got} == want


def test_predicates(spark):
    d = spark.createDataFrame([("image/png", "a.png", "image", True), ("text/plain", "b", "other", True), ("application/zip", "c.zip", "archive", None), (None, "d.DOCX", "other", False), (None, None, None, None)], "mime_type string, name string, category string, is_drive_item boolean")
    col = lambda c: [r[0] for r in d.select(c).collect()]
    assert col(validation.can_extract()) == [True, True, False, True, False]
    assert col(validation.matches_category("document")) == [False, True, False, True, False] and col(validation.matches_category("google_drive")) == [True, True, False, False, False]
    assert col(validation.extraction_route()) == ["image", "text", "none", "docx", "none"]
    assert col(validation.local_category(F.col("mime_type"), F.col("name"))) == ["image", "other", "archive", "document", "other"]
    e = spark.createDataFrame([(["a"], None, None), ([], None, None), (["a"] * 33, None, None), ([" "], None, None), (["x" * 8001], None, None), ([None], None, None), (["a"], "bad", None), (["a"], "query", "4")], "t array<string>, m string, v string")
    assert [r[0] for r in e.select(validation.embed_request_error(F.col("t"), F.col("m"), F.col("v"))).collect()] == [None, "texts required", "batch too large", "empty text not allowed", "text too long", "each text must be a string", "invalid mode", "unsupported contract version"]
    t = spark.createDataFrame([(None, 9e15), ("t", 0.0), ("t", 100_000.0), ("t", 60_002.0), ("t", None)], "t string, e double")
    assert [r[0] for r in t.select(validation.token_expired(F.col("t"), F.col("e"), F.lit(1))).collect()] == [True, True, False, False, True]
    r = spark.createDataFrame([(429, None), (403, '{"error":{"errors":[{"reason":"userRateLimitExceeded"}]}}'), (403, '{"error":{"errors":[{"reason":"x"}]}}'), (403, "no json"), (200, None)], "s int, b string")
    assert [x[0] for x in r.select(validation.is_rate_limited(F.col("s"), F.col("b"))).collect()] == [True, True, False, False, False]


def test_backup_rules(spark):
    d = spark.createDataFrame([("a", "x" * 3, "export", 3, None), ("a", "y", "other", 2, None)], "id string, text string, source string, char_count int, corpus_key string")
    v = spark.createDataFrame([("user::a#0", "a", 0, "t", [1.0], None, 1), ("user::q#0", "q", 0, "t", [1.0, math.nan], None, 1)], "id string, file_id string, idx int, text string, embedding array<double>, corpus_key string, dimension int")
    got = {r.rule: r.violations for r in validation.backup_violations(d, v).collect() if r.violations}
    assert got == {"document source unknown": 1, "document char_count wrong": 1, "document id repeated": 1, "vector length wrong": 1, "vector not finite": 1, "vector without document": 1}


def test_components_of_a_long_path_with_its_smallest_node_at_the_far_end(spark, monkeypatch):
    """2 - 3 - ... - 150 - 1: the smallest label must not walk back node by node. In one task, and in rounds of contraction."""
    path = [*range(2, 151), 1]
    edges = [*zip(path, path[1:]), (200, 900), (900, 200), *[(900, i) for i in range(201, 260)], (7, 7), (None, 1)]
    e = spark.createDataFrame(edges, "a int, b int")
    want = {i: 1 for i in path} | {i: 200 for i in [*range(200, 260), 900]}
    assert {r.node: r.component for r in components.connected_components(e).collect()} == want
    monkeypatch.setattr(components, "LOCAL", 100)
    monkeypatch.setattr(components, "HOT", 20)
    assert {r.node: r.component for r in components.connected_components(e).collect()} == want
