import hashlib

import pytest
from pyspark.sql import functions as F

from corvane import session
from corvane.functions import crypto
from corvane.operators import search, store, upkeep, validation
from corvane.sources import listing


def test_snapshots_do_not_mix(spark, tmp_path):
    f = lambda i, drive=True: spark.createDataFrame([(i, drive), ("local" + i, False)], "id string, is_drive_item boolean")
    d = spark.createDataFrame([("x",)], "id string")
    root = str(tmp_path)
    store.save_snapshot(f("a"), d, root, "user", None, "2024-01-01")
    store.save_snapshot(f("b"), d, root, "drive", "9", "2024-02-01")
    store.save_snapshot(f("c"), d, root, "user", None, "2024-01-02")
    ids = lambda s: {r.id for r in s[0].collect()}
    assert ids(store.load_snapshot(spark, root, "user")) == {"c"} and ids(store.load_snapshot(spark, root)) == {"b"}
    assert ids(store.load_snapshot(spark, root, "drive", "9")) == {"b"} and store.load_snapshot(spark, root, "allDrives") is None


def test_lookups(spark):
    t = spark.createDataFrame([("a", None), ("b", "user"), ("c", "drive:1")], "id string, corpus_key string")
    assert store.by_corpus(t, "user").count() == 2 and store.by_corpus(t, "drive:1").count() == 1 and store.by_corpus(t).count() == 3 and store.by_id(t, "a").count() == 1
    ix = spark.createDataFrame([("a", "k1"), ("a", "k2"), ("b", "k2")], "id string, bucket string")
    assert {r.id for r in store.by_buckets(t, ix, ["k1", "k2"]).collect()} == {"a", "b"} and store.by_buckets(t, ix, []).count() == 0


def test_cache_put_and_touch(spark):
    c = spark.createDataFrame([("a", 1, 50), ("b", 2, 50)], "id string, cached_at int, size int")
    e = spark.createDataFrame([("n", 3, 40)], c.schema)
    assert {r.id for r in store.put_cached(c, e, 40, "n", 100, 80).collect()} == {"b", "n"}
    t = store.touch(c, "a", F.lit(9))
    assert {r.id for r in store.put_cached(t, e, 40, "n", 100, 80).collect()} == {"a", "n"}


def test_upsert_keeps_unchanged_vectors(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    chunks = spark.createDataFrame([("f", 0, "x"), ("f", 1, "new")], "file_id string, idx int, text string")
    v = spark.createDataFrame([("f", 0, "x", sha("x"), [1.0, 0.0], "m", "1", 2), ("f", 1, "old", sha("old"), [0.0, 1.0], "m", "1", 2), ("f", 5, "q", sha("q"), [0.0, 1.0], "m", "1", 2), ("g", 0, "z", sha("z"), [0.0, 1.0], "m", "1", 2)], "file_id string, idx int, text string, content_hash string, embedding array<double>, embedding_model string, embedding_version string, dimension int")
    act = upkeep.vector_actions(chunks, v, "m", "1", 2)
    got = {(r.file_id, r.idx): r.embedding for r in store.embed_vectors(chunks, act, v, lambda ts: [[float(len(t)), 0.5] for t in ts], "m", "1", 2).collect()}
    assert got == {("f", 0): [1.0, 0.0], ("f", 1): [3.0, 0.5], ("g", 0): [0.0, 1.0]}
    with pytest.raises(Exception, match="unusable"):
        store.embed_texts(chunks, lambda ts: [[1.0]] * len(ts), "m", "1", 2).collect()


def test_restore_and_misc(spark):
    d = lambda *i: spark.createDataFrame([(x, n) for n, x in enumerate(i)], "id string, n int")
    v = lambda *i: spark.createDataFrame([(x, x[0]) for x in i], "id string, file_id string")
    out = store.merge_restore({"documents": d("a", "b"), "vectors": v("a1", "a2", "b1")}, {"documents": d("x", "a"), "vectors": v("a9")})
    assert {(r.id, r.n) for r in out["documents"].collect()} == {("a", 1), ("b", 1), ("x", 0)} and {r.id for r in out["vectors"].collect()} == {"b1", "a9"}
    w = spark.range(1).select(store.retry_wait(F.lit(3), F.lit(500), F.lit(None).cast("int"), F.lit(0.5)), store.retry_wait(F.lit(20), F.lit(500), F.lit(0), F.lit(1.0))).first()
    assert list(w) == [4000.0, 60000.0]
    assert store.export_events(d("a")).first()[0] == '{"id":"a","n":0}'
    assert store.sync_mode("all", True) == "incremental" and store.sync_mode("pdfs", True) == "full" and not store.may_prune("all", True)


def test_document_sets_are_replaced_and_deleted_whole(spark):
    docs = search.current_documents(spark.createDataFrame([("a", 1, "old words here", "t", "user"), ("b", 2, "kept text stays", "t", None)], "id string, doc_id bigint, text string, indexed_at string, corpus_key string"))
    chunks = search.chunk_rows(docs)
    vectors = spark.createDataFrame([("a", "user"), ("b", None), ("gone", "user")], "file_id string, corpus_key string")
    state = {"documents": docs, "chunks": chunks, "postings": search.postings(chunks), "vectors": vectors}
    new = docs.where("id = 'a'").withColumn("text", F.lit("fresh content"))
    after = upkeep.put_documents(state, new)
    assert {r.text for r in after["documents"].collect()} == {"fresh content", "kept text stays"} and {r.term for r in after["postings"].where("file_id = 'a'").collect()} == {"fresh", "content"}
    assert {r.file_id for r in after["vectors"].collect()} == {"b", "gone"} and upkeep.put_documents(state, new, True)["vectors"].count() == 3
    left = upkeep.delete_documents(after, spark.createDataFrame([("b",)], "id string"))
    assert [left[k].count() for k in ("documents", "chunks", "postings", "vectors")] == [1, 1, 2, 1]
    live = docs.select("id")
    assert {r.file_id for r in upkeep.prune_vectors(vectors, live, True).collect()} == {"a", "b"} and upkeep.prune_vectors(vectors, live, False).count() == 3
    assert upkeep.prune_vectors(vectors, live, True, "other").count() == 3


def test_backups_are_validated_before_they_are_sealed(spark):
    docs = spark.createDataFrame([("a", "text", "n", "export", 4, "user")], "id string, text string, name string, source string, char_count int, corpus_key string")
    vectors = spark.createDataFrame([("user::a#0", "a", 0, "text", [1.0, 0.0], 2, "user")], "id string, file_id string, idx int, text string, embedding array<double>, dimension int, corpus_key string")
    blob = store.seal_backup(docs, vectors, "a long enough passphrase", "2024-01-01T00:00:00Z")
    assert crypto.read_backup(spark, blob, "a long enough passphrase")["documents"][0]["id"] == "a"
    with pytest.raises(ValueError, match="char_count"):
        store.seal_backup(docs.withColumn("char_count", F.lit(5)), vectors, "a long enough passphrase", "x")
    with pytest.raises(ValueError, match="too large"):
        store.seal_backup(docs, vectors, "a long enough passphrase", "x", max_bytes=10)


def test_gates_and_flags(spark):
    vectors = spark.createDataFrame([("a", "title: n | text: x"), ("z", "title: n | text: y"), ("b", "plain")], "file_id string, text string")
    live = spark.createDataFrame([("a",), ("b",)], "id string")
    with pytest.raises(RuntimeError, match="^1 live"):
        validation.scan_gate(vectors, live)
    assert validation.scan_gate(vectors, live.where("id = 'b'")) == 0
    r = spark.range(1).select(validation.can_suggest(F.lit(True), F.lit(True), F.lit(None).cast("boolean")).alias("a"), validation.consent_granted(F.lit("granted"), F.lit("p1"), "p2").alias("b"), validation.consent_granted(F.lit("granted"), F.lit("p2"), "p2").alias("c")).first()
    assert (r.a, r.b, r.c) == (True, False, True)


def test_change_pages(spark):
    pages = {"1": (spark.range(2), "2", None), "2": (spark.range(2, 5), None, "9")}
    rows, offset = listing.drain_pages(pages.__getitem__, "1")
    assert rows.count() == 5 and offset == "9"
    with pytest.raises(RuntimeError, match="within 1 pages"):
        listing.drain_pages(pages.__getitem__, "1", max_pages=1)
    with pytest.raises(RuntimeError, match="without"):
        listing.drain_pages({"1": (spark.range(1), None, None)}.__getitem__, "1")


def test_sorted_rank_equals_a_window(spark):
    df = spark.createDataFrame([(i % 3 if i % 2 else 0, (i * 37) % 101) for i in range(101)], "k int, v int")
    got = {(r.k, r.v): r.n for r in session.sorted_rank(df, ["k"], [F.col("v")], "n").collect()}
    want = {(k, v): n for k in range(3) for n, v in enumerate(sorted(v for a, v in got if a == k))}
    assert got == want and len(got) == 101
