import math

from pyspark.sql import functions as F

from corvane.operators import search

DOC = "doc_id bigint, id string, text string, corpus_key string, indexed_at string"
FILE = "id string, name string, category string, semantic_summary string, tags array<string>, starred boolean, is_drive_item boolean"


def docs(spark, rows):
    return search.current_documents(spark.createDataFrame([(i, f, t, c, "2024-01-01T00:00:00Z") for i, (f, t, c) in enumerate(rows)], DOC))


def test_bm25_by_hand(spark):
    d = docs(spark, [("a", "apple apple pear", None), ("b", "apple", "user"), ("c", "plum", "user"), ("d", None, "user"), ("e", "apple", "drive:x"), (None, "apple", None)])
    idf = lambda n, df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    got = {r.file_id: r.score for r in search.bm25(d, "apple pear apple", "user").collect()}
    want = {"a": 2 * 2 * idf(4, 2) / 3.2 + idf(4, 1) / 2.2, "b": 2 * idf(4, 2) / 2.2}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert search.bm25(d, "? !").collect() == [] and search.bm25(d.where("false"), "apple").collect() == []
    assert [r.file_id for r in search.bm25(d, "apple").collect()][0] == "a"


def test_best_chunk_and_reindex(spark):
    text = "filler " * 200 + "needle needle " + "filler " * 200
    d = docs(spark, [("a", text, None)])
    hit = search.with_snippets(search.bm25(d, "needle"), d).first()
    assert hit.best_chunk_idx == 1 or "needle" in text[hit.best_chunk_idx * 680 :][:800]
    assert len(hit.snippet) <= 160
    old = docs(spark, [("a", "oldword", None), ("a", "newword", None)])
    assert search.bm25(old, "oldword").count() == 0 and search.bm25(old, "newword").count() == 1


def files(spark, rows):
    return spark.createDataFrame(rows, FILE)


def test_metadata_ranking(spark):
    f = files(spark, [("1", "annual plan.pdf", "document", "x", ["t"], False, True), ("2", "other.txt", "document", "the annual plan of last year", [], True, True),
                      ("3", "zzz", "image", None, None, True, None), ("4", None, None, "annual", ["annual"], None, False)])
    got = {r.file_id: (r.score, r.reason) for r in search.metadata_search(f, "annual plan").collect()}
    assert got["1"] == (100, "Exact filename match · Metadata terms 2/2") and got["2"] == (80, "Metadata phrase match · Metadata terms 2/2 · Starred")
    assert got["4"][0] == 15 and "3" not in got
    assert search.metadata_search(f, "  ").count() == 4 and search.metadata_search(f, "annual", "google_drive").count() == 2
    assert all(r.score < 50 for r in search.metadata_search(f, "the").collect())


def test_hybrid_numbers(spark):
    rows = [(0.0, 80.0, 20.0), (90.0, 10.0, 0.0), (0.0, 0.0, 80.0)]
    d = spark.createDataFrame(rows, "n double, b double, m double")
    assert [int(r[0]) for r in d.select(search.hybrid_scores(F.col("n"), F.col("b"), F.col("m"))).collect()] == [44, 52, 16]


def test_hybrid_degrades_without_vectors(spark):
    f = files(spark, [("a", "notes", "document", None, [], False, True), ("b", "budget", "document", None, [], False, True), ("c", "other", "image", None, [], False, True)])
    d = docs(spark, [("a", "budget budget", None), ("c", "budget", None)] + [(f"z{i}", "plum", None) for i in range(20)])
    plain = [(r.file_id, r.score) for r in search.hybrid_search(f, d, "budget", category="document").collect()]
    assert {x for x, _ in plain} == {"a", "b"} and dict(plain)["b"] == 75 + 18
    none = spark.createDataFrame([], "file_id string, score double, snippet string")
    assert [(r.file_id, r.score) for r in search.hybrid_search(f, d, "budget", none, "document").collect()] == plain
    some = spark.createDataFrame([("c", 0.9, "vector text")], "file_id string, score double, snippet string")
    got = {r.file_id: r for r in search.hybrid_search(f, d, "budget", some).collect()}
    assert got["c"].snippet == "vector text" and 0 < got["a"].score <= 100


VEC = "id string, file_id string, idx int, text string, embedding array<double>, corpus_key string, embedding_model string, embedding_version string, dimension int"


def vecs(spark, rows):
    return spark.createDataFrame([(f"{f}#{i}", f, i, f"t{i}", e, c, "m", "1", len(e) if e else 0) for f, i, e, c in rows], VEC)


def test_vector_search(spark):
    v = vecs(spark, [("a", 0, [1.0, 0.0], None), ("a", 1, [0.6, 0.8], None), ("b", 0, [0.21, math.sqrt(1 - 0.21**2)], None), ("c", 0, [0.23, math.sqrt(1 - 0.23**2)], None), ("d", 0, [0.0, 0.0], None), ("e", 0, None, None)])
    ok = search.valid_vectors(v, "m", "1", 2)
    got = [(r.file_id, r.chunk_idx) for r in search.vector_search(ok, [1.0, 0.0]).collect()]
    assert got == [("a", 0), ("c", 0)]
    assert search.valid_vectors(v, "m", "2", 2).count() == 0
    live = spark.createDataFrame([("c",)], "id string")
    assert [r.file_id for r in search.vector_search(ok, [1.0, 0.0], live=live).collect()] == ["c"]


def test_ann_paths(spark):
    import numpy as np

    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(40, 32))
    rows = [(f"f{i}", j, (base[i % 40] + 0.05 * rnd.normal(size=32)).tolist(), "user") for i in range(200) for j in range(1)]
    v = vecs(spark, rows)
    q = base[0].tolist()
    exact, m0 = search.ann_search(v, q, "user", 32, exact_up_to=500)
    guard, m1 = search.ann_search(v, q, "user", 32, probes=2)  # too few candidates
    loose, m2 = search.ann_search(v, q, "user", 32, fallback=False)
    assert m0["path"] == "exact" and m1["path"] == "guard" and m2["path"] == "ann" and m2["candidates"] < 200
    e, g, a = ({r.file_id for r in x.collect()} for x in (exact, guard, loose))
    assert e == g and a <= e and len({f"f{i}" for i in range(0, 200, 40)} & a) == 5


def test_pagination(spark):
    d = spark.range(1875).withColumnRenamed("id", "x")
    p = search.paginate(d, ["x"], 38).first()
    assert (p.page, p.page_count, p.start, p.end, p.x) == (38, 38, 1851, 1875, 1850)
    assert search.paginate(d, ["x"], 99, float("nan")).first().page == 38 and search.paginate(d, ["x"], -3, 10).first().start == 1
    assert search.paginate(d.where("false"), ["x"], 2).collect() == []


def test_metrics(spark):
    res = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "z", 1), (2, "c", 2)], "query_id int, item string, rank int")
    exp = spark.createDataFrame([(1, "a"), (1, "x"), (2, "c"), (3, "q")], "query_id int, item string")
    r = search.retrieval_metrics(res, exp).first()
    assert abs(r.mrr - 0.5) < 1e-9 and abs(r.recall_at_10 - 0.5) < 1e-9 and abs(r.precision_at_5 - (0.2 + 0.2) / 3) < 1e-9


def test_bucket_recall_equals_brute_force_without_pairs(spark):
    """Two corpora, one small enough to be scanned, repeated vectors; queries and vectors are never joined in pairs."""
    import numpy as np

    from corvane.functions import vectors as V

    x = np.random.default_rng(4).normal(size=(700, 16))
    x[300:420] = x[:120]
    rows = [(f"v{i:04d}", "big" if i < 620 else "small", v.tolist()) for i, v in enumerate(x)]
    v = spark.createDataFrame(rows, "id string, corpus_key string, embedding array<double>")
    got = search.bucket_recall(v, v.where("cast(substr(id, 2) as int) % 9 = 0"), 16, probes=20)
    assert "zip_with" not in got._jdf.queryExecution().toString()
    filed, asked = V.signatures(x), V.probes(x, 20)
    p5, recall, rr, n = [], [], [], 0
    for i in range(0, 700, 9):
        others = [j for j in range(700) if j != i and rows[j][1] == rows[i][1]]
        s = {j: sum(float(a) * float(b) for a, b in zip(x[i], x[j])) / (np.sqrt(sum(a * a for a in x[i].tolist())) * np.sqrt(sum(a * a for a in x[j].tolist()))) for j in others}
        order = sorted(others, key=lambda j: (-s[j], j))
        met = [j for j in order if rows[i][1] == "small" or any(np.isin(filed[j, t], asked[i, t]).any() for t in range(V.TABLES))][:10]
        hits = [j in order[:10] for j in met]
        p5.append(sum(hits[:5]) / 5), recall.append(sum(hits) / 10), rr.append(1 / (hits.index(True) + 1) if any(hits) else 0)
        n += 1
    r = got.first()
    assert r.queries == n and np.allclose([r.precision_at_5, r.recall_at_10, r.mrr], [np.mean(p5), np.mean(recall), np.mean(rr)]) and r.recall_at_10 < 1
