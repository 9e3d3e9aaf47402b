"""Search: inverted index and ranking, vector search, metadata score, hybrid fusion.

The query side is a handful of literals, so query terms filter the tokens before
anything is shuffled; document counts and scores are two small aggregations and
the top 200 is a TakeOrderedAndProject. Snippets are fetched for the winners only.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions import vectors as V
from corvane.functions.catalog import instant
from corvane.session import batches_of, stage

TOP = 200
ASKED = 512  #: queries of one task of ``bucket_recall``
SMALL = 200_000  #: hit lists up to this many rows are broadcast, longer ones are joined by shuffle


def _small(df: DataFrame) -> DataFrame:
    """A broadcast hint where a count shows the list to be small."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def current_documents(documents: DataFrame) -> DataFrame:
    """The newest indexed row per file id (``indexed_at`` as an instant, then ``doc_id``); null corpus is ``user``."""
    w = W.partitionBy("id").orderBy(instant("indexed_at").desc_nulls_last(), F.col("doc_id").desc())
    one = documents.where("id is not null").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return one.withColumn("corpus_key", F.coalesce("corpus_key", F.lit("user")))


def chunk_rows(docs: DataFrame, key: str = "id") -> DataFrame:
    """``file_id, idx, text`` of every chunk."""
    return docs.select(F.col(key).alias("file_id"), F.posexplode(T.chunk("text")).alias("idx", "text"))


def postings(chunks: DataFrame, only: list[str] | None = None) -> DataFrame:
    """``term, file_id, tf, best_chunk_idx``: per term and file the highest count in one chunk, and that chunk (smallest on ties).

    With ``only`` (query terms) other tokens are dropped before counting.
    """
    tokens = T.tokenize("text")
    if only is not None:
        tokens = F.filter(tokens, lambda t: t.isin(list(only)))
    counted = chunks.select("file_id", "idx", F.explode(tokens).alias("term")).groupBy("file_id", "term", "idx").agg(F.count("*").alias("n"))
    best = counted.groupBy("file_id", "term").agg(F.max(F.struct(F.col("n"), (-F.col("idx")).alias("i"))).alias("b"))
    return best.select("term", "file_id", F.col("b.n").alias("tf"), (-F.col("b.i")).cast("int").alias("best_chunk_idx"))


def bm25(docs: DataFrame, query: str, corpus: str | None = None, top: int | None = TOP) -> DataFrame:
    """``file_id, score, best_chunk_idx`` of matching files, best first.

    The score sums over query terms (repeats count again) tf * idf / (tf + 1.2) with
    idf = ln(1 + (N - df + 0.5) / (df + 0.5)). Ties: earliest matching term, then id.
    """
    terms = T.query_terms(query)
    if corpus is not None:
        docs = docs.where(F.col("corpus_key") == corpus)
    if not terms:
        return docs.select(F.col("id").alias("file_id"), F.lit(0.0).alias("score"), F.lit(0).alias("best_chunk_idx")).where("false")
    post = postings(chunk_rows(docs), terms)
    spark = docs.sparkSession
    asked = spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, pos int")  # the query: a few rows
    df = post.groupBy("term").agg(F.count("*").alias("df"))  # one row per query term
    facts = docs.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    idf = df.crossJoin(facts).select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    scored = post.join(F.broadcast(asked), "term").join(F.broadcast(idf), "term")
    out = scored.groupBy("file_id").agg(
        F.sum(F.col("tf") * F.col("idf") / (F.col("tf") + F.lit(1.2))).alias("score"),
        F.min_by("best_chunk_idx", F.struct(-F.col("tf"), F.col("pos"))).alias("best_chunk_idx"), F.min("pos").alias("first"))
    out = out.orderBy(F.desc("score"), "first", "file_id")
    return (out.limit(top) if top else out).select("file_id", "score", "best_chunk_idx", "first")


def with_snippets(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds ``snippet``: the first 160 characters of each hit's best chunk."""
    found = docs.join(_small(hits.select(F.col("file_id").alias("id"), "best_chunk_idx")), "id").select(
        F.col("id").alias("file_id"), F.trim(F.substring(F.coalesce(F.get(T.chunk("text"), F.col("best_chunk_idx")), F.lit("")), 1, 160)).alias("snippet"))
    return hits.join(found, "file_id", "left").withColumn("snippet", F.coalesce("snippet", F.lit("")))


def category_filter(files: DataFrame, category: str | None) -> DataFrame:
    """Coarse filter: everything, starred files, drive items, or one category."""
    if category in (None, "", "all"):
        return files
    if category == "starred":
        return files.where(F.coalesce("starred", F.lit(False)))
    if category == "google_drive":
        return files.where(F.coalesce("is_drive_item", F.lit(False)))
    return files.where(F.col("category") == category)


def metadata_columns(query: str) -> tuple[Column, Column]:
    """(score 0..100, reasons) of a file row for a query, from name, summary and tags."""
    terms = T.expand_terms(query)
    q = query.lower().strip()
    name, summary = F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("semantic_summary", F.lit("")))
    tags = F.lower(F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "))
    exact = (name == q) | (T.stem(name) == q)
    phrase = F.lit(len(terms) > 1) & (name.contains(q) | summary.contains(q))
    points = []
    for t in terms:
        rest = F.lit(0) if t in T.STOPWORDS else F.when(summary.contains(t), 15).when(tags.contains(t), 10).otherwise(0)
        points.append(F.when(name.contains(t), 25).otherwise(rest))
    total = reduce(lambda a, b: a + b, points, F.lit(0))
    hit = reduce(lambda a, b: a + b, [F.when(p > 0, 1).otherwise(0) for p in points], F.lit(0))
    starred = F.coalesce("starred", F.lit(False)) & ((hit > 0) | exact | phrase)
    score = F.least(F.lit(100), F.when(exact, 50).when(phrase, 45).otherwise(0) + total + F.when(starred, 5).otherwise(0))
    reasons = F.filter(F.array(
        F.when(exact, "Exact filename match").when(phrase, "Metadata phrase match"),
        F.when(hit > 0, F.concat(F.lit("Metadata terms "), hit.cast("string"), F.lit(f"/{len(terms)}"))), F.when(starred, "Starred")), lambda x: x.isNotNull())
    return score, reasons


def metadata_search(files: DataFrame, query: str, category: str | None = None) -> DataFrame:
    """``file_id, score, snippet, reason`` by metadata alone; a blank query lists every file with score 0."""
    f = category_filter(files, category)
    snippet = F.when(F.coalesce("semantic_summary", F.lit("")) != "", F.col("semantic_summary")).otherwise(F.col("name"))
    if not query.strip():
        return f.select(F.col("id").alias("file_id"), F.lit(0).alias("score"), snippet.alias("snippet"), F.lit("Browse mode (no query)").alias("reason"))
    score, reasons = metadata_columns(query)
    return f.select(F.col("id").alias("file_id"), score.alias("score"), snippet.alias("snippet"), F.array_join(reasons, " · ").alias("reason")).where("score > 0").orderBy(F.desc("score"), "file_id")


def valid_vectors(vectors: DataFrame, model: str, version: str, dimension: int) -> DataFrame:
    """Rows a query vector of the profile may be compared with."""
    return vectors.where((F.col("embedding_model") == model) & (F.col("embedding_version") == version) & (F.col("dimension") == dimension) & (F.size("embedding") == dimension) & V.is_finite(F.col("embedding")))


def vector_search(vectors: DataFrame, query: list[float], min_score: float = V.MIN_COSINE, top: int | None = TOP, live: DataFrame | None = None) -> DataFrame:
    """``file_id, score, chunk_idx, snippet``: best cosine per file (smallest idx on ties), best files first."""
    if live is not None:
        vectors = vectors.join(live.select(F.col("id").alias("file_id")).distinct(), "file_id", "left_semi")
    q = F.array(*[F.lit(float(x)) for x in query])
    hits = vectors.select("file_id", "idx", "text", V.cosine(F.col("embedding"), q).alias("score")).where(F.col("score") >= min_score)
    best = hits.groupBy("file_id").agg(F.max(F.struct("score", (-F.col("idx")).alias("i"), "text")).alias("b"))
    out = best.select("file_id", F.col("b.score").alias("score"), (-F.col("b.i")).alias("chunk_idx"), F.trim(F.substring(F.coalesce(F.col("b.text"), F.lit("")), 1, 160)).alias("snippet"))
    out = out.orderBy(F.desc("score"), "file_id")
    return out.limit(top) if top else out


def merge_variants(hits: list[DataFrame]) -> DataFrame:
    """Best hit per file over query variants."""
    every = reduce(lambda a, b: a.unionByName(b), [h.withColumn("variant", F.lit(i)) for i, h in enumerate(hits)])
    best = every.groupBy("file_id").agg(F.max(F.struct("score", (-F.col("variant")).alias("v"), "chunk_idx", "snippet")).alias("b"))
    return best.select("file_id", F.col("b.score").alias("score"), F.col("b.chunk_idx").alias("chunk_idx"), F.col("b.snippet").alias("snippet"))


def available_documents(docs: DataFrame, live: DataFrame, legacy: DataFrame) -> DataFrame:
    """Indexed documents whose file is live, without the ids of ``legacy`` (file_id): what search may offer."""
    return docs.join(live.select("id").distinct(), "id", "left_semi").join(legacy.select(F.col("file_id").alias("id")).distinct(), "id", "left_anti")


def bucket_index(vectors: DataFrame, dimension: int) -> DataFrame:
    """``id, bucket``: 24 bucket keys per vector (two probes in each of twelve tables)."""
    scope = F.coalesce("corpus_key", F.lit("user"))
    return vectors.select("id", F.explode(V.bucket_keys(F.col("embedding"), scope, dimension)).alias("bucket"))


def ann_search(vectors: DataFrame, query: list[float], corpus: str, dimension: int, exact_up_to: int = 128, guard_count: int = 64, guard_score: float = 0.45, fallback: bool = True, probes: int = V.PROBES, min_score: float = V.MIN_COSINE, top: int = TOP) -> tuple[DataFrame, dict]:
    """Bucketed candidates, exact rerank, and the recall guard; returns (hits, metrics).

    Exact when the corpus has at most ``exact_up_to`` vectors; otherwise candidates
    are filed under one of the ``probes`` buckets per table that the query asks, and the
    exact scan runs again if they are fewer than ``guard_count`` or their best score is
    under ``guard_score``. ``bucket_recall`` measures the bucket path alone.
    """
    own = vectors.where(F.coalesce("corpus_key", F.lit("user")) == corpus)
    total = own.count()
    if total <= exact_up_to:
        return vector_search(own, query, min_score, top), {"total": total, "candidates": total, "path": "exact"}
    probe = own.sparkSession.createDataFrame([(k,) for k in V.query_keys(query, corpus, probes)], "bucket string")  # the query
    ids = bucket_index(own, dimension).join(F.broadcast(probe), "bucket", "left_semi").select("id").distinct()
    some = own.join(ids, "id", "left_semi")
    count = some.count()
    hits = vector_search(some, query, min_score, top)
    best = hits.agg(F.max("score")).first()[0]
    if fallback and (count < guard_count or (best if best is not None else -1) < guard_score):
        return vector_search(own, query, min_score, top), {"total": total, "candidates": count, "path": "guard"}
    return hits, {"total": total, "candidates": count, "path": "ann"}


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``V.cosine`` of the rows of two matrices, added in the same order, so equal vectors tie."""
    dot, nx, ny = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for k in range(x.shape[1]):
        dot, nx, ny = dot + x[:, k] * y[:, k], nx + x[:, k] * x[:, k], ny + y[:, k] * y[:, k]
    length = np.sqrt(nx) * np.sqrt(ny)
    return np.where(length > 0, dot / np.where(length > 0, length, 1.0), 0.0)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x**2).sum(1))[:, None]
    return (x / np.where(n > 0, n, 1.0)).astype(np.float32)


def _nearest(batches, files: list[str], dimension: int, k: int, probes: int, exact_up_to: int):
    """The ``k`` nearest (``exact``), and the ``k`` nearest that share a bucket, of a block of queries; the data are read in slices.

    Products in single precision rule out what cannot be near enough; cosines and buckets
    are taken of the rest only.
    """
    mine = [b for b in batches if b.num_rows]
    if not mine:
        return
    ids, corpora = ([v for b in mine for v in b.column(c).to_pylist()] for c in (0, 1))
    q = np.concatenate([b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for b in mine])
    q32, count = _unit(q), np.concatenate([b.column(3).to_numpy(zero_copy_only=False) for b in mine])
    code = {c: i for i, c in enumerate(dict.fromkeys(corpora))}
    own, names = np.array([code[c] for c in corpora]), pd.Index(ids)
    asked = np.zeros((len(q), V.TABLES, 1 << V.BITS), bool)
    np.put_along_axis(asked, V.probes(q, probes), True, 2)
    best = {way: pd.DataFrame({"i": np.zeros(0, int), "s": np.zeros(0), "item": np.zeros(0, object)}) for way in ("exact", "found")}
    least = {way: np.full(len(q), -np.inf) for way in best}

    def add(i, j, x, items, way):
        """Merge pairs of query ``i`` and row ``j`` into the best of a way."""
        for at in range(0, len(i), 50_000):
            p, r = i[at : at + 50_000], j[at : at + 50_000]
            if way == "found":
                rows, back = np.unique(r, return_inverse=True)
                sig = V.signatures(x[rows])[back]
                met = asked[p[:, None, None], np.arange(V.TABLES)[None, :, None], sig].any((1, 2)) | (count[p] <= exact_up_to)
                p, r = p[met], r[met]
            new = pd.DataFrame({"i": p, "s": _cosines(x[r], q[p]), "item": items[r]})
            got = pd.concat([best[way], new], ignore_index=True).sort_values(["i", "s", "item"], ascending=[True, False, True])
            best[way] = got[got.groupby("i").cumcount() < k]
            full = best[way].groupby("i")["s"].agg(["size", "min"])
            full = full[full["size"] == k]
            least[way][full.index] = full["min"]

    for b in batches_of(files, ["id", "corpus_key", "embedding"], 8192):
        there = np.array([code.get(c, -1) for c in b.column(1).to_pylist()])
        x, items = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), b.column(0).to_numpy(zero_copy_only=False)
        s = np.where(own[:, None] == there, q32 @ _unit(x).T, np.float32(-9))
        itself = names.get_indexer(items)
        s[itself[itself >= 0], np.flatnonzero(itself >= 0)] = -9
        for way in best:
            done = np.full(s.shape, False)
            if np.isinf(least[way]).any() and len(x) > 8 * k:  # the first slices: a bound from the nearest rows
                top = np.argpartition(-s, 8 * k, axis=1)[:, : 8 * k]
                np.put_along_axis(done, top, np.take_along_axis(s, top, 1) > -9, 1)
                done[~np.isinf(least[way])] = False
                add(*np.nonzero(done), x, items, way)
            near = (s > -9) & (s >= (least[way] - 1e-5)[:, None].astype(np.float32)) & ~done
            add(*np.nonzero(near), x, items, way)
    for way, got in best.items():
        rank = got.groupby("i").cumcount().to_numpy() + 1
        yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in got["i"]], pa.string()), pa.array(got["item"], pa.string()), pa.array(rank, pa.int32()), pa.array([way] * len(got), pa.string())], ["query_id", "item", "rank", "way"])


def bucket_recall(vectors: DataFrame, queries: DataFrame, dimension: int, k: int = 10, probes: int = V.PROBES, exact_up_to: int = 128) -> DataFrame:
    """``queries, precision_at_5, recall_at_10, mrr`` of ``ann_search``, without its guard, against a scan.

    Corpora of up to ``exact_up_to`` vectors are scanned, as there; all others go through the buckets.
    Queries are cut into blocks; a task reads all vectors in slices from the shared folder.

    ``vectors``: id, corpus_key, embedding (valid, one row per id); ``queries``: some of
    them, all with a corpus. A query's own row does not count.
    """
    data = stage(vectors.select("id", "corpus_key", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")))
    size = data.groupBy("corpus_key").agg(F.count("*").alias("n"))
    q = stage(queries.select("id", "corpus_key", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")))
    files, blocks = data.inputFiles(), max(1, min(12, q.count() // 64), -(-q.count() // ASKED))
    asked = q.join(size, "corpus_key").select("id", "corpus_key", "embedding", "n").repartition(blocks)
    got = stage(asked.mapInArrow(lambda batches: _nearest(batches, files, dimension, k, probes, exact_up_to), "query_id string, item string, rank int, way string"))
    metrics = retrieval_metrics(got.where("way = 'found'").drop("way"), got.where("way = 'exact'").select("query_id", "item"))
    return q.agg(F.count("*").alias("queries")).crossJoin(metrics)  # one row each


def hybrid_scores(neural: Column, bm25n: Column, meta: Column) -> Column:
    """Weighted fusion; a lexical-only hit may be lifted to half of its lexical score."""
    weighted = T.half_up(neural * 0.55 + bm25n * 0.25 + meta * 0.2)
    floor = T.half_up(bm25n * 0.5 + meta * 0.2)
    return F.when((neural > 0) | (bm25n <= 0), weighted).otherwise(F.greatest(weighted, floor))


def hybrid_search(files: DataFrame, docs: DataFrame, query: str, neural: DataFrame | None = None, category: str | None = None, corpus: str | None = None) -> DataFrame:
    """``file_id, score, snippet`` fused from metadata, body text and (optionally) vectors.

    ``neural`` holds vector hits (file_id, score, snippet); null or empty selects the
    fusion without vectors. Body hits are cut to 200 before the category filter,
    vector hits after it. Ties keep candidate order: metadata matches, body hits,
    vector hits, then id.
    """
    if not query.strip():
        return metadata_search(files, query, category).select("file_id", "score", "snippet")
    f = category_filter(files, category)
    meta, _ = metadata_columns(query)
    q = query.lower().strip()
    body = with_snippets(bm25(docs, query, corpus), docs).select("file_id", F.col("score").alias("b"), F.col("snippet").alias("b_snip"), "first")
    use_neural = neural is not None and not neural.isEmpty()
    rows = f.withColumn("meta", meta).join(F.broadcast(body), F.col("id") == F.col("file_id"), "left").drop("file_id")
    if use_neural:
        n = neural.select(F.col("file_id").alias("_nid"), F.col("score").alias("n"), F.col("snippet").alias("n_snip"))
        rows = rows.join(_small(n), F.col("id") == F.col("_nid"), "left")
    else:
        rows = rows.withColumn("n", F.lit(None).cast("double")).withColumn("n_snip", F.lit(None).cast("string"))
    bm = F.coalesce(F.least(F.lit(100.0), F.col("b") * 12), F.lit(0.0))
    nn = F.coalesce(T.half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("n"))) * 100), F.lit(0))
    if use_neural:
        score = hybrid_scores(nn, bm, F.col("meta"))
    else:
        score = F.when(F.col("b").isNotNull(), T.half_up(F.least(F.lit(100.0), F.col("meta") + F.least(F.lit(40.0), F.col("b") * 8) * 0.5))).otherwise(F.col("meta"))
    name = F.lower(F.coalesce("name", F.lit("")))
    exact = (name == q) | (T.stem(name) == q)
    phrase = F.lit(len(query.strip()) > 1) & (name.contains(q) | F.lower(F.coalesce("semantic_summary", F.lit(""))).contains(q))
    boost = F.when(exact, 18).when(phrase, 6).otherwise(0)
    snippet = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("n_snip", "b_snip", "semantic_summary", "name")], F.lit(""))
    order = F.when(F.col("meta") > 0, 0).when(F.col("b").isNotNull(), 1).otherwise(2)
    return (
        rows.withColumn("raw", score).where(((F.col("meta") > 0) | (bm > 0) | (nn > 0)) & (F.col("raw") > 0))
        .select(F.col("id").alias("file_id"), F.least(F.lit(100), F.col("raw") + boost).cast("bigint").alias("score"), snippet.alias("snippet"), order.alias("o"))
        .orderBy(F.desc("score"), "o", "file_id").drop("o")
    )


def paginate(df: DataFrame, order: list, page: float = 1, size: float = 50) -> DataFrame:
    """One page with ``page, page_count, total, start, end``; page and size are made safe first."""
    import math

    size = math.floor(size) if math.isfinite(size) and size > 0 else 50
    total = df.count()
    pages = max(1, -(-total // size))
    page = min(pages, max(1, math.floor(page))) if math.isfinite(page) else 1
    begin = (page - 1) * size
    shown = max(0, min(size, total - begin))
    return df.orderBy(*order).offset(begin).limit(size).select(
        "*", F.lit(page).alias("page"), F.lit(pages).alias("page_count"), F.lit(total).cast("bigint").alias("total"), F.lit(begin + 1 if shown else 0).alias("start"), F.lit(begin + shown if shown else 0).alias("end"))


def retrieval_metrics(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Mean precision at 5, recall at 10 and reciprocal rank over queries.

    ``results``: query_id, item, rank (1-based); ``expected``: query_id, item.
    """
    hit = results.join(expected.withColumn("ok", F.lit(1)), ["query_id", "item"], "left").fillna({"ok": 0})
    per = hit.groupBy("query_id").agg(
        (F.sum(F.when(F.col("rank") <= 5, F.col("ok")).otherwise(0)) / 5).alias("p5"), F.sum(F.when(F.col("rank") <= 10, F.col("ok")).otherwise(0)).alias("h10"),
        F.coalesce(1 / F.min(F.when(F.col("ok") == 1, F.col("rank"))), F.lit(0.0)).alias("rr"))
    size = expected.groupBy("query_id").agg(F.count("*").alias("m"))
    return size.join(per, "query_id", "left").agg(
        F.avg(F.coalesce("p5", F.lit(0.0))).alias("precision_at_5"), F.avg(F.coalesce(F.col("h10") / F.col("m"), F.lit(0.0))).alias("recall_at_10"), F.avg(F.coalesce("rr", F.lit(0.0))).alias("mrr"))
