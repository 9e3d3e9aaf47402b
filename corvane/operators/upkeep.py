"""Keeping an index, a cache and a catalogue in order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_BYTES, MAX_ENTRIES = 200 * 1024 * 1024, 80
POLICY = "pdf-page-sampled-v1"


def stale_documents(files: DataFrame, docs: DataFrame, policy: str | None = None) -> DataFrame:
    """``id, stale, reason`` of every file against its indexed document.

    Stale: not indexed; another extraction policy than required; an indexed
    revision that is unknown or differs from the file's.
    """
    d = docs.select(F.col("id").alias("_did"), F.col("drive_modified_time").alias("_rev"), F.col("extraction_policy_version").alias("_pol"))
    j = files.select("id", "modified_time").join(d, F.col("id") == F.col("_did"), "left")
    bad_policy = F.lit(policy is not None) & ~F.coalesce(F.col("_pol") == F.lit(policy or ""), F.lit(False))
    has = F.coalesce("modified_time", F.lit("")) != ""
    reason = F.when(F.col("_did").isNull(), "missing").when(bad_policy, "policy").when(has & (F.coalesce("_rev", F.lit("")) == ""), "unknown-revision").when(has & (F.col("_rev") != F.col("modified_time")), "revision")
    return j.select("id", reason.isNotNull().alias("stale"), reason.alias("reason"))


def compatible(record_hash: Column, content_hash: Column, model: str, version: str, dimension: int) -> Column:
    """True if a stored vector can be kept for a chunk."""
    return F.coalesce((record_hash == content_hash) & (F.col("embedding_model") == model) & (F.col("embedding_version") == version) & (F.col("dimension") == dimension) & (F.size("embedding") == dimension), F.lit(False))


def vector_actions(chunks: DataFrame, vectors: DataFrame, model: str, version: str, dimension: int) -> DataFrame:
    """``file_id, idx, action``: keep, embed or delete, from chunks and stored vectors.

    Compatible vectors are kept, missing or incompatible ones embedded, and vectors
    beyond the file's non-blank chunks deleted. Files without chunks are left alone.
    """
    c = chunks.where(F.trim("text") != "").select("file_id", "idx", F.sha2("text", 256).alias("h"))
    v = vectors.select("file_id", "idx", "content_hash", "embedding_model", "embedding_version", "dimension", "embedding").join(c.select("file_id").distinct(), "file_id", "left_semi")
    ok = v.select("file_id", "idx", F.struct("content_hash", "embedding_model", "embedding_version", "dimension", "embedding").alias("v"))
    j = c.join(ok, ["file_id", "idx"], "full")
    s = F.col("v")
    good = (s["content_hash"] == F.col("h")) & (s["embedding_model"] == model) & (s["embedding_version"] == version) & (s["dimension"] == dimension) & (F.size(s["embedding"]) == dimension)
    act = F.when(F.col("h").isNull(), 0).when(F.coalesce(good, F.lit(False)), 2).otherwise(1)
    return j.groupBy("file_id", "idx").agg(F.max(act).alias("a")).select("file_id", "idx", F.element_at(F.array(F.lit("delete"), F.lit("embed"), F.lit("keep")), F.col("a") + 1).alias("action"))


def vector_sets(chunks: DataFrame, vectors: DataFrame, model: str, version: str, dimension: int) -> DataFrame:
    """``file_id, complete``: whether a file's vectors match its chunks one to one."""
    return vector_actions(chunks, vectors, model, version, dimension).groupBy("file_id").agg(F.every(F.col("action") == "keep").alias("complete"))


def prune_missing(docs: DataFrame, live: DataFrame, complete: bool, corpus: str | None = None) -> DataFrame:
    """Documents that stay. Only a complete enumeration prunes, and only within its corpus (null counts as ``user``)."""
    if not complete:
        return docs
    scope = F.lit(True) if corpus is None else F.coalesce("corpus_key", F.lit("user")) == corpus
    kept = docs.where(scope).join(live.select("id").distinct(), "id", "left_semi")
    return kept.unionByName(docs.where(~scope)) if corpus is not None else kept


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` without the keys of ``new``, plus ``new``: documents, chunks, postings or vault items replaced as a set."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def remove_rows(old: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return old.join(ids.select(key).distinct(), key, "left_anti")


def put_documents(state: dict[str, DataFrame], new: DataFrame, preserve_vectors: bool = False) -> dict[str, DataFrame]:
    """``state`` with documents replaced together with everything derived from them.

    ``state`` has ``documents`` (id, text), ``chunks`` (file_id, idx, text), ``postings`` (term,
    file_id, tf, best_chunk_idx) and ``vectors`` (file_id). Chunks and postings of the new texts
    are derived here; vectors of replaced files are dropped unless they are preserved.
    """
    from corvane.operators.search import chunk_rows, postings

    ids = new.select(F.col("id").alias("file_id")).distinct()
    chunks = chunk_rows(new)
    out = {"documents": replace_rows(state["documents"], new, "id")}
    for name, rows in (("chunks", chunks), ("postings", postings(chunks))):
        out[name] = remove_rows(state[name], ids, "file_id").unionByName(rows.select(*state[name].columns))
    out["vectors"] = state["vectors"] if preserve_vectors else remove_rows(state["vectors"], ids, "file_id")
    return out


def delete_documents(state: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """``state`` (see ``put_documents``) without the documents of ``ids`` (id) and everything derived from them."""
    own = ids.select(F.col("id").alias("file_id")).distinct()
    return {name: remove_rows(df, ids, "id") if name == "documents" else remove_rows(df, own, "file_id") for name, df in state.items()}


def prune_vectors(vectors: DataFrame, live: DataFrame, complete: bool, corpus: str | None = None) -> DataFrame:
    """Vectors that stay: those of live files. Only a complete enumeration prunes, and only within its corpus (null counts as ``user``)."""
    if not complete:
        return vectors
    mine = F.lit(True) if corpus is None else F.coalesce("corpus_key", F.lit("user")) == corpus
    kept = vectors.where(mine).join(live.select(F.col("id").alias("file_id")).distinct(), "file_id", "left_semi").select(*vectors.columns)
    return kept.unionByName(vectors.where(~mine)) if corpus is not None else kept


def index_signature(files: DataFrame, corpus: str, scope: str) -> DataFrame:
    """``signature``: SHA-256 of corpus, scope and the sorted ``id:revision`` list.

    The digest of one long string is sequential by nature: the list is sorted in
    ranges, and one task streams through them holding a batch at a time.
    """
    rows = files.where("id is not null").select(F.concat("id", F.lit(":"), F.coalesce("modified_time", F.lit(""))).alias("x")).orderBy("x").coalesce(1)

    def digest(batches):
        import hashlib

        h, first = hashlib.sha256(f"{corpus}|scope:{scope}|".encode()), True
        for b in batches:
            for x in b.column(0).to_pylist():
                h.update((x if first else "|" + x).encode())
                first = False
        yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest()])], ["signature"])

    return rows.mapInArrow(digest, "signature string")


def lru_evictions(cache: DataFrame, incoming: int = 0, replace_id: str | None = None, max_bytes: int = MAX_BYTES, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """``id`` of entries to evict, oldest first, until size and count fit with the incoming entry.

    Entry k goes if the entries at least as recent as k do not fit together with
    the incoming one. More than ``max_entries`` can never stay, so only that many
    newest are summed (a top-k, not a sort of the cache); all others go. Nulls:
    size 0, oldest. Ties by id.
    """
    rest = cache.where(F.col("id") != F.lit(replace_id)) if replace_id is not None else cache
    order = [F.col("cached_at").desc_nulls_last(), F.col("id")]
    newest = rest.select("id", "cached_at", F.coalesce("size", F.lit(0)).alias("size")).orderBy(*order).limit(max_entries)
    w = W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    fits = newest.withColumn("b", F.sum("size").over(w)).withColumn("n", F.count("*").over(w)).where((F.col("b") + incoming <= max_bytes) & (F.col("n") + 1 <= max_entries))
    return rest.select("id").join(F.broadcast(fits.select("id")), "id", "left_anti")


def ring_buffer(events: DataFrame, size: int = 120, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The newest ``size`` events."""
    return events.orderBy(F.desc(ts), F.desc(tie)).limit(size)


def contiguous_cursor(done: DataFrame, idx: str = "idx") -> DataFrame:
    """``cursor``: the first index from 0 that is not done; found by an anti-join, without a global sort."""
    have = done.select(F.col(idx).cast("bigint").alias("i")).where("i >= 0").distinct()
    start = done.sparkSession.createDataFrame([(0,)], "i bigint")
    after = have.select((F.col("i") + 1).alias("i")).unionByName(start)
    return after.join(have, "i", "left_anti").agg(F.min("i").alias("cursor"))


def batch_transition() -> Column:
    """Next step of an indexing batch from total, batch_end, contiguous_cursor, failures, cancelled, aborted."""
    return (
        F.when(F.col("cancelled") | F.col("aborted"), F.struct(F.lit("stopped").alias("kind"), F.lit(None).cast("bigint").alias("resume_from")))
        .when(F.col("contiguous_cursor") >= F.col("total"), F.struct(F.lit("done").alias("kind"), F.lit(None).cast("bigint").alias("resume_from")))
        .when(F.col("failures") > 0, F.struct(F.lit("retry").alias("kind"), F.col("contiguous_cursor").cast("bigint").alias("resume_from")))
        .when(F.col("batch_end") < F.col("total"), F.struct(F.lit("continue").alias("kind"), F.col("batch_end").cast("bigint").alias("resume_from")))
        .otherwise(F.struct(F.lit("incomplete").alias("kind"), F.col("contiguous_cursor").cast("bigint").alias("resume_from")))
    )


def apply_cache_meta(files: DataFrame, metas: DataFrame) -> DataFrame:
    """Files with cached copies become offline, and get the cached hash back if the revision still matches.

    Otherwise a hash verified for the present revision stays, a stale one becomes
    synthetic, any other is kept. ``metas``: id, sha256, drive_modified_time.
    """
    m = metas.select(F.col("id").alias("_mid"), F.col("sha256").alias("_sha"), F.col("drive_modified_time").alias("_rev")).dropDuplicates(["_mid"])
    j = files.join(m, F.col("id") == F.col("_mid"), "left")
    hit = F.col("_mid").isNotNull()
    hash_ = F.coalesce("content_hash", F.lit(""))
    cached = F.coalesce((F.coalesce("_sha", F.lit("")) != "") & (F.coalesce("_rev", F.lit("")) != "") & (F.col("_rev") == F.col("modified_time")), F.lit(False))
    current = F.coalesce(hash_.startswith("sha256:") & (F.col("content_hash_modified_time") == F.col("modified_time")) & (F.col("content_hash_modified_time") != ""), F.lit(False))
    fixed = F.when(cached, F.concat(F.lit("sha256:"), "_sha")).when(current, F.col("content_hash")).when(hash_.startswith("sha256:"), F.concat(F.lit("gdrive-"), "id", F.lit("-"), F.coalesce("size", F.lit(0)).cast("string"))).otherwise(F.col("content_hash"))
    when = F.when(cached, F.col("_rev")).when(current, F.col("content_hash_modified_time"))
    changed = {"is_offline": F.when(hit, True).otherwise(F.col("is_offline")), "content_hash": F.when(hit, fixed).otherwise(F.col("content_hash")), "content_hash_modified_time": F.when(hit, when).otherwise(F.col("content_hash_modified_time"))}
    return j.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in files.columns])


def verify_hashes(files: DataFrame, hashed: DataFrame) -> DataFrame:
    """Files with fresh hashes taken over where the revision did not change meanwhile.

    ``hashed``: id, sha256, modified_time (read after hashing). Adds ``verified``
    (true, false for a changed revision, null where nothing was hashed).
    """
    h = hashed.select(F.col("id").alias("_hid"), F.col("sha256").alias("_sha"), F.col("modified_time").alias("_rev")).dropDuplicates(["_hid"])
    j = files.join(h, F.col("id") == F.col("_hid"), "left").withColumn("verified", F.when(F.col("_hid").isNotNull(), F.coalesce(F.col("_rev") == F.col("modified_time"), F.lit(False))))
    ok = F.coalesce("verified", F.lit(False))
    return j.withColumn("content_hash", F.when(ok, F.concat(F.lit("sha256:"), "_sha")).otherwise(F.col("content_hash"))).withColumn("content_hash_modified_time", F.when(ok, F.col("_rev")).otherwise(F.col("content_hash_modified_time"))).drop("_hid", "_sha", "_rev")


def merge_listing(listed: DataFrame, known: DataFrame) -> DataFrame:
    """A fresh listing plus local-only rows that it does not contain."""
    local = known.where(~F.coalesce("is_drive_item", F.lit(False))).join(listed.select("id").distinct(), "id", "left_anti")
    return listed.unionByName(local, allowMissingColumns=True)


def rate_limit_sessions(requests: DataFrame, window_ms: int = 60_000) -> DataFrame:
    """``user, ts, request_id, session``: a gap of ``window_ms`` starts a session, whatever went before.

    A bucket never outlives the window after its user's last request, so sessions are
    independent. Gaps are found in hour blocks and between them, so a user with a third
    of all requests is spread over tasks.
    """
    r = requests.withColumn("blk", F.floor(F.col("ts") / 3_600_000))
    inner = W.partitionBy("user", "blk").orderBy("ts", "request_id")
    edge = r.groupBy("user", "blk").agg(F.max("ts").alias("hi"))
    before = edge.withColumn("prev_hi", F.lag("hi").over(W.partitionBy("user").orderBy("blk"))).select("user", "blk", "prev_hi")
    r = r.join(before, ["user", "blk"]).withColumn("prev", F.coalesce(F.lag("ts").over(inner), "prev_hi"))
    r = r.withColumn("starts", F.when(F.col("prev").isNull() | (F.col("ts") - F.col("prev") >= window_ms), F.col("ts")))
    r = r.withColumn("s", F.max("starts").over(inner.rowsBetween(W.unboundedPreceding, 0)))
    last = r.groupBy("user", "blk").agg(F.max("starts").alias("last"))
    carry = last.withColumn("carry", F.max("last").over(W.partitionBy("user").orderBy("blk").rowsBetween(W.unboundedPreceding, -1))).select("user", "blk", "carry")
    return r.join(carry, ["user", "blk"]).select("user", "ts", "request_id", F.coalesce("s", "carry").alias("session"))


def rate_limit_decisions(requests: DataFrame, limit: int = 30, window_ms: int = 60_000) -> DataFrame:
    """``user, ts, request_id, allowed, retry_after, log_event`` under a fixed window anchored at its first request.

    ``requests``: user, ts (epoch ms), request_id. The limit is clamped to 1..1000. Denied
    requests wait at least one second; only the first denial of a window is logged.
    Rows with null user or ts are ignored.
    """
    import pandas as pd

    limit = min(1000, max(1, int(limit)))
    ok = requests.where("user is not null and ts is not null").select("user", "ts", "request_id")

    def decide(batches):
        # Sessions follow each other sorted, so only the open window is carried on; no session is gathered.
        at, reset, count = None, 0, 0
        for pdf in batches:
            allowed, retry, log = [], [], []
            for user, session, ts in zip(pdf["user"].tolist(), pdf["session"].tolist(), pdf["ts"].tolist()):
                if (user, session) != at or ts >= reset:
                    at, reset, count = (user, session), ts + window_ms, 0
                good = count < limit
                allowed.append(good), retry.append(0 if good else max(1, -((ts - reset) // 1000))), log.append(count == limit)
                count += 1
            yield pd.DataFrame({"user": pdf["user"], "ts": pdf["ts"], "request_id": pdf["request_id"], "allowed": allowed, "retry_after": retry, "log_event": log})

    s = rate_limit_sessions(ok, window_ms).repartition("user", "session").sortWithinPartitions("user", "session", "ts", "request_id")
    return s.mapInPandas(decide, "user bigint, ts bigint, request_id bigint, allowed boolean, retry_after bigint, log_event boolean")
