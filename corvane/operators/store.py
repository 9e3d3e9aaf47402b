"""Stored tables of the catalogue: lookups, snapshots, cache and backup merges, embedding batches.

Writers replace whole partitions, so a repeated write leaves the same state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.catalog import corpus_key
from corvane.operators.upkeep import lru_evictions, replace_rows

BATCH, MAX_CHARS = 32, 8000


def by_id(table: DataFrame, value: str, key: str = "id") -> DataFrame:
    """Rows with one key; the filter reaches the Parquet scan."""
    return table.where(F.col(key) == value)


def by_corpus(table: DataFrame, corpus: str | None = None) -> DataFrame:
    """Rows of one corpus (null counts as ``user``); all rows without a corpus."""
    return table if corpus is None else table.where((F.col("corpus_key") == corpus) | (F.col("corpus_key").isNull() & F.lit(corpus == "user")))


def by_terms(postings: DataFrame, terms: list[str]) -> DataFrame:
    return postings.where(F.col("term").isin(list(terms)))


def by_buckets(vectors: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Vectors filed under any of the bucket keys, each once."""
    return vectors.join(index.where(F.col("bucket").isin(list(keys))).select("id").distinct(), "id", "left_semi")


def save_snapshot(files: DataFrame, folders: DataFrame, root: str, corpus: str, shared_drive_id: str | None, saved_at: str, truncated: bool = False) -> None:
    """Write the drive items of one corpus; the corpus's earlier snapshot is replaced, others stay."""
    spark = files.sparkSession
    key = spark.range(1).select(corpus_key(F.lit(corpus), F.lit(shared_drive_id))).first()[0]
    part = key.replace(":", "_")
    files.where(F.coalesce("is_drive_item", F.lit(False))).write.mode("overwrite").parquet(f"{root}/files/corpus={part}")
    folders.write.mode("overwrite").parquet(f"{root}/folders/corpus={part}")
    head = spark.createDataFrame([(key, saved_at, truncated)], "corpus_key string, saved_at string, truncated boolean")
    head.coalesce(1).write.mode("overwrite").parquet(f"{root}/heads/corpus={part}")  # last: names what is complete


def load_snapshot(spark: SparkSession, root: str, corpus: str | None = None, shared_drive_id: str | None = None) -> tuple[DataFrame, DataFrame] | None:
    """(files, folders) of a corpus, or of the newest snapshot if none is named; None if there is none. Corpora never mix."""
    heads = spark.read.parquet(f"{root}/heads").drop("corpus")
    if corpus is None:
        row = heads.agg(F.max_by("corpus_key", "saved_at")).first()
    else:
        row = heads.where(F.col("corpus_key") == corpus_key(F.lit(corpus), F.lit(shared_drive_id))).select("corpus_key").first()
    if row is None or row[0] is None:
        return None
    part = row[0].replace(":", "_")
    return spark.read.parquet(f"{root}/files/corpus={part}"), spark.read.parquet(f"{root}/folders/corpus={part}")


def put_cached(cache: DataFrame, entry: DataFrame, size: int, key: str, max_bytes: int, max_entries: int) -> DataFrame:
    """The cache with one more (or replaced) entry, after evicting the oldest that do not fit."""
    gone = lru_evictions(cache, size, key, max_bytes, max_entries)
    return cache.where(F.col("id") != key).join(gone, "id", "left_anti").unionByName(entry, allowMissingColumns=True)


def touch(cache: DataFrame, key: str, now: Column) -> DataFrame:
    """Reading an entry makes it the newest."""
    return cache.withColumn("cached_at", F.when(F.col("id") == key, now).otherwise(F.col("cached_at")))


def seal_backup(docs: DataFrame, vectors: DataFrame, passphrase: str, created_at: str, max_bytes: int = 128 * 1024 * 1024) -> bytes:
    """An encrypted backup of documents and vectors, written only if every backup rule holds and the estimate fits.

    The container is one file in memory; its size is checked on the cluster before any row is fetched.
    """
    from corvane.functions.crypto import write_backup
    from corvane.operators.validation import backup_bytes, backup_violations

    bad = [f"{r['rule']}: {r['violations']}" for r in backup_violations(docs, vectors).where("violations > 0").collect()]  # a row per rule at most
    if bad:
        raise ValueError("backup breaks rules: " + "; ".join(bad))
    size = backup_bytes(docs, vectors).first()[0]
    if size > max_bytes:
        raise ValueError(f"backup too large: about {size} bytes")
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]  # noqa: E731 - bounded by max_bytes
    return write_backup(docs.sparkSession, {"createdAt": created_at, "documents": rows(docs), "vectors": rows(vectors)}, passphrase)


def merge_restore(current: dict[str, DataFrame], backup: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Merge a backup: documents, vault items and snapshots replace equal ids; all vectors of restored documents are replaced."""
    out = {k: replace_rows(v, backup[k], "id") if k in backup else v for k, v in current.items() if k != "vectors"}
    docs = backup["documents"].select(F.col("id").alias("file_id")).distinct()
    out["vectors"] = current["vectors"].join(docs, "file_id", "left_anti").unionByName(backup["vectors"], allowMissingColumns=True)
    return out


def export_events(events: DataFrame) -> DataFrame:
    """``line``: one JSON object per diagnostic event."""
    return events.select(F.to_json(F.struct("*")).alias("line"))


def retry_wait(attempt: Column, base_ms: Column, retry_after_ms: Column, jitter: Column) -> Column:
    """Milliseconds to wait: exponential, at least what the server asks, spread by 0.75 to 1.25, at most a minute."""
    return F.least(F.lit(60_000.0), F.greatest(base_ms * F.pow(F.lit(2.0), attempt), F.coalesce(retry_after_ms, F.lit(0))) * (F.lit(0.75) + jitter * F.lit(0.5)))


def embed_texts(texts: DataFrame, provider: Callable[[list[str]], list[list[float]]], model: str, version: str, dimension: int, column: str = "text") -> DataFrame:
    """Adds ``embedding`` and its profile columns by calling ``provider`` on batches of at most 32 texts of 8000 characters.

    A batch whose answer has a wrong count or length or non-finite values raises.
    Null and blank texts get a null embedding.
    """

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import math

        for s in batches:
            out: list = [None] * len(s)
            at = [i for i, t in enumerate(s) if t is not None and t.strip()]
            for lo in range(0, len(at), BATCH):
                part = at[lo : lo + BATCH]
                got = provider([s.iloc[i][:MAX_CHARS] for i in part])
                if len(got) != len(part) or any(len(v) != dimension or not all(map(math.isfinite, v)) for v in got):
                    raise ValueError("embedding provider returned an unusable answer")
                for i, v in zip(part, got):
                    out[i] = list(map(float, v))
            yield pd.Series(out, dtype=object)

    return texts.withColumn("embedding", embed(F.col(column))).withColumns({"embedding_model": F.lit(model), "embedding_version": F.lit(version), "dimension": F.lit(dimension)})


def embed_vectors(chunks: DataFrame, actions: DataFrame, vectors: DataFrame, provider: Callable, model: str, version: str, dimension: int) -> DataFrame:
    """Vectors after an upsert: kept rows, newly embedded chunks; deleted and replaced rows are gone.

    ``actions`` is ``upkeep.vector_actions``; files it does not name keep their vectors.
    """
    kept = vectors.join(actions.where("action = 'keep'").select("file_id", "idx"), ["file_id", "idx"], "left_semi")
    other = vectors.join(actions.select("file_id").distinct(), "file_id", "left_anti")
    todo = chunks.join(actions.where("action = 'embed'").select("file_id", "idx"), ["file_id", "idx"], "left_semi").select("file_id", "idx", F.substring("text", 1, 2000).alias("text"), F.sha2("text", 256).alias("content_hash"), F.col("text").alias("_full"))
    new = embed_texts(todo, provider, model, version, dimension, "_full").drop("_full")
    one = W.partitionBy("file_id", "idx").orderBy(F.col("indexed_at").desc_nulls_last()) if "indexed_at" in vectors.columns else W.partitionBy("file_id", "idx").orderBy("content_hash")
    kept = kept.withColumn("_r", F.row_number().over(one)).where("_r = 1").drop("_r")
    return other.unionByName(kept).unionByName(new, allowMissingColumns=True)


def sync_mode(filter_: str, has_offset: bool) -> str:
    """``incremental`` for unfiltered runs with a stored offset, else ``full``."""
    return "incremental" if filter_ == "all" and has_offset else "full"


def may_prune(filter_: str, truncated: bool) -> bool:
    """Only a complete, unfiltered listing may prune the index and store a new offset."""
    return filter_ == "all" and not truncated
