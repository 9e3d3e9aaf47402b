"""Catalogue sources: paged listings, change feeds, local directories, text and binary files."""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corvane.functions.catalog import FOLDER_COLORS, FOLDER_MIME, mime_category, parse_size
from corvane.functions.text import MAX_TEXT
from corvane.session import restage, stage

SAMPLE = 64 * 1024
ITEM = "id string, name string, mimeType string, size string, modifiedTime string, createdTime string, parents array<string>, trashed boolean, description string, starred boolean"


class _Chain(InputPartition):
    def __init__(self, folder: str):
        self.folder = folder


class PagedListing(DataSource):
    """``spark.read.format("paged_listing").load(path)``: page files that name their successor.

    Every sub-folder of ``path`` is one token chain and one partition; ``page.json`` is
    its first page, and ``nextPageToken`` T continues in ``page-T.json``. Option
    ``maxPages`` (default 10 000) ends a chain early; its rows then have
    ``truncated`` true.
    """

    @classmethod
    def name(cls):
        return "paged_listing"

    def schema(self):
        return ITEM + ", chain string, truncated boolean"

    def reader(self, schema):
        return _ListingReader(self.options)


class _ListingReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.most = options["path"], int(options.get("maxPages", 10_000))

    def partitions(self):
        return [_Chain(f) for f in sorted(glob.glob(os.path.join(self.path, "*"))) if os.path.isdir(f)]

    def read(self, partition):
        rows, token, pages = [], "", 0
        while pages < self.most:
            with open(os.path.join(partition.folder, f"page-{token}.json" if token else "page.json")) as fh:
                page = json.load(fh)
            rows += page.get("files", [])
            pages, token = pages + 1, page.get("nextPageToken")
            if not token:
                break
        for r in rows:
            yield (r.get("id"), r.get("name"), r.get("mimeType"), r.get("size"), r.get("modifiedTime"), r.get("createdTime"), r.get("parents"), r.get("trashed"),
                   r.get("description"), r.get("starred"), os.path.basename(partition.folder), bool(token))


def map_items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, folders) of raw listing items, with defaults, derived category, synthetic hash, tags and summary.

    Folder colours rotate by a hash of the id, so they do not depend on page order.
    """
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    parent = F.get("parents", F.lit(0))
    cat = mime_category(F.col("mimeType"), F.col("name"))
    folder = F.coalesce(F.col("mimeType") == FOLDER_MIME, F.lit(False))
    text = lambda c, alt: F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(alt)
    files = items.where(~folder).select(
        "id", "name", text(F.col("mimeType"), F.lit("application/octet-stream")).alias("mime_type"), parse_size(F.col("size")).alias("size"),
        text(F.col("modifiedTime"), stamp).alias("modified_time"), text(F.col("createdTime"), stamp).alias("created_time"), cat.alias("category"), parent.alias("folder_id"),
        F.coalesce("parents", F.array().cast("array<string>")).alias("parent_ids"), F.lit(True).alias("is_drive_item"), F.lit(False).alias("is_offline"), F.lit(False).alias("is_encrypted"),
        F.concat(F.lit("gdrive-"), "id", F.lit("-"), text(F.col("size"), F.lit("0"))).alias("content_hash"),
        F.array(F.lit("google-drive"), cat, F.when(parent.isNotNull(), "categorized").otherwise("root")).alias("tags"),
        text(F.col("description"), F.concat(F.lit('Google Drive file "'), "name", F.lit('" of type '), F.coalesce("mimeType", F.lit("")))).alias("semantic_summary"), F.coalesce("starred", F.lit(False)).alias("starred"))
    color = F.element_at(F.array(*[F.lit(c) for c in FOLDER_COLORS]), (F.pmod(F.xxhash64("id"), F.lit(len(FOLDER_COLORS))) + 1).cast("int"))
    folders = items.where(folder).select("id", "name", color.alias("color"), text(F.col("description"), F.concat(F.lit("Google Drive folder with "), "name")).alias("description"), F.col("createdTime").alias("created_at"), F.coalesce("parents", F.array().cast("array<string>")).alias("parent_ids"))
    return files, folders


def read_changes(spark: SparkSession, path: str, complete: bool = True) -> DataFrame:
    """A drained change feed (Parquet); raises if the drain did not reach the end of the feed."""
    if not complete:
        raise RuntimeError("the change feed ended before its last page")
    return spark.read.parquet(path)


def start_offset(spark: SparkSession, path: str) -> int:
    """Where a change feed stands now: its greatest ``seq`` (0 if empty). Taken before a full listing, so nothing is missed between."""
    return spark.read.parquet(path).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]


def drain_pages(fetch: Callable[[str], tuple[DataFrame, str | None, str | None]], token: str, max_pages: int = 500) -> tuple[DataFrame, str]:
    """(changes, new start offset): follow change pages from ``token`` to the terminal one.

    ``fetch`` gives (rows, next token, new start offset); the last page alone has an
    offset. More than ``max_pages`` pages, or an end without offset, raise, and nothing
    of the drain counts. Pages are written once and read as one table.
    """
    pages: list[DataFrame] = []
    for _ in range(max_pages):
        rows, following, offset = fetch(token)
        pages.append(stage(rows))
        if offset:
            return restage(pages), offset
        if not following:
            raise RuntimeError("the change feed ended without a start offset")
        token = following
    raise RuntimeError(f"no end of the change feed within {max_pages} pages")


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """``path, name, size, modified, content`` of a directory tree, without dotted and review entries."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rel = F.substring_index("path", "/", -1)
    return raw.where(~F.col("path").rlike(r"/\.[^/]*") & ~F.col("path").contains("/Duplicates-Review/")).select("path", rel.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def fast_fingerprint(content, size):
    """``size:sha256`` of the first and last 64 KiB (the first twice if there is no more)."""
    head = F.substring(content, 1, SAMPLE)
    tail = F.when(size > SAMPLE, F.substring(content, (size - SAMPLE + 1).cast("int"), F.lit(SAMPLE))).otherwise(head)
    return F.concat(size.cast("string"), F.lit(":"), F.sha2(F.concat(head, tail), 256))


def duplicate_files(files: DataFrame) -> DataFrame:
    """``path, size, hash, movable`` of local files that are byte-equal to another.

    Equal fingerprints are candidates, equal full hashes duplicates; of each group the
    smallest path stays.
    """
    fp = files.withColumn("fp", fast_fingerprint(F.col("content"), F.col("size"))).select("path", "size", "fp", F.sha2("content", 256).alias("hash"))
    many = fp.groupBy("fp").agg(F.count("*").alias("c")).where("c > 1").select("fp")
    cand = fp.join(many, "fp")
    groups = cand.groupBy("hash").agg(F.count("*").alias("c"), F.min("path").alias("first")).where("c > 1")
    return cand.join(groups, "hash").select("path", "size", "hash", (F.col("path") != F.col("first")).alias("movable"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text, truncated``: whole text files, cut at 500 000 characters."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return t.select("path", F.substring("value", 1, MAX_TEXT).alias("text"), (F.length("value") > MAX_TEXT).alias("truncated"))
