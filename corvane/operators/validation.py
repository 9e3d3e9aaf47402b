"""Predicates and constraint checks on records, requests and backups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.catalog import FOLDER_MIME, SHORTCUT_MIME

# Mime types and endings by kind.
TEXT_MIMES = ["text/plain", "text/csv", "text/markdown", "text/html", "application/json", "application/xml", "text/xml"]
NATIVE_MIMES = ["application/vnd.google-apps.document", "application/vnd.google-apps.spreadsheet", "application/vnd.google-apps.presentation"]
BINARY_MIMES = [
    "application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/vnd.ms-word.document.macroEnabled.12",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "application/vnd.ms-powerpoint.presentation.macroEnabled.12",
]
IMAGE_MIMES = ["image/png", "image/jpeg", "image/webp", "image/bmp", "image/gif", "image/tiff"]
IMAGE_ENDING = r"(?i)\.(png|jpe?g|webp|bmp|gif|tiff?)\z"
LISTED = {
    "documents": ["application/pdf", "application/msword", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/vnd.google-apps.document", "text/plain", "application/rtf"],
    "pdfs": ["application/pdf"],
    "spreadsheets": ["application/vnd.ms-excel", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.google-apps.spreadsheet", "text/csv"],
    "folders": [FOLDER_MIME],
}
EXPORTS = {  # native type -> (mime type, ending) of its export
    "application/vnd.google-apps.document": ("application/pdf", "pdf"),
    "application/vnd.google-apps.spreadsheet": ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xlsx"),
    "application/vnd.google-apps.presentation": ("application/pdf", "pdf"),
    "application/vnd.google-apps.drawing": ("image/png", "png"),
}


def _s(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def can_extract(mime: str = "mime_type", name: str = "name") -> Column:
    """True for files whose text can be read."""
    m, n = _s(mime), _s(name)
    return (
        m.startswith("text/") | m.isin(*TEXT_MIMES, *NATIVE_MIMES, *BINARY_MIMES, *IMAGE_MIMES)
        | n.rlike(r"(?i)\.(txt|md|csv|json|xml|html|log)\z") | n.rlike(r"(?i)\.(pdf|docx|docm|xlsx|xlsm|pptx|pptm)\z") | n.rlike(IMAGE_ENDING)
    )


def matches_category(filter_: str) -> Column:
    """Fine category filter over category, mime type and ending of a file row."""
    cat, mime, name = _s("category"), F.lower(_s("mime_type")), F.lower(_s("name"))
    image = (cat == "image") | mime.startswith("image/") | name.rlike(IMAGE_ENDING)
    if filter_ in ("", "all"):
        return F.lit(True)
    if filter_ == "google_drive":
        return F.coalesce(F.col("is_drive_item"), F.lit(False))
    pdf = (mime == "application/pdf") | name.endswith(".pdf")
    if filter_ == "document":
        word = mime.contains("wordprocessingml") | mime.isin("application/msword", "application/vnd.google-apps.document")
        return ~image & ((cat == "document") | word | pdf | mime.startswith("text/") | name.rlike(r"\.(txt|md|rtf|docx?)\z") | ((cat == "other") & can_extract()))
    if filter_ == "spreadsheet":
        return (cat == "spreadsheet") | (mime == "application/vnd.google-apps.spreadsheet") | mime.contains("spreadsheetml") | name.rlike(r"\.(xlsx?|csv)\z")
    if filter_ == "presentation":
        return (mime == "application/vnd.google-apps.presentation") | mime.contains("presentationml") | name.rlike(r"\.(pptx?|odp)\z")
    if filter_ == "pdf":
        return pdf
    if filter_ == "image":
        return image
    return cat == filter_


def listing_filter(kind: str = "all", mime: str = "mime_type", trashed: Column | None = None) -> Column:
    """Predicate of a remote listing by type; never trashed items or shortcuts. Reaches the Parquet scan."""
    m = F.col(mime)
    base = (m != SHORTCUT_MIME) & ~(F.coalesce(trashed, F.lit(False)) if trashed is not None else F.lit(False))
    if kind == "images":
        return base & (m.contains("image/") | (m == "application/vnd.google-apps.photo"))
    if kind == "videos":
        return base & (m.contains("video/") | (m == "application/vnd.google-apps.video"))
    return base & m.isin(LISTED[kind]) if kind in LISTED else base


def local_category(mime: Column, name: Column) -> Column:
    """Category of a local file; its rule order differs from the catalogue's."""
    m, n = F.coalesce(mime, F.lit("")), F.coalesce(name, F.lit(""))
    return (
        F.when(m.startswith("image/"), "image").when(m.startswith("video/"), "video").when(m.startswith("audio/"), "audio")
        .when(m.contains("sheet") | n.rlike(r"(?i)\.(csv|xls|xlsx)\z"), "spreadsheet")
        .when(m.contains("pdf") | n.rlike(r"(?i)\.(pdf|doc|docx|txt|rtf)\z"), "document")
        .when(n.rlike(r"(?i)\.(zip|rar|7z)\z"), "archive").otherwise("other")
    )


def extraction_route(mime: str = "mime_type", name: str = "name") -> Column:
    """How a file's text is read: export, pdf, docx, xlsx, pptx, image, text or none."""
    m, n = _s(mime), F.lower(_s(name))
    return (
        F.when(m.isin(NATIVE_MIMES), "export").when((m == "application/pdf") | n.endswith(".pdf"), "pdf")
        .when(m.isin(BINARY_MIMES[1], BINARY_MIMES[2]) | n.rlike(r"\.doc[xm]\z"), "docx").when((m == BINARY_MIMES[3]) | n.rlike(r"\.xls[xm]\z"), "xlsx")
        .when(m.isin(BINARY_MIMES[4], BINARY_MIMES[5]) | n.rlike(r"\.ppt[xm]\z"), "pptx").when(m.isin(IMAGE_MIMES) | n.rlike(IMAGE_ENDING), "image")
        .when(can_extract(mime, name), "text").otherwise("none")
    )


def export_hint(mime: Column) -> Column:
    """struct(mime, ending) of a native file's export; null for others."""
    out = F.lit(None).cast("struct<mime:string,ending:string>")
    for native, (to, ending) in EXPORTS.items():
        out = F.when(mime == native, F.struct(F.lit(to).alias("mime"), F.lit(ending).alias("ending"))).otherwise(out)
    return out


def is_legacy_chunk(c: Column) -> Column:
    """True for chunk texts of the old titled profile."""
    return F.coalesce(c.rlike(r"^title: .* \| text: "), F.lit(False))


def token_expired(token: Column, expires_at: Column, now_ms: Column) -> Column:
    """Missing tokens and expiries count as expired; 60 s safety margin."""
    return F.coalesce(token, F.lit("")).eqNullSafe("") | expires_at.isNull() | F.isnan(expires_at.cast("double")) | (expires_at <= 0) | (now_ms >= expires_at - 60_000)


def is_rate_limited(status: Column, body: Column) -> Column:
    """429, or 403 whose error body names a rate-limit reason; broken bodies do not count."""
    kind = "struct<error:struct<errors:array<struct<reason:string>>>>"
    reasons = F.transform(F.from_json(body, kind)["error"]["errors"], lambda e: F.lower(F.coalesce(e["reason"], F.lit(""))))
    named = F.exists(reasons, lambda r: r.isin("ratelimitexceeded", "userratelimitexceeded", "sharingratelimitexceeded"))
    return (status == 429) | ((status == 403) & F.coalesce(named, F.lit(False)))


def embed_request_error(texts: Column, mode: Column, version: Column, max_texts: int = 32, max_chars: int = 8000) -> Column:
    """First error of an embedding request, null if it is valid."""
    trimmed = F.transform(texts, lambda t: F.trim(t))
    # errors are reported for the first text that has one
    per_text = F.transform(trimmed, lambda t: F.when(t.isNull(), "each text must be a string").when(t == "", "empty text not allowed").when(F.length(t) > max_chars, "text too long"))
    first = F.get(F.filter(per_text, lambda e: e.isNotNull()), F.lit(0))
    return (
        F.when(texts.isNull() | (F.size(texts) == 0), "texts required").when(F.size(texts) > max_texts, "batch too large").when(first.isNotNull(), first)
        .when(~F.coalesce(mode, F.lit("")).isin("", "query", "document"), "invalid mode").when(~F.coalesce(version, F.lit("2")).isin("2", "3"), "unsupported contract version")
    )


def backup_violations(docs: DataFrame, vectors: DataFrame, max_docs: int = 50_000, max_vectors: int = 100_000) -> DataFrame:
    """``rule, violations`` of a backup's documents and vectors; every rule has a row, all zero if it may be restored.

    One aggregation per table; uniqueness and references are checked by grouped
    counts and an anti-join.
    """
    spark = docs.sparkSession
    bad = lambda c: F.count_if(F.coalesce(c, F.lit(True)))
    d = docs.agg(
        bad(F.col("id").isNull() | (F.col("id") == "")).alias("document id missing"), bad(F.length("text") > 500_000).alias("document text too long"),
        bad(~F.col("source").isin("export", "binary-text", "offline-blob")).alias("document source unknown"), bad(F.col("char_count") != F.length("text")).alias("document char_count wrong"),
        F.greatest(F.lit(0), F.count("*") - max_docs).alias("too many documents"))
    key = F.concat(F.coalesce("corpus_key", F.lit("user")), F.lit("::"), "file_id", F.lit("#"), F.col("idx").cast("string"))
    v = vectors.agg(
        bad(F.col("id") != key).alias("vector key wrong"), bad(F.length("text") > 2000).alias("vector text too long"), bad(F.size("embedding") != F.col("dimension")).alias("vector length wrong"),
        F.count_if(~F.forall(F.coalesce("embedding", F.array().cast("array<double>")), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).alias("vector not finite"),
        F.greatest(F.lit(0), F.count("*") - max_vectors).alias("too many vectors"))
    twice = lambda t, name: t.groupBy("id").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias(name))
    owner = docs.select(F.col("id").alias("file_id"), F.coalesce("corpus_key", F.lit("user")).alias("corpus")).distinct()
    lost = vectors.select("file_id", F.coalesce("corpus_key", F.lit("user")).alias("corpus")).join(owner, ["file_id", "corpus"], "left_anti").agg(F.count("*").alias("vector without document"))
    out = None
    for one in (d, v, twice(docs, "document id repeated"), twice(vectors, "vector id repeated"), lost):
        long = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").cast("bigint").alias("violations")) for c in one.columns])).alias("s")).select("s.rule", "s.violations")
        out = long if out is None else out.unionByName(long)
    return out


def backup_bytes(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``bytes``: upper estimate of a backup's uncompressed size."""
    d = docs.agg(F.coalesce(F.sum(F.length(_s("text")) * 4 + F.length(_s("name")) * 8 + 2048), F.lit(0)).alias("a"))
    v = vectors.agg(F.coalesce(F.sum(F.greatest(F.lit(0), F.size(F.coalesce("embedding", F.array().cast("array<double>")))) * 16 + F.length(_s("text")) * 4 + 2048), F.lit(0)).alias("b"))
    return d.crossJoin(v).select((F.col("a") + F.col("b")).cast("bigint").alias("bytes"))  # one row each


def legacy_profiles(vectors: DataFrame, live: DataFrame) -> DataFrame:
    """``file_id`` of live files that still have a vector whose text includes the file name."""
    old = vectors.where(is_legacy_chunk(F.col("text"))).select("file_id").distinct()
    return old.join(live.select(F.col("id").alias("file_id")).distinct(), "file_id", "left_semi")


def scan_gate(vectors: DataFrame, live: DataFrame) -> int:
    """Raises if a duplicate scan must not run since live files have legacy profiles; else their number, 0."""
    n = legacy_profiles(vectors, live).count()
    if n:
        raise RuntimeError(f"{n} live profiles still include file names in their vectors; rebuild the index first")
    return n


def can_suggest(selected: Column, folders: Column, loading: Column) -> Column:
    """True if folder suggestions may be asked for; null flags are false."""
    on = lambda c: F.coalesce(c, F.lit(False))
    return on(selected) & on(folders) & ~on(loading)


def consent_granted(state: Column, policy: Column, current: str) -> Column:
    """True if embedding was agreed to under the current policy."""
    return F.coalesce((state == "granted") & (policy == current), F.lit(False))


def device_filter(name: Column, path: Column, text: str, source: Column | None = None, wanted: str = "all") -> Column:
    """Files of a device list by source and by a substring of name and path."""
    hit = F.lower(F.concat_ws(" ", name, path)).contains(text.strip().lower())
    return hit if source is None or wanted == "all" else hit & F.coalesce(source == wanted, F.lit(False))
