"""Column expressions on catalogue records: categories, sizes, instants, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mime types of folders and shortcuts, and the folder colours in rotation.
FOLDER_MIME = "application/vnd.google-apps.folder"
SHORTCUT_MIME = "application/vnd.google-apps.shortcut"
FOLDER_COLORS = ["blue", "emerald", "purple", "amber", "rose", "indigo", "cyan", "zinc"]


def instant(col: Column | str) -> Column:
    """ISO-8601 text (milliseconds, whole seconds or an offset) to a timestamp; null if it does not parse."""
    return F.try_to_timestamp(F.col(col) if isinstance(col, str) else col)


def millis(col: Column | str) -> Column:
    """ISO-8601 text to epoch milliseconds."""
    return F.unix_millis(instant(col))


def parse_size(col: Column) -> Column:
    """Leading integer of a decimal string, as ``parseInt`` reads it; 0 when there is none."""
    return F.coalesce(F.regexp_extract(col, r"^\s*([+-]?\d{1,18})", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def mime_category(mime: Column, name: Column) -> Column:
    """Ordered first-match rules from mime type and name to one of eight categories.

    Null mime or name count as empty. The order is part of the contract: Office
    spreadsheets match the document rule first, because their mime types contain
    ``document``.
    """
    m, n = F.coalesce(mime, F.lit("")), F.coalesce(name, F.lit(""))
    has = lambda *words: m.rlike("|".join(words))
    # The substrings and endings of each rule.
    return (
        F.when(m.startswith("image/"), "image")
        .when(m.startswith("audio/"), "audio")
        .when(m.startswith("video/"), "video")
        .when(has("pdf", "document", "text/plain"), "document")
        .when(has("sheet", "csv") | n.endswith(".xlsx"), "spreadsheet")
        .when(has("zip", "tar", "gzip"), "archive")
        .when(has("javascript", "typescript") | n.endswith(".ts") | n.endswith(".tsx") | n.endswith(".json"), "code")
        .otherwise("other")
    )


def corpus_key(corpus: Column, shared_drive_id: Column) -> Column:
    """``drive:<id>``, ``allDrives`` or ``user``."""
    return F.when((corpus == "drive") & (F.coalesce(shared_drive_id, F.lit("")) != ""), F.concat(F.lit("drive:"), shared_drive_id)).when(corpus == "allDrives", F.lit("allDrives")).otherwise("user")
