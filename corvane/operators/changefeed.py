"""Applying a stream of inserts, updates and deletes (problem 7).

Every change becomes a *patch*: a function from the state of one id before to
its state after, with the added/updated/removed events it causes. Patches form
a monoid: ``compose`` is associative, so the ordered operations of one id may be
folded in any bracketing. They are: sequence numbers are cut into ranges, each
(id, range) is folded on its own, and range results are folded again, ``FAN_IN``
at a time, until one patch per id is left. An id that owns a third of the feed
is thereby folded by many tasks and no group exceeds ``WIDTH`` changes. Only
then are patches joined to the base tables, once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.catalog import FOLDER_COLORS, FOLDER_MIME, SHORTCUT_MIME, mime_category, parse_size

WIDTH, FAN_IN = 256, 32

#: What a patch does to the file row and the folder row of its id. ``*_first`` is the first
#: operation that touches the row (its event depends on the state before), ``*_last`` whether the
#: row exists afterwards, ``f_keeps`` that no deletion came between, ``f_same`` that every file
#: payload also had the revision ``f_rev`` (so a verified hash of the base stays valid).
PATCH = (
    "struct<first_seq:bigint,last_seq:bigint,last_kind:string,f_first:string,f_last:boolean,d_first:string,d_last:boolean,"
    "f_seq:bigint,d_seq:bigint,f_keeps:boolean,f_same:boolean,f_rev:string,added:bigint,updated:bigint,removed:bigint,n:bigint>"
)


def change_kind(removed: Column, file: Column) -> Column:
    """``R`` removal, ``S`` shortcut, ``D`` folder, ``F`` file; null for a row that changes nothing."""
    mime = file["mimeType"]
    return (
        F.when(F.coalesce(removed, F.lit(False)) | F.coalesce(file["trashed"], F.lit(False)), "R")
        .when(file.isNull(), F.lit(None).cast("string"))
        .when(mime == SHORTCUT_MIME, "S")
        .when(mime == FOLDER_MIME, "D")
        .otherwise("F")
    )


def _leaf(seq: Column, kind: Column, rev: Column) -> Column:
    """The patch of one change."""
    no, zero = F.lit(None), F.lit(0).cast("bigint")
    touches_f, touches_d = kind.isin("R", "S", "F"), kind.isin("R", "D")
    is_f, is_d = kind == "F", kind == "D"
    return F.struct(
        seq.alias("first_seq"), seq.alias("last_seq"), kind.alias("last_kind"),
        F.when(touches_f, kind).alias("f_first"), F.when(touches_f, is_f).alias("f_last"),
        F.when(touches_d, kind).alias("d_first"), F.when(touches_d, is_d).alias("d_last"),
        F.when(is_f, seq).alias("f_seq"), F.when(is_d, seq).alias("d_seq"),
        F.when(touches_f, is_f).alias("f_keeps"), F.when(touches_f, is_f & rev.isNotNull()).alias("f_same"),
        F.when(is_f, rev).otherwise(no.cast("string")).alias("f_rev"),
        zero.alias("added"), zero.alias("updated"), zero.alias("removed"), F.lit(1).cast("bigint").alias("n"),
    ).cast(PATCH)


def _event(first: Column, before: Column, want: str) -> Column:
    """1 if operation ``first`` on a row whose presence was ``before`` is an event of kind ``want``."""
    upsert = first.isin("F", "D")
    hit = {"added": upsert & ~before, "updated": upsert & before, "removed": (first == "R") & before}[want]
    return F.when(F.coalesce(hit, F.lit(False)), 1).otherwise(0).cast("bigint")


def compose(a: Column, b: Column) -> Column:
    """The patch that applies ``a`` and then ``b``; associative."""
    total = {k: a[k] + b[k] + _event(b["f_first"], a["f_last"], k) + _event(b["d_first"], a["d_last"], k) for k in ("added", "updated", "removed")}
    a_f, b_f = a["f_first"].isNotNull(), b["f_first"].isNotNull()
    same = a["f_same"] & b["f_same"] & (a["f_rev"] == b["f_rev"])
    both = lambda x, y, ab: F.when(a_f & b_f, ab).when(a_f, x).otherwise(y)
    return F.struct(
        a["first_seq"].alias("first_seq"), b["last_seq"].alias("last_seq"), b["last_kind"].alias("last_kind"),
        F.coalesce(a["f_first"], b["f_first"]).alias("f_first"), F.coalesce(b["f_last"], a["f_last"]).alias("f_last"),
        F.coalesce(a["d_first"], b["d_first"]).alias("d_first"), F.coalesce(b["d_last"], a["d_last"]).alias("d_last"),
        F.coalesce(b["f_seq"], a["f_seq"]).alias("f_seq"), F.coalesce(b["d_seq"], a["d_seq"]).alias("d_seq"),
        both(a["f_keeps"], b["f_keeps"], a["f_keeps"] & b["f_keeps"]).alias("f_keeps"),
        both(a["f_same"], b["f_same"], F.coalesce(same, F.lit(False))).alias("f_same"),
        both(a["f_rev"], b["f_rev"], b["f_rev"]).alias("f_rev"),
        total["added"].alias("added"), total["updated"].alias("updated"), total["removed"].alias("removed"),
        (a["n"] + b["n"]).alias("n"),
    ).cast(PATCH)


def _fold(grouped: DataFrame) -> DataFrame:
    """(file_id, at, patch) rows to one composed patch per (file_id, at)."""
    # Sequence ranges of one group don't overlap, so first_seq, the struct's first field, orders them.
    return grouped.groupBy("file_id", "at").agg(F.array_sort(F.collect_list("patch")).alias("ps")).select(
        "file_id", "at",
        F.aggregate(F.slice("ps", 2, 1 << 30), F.col("ps")[0], compose).alias("patch"),
    )


def compose_patches(changes: DataFrame) -> DataFrame:
    """One patch per id of the feed: ``file_id, patch``.

    Repeated deliveries of a (file_id, seq) count once, late rows fall into place by
    ``seq``, rows without payload that are not removals change nothing. Null flags
    are false. Rows whose ``file_id`` or ``seq`` is null cannot be attributed or
    ordered and are ignored. If deliveries of one seq differ, the latest
    ``received_at`` counts (then removal before payload).
    """
    f = F.col("file")
    ops = (
        changes.select("file_id", "seq", change_kind(F.col("removed"), f).alias("kind"), f["modifiedTime"].alias("rev"), "received_at")
        .where("kind is not null and file_id is not null and seq is not null")
        .groupBy("file_id", "seq")
        .agg(F.max(F.struct("received_at", "kind", "rev")).alias("o"))
    )
    low, high = ops.agg(F.min("seq"), F.max("seq")).first()
    low, span = (low or 0), ((high or 0) - (low or 0))
    at = F.floor((F.col("seq") - F.lit(low)) / F.lit(WIDTH)).cast("bigint")
    level = _fold(ops.select("file_id", at.alias("at"), _leaf(F.col("seq"), F.col("o.kind"), F.col("o.rev")).alias("patch")))
    ranges = span // WIDTH + 1
    while ranges > 1:
        ranges = -(-ranges // FAN_IN)
        level = _fold(level.withColumn("at", F.floor(F.col("at") / F.lit(FAN_IN)).cast("bigint")))
    return level.select("file_id", "patch")


@dataclass
class Applied:
    """Result of applying a feed: current tables, patches and per-id event counts."""

    files: DataFrame
    folders: DataFrame
    patches: DataFrame
    counters: DataFrame


def current_rows(files: DataFrame, key: str = "id", newest: str = "listed_at") -> DataFrame:
    """The row of every id with the greatest ``listed_at`` (null lowest; equal rows: any, by all-column hash)."""
    w = W.partitionBy(key).orderBy(F.col(newest).desc_nulls_last(), F.xxhash64(*[F.col(f"`{c}`") for c in files.columns]))
    return files.where(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def apply_changes(files: DataFrame, folders: DataFrame, changes: DataFrame) -> Applied:
    """Apply a change feed to the current file and folder rows.

    Drive files and folders named by the feed are replaced, added or dropped; files
    that are not drive items and extra columns pass through (null for new rows). An
    updated file carries ``is_offline`` unless it was deleted in between, and keeps a
    verified hash while its revision is unchanged. Payload fields default as the
    listing mapper does; a missing time becomes ``received_at``.
    """
    patches = compose_patches(changes)
    p = F.col("patch")
    base_f = current_rows(files)
    drive, local = base_f.where(F.coalesce("is_drive_item", F.lit(False))), base_f.where(~F.coalesce("is_drive_item", F.lit(False)))
    base_d = folders.where("id is not null").dropDuplicates(["id"])

    pay = changes.where("file_id is not null and seq is not null and file is not null").groupBy("file_id", "seq").agg(
        F.max_by(F.struct("file", "received_at"), F.struct("received_at", change_kind(F.col("removed"), F.col("file")))).alias("v"))
    hit = patches.select("file_id", "patch")
    at_f = hit.where(p["f_last"]).select("file_id", p["f_seq"].alias("seq"), "patch")
    at_d = hit.where(p["d_last"]).select("file_id", p["d_seq"].alias("seq"), "patch")
    new_f = at_f.join(pay, ["file_id", "seq"]).select("file_id", "patch", "v.file", "v.received_at")
    new_d = at_d.join(pay, ["file_id", "seq"]).select("file_id", "patch", "v.file", "v.received_at")

    f = F.col("file")
    stamp = F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    old = drive.select(F.col("id").alias("_oid"), *[F.col(c).alias(f"_o_{c}") for c in drive.columns if c != "id"])
    j = new_f.join(old, F.col("file_id") == F.col("_oid"), "left").withColumn("_rev", F.coalesce(f["modifiedTime"], stamp))
    carried = F.col("_oid").isNotNull() & p["f_keeps"]
    verified = carried & p["f_same"] & F.col("_o_content_hash").startswith("sha256:") & (F.col("_o_content_hash_modified_time") == F.col("_o_modified_time")) & (F.col("_o_modified_time") == F.col("_rev"))
    parent = F.get(f["parents"], F.lit(0))
    category = mime_category(f["mimeType"], f["name"])
    mapped = {
        "id": F.col("file_id"), "name": f["name"], "mime_type": F.coalesce(f["mimeType"], F.lit("application/octet-stream")),
        "size": parse_size(f["size"]), "modified_time": F.col("_rev"), "created_time": F.coalesce(f["createdTime"], stamp),
        "category": category, "folder_id": parent, "parent_ids": F.coalesce(f["parents"], F.array().cast("array<string>")),
        "is_drive_item": F.lit(True), "is_offline": F.coalesce(F.when(carried, F.col("_o_is_offline")), F.lit(False)), "is_encrypted": F.lit(False),
        "content_hash": F.when(F.coalesce(verified, F.lit(False)), F.col("_o_content_hash")).otherwise(F.concat(F.lit("gdrive-"), F.col("file_id"), F.lit("-"), F.when(F.coalesce(f["size"], F.lit("")) == "", "0").otherwise(f["size"]))),
        "content_hash_modified_time": F.when(F.coalesce(verified, F.lit(False)), F.col("_o_content_hash_modified_time")),
        "tags": F.array(F.lit("google-drive"), category, F.when(parent.isNotNull(), "categorized").otherwise("root")),
        "semantic_summary": F.when(F.coalesce(f["description"], F.lit("")) != "", f["description"]).otherwise(F.concat(F.lit('Google Drive file "'), F.coalesce(f["name"], F.lit("")), F.lit('" of type '), F.coalesce(f["mimeType"], F.lit("")))),
        "starred": F.coalesce(f["starred"], F.lit(False)), "listed_at": F.col("received_at"),
    }
    types = dict(base_f.dtypes)
    upserted = j.select(*[(mapped[c].cast(types[c]) if c in mapped else F.when(carried, F.col(f"_o_{c}"))).alias(c) for c in base_f.columns])
    touched_f = hit.where(p["f_first"].isNotNull()).select(F.col("file_id").alias("id"))
    out_f = drive.join(touched_f, "id", "left_anti").unionByName(upserted).unionByName(local)

    color = F.element_at(F.array(*[F.lit(c) for c in FOLDER_COLORS]), (F.pmod(F.xxhash64("file_id"), F.lit(len(FOLDER_COLORS))) + 1).cast("int"))
    d_map = {
        "id": F.col("file_id"), "name": f["name"], "color": color,
        "description": F.when(F.coalesce(f["description"], F.lit("")) != "", f["description"]).otherwise(F.concat(F.lit("Google Drive folder with "), F.coalesce(f["name"], F.lit("")))),
        "created_at": f["createdTime"], "parent_ids": F.coalesce(f["parents"], F.array().cast("array<string>")),
    }
    d_types = dict(base_d.dtypes)
    up_d = new_d.select(*[d_map.get(c, F.lit(None)).cast(d_types[c]).alias(c) for c in base_d.columns])
    touched_d = hit.where(p["d_first"].isNotNull()).select(F.col("file_id").alias("id"))
    out_d = base_d.join(touched_d, "id", "left_anti").unionByName(up_d)

    have_f = drive.select(F.col("id").alias("file_id"), F.lit(True).alias("in_f"))
    have_d = base_d.select(F.col("id").alias("file_id"), F.lit(True).alias("in_d"))
    seen = hit.join(have_f, "file_id", "left").join(have_d, "file_id", "left")
    was_f, was_d = F.coalesce("in_f", F.lit(False)), F.coalesce("in_d", F.lit(False))
    counters = seen.select("file_id", *[(p[k] + _event(p["f_first"], was_f, k) + _event(p["d_first"], was_d, k)).alias(k) for k in ("added", "updated", "removed")])
    return Applied(out_f, out_d, patches, counters)


def live_changes(changes: DataFrame) -> DataFrame:
    """``file_id, seq`` of ids whose last effective change leaves a file or folder behind."""
    p = F.col("patch")
    return compose_patches(changes).where(p["last_kind"].isin("F", "D")).select("file_id", p["last_seq"].alias("seq"))
