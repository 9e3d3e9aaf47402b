"""Exact-duplicate groups and the file to keep.

Grouping key: a verified content hash, else any other real hash, else size and
lower-cased name; files with neither stay alone. Group facts (largest size,
earliest creation) are pre-aggregated and joined back, so a group that holds a
third of all files is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.catalog import millis
from corvane.session import sorted_rank

# Fixed value: file names that look like copies (tested on the lower-cased whole name; ASCII word ends).
COPY_NAME = r"(?<![a-z0-9_])(?:copy|duplicate|dup)(?![a-z0-9_])|\(copy(?: [0-9]+)?\)|\([0-9]+\)\z"


def duplicate_key() -> Column:
    """The exact-duplicate key of a file row; null for files that match nothing else."""
    h = F.coalesce(F.col("content_hash"), F.lit(""))
    verified = (F.coalesce("content_hash_modified_time", F.lit("")) != "") & (F.col("content_hash_modified_time") == F.coalesce("modified_time", F.lit("")))
    weak = (h == "") | h.startswith("gdrive-") | h.startswith("user-") | (h.startswith("sha256:") & ~F.coalesce(verified, F.lit(False)))
    by_name = F.when(F.col("size") > 0, F.concat(F.lit("size:"), F.col("size").cast("string"), F.lit("|name:"), F.lower(F.coalesce("name", F.lit("")))))
    return F.when(weak, by_name).otherwise(h)


def keep_score(max_size: Column, first_created: Column) -> Column:
    """Preservation score of a file among its peers, from group facts."""
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    size = F.coalesce(F.col("size"), F.lit(0)).cast("double")
    created = millis("created_time")
    score = size / F.greatest(F.lit(1), max_size).cast("double") * F.lit(12.0)
    score += F.when(on("starred"), 40.0).otherwise(0.0)
    score += F.when(on("is_offline"), 15.0).otherwise(0.0)
    score += F.when((F.coalesce("folder_id", F.lit("")) != "") & (F.col("folder_id") != "root"), 8.0).otherwise(0.0)
    score += F.when(F.length(F.coalesce("semantic_summary", F.lit(""))) >= 80, 4.0).otherwise(0.0)
    score += F.when(F.lower(F.coalesce("name", F.lit(""))).rlike(COPY_NAME), -25.0).otherwise(0.0)
    years = (created - first_created).cast("double") / F.lit(86400000.0) / F.lit(365.0)
    return score + F.when(created.isNotNull(), F.greatest(F.lit(0.0), F.lit(8.0) - F.least(F.lit(8.0), years))).otherwise(0.0)


def keep_reasons() -> Column:
    """Why a file scores, as an array of labels in fixed order."""
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    labels = F.filter(F.array(
        F.when(on("starred"), "starred"), F.when(on("is_offline"), "available offline"),
        F.when((F.coalesce("folder_id", F.lit("")) != "") & (F.col("folder_id") != "root"), "organized in a folder"),
        F.when(F.length(F.coalesce("semantic_summary", F.lit(""))) >= 80, "richer metadata"),
        F.when(F.lower(F.coalesce("name", F.lit(""))).rlike(COPY_NAME), "copy/duplicate naming penalty"),
    ), lambda x: x.isNotNull())
    return F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit("highest combined preservation score")))


def keep_order(score: str = "score") -> Column:
    """Smallest first: score down, creation, modification, name, id (missing instants last)."""
    far = F.lit(1 << 62)
    return F.struct(
        (-F.col(score)).alias("s"), F.coalesce(millis("created_time"), far).alias("c"), F.coalesce(millis("modified_time"), far).alias("m"),
        F.collate(F.coalesce("name", F.lit("")), "UNICODE").alias("n"), F.collate("id", "UNICODE").alias("i"), F.col("id").alias("z"),
    )


def scored_files(files: DataFrame) -> DataFrame:
    """Files that share their key with another, with ``dup_key, group_size, score``."""
    keyed = files.withColumn("dup_key", duplicate_key()).where("dup_key is not null and id is not null")
    facts = keyed.groupBy("dup_key").agg(
        F.count("*").alias("group_size"), F.max(F.coalesce("size", F.lit(0))).alias("_max"), F.min(millis("created_time")).alias("_first"),
        F.sum(F.coalesce("size", F.lit(0))).alias("total_size"),
    ).where("group_size > 1")
    return keyed.join(facts, "dup_key").withColumn("score", keep_score(F.col("_max"), F.col("_first"))).drop("_max", "_first")


def duplicate_groups(files: DataFrame) -> DataFrame:
    """One row per group: ``dup_key, verification, file_count, total_size, reclaimable_size, keep_id, keep_score``.

    ``reclaimable_size`` is the total less the size of the smallest-id member (members
    of one key nearly always have one size). For their order see ``ordered_groups``.
    """
    return scored_files(files).groupBy("dup_key").agg(
        F.when(F.first("dup_key").startswith("sha256:"), "sha256").otherwise("candidate").alias("verification"),
        F.count("*").alias("file_count"), F.max("total_size").alias("total_size"),
        (F.max("total_size") - F.min_by(F.coalesce("size", F.lit(0)), F.col("id"))).alias("reclaimable_size"),
        F.min_by("id", keep_order()).alias("keep_id"), F.max("score").alias("keep_score"),
    )


def ordered_groups(files: DataFrame) -> DataFrame:
    """``duplicate_groups``, verified groups first, then the most reclaimable, then by key."""
    return duplicate_groups(files).orderBy(F.when(F.col("verification") == "sha256", 0).otherwise(1), F.desc("reclaimable_size"), "dup_key")


def group_members(files: DataFrame) -> DataFrame:
    """``dup_key, position, id``: the kept file first (position 0), the others by modification (missing instants last), then id.

    One row per member and ranks by sorted ranges: a group that holds a third of all files is not gathered anywhere.
    """
    scored = scored_files(files)
    kept = scored.groupBy("dup_key").agg(F.min_by("id", keep_order()).alias("id")).withColumn("kept", F.lit(0))
    rows = scored.select("dup_key", "id", F.coalesce(millis("modified_time"), F.lit(1 << 62)).alias("m")).join(kept, ["dup_key", "id"], "left").withColumn("kept", F.coalesce("kept", F.lit(1)))
    rows = rows.withColumn("m", F.when(F.col("kept") == 0, F.lit(0)).otherwise(F.col("m")))
    return sorted_rank(rows, ["dup_key"], [F.col("kept"), F.col("m"), F.col("id")], "position").select("dup_key", "position", "id")
