"""Registered queries of the general training-data operators (problems 3 and 7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import changefeed, hierarchy
from corvane.session import table


def p3_found(spark, d):
    return hierarchy.cycles(table(spark, d, "folders"))


def p3_hierarchy(spark, d):
    return hierarchy.resolve_hierarchy(table(spark, d, "folders")).select(
        F.col("id").alias("folder_id"), "parent_id", "root_id", "depth", F.array_join("path_ids", "/").alias("path_ids"), "path", "cycle_id")


def p3_descendants(spark, d):
    r = hierarchy.resolve_hierarchy(table(spark, d, "folders"))
    return hierarchy.descendants(r).groupBy("ancestor_id").agg(F.count("*").alias("descendants"), F.max("distance").alias("height"))


def p3_pairs(spark, d):
    """Every folder above every other, in rows, with the trees below loops."""
    return hierarchy.all_descendants(table(spark, d, "folders"))


def p7_found(spark, d):
    return changefeed.live_changes(table(spark, d, "drive_changes"))


def p7_files(spark, d):
    a = changefeed.apply_changes(table(spark, d, "files"), table(spark, d, "folders"), table(spark, d, "drive_changes"))
    return a.files.select("id", "name", "mime_type", "size", "modified_time", "folder_id", "is_drive_item", "is_offline", "starred")


def p7_folders(spark, d):
    a = changefeed.apply_changes(table(spark, d, "files"), table(spark, d, "folders"), table(spark, d, "drive_changes"))
    return a.folders.select("id", "name", F.array_join("parent_ids", ",").alias("parent_ids"))


def p7_counters(spark, d):
    a = changefeed.apply_changes(table(spark, d, "files"), table(spark, d, "folders"), table(spark, d, "drive_changes"))
    return a.counters.agg(*[F.sum(k).alias(k) for k in ("added", "updated", "removed")])


_LINKS = r"""
WITH RECURSIVE one AS (
  SELECT id, min(CASE WHEN regexp_matches(parent_ids[1], '\S') THEN parent_ids[1] END) AS parent, min(name) AS name
  FROM folders WHERE id IS NOT NULL GROUP BY id),
links AS (SELECT o.id, p.id AS parent, o.name FROM one o LEFT JOIN one p ON o.parent = p.id),
up AS (
  SELECT id AS node, id AS cur, [id] AS seen FROM links
  UNION ALL
  SELECT u.node, l.parent, list_append(u.seen, l.parent) FROM up u JOIN links l ON l.id = u.cur
  WHERE l.parent IS NOT NULL AND NOT list_contains(u.seen, l.parent)),
last AS (SELECT node, arg_max(cur, len(seen)) AS cur, arg_max(seen, len(seen)) AS seen FROM up GROUP BY node),
fin AS (
  SELECT last.node, last.seen, l.parent AS back FROM last JOIN links l ON l.id = last.cur),
cyc AS (SELECT node, list_min(seen[list_position(seen, back):]) AS cycle_id FROM fin WHERE back IS NOT NULL)
"""

_LAST = """
WITH k AS (
  SELECT file_id, seq, file, received_at,
    CASE WHEN coalesce(removed, false) OR coalesce(file.trashed, false) THEN 'R'
         WHEN file IS NULL THEN NULL
         WHEN file."mimeType" = 'application/vnd.google-apps.shortcut' THEN 'S'
         WHEN file."mimeType" = 'application/vnd.google-apps.folder' THEN 'D' ELSE 'F' END AS kind
  FROM drive_changes WHERE file_id IS NOT NULL AND seq IS NOT NULL),
ops AS (SELECT * FROM k WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id, seq ORDER BY received_at DESC) = 1)
"""

SQL = {
    "p3_found": _LINKS + "SELECT node AS folder_id, cycle_id FROM cyc",
    "p3_hierarchy": _LINKS + """SELECT l.id AS folder_id, l.parent AS parent_id,
  CASE WHEN c.node IS NULL THEN f.seen[-1] END AS root_id,
  CASE WHEN c.node IS NULL THEN CAST(len(f.seen) - 1 AS BIGINT) END AS depth,
  CASE WHEN c.node IS NULL THEN array_to_string(list_reverse(f.seen), '/') END AS path_ids,
  CASE WHEN c.node IS NULL THEN array_to_string(list_transform(list_reverse(f.seen), lambda x: coalesce(n.m[x], '')), ' / ') END AS path,
  c.cycle_id
FROM links l JOIN fin f ON f.node = l.id LEFT JOIN cyc c ON c.node = l.id, (SELECT map(list(id), list(name)) AS m FROM links) n""",
    "p3_descendants": _LINKS + """SELECT u.cur AS ancestor_id, count(*) AS descendants, CAST(max(len(u.seen) - 1) AS BIGINT) AS height
FROM up u LEFT JOIN cyc c ON c.node = u.node WHERE c.node IS NULL AND u.cur <> u.node GROUP BY u.cur""",
    "p3_pairs": _LINKS + """, lp AS (SELECT DISTINCT f.node FROM fin f JOIN links l ON l.id = f.node WHERE f.back = f.node)
SELECT u.cur AS ancestor_id, u.node AS descendant_id, CAST(len(u.seen) - 1 AS BIGINT) AS distance FROM up u
WHERE u.cur <> u.node AND NOT EXISTS (SELECT 1 FROM lp WHERE lp.node = u.node)
  AND NOT EXISTS (SELECT 1 FROM lp WHERE lp.node = u.seen[-2])""",
    "p7_found": _LAST + """SELECT file_id, seq FROM ops
QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY seq DESC) = 1 AND kind IN ('D', 'F')""",
    "p7_files": _LAST + """,
cur AS (SELECT * FROM files WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY listed_at DESC) = 1),
drive AS (SELECT * FROM cur WHERE coalesce(is_drive_item, false)),
f AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY seq DESC) AS rn,
        max(CASE WHEN kind IN ('R', 'S') THEN 1 ELSE 0 END) OVER (PARTITION BY file_id) AS cut FROM ops WHERE kind IN ('R', 'S', 'F')),
new AS (SELECT f.file_id AS id, f.file.name AS name, coalesce(f.file."mimeType", 'application/octet-stream') AS mime_type,
    coalesce(TRY_CAST(regexp_extract(f.file.size, '^\\s*([+-]?[0-9]{1,18})', 1) AS BIGINT), 0) AS size,
    coalesce(f.file."modifiedTime", strftime(f.received_at, '%Y-%m-%dT%H:%M:%S.%gZ')) AS modified_time,
    f.file.parents[1] AS folder_id, true AS is_drive_item,
    coalesce(CASE WHEN f.cut = 0 THEN d.is_offline END, false) AS is_offline, coalesce(f.file.starred, false) AS starred
  FROM f LEFT JOIN drive d ON d.id = f.file_id WHERE f.rn = 1 AND f.kind = 'F')
SELECT id, name, mime_type, size, modified_time, folder_id, is_drive_item, is_offline, starred FROM cur
WHERE NOT coalesce(is_drive_item, false) OR id NOT IN (SELECT file_id FROM f)
UNION ALL SELECT * FROM new""".replace("\\\\s", "\\s"),
    "p7_folders": _LAST + """,
d AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY seq DESC) AS rn FROM ops WHERE kind IN ('R', 'D')),
base AS (SELECT id, any_value(name) AS name, any_value(parent_ids) AS parent_ids FROM folders WHERE id IS NOT NULL GROUP BY id)
SELECT id, name, array_to_string(parent_ids, ',') AS parent_ids FROM base WHERE id NOT IN (SELECT file_id FROM d)
UNION ALL SELECT file_id, file.name, array_to_string(coalesce(file.parents, []), ',') FROM d WHERE rn = 1 AND kind = 'D'""",
    "p7_counters": _LAST + """,
hf AS (SELECT DISTINCT id FROM (SELECT id, is_drive_item FROM files WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY listed_at DESC) = 1) WHERE coalesce(is_drive_item, false)),
hd AS (SELECT DISTINCT id FROM folders WHERE id IS NOT NULL),
f AS (SELECT file_id, kind, coalesce(lag(kind = 'F') OVER (PARTITION BY file_id ORDER BY seq), file_id IN (SELECT id FROM hf)) AS was FROM ops WHERE kind IN ('R', 'S', 'F')),
d AS (SELECT file_id, kind, coalesce(lag(kind = 'D') OVER (PARTITION BY file_id ORDER BY seq), file_id IN (SELECT id FROM hd)) AS was FROM ops WHERE kind IN ('R', 'D')),
e AS (SELECT * FROM f UNION ALL SELECT * FROM d)
SELECT CAST(count(*) FILTER (kind IN ('D', 'F') AND NOT was) AS BIGINT) AS added, CAST(count(*) FILTER (kind IN ('D', 'F') AND was) AS BIGINT) AS updated,
  CAST(count(*) FILTER (kind = 'R' AND was) AS BIGINT) AS removed FROM e""",
}

QUERIES = {f.__name__: f for f in (p3_found, p3_hierarchy, p3_descendants, p3_pairs, p7_found, p7_files, p7_folders, p7_counters)}
