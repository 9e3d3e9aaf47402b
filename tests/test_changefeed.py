import random

from corvane.operators import changefeed as cf

FILE = "struct<id:string,name:string,mimeType:string,size:string,modifiedTime:string,createdTime:string,parents:array<string>,trashed:boolean,description:string,starred:boolean>"
SCHEMA = f"seq bigint, file_id string, removed boolean, file {FILE}, received_at timestamp, id string"
FOLDER, SHORTCUT = "application/vnd.google-apps.folder", "application/vnd.google-apps.shortcut"


def pay(i, mime="text/plain", trashed=None, rev="r1", size="12"):
    return (i, f"n{i}", mime, size, rev, None, None, trashed, None, None)


def feed(spark, rows):
    return spark.createDataFrame([(s, i, rm, f, None, "extra") for s, i, rm, f in rows], SCHEMA)


def test_last_change_wins(spark):
    rows = [(1, "a", None, pay("a")), (3, "a", None, pay("a", FOLDER)), (2, "a", True, None), (3, "a", None, pay("a", FOLDER)),
            (1, "b", False, pay("b")), (9, "b", False, None), (4, "c", None, pay("c", trashed=True)), (5, "d", None, pay("d", SHORTCUT)),
            (5, "e", True, pay("e")), (None, "f", None, pay("f")), (6, None, None, pay("g"))]
    assert {tuple(r) for r in cf.live_changes(feed(spark, rows)).collect()} == {("a", 3), ("b", 1)}
    assert cf.live_changes(feed(spark, [])).collect() == []


def test_hot_key_tree_equals_sequential_replay(spark):
    rnd = random.Random(4)
    rows = []
    for s in range(1, 1500):
        i = "hot" if s % 3 == 0 else f"k{rnd.randrange(40)}"
        kind = rnd.choice(["up", "up", "dir", "rm", "cut", "none", "trash"])
        f = {"up": pay(i, rev=rnd.choice("xy")), "dir": pay(i, FOLDER), "cut": pay(i, SHORTCUT), "trash": pay(i, trashed=True)}.get(kind)
        rows.append((s, i, True if kind == "rm" else None, f))
    files, dirs, ev = set(), set(), [0, 0, 0]
    for s, i, rm, f in rows:
        if rm or (f and f[7]):
            for t in (files, dirs):
                if i in t:
                    t.discard(i)
                    ev[2] += 1
        elif f and f[2] == SHORTCUT:
            files.discard(i)
        elif f:
            t = dirs if f[2] == FOLDER else files
            ev[i in t] += 1
            t.add(i)
    shuffled = rows + rows[::7]
    rnd.shuffle(shuffled)
    files0 = spark.createDataFrame([], "id string, name string, mime_type string, size bigint, modified_time string, created_time string, category string, folder_id string, parent_ids array<string>, is_drive_item boolean, is_offline boolean, is_encrypted boolean, content_hash string, content_hash_modified_time string, tags array<string>, semantic_summary string, starred boolean, can_move boolean, listed_at timestamp")
    folders0 = spark.createDataFrame([], "id string, name string, color string, description string, created_at string, parent_ids array<string>")
    a = cf.apply_changes(files0, folders0, feed(spark, shuffled))
    assert {r.id for r in a.files.collect()} == files and {r.id for r in a.folders.collect()} == dirs
    got = a.counters.groupBy().sum("added", "updated", "removed").first()
    assert list(got) == ev
