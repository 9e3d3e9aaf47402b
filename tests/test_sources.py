import io
import json
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from corvane.operators import upkeep
from corvane.operators.changefeed import apply_changes
from corvane.sources import listing, office
from corvane.streaming.sync import ChangeSync, rate_limit_stream, windowed_counts


def packed(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def test_office(spark):
    docx = packed(**{"word__document.xml": "<w:p>A &amp; B<w:tab/>C</w:p><w:p>D</w:p>"})
    sheet = '<row r="1"><c t="s"><v>0</v></c><c><v>7</v></c><c t="b"><v>1</v></c></row><row><c><v></v></c></row>'
    xlsx = packed(**{"xl__sharedStrings.xml": "<si><t>Name</t></si>", "xl__worksheets__sheet10.xml": sheet, "xl__worksheets__sheet2.xml": "<row><c t='inlineStr'><is><t>In</t></is></c></row>"})
    pptx = packed(**{"ppt__slides__slide10.xml": "<a:t>ten</a:t>", "ppt__slides__slide2.xml": "<a:t>two</a:t> <a:t> and  more</a:t>"})
    rows = [("a.docx", docx), ("b.XLSX", xlsx), ("c.pptm", pptx), ("d.docx", b"broken"), ("e.txt", b"t"), ("f.docx", None)]
    got = {r.path: r for r in office.extract_office(spark.createDataFrame([(p, bytearray(c) if c is not None else None) for p, c in rows], "path string, content binary")).collect()}
    assert got["a.docx"].text == "A & B\tC\nD" or got["a.docx"].text.split() == ["A", "&", "B", "C", "D"]
    assert got["b.XLSX"].text == "[sheet10]\nName\t7\tTRUE\n[sheet2]\nIn" and got["c.pptm"].text == "two and more\nten"
    assert got["d.docx"].text is None and got["d.docx"].error and got["e.txt"].text is None and got["f.docx"].error is None


def test_paged_listing(spark, tmp_path):
    for chain, pages in {"x": [["1", "2"], ["3"]], "y": [["4"]]}.items():
        os.makedirs(tmp_path / chain)
        for n, ids in enumerate(pages):
            page = {"files": [{"id": i, "name": f"n{i}", "mimeType": "application/vnd.google-apps.folder" if i == "3" else "text/plain", "size": "5", "parents": ["p"]} for i in ids]}
            if n + 1 < len(pages):
                page["nextPageToken"] = f"T{n + 1}"
            (tmp_path / chain / (f"page-T{n}.json" if n else "page.json")).write_text(json.dumps(page))
    spark.dataSource.register(listing.PagedListing)
    got = spark.read.format("paged_listing").load(str(tmp_path))
    assert {r.id for r in got.collect()} == {"1", "2", "3", "4"} and not any(r.truncated for r in got.collect())
    cut = spark.read.format("paged_listing").option("maxPages", 1).load(str(tmp_path)).collect()
    assert {(r.id, r.truncated) for r in cut} == {("1", True), ("2", True), ("4", False)}
    files, folders = listing.map_items(got)
    assert {r.id for r in folders.collect()} == {"3"} and files.where("folder_id = 'p' and size = 5 and content_hash like 'gdrive-%-5'").count() == 3
    with pytest.raises(RuntimeError):
        listing.read_changes(spark, "x", complete=False)


def test_directory_and_texts(spark, tmp_path):
    os.makedirs(tmp_path / "sub")
    for name, data in {"a.bin": b"q" * 70_000, "sub/b.bin": b"q" * 70_000, "c.bin": b"q" * 69_999 + b"r", ".hidden": b"q", "d.txt": b"hello"}.items():
        (tmp_path / name).write_bytes(data)
    d = listing.read_directory(spark, str(tmp_path))
    assert {r.name for r in d.select("name").collect()} == {"a.bin", "b.bin", "c.bin", "d.txt"}
    dup = {os.path.basename(r.path): r.movable for r in listing.duplicate_files(d).collect()}
    assert dup == {"a.bin": False, "b.bin": True}
    t = listing.read_texts(spark, str(tmp_path / "d.txt")).first()
    assert t.text == "hello" and not t.truncated


FILE = "struct<id:string,name:string,mimeType:string,size:string,modifiedTime:string,createdTime:string,parents:array<string>,trashed:boolean,description:string,starred:boolean>"
CHANGE = f"seq bigint, file_id string, removed boolean, file {FILE}, received_at timestamp"


def _seeded(spark, tmp_path, parts=3):
    s = ChangeSync(spark, str(tmp_path / "state"), parts)
    files = spark.createDataFrame([("old", "o", "t", True, False, "gdrive-old-1")], "id string, name string, mime_type string, is_drive_item boolean, is_offline boolean, content_hash string")
    for c, t in (("size", "bigint"), ("modified_time", "string"), ("created_time", "string"), ("category", "string"), ("folder_id", "string"), ("parent_ids", "array<string>"), ("is_encrypted", "boolean"), ("content_hash_modified_time", "string"), ("tags", "array<string>"), ("semantic_summary", "string"), ("starred", "boolean"), ("can_move", "boolean"), ("listed_at", "timestamp")):
        files = files.withColumn(c, F.lit(None).cast(t))
    folders = spark.createDataFrame([], "id string, name string, color string, description string, created_at string, parent_ids array<string>")
    s.seed(files, folders, baseline_seq=0)
    return s, files, folders


def pay(i, mime="text/plain"):
    return (i, f"n{i}", mime, "1", "r", "c", None, None, None, None)


def test_change_sync_is_replay_safe(spark, tmp_path):
    batches = [[(1, "a", None, pay("a"), None), (2, "b", None, pay("b"), None)], [(3, "a", True, None, None), (4, "c", None, pay("c"), None), (5, "old", None, pay("old", "application/vnd.google-apps.shortcut"), None)]]
    for rows in batches:
        spark.createDataFrame(rows, CHANGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    s, *_ = _seeded(spark, tmp_path)
    s.drain(str(tmp_path / "feed"), spark.createDataFrame([], CHANGE).schema, str(tmp_path / "ck"))
    assert {r.id for r in s.read("files").collect()} == {"b", "c"}
    at = s.pointer()
    s.apply(spark.createDataFrame(batches[0], CHANGE), at["batch"])
    assert s.pointer() == at and at["batch"] == 1
    assert {r.file_id for b in (0, 1) for r in s.removed(b).collect()} >= {"old"}


def test_a_feed_in_any_order_gives_the_same_tables(spark, tmp_path):
    rnd = random.Random(3)
    rows = []
    for seq in range(1, 60):
        i = f"x{rnd.randrange(9)}" if rnd.random() < 0.9 else "old"
        kind = rnd.random()
        rows.append((seq, i, True, None, None) if kind < 0.25 else (seq, i, None, pay(i, "application/vnd.google-apps.folder"), None) if kind < 0.35 else (seq, i, None, pay(i), None))
    rows += rnd.sample(rows, 6)
    rnd.shuffle(rows)
    s, files, folders = _seeded(spark, tmp_path)
    for n in range(3):
        s.apply(spark.createDataFrame(rows[n::3], CHANGE), n)
    want = apply_changes(files, folders, spark.createDataFrame(rows, CHANGE))
    for name, df in (("files", want.files), ("folders", want.folders)):
        assert sorted(map(str, s.read(name).select(*df.columns).collect())) == sorted(map(str, df.collect()))


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    rows = [(1, 1000 * i, i) for i in range(33)] + [(1, 61_000, 90), (2, 5, 99)]
    schema = "user bigint, ts bigint, request_id bigint"
    batch = spark.createDataFrame(rows, schema)
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = rate_limit_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("limited").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    key = lambda d: sorted(tuple(r) for r in d.select("user", "ts", "request_id", "allowed", "retry_after", "log_event").collect())
    assert key(spark.table("limited")) == key(upkeep.rate_limit_decisions(batch))


def test_windowed_counts(spark, small):
    ev = spark.read.parquet(f"{small}/events.parquet")
    got = windowed_counts(ev.withColumn("ts", F.col("ts").cast("timestamp")))
    assert got.agg(F.sum("n")).first()[0] == ev.count()
