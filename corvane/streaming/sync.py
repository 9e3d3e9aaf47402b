"""Change feeds and rate limits as Structured Streaming.

``ChangeSync`` drains a change source into versioned catalogue tables. A batch may
hold changes that are older than ones applied before, so the history of every
touched id is kept, and its rows are worked out again from the first listing and
its whole history in true order: whatever the order of delivery, the tables equal
one application of all changes. History and tables are cut into ``parts`` by a hash
of the id; a batch reads and writes only the parts it touches.

Order of side effects: history, tables, removed ids, then a new pointer file that
names the versions of all parts, last. Pointers are numbered and never replaced, so
a crash at any point leaves the previous state readable. A batch that is delivered
again finds its number in the pointer and changes nothing.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.operators.changefeed import apply_changes


class ChangeSync:
    """Applies micro-batches of changes to ``files`` and ``folders`` under ``root``."""

    def __init__(self, spark: SparkSession, root: str, parts: int = 64):
        self.spark, self.root, self.parts = spark, root.rstrip("/"), parts

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def pointer(self) -> dict:
        """The newest complete pointer: batch, baseline_seq and, by table, the version of every part."""
        fs, p = self._fs(f"{self.root}/pointer/*.json")
        names = sorted(f.getPath().toString() for f in fs.globStatus(p) or [])
        return json.loads(self.spark.read.text(names[-1]).first()[0]) if names else {"no": 0, "batch": -1, "baseline_seq": None, "parts": {}}

    def _point(self, value: dict) -> None:
        value = value | {"no": value["no"] + 1}
        fs, tmp = self._fs(f"{self.root}/pointer/{value['no']:012d}.tmp")
        out = fs.create(tmp, True)
        out.write(json.dumps(value).encode())
        out.close()
        if not fs.rename(tmp, self._fs(f"{self.root}/pointer/{value['no']:012d}.json")[1]):
            raise RuntimeError("another writer has moved the pointer")

    def _part(self, key: str):
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int").alias("part")

    def _write(self, df: DataFrame, key: str, name: str, version: str) -> None:
        df.withColumn("part", self._part(key)).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/{name}/v={version}")

    def seed(self, files: DataFrame, folders: DataFrame, baseline_seq: int | None = None, complete: bool = True) -> None:
        """First tables from a full listing; the baseline offset was taken before the listing. Partial listings set no offset."""
        from corvane.operators.changefeed import current_rows

        self._write(current_rows(files), "id", "files", "seed")
        self._write(folders.where("id is not null").dropDuplicates(["id"]), "id", "folders", "seed")
        every = {str(i): "seed" for i in range(self.parts)}
        self._point({"no": self.pointer()["no"], "batch": -1, "baseline_seq": baseline_seq if complete else None, "parts": {"files": every, "folders": every, "history": {}}, "schemas": {"files": files.schema.json(), "folders": folders.schema.json()}})

    def _read(self, name: str, versions: dict[str, str], schema: str, parts: list[int] | None = None) -> DataFrame:
        """The given parts of a table (all of them by default) in the versions a pointer names."""
        kind = T.StructType.fromJson(json.loads(schema))
        by: dict[str, list[int]] = {}
        for part, version in versions.items():
            if parts is None or int(part) in parts:
                by.setdefault(version, []).append(int(part))
        out = None
        for version, own in sorted(by.items()):
            one = self.spark.read.schema(T.StructType([*kind.fields, T.StructField("part", T.IntegerType())])).parquet(f"{self.root}/{name}/v={version}").where(F.col("part").isin(own)).drop("part")
            out = one if out is None else out.unionByName(one)
        return self.spark.createDataFrame([], kind) if out is None else out

    def read(self, name: str) -> DataFrame:
        """``files`` or ``folders`` as of the last applied batch."""
        at = self.pointer()
        return self._read(name, at["parts"][name], at["schemas"][name])

    def apply(self, changes: DataFrame, batch_id: int) -> None:
        """foreachBatch target."""
        at = self.pointer()
        if batch_id <= at["batch"]:
            return
        if at["baseline_seq"] is not None:
            changes = changes.where(F.col("seq") > at["baseline_seq"])
        changes = changes.where("file_id is not null")
        new, version = at["parts"], f"b{batch_id}"
        touched = sorted(r["part"] for r in changes.select(self._part("file_id")).distinct().collect())  # at most ``parts`` rows
        kinds = {"history": changes.schema.json(), **at["schemas"]}
        read = lambda name, versions: self._read(name, versions, kinds[name], touched)
        if touched:
            self._write(read("history", new["history"]).unionByName(changes), "file_id", "history", version)
            move = lambda name: new[name] | {str(i): version for i in touched}
            seeds = {str(i): "seed" for i in touched}
            done = apply_changes(read("files", seeds), read("folders", seeds), read("history", move("history")))
            self._write(done.files, "id", "files", version)
            self._write(done.folders, "id", "folders", version)
            gone = read("files", new["files"]).select("id").join(read("files", move("files")).select("id"), "id", "left_anti")
            gone.select(F.col("id").alias("file_id")).write.mode("overwrite").parquet(f"{self.root}/removed/v={version}")
            new = {name: move(name) for name in ("history", "files", "folders")}
        self._point({**at, "batch": batch_id, "parts": new, "schemas": kinds})

    def removed(self, batch_id: int) -> DataFrame:
        """``file_id`` of the files that were there before a batch and not after it (their index rows are to be pruned)."""
        return self.spark.read.schema("file_id string").parquet(f"{self.root}/removed/v=b{batch_id}")

    def drain(self, feed: str, schema: T.StructType, checkpoint: str, per_trigger: int = 1) -> None:
        """Apply everything a Parquet feed folder holds now, in file order, and stop at its end."""
        stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(feed)
        q = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()


def rate_limit_stream(requests: DataFrame, limit: int = 30, window_ms: int = 60_000) -> DataFrame:
    """Decisions for a stream of ``user, ts, request_id``; state per user is (count, reset_at, logged)."""
    limit = min(1000, max(1, int(limit)))
    out = "user bigint, ts bigint, request_id bigint, allowed boolean, retry_after bigint, log_event boolean"

    def step(key, batches, state: GroupState):
        count, reset, logged = state.get if state.exists else (0, -1, False)
        pdf = pd.concat(list(batches)).sort_values(["ts", "request_id"], kind="stable")
        rows = []
        for ts, rid in zip(pdf["ts"].tolist(), pdf["request_id"].tolist()):
            if reset < 0 or ts >= reset:
                count, reset, logged = 0, ts + window_ms, False
            if count >= limit:
                rows.append((key[0], ts, rid, False, max(1, -((ts - reset) // 1000)), not logged))
                logged = True
            else:
                count += 1
                rows.append((key[0], ts, rid, True, 0, False))
        state.update((count, reset, logged))
        yield pd.DataFrame(rows, columns=["user", "ts", "request_id", "allowed", "retry_after", "log_event"])

    return requests.where("user is not null and ts is not null").groupBy("user").applyInPandasWithState(step, out, "count int, reset bigint, logged boolean", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Event counts and sums per tumbling window and type, with a watermark for late rows."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
