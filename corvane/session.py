"""Session helpers: table loading, lineage cuts and distributed numbering."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table (a file or a folder of parts) of a scale folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only where the setting is absent and the master is local (tests) a temporary
    folder is made, which is removed when the process ends; on a cluster a missing
    setting is an error, since executors would write to disks of their own.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
        if current:
            named = current
        elif not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            named = tempfile.mkdtemp(prefix="corvane-")
            atexit.register(shutil.rmtree, named, True)
            sc.setCheckpointDir(named)
    return named.rstrip("/")


def stage(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` once to the shared folder and read it back.

    Compressed Parquet is used instead of ``checkpoint()`` because it is several
    times smaller and lets later readers prune columns and push filters. It
    survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    out = df.coalesce(partitions) if partitions else df
    out.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._corvane_path = path
    return back


def restage(frames: list[DataFrame]) -> DataFrame:
    """Several staged frames of one schema as a single scan."""
    return frames[0].sparkSession.read.schema(frames[0].schema).parquet(*[f._corvane_path for f in frames])


def unstage(df: DataFrame) -> None:
    """Delete what ``stage`` wrote, once nothing reads it any more."""
    path = getattr(df, "_corvane_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def rows_of(df: DataFrame, default: int = 0) -> int:
    """Row count; a Parquet-backed frame answers from footers."""
    return df.count() or default


def bounded_rank(df: DataFrame, keys: list[str], order: list, name: str, salts: int = 64, salt_on: str | None = None) -> DataFrame:
    """0-based rank within ``keys`` without putting a whole hot key in one task.

    Rows get a salt from a hash of ``salt_on``; ranks are taken within
    (keys, salt) and shifted by the exact counts of the smaller salts, so a key
    that holds a third of all rows is ranked by ``salts`` tasks. The order is
    therefore by (salt, order): deterministic, not global.
    """
    from pyspark.sql import Window as W

    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(salt_on)), F.lit(salts)).cast("int"))
    counts = salted.groupBy(*keys, "_salt").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    shift = counts.select(*keys, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = W.partitionBy(*keys, "_salt").orderBy(*order)
    ranked = salted.withColumn("_within", F.row_number().over(within) - 1)
    return ranked.join(shift, [*keys, "_salt"]).withColumn(name, F.col("_within") + F.col("_shift")).drop("_salt", "_within", "_shift")


def hot_join(many: DataFrame, one: DataFrame, on: list[str], count: str, limit: int) -> DataFrame:
    """Inner join of ``many`` with ``one`` (unique in ``on``), where ``count`` of ``one`` tells how many rows of ``many`` match it.

    Keys with more than ``limit`` rows are at most rows / ``limit`` of them: they are
    joined apart, by broadcast, so no task of the shuffle join gets more than
    ``limit`` rows of one key. ``many`` should be staged, since it is read twice then.
    """
    hot = stage(one.where(F.col(count) > limit))
    if hot.isEmpty():
        unstage(hot)
        return many.join(one, on)
    apart = many.join(F.broadcast(hot), on)
    rest = many.join(F.broadcast(hot.select(*on)), on, "left_anti").join(one.where(F.col(count) <= limit), on)
    return apart.unionByName(rest.select(*apart.columns))


def sorted_rank(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """0-based rank within ``keys`` by ``order`` (made unique by the caller), exact and without a hot group in one task.

    Rows are cut into sorted ranges of (keys, order); ranks are taken within a range and
    shifted by the counts of the key's earlier ranges.
    """
    from pyspark.sql import Window as W

    ranged = stage(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    shift = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = ranged.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*order)) - 1)
    return within.join(shift, [*keys, "_range"]).withColumn(name, (F.col("_r") + F.col("_shift")).cast("int")).drop("_r", "_shift", "_range")


def batches_of(files: list[str], columns: list[str], rows: int):
    """Arrow batches of staged Parquet files (``DataFrame.inputFiles``), read from the shared folder inside a task."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    for uri in files:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as f:
            yield from pq.ParquetFile(f).iter_batches(rows, columns=columns)
