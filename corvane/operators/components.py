"""Connected components over an edge table by contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import hot_join, stage, unstage

MAX_ROUNDS = 60
HOT = 20_000
LOCAL = 1_000_000  #: edges that one task finishes


def _finish(batches):
    """``node, component`` of all edges ``x, y`` of one task: roots are hooked to smaller ones and paths halved until nothing changes."""
    some = [b for b in batches if b.num_rows]
    if not some:
        return
    ends = pa.concat_arrays([b.column(i) for i in (0, 1) for b in some])
    nodes = pc.unique(ends)
    nodes = nodes.take(pc.sort_indices(nodes))
    x, y = np.split(pc.index_in(ends, nodes).to_numpy(), 2)
    label = np.arange(len(nodes))
    while (label[x] != label[y]).any():
        a, b = label[x], label[y]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    for b in pa.table({"node": nodes, "component": nodes.take(pa.array(label))}).to_batches(max_chunksize=10_000):
        yield b


def _contract(e: DataFrame, rnd: int) -> tuple[DataFrame, DataFrame]:
    """One round: ``node, label`` of every node (the first of it and those near it, in an order drawn anew by hash), and the edges between labels."""
    both = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
    drawn = lambda c: F.struct(F.xxhash64(c, F.lit(rnd)).alias("h"), F.col(c).alias("id"))
    near = both.groupBy("x").agg(F.min(drawn("y")).alias("near"), F.count("*").alias("c"))
    step = stage(near.select(F.col("x").alias("node"), F.least(drawn("x"), "near")["id"].alias("label"), "c"))
    half = stage(hot_join(e, step.select(F.col("node").alias("x"), F.col("label").alias("lx"), "c"), ["x"], "c", HOT).select("y", "lx"))
    far = hot_join(half, step.select(F.col("node").alias("y"), F.col("label").alias("ly"), "c"), ["y"], "c", HOT).where("lx <> ly")
    out = stage(far.select(F.least("lx", "ly").alias("x"), F.greatest("lx", "ly").alias("y")).distinct())
    unstage(half)
    return step, out


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of an undirected edge table; the component is its smallest node.

    Up to ``LOCAL`` edges are finished by one task. While there are more, every node takes the
    label of the first node near it in a random order, and the nodes of one label are
    merged, so the graph shrinks by a share whatever its ids and however long its paths
    are; the rounds' labels are looked up backwards at the end. A hub, and a label that many
    nodes share, is looked up once (``hot_join``), so no task gets more than about ``HOT`` rows of it.
    Null ends and self-loops are ignored; an empty table gives an empty result.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    e = stage(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    steps: list[DataFrame] = []
    while e.count() > LOCAL:
        if len(steps) == MAX_ROUNDS:
            raise RuntimeError("components did not settle")
        step, less = _contract(e, len(steps))
        steps.append(step)
        unstage(e)
        e = less
    kind = e.schema["x"].dataType.simpleString()
    known = e.select("x", "y").coalesce(1).mapInArrow(_finish, f"node {kind}, component {kind}")
    if not steps:
        return stage(known)
    for step in reversed(steps):
        found = stage(known)
        shared = step.groupBy("label").agg(F.count("*").alias("n")).join(found.withColumnRenamed("node", "label"), "label", "left")
        shared = stage(shared.select("label", "n", F.coalesce("component", "label").alias("root")))
        known = hot_join(step, shared, ["label"], "n", HOT).select("node", F.col("root").alias("component"))
    known = stage(known.withColumnRenamed("component", "root"))
    least = stage(known.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("n")))
    return hot_join(known, least, ["root"], "n", HOT).select("node", "component")
