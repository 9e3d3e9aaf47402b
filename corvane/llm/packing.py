"""Filling fixed-capacity containers with items (problem 8).

Sizes are byte tokens (UTF-8 bytes, as public byte-level tokenizers count
without special tokens). The plan works on the histogram of lengths, which has
at most ``capacity`` entries whatever the number of documents: lengths are placed
longest first, each into the shortest pack (the one with the most room) if that
takes it, else into a new pack, and packs of one pattern are moved in bulk by
updating pattern counts. Patterns are then joined back to
documents by the rank of a document within its length.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import bounded_rank, stage


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Packing patterns ((length, multiplicity), ...) with their counts.

    Every length must be in 1..capacity. A pattern's lengths never exceed the capacity.
    """
    by_room: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    rooms: list[int] = []  # sorted keys of by_room

    def put(room: int, pattern, count: int) -> None:
        if room not in by_room:
            by_room[room] = []
            rooms.insert(bisect_right(rooms, room), room)
        by_room[room].append((pattern, count))

    def take(room: int):
        found = by_room[room].pop()
        if not by_room[room]:
            del by_room[room]
            rooms.remove(room)
        return found

    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        left = histogram[length]
        while left:
            k = len(rooms) - 1
            if k < 0 or rooms[k] < length:
                put(capacity - length, ((length, 1),), left)
                break
            room = rooms[k]
            pattern, count = take(room)
            used = min(count, left)
            if count > used:
                put(room, pattern, count - used)
            grown = pattern[:-1] + ((length, pattern[-1][1] + 1),) if pattern[-1][0] == length else (*pattern, (length, 1))
            put(room - length, grown, used)
            left -= used
    return [p for room in sorted(by_room) for p in by_room[room]]


def slots_of(patterns) -> tuple[np.ndarray, ...]:
    """Rank ranges by length: (length, first rank, multiplicity, first container), sorted."""
    rows, seen, container = [], {}, 0
    for pattern, count in patterns:
        for length, times in pattern:
            first = seen.get(length, 0)
            rows.append((length, first, times, container))
            seen[length] = first + times * count
        container += count
    rows.sort()
    return tuple(np.array([r[i] for r in rows], dtype=np.int64) for i in range(4))


@dataclass
class Packing:
    """``items``: doc_id, piece, start, size, container_id; ``containers`` in total, ``capacity``."""

    items: DataFrame
    containers: int
    capacity: int


def sizes(documents: DataFrame) -> DataFrame:
    """``doc_id, size``: byte tokens of each text (null text: 0); rows without id are ignored."""
    return documents.where("doc_id is not null").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size"))


def pack(documents: DataFrame, capacity: int) -> Packing:
    """Assign every document to containers of ``capacity`` byte tokens.

    Texts above the capacity, and only those, are cut into pieces of the capacity
    and a rest; ``start`` is the piece's first byte. Empty and null texts take no
    space and get the null container. Repeated ids are separate items.
    """
    whole = (F.col("size") > capacity)
    pieces = sizes(documents).select(
        "doc_id", "size", F.explode(F.sequence(F.lit(0), F.when(whole, F.ceil(F.col("size") / F.lit(capacity)).cast("int") - 1).otherwise(0))).alias("piece"),
    ).select("doc_id", "piece", (F.col("piece") * F.lit(capacity)).cast("bigint").alias("start"), F.least(F.col("size") - F.col("piece") * F.lit(capacity), F.lit(capacity)).cast("bigint").alias("size"))
    pieces = stage(pieces)
    histogram = {r["size"]: r["n"] for r in pieces.where("size > 0").groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    patterns = plan_patterns(histogram, capacity)
    length, first, times, container = slots_of(patterns)
    stride = max(histogram.values(), default=0) + 1
    keys = length * stride + first

    def assign(batches):
        for b in batches:
            size, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("size", "rank"))
            slot = np.searchsorted(keys, size * stride + rank, side="right") - 1
            where = container[slot] + (rank - first[slot]) // times[slot]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "size")), pa.array(where)], ["doc_id", "piece", "start", "size", "container_id"])

    schema = "doc_id bigint, piece int, start bigint, size bigint, container_id bigint"
    ranked = bounded_rank(pieces.where("size > 0"), ["size"], ["doc_id", "piece"], "rank", salts=32, salt_on="doc_id")
    placed = ranked.select("doc_id", "piece", "start", "size", F.col("rank").cast("bigint").alias("rank")).mapInArrow(assign, schema) if histogram else pieces.where("false").withColumn("container_id", F.lit(0).cast("bigint"))
    empty = pieces.where("size = 0").withColumn("container_id", F.lit(None).cast("bigint"))
    return Packing(placed.unionByName(empty), sum(c for _, c in patterns), capacity)


def oversized(packing: Packing) -> DataFrame:
    """``doc_id`` of every document the packing had to split."""
    return packing.items.where("piece = 1").select("doc_id")


def fill(packing: Packing) -> DataFrame:
    """One row per container: ``container_id, items, used, unused``."""
    return packing.items.where("container_id is not null").groupBy("container_id").agg(F.count("*").alias("items"), F.sum("size").alias("used")).withColumn("unused", F.lit(packing.capacity) - F.col("used"))
