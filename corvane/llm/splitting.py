"""Splitting oversized items at natural boundaries (problem 6).

Texts are whitespace-collapsed and trimmed. Recursive bisection: a stretch longer
than the limit minus the overlap is cut at the strongest boundary near its
midpoint (paragraph, sentence, line, clause, word; the nearer one on ties), and
the halves are cut again until all fit. Only a stretch without any word end near
its middle is cut elsewhere, and inside a word only if the word alone is too
long. Then every piece but the first is extended backwards by the overlap,
starting at a word where possible.

``audit_pieces`` names stored pieces that break these rules.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.session import stage

LONG_WORD = 80
BLOCK = 64  #: consecutive piece numbers that are looked for together
#: White space as the stored pieces were collapsed: ASCII, no-break and other Unicode spaces, BOM.
SPACE = "[\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
_RUN = re.compile(SPACE + "+")


def collapse(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """Collapsed text, positions of its blanks and their strengths (4 paragraph .. 0 word)."""
    out, at, strength, last, n = [], [], [], 0, 0
    for m in _RUN.finditer(text):
        word = text[last : m.start()]
        last = m.end()
        if not word and not out:
            continue
        out.append(word)
        n += len(word)
        gap, end = m.group(), word[-1:]
        lines = gap.count("\n") + (gap.count("\r") if "\n" not in gap else 0)
        at.append(n)
        strength.append(4 if lines > 1 else 3 if end in ".!?…。।！？" else 2 if lines else 1 if end in ",;:)" else 0)
        n += 1
    if last < len(text):
        out.append(text[last:])
    elif out:
        at.pop(), strength.pop()
    return " ".join(out), np.array(at, dtype=np.int64), np.array(strength, dtype=np.int64)


def split_text(text: str, limit: int, low: int, high: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces in the collapsed text; overlaps are ``low`` to ``high`` long."""
    flat, at, strength = collapse(text)
    if not flat:
        return []
    if len(flat) <= limit:
        return [(0, len(flat))]
    most = limit - high - 1
    cores, todo = [], [(0, len(flat))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= most:
            cores.append((lo, hi))
            continue
        cut = None
        mid, room = (lo + hi) / 2, hi - lo
        for part in (0.2, 0.35, 0.499):
            a, b = np.searchsorted(at, [mid - part * room, mid + part * room])
            if a < b:
                best = np.lexsort((np.abs(at[a:b] - mid), -strength[a:b]))[0]
                cut = int(at[a + best])
                break
        if cut is None:  # one word fills the middle: cut it
            todo += [(int(mid), hi), (lo, int(mid))]
        else:
            todo += [(cut + 1, hi), (lo, cut)]
    pieces = [cores[0]]
    for (p_lo, p_hi), (lo, hi) in zip(cores, cores[1:]):
        first = pieces[-1][0] + 1
        a, b = max(first, p_hi - high), max(first, p_hi - low)
        i, j = np.searchsorted(at, [a - 1, b])
        starts = [int(x) + 1 for x in at[i:j] if a <= x + 1 <= b]
        rank = {int(x) + 1: int(s) for x, s in zip(at[i:j], strength[i:j])}
        starts.sort(key=lambda s: (-rank[s], p_hi - s))
        prev = flat[pieces[-1][0] : p_hi]
        start = next((s for s in starts if longest_overlap(prev, flat[s:hi], low, high) == p_hi - s), starts[0] if starts else b)
        pieces.append((start, hi))
    return pieces


def longest_overlap(prev: str, this: str, low: int, high: int) -> int:
    """Length of the longest end of ``prev`` that starts ``this``; 0 if that is under ``low``."""
    head = this[:low]
    if len(head) < low:
        return 0
    i = prev.find(head, max(0, len(prev) - len(this)))
    while i >= 0:
        if this.startswith(prev[i:]):
            return len(prev) - i
        i = prev.find(head, i + 1)
    return 0


def split_documents(documents: DataFrame, limit: int = 800, low: int = 80, high: int = 160) -> DataFrame:
    """``doc_id, idx, start, text``: numbered pieces of every text, whole texts if they fit.

    Null and blank texts have no pieces. ``start`` is the offset in the collapsed
    text. Other columns are ignored; repeated rows give repeated pieces.
    """

    def run(batches):
        for b in batches:
            ids, idx, start, text = [], [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                flat = collapse(t)[0]
                for i, (lo, hi) in enumerate(split_text(t, limit, low, high)):
                    ids.append(d), idx.append(i), start.append(lo), text.append(flat[lo:hi])
                if len(ids) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(idx, pa.int32()), pa.array(start, pa.int64()), pa.array(text, pa.string())], ["doc_id", "idx", "start", "text"])
                    ids, idx, start, text = [], [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(idx, pa.int32()), pa.array(start, pa.int64()), pa.array(text, pa.string())], ["doc_id", "idx", "start", "text"])

    return documents.select("doc_id", "text").where("text is not null").mapInArrow(run, "doc_id bigint, idx int, start bigint, text string")


def _cut_ok(flat: str, piece: str, near: int = 0) -> tuple[bool, int]:
    """Whether some occurrence of ``piece`` neither starts nor ends inside a word of up to LONG_WORD characters, and where (-1: nowhere).

    Occurrences behind ``near`` are looked at first, then those before it.
    """

    def inside(p: int) -> bool:
        if p <= 0 or p >= len(flat) or flat[p - 1] == " " or flat[p] == " ":
            return False
        lo = flat.rfind(" ", max(0, p - LONG_WORD - 1), p) + 1 or max(0, p - LONG_WORD - 1)
        hi = flat.find(" ", p, p + LONG_WORD + 1)
        return (min(len(flat), p + LONG_WORD + 1) if hi < 0 else hi) - lo <= LONG_WORD

    at = -1
    for start, stop in ((near, len(flat)), (0, min(len(flat), near + len(piece) - 1))) if near else ((0, len(flat)),):
        p = flat.find(piece, start, stop)
        while p >= 0:
            at = p
            if not inside(p) and not inside(p + len(piece)):
                return True, p
            p = flat.find(piece, p + 1, stop)
    return False, at


def _audit(limit: int, low: int, high: int):
    """Batches of (file_id, pieces of one block, flat) to one row per piece with its faults."""

    def run(batches):
        for b in batches:
            rows, texts = [], []
            for file, pieces, flat in zip(*(b.column(i).to_pylist() for i in range(3))):
                near = 0
                for x in sorted(pieces, key=lambda x: x["idx"]):
                    t, prev, word = x["text"], x["prev"], None
                    if flat is not None:
                        ok, at = _cut_ok(flat, t, near)
                        if at >= 0:  # pieces follow each other, so the next one is looked for behind this one
                            near, word = at, not ok
                    rows.append((file, x["idx"], len(t) > limit, word, prev is not None and not low <= longest_overlap(prev, t, low, high) <= high))
                    texts.append(t)
            h = pd.util.hash_array(np.array(texts, dtype=object), categorize=False).view(np.int64) if texts else np.zeros(0, np.int64)
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(h), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.bool_()), pa.array(cols[4], pa.bool_())],
                ["file_id", "idx", "h", "too_long", "in_word", "bad_overlap"])

    return run


def _with_previous(p: DataFrame) -> DataFrame:
    """Add ``prev``: the text of the file's nearest smaller idx (the greatest, if texts conflict), null at the first."""
    p = p.withColumn("blk", F.floor(F.col("idx") / BLOCK))
    w = W.partitionBy("file_id", "blk").orderBy("idx").rangeBetween(W.unboundedPreceding, -1)
    p = p.withColumn("prev", F.max(F.struct("idx", "text")).over(w)["text"])
    # The first piece of a later block looks at the last one of the block before it.
    heads = p.where("prev is null and blk > 0").select("file_id", "blk").distinct()
    ids = heads.select("file_id").distinct()
    tails = p.join(ids, "file_id", "left_semi").groupBy("file_id", "blk").agg(F.max(F.struct("idx", "text")).alias("t"))
    before = tails.withColumn("tail", F.lag("t.text").over(W.partitionBy("file_id").orderBy("blk"))).select("file_id", "blk", "tail")
    return p.join(before, ["file_id", "blk"], "left").withColumn("prev", F.coalesce("prev", "tail")).drop("tail")


def audit_pieces(pieces: DataFrame, documents: DataFrame, limit: int = 800, low: int = 80, high: int = 160) -> DataFrame:
    """``file_id, idx, too_long, in_word, bad_overlap`` of every stored piece (repeats once).

    ``pieces``: file_id, idx, text; ``documents``: id, text; other columns are ignored.
    A piece that does not occur in its document, or has no document, has no word
    fault; if it occurs several times, or in both texts of a file indexed twice, one
    right place is enough. Conflicting texts of one idx are judged together. Rows with a
    null key are ignored; a null text counts as empty. Pieces are handled in blocks
    of consecutive numbers, so a file with very many of them is spread over tasks.
    """
    p = pieces.where("file_id is not null and idx is not null").select("file_id", "idx", F.coalesce("text", F.lit("")).alias("text")).distinct()
    p = _with_previous(p)
    flat = documents.where("id is not null and text is not null").select(F.col("id").alias("file_id"), F.trim(F.regexp_replace("text", SPACE + "+", " ")).alias("flat"))
    # A document meets its pieces in blocks, so it is sent once per BLOCK pieces, and those of one file may be in many tasks.
    blocks = stage(p.groupBy("file_id", "blk").agg(F.collect_list(F.struct("idx", "text", "prev")).alias("pieces")))
    held = blocks.groupBy("file_id").agg(F.collect_list("blk").alias("blks"))
    there = flat.join(held, "file_id").select("file_id", F.explode("blks").alias("blk"), "flat")
    judged = blocks.join(there, ["file_id", "blk"], "left").select("file_id", "pieces", "flat").mapInArrow(
        _audit(limit, low, high), "file_id string, idx int, h bigint, too_long boolean, in_word boolean, bad_overlap boolean")
    one = judged.groupBy("file_id", "idx", "h").agg(F.max("too_long").alias("too_long"), F.coalesce(F.min("in_word"), F.lit(False)).alias("in_word"), F.max("bad_overlap").alias("bad_overlap"))
    return one.groupBy("file_id", "idx").agg(*[F.max(c).alias(c) for c in ("too_long", "in_word", "bad_overlap")])


def faulty_pieces(audited: DataFrame) -> DataFrame:
    """``file_id, idx`` of stored pieces with any fault."""
    return audited.where("too_long or in_word or bad_overlap").select("file_id", "idx")
