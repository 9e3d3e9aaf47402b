"""Most similar vectors for every vector (problem 1).

Additive quantisation: a vector is approximated by a sum of full-dimensional
codewords, one from each of ``M`` codebooks. Codebooks start as residual k-means
and are re-solved jointly by least squares on the beam-search codes of a
bounded sample (``SAMPLE`` vectors, picked by hash). Every usable vector is then
encoded by beam search and stored as its codes and the squared norm of its
approximation, so that a query's distance to it is ``1 - 2 q.x' + |x'|^2``: one
table look-up per codebook and the stored norm. The nearest by that distance are
reranked exactly in double precision.

The codes double as an inverted index. The codewords of a book are ordered in a
binary tree of equal use; a cell is a path in the tree of the first book, then of
the next one behind it. A corpus of n vectors has about n / ``CELL`` cells, so the
path grows by one step when the corpus doubles. A vector is filed under its best
cell and asks its ``probes`` best ones. A cell that the sample shows to be crowded
is cut into blocks by a hash, of its data and of its queries: a task joins one
block of queries with one block of data, whatever the size of the cell. (The work
within one crowded cell thus grows with its square; what is bounded is the task.)

Equal vectors are one class. Its smallest id is indexed and carries the ``2 k``
members that can be among anyone's ``k`` nearest (``k`` per file), so classes are
never expanded inside a cell; its members get their lists at the end.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.hashing import mix
from corvane.session import hot_join, stage

M, K, BEAM = 4, 256, 4
SAMPLE, CELL, PROBES = 16_000, 1_200, 3
WIDE = 4  #: cells asked if no cosine is set as a floor: the neighbours are then farther away
BLOCK = 4_800  #: vectors in a block of a crowded cell
RERANK = 128  #: candidates per query and block that are reranked exactly if no cosine is set as a floor
FLOOR = 0.62  #: share of the wanted cosine that the quantised score must reach, see ``_search``
SMALL = 200_000  #: lists up to this many rows are broadcast, longer ones are joined by shuffle
HOT = 20_000  #: members from which a class of equal vectors is joined apart


class Additive:
    """Codebooks (M, K, dim) with beam-search encoding."""

    def __init__(self, codebooks: np.ndarray):
        self.c = codebooks.astype(np.float32)
        self.norms = (self.c**2).sum(-1)
        m, k, d = self.c.shape
        flat = self.c.reshape(m * k, d)
        self.gram = flat @ flat.T  # codeword products, for scoring sums without decoding

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, list[np.ndarray]]:
        """(codes n x M, per level the beam's prefixes n x beam x level, best first)."""
        parts = [self._encode(x[lo : lo + 512], beam) for lo in range(0, max(1, len(x)), 512)]
        return np.concatenate([c for c, _ in parts]), [np.concatenate(v) for v in zip(*(lev for _, lev in parts))]

    def _encode(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, list[np.ndarray]]:
        m, k, _ = self.c.shape
        n = len(x)
        dots = (x @ self.c.reshape(m * k, -1).T).reshape(n, m, k)
        err = np.zeros((n, 1), np.float32)
        codes = np.zeros((n, 1, 0), np.int64)
        levels = []
        for j in range(m):
            cost = err[:, :, None] + (self.norms[j] - 2 * dots[:, j])[:, None, :]
            for i in range(j):
                cost = cost + 2 * self.gram[i * k + codes[:, :, i], j * k : (j + 1) * k]
            b = cost.shape[1]
            cost = cost.reshape(n, b * k)
            take = min(beam, b * k)
            best = np.argpartition(cost, take - 1, axis=1)[:, :take]
            val = np.take_along_axis(cost, best, 1)
            o = np.argsort(val, axis=1, kind="stable")
            best, err = np.take_along_axis(best, o, 1), np.take_along_axis(val, o, 1)
            codes = np.concatenate((np.take_along_axis(codes, (best // k)[:, :, None], 1), (best % k)[:, :, None]), axis=2)
            levels.append(codes)
        return codes[:, 0, :], levels

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.c[j][codes[:, j]] for j in range(self.c.shape[0]))


def _sums(group: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``x`` by group."""
    return np.stack([np.bincount(group, col, n) for col in x.T.astype(np.float64)], axis=1)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c**2).sum(1) / 2
    return np.concatenate([(half - x[lo : lo + 2048] @ c.T).argmin(1) for lo in range(0, len(x), 2048)])


def train(x: np.ndarray, m: int | None = None, k: int | None = None, rounds: int = 2, seed: int = 7) -> Additive:
    """Residual k-means, then alternating beam search and joint least squares."""
    rnd = np.random.default_rng(seed)
    n, d = x.shape
    m, k = m or M, max(1, min(k or K, n // 4))
    books, rest = [], x.astype(np.float32)
    for _ in range(m):
        c = rest[rnd.choice(n, k, replace=False)].copy()
        for _ in range(6):
            near = _nearest(rest, c)
            total = _sums(near, rest, k)
            size = np.bincount(near, minlength=k)
            c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c).astype(np.float32)
        near = _nearest(rest, c)
        books.append(c)
        rest = rest - c[near]
    model = Additive(np.stack(books))
    for _ in range(rounds if m > 1 else 0):
        # The first level stays, since it names the cells; the finer levels are solved together.
        codes, _ = model.encode(x)
        cols = codes[:, 1:] + np.arange(m - 1) * k
        gram = np.zeros(((m - 1) * k, (m - 1) * k))
        right = np.zeros(((m - 1) * k, d))
        for i in range(m - 1):
            right += _sums(cols[:, i], x - model.c[0][codes[:, 0]], len(right))
            for j in range(m - 1):
                gram += np.bincount(cols[:, i] * len(gram) + cols[:, j], minlength=gram.size).reshape(gram.shape)
        old = model.c[1:].reshape((m - 1) * k, d)
        solved = np.linalg.solve(gram + np.eye((m - 1) * k), right + old).reshape(m - 1, k, d)
        model = Additive(np.concatenate((model.c[:1], solved)))
    return model


def usable_vectors(vectors: DataFrame, model: str, version: str, dimension: int):
    """Boolean column: the row belongs to the model and has a finite, non-zero embedding of the dimension."""
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ok = (F.col("embedding_model") == model) & (F.col("embedding_version") == version) & (F.col("dimension") == dimension) & (F.size(e) == dimension) & finite & F.exists(e, lambda v: v != 0)
    return F.coalesce(ok, F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dim)


def bits_of(count: int) -> int:
    """Steps of the path at which a corpus of ``count`` vectors has cells of about CELL."""
    return 0 if count <= 1.5 * CELL else math.ceil(math.log2(count / CELL))


class Paths:
    """Binary trees over the codewords of every book: ``codes[j][word]`` is the word's path of ``bits`` steps."""

    def __init__(self, model: Additive, used: np.ndarray):
        self.k = model.c.shape[1]
        self.bits = max(1, math.ceil(math.log2(max(2, self.k))))
        self.codes = np.stack([self._tree(c, np.bincount(used[:, j], minlength=self.k) + 0.5) for j, c in enumerate(model.c)])

    def _tree(self, words: np.ndarray, use: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        todo = [(np.arange(len(words)), 0)]
        while todo:
            at, depth = todo.pop()
            if depth == self.bits:
                continue
            right = at[:0]
            if len(at) > 1:
                centred = words[at] - words[at].mean(0)
                order = at[np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")]
                cut = int(np.clip(np.searchsorted(use[order].cumsum(), use[at].sum() / 2) + 1, 1, len(at) - 1))
                at, right = order[:cut], order[cut:]
            out[right] |= 1 << (self.bits - 1 - depth)
            todo += [(at, depth + 1), (right, depth + 1)]
        return out

    def cells(self, model: Additive, x: np.ndarray, levels: list[np.ndarray], bits: int, probes: int) -> np.ndarray:
        """n x probes cells, best first; -1 where a vector has no further one."""
        n = len(x)
        if not bits:
            return np.zeros((n, 1), np.int64)
        level, part = divmod(bits - 1, self.bits)
        level, part = min(level, len(self.codes) - 1), part + 1 if level < len(self.codes) else self.bits
        if level == 0:
            paths = self.codes[0] >> (self.bits - part)
            cost = model.norms[0] - 2 * x @ model.c[0].T
            best = np.full((n, 1 << part), np.inf, np.float32)
            for p in np.unique(paths):
                best[:, p] = cost[:, paths == p].min(1)
            take = min(probes, best.shape[1])
            order = np.argsort(best, axis=1, kind="stable")[:, :take]
            return np.where(np.isfinite(np.take_along_axis(best, order, 1)), order, -1)
        beams = levels[level]
        cell = np.zeros(beams.shape[:2], np.int64)
        for j in range(level):
            cell = cell * self.k + beams[:, :, j]
        cell = (cell << part) | (self.codes[level][beams[:, :, level]] >> (self.bits - part))
        out, size = np.full((n, probes), -1, np.int64), np.zeros(n, np.int64)
        for b in range(cell.shape[1]):
            new = (cell[:, b, None] != out).all(1) & (size < probes)
            out[new, size[new]] = cell[new, b]
            size += new
        return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dim)


def _unit(raw: np.ndarray) -> np.ndarray:
    raw = raw.astype(np.float64)
    return (raw / np.sqrt((raw**2).sum(1))[:, None]).astype(np.float32)


def _blocks_of(corpus: np.ndarray, cell: np.ndarray, crowded: dict) -> np.ndarray:
    """Number of blocks of every (corpus, cell)."""
    out = np.ones(len(cell), np.int64)
    for c, (cells, blocks) in crowded.items():
        at = np.nonzero(corpus == c)[0]
        if len(at):
            j = np.minimum(np.searchsorted(cells, cell[at]), len(cells) - 1)
            out[at] = np.where(cells[j] == cell[at], blocks[j], 1)
    return out


ASKS, HOLDS = 1, 2


def _assign(model: Additive, paths: Paths, dim: int, crowded: dict, probes: int):
    """Batches of (id, corpus, bits, file, heads, embedding) to rows of (corpus, cell, query block, data block)."""
    odd = mix(np.arange(dim, dtype=np.uint64)) | np.uint64(1)

    def run(batches):
        for big in batches:
            for b in (big.slice(lo, 1024) for lo in range(0, big.num_rows, 1024)):
                raw = _matrix(b.column(5), dim).astype(np.float32)
                x = _unit(raw)
                corpus, bits = np.array(b.column(1).to_pylist(), dtype=object), b.column(2).to_numpy()
                codes, levels = model.encode(x, beam=BEAM if bits.max(initial=0) <= paths.bits else 2 * max(BEAM, probes))
                norm = (model.decode(codes) ** 2).sum(1).astype(np.float32)
                own = (mix((raw.view(np.uint32).astype(np.uint64) * odd).sum(1)) >> np.uint64(16)).astype(np.int64)
                rows, cells, first = [], [], []
                for now in np.unique(bits):
                    at = np.nonzero(bits == now)[0]
                    c = paths.cells(model, x[at], [v[at] for v in levels], int(now), probes)
                    i, p = np.nonzero(c >= 0)
                    rows.append(at[i]), cells.append(c[i, p]), first.append(p == 0)
                rows, cells, first = np.concatenate(rows), np.concatenate(cells), np.concatenate(first)
                nb = _blocks_of(corpus[rows], cells, crowded)
                mine = own[rows] % nb
                # As a query, a vector meets every data block of the cell; as data (in its first cell only), every query block.
                asks = np.repeat(np.arange(len(rows)), nb)
                other = np.arange(len(asks)) - np.repeat(np.cumsum(nb) - nb, nb)
                both = (other == mine[asks]) & first[asks]
                holds = asks[first[asks] & ~both]
                far = other[first[asks] & ~both]
                r = np.concatenate((asks, holds))
                qb, db = np.concatenate((mine[asks], far)), np.concatenate((other, mine[holds]))
                role = np.concatenate((np.where(both, ASKS | HOLDS, ASKS), np.full(len(holds), HOLDS)))
                take = pa.array(rows[r])
                packed = pa.array([v.tobytes() for v in codes.astype(np.uint8)], pa.binary())
                data = pa.array(role >= HOLDS)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(cells[r]), pa.array(qb.astype(np.int32)), pa.array(db.astype(np.int32)), pa.array(role.astype(np.int8)), b.column(3).take(take), b.column(4).take(take),
                     pa.compute.if_else(data, packed.take(take), pa.scalar(b"", pa.binary())), pa.array(norm).take(take), pa.array([v.tobytes() for v in raw], pa.binary()).take(take)],
                    ["id", "corpus", "cell", "qb", "db", "role", "file", "heads", "codes", "norm", "vec"])

    return run


CELLS = "id string, corpus string, cell bigint, qb int, db int, role tinyint, file bigint, heads array<struct<id:string,f:bigint>>, codes binary, norm float, vec binary"
NEAR = "a string, many boolean, neighbour string, nf bigint, cosine double"


def _search(model: Additive, wanted: float | None, top: int):
    """One (corpus, cell, query block, data block): the best neighbours of every query.

    With a wanted cosine, whatever may reach it is reranked: ``q.x' / |x'|^2`` is about
    the cosine, its spread shrinks with the quality of the codes, and ``FLOOR`` leaves
    several deviations. Without one, the ``RERANK`` nearest by quantised distance are.
    """
    m, k, dim = model.c.shape
    flat = model.c.reshape(m * k, dim)

    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        role = t.column("role").to_numpy()
        qi, di = np.nonzero(role & ASKS)[0], np.nonzero(role & HOLDS)[0]
        ids, files = t.column("id").to_pylist(), t.column("file").to_numpy()
        heads = t.column("heads").to_pylist()
        vec = np.frombuffer(b"".join(t.column("vec").to_pylist()), np.float32).reshape(len(ids), dim).astype(np.float64)
        vec /= np.sqrt((vec**2).sum(1))[:, None]
        rows = t.column("codes").to_pylist()
        codes = np.frombuffer(b"".join(rows[i] for i in di), np.uint8).reshape(len(di), m).astype(np.int64)
        norm = t.column("norm").to_numpy()[di]
        cols = [codes[:, j] + j * k for j in range(m)]
        fd, hits = files[di], []
        step = max(16, min(1024, 4_000_000 // max(1, len(di))))
        for lo in range(0, len(qi) if len(di) else 0, step):
            at = qi[lo : lo + step]
            tables = vec[at].astype(np.float32) @ flat.T
            dot = tables[:, cols[0]]
            for c in cols[1:]:
                dot += tables[:, c]
            if wanted is not None:
                q, x = np.nonzero(dot >= FLOOR * wanted * np.maximum(norm, 1e-3))
                own = (at[q] != di[x]) & ((files[at[q]] == 0) | (files[at[q]] != fd[x]))
                q, x = q[own], x[own]
            else:
                near = 2 * dot - norm
                near[((files[at][:, None] == fd) & (fd != 0)) | (at[:, None] == di)] = -np.inf
                r = min(RERANK, len(di))
                x = np.argpartition(near, len(di) - r, axis=1)[:, len(di) - r :].reshape(-1)
                q = np.repeat(np.arange(len(at)), r)
                own = near[q, x] > -np.inf
                q, x = q[own], x[own]
            q, x = at[q], di[x]
            for s in range(0, len(q), 100_000):
                exact = np.round(np.einsum("ij,ij->i", vec[q[s : s + 100_000]], vec[x[s : s + 100_000]]), 12)
                good = exact >= wanted if wanted is not None else np.ones(len(exact), bool)
                hits.append((q[s : s + 100_000][good], x[s : s + 100_000][good], exact[good]))
        q, x, c = (np.concatenate(v) for v in zip(*hits)) if hits else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        # a class stands for its heads
        shown = [h if h else [{"id": i, "f": f}] for i, f, h in zip(ids, files.tolist(), heads)]
        size = np.array([len(h) for h in shown], dtype=np.int64)
        start = np.cumsum(size) - size
        nid = np.array([e["id"] for h in shown for e in h], dtype=object)
        nf = np.array([e["f"] for h in shown for e in h], dtype=np.int64)
        rank = np.empty(len(nid), np.int64)
        rank[np.argsort(nid.astype(str), kind="stable")] = np.arange(len(nid))
        rep = np.repeat(np.arange(len(q)), size[x])
        e = start[x][rep] + np.arange(len(rep)) - np.repeat(np.cumsum(size[x]) - size[x], size[x])
        q, c = q[rep], c[rep]
        own = (files[q] == 0) | (nf[e] != files[q])
        q, e, c = q[own], e[own], c[own]

        def placed(*keys):
            """Order by (keys, cosine down, id) and each row's place within its keys."""
            o = np.lexsort((rank[e], -c, *keys[::-1]))
            new = np.zeros(len(o), bool)
            new[:1] = True
            for key in keys:
                new[1:] |= key[o][1:] != key[o][:-1]
            return o, np.arange(len(o)) - np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))

        if len(q):
            # members of several files choose later among the best ``top`` of each file, the first ``2 top`` of those
            o, place = placed(q, nf[e])
            keep = o[(place < top) | (files[q[o]] != 0)]
            q, e, c = q[keep], e[keep], c[keep]
            o, place = placed(q)
            keep = o[place < np.where(files[q[o]] == 0, 2 * top, top)]
            q, e, c = q[keep], e[keep], c[keep]
        many = np.array([bool(h) for h in heads], bool)
        return pa.table({"a": pa.array([ids[i] for i in q], pa.string()), "many": pa.array(many[q], pa.bool_()), "neighbour": pa.array(list(nid[e]), pa.string()), "nf": pa.array(nf[e], pa.int64()), "cosine": pa.array(c, pa.float64())})

    return run


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a list if a count shows it to be small."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _current(vectors: DataFrame, model: str, version: str, dimension: int) -> DataFrame:
    return vectors.select(
        "id", F.coalesce("file_id", F.col("id")).alias("file_id"), F.coalesce("corpus_key", F.lit("user")).alias("corpus"), "indexed_at",
        usable_vectors(vectors, model, version, dimension).alias("ok"), "embedding").where("id is not null")


def similar_vectors(vectors: DataFrame, model: str = "multi-embed-b", version: str = "3", dimension: int = 64, k: int = 5, wanted: float | None = None, probes: int | None = None) -> DataFrame:
    """``id, neighbour, cosine, rank``: per vector its ``k`` most similar ones of other files in its corpus.

    With ``wanted`` only cosines of at least that are listed, and fewer cells are
    asked. Of repeated ids the row with the greatest ``indexed_at`` counts (ties: any,
    by content). Null corpus means ``user``; null ids are ignored, a null file id is a
    file of its own. Unusable rows (other model or version, wrong length, null,
    non-finite or all-zero values) take no part. Ties (12 digits) go to the smaller id.
    The index covers every usable vector; only the codebooks are fitted on a sample.
    Files are told apart by 64-bit hashes of their ids.
    """
    probes = probes or (PROBES if wanted is not None else WIDE)
    v = _current(vectors, model, version, dimension)
    narrow = v.select("id", "file_id", "corpus", F.struct("indexed_at", "ok", F.xxhash64("embedding").alias("v1"), F.hash("embedding").alias("v2"), "file_id", "corpus").alias("s"))
    latest = narrow.groupBy("id").agg(F.max("s").alias("s"), F.count("*").alias("n")).where("s.ok")
    latest = stage(latest.select("id", "s.file_id", "s.corpus", "s.indexed_at", "s.v1", "s.v2", "n"))
    # classes of equal vectors; only those with several members are listed
    alike = ["corpus", "v1", "v2"]
    crowds = stage(latest.groupBy(*alike).agg(F.min("id").alias("rep"), F.count("*").alias("c"), F.min("file_id").alias("f0"), F.max("file_id").alias("f1")).where("c > 1"))
    members = stage(hot_join(latest, crowds, alike, "c", HOT).select("id", "file_id", F.xxhash64("file_id").alias("f"), "rep", "c"))
    # Rows of ids that occur once and are no copies need no shuffle: all others are listed and handled apart.
    odd = latest.where("n > 1").select("id").unionByName(members.select("id")).distinct()
    stale = narrow.groupBy("id").agg(F.count("*").alias("n"), F.max("s").alias("s")).where("n > 1 and not s.ok").select("id")
    odd = stage(odd.unionByName(stale).distinct())
    # Of a class, ``k`` members per file and the first ``2 k`` of those can be among anyone's nearest. They are cut within salts
    # first (there a file's later members may stand before others, ``k`` at most), so that no class is sorted in one task.
    part = members.withColumn("p", F.pmod(F.xxhash64("id"), F.lit(64)))
    for keys, most in ((["rep", "f", "p"], k), (["rep", "p"], 3 * k), (["rep", "f"], k), (["rep"], 2 * k)):
        part = part.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy("id"))).where(F.col("r") <= most)
    heads = part.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("id", "f"))).alias("heads"))
    no_heads = F.lit(None).cast("array<struct<id:string,f:bigint>>")
    plain = v.where("ok").join(_small(odd), "id", "left_anti").select("id", "corpus", F.xxhash64("file_id").alias("file"), no_heads.alias("heads"), F.col("embedding").cast("array<float>").alias("embedding"))
    reps = latest.join(members.where("id <> rep").select("id"), "id", "left_anti").join(odd, "id", "left_semi")
    sole = stage(crowds.select("rep", (F.col("f0") != F.col("f1")).alias("mixed")).join(heads, "rep"))
    reps = stage(reps.join(sole, F.col("id") == F.col("rep"), "left").select(F.col("id").alias("rid"), F.col("indexed_at").alias("ri"), F.col("v1").alias("r1"), F.coalesce("mixed", F.lit(False)).alias("mixed"), "heads"))
    again = v.where("ok").join(_small(reps), (F.col("id") == F.col("rid")) & F.col("indexed_at").eqNullSafe(F.col("ri")) & (F.xxhash64("embedding") == F.col("r1")))
    again = again.groupBy("id", "corpus", "file_id", "mixed").agg(F.first("embedding").alias("embedding"), F.first("heads").alias("heads")).select(
        "id", "corpus", F.when(F.col("mixed"), F.lit(0).cast("bigint")).otherwise(F.xxhash64("file_id")).alias("file"), "heads", F.col("embedding").cast("array<float>").alias("embedding"))
    base = plain.unionByName(again)

    # The codebooks come from a sample that a hash of the id picks; corpus sizes are exact.
    sizes = latest.groupBy("corpus").agg(F.count("*").alias("n")).where(F.col("n") > 1.5 * CELL)
    sizes = stage(sizes.select("corpus", F.ceil(F.log2(F.col("n") / CELL)).cast("int").alias("bits")))
    share = min(1.0, SAMPLE / max(1, latest.count()))
    picked = v.where("ok").where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000)).join(_small(sizes), "corpus", "left")
    picked = picked.select("corpus", F.coalesce("bits", F.lit(0)).alias("bits"), F.col("embedding").cast("array<float>").alias("e")).limit(SAMPLE * 2).toPandas()
    if not len(picked):
        return vectors.sparkSession.createDataFrame([], "id string, neighbour string, cosine double, rank int")
    x = _unit(np.stack([np.asarray(e, np.float64) for e in picked["e"]]))
    coder = train(x)
    codes, levels = coder.encode(x, beam=2 * max(BEAM, probes))
    paths = Paths(coder, codes)
    crowded: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for (corpus, bits), at in picked.groupby(["corpus", "bits"]).indices.items():
        if bits:
            asked = paths.cells(coder, x[at], [lev[at] for lev in levels], int(bits), probes)
            cells, seen = np.unique(asked[asked >= 0], return_counts=True)
            full = (seen / share > 2 * BLOCK) & (seen >= 8)
            if full.any():
                crowded[corpus] = (cells[full], np.ceil(seen[full] / share / BLOCK).astype(np.int64))
    if sizes.count() <= SMALL:
        deep = base.join(F.broadcast(sizes), "corpus", "left")
    else:  # a corpus may hold a tenth of all rows: its one row is repeated for 64 salts
        salts = sizes.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(63))))
        deep = base.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(64)).cast("int")).join(salts, ["corpus", "_s"], "left")
    cells = deep.select("id", "corpus", F.coalesce("bits", F.lit(0)).alias("bits"), "file", "heads", "embedding").mapInArrow(_assign(coder, paths, dimension, crowded, probes), CELLS)
    near = cells.groupBy("corpus", "cell", "qb", "db").applyInArrow(_search(coder, wanted, k), NEAR)
    fellows = crowds.select("rep").join(heads, "rep").select(F.col("rep").alias("a"), F.lit(True).alias("many"), F.explode("heads").alias("h")).select("a", "many", F.col("h.id").alias("neighbour"), F.col("h.f").alias("nf"), F.lit(1.0).alias("cosine"))
    near = near.unionByName(fellows)
    # One short sorted list per class or single vector.
    lists = stage(near.groupBy("a", "many").agg(F.array_sort(F.collect_set(F.struct((-F.col("cosine")).alias("d"), "neighbour", "nf"))).alias("near")))
    single = lists.where("not many").select(F.col("a").alias("id"), F.slice("near", 1, k).alias("near"))
    shared = lists.where("many").select(F.col("a").alias("rep"), "near").join(crowds.select("rep", "c"), "rep")
    every = hot_join(members.drop("c"), shared, ["rep"], "c", HOT).select("id", F.slice(F.filter("near", lambda n: n["nf"] != F.col("f")), 1, k).alias("near"))
    out = single.unionByName(every).select("id", F.posexplode("near").alias("rank", "n"))
    return out.select("id", F.col("n.neighbour").alias("neighbour"), (-F.col("n.d")).alias("cosine"), (F.col("rank") + 1).alias("rank"))


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """``id_a, id_b`` of vectors of which at least one lists the other."""
    return neighbours.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def _brute(dim: int, top: int):
    """One (corpus, query block, data block), every pair scored exactly: the best of every query."""

    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        ids, files = np.array(t.column("id").to_pylist(), dtype=object), t.column("file").to_numpy()
        x = _matrix(t.column("embedding").combine_chunks(), dim).astype(np.float64)
        x /= np.sqrt((x**2).sum(1))[:, None]
        asks = np.array(t.column("asks").to_pylist(), bool)
        qi, di = np.nonzero(asks)[0], np.nonzero(~asks)[0]
        di = di[np.argsort(ids[di].astype(str), kind="stable")]
        rows = []
        for i in qi:
            s = np.where(files[di] == files[i], -np.inf, np.round(x[di] @ x[i], 12))
            best = np.argsort(-s, kind="stable")[:top]
            rows += [(ids[i], ids[di[j]], s[j]) for j in best if s[j] > -np.inf]
        cols = list(zip(*rows)) if rows else [[]] * 3
        return pa.table({n: pa.array(c, kind) for n, c, kind in zip(("id", "neighbour", "cosine"), cols, (pa.string(), pa.string(), pa.float64()))})

    return run


def _usable(vectors: DataFrame, model: str = "multi-embed-b", version: str = "3", dimension: int = 64, part: int = 100) -> DataFrame:
    """The usable vectors, with ``asks`` for every ``part``-th of them."""
    v = _current(vectors, model, version, dimension)
    w = W.partitionBy("id").orderBy(F.col("indexed_at").desc_nulls_last(), F.xxhash64("embedding"))
    v = v.withColumn("_r", F.row_number().over(w)).where("_r = 1 and ok").select("id", "corpus", F.xxhash64("file_id").alias("file"), "embedding")
    return v.withColumn("asks", F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("int") % part == 0)


def exact_neighbours(vectors: DataFrame, model: str = "multi-embed-b", version: str = "3", dimension: int = 64, k: int = 5, part: int = 100) -> DataFrame:
    """``id, neighbour, cosine`` by brute force for every ``part``-th vector (by MD5 of the id), against all of its corpus.

    For measuring recall: queries and data meet in blocks, a task holds one of each.
    """
    v = stage(_usable(vectors, model, version, dimension, part))
    sizes = v.groupBy("corpus").agg(F.ceil(F.count("*") / 20_000).cast("int").alias("nd"), F.ceil(F.sum(F.col("asks").cast("int")) / 2_000).cast("int").alias("nq")).where("nq > 0")
    here = v.join(_small(stage(sizes)), "corpus")
    h = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    steps = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ask = here.where("asks").withColumn("qb", h("nq")).withColumn("db", steps("nd"))
    data = here.withColumn("asks", F.lit(False)).withColumn("db", h("nd")).withColumn("qb", steps("nq"))
    cols = ["id", "corpus", "file", "embedding", "asks", "qb", "db"]
    got = ask.select(*cols).unionByName(data.select(*cols)).groupBy("corpus", "qb", "db").applyInArrow(_brute(dimension, k), "id string, neighbour string, cosine double")
    r = F.row_number().over(W.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))
    return got.withColumn("_r", r).where(F.col("_r") <= k).drop("_r")


def recall(vectors: DataFrame, k: int = 5, part: int = 100, **profile) -> DataFrame:
    """One row ``queries, neighbours, recall``: how many of the true ``k`` nearest of every ``part``-th vector are found.

    A neighbour as similar as the true last one counts as found (within 1e-7, since the index holds single precision).
    """
    true = stage(exact_neighbours(vectors, k=k, part=part, **profile))
    found = similar_vectors(vectors, k=k, **profile).select("id", "cosine")
    last = true.groupBy("id").agg(F.min("cosine").alias("last"), F.count("*").alias("n"))
    got = last.join(found, "id", "left").groupBy("id", "n").agg(F.sum(F.when(F.col("cosine") >= F.col("last") - 1e-7, 1).otherwise(0)).alias("hit"))
    asked = _usable(vectors, part=part, **profile).where("asks")
    return asked.agg(F.count("*").alias("queries")).crossJoin(got.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("neighbours"), F.coalesce(F.sum("hit") / F.sum("n"), F.lit(1.0)).alias("recall")))  # one row each
