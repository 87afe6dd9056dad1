"""Nearest neighbours by cosine with an inverted multi-index.

Vectors are normalised and cut into two halves, each quantised by a codebook of its own (k-means on a sample of at most
SAMPLE vectors, those of smallest hash of vec_id). A vector's cell is its pair of centroids. A query walks the pairs by
the sum of its two distances with a heap, until the cells it met hold a share of all entries; their entries are
reranked by the cosine of the original vectors in double precision. The share is the one that finds TARGET_RECALL of the
true neighbours inside the sample, so clustered vectors need few cells and vectors without structure need many.

Every row is indexed. Centroids grow with the square root of the table, so that cells keep their size, up to what the
sample can tell apart. Neighbouring cells form shards of about SHARD_ROWS entries; a cell of more than that is split over
several by a hash of the vector. Equal vectors of a batch are one entry with the smallest vec_ids that any query can
need. A query goes only to the shards that hold its cells, with the bits of the cells there; where over QUERY_BLOCK
queries meet in a shard, its entries are sent once for each block of them. A shard returns the best k of a query.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without vec_id or
vectors of another length than most of the others; of queries with one id the least vector counts. Ties go to the
smaller vec_id. With fewer than k candidates all are returned. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.runtime import persisted

SAMPLE = 20_000
#: Rows of the table for each cell, and vectors of the sample for each centroid, at least.
CELL_ROWS = 12
CENTROID_ROWS = 64
ITERATIONS = 12
TARGET_RECALL = 0.97
CALIBRATION_QUERIES = 300
SHARD_ROWS = 20_000
QUERY_BLOCK = 20_000


def vectors(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that take part, and their components as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.to_pylist() if column.null_count or column.flatten().null_count else None
    if values is None:
        lens = np.diff(np.asarray(column.offsets))
        at = np.flatnonzero(lens == dims)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        start = (np.cumsum(lens) - lens)[at]
        v = flat[start[:, None] + np.arange(dims)] if len(at) else np.zeros((0, dims))
    else:
        at = np.array([i for i, x in enumerate(values) if x is not None and len(x) == dims and None not in x], np.int64)
        v = np.array([values[i] for i in at], np.float64).reshape(len(at), dims)
    good = np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)
    return at[good], v[good]


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component near one: no square overflows, no bit changes."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=0.0, keepdims=True))[1])


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one."""
    v = scaled(v)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cosine(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The cosine of q and each row of v, the same for equal rows wherever they stand."""
    q, v = scaled(q[None, :])[0], scaled(v)
    return (v * q).sum(axis=1) / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum(axis=1)))


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1), 0)


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ITERATIONS):
        a = np.argmin(distances(x, c), axis=1)
        n = np.bincount(a, minlength=len(c))
        sums = np.stack([np.bincount(a, weights=x[:, j], minlength=len(c)) for j in range(x.shape[1])], axis=1)
        c[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return c


@dataclass
class MultiIndex:
    dims: int
    books: tuple[np.ndarray, np.ndarray]
    share: float

    @property
    def half(self) -> int:
        return self.dims // 2

    def halves(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(u[:, : self.half], self.books[0]), distances(u[:, self.half :], self.books[1])

    def cells(self, v: np.ndarray) -> np.ndarray:
        a, b = (np.argmin(d, axis=1) for d in self.halves(unit(v)))
        return a * len(self.books[1]) + b

    def walk(self, v: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For each query a row of bits, one a cell: the cells that the heap met before it had enough entries."""
        width = len(self.books[1])
        enough = math.ceil(self.share * int(counts.sum()))
        out = np.zeros((len(v), len(counts)), bool)
        held = counts.tolist()
        for row, (da, db) in enumerate(zip(*self.halves(unit(v)), strict=True)):
            ia, ib = np.argsort(da, kind="stable").tolist(), np.argsort(db, kind="stable").tolist()
            da, db = np.sort(da).tolist(), np.sort(db).tolist()
            heap, found, met = [(da[0] + db[0], 0, 0)], 0, []
            while heap and found < enough:
                _, i, j = heapq.heappop(heap)
                cell = ia[i] * width + ib[j]
                met.append(cell)
                found += held[cell]
                # (i, j) opens (i, j + 1), and (i + 1, 0) where it begins a row: each pair enters the heap once.
                if j + 1 < len(db):
                    heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
                if j == 0 and i + 1 < len(da):
                    heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
            out[row, met] = True
        return np.packbits(out, axis=1)


def fit(v: np.ndarray, k: int, centroids: int, target: float = TARGET_RECALL) -> MultiIndex | None:
    """Codebooks and the share of entries to look at, from a sample of vectors of one length; None without any."""
    if not v.size:
        return None
    dims = v.shape[1]
    u = unit(np.unique(v, axis=0))
    half = dims // 2
    books = kmeans(u[:, :half], centroids, 1) if half else np.zeros((1, 0)), kmeans(u[:, half:], centroids, 2)
    index = MultiIndex(dims, books, 1.0)
    cell = index.cells(u)
    counts = np.bincount(cell, minlength=len(books[0]) * len(books[1]))
    if len(u) <= 2 * k:
        return index
    needed = []
    for i in np.linspace(0, len(u) - 1, min(len(u), CALIBRATION_QUERIES)).astype(int):
        s = u @ u[i]
        s[i] = -np.inf
        near = np.argpartition(-s, k)[:k]
        da, db = index.halves(u[i : i + 1])
        order = np.argsort((da[0][:, None] + db[0][None, :]).ravel(), kind="stable")
        met = np.empty(len(order), np.int64)
        met[order] = np.cumsum(counts[order])
        needed += (met[cell[near]] / len(u)).tolist()
    index.share = float(np.quantile(needed, target))
    return index


def build(base: DataFrame, k: int, sample: int = SAMPLE, share: float | None = None) -> tuple[MultiIndex | None, DataFrame | None, np.ndarray | None]:
    """The index, its entries (cell, ids, vec) and how many each cell has. base: vec_id, embedding."""
    base = base.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    usable = base.where("NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(embedding, x -> x <> 0)")
    size = usable.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if size is None or not size.dims:
        return None, None, None
    rows = usable.where(F.size("embedding") == size.dims).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow().column(0).combine_chunks()
    drawn = rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, size.dims)
    index = fit(drawn, k, min(max(8, math.ceil(math.sqrt(size.n / CELL_ROWS))), max(8, sample // CENTROID_ROWS)))
    if index is None:
        return None, None, None
    if share is not None:
        index.share = share
    most = k + 1

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, v = vectors(batch.column(1), index.dims)
            if not len(at):
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)[at].astype(np.int64)
            # Adding zero makes equal of -0.0 and 0.0.
            once, code = np.unique(v + 0.0, axis=0, return_inverse=True)
            order = np.lexsort((ids, code.ravel()))
            code, ids = code.ravel()[order], ids[order]
            first = np.searchsorted(code, np.arange(len(once) + 1))
            lists = [ids[first[i] : first[i + 1]][:most].tolist() for i in range(len(once))]
            cell = index.cells(once)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(lists, pa.list_(pa.int64())), pa.array([x.tobytes() for x in once], pa.binary())], names=["cell", "ids", "vec"])

    entries = base.mapInArrow(enter, "cell int, ids array<bigint>, vec binary")
    entries = persisted(entries, "entries")
    counts = np.zeros(len(index.books[0]) * len(index.books[1]), np.int64)
    for r in entries.groupBy("cell").agg(F.count("*").alias("n")).collect():  # one row a cell
        counts[r.cell] = r.n
    return index, entries, counts


def dealt(counts: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The first shard of each cell and over how many the cell is split: cells in order, about `rows` entries a shard."""
    split = np.maximum(1, -(-counts // rows))
    first = np.zeros(len(counts), np.int64)
    shard = held = 0
    for c, (n, s) in enumerate(zip(counts.tolist(), split.tolist(), strict=True)):
        if held and (held + n > rows or s > 1):
            shard, held = shard + 1, 0
        first[c] = shard
        held += n
        if s > 1:
            shard, held = shard + s, 0
    return first, split


def search(base: DataFrame, queries: DataFrame, k: int = 5, sample: int = SAMPLE, share: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of `base` found for each row of `queries` (query_id, embedding), but
    those whose vec_id is its query_id."""
    spark = base.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    index, entries, counts = build(base, k, sample, share)
    if index is None:
        return spark.createDataFrame([], schema)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    first, split = dealt(counts, max(1, min(SHARD_ROWS, -(-int(counts.sum()) // parts))))
    last = first + split - 1
    # Shards of whole cells: where each begins and ends.
    lo = np.searchsorted(last, np.arange(int(last[-1]) + 1))
    hi = np.searchsorted(first, np.arange(int(last[-1]) + 1), "right")
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("query_id IS NOT NULL AND embedding IS NOT NULL")
    asked = asked.groupBy("query_id").agg(F.min("embedding").alias("embedding"))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, v = vectors(batch.column(1), index.dims)
            if len(at):
                met = np.unpackbits(index.walk(v, counts), axis=1)[:, : len(counts)].astype(bool) & (counts > 0)
                ids = batch.column(0).take(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.int64)
                for q, x, bits in zip(ids, v, met, strict=True):
                    cells = np.flatnonzero(bits)
                    edge = np.zeros(len(lo) + 1, np.int64)
                    np.add.at(edge, first[cells], 1)
                    np.add.at(edge, last[cells] + 1, -1)
                    shard = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                    here = [np.packbits(bits[lo[s] : hi[s]]).tobytes() for s in shard]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(shard), q)), pa.array(shard, pa.int32()), pa.array(here, pa.binary()), pa.array([x.tobytes()] * len(shard), pa.binary())], names=["query_id", "shard", "bits", "vec"])

    sent = persisted(asked.mapInArrow(plan, "query_id bigint, shard int, bits binary, vec binary"), "queries")
    blocks = sent.groupBy("shard").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    sent = sent.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, salt = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            shard = first[cell] + salt % split[cell]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(cell - lo[shard], pa.int32()), *batch.columns[1:3]], names=["shard", "at", "ids", "vec"])

    kept = entries.select("cell", "ids", "vec", F.pmod(F.xxhash64("vec"), F.lit(1 << 30)).alias("salt")).mapInArrow(placed, "shard int, at int, ids array<bigint>, vec binary")
    kept = kept.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def rerank(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and held.num_rows:
            cell = held.column("at").to_numpy()
            v = np.frombuffer(b"".join(held.column("vec").to_pylist()), np.float64).reshape(-1, index.dims)
            u = unit(v)
            ids = held.column("ids").to_pylist()
            for q, bits, raw in zip(*(asked.column(c).to_pylist() for c in ("query_id", "bits", "vec")), strict=True):
                vec = np.frombuffer(raw, np.float64)
                at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))[cell])
                near = u[at] @ unit(vec[None, :])[0]
                # The rough order leaves out only what exact scores cannot bring back.
                if len(at) > k + 1:
                    at = at[near >= np.partition(near, len(near) - k - 1)[len(near) - k - 1] - 1e-9]
                found = [(-s, i) for s, e in zip(cosine(vec, v[at]).tolist(), at.tolist(), strict=True) for i in ids[e] if i != q]
                out += [(q, i, -s) for s, i in heapq.nsmallest(k, found)]
        q, i, s = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})

    found = sent.groupBy("shard", "block").cogroup(kept.groupBy("shard", "block")).applyInArrow(rerank, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
