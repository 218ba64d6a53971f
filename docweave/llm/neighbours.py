"""Approximate nearest neighbours by largest inner product: an inverted multi-index over the two halves of the vectors.

Each half has its own ``K`` centroids, fitted on a bounded sample; every vector lies in the cell (i, j) of its nearest
centroid in each half. A query walks through the centroid pairs by the sum of both halves' distances (a distance is
the negative inner product with the centroid), best pair first, with a heap that holds the frontier only. Entries of
the visited cells are reranked by their exact inner products. The walk has two legs:

* until ``FIRST`` entries are visited; the k-th best exact score among them is the query's floor;
* on from there, until a pair's sum lies so far below the floor that ``MARGIN`` standard deviations of the cell's residuals
  do not reach it. Clustered vectors are left after few cells; for vectors without any structure the walk is long.

Work is dealt out by the first centroid i, in pieces of about ``PIECE`` entries and of ``ASKED`` queries each, so neither
a cell that holds a third of all rows nor one that every query visits fills a task; a piece multiplies only the runs of
entries whose second centroid the query visits. Equal vectors are one entry with its k + 1 smallest ids, which loses
nothing: of equal scores the smaller ids win, and a query drops itself only.

Sizes that are broadcast: the counts and spreads of at most ``MOST`` * ``MOST`` cells, and the centroids.

Defined results: rows whose id is null, whose vector is null, zero, or holds null or non-finite components, and rows
whose vector has another length than most valid ones (of equally common lengths the shorter), take no part. A repeated
id is a row like others: only the query's own row is left out. Equal scores go by smaller id, then row number; scores of
different vectors are equal if their sums in double precision are. No rows give no rows. Extra columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, cut, rows, slices

#: Distinct vectors, at most, on which the centroids are fitted.
SAMPLE = 20_000
#: Entries of the first leg; standard deviations of the residuals below the floor at which the second leg ends.
FIRST, MARGIN = 500, 2.9
#: Entries of a piece, queries of a piece, centroids of a half at most, and entries of a cell on average.
PIECE, ASKED, MOST, CELL = 1_024, 512, 1_024, 12
#: Queries whose walks are one task.
WALKS = 256
_ENTRY = pa.schema([("cid", pa.int64()), ("v", pa.binary()), ("least", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("r2", pa.float64())])
_PROBE = pa.schema([("i", pa.int32()), ("qid", pa.int64()), ("v", pa.binary()), ("js", pa.binary()), ("floor", pa.float64())])
_FOUND = pa.schema([("qid", pa.int64()), ("score", pa.float64()), ("cid", pa.int64()), ("least", pa.int64())])


def _valid(v: str):
    c = F.col(v)
    return c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(c, lambda x: x != 0)


def _matrix(packed: pa.Array, dim: int) -> np.ndarray:
    """Packed vectors as a matrix."""
    return np.frombuffer(b"".join(packed.to_pylist()), np.float64).reshape(-1, dim)


def packed_vectors(vectors: DataFrame, name: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """(uid, id, v) of the rows that take part, numbered and cut, and the vectors' length; ``v`` has its doubles as bytes."""
    some = vectors.select(F.col(name).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & _valid("v"))
    common = some.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = common["dim"] if common else 2

    def pack(batches):
        for b in slices(batches, 4_096):
            m = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) + 0.0  # no negative zeros
            offsets = np.arange(b.num_rows + 1, dtype=np.int32) * (8 * dim)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(m.tobytes())])], names=["uid", "id", "v"])

    sized = some.where(F.size("v") == dim).select(F.monotonically_increasing_id().alias("uid"), "id", "v")
    return cut(sized.mapInArrow(pack, "uid long, id long, v binary")), dim


def centroids(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """``k`` centroids by Lloyd's rounds; one that no row is nearest to stays where it is."""
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmax(x @ c.T - (c * c).sum(1) / 2, axis=1)


def walk(a: np.ndarray, b: np.ndarray):
    """The pairs (sum, i, j) of two score lists by descending sum. The heap holds the frontier only: a pair enters once both neighbours above it are out."""
    x, y = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    a, b, x, y = a[x].tolist(), b[y].tolist(), x.tolist(), y.tolist()
    taken = [0] * len(a)  # in each row, the columns that are out
    heap = [(-(a[0] + b[0]), 0, 0)]
    while heap:
        s, i, j = heapq.heappop(heap)
        yield -s, x[i], y[j]
        taken[i] = j + 1
        if j + 1 < len(b) and (i == 0 or taken[i - 1] > j + 1):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if i + 1 < len(a) and taken[i + 1] == j:
            heapq.heappush(heap, (-(a[i + 1] + b[j]), i + 1, j))


class MultiIndex:
    """Every distinct vector of ``packed_vectors`` in its cell."""

    def __init__(self, every: DataFrame, dim: int, k: int, scratch: Scratch):
        spark, self.dim, self.k = every.sparkSession, dim, k
        place = F.row_number().over(Window.partitionBy("v").orderBy("id", "uid"))
        some = every.withColumn("place", place).where(F.col("place") <= k + 1)
        ids = some.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", "uid"))).alias("ids"))
        self.distinct = cut(ids.select(F.monotonically_increasing_id().alias("cid"), "v", "ids"))  # the result reads it
        self.n = n = self.distinct.count()
        half, most = dim // 2, min(n, SAMPLE)
        size = max(1, min(MOST, most, 1 << max(0, round(math.log2(max(1, n / CELL)) / 2))))
        share = F.pmod(F.xxhash64("v"), F.lit(1 << 40)) < math.ceil(min(1.0, 1.1 * SAMPLE / max(1, n)) * (1 << 40))
        sample = self.distinct.where(share).select("v").limit(SAMPLE).toArrow()["v"].combine_chunks()  # at most SAMPLE vectors
        sample = _matrix(sample, dim)
        sample = sample[np.lexsort(sample.T[::-1])] if len(sample) else sample
        size = min(size, max(1, len(sample)))
        one, two = (centroids(x, size) if len(x) else np.zeros((1, x.shape[1])) for x in (sample[:, :half], sample[:, half:]))
        self.size, self.half, self.centres = size, half, spark.sparkContext.broadcast((one, two))

        def place_all(batches):
            one, two = self_centres.value
            for b in slices(batches, 2_048):
                m = _matrix(b.column(1), dim)
                i, j = nearest(m[:, :half], one), nearest(m[:, half:], two)
                r2 = ((m[:, :half] - one[i]) ** 2).sum(1) + ((m[:, half:] - two[j]) ** 2).sum(1)
                yield rows(_ENTRY, [*b.columns, i.astype(np.int32), j.astype(np.int32), r2])

        self_centres = self.centres
        entries = self.distinct.select("cid", "v", F.col("ids")[0]["id"].alias("least"))
        self.entries = scratch.keep(entries.mapInArrow(place_all, "cid long, v binary, least long, i int, j int, r2 double"))
        cells = self.entries.groupBy("i", "j").agg(F.count("*").alias("n"), F.sum("r2").alias("r2")).toArrow()  # at most size * size rows
        counts, spread, at = np.zeros((size, size), np.int64), np.zeros((size, size)), (cells["i"].to_numpy(), cells["j"].to_numpy())
        counts[at] = cells["n"].to_numpy()
        spread[at] = np.sqrt(cells["r2"].to_numpy() / cells["n"].to_numpy() / dim)
        self.counts, self.cells = counts, spark.sparkContext.broadcast((counts, spread))

    def probes(self, asked: DataFrame, first: bool) -> DataFrame:
        """(i, qid, v, js, floor): the second centroids that a query visits with each first one, as bits; of one leg of its walk."""
        centres, cells, half, dim = self.centres, self.cells, self.half, self.dim

        def visit(batches):
            (one, two), (counts, spread) = centres.value, cells.value
            for b in slices(batches, 64):
                out = []
                for qid, v, floor in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    q = np.frombuffer(v, np.float64)
                    a, c = one @ q[:half], two @ q[half:]
                    reach = MARGIN * math.sqrt(q @ q) * spread
                    bits, seen = {}, 0
                    least = None if first or floor is None else floor - reach.max() - 1e-9 * (abs(floor) + 1)
                    for s, i, j in walk(a, c):
                        own = seen < FIRST
                        if first and not own or least is not None and s < least:
                            break
                        n = counts[i, j]
                        if n and own == first and (first or floor is None or s >= floor - reach[i, j] - 1e-9 * (abs(floor) + 1)):
                            if i not in bits:
                                bits[i] = np.zeros(len(two), np.uint8)
                            bits[i][j] = 1
                        seen += n
                    out += [(i, qid, v, np.packbits(x).tobytes(), floor) for i, x in bits.items()]
                yield rows(_PROBE, list(zip(*out, strict=True)) or [[] for _ in _PROBE])

        return asked.select("qid", "v", "floor").mapInArrow(visit, "i int, qid long, v binary, js binary, floor double")

    def rerank(self, probes: DataFrame) -> DataFrame:
        """(qid, score, cid, least): the exact scores of the visited entries; of each piece the k + 1 best that reach the floor."""
        spark, dim, most = probes.sparkSession, self.dim, self.k + 1
        visits = {r["i"]: r["n"] for r in probes.groupBy("i").agg(F.count("*").alias("n")).collect()}  # at most MOST rows
        sized = [(int(i), max(1, math.ceil(int(self.counts[i].sum()) / PIECE)), math.ceil(n / ASKED)) for i, n in visits.items()]
        sizes = F.broadcast(spark.createDataFrame(sized, "i int, pieces int, parts int"))
        upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        held = self.entries.join(sizes, "i").withColumn("piece", F.pmod(F.xxhash64("cid"), F.col("pieces")).cast("int")).withColumn("part", upto("parts"))
        asking = probes.join(sizes, "i").withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int")).withColumn("piece", upto("pieces"))

        def score(_, left: pa.Table, right: pa.Table) -> pa.Table:
            none = _FOUND.empty_table()
            if not left.num_rows or not right.num_rows:
                return none
            left = left.sort_by("j")
            v, q = _matrix(left["v"], dim), _matrix(right["v"], dim)
            j = left["j"].to_numpy()
            bits = np.unpackbits(np.frombuffer(b"".join(right["js"].to_pylist()), np.uint8).reshape(len(q), -1), axis=1)
            floors = np.nan_to_num(right["floor"].to_numpy(zero_copy_only=False).astype(np.float64), nan=-np.inf)
            s = np.full((len(q), len(v)), -np.inf)
            starts = np.flatnonzero(np.diff(j, prepend=-1))
            for a, b in zip(starts, [*starts[1:], len(j)], strict=True):
                who = np.flatnonzero(bits[:, j[a]])
                if len(who):
                    s[who, a:b] = q[who] @ v[a:b].T
            low = np.partition(s, -min(most, len(v)), axis=1)[:, -min(most, len(v))] if len(v) > most else np.full(len(q), -np.inf)
            low = np.maximum(low, floors)
            low = np.where(np.isfinite(low), low - 1e-9 * (np.abs(low) + 1), low)
            at, which = np.nonzero((s >= low[:, None]) & (s > -np.inf))
            exact = (q[at] * v[which]).sum(axis=1)
            return pa.table([right["qid"].to_numpy()[at], exact, left["cid"].to_numpy()[which], left["least"].to_numpy()[which]], schema=_FOUND)

        keys = ["i", "piece", "part"]
        pairs = held.select(*keys, "cid", "v", "least", "j").groupBy(*keys).cogroup(asking.select(*keys, "qid", "v", "js", "floor").groupBy(*keys))
        return pairs.applyInArrow(score, "qid long, score double, cid long, least long")

    def best(self, found: DataFrame) -> DataFrame:
        """The k + 1 best entries of each query."""
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "least", "cid"))
        return found.withColumn("place", place).where(F.col("place") <= self.k + 1).drop("place")


def search(every: DataFrame, dim: int, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of ``every`` (uid, id, v; cut) for each of the rows ``queries`` of it."""
    spark = every.sparkSession
    with Scratch(spark) as scratch:
        index = MultiIndex(every, dim, k, scratch)
        asked = cut(queries.select("v").distinct().select(F.monotonically_increasing_id().alias("qid"), "v"))
        tasks = max(1, math.ceil(asked.count() / WALKS))  # few bytes, but long walks
        one = scratch.keep(index.probes(asked.withColumn("floor", F.lit(None).cast("double")).repartition(tasks, "qid"), True))
        near = scratch.keep(index.best(index.rerank(one)))
        floors = near.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("least")).select("qid", F.when(F.col("n") > k, F.col("least")).alias("floor"))
        two = scratch.keep(index.probes(asked.join(floors, "qid", "left").repartition(tasks, "qid"), False))
        best = cut(index.best(near.unionByName(index.rerank(two))))
    own = cut(queries.select("uid", F.col("id").alias("query_id"), "v").join(asked, "v").select("uid", "query_id", "qid"))
    rows_ = best.join(index.distinct.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("one")).select("qid", "score", "one.id", F.col("one.uid").alias("its"))
    first = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id", "its"))
    rows_ = rows_.withColumn("place", first).where(F.col("place") <= k + 1).drop("place")
    met = own.join(rows_, "qid").where("its <> uid")
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "id", "its"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def neighbours(vectors: DataFrame, k: int = 20, every_nth: int = 20) -> DataFrame:
    """The k nearest rows of each row whose vec_id is divisible by ``every_nth``."""
    every, dim = packed_vectors(vectors)
    return search(every, dim, every.where(F.col("id") % every_nth == 0), k)
