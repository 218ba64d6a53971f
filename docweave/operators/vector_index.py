"""An inverted file of vectors: coarse centroids with residuals in bytes, and a search that reranks few rows exactly.

Centroids are fitted by k-means on at most ``SAMPLE`` unit vectors. Every vector lies in the list of its nearest centroid, with its
residual in one byte a component, scaled by the largest residual of all. A query looks into the lists nearest to it, in
which scores are estimated from centroid and bytes; only the ``refine`` best estimates of a query are joined with
the vectors themselves. Lists are dealt out in pieces of about ``PIECE`` rows, so one that holds a third of all rows fills no task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import shared_folder, written
from .vectors import unit, vector_issue

SAMPLE, PIECE, ASKED, MOST = 20_000, 2_048, 512, 2_048
_CODED = "id {0}, list int, code binary"


@dataclass(frozen=True)
class VectorIndex:
    vectors: DataFrame  # (id, v): unit vectors
    coded: DataFrame  # (id, list, code)
    centroids: np.ndarray
    scale: float
    sizes: dict[int, int]


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """``k`` centroids of the rows; one that no row is nearest to stays where it is."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, j], k) for j in range(x.shape[1])], axis=1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def build(vectors: DataFrame, dim: int, folder: str | None = None, lists: int | None = None) -> VectorIndex:
    """The index of vectors (id, vector) of a stated length; rows with a ``vector_issue`` are not in it."""
    spark, folder = vectors.sparkSession, folder or shared_folder(vectors.sparkSession)
    units = written(vectors.where(vector_issue("vector", dim).isNull()).select("id", unit("vector").alias("v")), f"{folder}/units")
    n = units.count()
    share = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < math.ceil(min(1.0, 1.1 * SAMPLE / max(1, n)) * (1 << 30))
    sample = units.where(share).select("v").limit(SAMPLE).toArrow()["v"].combine_chunks()  # at most SAMPLE vectors
    x = _rows(sample, dim)
    x = x[np.lexsort(x.T[::-1])] if len(x) else np.zeros((1, dim))
    centres = k_means(x, max(1, min(MOST, len(x), lists or round(math.sqrt(n)))))
    sent = spark.sparkContext.broadcast(centres)

    def nearest(v: np.ndarray) -> np.ndarray:
        c = sent.value
        return np.argmin((c * c).sum(1) - 2 * (v @ c.T), axis=1)

    def largest(batches):
        most = 0.0
        for b in batches:
            v = _rows(b.column(0), dim)
            if len(v):
                most = max(most, float(np.abs(v - sent.value[nearest(v)]).max()))
        yield pa.RecordBatch.from_arrays([pa.array([most])], names=["most"])

    scale = (units.select("v").mapInArrow(largest, "most double").agg(F.max("most")).first()[0] or 1.0) / 127

    def code(batches):
        for b in batches:
            v = _rows(b.column(1), dim)
            at = nearest(v) if len(v) else np.zeros(0, np.int64)
            bytes_ = np.rint((v - sent.value[at]) / scale).astype(np.int8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at.astype(np.int32)), pa.array([r.tobytes() for r in bytes_], pa.binary())], names=["id", "list", "code"])

    coded = written(units.mapInArrow(code, _CODED.format(units.schema["id"].dataType.simpleString())).sortWithinPartitions("list"), f"{folder}/coded")
    sizes = {r["list"]: r["n"] for r in coded.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most MOST rows
    return VectorIndex(units, coded, centres, scale, sizes)


def candidates(index: VectorIndex, queries: DataFrame, refine: int, probes: int) -> DataFrame:
    """(query_id, id): the ``refine`` rows of each query (query_id, v) with the best estimates, in its ``probes`` nearest lists."""
    spark, dim, scale = queries.sparkSession, index.centroids.shape[1], index.scale
    sent = spark.sparkContext.broadcast(index.centroids)
    kind, named = (d.schema[c].dataType.simpleString() for d, c in ((index.coded, "id"), (queries, "query_id")))

    def probe(batches):
        for b in batches:
            q = _rows(b.column(1), dim)
            near = np.argsort(-(q @ sent.value.T), axis=1, kind="stable")[:, :probes]
            at = pa.array(np.repeat(np.arange(len(q)), near.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(near.ravel().astype(np.int32))], names=["query_id", "v", "list"])

    asking = queries.select("query_id", "v").mapInArrow(probe, f"query_id {named}, v array<double>, list int")
    asked = queries.count()
    size = F.broadcast(spark.createDataFrame([(int(i), math.ceil(n / PIECE), math.ceil(asked / ASKED)) for i, n in index.sizes.items()], "list int, pieces int, parts int"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = index.coded.join(size, "list").withColumn("piece", F.pmod(F.hash("id"), "pieces")).withColumn("part", upto("parts"))
    right = asking.join(size, "list").withColumn("part", F.pmod(F.hash("query_id"), "parts")).withColumn("piece", upto("pieces"))

    def estimate(key, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": b["query_id"].slice(0, 0), "id": a["id"].slice(0, 0), "score": pa.array([], pa.float64())})
        codes = np.frombuffer(b"".join(a["code"].to_pylist()), np.int8).reshape(-1, dim)
        q = _rows(b["v"].combine_chunks(), dim)
        s = (q @ codes.T.astype(np.float64)) * scale + (q @ sent.value[key[0].as_py()])[:, None]
        most = min(refine, len(codes))
        best = np.argpartition(-s, most - 1, axis=1)[:, :most]
        return pa.table({"query_id": b["query_id"].take(pa.array(np.repeat(np.arange(len(q)), most))), "id": a["id"].take(pa.array(best.ravel())), "score": np.take_along_axis(s, best, 1).ravel()})

    keys = ["list", "piece", "part"]
    met = left.select(*keys, "id", "code").groupBy(*keys).cogroup(right.select(*keys, "query_id", "v").groupBy(*keys)).applyInArrow(estimate, f"query_id {named}, id {kind}, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return met.where("id <> query_id").withColumn("place", place).where(F.col("place") <= refine).select("query_id", "id")


def search(index: VectorIndex, queries: DataFrame, k: int = 10, refine: int | None = None, share: float = 0.75) -> DataFrame:
    """(query_id, id, score, rank) by cosine, without the query itself: the best of each query's candidates, scored exactly.

    ``refine``: candidates of a query, ten times ``k`` by default; ``share``: of the lists, those a query looks into.
    """
    dim = index.centroids.shape[1]
    asked = queries.where(vector_issue("vector", dim).isNull()).select("query_id", unit("vector").alias("v"))
    found = candidates(index, asked, refine or 10 * k, max(1, math.ceil(share * len(index.centroids))))
    pairs = found.join(index.vectors, "id").join(asked.select("query_id", F.col("v").alias("q")), "query_id")
    dot = F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return pairs.select("query_id", "id", F.round(dot, 6).alias("score")).withColumn("rank", rank).where(F.col("rank") <= k)
