"""Embedding texts, vectors, and the vector index as a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLLECTIONS = {"text": "document_chunks", "table": "document_tables", "metadata": "document_metadata", "entity": "document_entities", "summary": "document_summaries"}


def metadata_texts(fields: DataFrame) -> DataFrame:
    pair = F.concat_ws(": ", "key", "value")
    return fields.where("coalesce(value, '') <> ''").groupBy("document_id").agg(F.array_join(F.sort_array(F.collect_list(pair)), "; ").alias("text"))


def entity_texts(ents: DataFrame) -> DataFrame:
    return ents.select("document_id", "block_id", F.concat_ws(": ", "entity_type", "value").alias("text"))


def summary_texts(docs: DataFrame, chars: int = 1500) -> DataFrame:
    return docs.select("document_id", F.substring("text", 1, chars).alias("text"))


def hash_vector(text: str, dim: int = 64) -> Column:
    """The bytes of the text's SHA-256, repeated to the dimension and scaled to -1 .. 1."""
    byte = lambda h, i: F.conv(F.substring(h, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double")
    digest = F.array(F.sha2(F.col(text).cast("binary"), 256))  # a list of one, so that the inner function has the digest and does not make it again
    return F.get(F.transform(digest, lambda h: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: byte(h, i) / 255 * 2 - 1)), F.lit(0))


def vector_issue(v: str, dim: int) -> Column:
    c = F.col(v)
    return (
        F.when(c.isNull() | (F.size(c) == 0), "empty").when(F.size(c) != dim, "wrong dimension")
        .when(F.exists(c, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), "not finite").when(F.forall(c, lambda x: x == 0), "all zero")
    )


def records(chunks: DataFrame, fields: DataFrame, ents: DataFrame, docs: DataFrame) -> DataFrame:
    """(document_id, ref, type, text): what is embedded, for the five types; table chunks count as text as well."""
    valid = chunks.where("status = 'valid'")
    part = lambda d, kind, ref, text="text": d.select("document_id", ref.cast("string").alias("ref"), F.lit(kind).alias("type"), F.col(text).alias("text"))
    return (
        part(valid, "text", F.col("chunk_id"), "content").unionByName(part(valid.where("chunk_type = 'table'"), "table", F.col("chunk_id"), "content"))
        .unionByName(part(metadata_texts(fields), "metadata", F.col("document_id"))).unionByName(part(entity_texts(ents), "entity", F.col("block_id"))).unionByName(part(summary_texts(docs), "summary", F.col("document_id")))
    )


def to_embed(new: DataFrame, store: DataFrame) -> DataFrame:
    """The records (text, model) whose content has no active vector of the same model yet."""
    return new.withColumn("hash", F.sha2(F.col("text").cast("binary"), 256)).join(store.where("is_active").select("hash", "model").distinct(), ["hash", "model"], "left_anti")


def embedded(recs: DataFrame, embedder: Callable[[Column], Column]) -> DataFrame:
    """The records with their ``vector``. ``embedder`` makes a column of vectors of a column of texts: a column expression or a pandas UDF."""
    return recs.withColumn("vector", embedder(F.col("text")))


def supersede(old: DataFrame, new: DataFrame) -> DataFrame:
    """All versions, those of the last version of a document and type active."""
    both = old.unionByName(new)
    last = F.max("version").over(Window.partitionBy("document_id", "type"))
    return both.withColumn("is_active", F.col("version") == last)


def collection(kind: str) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for p in COLLECTIONS.items() for x in p)), F.col(kind))


def payloads(vectors: DataFrame, docs: DataFrame, fields: DataFrame, keys: tuple[str, ...] = ("vendor", "customer", "currency", "invoice_date", "due_date", "language")) -> DataFrame:
    """Vectors with document columns and metadata keys beside them."""
    wide = fields.groupBy("document_id").agg(*(F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys))
    return vectors.join(docs, "document_id", "left").join(wide, "document_id", "left")


def payload_filter(filters: dict) -> Column:
    """Equality, any of a list, or a closed date range, as one predicate that reaches the scan."""
    out = F.lit(True)
    for name, want in filters.items():
        c = F.col(name)
        out = out & (c.between(want["gte"], want["lte"]) if isinstance(want, dict) else c.isin(want) if isinstance(want, list) else c == want)
    return out


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: str) -> Column:
    norm = F.sqrt(_dot(F.col(v), F.col(v)))
    return F.when(norm > 0, F.transform(F.col(v), lambda x: x.cast("double") / norm))


def common_length(vectors: DataFrame) -> int:
    """The length that most vectors have, the shorter of equally common ones; rows of other lengths are those that ``vector_issue`` reports."""
    found = vectors.where("vector is not null and size(vector) > 0").groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    return found["dim"] if found else 0


def top_k(vectors: DataFrame, queries: DataFrame, k: int, where: Column | None = None, block: int = 20_000, dim: int | None = None, meet: Callable | None = None) -> DataFrame:
    """(query_id, id, score, rank) by cosine, without the query itself. ``queries`` (query_id, vector) is a stated set.

    ``meet`` makes a function of the queries' unit vectors that says of other unit vectors which queries each may answer (a matrix of booleans).

    Vectors and queries of another length than ``dim`` (stated, else the ``common_length`` of all vectors) take no part. The queries are sent in
    blocks of about ``block``: every task multiplies its vectors with a block as matrices, and hands on no more than its own ``k`` best of each
    query; ties go to the lower id. Of several blocks, each one's results are written before the next is sent, so the plan does not grow with them.
    """
    import math

    from ..functions.storage import shared_folder, written

    dim = common_length(vectors) if dim is None else dim
    sized = F.col("vector").isNotNull() & (F.size("vector") == dim)
    base = (vectors if where is None else vectors.where(where)).select("id", "vector").where(sized)
    asked = queries.select("query_id", "vector").where(sized)
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    best = lambda d: d.withColumn("rank", rank).where(F.col("rank") <= k)
    blocks = max(1, math.ceil(asked.count() / block))
    if blocks == 1:
        return best(base.mapInArrow(_nearest(asked.toArrow(), k, dim, meet), kinds))
    folder, spark = shared_folder(vectors.sparkSession), vectors.sparkSession
    for i in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toArrow()  # about ``block`` vectors
        out = written(best(base.mapInArrow(_nearest(part, k, dim, meet), kinds)), f"{folder}/block={i}")
    return spark.read.schema(out.schema).parquet(*(f"{folder}/block={i}" for i in range(blocks)))


def _nearest(part, k: int, dim: int, meet: Callable | None = None):
    """A function for mapInArrow that gives the ``k`` nearest rows of a partition for each query of an Arrow table."""
    import numpy as np
    import pyarrow as pa

    def units(ids, vectors, dim):
        """The ids and scaled vectors of those that are not all zero."""
        m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        norm = np.sqrt((m * m).sum(axis=1))
        some = norm > 0
        return np.array(ids.to_pylist(), dtype=object)[some], m[some] / norm[some, None]

    asked = part.combine_chunks()
    names, q = units(asked["query_id"].combine_chunks(), asked["vector"].combine_chunks(), dim) if dim and part.num_rows else ([], None)
    cuts = [slice(lo, lo + 1_000) for lo in range(0, len(names), 1_000)]
    met = [meet(q[cut]) for cut in cuts] if meet is not None else None

    def find(batches):
        held: list[list[tuple[float, object]]] = [[] for _ in names]
        floor = np.full(len(names), -np.inf)  # the k-th best score so far
        kind = None
        for b in batches:
            kind = b.column(0).type
            for at in range(0, b.num_rows if len(names) else 0, 2_048):
                ids, v = units(b.column(0).slice(at, 2_048), b.column(1).slice(at, 2_048), dim)
                if not len(ids):
                    continue
                for i, cut in enumerate(cuts):
                    scores = q[cut] @ v.T
                    if met is not None:
                        scores[~met[i](v).T] = -np.inf
                    least = floor[cut].copy()
                    if (new := np.isinf(least)).any():
                        # one more than k, for the query itself may be among them
                        least[new] = np.partition(scores[new], -min(k + 1, len(ids)), axis=1)[:, -min(k + 1, len(ids))]
                    # what rounding may raise to the floor is rounded
                    rows, cols = np.nonzero((scores >= least[:, None] - 0.000001) & (scores > -np.inf))
                    if not len(rows):
                        continue
                    own = np.round(scores[rows, cols], 6)
                    starts = np.flatnonzero(np.diff(rows, prepend=-1)).tolist()
                    for lo, hi in zip(starts, [*starts[1:], len(rows)], strict=True):
                        j = cut.start + int(rows[lo])
                        new = [(-s, x) for s, x in zip(own[lo:hi].tolist(), ids[cols[lo:hi]], strict=True) if s >= floor[j] and x != names[j]]
                        if new:
                            held[j] = sorted(held[j] + new)[:k]
                            if len(held[j]) == k:
                                floor[j] = -held[j][-1][0]
        if kind is None:
            return
        flat = [(name, i, -s + 0.0) for name, own in zip(names, held, strict=True) for s, i in own]
        a, i, s = zip(*flat, strict=True) if flat else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, asked["query_id"].type), pa.array(i, kind), pa.array(s, pa.float64())], names=["query_id", "id", "score"])

    return find


def lsh_top_k(vectors: DataFrame, queries: DataFrame, k: int, dim: int, tables: int = 12, bits: int = 6, seed: int = 7, probes: int = 4) -> DataFrame:
    """As ``top_k`` among vectors in a random-hyperplane bucket of the query's or in a neighbouring one (approximate).

    In each table a query looks into its own bucket and those beyond the ``probes`` hyperplanes it lies nearest to. No pairs are joined or shuffled:
    a task tells by the numbers of the buckets which of its vectors a query meets.
    """
    import numpy as np

    planes = np.random.default_rng(seed).standard_normal((tables, bits, dim)).round(4)
    return top_k(vectors, queries, k, dim=dim, meet=_buckets(planes, probes))


def _buckets(planes, probes: int) -> Callable:
    """The ``meet`` of ``top_k``: a vector lies in a bucket of each table of hyperplanes, and a query looks into some."""
    import numpy as np

    tables, bits, dim = planes.shape

    def sides(v):
        m = (v @ planes.reshape(-1, dim).T).reshape(-1, tables, bits)
        return m, ((m >= 0) << np.arange(bits)).sum(axis=2)

    def meet(q):
        m, own = sides(q)
        near = np.argsort(np.abs(m), axis=2, kind="stable")[:, :, :probes]
        looked = np.concatenate([own[:, :, None], own[:, :, None] ^ (1 << near)], axis=2)
        open_ = np.zeros((tables, 2**bits, len(q)), dtype=bool)
        for t in range(tables):
            open_[t, looked[:, t, :].T, np.arange(len(q))[None, :]] = True

        def met(v):
            _, at = sides(v)
            out = open_[0, at[:, 0]]
            for t in range(1, tables):
                out |= open_[t, at[:, t]]
            return out

        return met

    return meet


def collection_stats(index: DataFrame) -> DataFrame:
    return index.groupBy("collection").agg(F.count("*").alias("points"), F.count_distinct("document_id").alias("documents"))


def build_index(recs: DataFrame, dim: int) -> DataFrame:
    """Active records with a valid vector, by collection."""
    return recs.where("is_active").where(vector_issue("vector", dim).isNull()).withColumn("collection", collection("type")).where("collection is not null")


def not_synced(recs: DataFrame, index: DataFrame, limit: int = 100) -> DataFrame:
    """Records that the index lacks, the first of them for the next retry."""
    return recs.join(index.select("document_id", "ref", "type").distinct(), ["document_id", "ref", "type"], "left_anti").orderBy("document_id", "ref", "type").limit(limit)


def active_by_type(recs: DataFrame) -> DataFrame:
    return recs.where("is_active").groupBy("document_id", "type").agg(F.count("*").alias("vectors"))
