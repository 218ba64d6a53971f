"""Ranked lexical search, exact, by a sparse ball tree over document vectors.

A document's vector holds, for each term of the asked items, weight * impact as an integer; an item's vector has ones, so the score
is their inner product. Documents of one vector and size are one entry with its k smallest doc_ids, which loses nothing:
of equal scores the smaller ids win.

* *Upper tree*: a bounded sample is halved again and again between two far apart documents; every entry goes down these
  splits to an anchor. The entries of an anchor are dealt into blocks of bounded size, so a hot anchor is many blocks.
* *Blocks*: each block is a ball tree (centre, radius) whose leaves hold about ``LEAF`` entries, stored as one row.
  While it is built, each item scores the leaf that looks best to it; the k-th best of these scores over all blocks is
  the item's floor.
* *Search*: per item, subtrees are taken from a heap by their bound, centre sum + sqrt(terms) * radius, until the bound falls below
  the floor or the k-th best so far. Radii and bounds are rounded up by more than the error of their sums in double precision, so no
  subtree goes that could hold a result; leaves are scored in 64-bit integers.

The items are a stated set, asked in blocks of about ``TERMS`` terms; a block's terms, weights and floors are broadcast, and
each block of items reads the texts once.

Defined results: a null text, or one without terms, is no document; an item without terms has no results. Equal scores go by
doc_id (null last). Repeated rows of documents are documents, repeated rows of items are items, each with ranks of its own. Very long texts are
read whole. No documents or no items give no rows. Extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, alnum_words, column, cut, rows, slices

TOP = 10
#: Terms of a block of items; entries of the sample, and terms of one of its entries, at most.
TERMS, SAMPLE, SHORT = 200_000, 4_096, 2_000
#: Entries of a leaf; entries and terms of a block; anchors of the upper tree.
LEAF, BLOCK, WIDE, ANCHORS = 128, 4_096, 1_500_000, 64
_POSTED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("tfs", pa.binary())])
_PLACED = pa.schema([("key", pa.binary()), ("anchor", pa.int32()), ("size", pa.int64()), ("doc_id", pa.int64()), ("m", pa.int64()), ("ids", pa.binary()), ("tfs", pa.binary())])
_TREE = pa.schema([("ptr", pa.binary()), ("ids", pa.binary()), ("x", pa.binary()), ("doc_ptr", pa.binary()), ("docs", pa.binary()), ("named", pa.binary()), ("nodes", pa.binary()), ("radius", pa.binary()), ("c_ptr", pa.binary()), ("c_ids", pa.binary()), ("c", pa.binary()), ("seed_items", pa.binary()), ("seeds", pa.binary())])
_HIT = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tfs: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tfs) // (1000 * tfs + 8 * m)


class Sparse:
    """Rows of sparse vectors (ids, x), none of them empty."""

    def __init__(self, ptr: np.ndarray, ids: np.ndarray, x: np.ndarray):
        self.ptr, self.ids, self.x = ptr, ids, x

    def take(self, at: np.ndarray) -> Sparse:
        size = self.ptr[at + 1] - self.ptr[at]
        ptr = np.concatenate([[0], np.cumsum(size)])
        each = np.repeat(self.ptr[at] - ptr[:-1], size) + np.arange(ptr[-1])
        return Sparse(ptr, self.ids[each], self.x[each])

    def norms(self) -> np.ndarray:
        x = self.x.astype(np.float64)
        return np.add.reduceat(x * x, self.ptr[:-1])

    def distances(self, dense: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Squared distances of the rows from a dense vector."""
        return norms - 2 * np.add.reduceat(self.x * dense[self.ids], self.ptr[:-1]) + dense @ dense

    def dense(self, i: int, width: int) -> np.ndarray:
        out = np.zeros(width)
        out[self.ids[self.ptr[i] : self.ptr[i + 1]]] = self.x[self.ptr[i] : self.ptr[i + 1]]
        return out


def _far_pair(m: Sparse, norms: np.ndarray, distances: np.ndarray, width: int):
    """Two far apart rows as dense vectors, and how much nearer each row is to the first."""
    one = m.dense(int(np.argmax(distances)), width)
    d_one = m.distances(one, norms)
    two = m.dense(int(np.argmax(d_one)), width)
    return one, two, d_one - m.distances(two, norms)


class Upper:
    """The upper tree: splits (two far apart vectors and a threshold) fitted on a sample."""

    def __init__(self, m: Sparse, width: int, anchors: int):
        self.splits: dict[int, tuple] = {}  # of nodes 1, 2, 3, ...; the children of k are 2k and 2k + 1
        todo = [(1, np.arange(len(m.ptr) - 1))]
        for node, at in todo:
            if 2 * node >= 2 * anchors or len(at) < 8:
                continue
            own = m.take(at)
            norms = own.norms()
            centre = np.bincount(own.ids, own.x, width) / len(at)
            one, two, diff = _far_pair(own, norms, own.distances(centre, norms), width)
            mid = float(np.median(diff))
            left = diff < mid
            if left.any():
                pair = [(np.flatnonzero(v).astype(np.int32), v[v != 0]) for v in (one, two)]
                self.splits[node] = (*pair, mid)
                todo += [(2 * node, at[left]), (2 * node + 1, at[~left])]

    def anchors(self, m: Sparse, width: int) -> np.ndarray:
        """The anchor of each row."""
        out, todo = np.zeros(len(m.ptr) - 1, np.int32), [(1, np.arange(len(m.ptr) - 1))]
        for node, at in todo:
            if node not in self.splits or not len(at):
                out[at] = node
                continue
            *pair, mid = self.splits[node]
            own, d = m.take(at), []
            for ids, x in pair:
                v = np.zeros(width)
                v[ids] = x
                d.append(x @ x - 2 * np.add.reduceat(own.x * v[own.ids], own.ptr[:-1]))
            left = d[0] - d[1] < mid
            todo += [(2 * node, at[left]), (2 * node + 1, at[~left])]
        return out


def ball_tree(m: Sparse, width: int):
    """The order of the rows, nodes (start, end, left, right), radii, and centres (ptr, ids, values), the root first."""
    order, norms = np.arange(len(m.ptr) - 1), m.norms()
    nodes, radii, c_ids, c_values = [[0, len(order), -1, -1]], [], [], []
    k = 0
    while k < len(nodes):
        start, end = nodes[k][:2]
        at = order[start:end]
        own = m.take(at)
        mean = (np.bincount(own.ids, own.x, width) / len(at)).astype(np.float32)
        centre = mean.astype(np.float64)
        d = own.distances(centre, norms[at])
        # safe: more than the rounding of the sums above
        radii.append(math.sqrt(max(0.0, float(d.max())) + 1e-11 * (float(norms[at].max()) + float(centre @ centre))) * (1 + 1e-9))
        c_ids.append(np.flatnonzero(mean).astype(np.int32))
        c_values.append(mean[c_ids[-1]])
        if len(at) > LEAF:
            diff = _far_pair(own, norms[at], d, width)[2]
            order[start:end] = at[np.argsort(diff, kind="stable")]
            mid = (start + end) // 2
            nodes[k][2:] = [len(nodes), len(nodes) + 1]
            nodes += [[start, mid, -1, -1], [mid, end, -1, -1]]
        k += 1
    c_ptr = np.concatenate([[0], np.cumsum([len(c) for c in c_ids])])
    return order, np.array(nodes, np.int64), np.array(radii), c_ptr, np.concatenate(c_ids), np.concatenate(c_values)


class Asked:
    """A block of items: their terms as ids, with weights once the corpus is counted."""

    def __init__(self, items: list[tuple[int, list[bytes]]]):
        self.names = [i for i, _ in items]
        self.vocabulary = {t: k for k, t in enumerate(sorted({t for _, terms in items for t in terms}))}
        self.terms = [np.array(sorted({self.vocabulary[t] for t in terms}), np.int32) for _, terms in items]
        self.width = len(self.vocabulary)
        sizes = np.bincount(np.concatenate(self.terms), minlength=self.width)
        self.item_ptr = np.concatenate([[0], np.cumsum(sizes)])  # by term, the items that hold it
        pairs = np.concatenate([np.stack([t, np.full(len(t), k, np.int32)]) for k, t in enumerate(self.terms)], axis=1)
        self.items = pairs[1][np.argsort(pairs[0], kind="stable")]
        self.weights = np.zeros(self.width, np.int64)

    def bounds(self, radii, c_ptr, c_ids, c) -> np.ndarray:
        """(nodes, items): upper bounds of the scores below each node, rounded up."""
        out = np.zeros((len(radii), len(self.terms)))
        for k in range(len(radii)):
            ids = c_ids[c_ptr[k] : c_ptr[k + 1]]
            size = self.item_ptr[ids + 1] - self.item_ptr[ids]
            ends = np.cumsum(size)
            each = np.repeat(self.item_ptr[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
            out[k] = np.bincount(self.items[each], np.repeat(c[c_ptr[k] : c_ptr[k + 1]].astype(np.float64), size), len(self.terms))
        roots = np.sqrt([len(t) for t in self.terms])
        return (out + radii[:, None] * roots) * (1 + 1e-9) + 1

    def scores(self, mask: np.ndarray, item: int, ptr, ids, x) -> np.ndarray:
        """The exact scores of the rows ``ptr``; ``mask`` (all zero) is used and left so."""
        mask[self.terms[item]] = 1
        out = np.add.reduceat(x * mask[ids], ptr[:-1])
        mask[self.terms[item]] = 0
        return out


def postings(texts: DataFrame, asked) -> DataFrame:
    """(doc_id, n, ids, tfs): each document's number of terms, and its counts of the asked terms."""

    def post(batches):
        known = asked.value.vocabulary.get
        for b in slices(batches, 64):
            out = []
            for doc, text in zip(column(b, "doc_id"), column(b, "text"), strict=True):
                found = alnum_words(text)
                if found:
                    n = len(found)
                    counts = Counter(map(known, found))
                    counts.pop(None, None)
                    ids = np.array(sorted(counts), np.int32)
                    out.append((doc, n, ids.tobytes(), np.array([counts[i] for i in ids.tolist()], np.int32).tobytes()))
            yield rows(_POSTED, list(zip(*out, strict=True)) or [[] for _ in _POSTED])

    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(post, "doc_id long, n long, ids binary, tfs binary")


def document_frequencies(posted: DataFrame, width: int) -> np.ndarray:
    """The number of documents that hold each term; every task sends one sum a term."""

    def count(batches):
        df = np.zeros(width, np.int64)
        for b in batches:
            df += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int32), minlength=width)
        some = np.flatnonzero(df)
        for i in range(0, len(some), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(some[i : i + 65_536]), pa.array(df[some[i : i + 65_536]])], names=["term", "df"])

    found = posted.select("ids").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row a term of the block
    out = np.zeros(width, np.int64)
    out[found["term"].to_numpy()] = found["df"].to_numpy()
    return out


def _weighted(asked: Asked, n_docs: int, length: int, n, ids, tfs):
    """Packed rows with the terms of no weight gone: those that are left, their m, and their ids and tfs."""
    kept = []
    for k, (size, i, t) in enumerate(zip(n, ids, tfs, strict=True)):
        i, t = np.frombuffer(i, np.int32), np.frombuffer(t, np.int32)
        some = asked.weights[i] > 0
        if some.any():
            kept.append((k, 100 - 90 + (90 * size * n_docs) // length, i[some], t[some]))
    return kept


def _vectors(asked: Asked, m: np.ndarray, ids: list[np.ndarray], tfs: list[np.ndarray]) -> Sparse:
    size = np.array([len(i) for i in ids])
    flat, t = np.concatenate(ids), np.concatenate(tfs).astype(np.int64)
    return Sparse(np.concatenate([[0], np.cumsum(size)]), flat, asked.weights[flat] * impacts(t, np.repeat(m, size)))


def placed(posted: DataFrame, asked, upper, n_docs: int, length: int) -> DataFrame:
    """The rows that can score, with a key of their vectors and their anchors in the upper tree."""

    def place(batches):
        a, tree = asked.value, upper.value
        for b in slices(batches, 1_024):
            docs = column(b, "doc_id")
            kept = _weighted(a, n_docs, length, *(column(b, c) for c in ("n", "ids", "tfs")))
            if not kept:
                continue
            at, m, ids, tfs = zip(*kept, strict=True)
            anchor = tree.anchors(_vectors(a, np.array(m), ids, tfs), a.width)
            keys = [xxhash.xxh3_128_digest(k.to_bytes(8, "little", signed=True) + i.tobytes() + t.tobytes()) for k, i, t in zip(m, ids, tfs, strict=True)]
            yield rows(_PLACED, [keys, anchor, [len(i) for i in ids], [docs[k] for k in at], m, [i.tobytes() for i in ids], [t.tobytes() for t in tfs]])

    return posted.mapInArrow(place, "key binary, anchor int, size long, doc_id long, m long, ids binary, tfs binary")


def entries(found: DataFrame, k: int) -> DataFrame:
    """(anchor, size, m, ids, tfs, docs): one row a vector, with its k smallest doc_ids."""
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.asc_nulls_last("doc_id")))
    some = found.withColumn("place", place).where(F.col("place") <= k)
    docs = F.transform(F.sort_array(F.collect_list(F.struct("place", "doc_id"))), lambda d: d["doc_id"])
    return some.groupBy("key").agg(*(F.first(c).alias(c) for c in ("anchor", "size", "m", "ids", "tfs")), docs.alias("docs"))


def trees(kept: DataFrame, asked, k: int) -> DataFrame:
    """A row for each block: its ball tree, and scores of the leaf that looks best to each item."""
    spark = kept.sparkSession
    sizes = kept.groupBy("anchor").agg(F.count("*").alias("n"), F.sum("size").alias("terms")).collect()  # at most 2 * ANCHORS rows
    parts = F.broadcast(spark.createDataFrame([(r["anchor"], max(math.ceil(r["n"] / BLOCK), math.ceil(r["terms"] / WIDE))) for r in sizes], "anchor int, parts int"))
    dealt = kept.join(parts, "anchor").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))

    def build(table: pa.Table) -> pa.Table:
        a = asked.value
        ids, tfs = ([np.frombuffer(x, np.int32) for x in table[c].to_pylist()] for c in ("ids", "tfs"))
        m = _vectors(a, table["m"].to_numpy(), ids, tfs)
        order, nodes, radii, c_ptr, c_ids, c = ball_tree(m, a.width)
        m, docs = m.take(order), [table["docs"][i].as_py() for i in order.tolist()]
        doc_ptr = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        flat = [x for d in docs for x in d]
        leaves = np.flatnonzero(nodes[:, 2] < 0)
        first = leaves[np.argmax(a.bounds(radii, c_ptr, c_ids, c)[leaves], axis=0)]
        mask, seeds, items = np.zeros(a.width, np.int64), [], []
        for item, leaf in enumerate(first.tolist()):
            start, end = nodes[leaf, :2]
            s = a.scores(mask, item, m.ptr[start : end + 1] - m.ptr[start], m.ids[m.ptr[start] : m.ptr[end]], m.x[m.ptr[start] : m.ptr[end]])
            s = np.sort(np.repeat(s, np.diff(doc_ptr[start : end + 1])))[::-1][:k]
            seeds.append(s[s > 0])
            items.append(np.full(len(seeds[-1]), item, np.int64))
        packed = [m.ptr, m.ids, m.x, doc_ptr, np.array([0 if x is None else x for x in flat], np.int64), np.array([x is not None for x in flat]), nodes, radii, c_ptr, c_ids, c, np.concatenate(items), np.concatenate(seeds)]
        return pa.table([[x.tobytes()] for x in packed], schema=_TREE)

    return dealt.select("anchor", "part", "m", "ids", "tfs", "docs").groupBy("anchor", "part").applyInArrow(build, ", ".join(f"{n} binary" for n in _TREE.names))


def floors(blocks: DataFrame, asked: Asked, k: int) -> np.ndarray:
    """The k-th best of each item's seeds; 0 where there are fewer."""

    def explode(batches):
        for b in slices(batches, 16):
            for items, seeds in zip(column(b, "seed_items"), column(b, "seeds"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(items, np.int64)), pa.array(np.frombuffer(seeds, np.int64))], names=["item", "score"])

    found = blocks.select("seed_items", "seeds").mapInArrow(explode, "item long, score long")
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).where(F.col("place") == k)
    out = np.zeros(len(asked.terms), np.int64)
    for r in found.collect():  # a row an item of the block at most
        out[r["item"]] = r["score"]
    return out


def best_first(a: Asked, item: int, bounds: np.ndarray, nodes, leaf_scores, ids, floor: int, k: int) -> list[tuple[int, tuple[bool, int]]]:
    """The (score, id) of the k best rows of a tree that reach the floor, subtrees by descending bound."""
    heap, best = [(-bounds[0, item], 0)], []
    least = max(floor, 1)
    while heap:
        bound, node = heapq.heappop(heap)
        if -bound < least:
            break
        start, end, left, right = nodes[node].tolist()
        if left >= 0:
            for child in (left, right):
                if bounds[child, item] >= least:
                    heapq.heappush(heap, (-bounds[child, item], child))
            continue
        scores = leaf_scores(item, start, end)
        some = np.flatnonzero(scores >= least)
        if len(some):
            best += [(-int(scores[i]), key) for i in some.tolist() for key in ids(start + i)]
            best = sorted(best)[:k]
            if len(best) == k:
                least = max(least, -best[-1][0])
    return best


def hits(blocks: DataFrame, asked, low, k: int) -> DataFrame:
    """(item, doc_id, score): the best rows of every block that reach the items' floors."""

    def find(batches):
        a, floor = asked.value, low.value
        mask = np.zeros(a.width, np.int64)
        kinds = {"ptr": np.int64, "ids": np.int32, "x": np.int64, "doc_ptr": np.int64, "docs": np.int64, "named": bool, "nodes": np.int64, "radius": np.float64, "c_ptr": np.int64, "c_ids": np.int32, "c": np.float32}
        for b in slices(batches, 1):
            t = {n: np.frombuffer(column(b, n)[0], kind) for n, kind in kinds.items()}
            nodes, ptr = t["nodes"].reshape(-1, 4), t["ptr"]
            bounds = a.bounds(t["radius"], t["c_ptr"], t["c_ids"], t["c"])
            leaf = lambda item, s, e: a.scores(mask, item, ptr[s : e + 1] - ptr[s], t["ids"][ptr[s] : ptr[e]], t["x"][ptr[s] : ptr[e]])  # noqa: B023, E731
            keys = lambda i: [(not t["named"][d], int(t["docs"][d])) for d in range(t["doc_ptr"][i], t["doc_ptr"][i + 1])]  # noqa: B023, E731
            out = [(item, d if not none else None, -s) for item in np.flatnonzero(bounds[0] >= np.maximum(floor, 1)).tolist() for s, (none, d) in best_first(a, item, bounds, nodes, leaf, keys, int(floor[item]), k)]
            yield rows(_HIT, list(zip(*out, strict=True)) or [[] for _ in _HIT])

    return blocks.drop("seed_items", "seeds").mapInArrow(find, "item long, doc_id long, score long")


def _search_block(texts: DataFrame, a: Asked, k: int, scratch: Scratch) -> DataFrame | None:
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(a)
    posted = scratch.keep(postings(texts, sent))
    n_docs, length = posted.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    df = document_frequencies(posted, a.width)
    a.weights = np.array([weight(n_docs, d) if d else 0 for d in df.tolist()], np.int64)
    sent = spark.sparkContext.broadcast(a)
    share = math.ceil(min(1.0, SAMPLE / n_docs) * (1 << 40))
    short = F.octet_length("ids").between(4, 4 * SHORT)
    sample = posted.where(short & (F.pmod(F.xxhash64("ids", "tfs"), F.lit(1 << 40)) < share)).limit(SAMPLE).toArrow()  # at most SAMPLE * SHORT terms
    kept = _weighted(a, n_docs, length, *(sample[c].to_pylist() for c in ("n", "ids", "tfs")))
    m = _vectors(a, np.array([x[1] for x in kept]), [x[2] for x in kept], [x[3] for x in kept]) if kept else Sparse(np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))
    upper = spark.sparkContext.broadcast(Upper(m, a.width, min(ANCHORS, 1 << max(0, math.ceil(n_docs / BLOCK) - 1).bit_length())))
    every = scratch.keep(entries(placed(posted, sent, upper, n_docs, length), k))
    blocks = scratch.keep(trees(every, sent, k))
    low = spark.sparkContext.broadcast(floors(blocks, a, k))
    return _named(scratch.keep(hits(blocks, sent, low, k)), a)


def _named(found: DataFrame, a: Asked) -> DataFrame:
    names = found.sparkSession.createDataFrame(list(enumerate(a.names)), "item long, name long")
    return found.join(F.broadcast(names), "item").select(F.col("name").alias("item"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, best first."""
    spark = docs.sparkSession

    def terms_of(batches):
        for b in slices(batches, 256):
            found = [sorted(set(alnum_words(t))) for t in column(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.binary())), pa.array([len(f) for f in found], pa.int64())], names=["item", "item_id", "terms", "n"])

    stated = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id"), "text")
    stated = cut(stated.mapInArrow(terms_of, f"item long, item_id {items.schema['item_id'].dataType.simpleString()}, terms array<binary>, n long").where("n > 0"))
    parts = max(1, math.ceil((stated.agg(F.sum("n")).first()[0] or 0) / TERMS))
    out = None
    with Scratch(spark) as scratch:
        for part in range(parts):
            own = stated.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).select("item", "terms").orderBy("item").collect()  # about TERMS terms
            if not own:
                continue
            with Scratch(spark) as inner:
                found = _search_block(docs, Asked([(r["item"], [bytes(t) for t in r["terms"]]) for r in own]), k, inner)
                if found is not None:
                    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
                    found = scratch.keep(found.withColumn("rank", rank).where(F.col("rank") <= k))
                    out = found if out is None else out.unionByName(found)
        if out is None:
            none = spark.createDataFrame([], "item long, doc_id long, score long, rank int")
            return stated.join(none, "item").select("item_id", "rank", "doc_id", "score")
        return cut(out.join(stated.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score"))


_term = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
with d as (select doc_id, row_number() over () as row_id, {_term} as terms from documents where text is not null), sized as (select doc_id, row_id, len(terms) as n, terms from d where len(terms) > 0),
total as (select count(*)::bigint as docs, sum(n)::bigint as length from sized), posted as (select row_id, any_value(doc_id) as doc_id, any_value(n) as n, term, count(*)::bigint as tf from (select row_id, doc_id, n, unnest(terms) as term from sized) group by row_id, term),
asked as (select distinct item_id, unnest({_term}) as term from benchmark where text is not null),
weights as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w from posted, total where term in (select term from asked) group by term, docs),
scored as (select item_id, row_id, any_value(doc_id) as doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // length)))) as bigint) as score from asked join weights using (term) join posted using (term), total group by 1, 2)
select item_id, cast(rank as integer) as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0) where rank <= {TOP}
"""
