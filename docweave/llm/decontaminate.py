"""Benchmark decontamination with a positional inverted index.

Method: the words of all benchmark windows are counted over the whole corpus; each window is looked up from its rarest
term on. The index stores, for each document, the positions of the benchmark's terms at and around every occurrence
of such a rarest term: its posting lists. A window's places are the intersection of its terms' lists, each
less the term's offset in the window, taken from the rarest term to the commonest until nothing is left: exact phrase matches.
Where a window has none in a document, the words around each occurrence of its rarest term are searched for its other
terms: at least ``near`` of them make a proximity match. Documents are dealt over all tasks, so no term's list meets in one.

Defined results: a text without words, or a null text, has no windows and no hits; an item of fewer than ``k`` words is
one window; repeated rows are judged each for itself; repeated item ids count once; a null item_id is left out; extra
columns are not read; an empty table on either side gives no matches. Benchmarks of more than ``BLOCK`` windows are looked up
block by block (one item may lie in several), so that what is broadcast stays bounded; each block reads the texts twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MEMO_LIMIT, alnum_words, column, cut, numbered, numbered_texts, raw, rows, slices, texts_of, unpacked

#: Words of a window; windows that are looked up at once; terms of a window that make a proximity match.
WINDOW, BLOCK, NEAR = 13, 200_000, 10

WINDOWS = pa.schema([("item_id", pa.int64()), ("window", pa.list_(pa.binary()))])
COUNTS = pa.schema([("term", pa.int32()), ("n", pa.int64())])
INDEX = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("terms", pa.binary()), ("places", pa.binary())])
MATCHES = pa.schema([("uid", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("kind", pa.string())])


class Numbers(dict):
    """word -> its number in a vocabulary, or -1."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_LIMIT:
            self.clear()
        n = self[word] = self.vocabulary.get(word, -1)
        return n

    def of(self, text: bytes) -> np.ndarray:
        words = alnum_words(text)
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def windows_of(benchmark: DataFrame, k: int = WINDOW) -> DataFrame:
    """(item_id, window): the distinct windows of each item."""

    def cut_up(batches):
        for b in slices(batches):
            for item, text in zip(column(b, "item_id"), column(b, "text"), strict=True):
                w = alnum_words(text)
                found = list(dict.fromkeys(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))) if w else []
                yield rows(WINDOWS, [[item] * len(found), [list(x) for x in found]])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null").mapInArrow(cut_up, "item_id long, window array<binary>").distinct()


def counts_of(docs: DataFrame, sent) -> dict[int, int]:
    """How often each term of the vocabulary stands in the corpus."""

    def count(batches):
        numbers, total = Numbers(sent.value), np.zeros(len(sent.value), np.int64)
        for b in slices(batches):
            for t in column(b, "packed"):
                ids = numbers.of(raw(t))
                np.add.at(total, ids[ids >= 0], 1)
        found = np.flatnonzero(total)
        yield rows(COUNTS, [found.astype(np.int32), total[found]])

    return {r.term: r.n for r in docs.select("packed").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}


def index_of(texts: DataFrame, sent, anchors, k: int) -> DataFrame:
    """(uid, doc_id, n_words, terms, places): the postings at and around the anchor terms, as packed 32-bit integers in the order of place."""

    def post(batches):
        numbers = Numbers(sent.value)
        wanted = np.zeros(len(sent.value) + 1, bool)
        wanted[anchors.value] = True  # the last entry stands for -1, no term
        for b in slices(batches):
            out = []
            for uid, doc, text in zip(*(column(b, c) for c in ("uid", "doc_id", "packed")), strict=True):
                ids = numbers.of(raw(text))
                at = np.flatnonzero(wanted[ids])
                if not len(at):
                    out.append((uid, doc, len(ids), None, None))
                    continue
                edge = np.zeros(len(ids) + 1, np.int32)
                np.add.at(edge, np.maximum(at - k + 1, 0), 1)
                np.add.at(edge, np.minimum(at + k, len(ids)), -1)
                places = np.flatnonzero((np.cumsum(edge)[:-1] > 0) & (ids >= 0)).astype("<i4")
                out.append((uid, doc, len(ids), ids[places].astype("<i4").tobytes(), places.tobytes()))
            for i in range(0, len(out), 512):
                yield rows(INDEX, list(zip(*out[i : i + 512], strict=True)))

    return texts.select("uid", "doc_id", "packed").mapInArrow(post, "uid long, doc_id long, n_words long, terms binary, places binary")


def lookups(windows: list, counted: dict[int, int], least: int) -> dict[int, list]:
    """rarest term -> windows (item, terms from the rarest on, their offsets, length, terms for proximity) that have it.

    A window with a term that the corpus lacks has no exact match; it stays for proximity if ``least`` of its terms occur.
    """
    out: dict[int, list] = {}
    for item, ids in windows:
        order = sorted((i for i in range(len(ids)) if ids[i] in counted), key=lambda i: (counted[ids[i]], ids[i], i))
        terms = list(dict.fromkeys(ids[i] for i in order))
        if len(order) == len(ids) or len(terms) >= least:
            whole = [(ids[i], i) for i in order] if len(order) == len(ids) else []
            out.setdefault(ids[order[0]], []).append((item, whole, len(ids), terms))
    return out


def intersected(lists: dict[int, np.ndarray], window: list[tuple[int, int]]) -> np.ndarray:
    """The starts of the window (term, offset) in a document with these posting lists (term -> rising places)."""
    starts = np.empty(0, np.int64)
    for n, (term, offset) in enumerate(window):
        own = lists.get(term)
        if own is None:
            return starts[:0]
        if not n:
            starts = own - offset
        else:
            at = np.searchsorted(own, starts + offset)
            starts = starts[own[np.minimum(at, len(own) - 1)] == starts + offset]
        if not len(starts):
            break
    return starts


def around(lists: dict[int, np.ndarray], terms: list[int], k: int, least: int) -> np.ndarray:
    """The places of the first term that have at least ``least`` of the terms within ``k`` - 1 words."""
    own = lists[terms[0]]
    n = np.zeros(len(own), np.int64)
    for left, t in enumerate(terms, 1 - len(terms)):
        if (of := lists.get(t)) is not None:
            n += np.searchsorted(of, own + k) > np.searchsorted(of, own - k + 1)
        if n.max() - left < least:
            return own[:0]
    return own[n >= least]


def search(texts: DataFrame, benchmark: DataFrame, k: int = WINDOW, near: int | None = NEAR, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(uid, doc_id, n_words) of the texts (uid, doc_id, packed), and the matches (uid, item_id, start, length, kind) in them.

    kind is ``phrase``, or ``proximity`` where a window has no phrase match in a document but at least ``near`` of its terms stand
    within ``k`` - 1 words of an occurrence of its rarest term (at ``start``; ``length`` is 1).
    """
    spark = texts.sparkSession
    windows = cut(windows_of(benchmark, k))
    blocks = max(1, -(-windows.count() // block))
    least, every, found = near or k + 1, None, None
    for i in range(blocks):
        part = [(r.item_id, r.window) for r in windows.where(F.pmod(F.hash("item_id", "window"), F.lit(blocks)) == i).toLocalIterator()]  # about ``block``
        words = sorted({bytes(w) for _, ws in part for w in ws})
        vocabulary = {w: n for n, w in enumerate(words)}
        sent = spark.sparkContext.broadcast(vocabulary)
        table = lookups([(item, [vocabulary[bytes(w)] for w in ws]) for item, ws in part], counts_of(texts, sent), least)
        index = cut(index_of(texts, sent, spark.sparkContext.broadcast(np.array(sorted(table), np.int64)), k))
        hit = matches(index.where("terms is not null").select("uid", "terms", "places"), spark.sparkContext.broadcast(table), k, least)
        every, found = index.select("uid", "doc_id", "n_words") if every is None else every, hit if found is None else found.unionByName(hit)
    return every, found


def matches(index: DataFrame, sent, k: int, least: int) -> DataFrame:
    """The matches of the windows of one block, by intersecting posting lists."""

    def meet(batches):
        for b in slices(batches):
            out = []
            for uid, terms, places in zip(*(column(b, c) for c in ("uid", "terms", "places")), strict=True):
                terms, places = np.frombuffer(terms, "<i4"), np.frombuffer(places, "<i4").astype(np.int64)
                order = np.argsort(terms, kind="stable")
                kinds, first = np.unique(terms[order], return_index=True)
                lists = dict(zip(kinds.tolist(), np.split(places[order], first[1:]), strict=True))
                for term in lists.keys() & sent.value.keys():
                    for item, window, length, distinct in sent.value[term]:
                        starts = intersected(lists, window)
                        out += [(uid, item, s, length, "phrase") for s in starts.tolist()]
                        if not len(starts) and len(distinct) >= least:
                            out += [(uid, item, s, 1, "proximity") for s in around(lists, distinct, k, least).tolist()]
            for i in range(0, len(out), 50_000):
                yield rows(MATCHES, list(zip(*out[i : i + 50_000], strict=True)))

    return index.mapInArrow(meet, "uid long, item_id long, start long, length long, kind string")


def report(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items) of each document.

    ``n_near_items``: items with a proximity match and without a phrase match.
    """
    return judged(numbered_texts(docs), benchmark, k).drop("uid")


def judged(texts: DataFrame, benchmark: DataFrame, k: int = WINDOW) -> DataFrame:
    """The report's rows with ``uid``, for numbered texts (uid, doc_id, packed)."""
    every, found = search(texts, benchmark, k)
    found = cut(found)
    exact = found.where("kind = 'phrase'")
    order = Window.partitionBy("uid").orderBy("start", "length")
    before = F.max(F.col("start") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = exact.select("uid", "start", "length").distinct().withColumn("new", F.col("start") + F.col("length") - F.greatest("start", F.coalesce(before, F.lit(0))))
    hit = spans.groupBy("uid").agg(F.sum(F.greatest("new", F.lit(0))).cast("long").alias("n_hit"))
    of_item = found.groupBy("uid", F.col("item_id").cast("string").alias("item")).agg(F.max(F.col("kind") == "phrase").alias("exact"))
    items = of_item.groupBy("uid").agg(F.sort_array(F.collect_list(F.when(F.col("exact"), F.col("item")))).alias("items"), F.count_if(~F.col("exact")).alias("n_near_items"))
    out = every.join(items.join(hit, "uid", "left"), "uid", "left")
    n_hit, listed = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    contaminated = (n_hit > 0) & (20 * n_hit >= F.col("n_words"))
    return out.select("uid", "doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), contaminated.alias("contaminated"), F.coalesce("n_near_items", F.lit(0)).cast("long").alias("n_near_items"))


def clean(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW) -> DataFrame:
    """``docs`` without the contaminated rows; rows without an id, or with the same one, are judged each by its own text."""
    every, uid = numbered(docs)
    bad = judged(texts_of(every, uid), benchmark, k).where("contaminated").select(F.col("uid").alias(uid))
    return unpacked(every.join(bad, uid, "left_anti"), docs.schema)
