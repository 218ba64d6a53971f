"""Removal of repeated byte strings by prefix-free parsing.

Rolling-hash triggers create the phrases: of the 32-byte strings in a 100-byte window, the one of the least hash is its
trigger, so equal windows have equal triggers at equal places and every window belongs to one phrase (the run of
windows that share a trigger occurrence). A phrase's key hashes all bytes of its windows, so equal keys are equal
phrases with equal continuations: the dictionary is the distinct keys, the parse their occurrences in corpus order.

* Triggers that stand once in the corpus cannot lie in a repeated window; their phrases are dropped.
* Of equal phrases, all but the first in corpus order are repeats as a whole.
* Where one trigger stands in several different phrases, the suffixes of these dictionary phrases are compared too,
  first occurrences only: up to ``FEW`` phrases side by side, by how far they agree to the left and the right of the
  trigger; more of them by grouping their single windows, so that no group of phrases is brought together.

Order is (doc_id, row, start). Defined results: null and empty texts, and texts of fewer than 100 bytes, lose nothing;
repeated rows are documents of their own in the order of their row number; rows without a doc_id come first; very long
texts are parsed whole, in blocks; an empty table gives no rows; extra columns are not read. Windows are equal when a 64-bit trigger hash and a 64-bit window hash are equal. A phrase across
the edge of two blocks of a long text is two phrases of one trigger occurrence, which are not compared with each other.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column, cut, free, mix, numbered_texts, raw, rows, slices
from .sieve import KEPT, buckets_for, packed, passes, repeated, sieve

LENGTH, TRIGGER = 100, 32
REACH = LENGTH - TRIGGER + 1
#: Phrases of one trigger that are compared side by side.
FEW = 16
#: Stands for a missing doc_id, before all others.
NO_ID = -(1 << 62)
#: Window starts of a long text that are worked on at once.
BLOCK = 1 << 19

_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0xD1342543DE82EF95

PHRASES = pa.schema([("trigger", pa.int64()), ("key", pa.int64()), ("id", pa.int64()), ("row", pa.int64()), ("span", pa.int64())])
EXPANDED = pa.schema([("trigger", pa.int64()), ("window", pa.int64()), ("id", pa.int64()), ("row", pa.int64()), ("place", pa.int64()), ("span", pa.int64()), ("left", pa.binary()), ("right", pa.binary())])
SPANS = pa.schema([("row", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


@functools.cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base of the hashes, and of its inverse."""
    return np.cumprod(np.full(n, _BASE, np.uint64)), np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))


def sums(d: np.ndarray) -> np.ndarray:
    """Sums of the polynomial of the bytes of ``d``: the hash of any string in it is made of two of them."""
    total = np.zeros(len(d) + 1, np.uint64)
    np.cumsum(_BYTES[d] * powers(BLOCK + LENGTH)[0][: len(d)], out=total[1:])
    return total


def windows(total: np.ndarray, at: np.ndarray | slice, width: int = LENGTH) -> np.ndarray:
    """Hashes of the strings of ``width`` bytes that start at the places ``at``."""
    return mix((total[width:][at] - total[:-width][at]) * powers(BLOCK + LENGTH)[1][: len(total) - width][at])


def least(h: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` windows, the place of its trigger: the leftmost least of the hashes' upper 40 bits."""
    low, w = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * w <= REACH:
        low, w = np.minimum(low[:-w], low[w:]), 2 * w
    return (np.minimum(low[:n], low[REACH - w : REACH - w + n]) & np.uint64((1 << 24) - 1)).astype(np.int64)


def triggers(raw: bytes):
    """(offset, sums, 32-byte hashes, lo, hi, trigger place) of a text's phrases, block by block."""
    d = np.frombuffer(raw, np.uint8)
    for at in range(0, len(d) - LENGTH + 1, BLOCK):
        total = sums(d[at : at + BLOCK + LENGTH - 1])
        h = windows(total, slice(None), TRIGGER)
        place = least(h, len(total) - LENGTH)
        lo = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        hi = np.append(lo[1:], len(place)) - 1
        yield at, total, h, lo, hi, place[lo]


def parse(raw: bytes):
    """``triggers`` with the hashes of all windows: (offset, 32-byte hashes, window hashes, lo, hi, trigger place)."""
    for at, total, h, lo, hi, place in triggers(raw):
        yield at, h, windows(total, slice(None)), lo, hi, place


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def packed_span(lo, hi, place):
    """First and last window start of a phrase and its trigger's place in one integer, ordered by the first."""
    return (lo << 16) | ((hi - lo) << 8) | (place - lo)


def parts(span):
    lo = span >> 16
    return lo, lo + ((span >> 8) & 255), lo + (span & 255)


def texts_of(docs: DataFrame) -> DataFrame:
    """(id, row, packed), written once: ``row`` tells rows of the same id apart."""
    return numbered_texts(docs).select(F.col("doc_id").alias("id"), F.col("uid").alias("row"), "packed")


def repeated_triggers(texts: DataFrame) -> DataFrame:
    """(key): the upper bits of the hashes of triggers that stand twice; a hint only."""
    buckets = buckets_for(texts)

    def count(batches):
        held, size = [], 0
        for b in slices(batches):
            for text in column(b, "packed"):
                for _, _, h, _, _, place in triggers(raw(text)):
                    held.append(h[place])
                    size += len(place)
            if size > 1_000_000:
                yield from packed(np.concatenate(held), buckets)
                held, size = [], 0
        if size:
            yield from packed(np.concatenate(held), buckets)

    return repeated(texts.select("packed").mapInArrow(count, "bucket long, keys binary"))


def phrases(texts: DataFrame, bitmap) -> DataFrame:
    """The occurrences of phrases whose trigger passes the bitmap."""

    def find(batches):
        for b in slices(batches):
            out, size = [], 0
            for i, row, text in zip(*(column(b, c) for c in ("id", "row", "packed")), strict=True):
                for at, total, h, lo, hi, place in triggers(raw(text)):
                    k = np.flatnonzero(passes(bitmap.value, h[place] >> np.uint64(64 - KEPT)))
                    if not len(k):
                        continue
                    lo, hi, place = lo[k], hi[k], place[k]
                    key = mix(mix(windows(total, lo) + np.uint64(7) * windows(total, hi)) + (place - lo).astype(np.uint64) * np.uint64(1 << 20) + (hi - lo).astype(np.uint64))
                    out.append((signed(h[place]), signed(key), np.full(len(k), NO_ID if i is None else i), np.full(len(k), row), packed_span(lo + at, hi + at, place + at)))
                    size += len(k)
            if out:
                whole = [np.concatenate(c) for c in zip(*out, strict=True)]
                for s in range(0, size, 100_000):
                    yield rows(PHRASES, [c[s : s + 100_000] for c in whole])

    return texts.mapInArrow(find, "trigger long, key long, id long, row long, span long")


def with_lists(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts with their wanted phrases."""
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("trigger", "span", (F.col("phrases") <= FEW).alias("few"))).alias("ranges"))
    return texts.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "row", "packed").join(lists, "row").select("id", "row", "packed", "ranges")


def expanded(listed: DataFrame, side: bool) -> DataFrame:
    """The wanted phrases of triggers with few phrases (``side``) or with many, ready to be compared.

    Of a trigger with few phrases: each phrase with the bytes to the left and the right of the trigger, as many as a
    window can hold. Of others: one row for each window (``window`` is its hash, ``place`` its start).
    """
    def expand(batches):
        for b in slices(batches, 64):
            ranges_of, out, many = b.column(b.schema.get_field_index("ranges")), [], []
            for j, (i, row, packed) in enumerate(zip(*(column(b, c) for c in ("id", "row", "packed")), strict=True)):
                text = raw(packed)
                r = ranges_of[j].values
                trigger, span, few = r.field(0).to_numpy(), r.field(1).to_numpy(), r.field(2).to_numpy(zero_copy_only=False)
                lo, hi, place = parts(span)
                for k in np.flatnonzero(few) if side else ():
                    p = int(place[k])
                    out.append((int(trigger[k]), None, i, row, p, int(span[k]), text[max(0, p - REACH + 1) : p][::-1], text[p + TRIGGER : p + LENGTH]))
                trigger, lo, hi = trigger[~few], lo[~few], hi[~few]
                for at in range(0, len(text) - LENGTH + 1 if len(lo) and not side else 0, BLOCK):
                    k = np.flatnonzero((lo >= at) & (lo < min(at + BLOCK, len(text) - LENGTH + 1)))
                    if len(k):
                        total = sums(np.frombuffer(text, np.uint8)[at : at + BLOCK + LENGTH - 1])
                        n = hi[k] - lo[k] + 1
                        starts = np.repeat(lo[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                        many.append((np.repeat(trigger[k], n), signed(windows(total, starts - at)), np.full(len(starts), i), np.full(len(starts), row), starts))
            for s in range(0, len(out), 20_000):
                yield rows(EXPANDED, list(zip(*out[s : s + 20_000], strict=True)))
            for part in many:
                none = pa.nulls(len(part[0]), pa.int64())
                yield rows(EXPANDED, [*part, none, pa.nulls(len(part[0]), pa.binary()), pa.nulls(len(part[0]), pa.binary())])

    return listed.mapInArrow(expand, "trigger long, window long, id long, row long, place long, span long, left binary, right binary")


def agree(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def side_by_side(found: DataFrame) -> DataFrame:
    """(row, lo, hi): windows of a phrase that stand in an earlier phrase of the same trigger."""
    grouped = found.groupBy("trigger").agg(F.collect_list(F.struct("id", "row", "place", "span", "left", "right")).alias("phrases"))

    def compare(batches):
        for b in slices(batches, 2_048):
            out = set()
            for phrases in column(b, "phrases"):
                phrases.sort(key=lambda p: (p["id"], p["row"], p["place"]))
                for k, p in enumerate(phrases):
                    first, last, _ = parts(p["span"])
                    for q in phrases[:k]:
                        if (q["row"], q["place"]) == (p["row"], p["place"]):
                            continue  # the phrase across a block's edge, in two parts
                        most, least_ = agree(p["left"], q["left"]), REACH - 1 - agree(p["right"], q["right"])
                        lo, hi = max(first, p["place"] - most), min(last, p["place"] - least_)
                        if lo <= hi:
                            out.add((p["row"], lo, hi))
            yield rows(SPANS, list(zip(*out, strict=True)) or [[] for _ in SPANS])

    return grouped.select("phrases").mapInArrow(compare, "row long, lo long, hi long")


def with_bits(texts: DataFrame, bitmap) -> DataFrame:
    """The texts whose row may be among those of the bitmap."""

    def keep(batches):
        for b in batches:
            yield b.filter(pa.array(passes(bitmap.value, b.column(1).to_numpy())))

    return texts.mapInArrow(keep, "id long, row long, packed binary")


def with_keys(found: DataFrame, bitmap) -> DataFrame:
    """The phrases whose key may be among those of the bitmap."""

    def keep(batches):
        for b in batches:
            yield b.filter(pa.array(passes(bitmap.value, b.column(1).to_numpy())))

    return found.select("trigger", "key", "row", "span").mapInArrow(keep, "trigger long, key long, row long, span long")


def spans(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """The repeats (row, lo, hi) in the texts (id, row, packed): every window that starts in lo..hi is a repeat."""
    with Scratch(texts.sparkSession) as first:  # phrases and dictionary go before texts are shuffled
        found = first.keep(phrases(texts, sieve(cut(repeated_triggers(texts)), "key")))
        free(texts.sparkSession)
        # Corpus order of equal phrases: the first one stays, the others are repeats from end to end.
        dictionary = first.keep(found.groupBy("trigger", "key").agg(F.min(F.struct("id", "row", "span")).alias("first"), F.count("*").alias("n")).select("trigger", "key", "first.*", "n"))
        free(texts.sparkSession)
        firsts = dictionary.where("n > 1").select("trigger", "key", F.col("row").alias("first_row"), F.col("span").alias("first_span"))
        # adaptive execution splits the partition of a phrase that very many texts have
        later = with_keys(found, sieve(firsts, "key")).join(firsts, ["trigger", "key"]).where("row <> first_row or span <> first_span")
        later = scratch.keep(later.select("row", F.expr("shiftright(span, 16)").alias("lo"), F.expr("shiftright(span, 16) + (shiftright(span, 8) & 255)").alias("hi")))
        free(texts.sparkSession)
        several = dictionary.groupBy("trigger").agg(F.count("*").alias("phrases")).where("phrases > 1")
        wanted = scratch.keep(dictionary.select("trigger", "row", "span").join(several, "trigger"))
    free(texts.sparkSession)
    # Suffixes of the dictionary's phrases that share a trigger.
    listed = with_lists(with_bits(texts, sieve(wanted, "row")), wanted)  # both branches read the same shuffle
    beside = side_by_side(expanded(listed, True))
    single = expanded(listed, False).select("trigger", "window", "id", "row", "place")
    first = single.groupBy("trigger", "window").agg(F.min(F.struct("id", "row", "place")).alias("first"), F.count("*").alias("n")).where("n > 1")
    more = single.join(first.select("trigger", "window", "first"), ["trigger", "window"]).where("row <> first.row or place <> first.place")
    return later.unionByName(beside).unionByName(more.select("row", F.col("place").alias("lo"), F.col("place").alias("hi")))


def runs(repeats: DataFrame) -> DataFrame:
    """(row, runs): the maximal runs of repeated bytes of each text, as packed pairs of start and end."""
    schema = pa.schema([("row", pa.int64()), ("runs", pa.binary())])

    def merge(batches):
        for b in slices(batches):
            ranges_of, out = b.column(b.schema.get_field_index("marks")), []
            for j in range(b.num_rows):
                r = ranges_of[j].values
                lo, end = r.field(0).to_numpy(), r.field(1).to_numpy() + LENGTH
                order = np.argsort(lo, kind="stable")
                lo, end = lo[order], np.maximum.accumulate(end[order])
                first = np.append(True, lo[1:] > end[:-1])
                last = np.append(first[1:], True)
                out.append(np.column_stack([lo[first], end[last]]).astype("<i8").tobytes())
            yield rows(schema, [b.column(0), out])

    return repeats.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("marks")).mapInArrow(merge, "row long, runs binary")


def remove(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document."""
    texts = texts_of(docs)
    with Scratch(docs.sparkSession) as scratch:
        marks = cut(runs(spans(texts, scratch)))
    free(docs.sparkSession)
    bitmap = sieve(marks, "row")

    def strike(batches):
        for b in slices(batches):
            out = []
            for i, packed, found in zip(*(column(b, c) for c in ("id", "packed", "runs")), strict=True):
                text, kept, at = raw(packed), [], 0
                own = np.frombuffer(found or b"", "<i8").reshape(-1, 2).tolist()
                for lo, end in own:
                    kept.append(text[at:lo])
                    at = end
                rest = b"".join([*kept, text[at:]])
                out.append((i, len(text), len(text) - len(rest), len(own), hashlib.sha256(rest).hexdigest()))
            yield rows(RESULT, list(zip(*out, strict=True)) or [[] for _ in RESULT])

    def whole(batches):
        for b in slices(batches):
            b = b.filter(pa.array(~passes(bitmap.value, b.column(1).to_numpy())))
            texts = list(map(raw, column(b, "packed")))
            yield rows(RESULT, [b.column(0), [len(x) for x in texts], [0] * len(texts), [0] * len(texts), [hashlib.sha256(x).hexdigest() for x in texts]])

    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    touched = with_bits(texts, bitmap).join(marks, "row", "left").select("id", "packed", "runs")
    return texts.mapInArrow(whole, kinds).unionByName(touched.mapInArrow(strike, kinds))
