"""Byte-level BPE encoding and decoding of whole texts.

Method: overlapping chunk encoding. A long text is cut into chunks that overlap; each chunk is pre-tokenised in a
task of its own; two neighbours are stitched at the first pre-token start that both found in their overlap, for from
there on both go on alike; then the pieces are encoded. Texts of one chunk skip the cutting and the shuffle.

Defined results: a null text counts as empty and gives no ids; every input row gives one output row, so repeated rows
repeat; input columns other than ``doc_id`` and ``text`` are not read; an empty table gives no rows. If neighbours share no
start in their overlap (a word longer than it), these chunks are pre-tokenised once more as one piece from the last certain
start on, and that piece grows by its own size each time, so the ids stay right and the work stays linear.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, rows, slices

#: Characters of a chunk without its overlap, and of the overlap with the next chunk.
CHUNK, OVERLAP = 32_768, 1_024
#: Bytes from which on a piece is merged with a heap; pieces that a worker's memo keeps, some 200 bytes each, before it starts anew.
SCANNED, KEPT = 48, 400_000

IDS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
CHUNKS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int32()), ("start", pa.int64()), ("text", pa.string())])
STARTS = pa.schema([*CHUNKS, ("starts", pa.binary())])
BYTES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("bytes", pa.binary())])


def load_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """token bytes -> id, from a file of ``base64 rank`` lines; the file is small and fixed, Spark's reader opens it."""
    lines = spark.read.text(path if ":" in path else f"file://{path}").collect()
    return {base64.b64decode(a): int(b) for a, b in (r.value.split() for r in lines if r.value.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: neighbours of the least rank merge first, the leftmost among equals."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n < SCANNED:
        return scanned(piece, ranks)
    ends, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = ends[i] if alive[i] else n
        if j >= n or ends[j] != end:
            continue  # one of the two parts has merged meanwhile
        alive[j], ends[i] = False, end
        if end < n:
            before[end] = i
            if (r := ranks.get(piece[i : ends[end]])) is not None:
                heapq.heappush(heap, (r, i, ends[end]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


def scanned(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As ``merge``, by a scan of all neighbours for each merge, which short pieces need less time for than a heap."""
    get, none = ranks.get, 1 << 62
    cuts = list(range(len(piece) + 1))
    found = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while found and (least := min(found)) < none:
        i = found.index(least)
        del cuts[i + 1], found[i]
        if i < len(found):
            found[i] = get(piece[cuts[i] : cuts[i + 2]], none)
        if i:
            found[i - 1] = get(piece[cuts[i - 1] : cuts[i + 1]], none)
    return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])]  # noqa: B905


class Pieces(dict):
    """pre-token -> its ids as little-endian 32-bit integers; grows to a bound."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        if len(self) > KEPT:
            self.clear()
        ids = np.array(merge(piece.encode("utf-8", "replace"), self.ranks), "<i4").tobytes()
        if len(piece) < 64:
            self[piece] = ids
        return ids

    def ids(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, pieces))


def stitched(chunks: list[dict], pattern, chunk: int) -> list[str]:
    """The pre-tokens of a text from those of its overlapping chunks, in order of their place."""
    pieces: list[str] = []
    parts: list[str] = []  # text not yet cut for good, from ``base`` on and up to ``end``
    base = end = 0
    starts = np.empty(0, np.int64)
    again, due = False, 0  # starts must be found anew, at the latest once the text reaches ``due``
    for k, c in enumerate(chunks):
        own = np.frombuffer(c["starts"], "<i4").astype(np.int64) + c["start"]
        parts.append(c["text"][end - c["start"] :])
        end = int(c["start"]) + len(c["text"])
        shared = np.intersect1d(starts, own[own > c["start"]], assume_unique=True)
        if not k:
            starts = own
        elif len(shared) and not again:
            starts = np.concatenate([starts[starts < shared[0]], own[own >= shared[0]]])
        else:
            if not again:
                again, due = True, base + 2 * (end - base)
            if end < due and k + 1 < len(chunks):
                continue
            parts = ["".join(parts)]
            starts, again = np.array([base + m.start() for m in pattern.finditer(parts[0])], np.int64), False
        # What lies before the last start of the part that no later chunk sees is certain.
        keep = max(base, int(c["start"]) + chunk)
        i = int(np.searchsorted(starts, keep, "right")) - 1
        if i > 0:
            text = "".join(parts)
            at = (starts[: i + 1] - base).tolist()
            pieces += [text[a:b] for a, b in zip(at, at[1:], strict=False)]
            parts, base, starts = [text[at[-1] :]], base + at[-1], starts[i:]
    text = "".join(parts)
    at = [*(starts - base).tolist(), len(text)]
    return pieces + [text[a:b] for a, b in zip(at, at[1:], strict=False)]


class Gather:
    """Byte strings by number, and their concatenation for many numbers at once."""

    def __init__(self, strings: dict[int, bytes]):
        n = max(strings, default=-1) + 1
        self.size = np.zeros(n, np.int64)
        for i, b in strings.items():
            self.size[i] = len(b)
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.bytes = np.frombuffer(b"".join(strings[i] for i in sorted(strings)), np.uint8)

    def joined(self, packed: bytes, stretch: int = 1 << 16) -> bytes:
        out = []
        for i in range(0, len(packed) // 4, stretch):
            ids = np.frombuffer(packed, "<i4", min(stretch, len(packed) // 4 - i), 4 * i)
            size = self.size[ids]
            shift = self.start[ids] - np.concatenate([[0], np.cumsum(size)[:-1]])
            out.append(self.bytes[np.repeat(shift, size) + np.arange(size.sum())].tobytes())
        return b"".join(out)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of each whole text, packed as little-endian 32-bit integers."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)  # one vocabulary: its size does not depend on the data
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def whole(batches):
        find, pieces = regex.compile(pattern).findall, Pieces(sent.value)
        for b in slices(batches):
            ids = [pieces.ids(find(t)) if t else b"" for t in column(b, "text")]
            yield rows(IDS, [b.column(0), [len(x) // 4 for x in ids], ids])

    def split(batches):
        for b in slices(batches):
            out = [(u, d, k, at, t[at : at + chunk + overlap]) for d, t, u in zip(*(column(b, c) for c in ("doc_id", "text", "uid")), strict=True) for k, at in enumerate(range(0, len(t), chunk))]
            for i in range(0, len(out), 256):
                yield rows(CHUNKS, list(zip(*out[i : i + 256], strict=True)))

    def starts(batches):
        find = regex.compile(pattern).finditer
        for b in slices(batches):
            yield rows(STARTS, [*b.columns, [np.fromiter((m.start() for m in find(t)), "<i4").tobytes() for t in column(b, "text")]])

    def stitch(batches):
        compiled, pieces = regex.compile(pattern), Pieces(sent.value)
        for b in slices(batches):
            ids = [pieces.ids(stitched(c, compiled, chunk)) for c in column(b, "chunks")]
            yield rows(IDS, [b.column(0), [len(x) // 4 for x in ids], ids])

    kind = "doc_id long, n_tokens long, ids binary"
    long = F.length("text") > chunk
    short = docs.where(F.col("text").isNull() | ~long).mapInArrow(whole, kind)
    parts = docs.where(long).withColumn("uid", F.monotonically_increasing_id()).mapInArrow(split, "uid long, doc_id long, k int, start long, text string")
    parts = parts.repartition("uid", "k").mapInArrow(starts, "uid long, doc_id long, k int, start long, text string, starts binary")
    texts = parts.groupBy("uid", "doc_id").agg(F.sort_array(F.collect_list(F.struct("k", "start", "text", "starts"))).alias("chunks"))
    return short.unionByName(texts.select("doc_id", "chunks").mapInArrow(stitch, kind))


def decode(tokens: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, n_tokens, ids, bytes): the raw bytes of all ids, one after another."""
    sent = tokens.sparkSession.sparkContext.broadcast({i: b for b, i in ranks.items()})

    def back(batches):
        tokens = Gather(sent.value)
        for b in slices(batches):
            yield rows(BYTES, [*b.columns, list(map(tokens.joined, column(b, "ids")))])

    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(back, "doc_id long, n_tokens long, ids binary, bytes binary")


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``decode``'s rows."""
    df = decoded.select("doc_id", "n_tokens", F.sha2("bytes", 256).alias("decoded_sha256"), "ids")

    def ordered(batches):
        most, numbers = -1, Gather({})
        for b in slices(batches):
            packed = column(b, "ids")
            if (top := max((int(np.frombuffer(x, "<i4").max()) for x in packed if x), default=-1)) > most:
                most, numbers = top, Gather({i: b"%d " % i for i in range(top + 1)})
            ids = [hashlib.sha256(numbers.joined(x)[:-1]).hexdigest() for x in packed]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.string()), b.column(2)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.mapInArrow(ordered, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
