"""A bitmap of bounded size that keeps most keys without a partner out of a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, rows, slices

#: log2 of the bits: by the number of keys, from 128 KB to 32 MB. A full bitmap lets every key pass; the exact join after it decides.
LEAST, MOST = 20, 28
#: Upper bits of a 64-bit key by which ``repeated`` tells keys apart.
KEPT = 47

PACKED = pa.schema([("bucket", pa.int64()), ("keys", pa.binary())])
KEYS = pa.schema([("key", pa.int64())])


def bits_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def sieve(df: DataFrame, key: str):
    """A broadcast bitmap with the bits of all values of ``key`` (long) of a cut ``df`` set; for ``passes``."""
    spark, bits = df.sparkSession, int(min(max(LEAST, 4 + df.count().bit_length()), MOST))

    def place(batches):
        seen = np.zeros(1 << (bits - 3), np.uint8)
        for b in batches:
            at = bits_of(b.column(0).drop_null().to_numpy(zero_copy_only=False), bits)
            np.bitwise_or.at(seen, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
        words = seen.view(np.int64)
        some = np.flatnonzero(words)
        for i in range(0, len(some), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(some[i : i + 65536]), pa.array(words[some[i : i + 65536]])], names=["place", "bits"])

    found = df.select(F.col(key).cast("long").alias("key")).mapInArrow(place, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()  # as large as the bitmap at most
    words = np.zeros(1 << (bits - 6), np.int64)
    words[found["place"].to_numpy()] = found["bits"].to_numpy()
    return spark.sparkContext.broadcast(words.view(np.uint8))


def passes(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be among those that the bitmap was made of."""
    at = bits_of(keys, len(bitmap).bit_length() + 2)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def buckets_for(df: DataFrame) -> int:
    """Buckets of keys for ``packed``: a power of two, in proportion to the input's partitions, so each stays small."""
    return 1 << max(6, (8 * df.rdd.getNumPartitions()).bit_length())


def packed(keys: np.ndarray, buckets: int):
    """Batches (bucket, keys): the distinct keys (uint64) by their upper ``KEPT`` bits and whether they stood twice, in 6 bytes each."""
    found, n = np.unique(keys >> np.uint64(64 - KEPT), return_counts=True)
    six = ((found << np.uint64(1)) | (n > 1).astype(np.uint64)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    bucket = (found >> np.uint64(KEPT - buckets.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(first[1:], len(bucket))
    for i in range(0, len(first), 4_096):
        yield rows(PACKED, [bucket[first[i : i + 4_096]], [six[a:b].tobytes() for a, b in zip(first[i : i + 4_096], ends[i : i + 4_096], strict=True)]])


def repeated(found: DataFrame) -> DataFrame:
    """(key): the upper ``KEPT`` bits of the keys that stand twice in ``packed`` rows (bucket, keys).

    Equal upper bits count as equal keys, so more keys may pass, never fewer.
    """

    def count(batches):
        for b in slices(batches, 16):
            for parts in column(b, "parts"):
                six = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 6)
                eight = np.zeros((len(six), 8), np.uint8)
                eight[:, :6] = six
                own = np.sort(eight.reshape(-1).view("<u8"))
                twice = (own & np.uint64(1)).astype(bool)
                own >>= np.uint64(1)
                twice[1:] |= own[1:] == own[:-1]
                again = np.unique(own[twice]).view(np.int64)
                for i in range(0, len(again), 100_000):
                    yield rows(KEYS, [again[i : i + 100_000]])

    return found.groupBy("bucket").agg(F.collect_list("keys").alias("parts")).select("parts").mapInArrow(count, "key long")


def repeated_keys(df: DataFrame, find) -> DataFrame:
    """``repeated`` of the longs in the first column of what ``find`` makes of the batches of ``df``, in the same Python worker."""
    buckets = buckets_for(df)

    def pack(batches):
        held, size = [], 0
        for b in find(batches):
            held.append(b.column(0).to_numpy().view(np.uint64))
            size += b.num_rows
            if size > 1_000_000:
                yield from packed(np.concatenate(held), buckets)
                held, size = [], 0
        if size:
            yield from packed(np.concatenate(held), buckets)

    return repeated(df.mapInArrow(pack, "bucket long, keys binary"))
