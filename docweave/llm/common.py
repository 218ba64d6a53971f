"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

#: Entries that a worker's memo of words keeps before it starts anew.
MEMO_LIMIT = 100_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where that is unset, a local session (tests) gets a folder; a cluster needs one."""
    given = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not given:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = tempfile.mkdtemp(prefix="docweave-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(given)
    return given


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path below ``shared_dir``."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that ``shared_folder`` named."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def free(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of frames that nothing refers to any more.

    Its cleaner follows the garbage collection of the driver, which an operator of many jobs with few objects seldom sets off by itself.
    """
    gc.collect()
    spark._jvm.System.gc()


def count_cut(df: DataFrame) -> int:
    """Rows of a cut frame (or of a filter of one), counted in no more tasks than there are cores: the driver keeps a record of every task."""
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism).count()


@contextmanager
def settings(spark: SparkSession, own: dict):
    """Spark's settings for the jobs that run within the block."""
    before = {key: spark.conf.get(key, None) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def arrow_rows(spark: SparkSession, n: int, size: int = 4 << 20):
    """Arrow batches of ``n`` rows and ``size`` bytes at most for the jobs that run within the block: wide rows then fill no worker's memory."""
    return settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": n, "spark.sql.execution.arrow.maxBytesPerBatch": size})


def no_guessed_broadcasts(spark: SparkSession):
    """Only joins that ask for it are broadcast within the block.

    Spark goes by estimates, which don't see how many rows a Python function or an explode makes, and by compressed sizes of shuffles; a
    table's hash map in the driver is several times as large, and every broadcast is a job and a thread of the driver.
    """
    return settings(spark, {"spark.sql.autoBroadcastJoinThreshold": -1, "spark.sql.adaptive.autoBroadcastJoinThreshold": -1})


class Scratch:
    """Frames that are written to the shared folder and go at the end of a ``with`` block.

    Columnar files pack rows of numbers better than a checkpoint. What a returned frame still reads must not lie here.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, shared_folder(spark), 0

    def __enter__(self):
        return self

    def __exit__(self, *_):
        remove_folder(self.spark, self.folder)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.option("compression", "zstd").parquet(f"{self.folder}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.n}")


_press, _unpress = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress


def press(text: str | None) -> bytes | None:
    return None if text is None else _press(text.encode("utf-8", "replace"))


def raw(packed: bytes | None) -> bytes:
    """The UTF-8 of a packed text; a null one counts as empty."""
    return b"" if packed is None else _unpress(packed)


def parcels(batches, at: int, most: int = 1 << 22):
    """The batches in slices of 256 rows at most whose packed texts, in column ``at``, are ``most`` bytes long or one text."""
    for b in batches:
        start = total = 0
        for i, t in enumerate(b.column(at).to_pylist()):
            n = 0 if t is None else zstandard.frame_content_size(t)
            if i > start and (total + n > most or i - start == 256):
                yield b.slice(start, i - start)
                start, total = i, 0
            total += n
        yield b.slice(start)
        pa.default_memory_pool().release_unused()


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with its text packed (zstd) and a number for each row, and the name of that column, which no other column has.

    The rows are written once (a checkpoint), so every later read sees the same numbers, however the plan that made
    ``df`` deals its rows.
    """
    name, taken, at = "uid", {c.lower() for c in df.columns}, df.columns.index("text")
    while name in taken:
        name = f"_{name}"
    fields = df.schema.fields
    schema = StructType([StructField(name, LongType()), *fields[:at], StructField("text", BinaryType()), *fields[at + 1 :]])

    def pack(batches):
        for b in slices(batches):
            columns = list(b.columns)
            columns[at + 1] = pa.array(map(press, columns[at + 1].to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return cut(df.select(F.monotonically_increasing_id().alias(name), F.col("*")).mapInArrow(pack, schema)), name


def unpacked(every: DataFrame, schema: StructType) -> DataFrame:
    """Rows of ``numbered`` as they were, without the number."""
    at = schema.names.index("text")

    def unpack(batches):
        for b in parcels(batches, at):
            columns = list(b.columns)
            columns[at] = pa.array([None if t is None else raw(t).decode() for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return every.select(*schema.names).mapInArrow(unpack, schema)


def numbered_texts(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, packed) of every row; see ``numbered``."""
    return texts_of(*numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")))


def texts_of(rows: DataFrame, uid: str) -> DataFrame:
    """(uid, doc_id, packed) of ``numbered`` rows."""
    return rows.select(F.col(uid).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("packed"))


def join_counted(left: DataFrame, right: DataFrame, *on: str, size: str = "size", parts: int = 1_000) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key and in ``size`` how many rows of ``left`` have the key.

    Keys that hold more than one row in ``parts`` are fewer than ``parts``: these are broadcast, so that no task gets
    all rows of one. The others are shuffled. Both sides are read twice, so they should be cut.
    """
    limit = max(1_000, (right.agg(F.sum(size)).first()[0] or 0) // parts)
    heavy = F.broadcast(right.where(F.col(size) > limit))
    light = left.join(heavy.select(*on), list(on), "left_anti").join(right.where(F.col(size) <= limit), list(on))
    return left.join(heavy, list(on)).unionByName(light)


class WordHashes(dict):
    """word (bytes) -> 63-bit hash, computed once for each distinct word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) >> 1
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes (none if there are fewer words)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = mix(words[:n] + np.array([k], np.uint64) * _STEP)
    for i in range(1, k):
        out = mix(out * np.uint64(3) + words[i : n + i] + _STEP)
    return out


#: A-Z become a-z, and every blank a space.
LOWER_SPACED = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
#: Bytes of a text that are hashed at once, and the longest word (bytes) that is hashed with the others of its piece.
PIECE, LONG_WORD = 1 << 18, 64
_VALUES = np.random.default_rng(20240517).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0xD6E8FEB86659FD93
_POWERS = np.cumprod(np.full(PIECE, _BASE, np.uint64))
_BACK = np.cumprod(np.full(PIECE, pow(_BASE, -1, 1 << 64), np.uint64))


def _hashes_of_piece(text: bytes) -> np.ndarray:
    d = np.frombuffer(text, np.uint8)
    gaps = np.flatnonzero(d == 32)
    start, end = np.append(0, gaps + 1), np.append(gaps, len(d))
    some = start < end
    start, end = start[some], end[some]
    total = np.zeros(len(d) + 1, np.uint64)
    np.cumsum(_VALUES[d] * _POWERS[: len(d)], out=total[1:])
    h = mix((total[end] - total[start]) * _BACK[start] + (end - start).astype(np.uint64) * _STEP)
    for i in np.flatnonzero(end - start > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(text[start[i] : end[i]])
    return h


def lower_word_hashes(text: bytes) -> np.ndarray:
    """Hash of each word ``[^\\x20\\x09-\\x0D]+`` of a text's UTF-8 after A-Z are lower-cased: a polynomial of its bytes, from sums over whole pieces."""
    text, out, at = text.translate(LOWER_SPACED), [], 0
    while at < len(text):
        end = len(text) if len(text) - at <= PIECE else text.rfind(b" ", at, at + PIECE)
        if end < 0:  # a word longer than a piece
            end = text.find(b" ", at + PIECE)
            end = len(text) if end < 0 else end
            out.append(np.array([xxhash.xxh3_64_intdigest(text[at:end])], np.uint64))
        else:
            out.append(_hashes_of_piece(text[at:end]))
        at = end + 1
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def distinct(g: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    g = np.sort(g)
    return g[np.append(True, g[1:] != g[:-1])] if len(g) else g


#: ASCII letters and digits and all bytes of non-ASCII characters stay; A-Z become a-z, every other byte a blank.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def alnum_words(text: str | bytes | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text (or its UTF-8) after A-Z are lower-cased, as UTF-8."""
    return (text if isinstance(text, bytes) else text.encode("utf-8", "replace")).translate(ALNUM).split() if text else []


def blank_words(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, as UTF-8."""
    return text.encode("utf-8", "replace").split() if text else []


def slices(batches, n: int = 256):
    """The batches in slices of ``n`` rows, so that a worker holds the Python objects of few texts at a time."""
    for b in batches:
        for i in range(0, b.num_rows, n):
            yield b.slice(i, n)
        pa.default_memory_pool().release_unused()  # a worker lives through many tasks


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def rows(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
