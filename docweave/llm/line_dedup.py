"""Removal of repeated runs of lines, by a suffix array over line ids.

Every text is the sequence of the ids of its lines with words. Prefix doubling sorts all suffixes of all sequences by
their first 1, 2, 4, ... lines: the rank of a suffix by 2d lines is the order of (its rank by d, the rank by d of the
suffix d lines on). Two overlapping ranks give any depth between, so ``min_lines`` need not be a power of two. Suffixes of equal
rank by d lines are an interval of the suffix array whose longest common prefix is at least d. A suffix that shares its
rank with no other cannot lie in a deeper interval and goes no further; the doubling ends when no rank is shared. Each interval's
occurrences but the first are later copies; from the deepest intervals of neighbouring suffixes come the maximal repeated
runs, and their lines are deleted.

A run counts from ``min_lines`` lines on, or as a single line of at least ``min_words`` words (repeated shorter lines,
such as headings, stay). Order is (doc_id, row, line). Defined results: null texts count as empty; lines without words are in
no run and stay; of tied copies the first in order stays; repeated rows are texts of their own in the order of their row
number; rows without a doc_id come first; an empty table stays empty; columns besides doc_id and text are kept by ``apply``
and not read. Lines are equal when their 64-bit hashes are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, cut, join_counted, numbered, parcels, raw, rows, slices, texts_of

MIN_LINES, MIN_WORDS = 2, 5

LINES = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("k", pa.int32()), ("line", pa.int64()), ("words", pa.int32())])
WHERE = ["id", "row", "k"]


def has_words(line: bytes) -> bool:
    return bool(line.strip(b" \t\n\r\x0b\x0c"))


def lines_of(texts: DataFrame) -> DataFrame:
    """(id, row, k, line, words) of (uid, doc_id, packed): k counts the lines with words, ``line`` is a 64-bit hash."""

    def split(batches):
        for b in slices(batches):
            out = []
            for i, row, text in zip(*(column(b, c) for c in ("doc_id", "uid", "packed")), strict=True):
                k = 0
                for line in raw(text).split(b"\n"):
                    if n := len(line.split()):
                        out.append((-(1 << 62) if i is None else i, row, k, xxhash.xxh3_64_intdigest(line), n))
                        k += 1
            if out:
                i, row, k, line, n = zip(*out, strict=True)
                yield rows(LINES, [i, row, k, np.array(line, np.uint64).view(np.int64), n])

    return texts.select("doc_id", "uid", "packed").mapInArrow(split, "id long, row long, k int, line long, words int")


def ranked(suffixes: DataFrame, *by: str) -> DataFrame:
    """The suffixes (cut) with their ``rank`` in the order of the given columns, and whether they are a ``later`` copy.

    Those alone in their rank are left out.
    """
    place = F.struct(*WHERE)
    keys = suffixes.groupBy(*by).agg(F.count("*").alias("size"), F.min(place).alias("first")).where("size > 1")
    # Ids rise through the sorted ranges, so they order the keys as the columns do.
    order = cut(keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()))
    return join_counted(suffixes, order, *by).select(*WHERE, "words", "rank", (place != F.col("first")).alias("later"))


def further(now: DataFrame, step: int) -> DataFrame:
    """The suffixes with their rank ``here`` and that of the suffix ``step`` lines on, ``next``, if both are shared."""
    on = Window.partitionBy("row").orderBy("k")
    if step == 1:
        then = F.when(F.lead("k", 1).over(on) == F.col("k") + 1, F.lead("rank", 1).over(on))
    else:
        then = F.max("rank").over(on.rangeBetween(step, step))
    return cut(now.select(*WHERE, "words", F.col("rank").alias("here"), then.alias("next")).where("next is not null"))


def repeated(texts: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, k, depth): lines k .. k + depth - 1 of a row stand earlier in the corpus."""
    now = cut(ranked(cut(lines_of(texts)), "line"))
    found, depth = now.where("later").where((F.col("words") >= min_words) | F.lit(min_lines == 1)).select("row", "k", F.lit(1).alias("depth")), 1
    while True:
        step = min(depth, min_lines - depth) if depth < min_lines else depth  # the last ranks may overlap
        now = cut(ranked(further(now, step), "here", "next"))
        if now.isEmpty():
            return found
        depth += step
        if depth >= min_lines:
            found = found.unionByName(now.where("later").select("row", "k", F.lit(depth).alias("depth")))


def maximal(found: DataFrame) -> DataFrame:
    """(row, runs): the maximal repeated runs of each row, as packed pairs of their first line and the line after their last."""
    schema = pa.schema([("row", pa.int64()), ("runs", pa.binary())])

    def merge(batches):
        for b in slices(batches):
            marks, out = b.column(b.schema.get_field_index("marks")), []
            for j in range(b.num_rows):
                lo, depth = (marks[j].values.field(i).to_numpy().astype(np.int64) for i in range(2))
                order = np.argsort(lo, kind="stable")
                lo, end = lo[order], np.maximum.accumulate((lo + depth)[order])
                first = np.append(True, lo[1:] > end[:-1])
                out.append(np.column_stack([lo[first], end[np.append(first[1:], True)]]).astype("<i8").tobytes())
            yield rows(schema, [b.column(0), out])

    return found.groupBy("row").agg(F.collect_list(F.struct("k", "depth")).alias("marks")).mapInArrow(merge, "row long, runs binary")


def marked(every: DataFrame, uid: str, min_lines: int, min_words: int) -> tuple[DataFrame, str]:
    """The numbered rows with their runs, in a column of the returned name."""
    name = "runs"
    while name in (c.lower() for c in every.columns):
        name = f"_{name}"
    runs = maximal(repeated(texts_of(every, uid), min_lines, min_words))
    return every.join(runs.select(F.col("row").alias(uid), F.col("runs").alias(name)), uid, "left"), name


def struck(text: bytes, packed: bytes | None) -> tuple[bytes, int, int, int]:
    """What is left of a text without its runs, its lines with words, how many of them go, and how many runs."""
    runs = np.frombuffer(packed or b"", "<i8").reshape(-1, 2).tolist()
    kept, k, at = [], 0, 0
    for line in text.split(b"\n"):
        if not has_words(line):
            kept.append(line)
            continue
        while at < len(runs) and runs[at][1] <= k:
            at += 1
        if at == len(runs) or k < runs[at][0]:
            kept.append(line)
        k += 1
    return b"\n".join(kept), k, sum(b - a for a, b in runs), len(runs)


def report(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_runs, kept_text_sha256) of each document."""
    found, name = marked(*numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), min_lines, min_words)
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("n_runs", pa.int64()), ("kept_sha256", pa.string())])

    def strike(batches):
        for b in slices(batches):
            out = []
            for t, r in zip(column(b, "text"), column(b, "runs"), strict=True):
                kept, *numbers = struck(raw(t), r)
                out.append((*numbers, hashlib.sha256(kept).hexdigest()))
            yield rows(schema, [b.column(0), *zip(*out, strict=True)] if out else [[] for _ in schema])

    return found.select("doc_id", "text", F.col(name).alias("runs")).mapInArrow(strike, "doc_id long, n_lines long, n_removed long, n_runs long, kept_sha256 string")


def apply(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the repeated lines, n_chars set anew; texts of which no line with words is left go."""
    found, name = marked(*numbered(docs), min_lines, min_words)
    text, schema = docs.columns.index("text"), docs.schema
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def strike(batches):
        for b in parcels(batches, text):
            gone = b.column(len(schema)).to_pylist()
            packed = zip(b.column(text).to_pylist(), gone, strict=True)
            out = [(None if t is None else s[0].decode(), bool(g) and s[1] == s[2]) for t, g in packed for s in [struck(raw(t), g)]]
            columns = list(b.columns[: len(schema)])
            columns[text] = pa.array([t for t, _ in out], pa.string())
            if size is not None:
                old = columns[size].to_pylist()
                columns[size] = pa.array([o if not g else len(t) for o, g, (t, _) in zip(old, gone, out, strict=True)], columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names).filter(pa.array([not empty for _, empty in out], pa.bool_()))

    return found.select(*docs.columns, name).mapInArrow(strike, schema)


#: The same rows in DuckDB's SQL, for the default parameters and unique doc_ids.
ORACLE = r"""
with split as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as place from documents
), lines as (
  select *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words from split
), numbered as (
  select *, row_number() over (partition by doc_id order by place) as k from lines where words > 0
), paired as (
  select *, lead(line) over (partition by doc_id order by k) as next from numbered
), judged as (
  select *, words >= 5 and row_number() over (partition by line order by doc_id, k) > 1 as one,
    next is not null and row_number() over (partition by line, next order by doc_id, k) > 1 as two
  from paired
), marked as (
  select *, one or two or coalesce(lag(two) over (partition by doc_id order by k), false) as gone from judged
), runs as (
  select *, gone and not coalesce(lag(gone) over (partition by doc_id order by k), false) as starts from marked
), kept as (
  select l.doc_id, string_agg(l.line, chr(10) order by l.place) as text
  from lines l left join runs r on l.doc_id = r.doc_id and l.place = r.place where not coalesce(r.gone, false) group by 1
), counted as (
  select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed, count(*) filter (starts) as n_runs from runs group by 1
)
select d.doc_id, coalesce(c.n_lines, 0) as n_lines, coalesce(c.n_removed, 0) as n_removed, coalesce(c.n_runs, 0) as n_runs, sha256(coalesce(k.text, '')) as kept_sha256
from documents d left join counted c on d.doc_id = c.doc_id left join kept k on d.doc_id = k.doc_id
"""
