"""Quality rules: a learned decision list of threshold conjunctions.

Text statistics are computed for every whole document. From a bounded sample of labelled rows, sequential covering
grows conjunctions of thresholds that single out rejected texts, prunes each on rows held back for that, and removes
the rows that a rule covers before it grows the next. The ordered list becomes one conditional Spark expression.

Defined results: null and empty texts have no words and fail the base rule; repeated rows are judged each for itself;
equal texts get equal verdicts; ratios of texts without words count as 0; an empty table stays empty; without labels of both
classes the list is empty and only the base rule rejects; 3-word windows are equal when their 64-bit hashes are; input columns other than ``doc_id`` and ``text`` are not read (``apply`` keeps them all).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import WordHashes, column, cut, gram_hashes, rows, slices

#: Labelled ids (of the least hash) that the list is fitted on at most, and twice as many rows where ids repeat.
SAMPLE = 20_000
#: A rule is kept only if it is that precise on all rows of the sample, and covers so many. The list ends with the first that is not.
PRECISION, SUPPORT = 0.98, 5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_marks", "n_digits"]
SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS)])
KINDS = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS)])

FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words"),
    "distinct": ("n_distinct", "n_words"), "upper": ("n_upper", "word_chars"), "marks_per_word": ("n_marks", "n_words"), "digits": ("n_digits", "word_chars"),
}

_UPPER, _SYMBOLS, _MARKS, _DIGITS = bytes(range(65, 91)), b"#*$%&|<>", b"!?;:()[]{}\"'", b"0123456789"
_BLANKS = " \t\n\r\x0b\x0c"


def counts_of(text: str | None, hashes: WordHashes) -> tuple:
    """The statistics of one text, in the order of ``COUNTS``."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    h = hashes.of(words)
    grams = gram_hashes(h, 3)
    repeat = 0
    if len(grams):
        _, back, n = np.unique(grams, return_inverse=True, return_counts=True)
        twice = n[back] > 1
        covered = np.zeros(len(words), bool)
        for i in range(3):
            covered[i : i + len(grams)] |= twice
        repeat = int(covered.sum())
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
    less = lambda drop: len(raw) - len(raw.translate(None, drop))
    return (len(words), len(text) - sum(map(text.count, _BLANKS)), less(_SYMBOLS), len(lines) - len(set(lines)), repeat, len(lines), len(set(words)), less(_UPPER), less(_MARKS), less(_DIGITS))


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, *COUNTS) of every whole text."""

    def count(batches):
        hashes = WordHashes()
        for b in slices(batches):
            yield rows(SCHEMA, [b.column(0), *zip(*(counts_of(t, hashes) for t in column(b, "text")), strict=True)] if b.num_rows else [[] for _ in SCHEMA])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, KINDS)


def features(row) -> list[float]:
    return [row[a] / max(1, row[b]) for a, b in FEATURES.values()]


def learn(stats: DataFrame, labels: DataFrame, target: str = "quality", reject: int = 0, sample: int = SAMPLE) -> list[list[tuple[str, str, float]]]:
    """The decision list: conjunctions of (feature, ``<=`` or ``>``, threshold); a text that meets one is rejected."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    got = stats.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *COUNTS).limit(2 * sample).collect()  # broadcast: at most ``sample`` rows
    if not got:
        return []
    x, bad = np.array([features(r) for r in got]), np.array([r["label"] == reject for r in got])
    return cover(x, bad)


def cover(x: np.ndarray, bad: np.ndarray) -> list[list[tuple[str, str, float]]]:
    """Sequential covering over the rows of ``x``; every third row is held back for pruning."""
    names, held = list(FEATURES), np.arange(len(x)) % 3 == 2
    left, rules = np.ones(len(x), bool), []
    while (left & bad & ~held).sum() >= SUPPORT:
        rule = grow(x[left & ~held], bad[left & ~held])
        rule = prune(rule, x[left & held], bad[left & held])
        met = meets(rule, x) & left
        n, p = met.sum(), (met & bad).sum()
        if not rule or p < SUPPORT or p < PRECISION * n:
            break
        rules.append(rule)
        left &= ~met
    return [[(names[j], op, t) for j, op, t in rule] for rule in rules]


def meets(rule: list, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, op, t in rule:
        out &= x[:, j] > t if op == ">" else x[:, j] <= t
    return out


def grow(x: np.ndarray, bad: np.ndarray) -> list:
    """Add the condition of the largest information gain until no good row is met."""
    rule: list = []
    inside = np.ones(len(x), bool)
    while (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best = (1e-9, None, None)
        for j in range(x.shape[1]):
            order = np.argsort(x[inside, j], kind="stable")
            v, y = x[inside, j][order], bad[inside][order]
            ends = np.flatnonzero(np.diff(v) > 0)
            if not len(ends):
                continue
            p_low, n_low = np.cumsum(y)[ends], np.cumsum(~y)[ends]
            for op, p, n in (("<=", p_low, n_low), (">", p0 - p_low, n0 - n_low)):
                gain = np.where(p >= SUPPORT, p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1e-9)) - np.log2(p0 / (p0 + n0))), -1)
                if gain[i := int(gain.argmax())] > best[0]:
                    best = (gain[i], (j, op, float((v[ends[i]] + v[ends[i] + 1]) / 2)), None)
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= meets(rule[-1:], x)
    return rule


def prune(rule: list, x: np.ndarray, bad: np.ndarray) -> list:
    """Drop last conditions while (p - n) / (p + n) on the held-back rows does not get worse."""

    def worth(r: list) -> float:
        met = meets(r, x)
        p, n = (met & bad).sum(), (met & ~bad).sum()
        return (p - n) / max(1, p + n)

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def expression(rules: list[list[tuple[str, str, float]]], prefix: str = "") -> Column:
    """The list as one conditional over the columns of ``statistics``: false where a rule rejects, else true."""
    out = None
    for rule in rules:
        met = F.lit(True)
        for name, op, t in rule:
            a, b = (F.col(prefix + c) for c in FEATURES[name])
            value = a / F.greatest(F.lit(1), b)
            met = met & (value > t if op == ">" else value <= t)
        out = F.when(met, False) if out is None else out.when(met, False)
    return F.lit(True) if out is None else out.otherwise(True)


def base_failed(prefix: str = "") -> Column:
    n_words, n_repeat = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n_words < 50) | (100 * n_repeat > 50 * n_words)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every document."""
    stats = cut(statistics(docs))
    return stats.select("doc_id", *COUNTS[:5], base_failed().alias("base_failed"), (~base_failed() & expression(learn(stats, labels))).alias("kept"))


def apply(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rejected ones, all columns as they were."""
    rules = learn(cut(statistics(docs)), labels)
    prefix = "quality_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    place = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, *(StructField(prefix + c, LongType()) for c in COUNTS)])

    def count(batches):
        hashes = WordHashes()
        for b in slices(batches):
            found = list(zip(*(counts_of(t, hashes) for t in b.column(place).to_pylist()), strict=True)) or [[] for _ in COUNTS]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.int64()) for c in found)], names=schema.names)

    counted = docs.mapInArrow(count, schema)
    return counted.where(~base_failed(prefix) & expression(rules, prefix)).select(*docs.columns)
