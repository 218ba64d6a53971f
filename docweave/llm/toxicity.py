"""Toxicity scores from a learned lexicon, Levenshtein automata and context windows.

From labelled texts (never those held out), Spark counts in how many toxic and clean texts each word and each word
beginning stands, and in how many different contexts. Those that mark toxic texts form the lexicon, kept as a trie.
Each token of a text is looked up among the terms, and else its Levenshtein automaton (one edit) is run against the trie of
words and beginnings, so misspelled terms and misspelled inflections are found. A beginning is matched with an edit only if
that speaks for toxic texts in the sample as well. The window around a hit tells quotation from abuse: quotation marks
around it and words of saying before it move its weight from abuse to quotation. A logistic regression of the summed
weights gives the score.

Defined results: null and empty texts score as texts without a hit; repeated rows are scored each for itself; labels
of null do not count, and of several values for one id the largest does; equal scores are possible and equal texts have
them; without labels nothing is in the lexicon and all score 0; an empty table stays empty; columns besides doc_id and text
(and the label) are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMO_LIMIT, column, cut, rows, slices

#: Labelled rows (of the least hash) that lexicon and weights are learned from at most. What is learned is bounded by them.
SAMPLE = 20_000
#: A term must stand in so many toxic texts and contexts, and in at most this share of clean texts among its texts.
SUPPORT, IMPURE = 6, 0.02
#: Lengths of word beginnings; shortest term that may be misspelled; tokens of the context window.
STEM, FUZZY, WINDOW = (4, 8), 5, 6
THRESHOLD = 0.3

# Words of saying before a quotation.
SAYING = set("said says say saying called calls wrote writes word words term quote quoted quoting reported sagte sagt nannte schrieb wort zitat dit disait appelé écrit mot citation dijo dice llamó escribió palabra cita".split())
OPENING, CLOSING = "\"“«„‘(", "\"”»“’)"
_EDGES = ".,;:!?()[]{}\"'“”«»„‘’…-*_"

FEATURES = ["abuse", "quoted", "misspelled", "misspelled_quoted", "density"]
TERM = pa.schema([("term", pa.string()), ("word", pa.bool_()), ("toxic", pa.int64()), ("clean", pa.int64())])
FOUND = pa.schema([("doc_id", pa.int64()), *((c, pa.float64()) for c in FEATURES), ("n_terms", pa.int64())])


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def terms_of(token: str) -> list[tuple[str, bool]]:
    """(term, whole word) of a stripped token: the word and its beginnings."""
    return [(token, True), *((token[:n], False) for n in range(STEM[0], min(STEM[1], len(token)) + 1))] if len(token) >= STEM[0] else []


def training_rows(docs: DataFrame, labels: DataFrame, target: str) -> DataFrame:
    """(doc_id, text, label): a bounded sample of the labelled rows that are not held out, equal texts once."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label")).where("doc_id is not null and label is not null")
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(known), "doc_id")  # at most SAMPLE rows
    once = texts.withColumn("digest", F.sha2("text", 256)).dropDuplicates(["digest"])
    return cut(once.orderBy(F.xxhash64("doc_id"), "doc_id", "digest").limit(SAMPLE).drop("digest"))  # an id may have many texts


def count_terms(sample: DataFrame) -> DataFrame:
    def count(batches):
        counts: dict = {}
        for b in slices(batches):
            for text, label in zip(column(b, "text"), column(b, "label"), strict=True):
                tokens = {t.strip(_EDGES) for t in text.lower().split()}
                for term in {x for t in tokens for x in terms_of(t)}:
                    counts.setdefault(term, [0, 0])[1 if label == 1 else 0] += 1
            if len(counts) > MEMO_LIMIT:
                yield from flush(counts)
                counts = {}
        yield from flush(counts)

    def flush(counts):
        items = list(counts.items())
        for i in range(0, len(items), 50_000):
            part = items[i : i + 50_000]
            yield rows(TERM, [[t for (t, _), _ in part], [w for (_, w), _ in part], [n[1] for _, n in part], [n[0] for _, n in part]])

    return sample.select("text", "label").mapInArrow(count, "term string, word boolean, toxic long, clean long").groupBy("term", "word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def contexts_of(sample: DataFrame, sent) -> DataFrame:
    """(term, word, contexts): in how many different pairs of neighbouring tokens a candidate stands."""

    def find(batches):
        wanted = sent.value
        for b in slices(batches):
            out = set()
            for text in column(b, "text"):
                tokens = [t.strip(_EDGES) for t in text.lower().split()]
                for i, t in enumerate(tokens):
                    for term in terms_of(t):
                        if term in wanted:
                            near = f"{tokens[i - 1] if i else ''} {tokens[i + 1] if i + 1 < len(tokens) else ''}"
                            out.add((*term, xxhash.xxh3_64_intdigest(near) >> 1))
            if out:
                term, word, near = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(word), pa.array(near, pa.int64())], names=["term", "word", "near"])

    found = sample.select("text", "label").where("label = 1").select("text").mapInArrow(find, "term string, word boolean, near long")
    return found.distinct().groupBy("term", "word").agg(F.count("*").alias("contexts"))


def learn_lexicon(sample: DataFrame) -> tuple[list[str], list[str]]:
    """(word beginnings, words) that mark toxic texts; a beginning stands for all words that start with it."""
    pure = count_terms(sample).where((F.col("toxic") >= SUPPORT) & (F.col("clean") <= IMPURE * (F.col("toxic") + F.col("clean"))))
    top = pure.orderBy(F.desc("toxic"), "term", "word").collect()  # terms of the sample
    if not top:
        return [], []
    wanted = sample.sparkSession.sparkContext.broadcast({(r.term, r.word) for r in top})
    seen = {(r.term, r.word): r.contexts for r in contexts_of(sample, wanted).collect()}
    good = [(r.term, r.word) for r in top if seen.get((r.term, r.word), 0) >= max(SUPPORT, r.toxic // 2)]
    stems: set[str] = set()
    for term in sorted((t for t, word in good if not word), key=len):
        if not any(term[:n] in stems for n in range(STEM[0], len(term))):
            stems.add(term)
    return sorted(stems), sorted(t for t, word in good if word)


def fuzzy_stems(sample: DataFrame, stems: list[str], words: list[str]) -> list[str]:
    """The beginnings whose misspelled forms mark toxic texts of the sample no less than the beginnings themselves."""
    sent = sample.sparkSession.sparkContext.broadcast((stems, words))

    def count(batches):
        lexicon, counts = Lexicon(*sent.value, sent.value[0]), {}
        exact = Lexicon(*sent.value)
        for b in slices(batches):
            for text, label in zip(column(b, "text"), column(b, "label"), strict=True):
                tokens = {t.strip(_EDGES) for t in text.lower().split()}
                for stem in {s for t in tokens if not exact[t] and lexicon.near(t) for s in lexicon.trie.within_one_edit(t) if s in lexicon.stems}:
                    counts.setdefault(stem, [0, 0])[1 if label == 1 else 0] += 1
        yield rows(TERM, [list(counts), [False] * len(counts), [n[1] for n in counts.values()], [n[0] for n in counts.values()]])

    found = sample.select("text", "label").mapInArrow(count, "term string, word boolean, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    bad = {r.term for r in found.where(F.col("clean") > IMPURE * (F.col("toxic") + F.col("clean"))).collect()}  # terms of the sample
    return [s for s in stems if s not in bad]


class Trie:
    """Characters -> nodes; the empty string as a key holds the terms that end there, with whether they are whole words."""

    def __init__(self, words: list[str], beginnings: list[str] = ()):
        self.root: dict = {}
        for w, whole in [*((w, True) for w in words), *((w, False) for w in beginnings)]:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node.setdefault("", []).append((w, whole))

    def within_one_edit(self, token: str) -> list[str]:
        """The words, and the beginnings of words, that the token's Levenshtein automaton for one edit and the trie accept."""
        n, out = len(token), []
        todo = [(self.root, ((0, 0),))]  # states: (read characters of the token, edits)
        while todo:
            node, states = todo.pop()
            for term, whole in node.get("", ()):
                if not whole or any(n - i + e <= 1 for i, e in states):
                    out.append(term)
            for c, below in node.items():
                if not c:
                    continue
                after = set()
                for i, e in states:
                    if i < n and token[i] == c:
                        after.add((i + 1, e))
                    if not e:
                        after.add((i, 1))  # the word has a character more
                        if i < n:
                            after.add((i + 1, 1))  # another character
                            if i + 1 < n and token[i + 1] == c:
                                after.add((i + 2, 1))  # the token has a character more
                if after:
                    todo.append((below, tuple(after)))
        return out


class Lexicon(dict):
    """raw token -> 0 (no term), 1 (a term) or 2 (a misspelled term)."""

    def __init__(self, stems: list[str], words: list[str], fuzzy: list[str] = ()):
        self.stems, self.words = set(stems), set(words)
        long, begin = ([w for w in ws if len(w) >= FUZZY] for ws in (words, fuzzy))
        self.trie = Trie(long, begin)
        self.heads, self.tails = {w[:2] for w in (*long, *begin)}, {w[2:5] for w in (*long, *begin)}

    def __missing__(self, raw: str) -> int:
        if len(self) > MEMO_LIMIT:
            self.clear()
        kind = self[raw] = self.kind(raw.strip(_EDGES))
        return kind

    def near(self, t: str) -> bool:
        """Whether one edit may make a term of the token: it leaves the first two characters of the term, or the next three, as they are."""
        return len(t) >= FUZZY - 1 and (t[:2] in self.heads or t[1:4] in self.tails or t[2:5] in self.tails or t[3:6] in self.tails)

    def kind(self, t: str) -> int:
        if t in self.words or any(t[:n] in self.stems for n in range(STEM[0], min(STEM[1], len(t)) + 1)):
            return 1
        return 2 if self.near(t) and self.trie.within_one_edit(t) else 0


def quotation(tokens: list[str], i: int) -> float:
    """How much the window around a hit speaks for a quotation, from 0 to 1."""
    before, after = tokens[max(0, i - WINDOW) : i + 1], tokens[i : i + WINDOW + 1]
    opened = any(t[0] in OPENING for t in before) and any(t.rstrip(".,;:!?")[-1:] in CLOSING and t.rstrip(".,;:!?") for t in after)
    said = any(t.strip(_EDGES) in SAYING for t in before[:-1])
    return 0.9 if opened and said else 0.7 if opened else 0.4 if said else 0.0


def found_in(text: str | None, lexicon: Lexicon) -> tuple:
    """The values of FEATURES and the number of hits of one text."""
    tokens = text.lower().split() if text else []
    kinds = list(map(lexicon.__getitem__, tokens))
    sums = [[0.0, 0.0], [0.0, 0.0]]
    hits = [i for i, k in enumerate(kinds) if k]
    for i in hits:
        q = quotation(tokens, i)
        sums[kinds[i] - 1][0] += 1 - q
        sums[kinds[i] - 1][1] += q
    return (*(math.log1p(x) for pair in sums for x in pair), math.log1p(100 * len(hits) / max(50, len(tokens))), len(hits))


def features(docs: DataFrame, terms: tuple[list[str], list[str], list[str]], *keep: str) -> DataFrame:
    """(doc_id, *FEATURES, n_terms) of every whole text, and the columns to ``keep`` (of integers)."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)  # bounded by the sample they were learned from
    schema = pa.schema([*FOUND, *((c, pa.int64()) for c in keep)])

    def find(batches):
        lexicon = Lexicon(*sent.value)
        for b in slices(batches):
            yield rows(schema, [b.column(0), *zip(*(found_in(t, lexicon) for t in column(b, "text")), strict=True), *b.columns[2:]])

    kinds = ", ".join(["doc_id long", *(f"{c} double" for c in FEATURES), "n_terms long", *(f"{c} long" for c in keep)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(c).cast("long").alias(c) for c in keep)).mapInArrow(find, kinds)


#: Weights before any row is seen, and how strongly they hold: hits speak for toxicity, quoted ones less.
PRIOR, HOLD = np.array([2.0, 0.5, 1.0, 0.2, 0.5, -3.0]), 1.0


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias of a logistic regression, by Newton's method with a ridge around PRIOR."""
    x = np.column_stack([x, np.ones(len(x))])
    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + HOLD * np.eye(len(w)), x.T @ (y - p) - HOLD * (w - PRIOR))
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, target: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted, n_terms) of each document."""
    sample = training_rows(docs, labels, target)
    stems, words = learn_lexicon(sample)
    terms = (stems, words, fuzzy_stems(sample, stems, words))
    got = features(sample, terms, "label").orderBy("doc_id", *FEATURES, "label").collect()  # at most SAMPLE rows
    x, y = np.array([[r[c] for c in FEATURES] for r in got]).reshape(-1, len(FEATURES)), np.array([float(r["label"] == 1) for r in got])
    found = features(docs, terms)
    if not len(got):
        p = F.lit(0.0)
    else:
        *w, bias = fit(x, y).tolist()
        p = 1 / (1 + F.exp(-(sum((F.col(c) * v for c, v in zip(FEATURES, w, strict=True)), F.lit(bias)))))
    return found.select("doc_id", held_out().alias("held_out"), p.alias("score"), (p >= THRESHOLD).cast("int").alias("predicted"), "n_terms")
