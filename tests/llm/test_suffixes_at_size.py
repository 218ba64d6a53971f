"""op8 at size: what lies on disk while texts are shuffled, and the hashes of strings by sums."""

from __future__ import annotations

import random

import numpy as np

from docweave.llm import suffix_dedup


def test_phrases_are_gone_before_texts_are_shuffled(spark, monkeypatch):
    """The last job reads the repeats of whole phrases and the wanted ones, no longer all phrases and the dictionary."""
    rng, read, of = random.Random(8), [], suffix_dedup.runs
    base = "".join(rng.choice("abcdefgh ") for _ in range(900))
    docs = spark.createDataFrame([(i, base[i * 7 :] + f" end {i}") for i in range(12)], "doc_id long, text string")
    monkeypatch.setattr(suffix_dedup, "runs", lambda repeats: read.extend(spark.read.parquet(f).columns for f in repeats.inputFiles()) or of(repeats))
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove(docs).collect()}
    assert got[0] == 0 and all(got[i] >= 900 - 7 * i for i in range(1, 12))
    assert read and not any("key" in columns for columns in read)


def test_hashes_do_not_depend_on_the_place(spark):
    """Equal strings have equal hashes wherever they stand, and the trigger is the leftmost least one."""
    rng = np.random.default_rng(9)
    part, before = (rng.integers(97, 123, n, dtype=np.uint8) for n in (400, 333))
    alone, within = suffix_dedup.sums(part), suffix_dedup.sums(np.concatenate([before, part]))
    for width in (suffix_dedup.TRIGGER, suffix_dedup.LENGTH):
        own = suffix_dedup.windows(alone, slice(None), width)
        assert np.array_equal(own, suffix_dedup.windows(within, slice(None), width)[333:]) and len(set(own.tolist())) == len(own)
    h = rng.integers(0, 4, 300, dtype=np.uint64) << np.uint64(24)
    want = [min(range(i, i + suffix_dedup.REACH), key=lambda j: (int(h[j]), j)) for i in range(300 - suffix_dedup.REACH + 1)]
    assert suffix_dedup.least(h, len(want)).tolist() == want
