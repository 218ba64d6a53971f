"""Indexes, guarded rules and range counts against plain forms of the same."""

import random

import pytest
from pyspark.sql import functions as F

from docweave.operators import retrieval, rules, text_index


@pytest.mark.parametrize("width", [3, 40, 1000])
def test_block_maxima_lose_nothing(spark, tmp_path, width):
    rng = random.Random(width)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 300}"
    chunks = spark.createDataFrame([(f"c{i:04d}", " ".join(word() for _ in range(rng.randrange(0, 40)))) for i in range(400)] + [("c9", None), ("c8", "  "), ("c7", "common " * 50)], "chunk_id string, content string")
    asked = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.randrange(0, 6)))) for i in range(30)] + [(40, "common w1 W1"), (41, None), (42, "w1")], "query_id long, query string")
    index = text_index.build(chunks, str(tmp_path / "index"), width)
    want = sorted(map(str, retrieval.bm25(retrieval.postings(chunks), asked, 10).select("query_id", "chunk_id", "score", "rank").collect()))
    assert want and sorted(map(str, text_index.search(index, asked, 10).select("query_id", "chunk_id", "score", "rank").collect())) == want
    again = text_index.load(spark, str(tmp_path / "index"))
    assert sorted(map(str, text_index.search(again, asked, 10).select("query_id", "chunk_id", "score", "rank").collect())) == want
    assert index.blocks.groupBy("shard").agg(F.count_distinct("term")).count() == index.chunks.select("shard").distinct().count()


def test_a_rule_that_raises_leaves_the_others(spark):
    df = spark.createDataFrame([(1, "invoice", 0, "5"), (2, "invoice", 4, "x"), (3, None, None, "7"), (4, "policy", 0, None)], "document_id int, document_type string, b int, s string")
    low = F.lit(10) / F.col("b") > 2
    chosen = [rules.Rule("divides", "high", (), low), rules.Rule("shares", "low", ("invoice",), low & (F.col("s").cast("int") > 1)), rules.Rule("broken", "low", (), F.raise_error(F.lit("no")).cast("boolean")), rules.Rule("fine", "medium", (), F.col("b").isNull()), rules.Rule("unsure", "critical", (), F.col("b") == 0, F.lit(1.0) / F.col("b"))]
    found = rules.evaluated(df, chosen)
    got = {(r.document_id, r.rule_key): (r.triggered, r.failed) for r in found.collect()}
    assert got[1, "divides"] == (False, True) and got[2, "divides"] == (True, False) and got[3, "divides"] == (False, False) and got[4, "divides"] == (False, True)
    assert got[1, "shares"] == (False, True) and got[2, "shares"] == (False, True) and (3, "shares") not in got
    assert all(got[i, "broken"] == (False, True) and got[i, "fine"] == (i == 3, False) for i in (1, 2, 3, 4))
    assert {(r.document_id, r.rule_key) for r in rules.findings(df, chosen).collect()} == {k for k, (_, failed) in got.items() if not failed}
    report = {r.document_id: r for r in rules.risk_score(found).collect()}
    assert (report[1].executed, report[1].failed, report[1].score) == (1, 4, 0.0) and (report[3].executed, report[3].triggered, report[3].score) == (3, 1, 15.0)
    assert {r.rule_key: r.documents for r in rules.failed_rules(found).collect()} == {"divides": 2, "shares": 2, "broken": 4, "unsure": 2}


def test_counts_around_are_those_of_a_window(spark):
    rng = random.Random(2)
    days = [(rng.randrange(4), rng.choice([None, *range(200)])) for _ in range(500)]
    df = spark.createDataFrame(days, "k int, at int").select("k", F.date_add(F.lit("1999-12-25").cast("date"), F.col("at")).alias("day"))
    got = {(r.k, (r.day - __import__("datetime").date(1999, 12, 25)).days): r.around for r in rules.counts_around(df, "k", "day", 30).collect()}
    assert got == {(k, a): sum(1 for j, b in days if j == k and b is not None and abs(a - b) <= 30) for k, a in set(days) if a is not None}


def test_change_events_and_states(spark):
    defs = spark.createDataFrame([("a", "low", "", True, 1), ("b", "low", "", True, 1)], "rule_key string, severity string, types string, active boolean, version int")
    log = spark.createDataFrame([("a", 1, None, "{}"), ("a", 3, False, None), ("a", 5, None, "{}"), ("b", 2, False, "{}"), ("b", 4, True, None), ("z", 1, False, None)], "rule_key string, at long, active boolean, config string")
    assert sorted(map(tuple, rules.change_events(defs, log).collect())) == [("a", 1, "updated", 2), ("a", 3, "disabled", 2), ("a", 5, "updated", 3), ("b", 2, "disabled", 2), ("b", 4, "enabled", 2)]
    assert [r.rule_key for r in rules.active_keys(defs, log).collect()] == ["b"]


def test_vector_index_recall(spark):
    """On vectors without structure: recall of the 10 nearest, with 5 % of the rows as candidates."""
    from docweave.operators import vector_index, vectors

    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    index = vector_index.build(v.unionByName(spark.createDataFrame([(-1, [0.0] * 64), (-2, [1.0]), (-3, None)], "id long, vector array<double>").select("id", F.col("vector").cast("array<float>").alias("vector"))), 64)
    exact, got = vectors.top_k(v, q, 10), vector_index.search(index, q, 10)
    both = exact.join(got.select("query_id", "id", F.col("score").alias("its")), ["query_id", "id"])
    assert got.count() == exact.count() and both.where("abs(score - its) > 0.000002").count() == 0
    assert both.count() >= 0.9 * exact.count()
    asked = q.select("query_id", vectors.unit("vector").alias("v"))
    assert vector_index.candidates(index, asked, 100, 30).count() <= 0.1 * v.count() * asked.count()
    assert index.coded.count() == v.count()


def test_words_meet_by_deletions(spark):
    rng = random.Random(6)
    letters = "abcä"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 13)))
    vocab = spark.createDataFrame([(w, rng.randrange(1, 50)) for w in {word() for _ in range(250)}], "word string, n long")
    words = spark.createDataFrame([(word(),) for _ in range(150)] + [("",)], "word string")
    known = {r.word: r.n for r in vocab.collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {}
    for (w,) in {tuple(r) for r in words.collect()}:
        near = [(n, k) for k, n in known.items() if k[:1] == w[:1] and edits(w, k) <= 2]
        if w not in known and near:
            want[w] = max(near)[1]
    assert {r.word: r.correction for r in retrieval.corrected(words, vocab).collect()} == want
