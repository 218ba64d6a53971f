"""Operators on small literal frames."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from docweave.operators import admission, chunking, context, evaluation, extract, monitoring, parsing, retrieval, rules, vectors


def test_admission_first_reason_counts(spark):
    df = spark.createDataFrame([("a/b/x.txt", 5), ("x.exe", 0), ("..", 4), ("y.zip", 1), ("z.pdf", 0), ("big.md", 60 * 1024 * 1024), ("noext", 3)], "file_name string, size long")
    got = {r.file_name: (r.safe_name, r.reject_reason, r.mime_type) for r in admission.admit(df).collect()}
    assert got["a/b/x.txt"] == ("x.txt", None, "text/plain")
    assert [got[n][1] for n in ("x.exe", "..", "y.zip", "z.pdf", "big.md", "noext")] == ["denied type", "invalid file name", "unsupported type", "empty file", "too large", "unsupported type"]


def test_model_replies_are_put_right(spark):
    df = spark.createDataFrame([('{"document_type": "invoice", "confidence": 2}',), ('{"document_type": "novel", "confidence": "x"}',), ("nonsense",)], "reply string")
    kind, sure = admission.model_reply("reply")
    assert [tuple(r) for r in df.select(kind, sure).collect()] == [("invoice", 1.0), ("unknown", 0.5), ("unknown", 0.0)]


def test_html_blocks(spark):
    html = "<html><nav><p>no</p></nav><h1>Head &amp; more</h1><p>one <b>bold</b><p>two<ul><li>item</li></ul><script>x()</script></html>"
    got = parsing.html_blocks(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("order").collect()
    assert [(r.type, r.text) for r in got] == [("heading", "Head & more"), ("paragraph", "one bold"), ("paragraph", "two"), ("list", "item")]


def test_generic_chunks_repeat_the_last_text(spark):
    rows = [(1, f"b{i}", "paragraph", "x" * 40, 1, i) for i in range(5)]
    df = spark.createDataFrame(rows, "document_id long, block_id string, type string, text string, page int, order int")
    got = chunking.windowed(df, 25).orderBy("part").collect()
    assert [len(r.content.split("\n")) for r in got] == [2, 2, 2, 2]
    assert [list(r.block_ids) for r in got] == [["b0", "b1"], ["b2"], ["b3"], ["b4"]]


def test_chunk_validation(spark):
    df = spark.createDataFrame([("   ",), ("short",), ("long enough text",), ("x" * 9000,)], "content string")
    assert [r.status for r in chunking.validate(df).collect()] == ["invalid", "invalid", "valid", "needs_review"]


def test_facts_of_a_text(spark):
    df = spark.createDataFrame([(1, "Subtotal: 150.00\nTax: 15.00\nTotal: $1,165.00\nDiscount: 3")], "document_id long, text string")
    assert {r.fact_type: r.value for r in extract.money_facts(df).collect()} == {"subtotal": 150.0, "tax_amount": 15.0, "invoice_total": 1165.0, "discount": 3.0}


def test_cell_numbers(spark):
    df = spark.createDataFrame([("(1,200.50)",), ("$7",), ("n/a",), (None,)], "c string")
    assert [r[0] for r in df.select(extract.cell_number(F.col("c"))).collect()] == [-1200.5, 7.0, None, None]


def test_risk_levels(spark):
    df = spark.createDataFrame([(1, "r1", True, "critical", 1.0), (1, "r2", True, "high", 1.0), (2, "r1", False, "critical", 1.0), (3, "r1", True, "medium", 0.5), (4, "r", True, "odd", 1.0)], "document_id long, rule_key string, triggered boolean, severity string, confidence double")
    got = {r.document_id: (r.score, r.level, r.route) for r in rules.risk_score(df).collect()}
    assert got == {1: (95.0, "critical", "immediate_escalation"), 2: (0.0, "low", "auto_approve"), 3: (7.5, "low", "auto_approve"), 4: (10.0, "low", "auto_approve")}


def test_rank_fusion(spark):
    lists = [spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(order)], "query_id long, chunk_id string, rank int") for order in ("abc", "bcd")]
    got = {r.chunk_id: r.fused for r in retrieval.reciprocal_rank_fusion(*lists).collect()}
    assert got["b"] == pytest.approx(1 / 62 + 1 / 61, abs=1e-9) and max(got, key=got.get) == "b" and set(got) == set("abcd")


def test_near_repeats_and_cap(spark):
    df = spark.createDataFrame([(1, "a", 1, "one two three four"), (1, "b", 2, "one two three four"), (1, "c", 3, "other words here")], "query_id long, chunk_id string, rank int, content string")
    assert sorted(r.chunk_id for r in retrieval.diverse(df).collect()) == ["a", "c"]


def test_snippet_and_highlight(spark):
    df = spark.createDataFrame([("z" * 300 + " Invoice total " + "y" * 300, "invoice x"), ("short", "none")], "content string, query string")
    got = [r[0] for r in df.select(retrieval.snippet("content", "query")).collect()]
    assert got[0].startswith("...") and got[0].endswith("...") and "Invoice" in got[0] and got[1] == "short"
    df = spark.createDataFrame([("The total (net) is", "TOTAL is (net)")], "t string, q string")
    assert df.select(retrieval.highlighted("t", "q")).first()[0] == "The **total** **(net)** is"


def test_vector_checks(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0],), ([],)], "v array<double>")
    assert [r[0] for r in df.select(vectors.vector_issue("v", 2)).collect()] == [None, "all zero", "not finite", "wrong dimension", "empty"]


def test_citations_and_status(spark):
    df = spark.createDataFrame([(1, "A [Doc: 7, Page: 2]. B [Doc: 7, Page: 2] [Doc: 9, Page: 1]")], "answer_id long, text string")
    assert [(r.document_id, r.page, r.place) for r in context.citations(df).orderBy("place").collect()] == [("7", "2", 1), ("9", "1", 2)]
    df = spark.createDataFrame([("", 0, 0, 0.5), ("I cannot find it", 1, 1, 0.5), ("x", 0, 0, 0.5), ("x", 0, 2, 0.5), ("x", 2, 2, 0.8)], "text string, n_citations int, n_context int, mean_score double")
    got = [(r.status, r.confidence) for r in context.answer_status(df).collect()]
    assert got == [("refused", 0.0), ("refused", 0.0), ("low_confidence", 0.2), ("low_confidence", 0.25), ("valid", 0.9)]


def test_retrieval_metrics(spark):
    got = spark.createDataFrame([(1, c, i + 1) for i, c in enumerate("abcde")], "query_id long, item string, rank int")
    rel = spark.createDataFrame([(1, "b"), (1, "z")], "query_id long, item string")
    r = evaluation.retrieval_metrics(got, rel, (5,)).first()
    assert (r.recall, r.precision, r.mrr, r.hit) == (0.5, 0.2, 0.5, 1)
    assert r.ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)), abs=1e-6)


def test_redaction_and_fingerprint(spark):
    df = spark.createDataFrame([("Bearer abc.d_e and 123-45-6789", "E", "first\nsecond")], "t string, kind string, message string")
    r = df.select(monitoring.redacted_text("t"), monitoring.fingerprint("kind", "message")).first()
    assert r[0] == "Bearer ***REDACTED*** and ***SSN-REDACTED***" and len(r[1]) == 16


def test_entry_without_training_operators():
    """Nothing outside the subpackage imports it."""
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for p in (root / "docweave").rglob("*.py"):
        if "llm" not in p.relative_to(root / "docweave").parts:
            assert "llm" not in p.read_text(), p


def test_lsh_finds_nine_of_ten_neighbours(spark):
    from docweave.plans import queries_search as S

    d = "/root/testdata/sf0.1"
    exact = {(r.query_id, r.id) for r in vectors.top_k(S.vectors(spark, d), S.vector_queries(spark, d), 10).collect()}
    found = {(r.query_id, r.id) for r in S.vector_lsh(spark, d).collect()}
    recall = len(exact & found) / len(exact)
    print(f"recall {recall:.3f}")
    assert recall >= 0.9


def test_percentiles_of_one_heavy_key(spark):
    rng = random.Random(3)
    values = {"heavy": [rng.choice([5.0, rng.random() * 100]) for _ in range(3000)], "one": [2.5], "same": [1.0] * 40}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "kind string, ms double")
    for r in evaluation.percentiles(df, "kind").collect():
        own = sorted(values[r.kind])
        assert [r.p50, r.p95, r.p99] == [own[min(len(own) * p // 100, len(own) - 1)] for p in (50, 95, 99)]


def test_trail_across_stretches(spark):
    docs = spark.createDataFrame([("a" if i % 3 else "b", i) for i in range(50)], "run_id string, document_id long")
    found = spark.createDataFrame([(i, i % 2 == 0) for i in range(50) for _ in range(i % 4)], "document_id long, triggered boolean")
    rows = [sorted(map(tuple, context.memory_trail(found, docs, w).collect())) for w in (7, 1000)]
    assert rows[0] == rows[1] and len(rows[0]) == 50 and max(r[3] for r in rows[0] if r[0] == "a") == sum(i % 4 for i in range(50) if i % 3)


def test_nearest_vectors_by_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)] if i % 11 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(5)
    q = df.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    good = {i: v for i, v in rows if v and norm(v)}
    for block in (2_000, 4):
        got = {}
        for r in vectors.top_k(df, q, 4, block=block).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
        want = {}
        for i in (i for i in good if i % 20 == 0):
            near = sorted((-round(sum(a * b for a, b in zip(good[i], v, strict=True)) / norm(good[i]) / norm(v), 6), j) for j, v in good.items() if j != i)[:4]
            want[i] = [(k + 1, j, -s + 0.0) for k, (s, j) in enumerate(near)]
        assert {i: sorted(v) for i, v in got.items()} == want


def test_policies_have_sections_without_a_name(spark):
    rows = [(d, f"{d}{i}", "heading" if i == 2 else "paragraph", t, 1, i) for d in (1, 2) for i, t in enumerate(["before", "more", "Scope", "after"])]
    blocks = spark.createDataFrame(rows, "document_id long, block_id string, type string, text string, page int, order int")
    types = spark.createDataFrame([(1, "policy"), (2, "contract")], "document_id long, document_type string")
    got = sorted((r.document_id, r.chunk_type, str(r.section_name), r.content) for r in chunking.by_family(blocks, types).collect())
    assert got == [(1, "section", "None", "before\nmore"), (1, "section", "Scope", "Scope\nafter"), (2, "clause", "Preamble", "before\nmore"), (2, "clause", "Scope", "Scope\nafter")]
    own = {"policy": lambda b: chunking.clauses(b, "Own", "own")}
    assert {r.section_name for r in chunking.by_family(blocks, types, own).where("chunk_type = 'own'").collect()} == {"Own", "Scope"}


def test_last_value_counts(spark):
    df = spark.createDataFrame([(1, "vendor", "old", 0.9, 1), (1, "vendor", "new", 0.1, 2)], "document_id long, key string, value string, confidence double, seq int")
    assert extract.field_map(df).first().fields == {"vendor": "new"}
    facts = spark.createDataFrame([(1, "subtotal", 5.0, 0.9, 1), (1, "subtotal", 7.0, 0.1, 2), (1, "discount", 1.0, 0.5, 3)], "document_id long, fact_type string, value double, confidence double, seq int")
    r = extract.fact_map(facts).first()
    assert (r.subtotal, r.discount, r.invoice_total) == (7.0, 1.0, None)


def test_every_reason_of_a_field(spark):
    rows = [("currency", "CHF", 0.9), ("currency", "ZZZ", 0.9), ("due_date", "1/2/2020", 0.9), ("vendor", " ", 0.9), ("vendor", "x", 0.5)]
    df = spark.createDataFrame(rows, "key string, value string, confidence double")
    got = [(r.status, r.issue) for r in extract.validate_fields(df, rules.CURRENCIES).collect()]
    assert got == [("valid", None), ("needs_review", "unknown currency"), ("needs_review", "date not ISO"), ("invalid", "empty value"), ("needs_review", "low confidence")]


def test_embedder_and_reranker_hooks(spark):
    store = spark.createDataFrame([("a", "m1", True)], "text string, model string, is_active boolean").withColumn("hash", F.sha2("text", 256))
    new = spark.createDataFrame([("a", "m1"), ("a", "m2"), ("b", "m1")], "text string, model string")
    todo = vectors.embedded(vectors.to_embed(new, store), lambda t: F.array(F.length(t).cast("double")))
    assert sorted((r.text, r.model, r.vector) for r in todo.collect()) == [("a", "m2", [1.0]), ("b", "m1", [1.0])]
    found = spark.createDataFrame([(1, "c1", 0.9, "q", "long content"), (1, "c2", 0.1, "q", "q")], "query_id long, chunk_id string, fused double, query string, content string")
    top = retrieval.rerank(found, scorer=lambda q, c: F.when(q == c, 5.0).otherwise(-5.0)).where("rank = 1").first()
    assert top.chunk_id == "c2"


def test_late_events_are_dropped(spark, tmp_path):
    """Four batches: the last has a row of a window that the watermark passed two batches ago."""
    from docweave.streaming import streams

    parts = [["10:00:10", "10:00:50", "10:01:10"], ["10:30:00"], ["10:31:00"], ["10:00:20", "10:50:00"]]
    for i, times in enumerate(parts):
        rows = spark.createDataFrame([(f"2024-01-01 {t}", "click") for t in times], "ts string, event_type string").withColumn("ts", F.to_timestamp_ntz("ts"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are read in the order of their time
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    counts = streams.counters(streams.read_stream(spark, str(tmp_path / "in"), schema, 1), "event_type")
    counts.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {str(r.start)[11:16]: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"10:00": 2, "10:01": 1, "10:30": 1, "10:31": 1}
