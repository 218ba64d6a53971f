"""What the reviewer of round 3 found."""

import numpy as np

from docweave.operators import admission, retrieval, text_index, vectors
from docweave.plans import queries_more


def test_preview_has_no_empty_words(spark):
    rows = [(1, 1, 0, "one two "), (1, 2, 20, " \t"), (2, 1, 0, "\tthree"), (2, 1, 1, "four \n\t")]
    blocks = spark.createDataFrame(rows, "document_id long, page int, order int, text string")
    got = {r["document_id"]: r["preview"] for r in admission.sampled_preview(blocks).collect()}
    assert got == {1: "one two", 2: "three four"}
    cut = spark.createDataFrame([(1, 1, 0, "one two three")], blocks.schema)
    assert admission.sampled_preview(cut, chars=4).first()["preview"] == "one"


def test_a_search_shuffles_no_pairs_of_queries_and_chunks(spark, tmp_path):
    """Its result is written, so that what reads it twice does not search twice; shards are no partitions of a shuffle."""
    chunks = spark.range(300).selectExpr("concat('c', id) as chunk_id", "concat('a b w', id % 7) as content")
    asked = spark.createDataFrame([(1, "a b"), (2, "w3 a")], "query_id long, query string")
    index = text_index.build(chunks, str(tmp_path / "index"), 2)
    assert index.chunks.select("shard").distinct().count() > 50 and len(index.blocks.inputFiles()) < 10
    found = text_index.search(index, asked, 5, str(tmp_path / "found"))
    assert found.inputFiles() and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = retrieval.bm25(retrieval.postings(chunks), asked, 5)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.select(*found.columns).collect()))


def test_stream_documents_reads_in_many_tasks(spark, tmp_path, monkeypatch):
    """Each batch comes in as many files as its input has parts."""
    docs = spark.range(400).selectExpr("id as doc_id", "repeat('x', cast(id % 50 as int)) as text")
    docs.repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(queries_more, "shared_folder", lambda _: f"file://{tmp_path}/shared")
    names = "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"
    kept = [spark.conf.get(n) for n in names]
    try:
        for n, value in zip(names, ("0", "1000"), strict=True):
            spark.conf.set(n, value)
        got = {r.file_id: (r.file_name, r.version) for r in queries_more.stream_documents(spark, str(tmp_path)).collect()}
    finally:
        for n, value in zip(names, kept, strict=True):
            spark.conf.set(n, value)
    assert got == {i: (f"{'new' if i % 3 == 0 else 'doc'}-{i}.md", 2 if i % 3 == 0 else 1) for i in range(400)}
    assert all(len(list((tmp_path / "shared" / "in" / str(n)).glob("*.parquet"))) > 1 for n in range(3))




def test_lsh_makes_no_pairs(spark):
    """The nearest of those that share a bucket, by brute force; no join and no shuffle of pairs."""
    rng = np.random.default_rng(5)
    v, planes = rng.standard_normal((300, 8)), np.random.default_rng(7).standard_normal((3, 4, 8)).round(4)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, vector array<double>")
    got = vectors.lsh_top_k(df, df.where("id % 20 = 0").selectExpr("id as query_id", "vector"), 5, 8, 3, 4, probes=1)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    u = v / np.linalg.norm(v, axis=1)[:, None]
    m = np.einsum("nd,tbd->ntb", u, planes)
    want = []
    for a in range(0, 300, 20):
        other = m[a].copy()
        for t in range(3):
            b = np.argmin(np.abs(m[a, t]))
            other[t, b] = -other[t, b]
        met = ((np.sign(m) == np.sign(m[a])).all(axis=2) | (np.sign(m) == np.sign(other)).all(axis=2)).any(axis=1)
        own = sorted((-round(float(u[a] @ u[i]), 6), i) for i in range(300) if met[i] and i != a)[:5]
        want += [(a, i, -s, n + 1) for n, (s, i) in enumerate(own)]
    assert sorted((r.query_id, r.id, r.score + 0.0, r["rank"]) for r in got.collect()) == sorted(want)


def test_what_picks_few_chunks_does_not_derive_them_again(spark):
    from docweave.plans import queries_ops, queries_search

    d = "/root/testdata/sf0.001"
    for f in (queries_ops.context_in_budget, queries_ops.prompts, queries_search.snippets, queries_search.reranked_query):
        assert not [p for p in f(spark, d).inputFiles() if "documents.parquet" in p]
    assert queries_search.kept_chunks(spark, d) is queries_search.kept_chunks(spark, d)


def test_blocks_of_a_shard_that_comes_in_many_batches(spark, tmp_path):
    """Words as the postings split them, whatever blanks, letters and batches there are; a shard's words are not exploded into rows."""
    texts = ["a\x0bA b \tİx ΣΣ", "\n a a ", "", None, "\x0b", " x y a"] * 20
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chunk_id long, content string")
    asked = spark.createDataFrame([(1, "a x   İx σσ"), (2, "a b"), (3, "x y A")], "query_id long, query string")
    key, kept = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set(key, 3)
        index = text_index.build(chunks, str(tmp_path / "index"), 50)
    finally:
        spark.conf.set(key, kept)
    want = retrieval.postings(chunks)
    assert sorted(map(tuple, index.blocks.selectExpr("term", "inline(postings)").select("chunk_id", "term", "tf").collect())) == sorted(map(tuple, want.select("chunk_id", "term", "tf").collect()))
    assert index.blocks.where("size(postings) <> df or postings <> sort_array(postings)").count() == 0 and index.chunks.columns == ["shard", "chunk_id", "length"]
    assert sorted(map(str, text_index.search(index, asked, 5).collect())) == sorted(map(str, retrieval.bm25(want, asked, 5).select("query_id", "chunk_id", "score", "rank").collect()))


def test_scoped_search_shuffles_texts_and_no_postings(spark):
    rng = np.random.default_rng(11)
    text = lambda: None if rng.random() < 0.05 else " ".join(f"W{int(x)}" for x in rng.zipf(1.6, rng.integers(0, 12)) if x < 40)
    chunks = spark.createDataFrame([(i % 9 if i % 11 else None, f"c{i:03d}", text()) for i in range(300)], "document_id int, chunk_id string, content string")
    asked = spark.createDataFrame([(i, i % 10, f"w1 w{i % 6} W{i % 4} w1 w99") for i in range(40)] + [(50, 1, None), (51, 2, " "), (52, None, "w1")], "query_id int, document_id int, query string")
    want = retrieval.bm25(retrieval.postings(chunks, "document_id"), asked, 5, ("document_id",))
    got = retrieval.bm25_scoped(chunks, asked, 5, "document_id")
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and want.count() > 100
    deals = [line.split("hashpartitioning(")[1] for line in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line]
    assert deals and not [x for x in deals if "chunk_id" in x and "query_id" not in x]  # postings of all terms of all chunks


def test_fields_come_from_one_pass_over_the_texts(spark):
    from docweave.operators import extract
    from docweave.plans import queries_text

    texts = ["Invoice Date: 03/09/1997\nDue Date: 1997-3-9\nCurrency: EUR", "paid on Mar 5, 2020 in $", "Due Date: 13/02/2001", "Expiry Date: 12-31-99 or 1/2-2003", "due date: 2001-02-30", "", None, "on 1/2/03, £ and USD"]
    docs = spark.createDataFrame([(i, t, "XYZ" if i % 2 else None) for i, t in enumerate(texts)], "document_id long, text string, own string")
    got = sorted((r.document_id, r.key, r.value, r.confidence, r.extractor) for r in extract.fields(docs, {"given_code": "own"}).collect())
    assert got == sorted([
        (0, "currency", "EUR", 0.9, "currency"), (0, "invoice_date", "1997-03-09", 0.8, "date"), (1, "currency", "USD", 0.6, "currency"), (1, "document_date", "2020-03-05", 0.5, "date"),
        (2, "due_date", "2001-02-13", 0.8, "date"), (7, "currency", "USD", 0.9, "currency"), (7, "document_date", "2003-01-02", 0.5, "date"), *((i, "given_code", "XYZ", 0.5, "given") for i in (1, 3, 5, 7)),
    ])
    both = extract.currencies(docs).unionByName(extract.dates(docs))
    assert sorted((r.document_id, r.key, r.value, r.confidence, r.extractor) for r in both.collect()) == [r for r in got if r[1] != "given_code"]
    plan = queries_text.fields(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("o_orderkey#") and plan.count("l_linenumber#") and plan.count("Window [") == 1


def test_dates_are_those_of_trying_every_format(spark):
    from pyspark.sql import functions as F

    from docweave.operators import extract

    said = ["1997-03-09", "1997-3-9", "3/9/1997", "3-9-1997", "13-9-1997", "3/9/97", "13/9/1997", "13/9/97", "3/9-1997", "Mar 9, 1997", "March 9, 1997", "Mar 9 1997", "March 9 1997", "mar 9, 1997", "Sept 9, 1997", "", "x", "2001-02-30", "2/30/2001", None]
    df = spark.createDataFrame([(t,) for t in said], "t string")
    plain = F.date_format(F.coalesce(*(F.try_to_date("t", f) for f in extract.DATE_FORMATS)), "yyyy-MM-dd")
    assert df.where(~extract.iso_date(F.col("t")).eqNullSafe(plain)).count() == 0 and df.where(plain.isNotNull()).count() > 8


def test_rules_are_counted_once_for_their_log_and_result(spark):
    from docweave.plans import queries_rules

    plan = queries_rules.findings_of_active_rules(spark, "/root/testdata/sf0.001")
    assert not [p for p in plan.inputFiles() if "lineitem" in p]
