"""Packing, nested documents, hooks, capped memories, redaction, search modes, evaluation runs and streams on small frames."""

import json
import random
import time

from pyspark.sql import functions as F

from docweave.operators import admission, chunking, context, evaluation, extract, monitoring, retrieval
from docweave.streaming import streams


def greedy(sizes, budget, overlap):
    """The starts of greedy chunks, one part after the other."""
    begin, total = [0], sizes[0]
    for i, t in enumerate(sizes[1:], 1):
        if total + t > budget:
            begin.append(i)
            total = (sizes[i - 1] if overlap else 0) + t
        else:
            total += t
    return begin


def test_jumps_are_those_of_a_greedy_walk(spark):
    rng = random.Random(1)
    docs = {k: [rng.choice([1, 2, 5, 9, 30]) for _ in range(rng.randrange(1, 60))] for k in range(40)}
    rows = [(k, i, t) for k, sizes in docs.items() for i, t in enumerate(sizes)]
    df = spark.createDataFrame(rows, "k int, i int, t int")
    for overlap in (0, 1):
        sized = chunking.packable(df, ["k"], ["i"], F.col("t"), 20).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("at", "sum", "upto"))).alias("parts"))
        got = {r.k: list(r.s) for r in sized.select("k", chunking.starts(F.col("parts"), 20, overlap).alias("s")).collect()}
        assert got == {k: greedy(sizes, 20, overlap) for k, sizes in docs.items()}


def test_a_document_of_many_blocks_is_packed_in_seconds(spark):
    n = 100_000
    df = spark.range(n).select(F.lit(1).alias("document_id"), F.concat(F.lit("b"), F.col("id").cast("string")).alias("block_id"), F.lit("paragraph").alias("type"), F.concat(F.lit("some text of block "), F.col("id").cast("string")).alias("text"), (F.col("id") / 50).cast("int").alias("page"), F.col("id").cast("int").alias("order"))
    began = time.time()
    made = chunking.windowed(df, 100).select(F.size("block_ids").alias("n"), F.length("content").alias("c")).agg(F.count("*"), F.sum("n"), F.max("c")).first()
    assert made[1] == n and made[0] > n / 30 and time.time() - began < 60


def test_nested_documents_with_and_without_parts(spark):
    blocks = spark.createDataFrame([(1, "b0", "heading", "H", 1, 0), (1, "b1", "paragraph", "p", 1, 1), (1, "b2", "paragraph", "q", 2, 2), (2, "c0", "paragraph", "only", 1, 0)], "document_id long, block_id string, type string, text string, page int, order int")
    pages = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "document_id long, page int")
    cells = spark.createDataFrame([(1, "t", 2, 0, 0, "a"), (1, "t", 2, 1, 1, "d")], "document_id long, table_id string, page int, row int, col int, text string")
    images = spark.createDataFrame([(1, "i", 3, None)], "document_id long, image_id string, page int, caption string")
    got = {r.document_id: r.document for r in chunking.nested(blocks, pages, cells, images).collect()}
    assert [(p.page, list(p.reading_order)) for p in got[1].pages] == [(1, ["b0", "b1"]), (2, ["b2"]), (3, [])]
    assert [(t.table_id, t.row_count, t.col_count, len(t.cells)) for t in got[1].tables] == [("t", 2, 2, 2)] and got[1].images[0].image_id == "i"
    assert [(r.source, r.target) for r in got[1].relationships] == [("b0", "b1"), ("b0", "b2")] and got[1].raw_text == "H\np\nq"
    assert got[2].tables == got[2].images == got[2].relationships == [] and len(got[2].blocks) == 1


def test_own_extractor(spark):
    @F.udtf(returnType="key string, value string, confidence double", useArrow=True)
    class Words:
        def eval(self, text):
            for i, w in enumerate((text or "").split()):
                yield "word", w if w != "-" else None, float(i)

    df = spark.createDataFrame([(1, "a - b"), (2, None), (3, "")], "document_id long, text string")
    assert sorted(map(tuple, extract.extracted(df, Words, "words").collect())) == [(1, "word", "a", 0.0, "words"), (1, "word", "b", 1.0, "words")]


def test_memories_are_capped(spark):
    f = spark.createDataFrame([("r", i, f"f{i}") for i in range(9)] + [("s", 1, "x")], "run_id string, position int, text string")
    sev = ["low", "medium", "critical", "high", None]
    flags = spark.createDataFrame([("r", i, sev[i % 5], f"g{i}") for i in range(12)], "run_id string, position int, severity string, text string")
    got = {r.run_id: r for r in context.capped_memory(f, flags, f.where("position > 6"), 2).collect()}
    assert list(got["r"].key_findings) == ["f7", "f8"] and list(got["r"].open_questions) == ["f7", "f8"] and list(got["s"].key_findings) == ["x"] and list(got["s"].risk_flags) == []
    assert [x.text for x in got["r"].risk_flags] == ["g2", "g7", "g3", "g8"]
    kept = {r.position for r in context.capped(flags, 1, keep_all_high=True).collect()}
    assert {2, 7, 3, 8} <= kept and len(kept) == 6


def test_nested_values_are_redacted(spark):
    doc = {"a": {"Password": "x", "b": {"c": {"token": 1, "d": {"e": 1}}, "n": 2.5}}, "list": [{"ssn": "1"}, 2, None], "long": "y" * 2001, "short": "z", "none": None}
    df = spark.createDataFrame([(json.dumps(doc),), ('"text"',), ("[1]",), (None,)], "s string")
    red = lambda **k: [None if r.j is None else json.loads(r.j) for r in df.select(F.to_json(monitoring.redacted_variant(F.parse_json("s"), **k)).alias("j")).collect()]
    mark = "***REDACTED***"
    got, text, numbers, nothing = red(depth=4)
    assert got == {"a": {"Password": mark, "b": {"c": {"token": mark, "d": mark}, "n": 2.5}}, "list": [{"ssn": "1"}, 2, None], "long": "y" * 200 + "...[truncated, full document content not logged]", "short": "z", "none": None}
    assert (text, numbers, nothing) == ("text", [1], None)
    assert red(depth=4, into_lists=True)[0]["list"] == [{"ssn": mark}, 2, None] and red(depth=1)[0]["a"] == mark


def test_rows_that_hold_a_query(spark):
    rows = spark.createDataFrame([(1, "INV-12"), (2, "inv-1"), (3, None), (4, "x")], "document_id long, value string")
    q = spark.createDataFrame([(7, "nv-1"), (8, "12"), (9, "zz")], "query_id long, query string")
    assert sorted((r.query_id, r.document_id) for r in retrieval.holding(rows, "value", q).collect()) == [(7, 1), (7, 2), (8, 1)]


def test_percentiles_of_repeated_values(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([1.0, 2.0, 2.0, 7.5, rng.random() * 90])) for k in "abc" for _ in range(rng.randrange(1, 700))] + [("d", 4.0)] * 300
    got = {r.k: r for r in evaluation.percentiles(spark.createDataFrame(rows, "k string, ms double"), "k").collect()}
    for k in "abcd":
        own = sorted(v for x, v in rows if x == k)
        assert [got[k][f"p{p}"] for p in (50, 95, 99)] == [own[min(len(own) * p // 100, len(own) - 1)] for p in (50, 95, 99)]
        assert abs(got[k].avg - sum(own) / len(own)) < 1e-5


def test_documents_that_come_again_are_there_once(spark, tmp_path):
    batches = [[(1, "a.md", 5, 1), (2, "b.md", 5, 1)], [(2, "c.md", 5, 2), (3, "d.exe", 5, 1), (1, "a.md", 5, 1)], [(2, "old.md", 5, 1), (4, "e.md", 5, 1)]]
    schema = "file_id long, file_name string, size long, version int"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        streams.ingest_documents(s, f"{tmp_path}/out", f"{tmp_path}/state", buckets=3).awaitTermination()
    got = sorted((r.file_id, r.file_name, r.version, r.reject_reason) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, "a.md", 1, None), (2, "c.md", 2, None), (3, "d.exe", 1, "denied type"), (4, "e.md", 1, None)]
    # without its checkpoint, everything comes again: nothing changes
    streams.ingest_documents(s, f"{tmp_path}/out", f"{tmp_path}/fresh", buckets=3).awaitTermination()
    assert sorted((r.file_id, r.file_name, r.version, r.reject_reason) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == got


def test_failed_stages(spark):
    rows = spark.createDataFrame([(1, "valid"), (1, "invalid"), (2, "valid"), (3, "valid")], "document_id long, status string")
    bad = spark.createDataFrame([(3,), (4,), (4,)], "document_id long")
    assert sorted((r.document_id, r.total, r.status) for r in admission.run_log(rows, "x", bad).collect()) == [(1, 2, "needs_review"), (2, 1, "completed"), (3, 1, "failed"), (4, 0, "failed")]
