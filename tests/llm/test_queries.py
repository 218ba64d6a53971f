"""The registered queries and the pipeline on the smallest tables."""

import hashlib
import random

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from docweave.llm import bpe, decontaminate, line_dedup, ngram_join, quality, queries, suffix_dedup

DATA = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))


def test_line_dedup_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{DATA}/documents.parquet')")
    assert sorted(map(tuple, queries.QUERIES["op7_line_dedup"](spark, DATA).collect())) == sorted(con.execute(queries.ORACLES["op7_line_dedup"]).fetchall())


@pytest.mark.parametrize("name", ["op1_toxicity", "op2_ngram_join", "op3_bpe", "op4_license_scan", "op5_token_counts", "op6_quality_rules", "op8_suffix_dedup", "op10_decontaminate"])
def test_one_row_per_document(spark, name):
    got = [r.doc_id for r in queries.QUERIES[name](spark, DATA).select("doc_id").collect()]
    assert sorted(got) == sorted(r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect())


def test_pipeline_is_its_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("benchmark", "labels"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "encoding"]
    kept = {r.doc_id for r in quality.judge(docs, labels).where("kept").collect()}
    one = quality.apply(docs, labels)
    assert {r.doc_id for r in one.collect()} == kept and one.columns == docs.columns
    two = spark.createDataFrame(line_dedup.apply(one).collect(), docs.schema)
    assert all(r.n_chars == len(r.text) for r in two.collect())
    classes = ngram_join.duplicates(two).where("n_shingles > 0").select("component_id").distinct().count()
    three = spark.createDataFrame(ngram_join.deduplicate(two).collect(), docs.schema)
    assert three.count() == classes + two.where("trim(text) = ''").count()
    bad = {r.doc_id for r in decontaminate.report(three, bench).where("contaminated").collect()}
    want = {r.doc_id for r in three.collect()} - bad
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in got} == want and len(got) == len(want)
    assert set(got[0].asDict()) == set(bpe.digests(bpe.decode(bpe.encode(docs.limit(1), {bytes([b]): b for b in range(256)}, "(?s:.)"), {bytes([b]): b for b in range(256)})).columns)


LICENSE_SQL = r"""
with words as (
  select doc_id, unnest(w) as word, generate_subscripts(w, 1) - 1 as i, len(w) as n from (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents)
), ahead as (
  select *, lead(word, 1) over o as w1, lead(word, 2) over o as w2 from words window o as (partition by doc_id order by i)
), places as (
  select doc_id, i, 'cc-by' as label from ahead where word = 'cc' and w1 = 'by'
  union all select doc_id, i, 'gpl' from ahead where word = 'general' and w1 = 'public' and w2 = 'license'
  union all select doc_id, i, 'reserved' from ahead where word = 'all' and w1 = 'rights' and w2 = 'reserved'
), base as (
  select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, string_agg(distinct label, ',' order by label) as base_labels from places group by 1
), counted as (select doc_id, count(*) as n_words from words group by 1)
select d.doc_id, coalesce(c.n_words, 0), coalesce(b.n_base, 0), b.first_word, b.last_word, coalesce(b.base_labels, '')
from documents d left join counted c using (doc_id) left join base b using (doc_id)
"""


def test_license_base_is_that_of_the_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{DATA}/documents.parquet')")
    got = queries.QUERIES["op4_license_scan"](spark, DATA).collect()
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, con.execute(LICENSE_SQL).fetchall()))
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_chat_query_against_the_conversations(spark):
    said = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    own = "</s>[INST] ok [/INST]"
    said += [(-1, 0, "user", own), (-1, 1, "assistant", own)]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for conv in {r[0] for r in said}:
        turns = [(r[2], r[3] or "") for r in sorted((x for x in said if x[0] == conv), key=lambda x: x[1])]
        loss = "".join(t for role, t in turns if role == "assistant")
        want[conv] = (len(turns), digest("".join(f"{role}\n{t}\n" for role, t in turns)), len(loss), digest(loss))
    got = {r.conv_id: r for r in queries.QUERIES["op9_chat_format"](spark, DATA).collect()}
    assert {c: tuple(r)[1:5] for c, r in got.items()} == want
    assert all(r.formatted_chars >= r.loss_chars for r in got.values()) and -1 in got


def test_toxicity_and_quality_on_held_out_labels(spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    tox = queries.QUERIES["op1_toxicity"](spark, DATA).collect()
    held = [r for r in tox if r.held_out and r.doc_id in labels]
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in tox)
    assert sum(r.predicted == labels[r.doc_id].toxic for r in held) >= 0.9 * len(held)
    rows = queries.QUERIES["op6_quality_rules"](spark, DATA).collect()
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in rows)


# ---- rows that were shuffled, and odd rows through every stage ------------------------------------------------------


def shuffled(spark, docs):
    """The same rows, dealt by a shuffle that adaptive execution coalesces, with a column that nothing reads."""
    return docs.withColumn("more", docs["text"]).dropDuplicates(["doc_id"])


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_the_same_rows_of_shuffled_input(spark, stage):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        one, other = (sorted((r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)[stage](spark, d, DATA).collect()) for d in (docs, shuffled(spark, docs)))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert [i for i, _ in one] == [i for i, _ in other] and (stage == "near_duplicates" or one == other)


def test_suffix_dedup_of_shuffled_input(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one, other = (sorted(map(tuple, suffix_dedup.remove(d).collect())) for d in (docs, shuffled(spark, docs)))
    assert one == other


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, stage):
    """Null ids and texts, repeated rows, empty and very long texts, and columns whose names the stages use themselves."""
    long = " ".join(f"w{random.Random(5).randrange(9)}{i}" for i in range(120_000))
    texts = [None, "", " \n ", "one two", "one two", long, long, "x" * 300_000, "line of five words here\n" * 400]
    rows = [(None if i % 3 == 2 else i // 2, t, "en", "s", len(t or ""), i, b"r", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, uid int, runs binary, gone_lines int")
    step = dict(corpus_pipeline.STAGES)[stage]
    got, none = step(spark, docs, DATA), step(spark, docs.where("uid < 0"), DATA)
    assert none.count() == 0 and got.count() <= len(rows)
    assert stage == "encoding" and got.count() == len(rows) or got.columns == docs.columns
