"""Retrieval and answer metrics, run comparison, quality gates and case generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 5, 10, 20, 50)
TOLERANCE = 0.02


def retrieval_metrics(retrieved: DataFrame, relevant: DataFrame, ks=KS) -> DataFrame:
    """(query_id, k, recall, precision, mrr, ndcg, hit): retrieved (query_id, item, rank), relevant (query_id, item)."""
    rel = relevant.select("query_id", "item", F.lit(1).alias("is_relevant")).distinct()
    queries = retrieved.select("query_id").union(relevant.select("query_id")).distinct()
    n = rel.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    got = retrieved.join(rel, ["query_id", "item"], "left").withColumn("hit", F.coalesce("is_relevant", F.lit(0)))
    sums = [F.struct(F.lit(k).alias("k"), F.sum(F.when(F.col("rank") <= k, F.col("hit"))).alias("hits"), F.count_if(F.col("rank") <= k).alias("returned"), F.sum(F.when(F.col("rank") <= k, F.col("hit") / F.log2(F.col("rank") + 1.0))).alias("dcg")) for k in ks]
    g = got.groupBy("query_id").agg(F.array(*sums).alias("at"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    out = queries.join(g, "query_id", "left").join(n, "query_id", "left").select("query_id", "first", F.coalesce("n_relevant", F.lit(0)).alias("n"), F.explode_outer("at").alias("a"))
    hits = F.coalesce("a.hits", F.lit(0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest("n", F.lit(1)), F.col("a.k").cast("long"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return out.where("a is not null").select(
        "query_id", F.col("a.k").alias("k"), zero(F.try_divide(hits, F.col("n"))).alias("recall"), zero(F.try_divide(hits, F.col("a.returned"))).alias("precision"),
        zero(1 / F.col("first")).alias("mrr"), zero(F.when(F.col("n") > 0, F.col("a.dcg") / ideal)).alias("ndcg"), (hits > 0).cast("int").alias("hit"),
    )


def citation_metrics(generated: DataFrame, expected: DataFrame) -> DataFrame:
    """(answer_id, precision, recall) on (document_id, page); repeats count in precision, not in recall."""
    e = expected.select("answer_id", "document_id", F.col("page").cast("string").alias("page")).distinct()
    g = generated.select("answer_id", "document_id", F.col("page").cast("string").alias("page"))
    p = g.join(e.withColumn("ok", F.lit(1)), ["answer_id", "document_id", "page"], "left").groupBy("answer_id").agg(F.round(F.count("ok") / F.count("*"), 6).alias("precision"))
    r = e.join(g.distinct().withColumn("ok", F.lit(1)), ["answer_id", "document_id", "page"], "left").groupBy("answer_id").agg(F.round(F.count("ok") / F.count("*"), 6).alias("recall"))
    return p.join(r, "answer_id", "full").select("answer_id", F.coalesce("precision", F.lit(0.0)).alias("precision"), F.coalesce("recall", F.lit(1.0)).alias("recall"))


def citation_coverage(text: str, n: str) -> Column:
    sentences = F.size(F.filter(F.split(text, r"\."), lambda s: F.trim(s) != ""))
    return F.when(sentences == 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), F.col(n) / sentences), 6))


def numbers(text: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\b\d[\d,]*\.?\d*\b"), F.lit(0)), lambda m: F.regexp_replace(m, ",", "").try_cast("double"))


def numerical_accuracy(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """(answer_id, accuracy, mismatches): how many ground-truth facts (answer_id, fact_type, value) an answer's numbers meet."""
    pairs = facts.where("value is not null").join(answers.select("answer_id", numbers("text").alias("said")), "answer_id")
    met = F.exists("said", lambda x: F.abs(x - F.col("value")) <= TOLERANCE * F.greatest(F.abs("value"), F.lit(1.0)))
    g = pairs.withColumn("met", met).groupBy("answer_id").agg(F.round(F.avg(F.col("met").cast("int")), 6).alias("accuracy"), F.array_join(F.sort_array(F.collect_set(F.when(~F.col("met"), F.col("fact_type")))), ",").alias("mismatches"))
    return answers.select("answer_id").join(g, "answer_id", "left")


#: Ranges of a key's values that are counted before values are numbered.
RANGES = 64


def percentiles(samples: DataFrame, *keys: str, value: str = "ms", ps=(50, 95, 99)) -> DataFrame:
    """avg and nearest-rank percentiles of each key, without bringing a key's values together.

    Equal values of a key are counted once, and everything else reads these counts. They are dealt into ranges between approximate quantiles of
    the key's different values; the counts before each range find the one that holds a rank, and only within that range values are numbered.
    """
    counted = samples.groupBy(*keys, value).agg(F.count("*").alias("times"))
    weight = F.col(value) * F.col("times")
    bounds = counted.groupBy(*keys).agg(F.percentile_approx(value, F.array(*(F.lit(i / RANGES) for i in range(1, RANGES))), 1_000).alias("bounds"), F.sum("times").alias("n"), F.round(F.sum(weight) / F.sum(F.when(F.col(value).isNotNull(), F.col("times"))), 6).alias("avg"))
    part = F.size(F.filter("bounds", lambda b: b < F.col(value)))
    dealt = counted.where(F.col(value).isNotNull()).join(bounds.select(*keys, "bounds"), list(keys)).select(*keys, value, "times", part.alias("part"))
    sizes = dealt.groupBy(*keys, "part").agg(F.sum("times").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.partitionBy(*keys).orderBy("part")) - F.col("size"))  # up to RANGES rows a key
    at = lambda p: F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1)
    asked = bounds.select(*keys, "avg", F.explode(F.array(*(F.struct(F.lit(p).alias("p"), at(p).alias("at")) for p in ps))).alias("a")).select(*keys, "avg", "a.*")
    held = asked.join(before, list(keys)).where("before <= at and at < before + size").select(*keys, "avg", "part", "p", (F.col("at") - F.col("before")).alias("at"))
    ranks = held.groupBy(*keys, "avg", "part").agg(F.collect_list(F.struct("p", "at")).alias("asked"))  # as many as there are percentiles
    upto = F.sum("times").over(Window.partitionBy(*keys, "part").orderBy(value))
    values = dealt.join(ranks, [*keys, "part"]).withColumn("upto", upto)
    met = values.select(*keys, "avg", value, F.explode(F.filter("asked", lambda a: (a["at"] < F.col("upto")) & (a["at"] >= F.col("upto") - F.col("times")))).alias("a"))
    return met.groupBy(*keys, "avg").agg(*(F.max(F.when(F.col("a.p") == p, F.col(value))).alias(f"p{p}") for p in ps))


def mean_metrics(long: DataFrame, *keys: str) -> DataFrame:
    """(keys, metric, value): the mean of each metric, nulls skipped."""
    return long.groupBy(*keys, "metric").agg(F.round(F.avg("value"), 6).alias("value"))


def violations(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """(metric, environment, value, problem): gates (metric, environment, min_value, max_value) that are not met."""
    v = F.col("value")
    problem = F.when(v < F.col("min_value"), "below minimum").when(v > F.col("max_value"), "above maximum")
    return metrics.where("value is not null").join(gates, "metric").withColumn("problem", problem).where("problem is not null").select("metric", "environment", "value", "problem")


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("metric", F.col("value").alias("a")).join(b.select("metric", F.col("value").alias("b")), "metric").where("a is not null and b is not null")
    return both.withColumn("delta", F.round(F.col("b") - F.col("a"), 6))


def baseline(runs: DataFrame) -> DataFrame:
    """The baseline run of each dataset, the newest if there are several."""
    w = Window.partitionBy("dataset_id").orderBy(F.desc("run_id"))
    return runs.where("is_baseline").withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def rule_quality(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """(rule_key, tp, fp, fn, precision, recall, f1) of (document_id, rule_key) pairs."""
    both = predicted.distinct().withColumn("p", F.lit(1)).join(expected.distinct().withColumn("e", F.lit(1)), ["document_id", "rule_key"], "full")
    g = both.groupBy("rule_key").agg(F.count_if(F.col("p").isNotNull() & F.col("e").isNotNull()).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = zero(F.col("tp"), F.col("tp") + F.col("fp")), zero(F.col("tp"), F.col("tp") + F.col("fn"))
    return g.select("rule_key", "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(zero(2 * p * r, p + r), 6).alias("f1"))


def verdicts(cases: DataFrame) -> DataFrame:
    """Adds passed and reason from status, recall_at_10, n_relevant, faithfulness and answered."""
    reason = (
        F.when(F.col("answered") & (F.col("status") == "refused"), "refused").when((F.col("n_relevant") > 0) & (F.col("recall_at_10") == 0), "nothing relevant found")
        .when(F.col("answered") & (F.col("faithfulness") < 0.5), "not faithful").when(~F.col("answered") & (F.col("recall_at_10") <= 0), "nothing relevant found")
    )
    return cases.withColumn("reason", reason).withColumn("passed", F.col("reason").isNull())


def failed(cases: DataFrame) -> DataFrame:
    return cases.where(~F.col("passed"))


def generated_cases(docs: DataFrame, facts: DataFrame, fields: DataFrame, n_facts: int = 5, n_fields: int = 3, chunks: DataFrame | None = None, n_chunks: tuple[int, int] = (5, 3)) -> DataFrame:
    """(document_id, kind, question, expected): one summary and a few fact and metadata questions per document.

    With ``chunks`` (document_id, chunk_id, chunk_index) also ``relevant``: a document's first chunks, five for a summary and three for other cases.
    """
    pick = lambda d, name, n: d.withColumn("i", F.row_number().over(Window.partitionBy("document_id").orderBy(name))).where(F.col("i") <= n)
    ask = lambda kind, q, a: [F.col("document_id"), F.lit(kind).alias("kind"), q.alias("question"), a.cast("string").alias("expected")]
    words = lambda c: F.replace(F.col(c), F.lit("_"), F.lit(" "))
    s = docs.select(*ask("summary", F.concat(F.lit("What is "), F.col("file_name"), F.lit(" about?")), F.lit(None)))
    f = pick(facts, "fact_type", n_facts).select(*ask("fact", F.concat(F.lit("What is the "), words("fact_type"), F.lit("?")), F.col("value").cast("decimal(18,2)")))
    m = pick(fields, "key", n_fields).select(*ask("metadata", F.concat(F.lit("What is the "), words("key"), F.lit("?")), F.col("value")))
    every = s.unionByName(f).unionByName(m)
    if chunks is None:
        return every
    first = pick(chunks, "chunk_index", max(n_chunks)).groupBy("document_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "chunk_id"))), lambda c: c["chunk_id"]).alias("first"))
    n = F.when(F.col("kind") == "summary", n_chunks[0]).otherwise(n_chunks[1])
    none = F.array().cast(first.schema["first"].dataType)
    return every.join(first, "document_id", "left").select("document_id", "kind", "question", "expected", F.coalesce(F.slice("first", F.lit(1), n), none).alias("relevant"))


def run_cases(cases: DataFrame, retrieved: DataFrame, answers: DataFrame, facts: DataFrame, expected: DataFrame, cited: DataFrame, scores: DataFrame) -> DataFrame:
    """A row for each case of an evaluation run, with all its metrics, its verdict and its latency.

    ``cases`` (case_id, answered, relevant), ``retrieved`` (case_id, item, rank), ``answers`` (case_id, text, status), ``facts`` (case_id, fact_type, value),
    ``expected`` and ``cited`` (case_id, document_id, page), ``scores`` (case_id, faithfulness, latency_ms), which a judge and a clock gave.
    """
    as_query = lambda d: d.withColumnRenamed("case_id", "query_id")
    as_answer = lambda d: d.withColumnRenamed("case_id", "answer_id")
    relevant = cases.select("case_id", F.explode("relevant").alias("item"))
    at = retrieval_metrics(as_query(retrieved), as_query(relevant))
    wide = at.groupBy(F.col("query_id").alias("case_id")).agg(*(F.max(F.when(F.col("k") == k, F.col(m))).alias(f"{m}_at_{k}") for m in ("recall", "precision", "ndcg", "hit") for k in KS), F.max("mrr").alias("mrr"))
    cites = citation_metrics(as_answer(cited), as_answer(expected)).select(F.col("answer_id").alias("case_id"), F.col("precision").alias("citation_precision"), F.col("recall").alias("citation_recall"))
    n_cited = cited.groupBy("case_id").agg(F.count("*").alias("n_cited"))
    numeric = numerical_accuracy(as_answer(answers), as_answer(facts)).select(F.col("answer_id").alias("case_id"), F.col("accuracy").alias("numerical_accuracy"))
    out = cases.select("case_id", "answered", F.size("relevant").alias("n_relevant"))
    for d in (wide, answers.select("case_id", "text", "status"), n_cited, cites, numeric, scores):
        out = out.join(d, "case_id", "left")
    out = out.withColumn("n_cited", F.coalesce("n_cited", F.lit(0))).withColumn("citation_coverage", citation_coverage("text", "n_cited"))
    found = [c for c in wide.columns if c != "case_id"]
    out = out.fillna(0.0, [c for c in found if not c.startswith("hit")]).fillna(0, [c for c in found if c.startswith("hit")])
    return verdicts(out).drop("text", "n_cited")


def run_metrics(cases: DataFrame) -> DataFrame:
    """(metric, value): the means of a run's numeric case metrics (``run_cases``), nulls skipped, counts of its verdicts, and percentiles of its latency."""
    skip = {"case_id", "n_relevant", "latency_ms"}
    names = [n for n, t in cases.dtypes if t in ("double", "int", "bigint") and n not in skip]
    one = cases.agg(*(F.round(F.avg(n), 6).alias(n) for n in names), F.count("*").cast("double").alias("total_cases"), F.count_if("passed").cast("double").alias("passed_cases"), F.count_if(~F.col("passed")).cast("double").alias("failed_cases"))
    times = percentiles(cases.where("latency_ms is not null").select(F.lit("latency").alias("of"), "latency_ms"), "of", value="latency_ms").drop("of")
    long = lambda d, start="": d.select(F.explode(F.array(*(F.struct(F.lit(start + n).alias("metric"), F.col(n).cast("double").alias("value")) for n in d.columns))).alias("m")).select("m.*")
    return long(one).unionByName(long(times, "latency_")).where("value is not null")


def dataset_documents(listed: DataFrame, cases: DataFrame) -> DataFrame:
    """(dataset_id, document_id): the list of a dataset and the relevant documents of its cases."""
    return listed.select("dataset_id", "document_id").union(cases.select("dataset_id", F.explode("relevant").alias("document_id"))).distinct()


def imported_cases(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases and rejected rows of text columns question, relevant (JSON list), facts (JSON object)."""
    parsed = raw.withColumn("relevant_ids", F.coalesce(F.from_json("relevant", "array<string>"), F.array().cast("array<string>"))).withColumn("fact_map", F.coalesce(F.from_json("facts", "map<string,double>"), F.create_map().cast("map<string,double>")))
    bad = F.coalesce(F.trim("question"), F.lit("")) == ""
    return parsed.where(~bad).drop("relevant", "facts"), raw.where(bad).withColumn("error", F.lit("no question"))
