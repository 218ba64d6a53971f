"""Queries on answers, audits, evaluation, monitoring, dashboards and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import shared_folder
from ..operators import admission as A
from ..operators import chunking as H
from ..operators import context as T
from ..operators import evaluation as X
from ..operators import monitoring as N
from ..operators import rules as R
from ..sources import frames as S
from ..sources.tables import table
from ..streaming import streams
from .oracle import sql
from .queries_rules import AS_OF, CONFIG, _risk, findings, wide, with_rules
from .queries_search import _bm, bm25_search, kept_chunks, questions

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def conv(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", "text")


@query("context_in_budget", sql("select query_id, chunk_id from (select *, sum(greatest(1, length(content) // 4)) over (partition by query_id order by rank) as t from ranked join chunks using (chunk_id)) where t <= 350", "chunks", "queries", **_bm))
def context_in_budget(spark, d):
    return T.within_budget(bm25_search(spark, d).join(kept_chunks(spark, d), "chunk_id"), "query_id", "rank", 350).select("query_id", "chunk_id")


@query("trimmed_history", "select conv_id, turn from (select *, sum(greatest(1, length(text) // 4)) over (partition by conv_id order by turn desc) as t from conversations) where t <= 120")
def trimmed_history(spark, d):
    return T.within_budget(conv(spark, d), "conv_id", "turn", 120, "text", newest=True).select("conv_id", "turn")


_prompt = {
    "src": "select query_id, string_agg('[Source ' || rank || ' | Doc: ' || document_id || ' | Page: 1]' || chr(10) || content, chr(10) || chr(10) order by rank) as sources from ranked join chunks using (chunk_id) where rank <= 3 group by 1",
    "said": "select conv_id as query_id, string_agg(concat_ws(': ', role, text), chr(10) order by turn) as said from (select *, row_number() over (partition by conv_id order by turn desc) as back from conversations) where back <= 6 group by 1",
}
_asks = "'Conversation so far:' || chr(10) || coalesce(said, '(none)') || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(sources, '(no relevant context found)') || chr(10) || chr(10) || 'Question: ' || query || chr(10) || chr(10) || 'Answer:'"


@query("prompts", sql(f"select query_id, {_asks} as prompt from queries left join src using (query_id) left join said using (query_id)", "chunks", "queries", **_bm, **_prompt))
def prompts(spark, d):
    context = bm25_search(spark, d).where("rank <= 3").join(kept_chunks(spark, d), "chunk_id").withColumn("page", F.lit(1))
    return T.prompts(questions(spark, d), context, conv(spark, d).withColumnRenamed("conv_id", "query_id"))


_answers = "select conv_id * 1000 + turn as answer_id, text || case turn % 4 when 1 then ' [Doc: ' || conv_id || ', Page: 1] [Doc: ' || conv_id || ', Page: 1]' when 3 then ' [Doc: 5, Page: 2]' else '' end as text, conv_id, turn from conversations where role = 'assistant'"


def answers(spark, d):
    c = conv(spark, d).where("role = 'assistant'")
    m = F.when(F.col("turn") % 4 == 1, F.concat(F.lit(" [Doc: "), F.col("conv_id").cast("string"), F.lit(", Page: 1] [Doc: "), F.col("conv_id").cast("string"), F.lit(", Page: 1]"))).when(F.col("turn") % 4 == 3, " [Doc: 5, Page: 2]").otherwise("")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.concat("text", m).alias("text"), "conv_id", "turn")


@query("citations", sql("select answer_id, case turn % 4 when 1 then cast(conv_id as varchar) else '5' end as document_id, case turn % 4 when 1 then '1' else '2' end as page, cast(1 as integer) as place from answers where turn % 4 in (1, 3)", answers=_answers))
def citations(spark, d):
    return T.citations(answers(spark, d))


_status = "select answer_id, case when turn % 4 in (1, 3) then 1 else 0 end as n_citations, case when conv_id % 5 = 0 then 0 else 3 end as n_context, (conv_id % 10) / 10.0 as mean_score, text from answers"


@query("answer_status", sql("select answer_id, case when n_context = 0 or n_citations = 0 then 'low_confidence' else 'valid' end as status, round(case when n_context = 0 then 0.2 when n_citations = 0 then least(c, 0.35) else c end, 6) as confidence from (select *, least(1.0, 0.5 * mean_score + 0.5 * least(n_citations / greatest(len(string_split(text, '. ')), 1) * 3, 1.0)) as c from s)", answers=_answers, s=_status))
def answer_status(spark, d):
    a = answers(spark, d).withColumn("n_citations", F.when(F.col("turn") % 4 % 2 == 1, 1).otherwise(0)).withColumn("n_context", F.when(F.col("conv_id") % 5 == 0, 0).otherwise(3)).withColumn("mean_score", F.col("conv_id") % 10 / 10.0)
    return T.answer_status(a).select("answer_id", "status", "confidence")


def block_chunks(spark, d):
    b = S.blocks(spark, d)
    return b.select("document_id", F.col("order").alias("chunk_index"), F.col("text").alias("content"), F.array("page").alias("pages"))


@query("selected_documents", sql("select document_id, case when n <= 200 then 'whole' else 'condensed' end as mode, cast(n as bigint) as n_tokens, sha256(case when n <= 200 then w else c end) as content_sha256 from (select document_id, sum(greatest(1, length(text) // 4)) as n, string_agg(text, chr(10) order by ord) as w, string_agg(left(text, greatest(1, 800 // of)), chr(10) order by ord) as c from (select *, count(*) over (partition by document_id) as of from blocks) group by 1)", "blocks"))
def selected_documents(spark, d):
    return T.selected_documents(block_chunks(spark, d), 200).select("document_id", "mode", "n_tokens", F.sha2("content", 256).alias("content_sha256"))


@query("conversation_list", "select conv_id, max(turn) as last_turn, count(*) as messages, left(arg_min(text, turn) filter (role = 'user'), 60) as title from conversations group by 1")
def conversation_list(spark, d):
    return T.conversations(conv(spark, d))


@query("questions_before", "select conv_id, turn, question from (select *, lag(text) over (partition by conv_id order by turn) as question from conversations) where role = 'assistant'")
def questions_before(spark, d):
    return T.questions_before(conv(spark, d))


@query("audit_scope", sql("select 'known' as part, count(*) as n from inv where document_id % 10 = 0 union all select 'unknown', count(*) from orders where o_orderkey % 10 = 1", "inv"))
def audit_scope(spark, d):
    docs = S.invoices(spark, d).select("document_id").where("document_id % 10 = 0")
    wanted = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id")).where("document_id % 10 in (0, 1)")
    known, unknown = T.scope(wanted, docs)
    one = lambda f, n: f.agg(F.count("*").alias("n")).select(F.lit(n).alias("part"), "n")
    return one(known, "known").unionByName(one(unknown, "unknown"))


_bparts = "select document_id, ord, greatest(1, length(text) // 4) as t, row_number() over (partition by document_id order by ord) as i from blocks"
_bsteps = "select document_id, i, 0 as batch, t as total from bparts where i = 1 union all select p.document_id, p.i, case when s.total + p.t > 120 then s.batch + 1 else s.batch end, case when s.total + p.t > 120 then p.t else s.total + p.t end from bsteps s join bparts p on p.document_id = s.document_id and p.i = s.i + 1"


@query("audit_batches", sql("select s.document_id, cast(batch as integer) as batch, string_agg(ord, ',' order by ord) as chunk_indexes from bsteps s join bparts p using (document_id, i) group by 1, 2", "blocks", bparts=_bparts, bsteps=_bsteps).replace("with blocks", "with recursive blocks", 1))
def audit_batches(spark, d):
    return T.batches(block_chunks(spark, d), 120).select("document_id", "batch", F.array_join("chunk_indexes", ",").alias("chunk_indexes"))


_level = "case when score >= 85 then 'critical' when score >= 60 then 'high' when score >= 25 then 'medium' else 'low' end"


@query("audit_evidence", with_rules(f"select i.document_id, coalesce(n, 0) as facts, coalesce(flags, '') as flags, case when score is null then 'unknown' else {_level} end as level from inv i left join (select document_id, count(*) as n from items group by 1) f on i.document_id = f.document_id left join (select document_id, string_agg(distinct rule_key, ',' order by rule_key) as flags from findings where triggered group by 1) t on i.document_id = t.document_id left join (select * from risk where document_id % 4 <> 0) r on i.document_id = r.document_id", risk=_risk))
def audit_evidence(spark, d):
    rules = R.rules(AS_OF, CONFIG)
    found = R.evaluated(wide(spark, d), rules, more=("facts",))
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"))
    return T.evidence(docs, found, [r.key for r in rules], F.col("document_id") % 4 != 0)


@query("audit_flag_counts", with_rules("select document_type as run_id, " + ", ".join(f"count(*) filter (severity = '{s}') as {s}" for s in R.WEIGHTS) + " from findings join inv using (document_id) where triggered group by 1"))
def audit_flag_counts(spark, d):
    f = findings(spark, d).join(S.invoices(spark, d).select("document_id", F.col("document_type").alias("run_id")), "document_id")
    return T.flag_counts(f, "run_id")


@query("audit_memory_trail", with_rules("select document_type as run_id, document_id, cast(row_number() over w as integer) as position, cast(sum(n) over w as bigint) as findings_so_far, cast(sum(t) over w as bigint) as flags_so_far from inv join (select document_id, count(*) as n, count(*) filter (triggered) as t from findings group by 1) using (document_id) window w as (partition by document_type order by document_id)"))
def audit_memory_trail(spark, d):
    return T.memory_trail(findings(spark, d), S.invoices(spark, d).select(F.col("document_type").alias("run_id"), "document_id"))


@query("audit_capped_flags", with_rules("select run_id, document_id, rule_key from (select document_type as run_id, document_id, rule_key, row_number() over (partition by document_type order by case severity when 'critical' then 3 when 'high' then 2 when 'medium' then 1 else 0 end desc, document_id || rule_key) as p from findings join inv using (document_id) where triggered) where p <= 10"))
def audit_capped_flags(spark, d):
    f = findings(spark, d).where("triggered").join(S.invoices(spark, d).select("document_id", F.col("document_type").alias("run_id")), "document_id")
    return T.capped(f.withColumn("position", F.concat(F.col("document_id").cast("string"), "rule_key")), 5).select("run_id", "document_id", "rule_key")


@query("audit_memory_records", "select event_id, 0 as findings, cast(case when event_id % 3 = 0 then 1 else 0 end as integer) as flags from events")
def audit_memory_records(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, '{"risk_flags": [{"severity": "high", "text": "x"}]}').when(F.col("event_id") % 3 == 1, '{"key_findings": null}').otherwise("broken")
    m = table(spark, d, "events").select("event_id", raw.alias("raw")).select("event_id", T.memory_of("raw").alias("m"))
    return m.select("event_id", F.size("m.key_findings").alias("findings"), F.size("m.risk_flags").alias("flags"))


@query("audit_coverage", sql("select document_type as run_id, count(*) as documents, count(*) filter (document_id % 9 = 0) as failed, count(*) filter (document_id % 9 <> 0) as covered, round(count(*) filter (document_id % 9 <> 0) / count(*), 6) as progress from inv group by 1", "inv"))
def audit_coverage(spark, d):
    inv = S.invoices(spark, d).select("document_id", F.col("document_type").alias("run_id"))
    return T.coverage(inv, inv.where("document_id % 9 = 0"))


@query("audit_report", with_rules("select run_id, '## Risk summary' || chr(10) || 'critical ' || critical || ', high ' || high || ', medium ' || medium || ', low ' || low || chr(10) || '## Key findings' || chr(10) || lines as report from (select document_type as run_id, count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'high') as high, count(*) filter (severity = 'medium') as medium, count(*) filter (severity = 'low') as low from fi group by 1) join (select run_id, string_agg('- ' || rule_key || ': ' || n, chr(10) order by p) as lines from (select *, row_number() over (partition by run_id order by n desc, rule_key) as p from (select document_type as run_id, rule_key, count(*) as n from fi group by 1, 2)) where p <= 5 group by 1) using (run_id)", fi="select * from findings join inv using (document_id) where triggered"))
def audit_report(spark, d):
    return T.report(findings(spark, d), S.invoices(spark, d).select("document_id", F.col("document_type").alias("run_id")))


_ks = "select unnest([1, 5, 10, 20, 50]) as k"


def relevance(best):
    """Stands in for judgements: the first and third of the ranking."""
    return best.where("rank in (1, 3)").select("query_id", F.col("chunk_id").alias("item"))


_rel = "select query_id, chunk_id as item from ranked where rank in (1, 3)"
_ret = "select query_id, chunk_id as item, rank from ranked where query_id % 5 <> 0 or rank > 3"
_m = "select q.query_id, k, (select count(*) from rel where rel.query_id = q.query_id) as n, (select count(*) from ret join rel using (query_id, item) where ret.query_id = q.query_id and rank <= k) as hits, (select count(*) from ret where ret.query_id = q.query_id and rank <= k) as returned, (select min(rank) from ret join rel using (query_id, item) where ret.query_id = q.query_id) as first_hit, (select sum(1 / log2(rank + 1)) from ret join rel using (query_id, item) where ret.query_id = q.query_id and rank <= k) as dcg from (select distinct query_id from ret) q, ks"


@query("retrieval_metrics", sql("select query_id, k, round(coalesce(hits / nullif(n, 0), 0), 6) as recall, round(coalesce(hits / nullif(returned, 0), 0), 6) as precision, round(coalesce(1 / first_hit, 0), 6) as mrr, round(coalesce(dcg / (select sum(1 / log2(i + 1)) from range(1, least(n, k) + 1) t(i)), 0), 6) as ndcg, cast(hits > 0 as integer) as hit from m", "chunks", "queries", **_bm, rel=_rel, ret=_ret, ks=_ks, m=_m))
def retrieval_metrics(spark, d):
    best = bm25_search(spark, d)
    got = best.where("query_id % 5 <> 0 or rank > 3").select("query_id", F.col("chunk_id").alias("item"), "rank")
    return X.retrieval_metrics(got, relevance(best))


@query("citation_metrics", sql("select answer_id, case when turn % 4 = 1 then 1.0 when turn % 4 = 3 then 0.0 else 0.0 end as precision, case when turn % 4 = 1 then 1.0 else 0.0 end as recall from answers", answers=_answers))
def citation_metrics(spark, d):
    a = answers(spark, d)
    return X.citation_metrics(T.citations(a), a.select("answer_id", F.col("conv_id").cast("string").alias("document_id"), F.lit(1).alias("page")))


@query("citation_coverage", sql("select answer_id, case when n = 0 then 0.0 else round(least(1.0, 2 / n), 6) end as coverage from (select answer_id, len(list_filter(string_split(text, '.'), lambda s: trim(s) <> '')) as n from answers)", answers=_answers))
def citation_coverage(spark, d):
    return answers(spark, d).withColumn("n", F.lit(2)).select("answer_id", X.citation_coverage("text", "n").alias("coverage"))


@query("numerical_accuracy", sql("select document_id as answer_id, case when document_id % 3 = 0 then 0.5 else 1.0 end as accuracy, case when document_id % 3 = 0 then 'tax' else '' end as mismatches from inv where invoice_total > 1000 and tax_amount is not null", "inv"))
def numerical_accuracy(spark, d):
    inv = S.invoices(spark, d).where("invoice_total > 1000 and tax_amount is not null")
    text = F.concat(F.lit("In all "), S.money(F.col("invoice_total")), F.lit(" with tax of "), F.when(F.col("document_id") % 3 == 0, "7").otherwise(S.money(F.col("tax_amount") + 1)))
    a = inv.select(F.col("document_id").alias("answer_id"), text.alias("text"))
    f = inv.select(F.col("document_id").alias("answer_id"), F.explode(F.array(F.struct(F.lit("total").alias("fact_type"), F.col("invoice_total").alias("value")), F.struct(F.lit("tax").alias("fact_type"), F.when(F.col("document_id") % 3 == 0, -1e7).otherwise(F.col("tax_amount") + 1).alias("value")))).alias("f")).select("answer_id", "f.*")
    return X.numerical_accuracy(a, f)


@query("latency_percentiles", "select event_type, round(avg(value), 6) as avg, max(value) filter (i = least(n * 50 // 100, n - 1)) as p50, max(value) filter (i = least(n * 95 // 100, n - 1)) as p95, max(value) filter (i = least(n * 99 // 100, n - 1)) as p99 from (select *, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events) group by 1")
def latency_percentiles(spark, d):
    return X.percentiles(table(spark, d, "events"), "event_type", value="value")


_metrics = "select 'd' || dayofyear(ts) % 2 as run, event_type as metric, round(avg(value), 6) as value from events group by 1, 2"


def run_metrics(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("d"), (F.dayofyear("ts") % 2).cast("string")).alias("run"), F.col("event_type").alias("metric"), "value")
    return X.mean_metrics(e, "run")


@query("run_metrics", sql("select * from metrics", metrics=_metrics))
def run_metrics_query(spark, d):
    return run_metrics(spark, d)


@query("compared_runs", sql("select a.metric, a.value as a, b.value as b, round(b.value - a.value, 6) as delta from metrics a join metrics b on a.metric = b.metric and a.run = 'd0' and b.run = 'd1'", metrics=_metrics))
def compared_runs(spark, d):
    m = run_metrics(spark, d)
    return X.compared(m.where("run = 'd0'"), m.where("run = 'd1'"))


@query("gate_violations", sql("select metric, 'ci' as environment, value, case when metric < 'd' and value < 1e9 then 'below minimum' else 'above maximum' end as problem from metrics where run = 'd0' and (metric < 'd' and value < 1e9 or metric >= 'p' and value > 0.001)", metrics=_metrics))
def gate_violations(spark, d):
    m = run_metrics(spark, d).where("run = 'd0'").drop("run")
    gates = m.select("metric", F.lit("ci").alias("environment"), F.when(F.col("metric") < "d", 1e9).alias("min_value"), F.when(F.col("metric") >= "p", 0.001).alias("max_value"))
    return X.violations(m, gates)


@query("baseline_runs", "select user_id as dataset_id, max(event_id) as run_id from events where event_type = 'click' group by 1")
def baseline_runs(spark, d):
    runs = table(spark, d, "events").select(F.col("user_id").alias("dataset_id"), F.col("event_id").alias("run_id"), (F.col("event_type") == "click").alias("is_baseline"))
    return X.baseline(runs).drop("is_baseline")


_pe = "select rule_key, count(*) filter (triggered and document_id % 3 <> 0) as tp, count(*) filter (triggered and document_id % 3 = 0) as fp, count(*) filter (not triggered and document_id % 13 = 0) as fn from findings group by 1"


@query("rule_quality", with_rules("select rule_key, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from pe where tp + fp + fn > 0", pe=_pe))
def rule_quality(spark, d):
    f = findings(spark, d)
    predicted = f.where("triggered").select("document_id", "rule_key")
    expected = f.where("(triggered and document_id % 3 <> 0) or (not triggered and document_id % 13 = 0)").select("document_id", "rule_key")
    return X.rule_quality(predicted, expected)


_cases = "select conv_id * 1000 + turn as case_id, conv_id % 4 as n_relevant, (turn % 3) / 2.0 as recall_at_10, (conv_id % 10) / 10.0 as faithfulness, turn % 5 <> 0 as answered, case when conv_id % 7 = 0 then 'refused' else 'valid' end as status from conversations"


def cases(spark, d):
    c, t = F.col("conv_id"), F.col("turn")
    return conv(spark, d).select((c * 1000 + t).alias("case_id"), (c % 4).alias("n_relevant"), (t % 3 / 2.0).alias("recall_at_10"), (c % 10 / 10.0).alias("faithfulness"), (t % 5 != 0).alias("answered"), F.when(c % 7 == 0, "refused").otherwise("valid").alias("status"))


_reason = "case when answered and status = 'refused' then 'refused' when n_relevant > 0 and recall_at_10 = 0 then 'nothing relevant found' when answered and faithfulness < 0.5 then 'not faithful' when not answered and recall_at_10 <= 0 then 'nothing relevant found' end"


@query("case_verdicts", sql(f"select case_id, {_reason} as reason, {_reason} is null as passed from cases", cases=_cases))
def case_verdicts(spark, d):
    return X.verdicts(cases(spark, d)).select("case_id", "reason", "passed")


@query("failed_cases", sql(f"select {_reason} as reason, count(*) as n from cases where {_reason} is not null group by 1", cases=_cases))
def failed_cases(spark, d):
    return X.failed(X.verdicts(cases(spark, d))).groupBy("reason").agg(F.count("*").alias("n"))


@query("generated_cases", sql("select document_id, 'summary' as kind, 'What is ' || file_name || ' about?' as question, cast(null as varchar) as expected from inv union all select document_id, 'fact', 'What is the invoice total?', cast(cast(invoice_total as decimal(18,2)) as varchar) from inv union all select document_id, 'metadata', 'What is the currency?', currency from inv", "inv"))
def generated_cases(spark, d):
    inv = S.invoices(spark, d)
    facts = inv.select("document_id", F.lit("invoice_total").alias("fact_type"), F.col("invoice_total").alias("value"))
    return X.generated_cases(inv, facts, inv.select("document_id", F.lit("currency").alias("key"), F.col("currency").alias("value")))


@query("dataset_documents", "select distinct user_id % 5 as dataset_id, document_id from (select user_id, event_id % 100 as document_id from events union all select user_id, event_id % 7 from events where event_type = 'view')")
def dataset_documents(spark, d):
    e = table(spark, d, "events").withColumn("dataset_id", F.col("user_id") % 5)
    return X.dataset_documents(e.select("dataset_id", (F.col("event_id") % 100).alias("document_id")), e.where("event_type = 'view'").select("dataset_id", F.array(F.col("event_id") % 7).alias("relevant")))


@query("imported_cases", "select item_id, cast(case when item_id % 3 = 0 then 2 else 0 end as integer) as n_relevant, cast(case when item_id % 2 = 0 then 1 else 0 end as integer) as n_facts from benchmark where item_id % 5 <> 0")
def imported_cases(spark, d):
    i = F.col("item_id")
    raw = table(spark, d, "benchmark").select("item_id", F.when(i % 5 == 0, "").otherwise(F.col("text")).alias("question"), F.when(i % 3 == 0, '["a", "b"]').otherwise("bad[").alias("relevant"), F.when(i % 2 == 0, '{"total": 1.5}').alias("facts"))
    good, _ = X.imported_cases(raw)
    return good.select("item_id", F.size("relevant_ids").alias("n_relevant"), F.size("fact_map").alias("n_facts"))


@query("evaluation_run", sql("select k, round(avg(hits / nullif(n, 0)), 6) as recall, count(*) as queries from m group by 1", "chunks", "queries", **_bm, rel=_rel, ret=_ret, ks=_ks, m=_m))
def evaluation_run(spark, d):
    m = retrieval_metrics(spark, d)
    return m.groupBy("k").agg(F.round(F.avg("recall"), 6).alias("recall"), F.count("*").alias("queries"))


KINDS = ["AuthenticationError", "OCRFailed", "StorageError", "ValueError", "DocumentNotFound", "KeyError", "RuleEngineError"]
_kinds = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
_errors = f"select event_id as id, ts as at_time, user_id, list_extract({_kinds}, user_id % 7 + 1) as kind, 'failed with Bearer ***REDACTED*** for ***SSN-REDACTED*** in step ' || event_id % 5 || chr(10) || 'line ' || event_id as message from events where event_type = 'error'"


def errors(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    i = F.col("event_id")
    text = F.concat(F.lit("failed with Bearer abc.def-"), i.cast("string"), F.lit(" for 123-45-6789 in step "), (i % 5).cast("string"), F.lit("\nline "), i.cast("string"))
    return e.select(i.alias("id"), F.col("ts").alias("at"), "user_id", F.element_at(F.array(*map(F.lit, KINDS)), (F.col("user_id") % 7 + 1).cast("int")).alias("kind"), text.alias("message"))


_fp = "substr(sha256(kind || ':' || left(string_split(message, chr(10))[1], 100)), 1, 16)"
_cat = "case kind when 'AuthenticationError' then 'authentication' when 'OCRFailed' then 'ocr' when 'StorageError' then 'storage' when 'DocumentNotFound' then 'validation' else 'internal' end"
_groups = f"select {_fp} as fingerprint, max(kind) as kind, count(*) as times, arg_max(message, (at_time, id)) as last_message, arg_min(user_id, (at_time, id)) as first_user, max({_cat}) as category from errors group by 1"


@query("redacted_errors", sql("select id, message from errors", errors=_errors))
def redacted_errors(spark, d):
    return errors(spark, d).select("id", N.redacted_text("message").alias("message"))


@query("redacted_maps", "select event_id, '***REDACTED***' as token, event_type as kind, case when event_id % 2 = 0 then repeat('x', 200) || '...[truncated, full document content not logged]' else 'x' end as body from events")
def redacted_maps(spark, d):
    body = F.when(F.col("event_id") % 2 == 0, F.repeat(F.lit("x"), 2500)).otherwise("x")
    m = table(spark, d, "events").select("event_id", N.redacted_map(F.create_map(F.lit("user.Access_Token"), F.lit("t"), F.lit("kind"), F.col("event_type"), F.lit("body"), body)).alias("m"))
    return m.select("event_id", F.col("m")["user.Access_Token"].alias("token"), F.col("m")["kind"].alias("kind"), F.col("m")["body"].alias("body"))


@query("error_groups", sql("select * from g", errors=_errors, g=_groups))
def error_groups(spark, d):
    return N.error_groups(errors(spark, d))


@query("top_errors", sql("select fingerprint, times from g order by times desc, fingerprint limit 10", errors=_errors, g=_groups))
def top_errors(spark, d):
    return N.top_errors(N.error_groups(errors(spark, d))).select("fingerprint", "times")


@query("errors_by_category", sql(f"select {_cat} as category, count(*) as times from errors group by 1", errors=_errors))
def errors_by_category(spark, d):
    return N.by_category(N.error_groups(errors(spark, d)))


def usage(spark, d):
    e = table(spark, d, "events")
    k = F.from_json("props", "k int")["k"]
    u = e.select(F.col("ts").alias("at"), F.when(F.col("user_id") % 6 != 0, F.col("user_id")).alias("user_id"), F.col("event_type").alias("model"), (10 * k).alias("input_tokens"), k.alias("output_tokens"))
    return u.withColumn("cost", N.cost("input_tokens", "output_tokens", 0.5, 1.5))


_usage = "select *, input_tokens / 1000 * 0.5 + output_tokens / 1000 * 1.5 as cost from (select ts as at_time, case when user_id % 6 <> 0 then user_id end as user_id, event_type as model, 10 * cast(json_extract_string(props, '$.k') as integer) as input_tokens, cast(json_extract_string(props, '$.k') as integer) as output_tokens from events)"


@query("cost_by_model", sql("select model, round(sum(cost), 6) as cost, cast(sum(input_tokens + output_tokens) as bigint) as tokens, count(*) as requests from usage where at_time >= timestamp '2024-01-20' - interval 48 hours group by 1", usage=_usage))
def cost_by_model(spark, d):
    return N.cost_by_model(usage(spark, d), "2024-01-20", 48)


@query("cost_by_user", sql("select user_id, round(sum(cost), 6) as cost from usage where user_id is not null group by 1 order by 2 desc, 1 limit 10", usage=_usage))
def cost_by_user(spark, d):
    return N.cost_by_user(usage(spark, d))


@query("alerts", sql("select 'a-' || metric as name, metric, value, 'high' as severity from metrics where run = 'd0' and (metric < 'd' and value > 0.5 or metric >= 'd' and metric < 'p' and value < 1e9)", metrics=_metrics))
def alerts(spark, d):
    m = run_metrics(spark, d).where("run = 'd0'").drop("run")
    c = F.when(F.col("metric") < "d", "gt").when(F.col("metric") < "p", "lt").otherwise("no such")
    rules = m.select(F.concat(F.lit("a-"), "metric").alias("name"), "metric", c.alias("condition"), F.when(F.col("metric") < "d", 0.5).otherwise(1e9).alias("threshold"), F.lit("high").alias("severity"), F.lit(True).alias("active"))
    return N.alerts(rules, m)


@query("firing_alerts", "select user_id as name, 'firing' as state, max(ts) as at_time from events group by 1 having arg_max(event_type, ts) <> 'purchase'")
def firing_alerts(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("name"), F.col("ts").alias("at"), F.when(F.col("event_type") == "purchase", "acknowledged").otherwise("firing").alias("state"))
    return N.alert_states(log).withColumnRenamed("at", "at_time")


@query("event_counters", "select event_type, user_id % 3 as shard, count(*) as n from events group by 1, 2")
def event_counters(spark, d):
    return N.counters(table(spark, d, "events").withColumn("shard", F.col("user_id") % 3), "event_type", "shard")


@query("value_histogram", "select event_type, le, count(*) filter (value <= b) as n from events, (select unnest(['10.0', '50.0', '100.0', '+Inf']) as le, unnest([10.0, 50.0, 100.0, 1e300]) as b) group by 1, 2")
def value_histogram(spark, d):
    return N.histogram(table(spark, d, "events"), "event_type", "value", [10.0, 50.0, 100.0])


@query("summary_cards", sql("select 'documents' as card, cast(count(*) as double) as value from inv union all select 'storage', cast(sum(strlen(text)) as double) from documents union all select 'embeddings', cast(count(*) as double) from embeddings union all select 'active_users', cast(count(distinct user_id) as double) from events", "inv"))
def summary_cards(spark, d):
    return N.cards(documents=(S.invoices(spark, d), F.count("*")), storage=(table(spark, d, "documents"), F.sum(F.octet_length("text"))), embeddings=(table(spark, d, "embeddings"), F.count("*")), active_users=(table(spark, d, "events"), F.count_distinct("user_id")))


@query("activity_feed", "select event_id as id, ts as at_time, c_name as email from events left join customer on c_custkey = user_id order by ts desc, event_id limit 20")
def activity_feed(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), "user_id")
    u = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"))
    return N.activity_feed(e, u).select("id", F.col("at").alias("at_time"), "email")


@query("daily_events", "select strftime(day, '%Y-%m-%d') as day, count(event_id) as n from (select unnest(range(date '2024-01-20', date '2024-02-03', interval 1 day)) as day) left join events on cast(ts as date) = cast(day as date) group by 1")
def daily_events(spark, d):
    return N.daily(table(spark, d, "events").withColumn("at", F.col("ts")), "2024-02-02", 14).withColumn("day", F.col("day").cast("string"))


@query("type_distribution", sql("select document_type, count(*) as n from inv where document_type <> 'unknown' group by 1", "inv"))
def type_distribution(spark, d):
    return N.distribution(S.invoices(spark, d).withColumn("document_type", F.nullif("document_type", F.lit("unknown"))))


@query("document_bundles", with_rules("select i.document_id, coalesce(n, 0) as items, coalesce(t, 0) as flags from inv i left join (select document_id, count(*) as n from items group by 1) a on a.document_id = i.document_id left join (select document_id, count(*) as t from findings where triggered group by 1) b on b.document_id = i.document_id"))
def document_bundles(spark, d):
    b = N.bundle(S.invoices(spark, d).select("document_id"), items=S.line_items(spark, d), flags=findings(spark, d).where("triggered"))
    n = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long").alias(c)
    return b.select("document_id", n("items"), n("flags"))


@query("boxed_blocks", sql("select document_id, block_id, left(text, 200) as text from blocks where ord % 3 = 0 and page = 1", "blocks"))
def boxed_blocks(spark, d):
    b = S.blocks(spark, d).withColumn("box", F.when(F.col("order") % 3 == 0, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))))
    return N.boxed_blocks(b, 1).select("document_id", "block_id", "text")


@query("resolved_citations", sql("select document_id, chunk_id, block_id, page from (select document_id, document_id || '_c' || section as chunk_id, arg_min(block_id, ord) as block_id, arg_min(page, ord) as page from (select *, cast(sum(case when type = 'heading' then 1 else 0 end) over (partition by document_id order by ord) as bigint) as section from blocks) where document_id % 5 = 0 group by document_id, section)", "blocks"))
def resolved_citations(spark, d):
    c = H.clauses(S.blocks(spark, d), None)
    c = c.withColumn("chunk_id", F.concat(F.col("document_id").cast("string"), F.lit("_c"), F.col("section").cast("string")))
    cited = c.where("document_id % 5 in (0, 1)").select(F.when(F.col("document_id") % 5 == 0, F.col("document_id")).otherwise(-1).alias("document_id"), "chunk_id")
    blocks = S.blocks(spark, d).select("document_id", "block_id", "page")
    return N.resolved_citations(cited, c, blocks).select("document_id", "chunk_id", "block_id", "page")


@query("found_in_blocks", sql("select document_id, block_id, cast(p - 1 as integer) as start, cast(p + 2 as integer) as end_ from (select *, strpos(lower(text), 'the') as p from blocks) where p > 0", "blocks"))
def found_in_blocks(spark, d):
    return N.found_in_blocks(S.blocks(spark, d), "The").withColumnRenamed("end", "end_")


_roles = "select distinct user_id, case when user_id % 5 = 0 then 'admin' else 'reader' end as role from events union select distinct user_id, 'auditor' from events where user_id % 3 = 0"
_perms = "select unnest(['admin', 'admin', 'reader', 'auditor']) as role, unnest(['admin.all', 'read', 'read', 'audit']) as permission"


def grants(spark, d):
    u = table(spark, d, "events").select("user_id").distinct()
    roles = u.select("user_id", F.when(F.col("user_id") % 5 == 0, "admin").otherwise("reader").alias("role")).union(u.where("user_id % 3 = 0").select("user_id", F.lit("auditor")))
    p = spark.createDataFrame([("admin", "admin.all"), ("admin", "read"), ("reader", "read"), ("auditor", "audit")], "role string, permission string")
    return N.permissions(roles, p)


@query("permissions", sql("select user_id, string_agg(distinct permission, ',' order by permission) as permissions from roles join perms using (role) group by 1", roles=_roles, perms=_perms))
def permissions(spark, d):
    return grants(spark, d)


@query("visible_documents", sql("select 'everything' as part, count(distinct user_id) as n from events where user_id % 5 = 0 union all select 'own', count(*) from inv", "inv"))
def visible_documents(spark, d):
    everyone, own = N.visible(S.invoices(spark, d), grants(spark, d), "admin.all")
    one = lambda f, n: f.agg(F.count("*").alias("n")).select(F.lit(n).alias("part"), "n")
    return one(everyone, "everything").unionByName(one(own, "own"))


@query("stage_runs", sql("select document_id, 'document_chunked' as event_type, case when count(*) filter (length(text) < 10 or length(text) // 4 > 2000) > 0 then 'needs_review' else 'completed' end as status from blocks group by 1", "blocks"))
def stage_runs(spark, d):
    c = H.validate(S.blocks(spark, d).withColumnRenamed("text", "content"))
    return A.activity(A.run_log(c, "chunked"))


def _streamed(spark, stream, mode: str):
    folder = shared_folder(spark)
    if mode == "append":
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")
    last = f"{folder}/out"
    stream.writeStream.outputMode("complete").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(last)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(last)


@query("stream_error_groups", sql("select fingerprint, times from g", errors=_errors, g=_groups))
def stream_error_groups(spark, d):
    t = table(spark, d, "events")
    e = streams.read_stream(spark, f"{d}/events.parquet*", t.schema).where("event_type = 'error'")
    i = F.col("event_id")
    text = F.concat(F.lit("failed with Bearer abc.def-"), i.cast("string"), F.lit(" for 123-45-6789 in step "), (i % 5).cast("string"), F.lit("\nline "), i.cast("string"))
    e = e.select(i.alias("id"), F.col("ts").alias("at"), "user_id", F.element_at(F.array(*map(F.lit, KINDS)), (F.col("user_id") % 7 + 1).cast("int")).alias("kind"), text.alias("message"))
    return _streamed(spark, streams.error_groups(e), "complete").select("fingerprint", "times")


@query("stream_counters", "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n from events where date_trunc('hour', ts) + interval 1 hour <= (select max(ts) from events) - interval 10 minute group by 1, 2")
def stream_counters(spark, d):
    t = table(spark, d, "events")
    return _streamed(spark, streams.counters(streams.read_stream(spark, f"{d}/events.parquet*", t.schema), "event_type", "1 hour"), "append").withColumn("start", F.col("start").cast("string"))


@query("stream_sliding", "select strftime(start, '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(avg(value), 6) as mean from (select *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) as start from events) group by 1, 2")
def stream_sliding(spark, d):
    t = table(spark, d, "events")
    return _streamed(spark, streams.sliding(streams.read_stream(spark, f"{d}/events.parquet*", t.schema), "event_type", "value", "2 hours", "1 hour"), "complete").withColumn("start", F.col("start").cast("string"))


@query("stream_distinct_contents", "select count(distinct user_id || event_type) as n from events")
def stream_distinct_contents(spark, d):
    t = table(spark, d, "events")
    e = streams.read_stream(spark, f"{d}/events.parquet*", t.schema).select("ts", F.concat(F.col("user_id").cast("string"), "event_type").alias("content"))
    return _streamed(spark, streams.distinct_contents(e, "ts", "365 days"), "append").agg(F.count("*").alias("n"))


@query("stream_ingest", sql("select extension, count(*) as n from (select *, case when contains(s, '.') then lower(string_split(s, '.')[-1]) else '' end as extension from (select string_split(file_name, '/')[-1] as s from files)) group by 1", "files"))
def stream_ingest(spark, d):
    folder, t = shared_folder(spark), table(spark, d, "documents")
    i = F.col("doc_id")
    names = ["txt", "md", "exe", "html", "TXT", "csv", "zip", "pdf", "js", ""]
    ext = F.element_at(F.array(*map(F.lit, names)), (i % 10 + 1).cast("int"))
    name = F.when(i % 97 == 0, "..").otherwise(F.concat(F.when(i % 4 == 0, "../up/").otherwise(""), F.lit("doc-"), i.cast("string"), F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext))))
    s = streams.read_stream(spark, f"{d}/documents.parquet*", t.schema).select(i.alias("file_id"), name.alias("file_name"), F.octet_length("text").cast("long").alias("size"))
    streams.ingest(s, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("extension").agg(F.count("*").alias("n"))


@query("stream_alerts", "select strftime(start, '%Y-%m-%d %H:%M:%S') as start, event_type as metric, n as value, 'busy-' || event_type as name, 'high' as severity from (select date_trunc('hour', ts) as start, event_type, cast(count(*) as double) as n from events group by 1, 2) where n > 1")
def stream_alerts(spark, d):
    folder, t = shared_folder(spark), table(spark, d, "events")
    c = streams.counters(streams.read_stream(spark, f"{d}/events.parquet*", t.schema), "event_type", "1 hour").select("start", F.col("event_type").alias("metric"), F.col("n").cast("double").alias("value"))
    rules = t.select("event_type").distinct().select(F.concat(F.lit("busy-"), "event_type").alias("name"), F.col("event_type").alias("metric"), F.lit("gt").alias("condition"), F.lit(1.0).alias("threshold"), F.lit("high").alias("severity"), F.lit(True).alias("active"))
    streams.windowed_alerts(c, rules, f"{folder}/out", f"{folder}/state").awaitTermination()
    found = spark.read.schema("metric string, value double, name string, severity string, start timestamp, batch int").parquet(f"{folder}/out")
    last = found.groupBy("start", "metric", "name", "severity").agg(F.max_by("value", "batch").alias("value"))
    return last.withColumn("start", F.col("start").cast("string"))
