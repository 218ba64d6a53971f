"""Queries on nested documents, hooks, search modes, whole evaluation runs, audit memories and reports, and further views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import shared_folder, written
from ..operators import admission as A
from ..operators import chunking as H
from ..operators import context as T
from ..operators import evaluation as X
from ..operators import extract as E
from ..operators import monitoring as N
from ..operators import parsing as P
from ..operators import retrieval as Q
from ..sources import frames as S
from ..sources.tables import table
from ..streaming import streams
from .oracle import sql
from .queries_rules import findings, with_rules
from .queries_search import _bm, _dense, _rr, bm25_search, chunks, dense, questions, reranked, scored
from .queries_text import _cells, cells, invoice_entities, text_lines

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


# ---- nested documents (K1, K5) --------------------------------------------------------------------------------------


def doc_parts(spark, d):
    """Blocks, pages, and tables and images that stand in some of the blocks' places."""
    b = S.blocks(spark, d)
    key = lambda kind: F.concat(F.col("document_id").cast("string"), F.lit(kind), F.col("order").cast("string"))
    words = F.slice(F.split("text", " "), 1, 4)
    c = b.where("order % 10 = 3").select("document_id", key("_t").alias("table_id"), "page", F.posexplode(words).alias("i", "text"))
    c = c.select("document_id", "table_id", "page", F.floor(F.col("i") / 2).cast("int").alias("row"), (F.col("i") % 2).cast("int").alias("col"), "text")
    images = b.where("order % 13 = 5").select("document_id", key("_i").alias("image_id"), "page", F.substring("text", 1, 10).alias("caption"))
    return b, b.select("document_id", "page").distinct(), c, images


_parts = {
    "cel": "select document_id, document_id || '_t' || ord as table_id, page, i // 2 as row, i % 2 as col, w as text from (select *, unnest(string_split(text, ' ')[1:4]) as w, unnest(range(len(string_split(text, ' ')[1:4]))) as i from blocks where ord % 10 = 3)",
    "img": "select document_id, document_id || '_i' || ord as image_id, page, left(text, 10) as caption from blocks where ord % 13 = 5",
    "edg": "select document_id, source, block_id as target from (select *, last_value(case when type = 'heading' then block_id end ignore nulls) over (partition by document_id order by page, ord) as source from blocks) where type = 'paragraph' and source is not null",
    "pag": "select document_id, string_agg(page || ':' || ids, ';' order by page) as pages from (select document_id, page, string_agg(block_id, ',' order by ord) as ids from blocks group by 1, 2) group by 1",
    "tab": "select document_id, string_agg(page || ':' || table_id || ':' || rs || 'x' || cs || ':' || c, ';' order by page, table_id) as tables from (select document_id, table_id, page, max(row) + 1 as rs, max(col) + 1 as cs, string_agg(text, '|' order by row, col) as c from cel group by 1, 2, 3) group by 1",
    "ims": "select document_id, string_agg(page || ':' || image_id || ':' || caption, ';' order by page, image_id) as images from img group by 1",
    "rel": "select document_id, string_agg(source || '>' || target, ';' order by source, target) as relationships from edg group by 1",
    "raw": "select document_id, count(*) as blocks, sha256(string_agg(text, chr(10) order by page, ord)) as raw_text_sha256 from blocks group by 1",
}


@query("canonical_nested", sql("select document_id, pages, coalesce(tables, '') as tables, coalesce(images, '') as images, coalesce(relationships, '') as relationships, blocks, raw_text_sha256 from raw left join pag using (document_id) left join tab using (document_id) left join ims using (document_id) left join rel using (document_id)", "blocks", **_parts))
def canonical_nested(spark, d):
    n = H.nested(*doc_parts(spark, d)).select("document_id", "document.*")
    text = lambda c, f: F.array_join(F.transform(c, f), ";").alias(c)
    s = lambda x: x.cast("string")
    return n.select(
        "document_id", text("pages", lambda p: F.concat_ws(":", s(p["page"]), F.array_join(p["reading_order"], ","))),
        text("tables", lambda t: F.concat_ws(":", s(t["page"]), t["table_id"], F.concat_ws("x", s(t["row_count"]), s(t["col_count"])), F.array_join(F.transform(t["cells"], lambda c: c["text"]), "|"))),
        text("images", lambda i: F.concat_ws(":", s(i["page"]), i["image_id"], i["caption"])), text("relationships", lambda r: F.concat_ws(">", r["source"], r["target"])),
        F.size("blocks").cast("long").alias("blocks"), F.sha2("raw_text", 256).alias("raw_text_sha256"),
    )


_lost = """select document_id, 'block on missing page' as issue, block_id as item from blocks where document_id % 5 = 0 and page = 2 union all select document_id, 'box on another page', block_id from blocks where ord % 11 = 0
union all select document_id, 'too many cells', table_id from (select document_id, table_id, count(*) as n from cel group by 1, 2) where document_id % 9 = 0 and n > 1 union all select document_id, 'unknown edge source', source || 'x' from edg where document_id % 16 = 0
union all select distinct document_id, 'schema version', '0.9' from blocks where document_id % 6 = 0 union all select distinct document_id, 'table on missing page', table_id from cel where document_id % 6 = 1 or document_id % 5 = 0 and page = 2
union all select document_id, 'image on missing page', image_id from img where document_id % 6 = 2 or document_id % 5 = 0 and page = 2"""


@query("integrity_of_parts", sql("select * from issues", "blocks", cel=_parts["cel"], img=_parts["img"], edg=_parts["edg"], issues=_lost))
def integrity_of_parts(spark, d):
    """Every kind of issue: pages, boxes, cells, edges (those from a table are fine), versions, tables and images."""
    b, pages, c, images = doc_parts(spark, d)
    k = F.col("document_id")
    away = lambda n: F.when(k % 6 == n, F.col("page") + 1000).otherwise(F.col("page")).alias("page")
    b = b.withColumn("box_page", F.when(F.col("order") % 11 == 0, F.col("page") + 1).otherwise(F.col("page")))
    tables = c.select("document_id", "table_id", "page").distinct()
    every = tables.unionByName(b.select("document_id", F.concat(k.cast("string"), F.lit("_plan")).alias("table_id"), F.lit(1).alias("page")).distinct())
    edges = H.heading_edges(b).withColumn("source", F.when(k % 16 == 0, F.concat("source", F.lit("x"))).when(k % 16 == 8, F.concat(k.cast("string"), F.lit("_plan"))).otherwise(F.col("source")))
    sizes = c.groupBy("table_id").agg(F.when(F.max("document_id") % 9 == 0, 1).otherwise(F.count("*")).alias("row_count"), F.lit(1).alias("col_count"))
    docs = b.select("document_id").distinct().withColumn("schema_version", F.when(k % 6 == 0, "0.9").otherwise("1.0"))
    known = pages.where("not (document_id % 5 = 0 and page = 2)").unionByName(b.select("document_id", F.lit(1).alias("page")).distinct())
    moved = tables.select("document_id", "table_id", away(1)).unionByName(every.join(tables, ["document_id", "table_id"], "left_anti").select("document_id", "table_id", "page"))
    return H.integrity_issues(b, known, c, sizes, edges, docs, tables=moved, images=images.select("document_id", "image_id", away(2)))


# ---- hooks, chunks, previews, stages --------------------------------------------------------------------------------


@F.udtf(returnType="key string, value string, confidence double")
class LineKeys:
    """A user's own extractor: the lines ``Bill To`` and ``Currency`` of a document."""

    def eval(self, text: str):
        for line in (text or "").split("\n"):
            key, colon, value = line.partition(": ")
            if colon and key in ("Bill To", "Currency"):
                yield key.lower().replace(" ", "_"), value, 1.5 if key == "Currency" else 0.4


@query("own_extractor_fields", sql("select document_id, 'bill_to' as key, 'Customer ' || owner as value, 0.4::double as confidence, 'lines' as extractor from inv union all select document_id, 'currency', currency, 1.0, 'lines' from inv union all select document_id, 'currency', currency, 0.9, 'currency' from inv where currency <> 'ZZZ'", "inv"))
def own_extractor_fields(spark, d):
    t = S.rendered(spark, d)
    return E.extracted(t, LineKeys, "lines").unionByName(E.currencies(t))


_tables = "select document_id, cast(5 + 1 as bigint) as section, cast(b as integer) as part, 'Table ' || table_id as section_name, 'Description | Qty | Unit Price | Amount' || chr(10) || string_agg(line, chr(10) order by row) as content from (select *, table_id as document_id, (row - 1) // 25 as b from (select table_id, row, string_agg(text, ' | ' order by col) as line from cells where row > 0 group by 1, 2)) join inv using (document_id) where document_type in ('invoice', 'receipt', 'purchase_order') group by document_id, table_id, b"


@query("invoice_table_chunks", sql(_tables.replace("5 + 1", "4 + 1"), "items", "inv", cells=_cells))
def invoice_table_chunks(spark, d):
    """The table chunks among all chunks of a corpus: of invoices, receipts and purchase orders only, behind their sections."""
    b, types = text_lines(spark, d)
    c = cells(spark, d).withColumn("document_id", F.col("table_id")).withColumn("page", F.lit(1))
    return H.by_family(b, types, cells=c).where("chunk_type = 'table'").select("document_id", "section", "part", "section_name", "content")


_sampled = "select document_id, page from (select *, row_number() over (partition by document_id order by page) as i, count(*) over (partition by document_id) as n from (select distinct document_id, page from blocks)) where i <= 2 or ((i - 3) % greatest(greatest(n - 2, 1) // 2, 1) = 0 and (i - 3) // greatest(greatest(n - 2, 1) // 2, 1) < 2)"


@query("sampled_previews", sql("select document_id, array_to_string(regexp_extract_all(string_agg(t, chr(10) order by page), '[^ \\n\\t]+')[1:40], ' ') as preview from (select document_id, page, left(string_agg(text, chr(10) order by ord), 100) as t from blocks semi join sampled using (document_id, page) group by 1, 2) group by 1", "blocks", sampled=_sampled))
def sampled_previews(spark, d):
    return A.sampled_preview(S.blocks(spark, d), 2, 2, 100, 40)


@query("failed_stage_runs", sql("select document_id, case when document_id % 12 = 0 then 'failed' when count(*) filter (length(text) < 10 or length(text) // 4 > 2000) > 0 then 'needs_review' else 'completed' end as status, count(*) filter (document_id % 24 <> 0) as total from blocks group by 1", "blocks"))
def failed_stage_runs(spark, d):
    b = S.blocks(spark, d)
    c = H.validate(b.where("document_id % 24 <> 0").withColumnRenamed("text", "content"))
    return A.run_log(c, "chunked", b.where("document_id % 12 = 0").select("document_id")).select("document_id", "status", "total")


# ---- search (R16, R17, R21) -----------------------------------------------------------------------------------------


def fifty(spark, d):
    """Fifty candidates of each question with rerank scores; the reranker fails for every fourth question."""
    r = scored(spark, d)
    return r.withColumn("rerank_score", F.when(F.col("query_id") % 4 != 3, F.col("rerank_score")))


_final = "round(0.8 / (1 + exp(-(len(list_intersect(string_split(lower(query), ' '), regexp_split_to_array(lower(content), '\\s+'))) / 2.0::double - 1))) + 0.2 * least(score, 1.0), 6)"
_words = "list_distinct(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda w: w <> ''))"


def greedy_sql(scores: str) -> dict[str, str]:
    """Results in order, each kept unless a kept one before it is too much like it: a recursive walk of each query's list."""
    like = "len(list_filter(kept, lambda y: case when len(y) = 0 or len(o.words) = 0 then false else len(list_intersect(y, o.words)) / len(list_distinct(list_concat(y, o.words)))::double > 0.85 end)) > 0"
    return {
        "inorder": f"select *, {_words} as words, row_number() over (partition by query_id order by final desc, chunk_id) as i from ({scores})",
        "walk": f"select query_id, i, chunk_id, document_id, final, true as keep, [words] as kept from inorder where i = 1 union all select o.query_id, o.i, o.chunk_id, o.document_id, o.final, not ({like}), case when {like} then kept else list_append(kept, o.words) end from walk w join inorder o on o.query_id = w.query_id and o.i = w.i + 1",
    }


def _recursive(text: str, first: str) -> str:
    return text.replace(f"with {first}", f"with recursive {first}", 1)


_rr_scores = f"select query_id, chunk_id, document_id, content, {_final} as final from dense join chunks using (chunk_id) join queries using (query_id) where {_final} >= 0.3"
_all_scores = f"select query_id, chunk_id, document_id, content, {_final} as final from dense join chunks using (chunk_id) join queries using (query_id)"
_fb_scores = f"select query_id, chunk_id, document_id, content, case when query_id % 4 = 3 then score else {_final} end as final from dense join chunks using (chunk_id) join queries using (query_id)"
_cap = "select query_id, chunk_id, final, cast(row_number() over (partition by query_id order by final desc, chunk_id) as integer) as rank from (select *, row_number() over (partition by query_id, document_id order by i) as n from walk where keep) where n <= 3"
DIVERSE = _recursive(sql("select query_id, chunk_id, cast(i as integer) as rank from walk where keep", "blocks", "chunks", "queries", **_dense, **greedy_sql(_rr_scores)), "blocks")
RERANKED = _recursive(sql(f"select * from ({_cap}) where rank <= 5", "blocks", "chunks", "queries", **_dense, **greedy_sql(_all_scores)), "blocks")


@query("rerank_runs", _recursive(sql(f"select q.query_id, coalesce(c.n, 0) as candidates, coalesce(f.n, 0) as results, q.query_id % 4 = 3 and c.n is not null as fallback_used from queries q left join (select query_id, count(*) as n from dense group by 1) c on c.query_id = q.query_id left join (select query_id, count(*) as n from ({_cap}) where rank <= 5 group by 1) f on f.query_id = q.query_id", "blocks", "chunks", "queries", **_dense, **greedy_sql(_fb_scores)), "blocks"))
def rerank_runs(spark, d):
    """Candidates in, results out and whether the order of retrieval had to stand, of each question."""
    r = fifty(spark, d)
    return Q.rerank_report(questions(spark, d), r, Q.retrieve_and_rerank(r))


def mode_parts(spark, d):
    """Entities, facts and vendors of the business documents, and short questions: the third and fourth digit of each item's number."""
    ask = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("1"), (F.col("item_id") % 50).cast("string")).alias("query"))
    inv = S.invoices(spark, d)
    entities = inv.where("invoice_number is not null").select("document_id", F.lit("invoice_number").alias("entity_type"), F.col("invoice_number").alias("value"))
    facts = inv.where("invoice_total is not null").select("document_id", F.lit("invoice_total").alias("fact_type"), F.col("invoice_total").cast("decimal(18,2)").cast("string").alias("value"))
    return ask, entities, facts, inv.where("vendor is not null").select("document_id", F.lit("vendor").alias("key"), F.col("vendor").alias("value"))


_modes = {
    "ask": "select item_id as query_id, '1' || (item_id % 50) as query from benchmark", "em": "select query_id, document_id from ask join inv on contains(lower(invoice_number), query)",
    "fm": "select query_id, document_id from ask join inv on contains(cast(cast(invoice_total as decimal(18,2)) as varchar), query)", "mm": "select query_id, document_id from ask join inv on contains(lower(vendor), query)",
    "tops": "select 'entity' as mode, *, row_number() over (partition by query_id order by document_id) as r from em union all select 'fact', *, row_number() over (partition by query_id order by document_id) from fm union all select 'metadata', *, row_number() over (partition by query_id order by document_id) from mm",
    "hybrids": "select query_id, chunk_id from (select query_id, chunk_id, row_number() over (partition by query_id order by sum(1.0::double / (60 + rank)) desc, chunk_id) as r from (select query_id, chunk_id, rank from dense union all select query_id, chunk_id, rank from ranked) group by 1, 2) where r <= 20",
}


@query("search_in_six_modes", sql("select mode, query_id, count(*) as n, count(document_id) as documents from (select mode, query_id, document_id from tops where r <= 20 union all select 'keyword', query_id, null from ranked union all select 'semantic', query_id, null from dense union all select 'hybrid', query_id, null from hybrids) group by 1, 2", "inv", "chunks", "queries", **_dense, **_bm, **_modes))
def search_in_six_modes(spark, d):
    """One entry for all modes: rows of every mode with the columns that it has."""
    ask, entities, facts, fields = mode_parts(spark, d)
    near, best = dense(spark, d), bm25_search(spark, d)
    fused = Q.ranked(Q.reciprocal_rank_fusion(near, best), 20, score="fused")
    every = Q.by_mode(hybrid=fused, keyword=best, semantic=near, entity=Q.entity_mode(entities, ask), fact=Q.fact_mode(facts, ask), metadata=Q.metadata_mode(fields, ask))
    return every.groupBy("mode", "query_id").agg(F.count("*").alias("n"), F.count("document_id").alias("documents"))


@query("timed_search_log", sql("select query_id, query, count(chunk_id) as results, case when query_id % 3 = 0 then '{}' else '{\"lang\":\"de\"}' end as filters, true as timed from queries left join ranked using (query_id) group by 1, 2", "chunks", "queries", **_bm))
def timed_search_log(spark, d):
    results, ms, rows = Q.timed(bm25_search(spark, d))
    q = questions(spark, d)
    filters = q.select("query_id", F.when(F.col("query_id") % 3 != 0, "de").alias("lang"))
    log = Q.search_log(results, q, filters, ms)
    return log.select("query_id", "query", "results", "filters", ((F.col("latency_ms") > 0) & F.lit(rows >= 0)).alias("timed"))


# ---- a whole evaluation run (X19, X22) ------------------------------------------------------------------------------


@query("generated_cases_with_chunks", sql("select document_id, kind, question, coalesce(array_to_string(chunk_ids[1:case when kind = 'summary' then 5 else 3 end], ','), '') as relevant from (select document_id, 'summary' as kind, 'What is ' || file_name || ' about?' as question from inv union all select document_id, 'fact', 'What is the invoice total?' from inv union all select document_id, 'metadata', 'What is the currency?' from inv) left join (select document_id, list(document_id || '_c' || row_index order by row_index) as chunk_ids from items group by 1) using (document_id)", "inv", "items"))
def generated_cases_with_chunks(spark, d):
    inv = S.invoices(spark, d)
    facts = inv.select("document_id", F.lit("invoice_total").alias("fact_type"), F.col("invoice_total").alias("value"))
    c = S.line_items(spark, d).select("document_id", F.concat(F.col("document_id").cast("string"), F.lit("_c"), F.col("row_index").cast("string")).alias("chunk_id"), F.col("row_index").alias("chunk_index"))
    cases = X.generated_cases(inv, facts, inv.select("document_id", F.lit("currency").alias("key"), F.col("currency").alias("value")), chunks=c)
    return cases.select("document_id", "kind", "question", F.array_join("relevant", ",").alias("relevant"))


def evaluated_cases(spark, d):
    """A case for each question: its relevant chunks, the chunks that BM25 gives, an answer that quotes the best one, and what a judge said."""
    q, best = questions(spark, d), bm25_search(spark, d)
    k = F.col("case_id")
    got = best.where("query_id % 5 <> 0 or rank > 3").select(F.col("query_id").alias("case_id"), F.col("chunk_id").alias("item"), "rank")
    relevant = best.where("rank in (1, 3)").groupBy("query_id").agg(F.collect_list("chunk_id").alias("relevant"))
    cases = q.join(relevant, "query_id", "left").select(F.col("query_id").alias("case_id"), (F.col("query_id") % 6 != 0).alias("answered"), F.coalesce("relevant", F.array().cast("array<string>")).alias("relevant"))
    cited = got.where("rank = 1 or rank = 5").select("case_id", F.substring_index("item", "_", 1).alias("document_id"), F.lit(1).alias("page"))
    expected = cases.select("case_id", F.explode("relevant").alias("item")).select("case_id", F.substring_index("item", "_", 1).alias("document_id"), F.lit(1).alias("page"))
    answers = q.select(F.col("query_id").alias("case_id"), F.concat(F.lit("In all 1,"), F.lpad((F.col("query_id") % 1000).cast("string"), 3, "0"), F.lit(" were found. See the source.")).alias("text"), F.when(F.col("query_id") % 7 == 0, "refused").otherwise("valid").alias("status"))
    facts = q.select(F.col("query_id").alias("case_id"), F.lit("total").alias("fact_type"), F.when(F.col("query_id") % 2 == 0, 1000.0 + F.col("query_id") % 1000).otherwise(5.0).alias("value"))
    scores = q.select(F.col("query_id").alias("case_id"), (F.col("query_id") % 10 / 10.0).alias("faithfulness"), (F.col("query_id") % 17 * 10.0).alias("latency_ms"))
    return X.run_cases(cases, got, answers, facts, expected, cited, scores).withColumn("case_id", k)


_ks = "select unnest([1, 5, 10, 20, 50]) as k"
_run = {
    "rel": "select query_id, chunk_id as item from ranked where rank in (1, 3)", "ret": "select query_id, chunk_id as item, rank from ranked where query_id % 5 <> 0 or rank > 3", "ks": _ks,
    "m": "select q.query_id, k, (select count(*) from rel where rel.query_id = q.query_id) as n, (select count(*) from ret join rel using (query_id, item) where ret.query_id = q.query_id and rank <= k) as hits, (select count(*) from ret where ret.query_id = q.query_id and rank <= k) as returned, (select min(rank) from ret join rel using (query_id, item) where ret.query_id = q.query_id) as first_hit, (select sum(1 / log2(rank + 1)) from ret join rel using (query_id, item) where ret.query_id = q.query_id and rank <= k) as dcg from queries q, ks",
    "atk": "select query_id, k, round(coalesce(hits / nullif(n, 0), 0), 6) as recall, round(coalesce(hits / nullif(returned, 0), 0), 6) as precision, round(coalesce(1 / first_hit, 0), 6) as mrr, round(coalesce(dcg / (select sum(1 / log2(i + 1)) from range(1, least(greatest(n, 1), k) + 1) t(i)), 0), 6) as ndcg, cast(hits > 0 as integer) as hit from m",
    "cit": "select query_id, string_split(item, '_')[1] as doc from ret where rank in (1, 5)", "exd": "select distinct query_id, string_split(item, '_')[1] as doc from rel",
    "cp": "select query_id, round(count(*) filter (doc in (select e.doc from exd e where e.query_id = cit.query_id)) / count(*), 6) as p, count(*) as n_cited from cit group by 1",
    "cr": "select query_id, round(count(*) filter (doc in (select c.doc from cit c where c.query_id = exd.query_id)) / count(*), 6) as r from exd group by 1",
    "wide": "select q.query_id as case_id, " + ", ".join(f"coalesce((select {x} from atk where atk.query_id = q.query_id and k = {k}), 0) as {x}_at_{k}" for x in ("recall", "precision", "ndcg", "hit") for k in (1, 5, 10, 20, 50)) + ", coalesce((select max(mrr) from atk where atk.query_id = q.query_id), 0) as mrr, case when p is null and r is null then null else coalesce(p, 0) end as citation_precision, case when p is null and r is null then null else coalesce(r, 1) end as citation_recall, round(least(1.0, coalesce(n_cited, 0) / 2), 6) as citation_coverage, case when q.query_id % 2 = 0 then 1.0 else 0.0 end as numerical_accuracy, (q.query_id % 10) / 10.0 as faithfulness, q.query_id % 17 * 10.0 as latency_ms, q.query_id % 6 <> 0 as answered, case when q.query_id % 7 = 0 then 'refused' else 'valid' end as status, (select count(*) from rel where rel.query_id = q.query_id) as n_relevant from queries q left join cp on cp.query_id = q.query_id left join cr on cr.query_id = q.query_id",
    "judged": "select *, case when answered and status = 'refused' then 'refused' when n_relevant > 0 and recall_at_10 = 0 then 'nothing relevant found' when answered and faithfulness < 0.5 then 'not faithful' when not answered and recall_at_10 <= 0 then 'nothing relevant found' end as reason from wide",
}
_case_columns = [f"{x}_at_{k}" for x in ("recall", "precision", "ndcg", "hit") for k in (1, 5, 10, 20, 50)] + ["mrr", "citation_precision", "citation_recall", "citation_coverage", "numerical_accuracy", "faithfulness"]


@query("evaluation_cases", sql("select case_id, " + ", ".join(_case_columns) + ", latency_ms, reason, reason is null as passed from judged", "chunks", "queries", **_bm, **_run))
def evaluation_cases(spark, d):
    return evaluated_cases(spark, d).select("case_id", *_case_columns, "latency_ms", "reason", "passed")


_means = " union all ".join(f"select '{c}' as metric, round(avg({c}), 6)::double as value from judged" for c in _case_columns)
_ranks = " union all ".join(f"select 'latency_p{p}', max(latency_ms) filter (i = least(n * {p} // 100, n - 1)) from lat" for p in (50, 95, 99))


@query("evaluation_run_metrics", sql(f"{_means} union all select 'total_cases', count(*) from judged union all select 'passed_cases', count(*) from judged where reason is null union all select 'failed_cases', count(*) from judged where reason is not null union all select 'latency_avg', round(avg(latency_ms), 6) from judged union all {_ranks}", "chunks", "queries", **_bm, **_run, lat="select latency_ms, row_number() over (order by latency_ms) - 1 as i, count(*) over () as n from judged"))
def evaluation_run_metrics(spark, d):
    return X.run_metrics(written(evaluated_cases(spark, d), shared_folder(spark)))  # a row a case, read by several jobs


# ---- audits, monitoring, streams ------------------------------------------------------------------------------------


_flags = "select document_type as run_id, severity, document_id, rule_key, document_id * 100 + rank as position from (select f.*, i.document_type, dense_rank() over (order by rule_key) as rank from findings f join inv i using (document_id) where triggered)"
_sev = "case severity when 'critical' then 3 when 'high' then 2 when 'medium' then 1 else 0 end"


def run_flags(spark, d):
    found = findings(spark, d)
    places = {k: i + 1 for i, k in enumerate(sorted(r.key for r in __import__("docweave.operators.rules", fromlist=["rules"]).rules("2001-01-01")))}
    rank = F.element_at(F.create_map(*(F.lit(x) for p in places.items() for x in p)), F.col("rule_key"))
    return found.where("triggered").join(S.invoices(spark, d).select("document_id", F.col("document_type").alias("run_id")), "document_id").withColumn("position", F.col("document_id") * 100 + rank)


@query("audit_capped_memories", with_rules(f"select run_id, k as key_findings, f as risk_flags, o as open_questions from (select run_id, string_agg('finding ' || document_id, ';' order by document_id) as k from (select document_type as run_id, document_id, row_number() over (partition by document_type order by document_id desc) as r from inv) where r <= 4 group by 1) join (select run_id, string_agg(severity || ' ' || rule_key, ';' order by r) as f from (select run_id, severity, rule_key, row_number() over (partition by run_id order by {_sev} desc, document_id, rule_key) as r from fl) where r <= 8 group by 1) using (run_id) left join (select run_id, string_agg('Document ' || document_id || ' could not be processed', ';' order by document_id) as o from (select document_type as run_id, document_id, row_number() over (partition by document_type order by document_id desc) as r from inv where document_id % 9 = 0) where r <= 4 group by 1) using (run_id)", fl="select document_type as run_id, f.* from findings f join inv using (document_id) where triggered"))
def audit_capped_memories(spark, d):
    """All three lists of a run's memory capped: last findings and questions, gravest flags."""
    inv = S.invoices(spark, d).select("document_id", F.col("document_type").alias("run_id"))
    seen = inv.select("run_id", F.col("document_id").alias("position"), F.concat(F.lit("finding "), F.col("document_id").cast("string")).alias("text"))
    f = findings(spark, d).where("triggered").join(inv, "document_id")
    flags = f.select("run_id", "severity", F.struct("document_id", "rule_key").alias("position"), F.concat_ws(" ", "severity", "rule_key").alias("text"))
    m = T.capped_memory(seen, flags, T.failures_as_questions(inv, inv.where("document_id % 9 = 0")), 4)
    return m.select("run_id", F.array_join("key_findings", ";").alias("key_findings"), F.array_join(F.transform("risk_flags", lambda x: x["text"]), ";").alias("risk_flags"), F.nullif(F.array_join("open_questions", ";"), F.lit("")).alias("open_questions"))


_sections = """select run_id, 'Risk Summary' as section, unnest([0, 1, 2, 3])::bigint as place, unnest(['| critical | ' || c || ' |', '| high | ' || h || ' |', '| medium | ' || m || ' |', '| low | ' || l || ' |']) as line from (select run_id, count(*) filter (severity = 'critical') as c, count(*) filter (severity = 'high') as h, count(*) filter (severity = 'medium') as m, count(*) filter (severity = 'low') as l from fl group by 1)
union all select run_id, 'Flagged Issues Requiring Review', document_id, '| ' || severity || ' | ' || rule_key || ' | document ' || document_id || ' |' from fl where severity in ('critical', 'high')
union all select document_type, 'Open Questions', document_id, '- Document ' || document_id || ' could not be processed' from inv where document_id % 9 = 0"""


@query("audit_report_sections", with_rules(_sections, fl="select document_type as run_id, f.* from findings f join inv using (document_id) where triggered"))
def audit_report_sections(spark, d):
    inv = S.invoices(spark, d).select("document_id", F.col("document_type").alias("run_id"))
    return T.report_sections(findings(spark, d), inv, inv.where("document_id % 9 = 0"))


@query("audit_memory_sizes", "select event_id, cast(length('{\"k\":\"' || json_extract_string(props, '$.k') || '\"}') // 4 as integer) as n_tokens from events")
def audit_memory_sizes(spark, d):
    m = table(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return m.select("event_id", T.memory_tokens("m").alias("n_tokens"))


_masked = """'{"body":"' || case when event_id % 2 = 0 then repeat('x', 200) || '...[truncated, full document content not logged]' else 'x' end || '","items":[{"n":' || event_id || ',"secret":"***REDACTED***"},"plain",[' || event_id % 7 || ']],"user":{"Access_Token":"***REDACTED***","deep":{"api_key":"***REDACTED***","deeper":{"gone":"***REDACTED***","n":1},"kind":"' || event_type || '"},"id":' || user_id || '}}'"""


@query("redacted_json", f"select event_id, {_masked} as json from events")
def redacted_json(spark, d):
    """Nested values of any shape, masked in objects and lists down to depth 3; what lies deeper is masked whole."""
    i, s = F.col("event_id"), lambda c: F.col(c).cast("string")
    body = F.when(i % 2 == 0, F.repeat(F.lit("x"), 2500)).otherwise("x")
    text = F.concat(
        F.lit('{"user": {"id": '), s("user_id"), F.lit(', "Access_Token": ["t", 1], "deep": {"kind": "'), F.col("event_type"), F.lit('", "api_key": {"a": 1}, "deeper": {"n": 1, "gone": {"too": "deep"}}}}, "items": [{"n": '),
        s("event_id"), F.lit(', "secret": "s"}, "plain", ['), (i % 7).cast("string"), F.lit(']], "body": "'), body, F.lit('"}'),
    )
    return table(spark, d, "events").select("event_id", F.to_json(N.redacted_variant(F.parse_json(text), 4, into_lists=True)).alias("json"))


@query("all_summary_cards", sql(f"select 'documents' as card, cast(count(*) as double) as value from files union all select 'processed', count(*) from files where document % 12 <> 0 and document % 5 <> 1 union all select 'queued', count(*) from files where document % 5 = 1 union all select 'failed', count(*) from files where document % 12 = 0 and document % 5 <> 1 union all select 'ocr_success_rate', round(100.0 * count(*) filter (document % 8 <> 3) / count(*), 6) from files where document % 2 = 1 union all select 'storage', sum(strlen(text)) from documents union all select 'embeddings', count(*) from embeddings union all select 'active_users', count(distinct user_id) from events", files="select doc_id as document from documents"))
def all_summary_cards(spark, d):
    """The eight cards: of documents by the state of their last stage, OCR success in percent, storage, vectors and users."""
    k = F.col("doc_id")
    docs = table(spark, d, "documents").select(F.when(k % 5 == 1, "queued").when(k % 12 == 0, "failed").otherwise("completed").alias("state"), F.when(k % 2 == 1, k % 8 != 3).alias("ocr"), F.octet_length("text").alias("bytes"))
    of = lambda s: (docs, F.count_if(F.col("state") == s))
    return N.cards(
        documents=(docs, F.count("*")), processed=of("completed"), queued=of("queued"), failed=of("failed"), ocr_success_rate=(docs, F.round(100.0 * F.count_if("ocr") / F.count("ocr"), 6)), storage=(docs, F.sum("bytes")),
        embeddings=(table(spark, d, "embeddings"), F.count("*")), active_users=(table(spark, d, "events"), F.count_distinct("user_id")),
    )


@query("stream_documents", "select doc_id as file_id, case when doc_id % 3 = 0 then 'new-' else 'doc-' end || doc_id || '.md' as file_name, cast(case when doc_id % 3 = 0 then 2 else 1 end as integer) as version from documents")
def stream_documents(spark, d):
    """Documents that come in three batches, some again and some changed: each is there once, as its newest version."""
    folder, i = shared_folder(spark), F.col("doc_id")
    t = table(spark, d, "documents")
    row = lambda name, version: [i.alias("file_id"), F.concat(F.lit(name), i.cast("string"), F.lit(".md")).alias("file_name"), F.octet_length("text").cast("long").alias("size"), F.lit(version).alias("version")]
    for n, part in enumerate((t.select(*row("doc-", 1)), t.where(i % 3 == 0).select(*row("new-", 2)).unionByName(t.where(i % 4 == 0).select(*row("doc-", 1))), t.where(i % 6 == 0).select(*row("doc-", 1)))):
        part.write.parquet(f"{folder}/in/{n}")
        s = spark.readStream.schema(part.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        streams.ingest_documents(s, f"{folder}/out", f"{folder}/state", buckets=4).awaitTermination()  # all files that came since: one batch
    return spark.read.parquet(f"{folder}/out").select("file_id", "file_name", "version")
