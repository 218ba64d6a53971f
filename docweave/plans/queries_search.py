"""Queries on search: question processing, BM25, vectors, fusion, reranking, history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import shared_folder, written
from ..operators import retrieval as Q
from ..operators import text_index as I
from ..operators import vector_index as VI
from ..operators import vectors as V
from ..sources.tables import table
from .oracle import STOP, sql, text_list

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def chunks(spark, d):
    """The chunks of all whole documents: one for each heading with all that follows it."""
    from ..operators.chunking import clauses
    from ..sources.frames import blocks

    c = clauses(blocks(spark, d), None)
    return c.select(F.concat(F.col("document_id").cast("string"), F.lit("_c"), F.col("section").cast("string")).alias("chunk_id"), "document_id", F.col("section").alias("chunk_index"), "content", "pages", "section_name")


_kept = {}


def kept_chunks(spark, d):
    """The ``chunks``, written once in a session for all queries that read them more than once or pick few of them."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _kept:
        _kept[key] = written(chunks(spark, d), shared_folder(spark))
    return _kept[key]


def questions(spark, d):
    """The stated set of questions: of each benchmark item, its first six words."""
    t = table(spark, d, "benchmark")
    return t.select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), 1, 6), " ").alias("query"))


_parts = "select query_id, unnest(string_split(query, ' ')) as w, unnest(range(len(string_split(query, ' ')))) as i from asked"
_asked = "select conv_id * 1000 + turn as query_id, text as query from conversations where role = 'user' and text <> ''"


def asked(spark, d):
    """The questions that users asked: all user turns of the conversations."""
    t = table(spark, d, "conversations").where("role = 'user' and text <> ''")
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))


@query("normalised_queries", sql("select query_id, trim(regexp_replace(query, '\\s+', ' ', 'g')) as query from asked", asked=_asked))
def normalised_queries(spark, d):
    return asked(spark, d).select("query_id", Q.normalised("query").alias("query"))


@query("acronyms", sql("select query_id, string_agg(case lower(trim(w, '?.')) when 'po' then 'purchase order' when 'inv' then 'invoice' when 'vat' then 'value added tax' when 'gst' then 'goods and services tax' else w end, ' ' order by i) as query from parts group by 1", asked=_asked, parts=_parts))
def acronyms(spark, d):
    return asked(spark, d).select("query_id", Q.with_acronyms("query").alias("query"))


@query("without_stop_words", sql(f"select query_id, string_agg(w, ' ' order by i) as query from parts where not list_contains({STOP}, lower(w)) group by 1", asked=_asked, parts=_parts))
def without_stop_words(spark, d):
    return asked(spark, d).select("query_id", Q.without_stop_words("query").alias("query"))


_pairs = "select unnest([" + ", ".join(f"'{w}'" for w, s in Q.SYNONYMS.items() for _ in s) + "]) as word, unnest([" + ", ".join(f"'{x}'" for s in Q.SYNONYMS.values() for x in s) + "]) as syn"
_made = "select query_id, query, 0 as own, query as variant from asked union select a.query_id, a.query, 1, replace(lower(a.query), p.word, p.syn) from asked a join parts t on a.query_id = t.query_id join pairs p on trim(lower(t.w), '?.,') = p.word"


@query("query_variants", sql("select query_id, cast(n - 1 as integer) as variant_no, variant from (select *, row_number() over (partition by query_id order by own, variant) as n from made) where n <= 3", asked=_asked, parts=_parts, pairs=_pairs, made=_made))
def query_variants(spark, d):
    return Q.variants(asked(spark, d))


_vocab = "select w as word, count(*) as n from (select unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) as w from documents) where w <> '' group by 1"


@query("vocabulary", sql("select * from vocab", vocab=_vocab))
def vocabulary(spark, d):
    return Q.vocabulary(table(spark, d, "documents"))


#: Edits in DuckDB count bytes: there, each letter beyond ASCII becomes one capital letter, which no word has, so that edits count letters.
_letters = "select coalesce(string_agg(c, '' order by c), '') as found, left('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', cast(count(*) as integer)) as put from (select distinct unnest(string_split(word, '')) as c from (select word from vocab union all select word from typed)) where strlen(c) > 1"
_typed = "select distinct query_id, lower(case when i = 1 then left(w, 3) || 'q' || substr(w, 4) when i = 2 then substr(w, 2) when i = 3 then left(w, 2) || substr(w, 5) when i = 4 then left(w, 1) || substr(w, 3, 1) || substr(w, 2, 1) || substr(w, 4) else w end) as word from (select query_id, unnest(string_split(query, ' ')) as w, unnest(range(1, len(string_split(query, ' ')) + 1)) as i from queries)"


@query("spelling", sql("select word, arg_max(known, (n, known)) as correction from (select t.word, v.word as known, v.n from (select distinct word, translate(word, found, put) as plain from typed, letters where word <> '' and word not in (select word from vocab)) t join (select *, translate(word, found, put) as plain from vocab, letters) v on left(v.word, 1) = left(t.word, 1) and abs(length(v.word) - length(t.word)) <= 2 and levenshtein(v.plain, t.plain) <= 2) group by 1", "queries", vocab=_vocab, typed=_typed, letters=_letters))
def spelling(spark, d):
    """Each word of a question is misspelt by its place: a letter more, the first one gone, two gone, two that changed places; the fifth and sixth stay."""
    w = F.col("w")
    sub = lambda a, n=None: F.substring(w, a, n) if n else F.expr(f"substring(w, {a})")
    i = F.col("i")
    typed = F.when(i == 0, F.concat(sub(1, 3), F.lit("q"), sub(4))).when(i == 1, sub(2)).when(i == 2, F.concat(sub(1, 2), sub(5))).when(i == 3, F.concat(sub(1, 1), sub(3, 1), sub(2, 1), sub(4))).otherwise(w)
    words = questions(spark, d).select(F.posexplode(F.split("query", " ")).alias("i", "w")).select(F.lower(typed).alias("word")).where("word <> ''")
    return Q.corrected(words, Q.vocabulary(table(spark, d, "documents")))


@query("query_filters", sql("select query_id, case when contains(lower(query), 'invoice') then 'invoice' when contains(lower(query), 'contract') then 'contract' when contains(lower(query), 'receipt') then 'receipt' when contains(lower(query), 'policy') then 'policy' end as document_type, nullif(trim(regexp_extract(query, '(?:from|with|to)\\s+([A-Z][A-Za-z0-9&.\\s]{2,30})', 1)), '') as vendor, nullif(regexp_extract(query, '\\b(20\\d{2}|19\\d{2})\\b', 1), '') || '-01-01' as date_from, case when query_id % 2 = 1 then '2020-12-31' else nullif(regexp_extract(query, '\\b(20\\d{2}|19\\d{2})\\b', 1), '') || '-12-31' end as date_to from asked", asked=_asked))
def query_filters(spark, d):
    own = {"date_to": F.when(F.col("query_id") % 2 == 1, "2020-12-31")}
    f = Q.merged_filters(own, Q.filters_of("query"))
    return asked(spark, d).select("query_id", *(c.alias(k) for k, c in f.items()))


@query("named_files", sql("select query_id, name as file_name, document_id from (select item_id as query_id, item_id % 7 as user_id, 'doc-' || item_id || '.txt' as name from benchmark) q left join (select doc_id as document_id, doc_id % 7 as owner, 'doc-' || doc_id // 2 * 2 || '.txt' as f, row_number() over (partition by doc_id % 7, doc_id // 2 order by doc_id desc) as n from documents) f on name = f and user_id = owner and n = 1"))
def named_files(spark, d):
    i = F.col("doc_id")
    name = lambda n: F.concat(F.lit("doc-"), n.cast("string"), F.lit(".txt"))
    docs = table(spark, d, "documents").select(i.alias("document_id"), (i % 7).alias("user_id"), name(i - i % 2).alias("file_name"), i.alias("created_at"))
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 7).alias("user_id"), F.concat(F.lit("what do we owe in "), name(F.col("item_id")), F.lit(" ?")).alias("query"))
    return Q.named_file(q, docs)


_bm = {
    "toks": "select chunk_id, t as term from (select chunk_id, unnest(regexp_split_to_array(lower(content), '\\s+')) as t from chunks) where t <> ''",
    "tf": "select chunk_id, term, count(*) as tf from toks group by 1, 2", "lens": "select chunk_id, count(*) as length from toks group by 1", "tot": "select count(*) as n, avg(length) as mean_length from lens",
    "raw": "select term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) as raw from tf, tot group by term, n", "idf": "select term, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw",
    "qt": "select query_id, t as term, count(*) as times from (select query_id, unnest(string_split(lower(query), ' ')) as t from queries) where t <> '' group by 1, 2",
    "bm": "select query_id, chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))), 6) as score from qt join idf using (term) join tf using (term) join lens using (chunk_id), tot group by 1, 2",
    "ranked": "select * from (select query_id, chunk_id, score, cast(row_number() over (partition by query_id order by score desc, chunk_id) as integer) as rank from bm where score > 0) where rank <= 10",
}


_indexes: dict[tuple[str, str], I.TextIndex] = {}


def text_index(spark, d):
    """The index of all chunks, built once in a session and then read by every query that ranks by it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _indexes:
        _indexes[key] = I.build(kept_chunks(spark, d))
    return _indexes[key]


@query("text_index_blocks", sql("select term, count(*) as df, round(max(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))), 6) as top, any_value(round(idf, 6)) as idf from tf join lens using (chunk_id) join idf using (term), tot group by 1", "chunks", **{k: _bm[k] for k in ("toks", "tf", "lens", "tot", "raw", "idf")}))
def text_index_blocks(spark, d):
    index = text_index(spark, d)
    b = index.blocks.groupBy("term").agg(F.sum("df").alias("df"), F.round(F.max("top"), 6).alias("top"))
    return b.join(index.terms.select("term", F.round("idf", 6).alias("idf")), "term")


@query("bm25_postings", sql("select chunk_id, term, tf, length from tf join lens using (chunk_id)", "chunks", **{k: _bm[k] for k in ("toks", "tf", "lens")}))
def bm25_postings(spark, d):
    return Q.postings(chunks(spark, d))


@query("bm25_search", sql("select * from ranked", "chunks", "queries", **_bm))
def bm25_search(spark, d):
    return I.search(text_index(spark, d), questions(spark, d), 10)


_vec = "select v.vec_id as id, q.vec_id as query_id, round(list_dot_product(cast(v.embedding as double[]), cast(q.embedding as double[])) / (sqrt(list_dot_product(cast(v.embedding as double[]), cast(v.embedding as double[]))) * sqrt(list_dot_product(cast(q.embedding as double[]), cast(q.embedding as double[])))), 6) as score from embeddings v, embeddings q where q.vec_id % 20 = 0 and v.vec_id <> q.vec_id"


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def vector_queries(spark, d):
    return vectors(spark, d).where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")


@query("vector_top_k", sql("select query_id, count(*) as n, round(sum(score), 3) as total, round(max(score), 4) as best from (select *, row_number() over (partition by query_id order by score desc, id) as r from vec) where r <= 10 group by 1", vec=_vec))
def vector_top_k(spark, d):
    top = V.top_k(vectors(spark, d), vector_queries(spark, d), 10)
    return top.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.sum("score"), 3).alias("total"), F.round(F.max("score"), 4).alias("best"))


@query("vector_top_k_filtered", sql("select query_id, count(*) as n, round(max(score), 4) as best from (select query_id, score, row_number() over (partition by query_id order by score desc, id) as r from vec join embeddings e on e.vec_id = vec.id where e.label in (1, 3)) where r <= 5 group by 1", vec=_vec))
def vector_top_k_filtered(spark, d):
    top = V.top_k(vectors(spark, d), vector_queries(spark, d), 5, V.payload_filter({"label": [1, 3]}))
    return top.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.max("score"), 4).alias("best"))


@query("vector_lsh", None)
def vector_lsh(spark, d):
    return V.lsh_top_k(vectors(spark, d), vector_queries(spark, d), 10, 64)


@query("vector_index", None)
def vector_index(spark, d):
    return VI.search(VI.build(vectors(spark, d), 64), vector_queries(spark, d), 10)


@query("vector_index_lists", sql("select count(*) as n, count(distinct vec_id) as ids from embeddings where embedding is not null and len(embedding) = 64"))
def vector_index_lists(spark, d):
    """Every vector lies in exactly one list."""
    return VI.build(vectors(spark, d), 64).coded.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query("hash_vectors", sql("select doc_id, round(list_sum(list_transform(range(32), lambda i: cast(('0x' || substr(sha256(text), cast(i * 2 + 1 as bigint), 2)) as integer) / 255.0 * 2 - 1)), 6) + 0.0 as total, cast(64 as integer) as dim from documents"))
def hash_vectors(spark, d):
    v = table(spark, d, "documents").select("doc_id", V.hash_vector("text").alias("v"))
    return v.select("doc_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / 2, 6).alias("total"), F.size("v").alias("dim"))


@query("vector_issues", "select vec_id, case vec_id % 5 when 1 then 'empty' when 2 then 'wrong dimension' when 3 then 'not finite' when 4 then 'all zero' end as issue from embeddings")
def vector_issues(spark, d):
    i, e = F.col("vec_id"), F.col("embedding")
    v = F.when(i % 5 == 1, F.slice(e, 1, 0)).when(i % 5 == 2, F.slice(e, 1, 63)).when(i % 5 == 3, F.transform(e, lambda x: F.lit(float("nan")).cast("float"))).when(i % 5 == 4, F.transform(e, lambda x: (x * 0).cast("float"))).otherwise(e)
    return table(spark, d, "embeddings").select("vec_id", v.alias("vector")).select("vec_id", V.vector_issue("vector", 64).alias("issue"))


def recs(spark, d):
    c = chunks(spark, d).withColumn("status", F.when(F.length("content") < 200, "invalid").otherwise("valid")).withColumn("chunk_type", F.when(F.col("document_id") % 10 == 0, "table").otherwise("generic"))
    t = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "lang", "source", "text")
    f = t.select("document_id", F.explode(F.array(F.struct(F.lit("language").alias("key"), F.col("lang").alias("value")), F.struct(F.lit("source").alias("key"), F.col("source").alias("value")))).alias("f")).select("document_id", "f.*")
    e = t.select("document_id", F.concat(F.col("document_id").cast("string"), F.lit("_b0")).alias("block_id"), F.lit("origin").alias("entity_type"), F.col("source").alias("value"))
    return V.records(c, f, e, t)


_recs = """select document_id, chunk_id as ref, 'text' as type, content as text from chunks where length(content) >= 200 union all select document_id, chunk_id, 'table', content from chunks where length(content) >= 200 and document_id % 10 = 0
union all select doc_id, cast(doc_id as varchar), 'metadata', 'language: ' || lang || '; source: ' || source from documents union all select doc_id, doc_id || '_b0', 'entity', 'origin: ' || source from documents union all select doc_id, cast(doc_id as varchar), 'summary', left(text, 1500) from documents"""


@query("embedding_records", sql("select document_id, ref, type, sha256(text) as hash from recs", "chunks", recs=_recs))
def embedding_records(spark, d):
    return recs(spark, d).select("document_id", "ref", "type", F.sha2("text", 256).alias("hash"))


@query("records_to_embed", sql("select type, count(*) as n from recs where sha256(text) not in (select sha256(text) from recs where document_id % 4 = 0) group by 1", "chunks", recs=_recs))
def records_to_embed(spark, d):
    r = recs(spark, d).withColumn("model", F.lit("new"))
    model = F.when(F.col("document_id") % 4 == 0, "new").otherwise("old")
    store = r.where("document_id % 2 = 0").select(F.sha2("text", 256).alias("hash"), model.alias("model"), F.lit(True).alias("is_active"))
    return V.to_embed(r, store).groupBy("type").agg(F.count("*").alias("n"))


def versioned(spark, d):
    r = recs(spark, d)
    old = r.withColumn("version", F.lit(1))
    return V.supersede(old, r.where("document_id % 3 = 0").withColumn("version", F.lit(2)))


_versions = "select *, version = max(version) over (partition by document_id, type) as is_active from (select *, 1 as version from recs union all select *, 2 from recs where document_id % 3 = 0)"


@query("active_versions", sql("select document_id, type, count(*) as vectors from versions where is_active group by 1, 2", "chunks", recs=_recs, versions=_versions))
def active_versions(spark, d):
    return V.active_by_type(versioned(spark, d))


def index(spark, d):
    v = versioned(spark, d).withColumn("vector", F.when(F.col("document_id") % 11 == 0, F.array().cast("array<double>")).otherwise(V.hash_vector("text", 32)))
    return V.build_index(v, 32), versioned(spark, d).where("is_active")


_index = "select *, case type when 'text' then 'document_chunks' when 'table' then 'document_tables' when 'metadata' then 'document_metadata' when 'entity' then 'document_entities' else 'document_summaries' end as collection from versions where is_active and document_id % 11 <> 0"


@query("collection_stats", sql("select collection, count(*) as points, count(distinct document_id) as documents from idx group by 1", "chunks", recs=_recs, versions=_versions, idx=_index))
def collection_stats(spark, d):
    return V.collection_stats(index(spark, d)[0])


@query("not_synced", sql("select document_id, ref, type from versions where is_active and document_id % 11 = 0 order by 1, 2, 3 limit 50", "chunks", recs=_recs, versions=_versions))
def not_synced(spark, d):
    idx, active = index(spark, d)
    return V.not_synced(active, idx, 50).select("document_id", "ref", "type")


@query("payloads", "select vec_id as id, vec_id % 50 as document_id, d.source, d.lang as language from embeddings left join documents d on d.doc_id = vec_id % 50")
def payloads(spark, d):
    v = vectors(spark, d).select("id", (F.col("id") % 50).alias("document_id"))
    t = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "source", "lang")
    f = t.select("document_id", F.lit("language").alias("key"), F.col("lang").alias("value"))
    return V.payloads(v, t.drop("lang"), f).select("id", "document_id", "source", "language")


_vectors = {}


def kept_vectors(spark, d):
    """(id, document_id, vector) of the ``kept_chunks``, written once in a session: each block of questions reads them again."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _vectors:
        made = kept_chunks(spark, d).select(F.col("chunk_id").alias("id"), "document_id", V.hash_vector("content", 32).alias("vector"))
        _vectors[key] = written(made, shared_folder(spark))
    return _vectors[key]


def dense(spark, d):
    """(query_id, chunk_id, score, rank): the 30 nearest chunks of each question by their vectors, written once for all that read them."""
    c = kept_vectors(spark, d).select("id", "vector")
    q = questions(spark, d).select("query_id", V.hash_vector("query", 32).alias("vector"))
    return written(V.top_k(c, q, 30, dim=32).select("query_id", F.col("id").alias("chunk_id"), "score", "rank"), shared_folder(spark))


def _bytes(text):
    return f"list_transform(range(32), lambda i: cast(('0x' || substr(sha256({text}), cast(i * 2 + 1 as bigint), 2)) as integer) / 255.0::double * 2 - 1)"


_dense = {
    "cvec": f"select *, sqrt(list_dot_product(v, v)) as length_v from (select chunk_id, {_bytes('content')} as v from chunks)", "qvec": f"select *, sqrt(list_dot_product(q, q)) as length_q from (select query_id, {_bytes('query')} as q from queries)",
    "near": "select query_id, chunk_id, round(list_dot_product(q, v) / (length_q * length_v), 6) as score from cvec, qvec",
    "dense": "select * from (select *, cast(row_number() over (partition by query_id order by score desc, chunk_id) as integer) as rank from near) where rank <= 30",
}


@query("rank_fusion", sql("select query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 9) as fused from (select query_id, chunk_id, rank from dense union all select query_id, chunk_id, rank from ranked) group by 1, 2", "chunks", "queries", **_dense, **_bm))
def rank_fusion(spark, d):
    return Q.reciprocal_rank_fusion(dense(spark, d), bm25_search(spark, d))


@query("weighted_fusion", sql("select query_id, chunk_id, round(0.6 * coalesce(d.score / max_d, 0) + 0.4 * coalesce(s.score / max_s, 0), 6) as fused from (select *, max(score) over (partition by query_id) as max_d from dense) d full join (select *, max(score) over (partition by query_id) as max_s from ranked) s using (query_id, chunk_id)", "chunks", "queries", **_dense, **_bm))
def weighted_fusion(spark, d):
    return Q.weighted_fusion(dense(spark, d), bm25_search(spark, d))


def _scoped(cands: str) -> dict[str, str]:
    """BM25 in SQL with the statistics of each query's own candidates (query_id, chunk_id), as ``csp`` with ranks."""
    return {
        "qt": _bm["qt"], "ctok": f"select query_id as set_id, chunk_id, t as term from (select query_id, chunk_id, unnest(regexp_split_to_array(lower(content), '\\s+')) as t from {cands} join chunks using (chunk_id)) where t <> ''",
        "ctf": "select set_id, chunk_id, term, count(*) as tf from ctok group by 1, 2, 3", "clen": "select set_id, chunk_id, count(*) as length from ctok group by 1, 2", "ctot": "select set_id, count(*) as n, avg(length) as mean_length from clen group by 1",
        "craw": "select set_id, term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) as raw from ctf join ctot using (set_id) group by set_id, term, n", "cidf": "select set_id, term, case when raw < 0 then 0.25 * avg(raw) over (partition by set_id) else raw end as idf from craw",
        "cbm": "select set_id as query_id, chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))), 6) as score from (select query_id as set_id, term, times from qt) join ctf using (set_id, term) join cidf using (set_id, term) join clen using (set_id, chunk_id) join ctot using (set_id) group by 1, 2",
        "csp": "select *, cast(row_number() over (partition by query_id order by score desc, chunk_id) as integer) as rank from cbm where score > 0",
    }


_filtered = {
    "found": "select query_id, chunk_id, score, cast(row_number() over (partition by query_id order by score desc, chunk_id) as integer) as rank from near join chunks using (chunk_id) join documents on doc_id = document_id where lang = case when query_id % 5 = 0 then 'xx' else 'de' end",
    "densef": "select * from found where rank <= 30", "cands": "select query_id, chunk_id, score, rank from densef union all select query_id, chunk_id, score, rank from dense where query_id not in (select query_id from densef)",
}
_fused = "select query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 9) as fused from (select query_id, chunk_id, rank from cands union all select query_id, chunk_id, rank from csp) group by 1, 2"


@query("hybrid_search", sql("select f.query_id, f.chunk_id, fused, f.rank, c.score as dense_score, s.score as sparse_score from (select *, cast(row_number() over (partition by query_id order by fused desc, chunk_id) as integer) as rank from fu) f left join cands c using (query_id, chunk_id) left join csp s using (query_id, chunk_id) where f.rank <= 10", "chunks", "queries", **_dense, **_filtered, **_scoped("cands"), fu=_fused))
def hybrid_search(spark, d):
    """Questions ask for German texts, every fifth for a language that no text is in: these fall back to all texts."""
    german = table(spark, d, "documents").where("lang = 'de'").select(F.col("doc_id").alias("document_id"))
    c = kept_chunks(spark, d)
    v = kept_vectors(spark, d).join(german, "document_id", "left_semi").select("id", "vector")
    q = questions(spark, d).where("query_id % 5 <> 0").select("query_id", V.hash_vector("query", 32).alias("vector"))
    filtered = V.top_k(v, q, 30).withColumnRenamed("id", "chunk_id")
    return Q.hybrid(filtered, c, questions(spark, d), 10, dense(spark, d))


_own = {"chunks": "select block_id as chunk_id, document_id, text as content from blocks", "queries": "select document_id as query_id, array_to_string(string_split(text, ' ')[1:3], ' ') as query from blocks where block_id like '%_b0'", "cands": "select document_id as query_id, chunk_id from chunks where document_id in (select query_id from queries)"}


@query("keyword_search_in_document", sql("select query_id, query_id as document_id, chunk_id, score, rank from csp where rank <= 5", "blocks", **_own, **_scoped("cands")))
def keyword_search_in_document(spark, d):
    from ..sources.frames import blocks

    b = blocks(spark, d).select("document_id", F.col("block_id").alias("chunk_id"), F.col("text").alias("content"))
    q = b.where("chunk_id like '%_b0'").select(F.col("document_id").alias("query_id"), "document_id", F.array_join(F.slice(F.split("content", " "), 1, 3), " ").alias("query"))
    return Q.bm25_scoped(b, q, 5, "document_id")


_lacking = {
    "first": "select chunk_id from chunks order by chunk_index, chunk_id limit 200", "lack": "select query_id from queries where query_id % 3 <> 0", "named": "select query_id, query_id as document_id from lack where query_id % 3 = 1 and query_id in (select doc_id from documents)",
    "cands": "select query_id, chunk_id from named join chunks using (document_id) union all select query_id, chunk_id from lack, first where query_id not in (select query_id from named)",
}


@query("fallback_candidates", sql("select query_id, chunk_id, score, rank from csp", "chunks", "queries", **_lacking, **_scoped("cands")))
def fallback_candidates(spark, d):
    found = dense(spark, d).where("query_id % 3 = 0")
    q = questions(spark, d)
    ids = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"))
    named = q.where("query_id % 3 = 1").join(ids, F.col("query_id") == F.col("document_id")).select("query_id", "document_id")
    return Q.fallback(q, found, kept_chunks(spark, d), named=named)


_variants = {
    "asked": "select * from queries", "parts": _parts, "pairs": _pairs, "made": _made, "v": "select query_id, query_id * 10 + n as vid, variant from (select *, row_number() over (partition by query_id order by own, variant) as n from made) where n <= 3",
    **{k: _bm[k] for k in ("toks", "tf", "lens", "tot", "raw", "idf")}, "vt": "select vid, query_id, t as term, count(*) as times from (select vid, query_id, unnest(string_split(lower(variant), ' ')) as t from v) where t <> '' group by 1, 2, 3",
    "vbm": "select vid, query_id, chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))), 6) as score from vt join idf using (term) join tf using (term) join lens using (chunk_id), tot group by 1, 2, 3",
    "best": "select query_id, chunk_id, max(score) as score from vbm where score > 0 group by 1, 2",
}


@query("best_of_variants", sql("select * from (select *, cast(row_number() over (partition by query_id order by score desc, chunk_id) as integer) as rank from best) where rank <= 10", "chunks", "queries", **_variants))
def best_of_variants(spark, d):
    """A variant's own k best hold whatever it gives to the k best of its question."""
    v = Q.variants(questions(spark, d)).withColumn("vid", F.col("query_id") * 10 + F.col("variant_no") + 1)
    scores = I.search(text_index(spark, d), v.select(F.col("vid").alias("query_id"), F.col("variant").alias("query")), 10)
    return Q.best_of_variants(scores.withColumn("query_id", F.floor(F.col("query_id") / 10)), 10)


_final = "round(0.8 / (1 + exp(-(len(list_intersect(string_split(lower(query), ' '), regexp_split_to_array(lower(content), '\\s+'))) / 2.0::double - 1))) + 0.2 * least(score, 1.0), 6)"
_rr = f"select * from (select query_id, chunk_id, document_id, {_final} as final, cast(row_number() over (partition by query_id order by {_final} desc, chunk_id) as integer) as rank from dense join chunks using (chunk_id) join queries using (query_id) where {_final} >= 0.3)"


def scored(spark, d):
    """The dense results with their chunks and a rerank score: how many words of the question the chunk has."""
    r = dense(spark, d).withColumnRenamed("score", "fused").drop("rank").join(kept_chunks(spark, d), "chunk_id").join(questions(spark, d), "query_id")
    met = F.array_intersect(F.split(F.lower("query"), " "), F.split(F.lower("content"), r"\s+"))
    return r.withColumn("rerank_score", F.size(met) / 2.0 - 1)


def reranked(spark, d):
    return Q.rerank(scored(spark, d), 0.3)


@query("reranked", sql("select query_id, chunk_id, final, rank from rr", "chunks", "queries", **_dense, rr=_rr))
def reranked_query(spark, d):
    return reranked(spark, d).select("query_id", "chunk_id", "final", "rank")


@query("per_document_cap", sql("select query_id, chunk_id from (select *, row_number() over (partition by query_id, document_id % 3 order by rank) as n from rr) where n <= 2", "chunks", "queries", **_dense, rr=_rr))
def per_document_cap(spark, d):
    return Q.per_document(reranked(spark, d).withColumn("document_id", F.col("document_id") % 3), 2).select("query_id", "chunk_id")


@query("diverse_results", None)
def diverse_results(spark, d):
    return Q.diverse(reranked(spark, d)).select("query_id", "chunk_id", "rank")


@query("retrieve_and_rerank", None)
def retrieve_and_rerank(spark, d):
    return Q.retrieve_and_rerank(scored(spark, d)).select("query_id", "chunk_id", "final", "rank")


_first = "lower(string_split(query, ' ')[1])"


_cut = "case when p = 0 then left(content, 160) || (case when length(content) > 160 then '...' else '' end) else (case when lo > 0 then '...' else '' end) || substr(content, lo + 1, hi - lo) || (case when hi < length(content) then '...' else '' end) end"


@query("snippets", sql(f"select query_id, chunk_id, {_cut} as snippet from (select *, greatest(0, p - 81) as lo, least(length(content), p + 79) as hi from (select *, strpos(lower(content), {_first}) as p from dense join chunks using (chunk_id) join queries using (query_id)))", "chunks", "queries", **_dense))
def snippets(spark, d):
    r = dense(spark, d).join(kept_chunks(spark, d), "chunk_id").join(questions(spark, d), "query_id")
    return r.select("query_id", "chunk_id", Q.snippet("content", "query").alias("snippet"))


@query("highlighted", None)
def highlighted(spark, d):
    r = dense(spark, d).join(kept_chunks(spark, d), "chunk_id").join(questions(spark, d), "query_id")
    return r.select("query_id", "chunk_id", Q.highlighted("content", "query").alias("text"))


@query("shaped_results", sql("select query_id, chunk_id, coalesce(case when document_id % 5 <> 0 then 'Title ' || document_id end, 'Unknown Document') as title, page from dense join chunks using (chunk_id)", "chunks", "queries", **_dense))
def shaped_results(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("document_id")).where("document_id % 5 <> 0").select("document_id", F.concat(F.lit("Title "), F.col("document_id").cast("string")).alias("title"))
    return Q.shaped(Q.with_content(dense(spark, d), kept_chunks(spark, d)), t).select("query_id", "chunk_id", "title", "page")


@query("search_log", sql("select query_id, query, count(chunk_id) as results from queries left join ranked using (query_id) group by 1, 2", "chunks", "queries", **_bm))
def search_log(spark, d):
    return Q.search_log(bm25_search(spark, d), questions(spark, d))


@query("search_modes", sql("select 'keyword' as mode, query_id, count(*) as n from ranked group by 2 union all select 'semantic', query_id, count(*) from dense group by 2", "chunks", "queries", **_dense, **_bm))
def search_modes(spark, d):
    both = Q.by_mode(keyword=bm25_search(spark, d), semantic=dense(spark, d))
    return both.groupBy("mode", "query_id").agg(F.count("*").alias("n"))


_log = "select event_id as id, user_id, ts as at_time, query from (select *, event_id % (select count(*) from benchmark) as item from events where event_type in ('click', 'view')) join queries on query_id = item"


def log(spark, d):
    items = table(spark, d, "benchmark").agg(F.count("*").alias("items"))  # one row
    e = table(spark, d, "events").where("event_type in ('click', 'view')").crossJoin(F.broadcast(items))
    e = e.select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("at"), (F.col("event_id") % F.col("items")).alias("query_id"))
    return e.join(questions(spark, d), "query_id").drop("query_id")


@query("recent_searches", sql("select user_id, id, query, cast(r as integer) as rank from (select *, row_number() over (partition by user_id order by at_time desc, id desc) as r from log) where r <= 5", "queries", log=_log))
def recent_searches(spark, d):
    return Q.recent(log(spark, d), 5).select("user_id", "id", "query", "rank")


@query("popular_searches", sql("select query, count(*) as times from log group by 1 order by 2 desc, 1 limit 10", "queries", log=_log))
def popular_searches(spark, d):
    return Q.popular(log(spark, d))


_pool = {
    "recent": "select user_id, query from (select *, row_number() over (partition by user_id order by at_time desc, id desc) as r from log) where r <= 50", "top": "select query from log group by 1 order by count(*) desc, 1 limit 20",
    "pool": "select user_id, query from recent where starts_with(lower(query), 't') union select user_id, query from (select distinct user_id from events), top where starts_with(lower(query), 't')",
}


@query("search_suggestions", sql("select * from (select user_id, 't' as prefix, query, cast(row_number() over (partition by user_id order by query) as integer) as rank from pool) where rank <= 5", "queries", log=_log, **_pool))
def search_suggestions(spark, d):
    prefixes = table(spark, d, "events").select("user_id").distinct().select("user_id", F.lit("t").alias("prefix"))
    return Q.suggestions(log(spark, d), prefixes).select("user_id", "prefix", "query", "rank")


@query("saved_searches", sql("select user_id, id, cast(row_number() over (partition by user_id order by (id % 7 = 0) desc, at_time desc, id) as integer) as place from log where id % 3 = 0", "queries", log=_log))
def saved_searches(spark, d):
    return Q.saved(log(spark, d).where("id % 3 = 0").withColumn("favourite", F.col("id") % 7 == 0)).select("user_id", "id", "place")


@query("cleared_history", sql("select user_id, count(*) as n from log where user_id % 4 <> 0 group by 1", "queries", log=_log))
def cleared_history(spark, d):
    log_ = log(spark, d)
    return Q.without_history(log_, log_.where("user_id % 4 = 0"), "user_id").groupBy("user_id").agg(F.count("*").alias("n"))
