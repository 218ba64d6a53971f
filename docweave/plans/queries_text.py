"""Queries on texts: blocks, integrity, chunks, metadata, entities, facts and line items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chunking as H
from ..operators import extract as E
from ..operators import parsing as P
from ..operators import rules as R
from ..sources import frames as S
from ..sources.tables import table
from .oracle import sql, text_list

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


@query("text_blocks", sql("select document_id, block_id, text, cast(ord as integer) as block_order from blocks", "blocks"))
def text_blocks(spark, d):
    return S.blocks(spark, d).select("document_id", "block_id", "text", F.col("order").alias("block_order"))


@query("html_blocks", None)
def html_blocks(spark, d):
    return P.html_blocks(table(spark, d, "pages"))


@query("reading_order", sql("select document_id, page, string_agg(block_id, ',' order by ord, block_id) as block_ids from blocks group by 1, 2", "blocks"))
def reading_order(spark, d):
    return H.reading_order(S.blocks(spark, d)).select("document_id", "page", F.array_join("block_ids", ",").alias("block_ids"))


@query("canonical_documents", sql("select document_id, count(*) as blocks, sha256(string_agg(text, chr(10) order by page, ord)) as raw_text_sha256 from blocks group by 1", "blocks"))
def canonical_documents(spark, d):
    c = H.canonical(S.blocks(spark, d))
    return c.select("document_id", F.size("document.blocks").cast("long").alias("blocks"), F.sha2("document.raw_text", 256).alias("raw_text_sha256"))


@query("canonical_json", sql("select document_id, to_json({'schema_version': '1.0', 'blocks': list({'page': page, 'order': ord, 'block_id': block_id, 'type': type, 'text': text} order by page, ord, block_id), 'raw_text': string_agg(text, chr(10) order by page, ord)})::varchar as json from blocks group by 1", "blocks"))
def canonical_json(spark, d):
    return H.canonical(S.blocks(spark, d)).select("document_id", F.to_json("document").alias("json"))


@query("heading_edges", sql("select document_id, source, block_id as target from (select *, last_value(case when type = 'heading' then block_id end ignore nulls) over (partition by document_id order by page, ord) as source from blocks) where type = 'paragraph' and source is not null", "blocks"))
def heading_edges(spark, d):
    return H.heading_edges(S.blocks(spark, d))


def broken(spark, d):
    b = S.blocks(spark, d).withColumn("box_page", F.when(F.col("order") % 11 == 0, F.col("page") + 1).otherwise(F.col("page")))
    pages = b.select("document_id", "page").distinct().where("not (document_id % 5 = 0 and page = 2)")
    cells = S.line_items(spark, d).select("document_id", F.col("document_id").alias("table_id"))
    sizes = cells.groupBy("table_id").agg(F.when(F.col("table_id") % 9 == 0, 1).otherwise(F.count("*")).alias("row_count"), F.lit(1).alias("col_count"))
    edges = H.heading_edges(b).withColumn("source", F.when(F.col("document_id") % 8 == 0, F.concat("source", F.lit("x"))).otherwise(F.col("source")))
    docs = b.select("document_id").distinct().withColumn("schema_version", F.when(F.col("document_id") % 6 == 0, "0.9").otherwise("1.0"))
    return docs, H.integrity_issues(b, pages, cells, sizes, edges, docs)


_edges = "select document_id, source from (select *, last_value(case when type = 'heading' then block_id end ignore nulls) over (partition by document_id order by page, ord) as source from blocks) where type = 'paragraph' and source is not null"
_issues = """select document_id, 'block on missing page' as issue, block_id as item from blocks where document_id % 5 = 0 and page = 2 union all select document_id, 'box on another page', block_id from blocks where ord % 11 = 0
union all select document_id, 'too many cells', cast(document_id as varchar) from items where document_id % 9 = 0 group by document_id having count(*) > 1 union all select document_id, 'unknown edge source', source || 'x' from edges where document_id % 8 = 0
union all select distinct document_id, 'schema version', '0.9' from blocks where document_id % 6 = 0"""


@query("integrity_issues", sql("select * from issues", "blocks", "items", edges=_edges, issues=_issues))
def integrity_issues(spark, d):
    return broken(spark, d)[1]


@query("canonical_status", sql("select document_id, coalesce(n, 0) as issues, case when coalesce(n, 0) > 0 then 'needs_review' else 'canonicalized' end as status from (select distinct document_id from blocks) left join (select document_id, count(*) as n from issues group by 1) using (document_id)", "blocks", "items", edges=_edges, issues=_issues))
def canonical_status(spark, d):
    return H.document_status(*broken(spark, d))


@query("repeated_block_ids", sql("select document_id, left(text, 3) as block_id, count(*) as n from blocks group by 1, 2 having count(*) > 1", "blocks"))
def repeated_block_ids(spark, d):
    return H.repeated_block_ids(S.blocks(spark, d).withColumn("block_id", F.substring("text", 1, 3)))


ITEMS = ["item_name", "quantity", "unit_price", "line_total"]
NAMES = ["Description", "Qty", "Unit Price", "Amount"]


def cells(spark, d):
    li = S.line_items(spark, d).select(F.col("document_id"), "row_index", *(F.col(c) if c == "item_name" else (F.col(c).cast("int").cast("string") if c == "quantity" else S.money(F.col(c))).alias(c) for c in ITEMS))
    c = P.cells(li, F.col("document_id"), ITEMS, F.col("row_index"))
    head = F.element_at(F.array(*map(F.lit, NAMES)), F.col("col") + 1)
    return c.withColumn("text", F.when(F.col("row") == 0, head).otherwise(F.col("text")))


_cells = "select document_id as table_id, 0 as row, unnest([0, 1, 2, 3]) as col, unnest(['Description', 'Qty', 'Unit Price', 'Amount']) as text from (select distinct document_id from items) union all select * from (select document_id, row_index, unnest([0, 1, 2, 3]), unnest([item_name, cast(cast(quantity as integer) as varchar), money(unit_price), money(line_total)]) as text from items) where text is not null"
from .oracle import _with_money  # noqa: E402

_cells = _with_money(_cells)


@query("table_cells", sql("select table_id, 1 as page, row as row_no, col, text from cells", "items", cells=_cells))
def table_cells(spark, d):
    return cells(spark, d).withColumnRenamed("row", "row_no")


@query("table_sizes", sql("select table_id, max(row) + 1 as row_count, max(col) + 1 as col_count from cells group by 1", "items", cells=_cells))
def table_sizes(spark, d):
    return H.table_sizes(cells(spark, d))


@query("table_chunks", sql("select table_id, cast(b as bigint) as batch, 'Description | Qty | Unit Price | Amount' || chr(10) || string_agg(line, chr(10) order by row) as content, min(row) as first_row, max(row) as last_row from (select *, (row - 1) // 3 as b from (select table_id, row, string_agg(text, ' | ' order by col) as line from cells where row > 0 group by 1, 2)) group by 1, 2", "items", cells=_cells))
def table_chunks(spark, d):
    return H.table_chunks(cells(spark, d), 3)


_clauses = "select document_id, section, coalesce(max(case when type = 'heading' then text end), 'Preamble') as section_name, string_agg(text, chr(10) order by page, ord) as content from (select *, sum(cast(type = 'heading' as integer)) over (partition by document_id order by page, ord) as section from blocks) group by 1, 2"


@query("clause_chunks", sql("select document_id, cast(section as bigint) as section, section_name, content from clauses", "blocks", clauses=_clauses))
def clause_chunks(spark, d):
    return H.clauses(S.blocks(spark, d)).select("document_id", "section", "section_name", "content")


def packed_sql(budget: int) -> tuple[str, dict[str, str]]:
    """Greedy packing as a recursive query over the blocks of each section."""
    t = "greatest(1, length(text) // 4)"
    frames = {
        "parts": f"select document_id, section, text, {t} as t, row_number() over (partition by document_id, section order by page, ord) as i from (select *, sum(cast(type = 'heading' as integer)) over (partition by document_id order by page, ord) as section from blocks)",
        "steps": f"select document_id, section, i, 0 as chunk, text, t as total, text as content, false as cut from parts where i = 1 union all select p.document_id, p.section, p.i, case when s.total + p.t > {budget} then s.chunk + 1 else s.chunk end, p.text, case when s.total + p.t > {budget} then greatest(1, length(s.text) // 4) + p.t else s.total + p.t end, case when s.total + p.t > {budget} then s.text || chr(10) || p.text else s.content || chr(10) || p.text end, s.total + p.t > {budget} from steps s join parts p on p.document_id = s.document_id and p.section = s.section and p.i = s.i + 1",
    }
    return "select document_id, cast(section as bigint) as section, cast(chunk as integer) as part, arg_max(content, i) as content from steps group by 1, 2, 3", frames


_packed, _steps = packed_sql(60)


@query("generic_chunks", sql(_packed, "blocks", **_steps).replace("with blocks", "with recursive blocks", 1))
def generic_chunks(spark, d):
    return H.windowed(S.blocks(spark, d), 60).select("document_id", "section", "part", "content")


@query("narrative_chunks", sql(_packed, "blocks", **_steps).replace("with blocks", "with recursive blocks", 1))
def narrative_chunks(spark, d):
    return H.windowed(S.blocks(spark, d), 60, narrative=True).select("document_id", "section", "part", "content")


_dedup = "select *, row_number() over (partition by document_id order by section) - 1 as chunk_index, count(*) over (partition by document_id) as n from (select *, row_number() over (partition by document_id, trim(content) order by section) as copy from clauses) where copy = 1"
_valid = "case when trim(content) = '' then 'invalid' when length(content) < 10 then 'invalid' when length(content) // 4 > 2000 then 'needs_review' else 'valid' end"


@query("linked_chunks", sql(f"select document_id || '_c' || chunk_index as chunk_id, case when chunk_index > 0 then document_id || '_c' || (chunk_index - 1) end as previous_id, case when chunk_index < n - 1 then document_id || '_c' || (chunk_index + 1) end as next_id, cast(greatest(1, length(content) // 4) as integer) as n_tokens, cast(length(content) as integer) as n_chars, {_valid} as status from dedup", "blocks", clauses=_clauses, dedup=_dedup))
def linked_chunks(spark, d):
    return H.validate(H.without_repeats(H.clauses(S.blocks(spark, d)))).select("chunk_id", "previous_id", "next_id", "n_tokens", "n_chars", "status")


@query("chunk_runs", sql(f"select document_id, count(*) as chunks, cast(sum(greatest(1, length(content) // 4)) as bigint) as tokens, count(*) filter ({_valid} <> 'valid') as invalid, case when count(*) filter ({_valid} <> 'valid') > 0 then 'needs_review' else 'chunked' end as run_status from dedup group by 1", "blocks", clauses=_clauses, dedup=_dedup))
def chunk_runs(spark, d):
    return H.roll_up(H.validate(H.without_repeats(H.clauses(S.blocks(spark, d)))))


def text_lines(spark, d):
    t = S.rendered(spark, d)
    b = P.text_blocks(t.select("document_id", "text"))
    return b, t.select("document_id", "document_type")


_class = "case when contains(low, 'invoice') or contains(low, 'vendor') or contains(low, 'from') then 'header' when contains(low, 'bill to') or contains(low, 'customer') or contains(low, 'client') then 'customer' when contains(low, 'payment') or contains(low, 'due date') or contains(low, 'terms') then 'payment' when contains(low, 'total') or contains(low, 'tax') then 'totals' else 'other' end"
_tlines = "select document_id, document_type, trim(line) as text, i, lower(trim(line)) as low from (select document_id, document_type, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from texts) where trim(line) <> ''"


@query("section_chunks", sql(f"select document_id, {_class} as chunk_type, string_agg(text, chr(10) order by i) as content from tlines where document_type in ('invoice', 'receipt', 'purchase_order') group by 1, 2", "texts", tlines=_tlines))
def section_chunks(spark, d):
    b, types = text_lines(spark, d)
    return H.by_family(b, types).where("section_name in ('Header', 'Customer', 'Payment', 'Totals', 'Other') and chunk_type not in ('clause', 'section')").select("document_id", "chunk_type", "content")


@query("chunk_families", sql("select case when document_type in ('invoice', 'receipt', 'purchase_order') then 'sections' when document_type = 'contract' then 'clause' when document_type = 'policy' then 'section' else 'generic' end as family, cast(count(distinct document_id) as bigint) as documents from tlines group by 1", "texts", tlines=_tlines))
def chunk_families(spark, d):
    b, types = text_lines(spark, d)
    kind = F.when(F.col("chunk_type").isin("clause", "section", "generic"), F.col("chunk_type")).otherwise("sections")
    return H.by_family(b, types).groupBy(kind.alias("family")).agg(F.count_distinct("document_id").alias("documents"))


_fields = """select document_id, 'vendor' as key, trim(regexp_extract(text, '(?i)(?:vendor|from|seller)[:\\s]+([A-Z][A-Za-z0-9&.,\\s]{2,50})(?:\\n|$)', 1)) as value, 0.65 as confidence from texts
union all select document_id, 'customer', trim(regexp_extract(text, '(?i)(?:bill\\s*to|customer|client)[:\\s]+([A-Z][A-Za-z0-9&.,\\s]{2,50})(?:\\n|$)', 1)), 0.65 from texts"""


@query("companies", sql("select document_id, key, value, confidence, 'company' as extractor from f where value <> ''", "texts", f=_fields))
def companies(spark, d):
    return E.companies(S.rendered(spark, d))


@query("currencies", sql("select document_id, 'currency' as key, currency as value, 0.9 as confidence from inv where currency <> 'ZZZ'", "inv"))
def currencies(spark, d):
    return E.currencies(S.rendered(spark, d)).drop("extractor")


@query("document_dates", sql("select document_id, 'invoice_date' as key, strftime(invoice_date, '%Y-%m-%d') as value, 0.8 as confidence from inv union all select document_id, 'due_date', strftime(due_date, '%Y-%m-%d'), 0.8 from inv where due_date is not null", "inv"))
def document_dates(spark, d):
    return E.dates(S.rendered(spark, d)).drop("extractor")


@query("date_entities", sql("select document_id, 'invoice_date' as entity_type, strftime(invoice_date, '%Y-%m-%d') as value, 0.75 as confidence from inv union all select document_id, 'due_date', strftime(due_date, '%Y-%m-%d'), 0.75 from inv where due_date is not null", "inv"))
def date_entities(spark, d):
    return E.date_entities(S.rendered(spark, d))


@query("document_info", sql("select document_id, unnest(['file_name', 'file_type', 'page_count', 'parser_version', 'language']) as key, unnest([file_name, 'txt', '1', '1.0', 'en']) as value from inv", "inv"))
def document_info(spark, d):
    return E.document_info(S.invoices(spark, d).withColumn("page_count", F.lit(1)).withColumn("lang", F.lit("en"))).select("document_id", "key", "value")


def fields(spark, d):
    return E.fields(S.rendered(spark, d, "currency"), {"currency_code": "currency"})


_all_fields = "select document_id, 'currency' as key, currency as value, 0.9 as confidence from inv where currency <> 'ZZZ' union all select document_id, 'invoice_date', strftime(invoice_date, '%Y-%m-%d'), 0.8 from inv union all select document_id, 'due_date', strftime(due_date, '%Y-%m-%d'), 0.8 from inv where due_date is not null union all select document_id, 'currency_code', currency, 0.5 from inv"
_judged = "select *, case when confidence < 0.6 then 'low confidence' end as issue, case when confidence < 0.6 then 'needs_review' else 'valid' end as status from fields"


@query("validated_fields", sql("select document_id, key, value, confidence, issue, status from judged", "inv", fields=_all_fields, judged=_judged))
def validated_fields(spark, d):
    return E.validate_fields(E.normalise(fields(spark, d)), R.CURRENCIES).drop("extractor")


@query("metadata_runs", sql("select document_id, round(avg(confidence), 6) as mean_confidence, count(*) as fields, count(*) filter (status <> 'valid') as to_review, 'needs_review' as run_status from judged group by 1", "inv", fields=_all_fields, judged=_judged))
def metadata_runs(spark, d):
    return E.metadata_run(E.validate_fields(fields(spark, d), R.CURRENCIES))


@query("manual_fields", sql("select document_id, key, case when key = 'currency' and document_id % 5 = 0 then 'AED' else value end as value, case when key = 'currency' and document_id % 5 = 0 then 'manual' when key = 'currency_code' then 'given' when key = 'currency' then 'currency' else 'date' end as extractor from fields union all select document_id, 'currency', 'AED', 'manual' from inv where document_id % 5 = 0 and currency = 'ZZZ'", "inv", fields=_all_fields))
def manual_fields(spark, d):
    manual = S.invoices(spark, d).where("document_id % 5 = 0").select("document_id", F.lit("currency").alias("key"), F.lit("AED").alias("value"))
    return E.upsert(fields(spark, d), manual)


@query("field_search", sql("select document_id from inv where currency = 'USD' and strftime(invoice_date, '%Y-%m-%d') like '%1997%'", "inv"))
def field_search(spark, d):
    return E.search_fields(fields(spark, d), {"currency": "us", "invoice_date": "1997"})


@query("metadata_export", sql("select document_id, string_agg(key || '=' || value, ';' order by key) as fields from fields group by 1", "inv", fields=_all_fields))
def metadata_export(spark, d):
    order = F.array_position(F.array(*map(F.lit, ("currency", "date", "given"))), F.col("extractor"))
    m = E.field_map(fields(spark, d).withColumn("seq", order))
    return m.select("document_id", F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("fields"))


@query("money_facts", sql("select document_id, unnest(['subtotal', 'tax_amount']) as fact_type, unnest([subtotal, tax_amount]) as value, 0.75 as confidence from inv where subtotal is not null union all select document_id, 'invoice_total', invoice_total, 0.75 from inv where invoice_total >= 0", "inv"))
def money_facts(spark, d):
    return E.money_facts(S.rendered(spark, d)).withColumn("value", F.round("value", 2))


@query("wide_facts", sql("select document_id, case when invoice_total >= 0 then invoice_total end as invoice_total, subtotal, tax_amount, cast(null as double) as discount from inv where subtotal is not null or invoice_total >= 0", "inv"))
def wide_facts(spark, d):
    return E.fact_map(E.money_facts(S.rendered(spark, d)).withColumn("seq", F.lit(0)))


@query("fact_issues", sql("select document_id, 'total off' as issue from inv where abs(subtotal + tax_amount - invoice_total) > 0.02 * greatest(invoice_total, 1.0) union all select document_id, 'negative total' from inv where invoice_total < 0", "inv"))
def fact_issues(spark, d):
    return E.fact_issues(S.invoices(spark, d))


@query("text_items", sql("select document_id, row_index, item_name, cast(cast(quantity as integer) as double) as quantity, cast(money(unit_price) as double) as unit_price, cast(money(line_total) as double) as line_total from items".replace("money(unit_price)", _with_money("money(unit_price)")).replace("money(line_total)", _with_money("money(line_total)")), "items"))
def text_items(spark, d):
    return E.text_line_items(S.rendered(spark, d))


@query("table_items", sql("select document_id as table_id, row_index, item_name, cast(cast(quantity as integer) as double) as quantity, cast(money(unit_price) as double) as unit_price, cast(money(line_total) as double) as line_total from items".replace("money(unit_price)", _with_money("money(unit_price)")).replace("money(line_total)", _with_money("money(line_total)")), "items"))
def table_items(spark, d):
    return E.line_items(cells(spark, d)).select("table_id", "row_index", "item_name", "quantity", "unit_price", "line_total")


@query("item_issues", sql("select document_id, row_index from items where abs(quantity * unit_price - coalesce(discount, 0) - line_total) > 0.02 * greatest(line_total, 1.0)", "items"))
def item_issues(spark, d):
    return E.item_issues(S.line_items(spark, d)).select("document_id", "row_index")


def statement_cells(spark, d):
    o = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y"), "o_orderstatus").agg(F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 2).cast("double").alias("total"))
    label = F.when(F.col("o_orderstatus") == "F", "Total Revenue").when(F.col("o_orderstatus") == "O", "Cost of sales").otherwise("Net income")
    amount = S.money(F.col("total"))
    text = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("("), amount, F.lit(")"))).otherwise(F.concat(F.lit("$"), amount))
    rows = o.select(F.col("y").alias("table_id"), F.dense_rank().over(Window.partitionBy("y").orderBy("o_orderstatus")).alias("row"), F.array(label, F.lit("n/a"), text).alias("cells"))
    return rows.select("table_id", "row", F.posexplode("cells").alias("col", "text"))


@query("statement_facts", "select cast(y as integer) as table_id, case o_orderstatus when 'F' then 'revenue' when 'O' then 'cost_of_revenue' else 'net_income' end as fact_type, case when o_orderstatus = 'O' then -total else total end as value, 0.85 as confidence from (select year(o_orderdate) as y, o_orderstatus, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total from orders group by 1, 2)")
def statement_facts(spark, d):
    return E.table_facts(statement_cells(spark, d)).drop("row")


@query("statement_text_facts", "select cast(y as integer) as document_id, case o_orderstatus when 'F' then 'revenue' when 'O' then 'cost_of_revenue' else 'net_income' end as fact_type, total as value, 0.5 as confidence from (select year(o_orderdate) as y, o_orderstatus, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total from orders group by 1, 2) where y % 4 <> 0")
def statement_text_facts(spark, d):
    c = statement_cells(spark, d).where("col <> 1")
    lines = c.groupBy("table_id", "row").agg(F.concat_ws(": ", F.min_by("text", "col"), F.max_by("text", "col")).alias("line"))
    docs = lines.groupBy(F.col("table_id").alias("document_id")).agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("text"))
    return E.statement_facts(docs, c.where("table_id % 4 = 0").select(F.col("table_id").alias("document_id")))


EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+"


_entities = " union all ".join(f"select document_id, block_id, '{k}' as entity_type, trim(unnest(regexp_extract_all(text, '{p}', 1))) as value from blocks" for k, p in E.ENTITIES.items())


@query("emails", sql("select document_id, block_id, value from entities where entity_type = 'email'", "blocks", entities=_entities))
def emails(spark, d):
    return E.entities(S.blocks(spark, d)).where("entity_type = 'email'").select("document_id", "block_id", "value")


@query("entity_counts", sql("select entity_type, count(*) as n, count(distinct document_id) as documents from entities group by 1", "blocks", entities=_entities))
def entity_counts(spark, d):
    return E.entities(S.blocks(spark, d)).groupBy("entity_type").agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("documents"))


def invoice_entities(spark, d):
    t = S.rendered(spark, d)
    return E.entities(P.text_blocks(t))


@query("invoice_numbers", sql("select document_id, invoice_number as value from inv where invoice_number is not null", "inv"))
def invoice_numbers(spark, d):
    return invoice_entities(spark, d).where("entity_type = 'invoice_number' and value like 'INV-%'").select("document_id", "value")


@query("vendor_edges", sql("select document_id, replace(vendor, '#', ' ') as vendor, invoice_number from inv where vendor is not null and invoice_number is not null", "inv"))
def vendor_edges(spark, d):
    f = S.invoices(spark, d).where("vendor is not null").select("document_id", F.lit("vendor").alias("key"), F.regexp_replace("vendor", "#", " ").alias("value"))
    return E.vendor_edges(f, invoice_entities(spark, d).where("value like 'INV-%'"))


@query("entity_search", sql("select document_id, invoice_number as value from inv where invoice_number ilike '%inv-12%' order by document_id limit 20", "inv"))
def entity_search(spark, d):
    return E.search_entities(invoice_entities(spark, d), "invoice_number", "INV-12", 0, 20).select("document_id", "value")


@query("fact_search", sql("select document_id, invoice_total as value from inv where invoice_total >= 0 and contains(cast(cast(invoice_total as decimal(18,2)) as varchar), '77.')", "inv"))
def fact_search(spark, d):
    return E.search_facts(E.money_facts(S.rendered(spark, d)), "invoice_total", "77.").select("document_id", "value")


@query("extraction_runs", sql("select document_id, 2 + cast(invoice_total >= 0 as integer) as facts, n as items from inv join (select document_id, count(*) as n from items group by 1) using (document_id)", "inv", "items"))
def extraction_runs(spark, d):
    t = S.rendered(spark, d)
    return E.extraction_run(invoice_entities(spark, d), E.money_facts(t), E.text_line_items(t)).where("items > 0").select("document_id", F.col("facts").cast("int").alias("facts"), "items")
