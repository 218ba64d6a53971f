"""DuckDB forms of the derived frames, to be put before a query's own SQL."""

from __future__ import annotations

from ..operators import rules as R
from ..operators import retrieval as Q
from ..sources.frames import TYPES


def text_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


FRAMES = {
    "sums": "select l_orderkey, sum(cast(l_extendedprice as decimal(10,2)) * (cast(1 as decimal(4,2)) - cast(l_discount as decimal(4,2)))) as net, sum(cast(l_extendedprice as decimal(10,2)) * (cast(1 as decimal(4,2)) - cast(l_discount as decimal(4,2))) * cast(l_tax as decimal(4,2))) as taxes, min(l_suppkey) as suppkey from lineitem group by 1",
    "inv0": "select o.*, s_name, cast(round(net, 2) as double) as subtotal, cast(round(taxes, 2) as double) as tax_amount, cast(o_orderdate as date) as day, round(cast(round(net, 2) as double) + cast(round(taxes, 2) as double), 2) as both_parts, o_orderkey as k from orders o left join sums on l_orderkey = o_orderkey left join supplier on s_suppkey = suppkey",
    "inv": f"""select k as document_id, list_extract({text_list(TYPES)}, k % 10 + 1) as document_type, list_extract({text_list(TYPES)}, k % 10 + 1) || '-' || k || '.txt' as file_name,
      case when k % 19 <> 0 then 'INV-' || (case when k % 31 = 0 then k - 1 else k end) end as invoice_number, case when k % 23 <> 0 then s_name end as vendor, day as invoice_date,
      case when k % 37 = 0 then null when k % 29 = 0 then cast(day - 5 as date) else cast(day + 30 as date) end as due_date, case when k % 3 <> 0 then day end as effective_date, case when k % 3 <> 0 then cast(day + 365 as date) end as expiration_date,
      case when k % 47 = 0 then 'ZZZ' when k % 3 = 0 then 'USD' when k % 3 = 1 then 'EUR' else 'GBP' end as currency, subtotal, tax_amount,
      case when k % 11 = 0 then o_totalprice when k % 41 = 0 then -both_parts when k % 43 = 0 then floor(both_parts / 100) * 100.0 else both_parts end as invoice_total, o_custkey as owner, o_orderdate as created_at from inv0""",
    "items": """select l_orderkey as document_id, row_index, p_name as item_name, l_quantity as quantity, l_extendedprice / l_quantity as unit_price, case when (l_orderkey + row_index) % 17 = 0 then l_extendedprice * 1.1 else l_extendedprice end as line_total,
      case when l_returnflag = 'R' then l_extendedprice * l_discount end as discount from (select *, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as integer) as row_index from lineitem) left join part on l_partkey = p_partkey""",
    "lines": """select document_id, string_agg(concat_ws(' ', item_name, cast(quantity as integer), money(unit_price), money(line_total)), chr(10) order by row_index) as items from items group by 1""",
    "texts": """select i.document_id, document_type, file_name, concat_ws(chr(10), upper(document_type), 'Invoice No: ' || invoice_number, 'Vendor: ' || replace(vendor, '#', ' '), 'Bill To: Customer ' || owner,
      'Invoice Date: ' || strftime(invoice_date, '%m/%d/%Y'), 'Due Date: ' || strftime(due_date, '%m/%d/%Y'), 'Description Qty Price Amount', items, 'Subtotal: ' || money(subtotal), 'Tax: ' || money(tax_amount), 'Total: ' || money(invoice_total), 'Currency: ' || currency,
      case when document_type = 'contract' and (i.document_id // 10) % 4 <> 0 then 'Signature: on file' end, case when document_type = 'contract' and (i.document_id // 10) % 5 <> 0 then 'Either side may give notice of termination.' end,
      case when document_type = 'policy' and (i.document_id // 10) % 6 <> 0 then 'Purpose of this text.' end, case when document_type = 'policy' and (i.document_id // 10) % 7 <> 0 then 'Scope of this text.' end, case when document_type = 'policy' and (i.document_id // 10) % 8 <> 0 then 'Policy owner: audit.' end) as text
      from inv i left join lines l on i.document_id = l.document_id""",
    "blocks": """select document_id, document_id || '_b' || ord as block_id, case when ord % 7 = 0 then 'heading' else 'paragraph' end as type, trim(line) as text, cast(ord // 20 + 1 as integer) as page, ord
      from (select doc_id as document_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as ord from documents) where trim(line) <> ''""",
    "files": """select doc_id as file_id, case when doc_id % 97 = 0 then '..' else (case when doc_id % 4 = 0 then '../up/' else '' end) || 'doc-' || doc_id || (case when e = '' then '' else '.' || e end) end as file_name,
      cast(case when doc_id % 13 = 0 then 0 when doc_id % 17 = 0 then 62914560 else strlen(text) end as bigint) as size, text as content, source from (select *, list_extract(['txt', 'md', 'exe', 'html', 'TXT', 'csv', 'zip', 'pdf', 'js', ''], doc_id % 10 + 1) as e from documents)""",
    "chunks": """select document_id || '_c' || section as chunk_id, document_id, section as chunk_index, string_agg(text, chr(10) order by ord) as content, min(page) as page
      from (select *, cast(sum(case when type = 'heading' then 1 else 0 end) over (partition by document_id order by ord) as bigint) as section from blocks) group by document_id, section""",
    "queries": """select item_id as query_id, array_to_string(regexp_extract_all(text, '\\S+')[1:6], ' ') as query from benchmark""",
}
NEEDS = {"inv0": ["sums"], "inv": ["inv0"], "lines": ["items"], "texts": ["inv", "lines"], "chunks": ["blocks"]}
MONEY = "(case when {0} < 0 then '-' else '' end || cast(floor(abs({0}) * 100 + 0.5) as bigint) // 100 || '.' || lpad(cast(cast(floor(abs({0}) * 100 + 0.5) as bigint) % 100 as varchar), 2, '0'))"


def _with_money(sql: str) -> str:
    import re

    return re.sub(r"money\((\w+)\)", lambda m: MONEY.format(m[1]), sql)


def sql(body: str, *frames: str, **extra: str) -> str:
    """``body`` with the derived frames it reads, and further ones, as common table expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for f in frames:
        add(f)
    parts = [f"{n} as ({_with_money(FRAMES[n])})" for n in order] + [f"{n} as ({s})" for n, s in extra.items()]
    return f"with {', '.join(parts)} {body}" if parts else body


def findings_sql(as_of: str, config: dict, text: str = "''") -> tuple[str, dict[str, str]]:
    """The rules in SQL over ``inv``: the findings query and the frames it needs."""
    c = R.DEFAULTS | config
    cond = {
        "missing_invoice_number": ("high", ["invoice"], "coalesce(trim(invoice_number), '') = ''"), "missing_vendor": ("medium", ["invoice", "receipt", "purchase_order"], "coalesce(trim(vendor), '') = ''"),
        "empty_document": ("critical", [], "length(trim(text)) < 20"), "low_ocr_confidence": ("medium", [], f"ocr_confidence < {c['min_ocr_confidence']}"),
        "missing_signature": ("high", ["contract"], "not (contains(lower(text), 'signature') or contains(lower(text), 'signed'))"), "invalid_currency": ("medium", [], f"not list_contains({text_list(R.CURRENCIES)}, currency)"),
        "future_transaction_date": ("high", [], f"invoice_date > date '{as_of}'"), "missing_company": ("low", [], "coalesce(trim(vendor), '') = '' and coalesce(trim(customer), '') = ''"),
        "total_equals_subtotal_plus_tax": ("high", ["invoice", "receipt"], f"abs(subtotal + tax_amount - invoice_total) > {c['tolerance_pct']} * greatest(invoice_total, 1.0)"), "negative_invoice_amount": ("critical", ["invoice", "receipt", "purchase_order"], "invoice_total < 0"),
        "invoice_exceeds_approval_threshold": ("medium", ["invoice", "purchase_order"], f"invoice_total > {c['approval_limit']}"), "line_item_math_mismatch": ("medium", [], "coalesce(bad_items, 0) > 0"),
        "missing_due_date": ("low", ["invoice"], "due_date is null"), "invoice_date_after_due_date": ("high", ["invoice"], "invoice_date > due_date"), "duplicate_invoice": ("critical", ["invoice"], "coalesce(same_number, 0) > 1"),
        "missing_effective_date": ("medium", ["contract"], "effective_date is null"), "expired_contract": ("high", ["contract"], f"expiration_date < date '{as_of}'"), "missing_termination_clause": ("low", ["contract"], "not contains(lower(text), 'terminat')"),
        "required_section_missing": ("medium", ["policy"], " or ".join(f"not contains(lower(text), '{s}')" for s in c["required_sections"])), "round_number_payment": ("low", [], "invoice_total > 0 and fmod(invoice_total, 100) = 0"),
        "weekend_transaction": ("low", [], "isodow(invoice_date) >= 6"), "high_value_transaction": ("medium", [], f"invoice_total > {c['high_value_threshold']}"), "invoice_splitting": ("high", ["invoice"], "coalesce(related, 0) >= 2"),
    }
    sure = {"low_ocr_confidence": "coalesce(ocr_confidence, 1.0)", "total_equals_subtotal_plus_tax": "case when invoice_total is not null and subtotal is not null and tax_amount is not null then 1.0 else 0.0 end"}
    rows = [f"select document_id, '{k}' as rule_key, coalesce({t}, false) as triggered, '{s}' as severity, cast({sure.get(k, '1.0')} as double) as confidence from wide" + (f" where list_contains({text_list(types)}, document_type)" if types else "") for k, (s, types, t) in cond.items()]
    frames = {
        "numbers": "select invoice_number, count(*) as same_number from inv where invoice_number is not null group by 1",
        "near": f"select document_id, count(*) over (partition by vendor order by invoice_date range between interval {c['split_days']} days preceding and interval {c['split_days']} days following) - 1 as related from inv where document_type = 'invoice' and invoice_total >= {c['split_from'] * c['approval_limit']} and invoice_total < {c['approval_limit']} and vendor is not null",
        "bad": "select document_id, count(*) filter (abs(quantity * unit_price - line_total) > 0.02 * greatest(line_total, 1.0)) as bad_items from items group by 1",
        "wide": "select i.*, t.text, same_number, related, bad_items, 'Customer ' || i.owner as customer, case when i.document_id % 2 = 0 then null else (i.document_id % 10) / 10.0 end as ocr_confidence from inv i left join texts t on i.document_id = t.document_id left join numbers n on i.invoice_number = n.invoice_number left join near r on i.document_id = r.document_id left join bad b on i.document_id = b.document_id",
        "findings": " union all ".join(rows),
    }
    return "select * from findings", frames


STOP = text_list(Q.STOP_WORDS)
