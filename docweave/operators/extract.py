"""Metadata, entities, financial facts and line items from texts and tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels, patterns and names as the results need them.
COMPANY = {
    "vendor": r"(?i)(?:vendor|from|seller)[:\s]+([A-Z][A-Za-z0-9&.,\s]{2,50})(?:\n|$)", "customer": r"(?i)(?:bill\s*to|customer|client)[:\s]+([A-Z][A-Za-z0-9&.,\s]{2,50})(?:\n|$)",
    "company": r"(?i)(?:company)[:\s]+([A-Z][A-Za-z0-9&.,\s]{2,50})(?:\n|$)",
}
SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "₹": "INR", "¥": "JPY", "₨": "PKR"}
ISO_CODES = r"\b(USD|EUR|GBP|PKR|INR|JPY|AED|CAD|AUD)\b"
ANY_DATE = r"(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4})"
DATE_LABELS = {"invoice_date": r"invoice\s*date[:\s]", "due_date": r"due\s*date[:\s]", "effective_date": r"effective\s*date[:\s]", "expiration_date": r"expir\w*\s*date[:\s]"}
ENTITY_DATES = {"invoice_date": r"invoice\s*date[:\s]+", "due_date": r"due\s*date[:\s]+", "payment_date": r"payment\s*date[:\s]+", "contract_date": r"contract\s*date[:\s]+"}
ENTITIES = {
    "invoice_number": r"(?i)(?:invoice\s*(?:no|#|number)?[:\s]+)([A-Z0-9\-\/]{3,20})", "po_number": r"(?i)(?:p\.?o\.?\s*(?:no|#|number)?[:\s]+)([A-Z0-9\-\/]{3,20})",
    "receipt_number": r"(?i)(?:receipt\s*(?:no|#|number)?[:\s]+)([A-Z0-9\-\/]{3,20})", "tax_id": r"(?i)(?:tax\s*id[:\s]+)([A-Z0-9\-]{5,20})", "vat_number": r"(?i)(?:vat\s*(?:no|#|number)?[:\s]+)([A-Z0-9\-]{5,20})",
    "bank_account": r"(?i)(?:account\s*(?:no|#|number)?[:\s]+)(\d{6,20})", "postal_code": r"\b(\d{5}(?:-\d{4})?)\b", "email": r"\b([\w.+-]+@[\w-]+\.[\w.-]+)\b",
    "phone": r"\b(\+?\d{1,3}[-.\s]?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4})\b",
}
MONEY = {"invoice_total": r"(?i)\btotal[:\s]+\$?([\d,]+\.?\d*)", "subtotal": r"(?i)sub\s*-?\s*total[:\s]+\$?([\d,]+\.?\d*)", "tax_amount": r"(?i)tax(?:\s*amount)?[:\s]+\$?([\d,]+\.?\d*)", "discount": r"(?i)discount[:\s]+\$?([\d,]+\.?\d*)"}
STATEMENT = {
    "revenue": ["total revenue", "net revenue", "revenue", "net sales", "total net sales"], "cost_of_revenue": ["cost of revenue", "cost of goods sold", "cost of sales"], "gross_profit": ["gross profit", "gross margin"],
    "operating_income": ["operating income", "income from operations"], "net_income": ["net income", "net earnings", "net profit"], "total_assets": ["total assets"], "total_liabilities": ["total liabilities"],
    "total_equity": ["total stockholders' equity", "total shareholders' equity", "total equity"], "cash_and_equivalents": ["cash and cash equivalents", "cash and equivalents"],
    "eps": ["earnings per share", "diluted earnings per share", "basic earnings per share"],
}
COLUMNS = {"item_name": ["item", "description", "product"], "quantity": ["qty", "quantity"], "unit_price": ["unit price", "price", "rate"], "tax": ["tax", "vat"], "discount": ["discount"], "line_total": ["total", "amount"]}
DATE_FORMATS = ["yyyy-MM-dd", "M/d/yyyy", "M-d-yyyy", "M/d/yy", "d/M/yyyy", "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy"]
TOLERANCE = 0.02


def captured(pattern: str, group: int = 1, text: str = "text") -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def iso_date(c: Column) -> Column:
    """The first of ``DATE_FORMATS`` that reads a date. A date of digits alone can only be read by the formats with its separator."""
    first = lambda formats: F.coalesce(*(F.try_to_date(c, f) for f in formats))
    named = [f for f in DATE_FORMATS if "MMM" in f]
    of = lambda mark: [f for f in DATE_FORMATS if f not in named and mark in f]
    read = F.when(c.rlike("[A-Za-z]"), first(named)).when(F.contains(c, F.lit("/")), first(of("/"))).otherwise(first(of("-")))
    return F.date_format(read, "yyyy-MM-dd")


def _long(docs: DataFrame, values: list[tuple[str, Column, Column]], extractor: str) -> DataFrame:
    """(document_id, key, value, confidence, extractor) of the values that are there."""
    each = [F.struct(F.lit(k).alias("key"), v.alias("value"), c.cast("double").alias("confidence")) for k, v, c in values]
    out = docs.select("document_id", F.explode(F.array(*each)).alias("f")).select("document_id", "f.*")
    return out.where("value is not null").withColumn("extractor", F.lit(extractor))


def companies(docs: DataFrame) -> DataFrame:
    strip = lambda c: F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"[,.]+$", "")
    return _long(docs, [(k, F.nullif(strip(captured(p)), F.lit("")), F.lit(0.65)) for k, p in COMPANY.items()], "company")


def currencies(docs: DataFrame) -> DataFrame:
    return _of(_with_currency(docs), ["currency"])


def dates(docs: DataFrame) -> DataFrame:
    """Labelled dates; only where none is found, the first date of the text."""
    return _of(_with_dates(docs), ["date"])


def fields(docs: DataFrame, given: dict[str, str] | None = None) -> DataFrame:
    """The rows of ``currencies`` and ``dates``, and those of ``given`` (key: column of ``docs``, with a confidence of 0.5), in one pass over the texts."""
    return _of(_with_dates(_with_currency(docs)), ["currency", "date"], given or {})


# What a text is searched for lies in columns of its own: within the branches of a conditional each use of an expression is evaluated anew.


def _with_currency(docs: DataFrame) -> DataFrame:
    symbol = reduce(lambda a, kv: a.when(F.contains("text", F.lit(kv[0])), kv[1]), SYMBOLS.items(), F.when(F.lit(False), ""))
    return docs.withColumn("_code", captured(ISO_CODES)).withColumn("_symbol", symbol)


def _with_dates(docs: DataFrame) -> DataFrame:
    out = docs.withColumns({f"_{k}": captured(rf"(?i){p}\s*\b({ANY_DATE})\b") for k, p in DATE_LABELS.items()})
    out = out.withColumns({f"_{k}": iso_date(F.col(f"_{k}")) for k in DATE_LABELS})
    none = reduce(lambda a, b: a & b, (F.col(f"_{k}").isNull() for k in DATE_LABELS))
    out = out.withColumn("_any", F.when(none, captured(rf"(?i)\b({ANY_DATE})\b")))
    return out.withColumn("_any", iso_date(F.col("_any")))


def _of(docs: DataFrame, kinds: list[str], given: dict[str, str] | None = None) -> DataFrame:
    """(document_id, key, value, confidence, extractor) of the columns that ``_with_currency`` and ``_with_dates`` add, and of ``given`` ones."""
    code = F.col("_code")
    values = {
        "currency": lambda: [("currency", F.coalesce(code, "_symbol"), F.when(code.isNotNull(), 0.9).otherwise(0.6))],
        "date": lambda: [*((k, F.col(f"_{k}"), F.lit(0.8)) for k in DATE_LABELS), ("document_date", F.col("_any"), F.lit(0.5))],
    }
    each = [F.struct(F.lit(k).alias("key"), v.alias("value"), c.cast("double").alias("confidence"), F.lit(kind).alias("extractor")) for kind in kinds for k, v, c in values[kind]()]
    each += [F.struct(F.lit(k).alias("key"), F.col(c).alias("value"), F.lit(0.5).alias("confidence"), F.lit("given").alias("extractor")) for k, c in (given or {}).items()]
    found = F.filter(F.array(*each), lambda f: f["value"].isNotNull())
    return docs.select("document_id", F.explode(found).alias("f")).select("document_id", "f.*")


def extracted(docs: DataFrame, extractor, name: str) -> DataFrame:
    """The metadata fields of a user's own extractor, with the columns of the built-in ones, to be united with theirs.

    ``extractor``: a Python UDTF whose ``eval(text)`` gives (key string, value string, confidence double) rows, Arrow-batched if it is made so.
    Fields without a value are left out; a confidence beyond 0 and 1 is put right.
    """
    rows = docs.select("document_id", "text").lateralJoin(extractor(F.col("text").outer()))
    sure = F.least(F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return rows.where("coalesce(value, '') <> ''").select("document_id", "key", "value", sure.alias("confidence"), F.lit(name).alias("extractor"))


def document_info(docs: DataFrame) -> DataFrame:
    """file_name, file_type, page_count, parser_version and language as metadata rows."""
    kind = F.lower(F.substring_index("file_name", ".", -1))
    values = [("file_name", F.col("file_name")), ("file_type", kind), ("page_count", F.col("page_count").cast("string")), ("parser_version", F.lit("1.0")), ("language", F.col("lang"))]
    return _long(docs, [(k, v, F.lit(1.0)) for k, v in values], "document_info")


def word_profile(docs: DataFrame, top: int = 30) -> DataFrame:
    """(lang, word, weight): the commonest words of each language, as shares of its words."""
    w = docs.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
    own = Window.partitionBy("lang")
    ranked = w.withColumn("weight", F.col("n") / F.sum("n").over(own)).withColumn("rank", F.row_number().over(own.orderBy(F.desc("n"), "word")))
    return ranked.where(F.col("rank") <= top).select("lang", "word", "weight")


def languages(docs: DataFrame, profile: DataFrame, chars: int = 2000) -> DataFrame:
    """(document_id, language): the language whose common words fill most of a text's beginning."""
    w = docs.select("document_id", F.explode(F.split(F.lower(F.substring("text", 1, chars)), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    s = w.join(F.broadcast(profile), "word").groupBy("document_id", "lang").agg(F.round(F.sum("weight"), 9).alias("score"))  # broadcast: ``top`` words a language
    best = s.groupBy("document_id").agg(F.max_by("lang", F.struct("score", "lang")).alias("language"))
    return docs.select("document_id").join(best, "document_id", "left")


def normalise(fields: DataFrame) -> DataFrame:
    k, v = F.col("key"), F.col("value")
    return fields.withColumn("value", F.when(k == "currency", F.upper(F.trim(v))).when(F.contains(k, F.lit("date")), F.trim(v)).otherwise(F.trim(F.regexp_replace(v, r"\s+", " "))))


def validate_fields(fields: DataFrame, codes: list[str]) -> DataFrame:
    """Adds status and issue; the first reason that applies counts."""
    k, v = F.col("key"), F.col("value")
    issue = (
        F.when(F.coalesce(F.trim(v), F.lit("")) == "", "empty value").when((k == "currency") & ~v.isin(codes), "unknown currency")
        .when(F.contains(k, F.lit("date")) & ~v.rlike(r"^\d{4}-\d{2}-\d{2}$"), "date not ISO").when(F.col("confidence") < 0.6, "low confidence")
    )
    return fields.withColumn("issue", issue).withColumn("status", F.when(F.col("issue") == "empty value", "invalid").when(F.col("issue").isNotNull(), "needs_review").otherwise("valid"))


def metadata_run(fields: DataFrame) -> DataFrame:
    out = fields.groupBy("document_id").agg(F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count("*").alias("fields"), F.count_if(F.col("status") != "valid").alias("to_review"))
    return out.withColumn("run_status", F.when(F.col("to_review") > 0, "needs_review").otherwise("metadata_extracted"))


def upsert(fields: DataFrame, manual: DataFrame) -> DataFrame:
    """Manual values replace or add to (document_id, key, value, extractor)."""
    m = manual.select("document_id", "key", F.col("value").alias("own"))
    both = fields.select("document_id", "key", "value", "extractor").join(m, ["document_id", "key"], "full")
    return both.select("document_id", "key", F.coalesce("own", "value").alias("value"), F.when(F.col("own").isNotNull(), "manual").otherwise(F.col("extractor")).alias("extractor"))


def search_fields(fields: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Documents that meet all of key contains value, case ignored."""
    met = reduce(lambda a, b: a | b, ((F.col("key") == k) & F.contains(F.lower("value"), F.lit(v.lower())) for k, v in wanted.items()))
    return fields.where(met).groupBy("document_id").agg(F.count_distinct("key").alias("n")).where(F.col("n") == len(wanted)).select("document_id")


def field_map(fields: DataFrame) -> DataFrame:
    """(document_id, fields): the last value of each key, by ``seq``, as a map."""
    last = fields.groupBy("document_id", "key").agg(F.max_by("value", F.struct("seq", "value")).alias("value"))
    return last.groupBy("document_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("fields"))


def entities(blocks: DataFrame) -> DataFrame:
    """(document_id, block_id, page, entity_type, value, confidence): every match in every block."""
    found = F.array(*(F.struct(F.lit(k).alias("entity_type"), F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("values")) for k, p in ENTITIES.items()))
    out = blocks.select("document_id", "block_id", "page", F.explode(found).alias("e")).select("document_id", "block_id", "page", "e.entity_type", F.explode("e.values").alias("value"))
    return out.withColumn("value", F.trim("value")).withColumn("confidence", F.lit(0.7))


def date_entities(docs: DataFrame) -> DataFrame:
    generic = r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2})"
    out = _long(docs, [(k, iso_date(captured(rf"(?i){p}{generic}")), F.lit(0.75)) for k, p in ENTITY_DATES.items()], "rule_based")
    return out.select("document_id", F.col("key").alias("entity_type"), "value", "confidence")


def number(c: Column) -> Column:
    return F.regexp_replace(c, r"[,$]", "").try_cast("double")


def _facts(docs: DataFrame, values: list[tuple[str, Column]], sure: float) -> DataFrame:
    out = _long(docs, [(k, v, F.lit(sure)) for k, v in values], "text")
    return out.select("document_id", F.col("key").alias("fact_type"), number(F.col("value")).alias("value"), "confidence").where("value is not null")


def money_facts(docs: DataFrame) -> DataFrame:
    return _facts(docs, [(k, captured(p)) for k, p in MONEY.items()], 0.75)


def statement_facts(docs: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Facts of statements that have no ``tables`` (document_id): the first label variant that matches."""
    if tables is not None:
        docs = docs.join(tables.select("document_id").distinct(), "document_id", "left_anti")
    return _facts(docs, [(k, F.coalesce(*(captured(rf"(?i){re.escape(v)}[:\s]+\$?\(?([\d,]+\.?\d*)\)?") for v in names))) for k, names in STATEMENT.items()], 0.5)


def cell_number(c: Column) -> Column:
    """The number of a table cell; parentheses make it negative."""
    n = F.regexp_replace(F.regexp_extract(c, r"\(?\$?\s*([\d,]+\.?\d*)\)?", 1), ",", "").try_cast("double")
    return F.when(F.contains(c, F.lit("(")) & F.contains(c, F.lit(")")), -n).otherwise(n)


def statement_label(label: Column) -> Column:
    out = F.when(F.lit(False), "")
    for fact, names in STATEMENT.items():
        out = out.when(reduce(lambda a, b: a | b, (F.contains(label, F.lit(n)) for n in names)), fact)
    return out


def table_facts(cells: DataFrame) -> DataFrame:
    """(table_id, row, fact_type, value): the rightmost number of each row whose first cell names a fact."""
    g = cells.groupBy("table_id", "row").agg(
        F.lower(F.trim(F.min_by("text", "col"))).alias("label"), F.min("col").alias("c0"), F.collect_list(F.struct("col", cell_number(F.col("text")).alias("n"))).alias("all")
    )
    numbers = F.filter("all", lambda x: (x["col"] > F.col("c0")) & x["n"].isNotNull())
    out = g.select("table_id", "row", statement_label(F.col("label")).alias("fact_type"), F.array_max(numbers)["n"].alias("value"))
    return out.where("fact_type is not null and value is not null").withColumn("confidence", F.lit(0.85))


def line_items(cells: DataFrame) -> DataFrame:
    """(table_id, row_index, item_name, quantity, unit_price, tax, discount, line_total) by header words."""
    field = F.when(F.lit(False), "")
    for name, words in reversed(COLUMNS.items()):  # the last field that a header fits counts
        field = field.when(reduce(lambda a, b: a | b, (F.contains(F.lower("text"), F.lit(w)) for w in words)), name)
    head = cells.where("row = 0").select("table_id", "col", field.alias("field")).where("field is not null")
    body = cells.where("row > 0").join(head, ["table_id", "col"])
    each = [F.max_by(F.when(F.col("field") == f, F.col("text")), F.when(F.col("field") == f, F.col("col"))).alias(f) for f in COLUMNS]
    out = body.groupBy("table_id", F.col("row").alias("row_index")).agg(*each)
    return out.select("table_id", "row_index", "item_name", *(number(F.col(f)).alias(f) for f in list(COLUMNS)[1:]))


def text_line_items(docs: DataFrame, have: DataFrame | None = None) -> DataFrame:
    """Lines ``name quantity price total`` of documents that no table gave items for."""
    if have is not None:
        docs = docs.join(have.select("document_id").distinct(), "document_id", "left_anti")
    lines = docs.select("document_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("line", F.trim("line"))
    p = r"^([A-Za-z0-9\s\-]+?)\s+(\d+)\s+([\$\d\.,]+)\s+([\$\d\.,]+)$"
    ok = F.col("line").rlike(p) & ~F.contains(F.lower("line"), F.lit("qty")) & ~F.contains(F.lower("line"), F.lit("total"))
    part = lambda i: F.regexp_extract("line", p, i)
    out = lines.where(ok).withColumn("row_index", F.row_number().over(Window.partitionBy("document_id").orderBy("at")))
    return out.select("document_id", "row_index", F.trim(part(1)).alias("item_name"), number(part(2)).alias("quantity"), number(part(3)).alias("unit_price"), number(part(4)).alias("line_total"))


def fact_map(facts: DataFrame) -> DataFrame:
    """One row per document with each fact type as a column; the last fact of a type, by ``seq``, counts."""
    of = lambda k, *c: F.when(F.col("fact_type") == k, F.struct(*c))
    return facts.groupBy("document_id").agg(*(F.max(of(k, "seq", "value"))["value"].alias(k) for k in MONEY))


def fact_issues(wide: DataFrame) -> DataFrame:
    """(document_id, issue): totals that do not add up, and negative ones."""
    total, s = F.col("invoice_total"), F.col("subtotal") + F.col("tax_amount")
    issues = F.array(F.when(F.abs(s - total) > TOLERANCE * F.greatest(total, F.lit(1.0)), "total off"), F.when(total < 0, "negative total"))
    return wide.select("document_id", F.explode(F.array_compact(issues)).alias("issue"))


def item_issues(items: DataFrame) -> DataFrame:
    off = F.abs(F.col("quantity") * F.col("unit_price") - F.coalesce("discount", F.lit(0.0)) - F.col("line_total")) > TOLERANCE * F.greatest("line_total", F.lit(1.0))
    return items.where(off)


def extraction_run(ents: DataFrame, facts: DataFrame, items: DataFrame) -> DataFrame:
    n = lambda d, name: d.groupBy("document_id").agg(F.count("*").alias(name))
    out = n(ents, "entities").join(n(facts, "facts"), "document_id", "full").join(n(items, "items"), "document_id", "full")
    return out.fillna(0, ["entities", "facts", "items"])


def vendor_edges(fields: DataFrame, ents: DataFrame) -> DataFrame:
    """(document_id, vendor, invoice_number): who issued which number."""
    v = fields.where("key = 'vendor'").select("document_id", F.col("value").alias("vendor"))
    return v.join(ents.where("entity_type = 'invoice_number'").select("document_id", F.col("value").alias("invoice_number")), "document_id").distinct()


def search_entities(ents: DataFrame, kind: str, part: str, skip: int = 0, limit: int = 50) -> DataFrame:
    return ents.where((F.col("entity_type") == kind) & F.col("value").ilike(f"%{part}%")).orderBy("document_id", "block_id", "value").offset(skip).limit(limit)


def search_facts(facts: DataFrame, kind: str, part: str) -> DataFrame:
    return facts.where((F.col("fact_type") == kind) & F.contains(F.col("value").cast("decimal(18,2)").cast("string"), F.lit(part)))
