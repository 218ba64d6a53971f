"""Business documents derived from the order tables, and blocks, cells and files derived from the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import money
from .tables import table

TYPES = ["invoice"] * 5 + ["receipt", "purchase_order", "contract", "policy", "unknown"]


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, row_index, item_name, quantity, unit_price, line_total, discount, suppkey)."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    li = li.withColumn("row_index", F.row_number().over(order)).join(part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"), "left")
    off = (F.col("l_orderkey") + F.col("row_index")) % 17 == 0
    return li.select(
        F.col("l_orderkey").alias("document_id"), "row_index", F.col("p_name").alias("item_name"), F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"), F.when(off, F.col("l_extendedprice") * 1.1).otherwise(F.col("l_extendedprice")).alias("line_total"),
        F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice") * F.col("l_discount")).alias("discount"), F.col("l_suppkey").alias("suppkey"),
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One business document per order, with facts and metadata as columns."""
    k = F.col("o_orderkey")
    price, less, tax = F.col("l_extendedprice").cast("decimal(10,2)"), F.col("l_discount").cast("decimal(4,2)"), F.col("l_tax").cast("decimal(4,2)")
    net = price * (F.lit(1).cast("decimal(4,2)") - less)
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(net).alias("net"), F.sum(net * tax).alias("taxes"), F.min("l_suppkey").alias("suppkey"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("suppkey"), F.col("s_name").alias("s_name"))
    o = table(spark, sf_dir, "orders").join(sums, F.col("l_orderkey") == k, "left").join(supplier, "suppkey", "left")
    day = F.to_date("o_orderdate")
    subtotal, taxes = F.round("net", 2).cast("double"), F.round("taxes", 2).cast("double")
    o = o.withColumn("subtotal", subtotal).withColumn("tax_amount", taxes)
    both = F.round(F.col("subtotal") + F.col("tax_amount"), 2)
    total = F.when(k % 11 == 0, F.col("o_totalprice")).when(k % 41 == 0, -both).when(k % 43 == 0, F.floor(both / 100) * 100.0).otherwise(both)
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (k % 10 + 1).cast("int"))
    return o.select(
        k.alias("document_id"), kind.alias("document_type"), F.concat(kind, F.lit("-"), k.cast("string"), F.lit(".txt")).alias("file_name"),
        F.when(k % 19 != 0, F.concat(F.lit("INV-"), F.when(k % 31 == 0, k - 1).otherwise(k).cast("string"))).alias("invoice_number"),
        F.when(k % 23 != 0, F.col("s_name")).alias("vendor"), day.alias("invoice_date"),
        F.when(k % 37 == 0, None).when(k % 29 == 0, F.date_sub(day, 5)).otherwise(F.date_add(day, 30)).alias("due_date"),
        F.when(k % 3 != 0, day).alias("effective_date"), F.when(k % 3 != 0, F.date_add(day, 365)).alias("expiration_date"),
        F.when(k % 47 == 0, "ZZZ").when(k % 3 == 0, "USD").when(k % 3 == 1, "EUR").otherwise("GBP").alias("currency"),
        "subtotal", "tax_amount", total.alias("invoice_total"), F.col("o_custkey").alias("owner"), F.col("o_orderdate").alias("created_at"),
    )


def item_lines(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """(document_id, items): the line items as lines of a text, and ``more`` aggregates of each document's ``line_items``."""
    line = F.concat_ws(" ", "item_name", F.col("quantity").cast("int").cast("string"), money(F.col("unit_price")), money(F.col("line_total")))
    return line_items(spark, sf_dir).groupBy("document_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_index", line.alias("line")))), lambda x: x["line"]), "\n").alias("items"), *more)


def labelled_text() -> Column:
    """The text of a document, over the columns of ``invoices`` and ``item_lines``."""
    j = F.floor(F.col("document_id") / 10).cast("long")
    date = lambda c: F.date_format(c, "MM/dd/yyyy")
    kind = F.col("document_type")
    return F.concat_ws(
        "\n", F.upper(kind), F.concat(F.lit("Invoice No: "), F.col("invoice_number")), F.concat(F.lit("Vendor: "), F.regexp_replace("vendor", "#", " ")),
        F.concat(F.lit("Bill To: Customer "), F.col("owner").cast("string")), F.concat(F.lit("Invoice Date: "), date("invoice_date")), F.concat(F.lit("Due Date: "), date("due_date")),
        F.lit("Description Qty Price Amount"), F.col("items"), F.concat(F.lit("Subtotal: "), money(F.col("subtotal"))), F.concat(F.lit("Tax: "), money(F.col("tax_amount"))),
        F.concat(F.lit("Total: "), money(F.col("invoice_total"))), F.concat(F.lit("Currency: "), F.col("currency")),
        F.when((kind == "contract") & (j % 4 != 0), "Signature: on file"), F.when((kind == "contract") & (j % 5 != 0), "Either side may give notice of termination."),
        F.when((kind == "policy") & (j % 6 != 0), "Purpose of this text."), F.when((kind == "policy") & (j % 7 != 0), "Scope of this text."), F.when((kind == "policy") & (j % 8 != 0), "Policy owner: audit."),
    )


def rendered(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(document_id, document_type, file_name, text): the documents as texts with labelled lines, and ``more`` columns of the ``invoices``."""
    every = invoices(spark, sf_dir).join(item_lines(spark, sf_dir), "document_id", "left")
    return every.select("document_id", "document_type", "file_name", labelled_text().alias("text"), *more)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, block_id, type, text, page, order): the lines of the documents."""
    from ..operators.parsing import text_blocks

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    found = text_blocks(docs)
    return found.withColumn("type", F.when(F.col("order") % 7 == 0, "heading").otherwise("paragraph")).withColumn("page", (F.floor(F.col("order") / 20) + 1).cast("int"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, file_name, size, content): the documents as uploaded files of many kinds."""
    names = ["txt", "md", "exe", "html", "TXT", "csv", "zip", "pdf", "js", ""]
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    ext = F.element_at(F.array(*map(F.lit, names)), (i % 10 + 1).cast("int"))
    name = F.concat(F.when(i % 4 == 0, "../up/").otherwise(""), F.lit("doc-"), i.cast("string"), F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))
    return d.select(i.alias("file_id"), F.when(i % 97 == 0, "..").otherwise(name).alias("file_name"), F.when(i % 13 == 0, 0).when(i % 17 == 0, 60 * 1024 * 1024).otherwise(F.octet_length("text")).cast("long").alias("size"), F.col("text").alias("content"), "source")
