"""Texts, pages and tables to blocks and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_blocks(docs: DataFrame) -> DataFrame:
    """One paragraph block for each line that is not blank; the line's number stays as the order."""
    lines = docs.select("document_id", F.posexplode(F.split("text", "\n")).alias("order", "text"))
    return lines.where(F.trim("text") != "").select("document_id", F.concat_ws("_b", F.col("document_id").cast("string"), F.col("order").cast("string")).alias("block_id"), F.lit("paragraph").alias("type"), F.trim("text").alias("text"), F.lit(1).alias("page"), "order")


def html_blocks(pages: DataFrame) -> DataFrame:
    """Headings, paragraphs, list items and tables of HTML pages in order; navigation, scripts and styles are dropped.

    An element ends where the next block element starts, so open ``<p>`` are closed; tags inside go, entities of the
    five basic characters are decoded.
    """
    bare = F.regexp_replace("html", r"(?is)<(script|style|nav|footer)\b.*?</\1\s*>", " ")
    cut = r"(?is)<(h[1-4]|p|li|table)(?:\s[^>]*)?>(.*?)(?=<(?:/?(?:h[1-4]|p|li|table|ul|ol|article|section|div|body|html|main|header|aside)\b)|\z)"
    found = pages.select("page_id", bare.alias("html")).select("page_id", F.posexplode(F.arrays_zip(F.regexp_extract_all("html", F.lit(cut), F.lit(1)).alias("tag"), F.regexp_extract_all("html", F.lit(cut), F.lit(2)).alias("body"))).alias("order", "e"))
    text = F.trim(F.regexp_replace(F.regexp_replace("e.body", r"(?s)<[^>]*>", " "), r"\s+", " "))
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(c))
    tag = F.lower("e.tag")
    kind = F.when(F.startswith(tag, F.lit("h")), "heading").when(tag == "li", "list").when(tag == "table", "table").otherwise("paragraph")
    return found.select(F.col("page_id").alias("document_id"), "order", kind.alias("type"), F.trim(text).alias("text")).where("text <> ''")


def cells(df: DataFrame, table_id, columns: list[str], row, page=1) -> DataFrame:
    """(table_id, page, row, col, text) of a tabular frame: row 0 holds the column names, null cells are left out."""
    ids = df.select(table_id.alias("table_id")).distinct()
    head = ids.select("table_id", F.lit(page).alias("page"), F.lit(0).alias("row"), F.posexplode(F.array(*map(F.lit, columns))).alias("col", "text"))
    body = df.select(table_id.alias("table_id"), F.lit(page).alias("page"), row.cast("int").alias("row"), F.posexplode(F.array(*(F.col(c).cast("string") for c in columns))).alias("col", "text"))
    return head.unionByName(body.where("text is not null"))
