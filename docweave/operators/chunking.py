"""Canonical blocks: reading order, tables, heading edges, integrity; and chunks by document type."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import tokens

# Fixed values.
MAX_TOKENS, MAX_ROWS, LARGEST_CHUNK, SHORTEST_CHUNK = 500, 25, 2000, 10
SECTION_WORDS = {"header": ["invoice", "vendor", "from"], "customer": ["bill to", "customer", "client"], "payment": ["payment", "due date", "terms"], "totals": ["total", "subtotal", "tax"]}
NARRATIVE = ["management's discussion", "md&a", "notes to financial statements", "report of independent", "auditor's report", "risk factors", "critical accounting", "liquidity and capital resources"]
FAMILIES = {"invoice": "sections", "receipt": "sections", "purchase_order": "sections", "contract": "clauses", "policy": "headings", "manual": "headings", "financial_statement": "narrative", "bank_statement": "narrative", "tax_document": "narrative", "audit_report": "narrative"}


def reading_order(blocks: DataFrame) -> DataFrame:
    """(document_id, page, block_ids): the blocks of each page in order."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("order", "block_id"))), lambda b: b["block_id"])
    return blocks.groupBy("document_id", "page").agg(ids.alias("block_ids"))


def canonical(blocks: DataFrame) -> DataFrame:
    """(document_id, document): the nested document of its blocks, with schema version and raw text."""
    ordered = F.sort_array(F.collect_list(F.struct("page", "order", "block_id", "type", "text")))
    out = blocks.groupBy("document_id").agg(ordered.alias("blocks"))
    return out.select("document_id", F.struct(F.lit("1.0").alias("schema_version"), "blocks", F.array_join(F.transform("blocks", lambda b: b["text"]), "\n").alias("raw_text")).alias("document"))


def nested(blocks: DataFrame, pages: DataFrame, cells: DataFrame, images: DataFrame) -> DataFrame:
    """(document_id, document): pages with their reading order, blocks, tables with cells, images, and heading edges, each list in order.

    ``pages`` (document_id, page), ``cells`` (document_id, table_id, page, row, col, text), ``images`` (document_id, image_id, page, caption). All
    parts come together in one shuffle by document; documents without a part have an empty list of it.
    """
    read = pages.select("document_id", "page").distinct().join(reading_order(blocks), ["document_id", "page"], "left")
    none = F.array().cast("array<string>")
    held = cells.groupBy("document_id", "table_id", "page").agg(F.sort_array(F.collect_list(F.struct("row", "col", "text"))).alias("cells"), (F.max("row") + 1).alias("row_count"), (F.max("col") + 1).alias("col_count"))
    parts = {
        "pages": read.select("document_id", F.struct("page", F.coalesce("block_ids", none).alias("reading_order")).alias("pages")),
        "blocks": blocks.select("document_id", F.struct("page", "order", "block_id", "type", "text").alias("blocks")),
        "tables": held.select("document_id", F.struct("page", "table_id", "row_count", "col_count", "cells").alias("tables")),
        "images": images.select("document_id", F.struct("page", "image_id", "caption").alias("images")),
        "relationships": heading_edges(blocks).select("document_id", F.struct("source", "target", F.lit("heading_paragraph").alias("type")).alias("relationships")),
    }
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts.values())
    g = every.groupBy("document_id").agg(*(F.sort_array(F.collect_list(c)).alias(c) for c in parts))
    return g.select("document_id", F.struct(F.lit("1.0").alias("schema_version"), *parts, F.array_join(F.transform("blocks", lambda b: b["text"]), "\n").alias("raw_text")).alias("document"))


def table_sizes(cells: DataFrame) -> DataFrame:
    return cells.groupBy("table_id").agg((F.max("row") + 1).alias("row_count"), (F.max("col") + 1).alias("col_count"))


def heading_edges(blocks: DataFrame) -> DataFrame:
    """(document_id, source, target): the nearest heading before each paragraph."""
    w = Window.partitionBy("document_id").orderBy("page", "order")
    head = F.last(F.when(F.col("type") == "heading", F.col("block_id")), ignorenulls=True).over(w)
    return blocks.withColumn("source", head).where((F.col("type") == "paragraph") & F.col("source").isNotNull()).select("document_id", "source", F.col("block_id").alias("target"))


def integrity_issues(blocks: DataFrame, pages: DataFrame, cells: DataFrame, sizes: DataFrame, edges: DataFrame, docs: DataFrame, version: str = "1.0", tables: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """(document_id, issue, item): everything that does not fit together.

    ``tables`` (document_id, table_id, page) and ``images`` (document_id, image_id, page) must lie on known pages; an edge may come from a table.
    """
    on = ["document_id", "page"]
    lost = blocks.join(pages.select(*on).distinct(), on, "left_anti").select("document_id", F.lit("block on missing page").alias("issue"), F.col("block_id").alias("item"))
    box = blocks.where(F.col("box_page") != F.col("page")).select("document_id", F.lit("box on another page").alias("issue"), F.col("block_id").alias("item"))
    n = cells.groupBy("document_id", "table_id").agg(F.count("*").alias("n"))
    many = n.join(sizes, "table_id").where(F.col("n") > F.col("row_count") * F.col("col_count")).select("document_id", F.lit("too many cells").alias("issue"), F.col("table_id").cast("string").alias("item"))
    ids = blocks.select("document_id", F.col("block_id").cast("string").alias("source"))
    ids = (ids if tables is None else ids.unionByName(tables.select("document_id", F.col("table_id").cast("string").alias("source")))).distinct()
    loose = edges.join(ids, ["document_id", "source"], "left_anti").select("document_id", F.lit("unknown edge source").alias("issue"), F.col("source").alias("item"))
    old = docs.where(F.col("schema_version") != version).select("document_id", F.lit("schema version").alias("issue"), F.col("schema_version").alias("item"))
    found = [lost, box, many, loose, old]
    for kind, d in (("table", tables), ("image", images)):
        if d is not None:
            away = d.join(pages.select(*on).distinct(), on, "left_anti")
            found.append(away.select("document_id", F.lit(f"{kind} on missing page").alias("issue"), F.col(f"{kind}_id").cast("string").alias("item")))
    return reduce(DataFrame.unionByName, found)


def repeated_block_ids(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("document_id", "block_id").agg(F.count("*").alias("n")).where("n > 1")


def document_status(docs: DataFrame, issues: DataFrame) -> DataFrame:
    n = issues.groupBy("document_id").agg(F.count("*").alias("issues"))
    out = docs.select("document_id").distinct().join(n, "document_id", "left").withColumn("issues", F.coalesce("issues", F.lit(0)))
    return out.withColumn("status", F.when(F.col("issues") > 0, "needs_review").otherwise("canonicalized"))


def packable(rows: DataFrame, keys: list[str], order: list[str], n_tokens: Column, budget: int) -> DataFrame:
    """Adds ``at`` (a row's place in its key), ``sum`` (tokens up to the row) and ``upto``: the last row that, counted from behind this one, fits the budget.

    One range window over the running sum finds all of them; see ``starts``.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    out = rows.withColumn("at", F.row_number().over(w) - 1).withColumn("sum", F.sum(n_tokens).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("upto", F.max("at").over(Window.partitionBy(*keys).orderBy("sum").rangeBetween(0, budget)))


def starts(parts: Column, budget: int, overlap: int = 0) -> Column:
    """The places at which greedy chunks of the ordered parts (at, sum, upto) begin; each repeats ``overlap`` parts before its own.

    A chunk from s on reaches as far as the budget lets it, counted from behind part s - overlap - 1, and holds part s at
    least. The fold jumps from start to start, so it is linear in the parts.
    """
    reach = F.size(F.filter(parts, lambda x: x["sum"] <= budget)) - 1
    none = F.from_json(F.lit('{"next":0,"starts":[]}'), "struct<next:int,starts:array<int>>")

    def step(state, x):
        far = F.when(x["at"] <= overlap, reach).otherwise(F.get(parts, x["at"] - overlap - 1)["upto"])
        begun = F.struct((F.greatest(x["at"], far) + 1).alias("next"), F.concat(state["starts"], F.array(x["at"])).alias("starts"))
        return F.when(x["at"] == state["next"], begun).otherwise(state)

    return F.aggregate(parts, none, step, lambda state: state["starts"])


def _packed(parts: Column, begin: Column) -> Column:
    """The chunks (texts, pages, ids) of the ordered blocks of one section, by their ``starts``; the last text of a chunk opens the next one as well."""

    def chunk(s, k):
        own = F.slice(parts, s + 1, F.coalesce(F.get(begin, k + 1), F.size(parts)) - s)
        before = F.slice(parts, F.greatest(s, F.lit(1)), F.when(s > 0, 1).otherwise(0))
        return F.struct(F.transform(F.concat(before, own), lambda x: x["text"]).alias("texts"), F.transform(own, lambda x: x["page"]).alias("pages"), F.transform(own, lambda x: x["block_id"]).alias("ids"))

    return F.transform(begin, chunk)


def _sections(blocks: DataFrame, breaks: Column) -> DataFrame:
    w = Window.partitionBy("document_id").orderBy("page", "order")
    return blocks.withColumn("section", F.sum(breaks.cast("int")).over(w)).withColumn("breaks", breaks)


def windowed(blocks: DataFrame, budget: int = MAX_TOKENS, narrative: bool = False) -> DataFrame:
    """Generic chunks, or the narrative ones of financial statements: greedy packing inside sections."""
    low = F.lower("text")
    breaks = F.col("type") == "heading"
    if narrative:
        for w in NARRATIVE:
            breaks = breaks | F.contains(low, F.lit(w))
    s = _sections(blocks, breaks)
    s = packable(s, ["document_id", "section"], ["page", "order", "block_id"], tokens("text"), budget)
    parts = F.sort_array(F.collect_list(F.struct("at", "page", "order", "block_id", "text", "sum", "upto")))
    g = s.groupBy("document_id", "section").agg(parts.alias("parts"), F.max(F.when(F.col("breaks"), F.col("text"))).alias("section_name"))
    g = g.withColumn("begin", starts(F.col("parts"), budget, 1))  # a column of its own, for each chunk looks into it
    out = g.select("document_id", "section", "section_name", F.posexplode(_packed(F.col("parts"), F.col("begin"))).alias("part", "c"))
    kind = "narrative" if narrative else "generic"
    return out.select("document_id", "section", "part", F.lit(kind).alias("chunk_type"), "section_name", F.array_join("c.texts", "\n").alias("content"), F.array_sort(F.array_distinct("c.pages")).alias("pages"), F.col("c.ids").alias("block_ids"))


def clauses(blocks: DataFrame, first: str | None = "Preamble", kind: str = "clause") -> DataFrame:
    """One chunk for each heading with all that follows it; text before the first heading is ``first``."""
    s = _sections(blocks, F.col("type") == "heading")
    parts = F.sort_array(F.collect_list(F.struct("page", "order", "block_id", "text")))
    g = s.groupBy("document_id", "section").agg(parts.alias("parts"), F.max(F.when(F.col("breaks"), F.col("text"))).alias("head"))
    return g.select("document_id", "section", F.lit(0).alias("part"), F.lit(kind).alias("chunk_type"), F.coalesce("head", F.lit(first)).alias("section_name"), *_joined())


def _joined() -> list[Column]:
    return [
        F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("content"), F.array_sort(F.array_distinct(F.transform("parts", lambda p: p["page"]))).alias("pages"),
        F.transform("parts", lambda p: p["block_id"]).alias("block_ids"),
    ]


def keyword_sections(blocks: DataFrame) -> DataFrame:
    """Blocks of invoices and their like by the first word class they hold, one chunk for each class."""
    low, kind, place = F.lower("text"), None, F.lit(len(SECTION_WORDS))
    for i, (name, words) in enumerate(SECTION_WORDS.items()):
        met = F.lit(False)
        for w in words:
            met = met | F.contains(low, F.lit(w))
        kind = F.when(met, name) if kind is None else kind.when(met, name)
    kind = kind.otherwise("other")
    for i, name in enumerate(SECTION_WORDS):
        place = F.when(F.col("chunk_type") == name, i).otherwise(place)
    g = blocks.withColumn("chunk_type", kind).groupBy("document_id", "chunk_type").agg(F.sort_array(F.collect_list(F.struct("page", "order", "block_id", "text"))).alias("parts"))
    return g.select("document_id", place.cast("long").alias("section"), F.lit(0).alias("part"), "chunk_type", F.initcap("chunk_type").alias("section_name"), *_joined())


def table_chunks(cells: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Up to ``max_rows`` data rows with the header repeated; cells under a header column joined by bars."""
    head = cells.where("row = 0").groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("col", "text"))).alias("head"))
    body = cells.where("row > 0").groupBy("table_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("cells"))
    number = F.row_number().over(Window.partitionBy("table_id").orderBy("row"))
    line = F.array_join(F.transform("head", lambda h: F.coalesce(F.try_element_at("cells", h["col"]), F.lit(""))), " | ")
    rows = body.withColumn("batch", F.floor((number - 1) / max_rows)).join(head, "table_id").withColumn("line", line)
    g = rows.groupBy("table_id", "batch").agg(F.sort_array(F.collect_list(F.struct("row", "line"))).alias("rows"), F.max("head").alias("head"))
    top = F.array_join(F.transform("head", lambda h: h["text"]), " | ")
    return g.select("table_id", "batch", F.concat_ws("\n", top, F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("content"), F.element_at("rows", 1)["row"].alias("first_row"), F.element_at("rows", -1)["row"].alias("last_row"))


def by_family(blocks: DataFrame, types: DataFrame, own: dict[str, Callable[[DataFrame], DataFrame]] | None = None, cells: DataFrame | None = None) -> DataFrame:
    """Chunks of all documents, each by the family of its type (document_id, document_type).

    ``own``: further chunkers by document type, functions of blocks that give the columns of ``windowed``. ``cells`` (document_id, table_id, page, row, col,
    text): tables, whose chunks follow the sections of invoices, receipts and purchase orders.
    """
    families = FAMILIES | {t: t for t in own or ()}
    family = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in families.items() for x in p)), F.col("document_type")), F.lit("generic"))
    b = blocks.join(types.select("document_id", family.alias("family")), "document_id")
    of = lambda name: b.where(F.col("family") == name).drop("family")
    parts = [keyword_sections(of("sections")), clauses(of("clauses")), clauses(of("headings"), None, "section"), windowed(of("narrative"), narrative=True), windowed(of("generic"))]
    if cells is not None:
        sectioned = types.where(family == "sections").select("document_id")
        parts.append(table_parts(cells.join(sectioned, "document_id", "left_semi")))
    return reduce(DataFrame.unionByName, [*parts, *(f(of(t)) for t, f in (own or {}).items())])


def table_parts(cells: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``table_chunks`` of documents' tables with the columns of ``windowed``: section and part follow the document's own sections."""
    where = cells.groupBy("table_id").agg(F.min("document_id").alias("document_id"), F.min("page").cast("int").alias("page"))
    made = table_chunks(cells, max_rows).join(where, "table_id")
    place = F.dense_rank().over(Window.partitionBy("document_id").orderBy("page", "table_id"))
    return made.select("document_id", (place + len(SECTION_WORDS)).cast("long").alias("section"), F.col("batch").cast("int").alias("part"), F.lit("table").alias("chunk_type"), F.concat(F.lit("Table "), F.col("table_id").cast("string")).alias("section_name"), "content", F.array("page").alias("pages"), F.array().cast("array<string>").alias("block_ids"))


def validate(chunks: DataFrame) -> DataFrame:
    """Adds status and issue."""
    n, t = F.length("content"), tokens("content")
    issue = F.when(F.trim("content") == "", "empty chunk").when(n < SHORTEST_CHUNK, "too short").when(t > LARGEST_CHUNK, "too long")
    return chunks.withColumn("issue", issue).withColumn("status", F.when(F.col("issue") == "too long", "needs_review").when(F.col("issue").isNotNull(), "invalid").otherwise("valid"))


def without_repeats(chunks: DataFrame, *order: str) -> DataFrame:
    """The first chunk of each content in a document, numbered and linked to its neighbours."""
    order = order or ("section", "part")
    same = Window.partitionBy("document_id", F.sha2(F.trim("content"), 256)).orderBy(*order)
    kept = chunks.withColumn("copy", F.row_number().over(same)).where("copy = 1").drop("copy")
    w = Window.partitionBy("document_id").orderBy(*order)
    out = kept.withColumn("chunk_index", F.row_number().over(w) - 1)
    chunk = lambda i: F.concat_ws("_c", F.col("document_id").cast("string"), i.cast("string"))
    i, last = F.col("chunk_index"), F.count("*").over(Window.partitionBy("document_id"))
    out = out.withColumn("chunk_id", chunk(i)).withColumn("previous_id", F.when(i > 0, chunk(i - 1))).withColumn("next_id", F.when(i < last - 1, chunk(i + 1)))
    return out.withColumn("n_tokens", tokens("content")).withColumn("n_chars", F.length("content"))


def roll_up(chunks: DataFrame) -> DataFrame:
    out = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum("n_tokens").alias("tokens"), F.count_if(F.col("status") != "valid").alias("invalid"))
    return out.withColumn("run_status", F.when(F.col("invalid") > 0, "needs_review").otherwise("chunked"))
