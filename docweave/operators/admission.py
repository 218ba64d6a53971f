"""Admission of files, exact duplicates, classification by name, and record keeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import lookup

# Fixed values.
DENIED = ["exe", "bat", "sh", "cmd", "msi", "dll", "js", "vbs", "ps1"]
ALLOWED = ["pdf", "docx", "xlsx", "pptx", "csv", "html", "txt", "md", "png", "jpg", "jpeg", "tiff", "bmp", "eml"]
MAX_BYTES = 50 * 1024 * 1024
PARSERS = {"pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "pptx": "pptx", "html": "html", "htm": "html", "txt": "text", "md": "text", "png": "image", "jpg": "image", "jpeg": "image", "tiff": "image", "bmp": "image"}
MIME = {"bmp": "image/bmp", "csv": "text/csv", "eml": "message/rfc822", "html": "text/html", "jpeg": "image/jpeg", "jpg": "image/jpeg", "md": "text/markdown", "pdf": "application/pdf", "png": "image/png", "tiff": "image/tiff", "txt": "text/plain"}
# File-name patterns in the order in which they are tried, and hints by MIME type.
NAME_PATTERNS = [
    ("invoice", r"invoice|inv[-_]?\d+"), ("receipt", r"receipt|rcpt"), ("purchase_order", r"purchase[-_]?order|\bpo[-_]?\d+"), ("bank_statement", r"bank[-_]?statement|statement"),
    ("tax_document", r"tax|w-?2|1099"), ("contract", r"contract|agreement|nda"), ("policy", r"policy|policies"), ("manual", r"manual|guide|handbook"), ("audit_report", r"audit"), ("hr_document", r"hr[-_]|employee|payroll"),
]
MIME_HINTS = {"message/rfc822": "email", "text/html": "html", "application/vnd.ms-excel": "spreadsheet", "application/vnd.ms-powerpoint": "presentation"}
DOCUMENT_TYPES = ["invoice", "receipt", "purchase_order", "bank_statement", "financial_statement", "tax_document", "contract", "policy", "manual", "audit_report", "hr_document", "email", "html", "spreadsheet", "presentation", "unknown"]
GENERIC = ["html", "spreadsheet", "presentation", "unknown"]


def base_name(c: str) -> Column:
    return F.replace(F.substring_index(c, "/", -1), F.lit("\x00"), F.lit(""))


def extension(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def admit(files: DataFrame) -> DataFrame:
    """Adds safe_name, extension, mime_type, parser and reject_reason (null where the file is accepted)."""
    out = files.withColumn("safe_name", base_name("file_name"))
    bad = F.col("safe_name").isin("", ".", "..")
    out = out.withColumn("extension", extension(F.col("safe_name")))
    ext = F.col("extension")
    reason = F.when(bad, "invalid file name").when(ext.isin(DENIED), "denied type").when(~ext.isin(ALLOWED), "unsupported type").when(F.col("size") == 0, "empty file").when(F.col("size") > MAX_BYTES, "too large")
    return out.withColumn("reject_reason", reason).withColumn("mime_type", lookup(MIME, ext, "application/octet-stream")).withColumn("parser", lookup(PARSERS, ext))


def content_hash(c: str) -> Column:
    return F.sha2(F.col(c).cast("binary"), 256)


def exact_duplicates(files: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, hash, duplicate_of): later copies of a content point at its first file."""
    first = files.groupBy("hash").agg(F.min(key).alias("first"))
    return files.join(first, "hash").select(key, "hash", F.when(F.col("first") != F.col(key), F.col("first")).alias("duplicate_of"))


def batch_summary(files: DataFrame) -> DataFrame:
    return files.groupBy(F.when(F.col("reject_reason").isNull(), "accepted").otherwise("failed").alias("status")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def classify(name: str, mime: str) -> tuple[Column, Column]:
    """(document_type, confidence) from the file name, else the MIME type."""
    low, kind = F.lower(name), None
    for label, pattern in NAME_PATTERNS:
        kind = F.when(low.rlike(pattern), label) if kind is None else kind.when(low.rlike(pattern), label)
    by_mime = lookup(MIME_HINTS, F.col(mime))
    return F.coalesce(kind, by_mime, F.lit("unknown")), F.when(kind.isNotNull(), 0.75).when(by_mime.isNotNull(), 0.65).otherwise(0.3)


def hybrid(rule: tuple[Column, Column], other: tuple[Column, Column], least: float = 0.6) -> tuple[Column, Column]:
    """The rule's result if it is sure enough, else the other's if that is surer."""
    use = (rule[1] < least) & (F.coalesce(other[1], F.lit(0.0)) > rule[1])
    return F.when(use, other[0]).otherwise(rule[0]), F.when(use, other[1]).otherwise(rule[1])


def model_reply(c: str) -> tuple[Column, Column]:
    """(document_type, confidence) of a scorer's JSON reply, with unknown types and bad confidences put right."""
    j = F.from_json(c, "document_type string, confidence string")
    kind, sure = j["document_type"], j["confidence"].try_cast("double")
    broken = F.coalesce(kind, j["confidence"]).isNull()
    return F.when(~broken & kind.isin(DOCUMENT_TYPES), kind).otherwise("unknown"), F.when(broken, 0.0).otherwise(F.least(F.greatest(F.coalesce(sure, F.lit(0.5)), F.lit(0.0)), F.lit(1.0)))


def status_and_pipeline(kind: str, sure: str, least: float = 0.6) -> tuple[Column, Column]:
    """(status, pipeline) of a classification."""
    k = F.col(kind)
    pipeline = F.when(k.isin([x for x in DOCUMENT_TYPES if x not in GENERIC]), F.concat(k, F.lit("_pipeline"))).otherwise("generic_pipeline")
    return F.when(F.col(sure) >= least, "classified").otherwise("needs_review"), pipeline


def preview(text: str, words: int = 50) -> Column:
    """The first words of a text, one blank between them; blanks and line ends before, behind and between words are no words."""
    found = F.regexp_extract_all(F.regexp_replace(text, "\r\n?", "\n"), F.lit(r"[^ \n\t]+"), F.lit(0))
    return F.array_join(F.slice(found, 1, words), " ")


def sampled_pages(pages: DataFrame, first: int = 15, spread: int = 7) -> DataFrame:
    """The first pages of each document and some evenly spaced ones of the rest."""
    own = Window.partitionBy("document_id")
    p = pages.withColumn("i", F.row_number().over(own.orderBy("page"))).withColumn("n", F.count("*").over(own))
    rest = F.greatest(F.col("n") - first, F.lit(1))
    step = F.greatest(F.floor(rest / spread), F.lit(1))
    kept = (F.col("i") <= first) | (((F.col("i") - first - 1) % step == 0) & (F.floor((F.col("i") - first - 1) / step) < spread))
    return p.where(kept).drop("i", "n")


def sampled_preview(blocks: DataFrame, first: int = 15, spread: int = 7, chars: int = 2000, words: int = 50) -> DataFrame:
    """(document_id, preview): the first words of a document's sampled pages, of each page its first ``chars`` characters.

    ``blocks``: (document_id, page, order, text).
    """
    pages = sampled_pages(blocks.select("document_id", "page").distinct(), first, spread)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("order", "text"))), lambda b: b["text"]), "\n")
    texts = blocks.join(pages, ["document_id", "page"], "left_semi").groupBy("document_id", "page").agg(F.substring(joined, 1, chars).alias("text"))
    whole = texts.groupBy("document_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n").alias("text"))
    return whole.select("document_id", preview("text", words).alias("preview"))


def override(automatic: DataFrame, manual: DataFrame) -> DataFrame:
    """Manual classifications of known types take the place of automatic ones."""
    own = manual.where(F.col("document_type").isin(DOCUMENT_TYPES)).select("document_id", "document_type", F.lit(1.0).alias("confidence"), F.lit("manual").alias("method"))
    return automatic.join(own, "document_id", "left_anti").unionByName(own)


def latest(records: DataFrame, key: str, at: str) -> DataFrame:
    """The newest record of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), *(F.desc(c) for c in records.columns if c not in (key, at))))
    return records.withColumn("rank_of_record", rank).where("rank_of_record = 1").drop("rank_of_record")


def history(records: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    """All records of each key, newest first, as a list."""
    return records.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(at, *columns)), asc=False).alias("records"))


def replace_documents(old: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """All rows of the documents in ``new`` are replaced."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_documents(frame: DataFrame, deleted: DataFrame, key: str = "document_id") -> DataFrame:
    return frame.join(deleted.select(key).distinct(), key, "left_anti")


def orphans(child: DataFrame, parent: DataFrame, key: str = "document_id") -> DataFrame:
    return child.join(parent.select(key).distinct(), key, "left_anti")


def owned(docs: DataFrame, owner, skip: int = 0, limit: int = 50) -> DataFrame:
    """A page of an owner's documents, newest first."""
    return docs.where(F.col("owner") == owner).orderBy(F.desc("created_at"), "document_id").offset(skip).limit(limit)


def run_log(rows: DataFrame, stage: str, errors: DataFrame | None = None) -> DataFrame:
    """(document_id, stage, total, invalid, status) of a stage's rows with a ``status`` column.

    ``errors`` (document_id): documents for which the stage raised an error; they have failed, whatever rows they left.
    """
    out = rows.groupBy("document_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") != "valid").alias("invalid"))
    status = F.when(F.col("invalid") > 0, "needs_review").otherwise("completed")
    if errors is not None:
        out = out.join(errors.select("document_id", F.lit(True).alias("bad")).distinct(), "document_id", "full").fillna(0, ["total", "invalid"])
        status = F.when(F.col("bad"), "failed").otherwise(status)
    return out.select("document_id", F.lit(stage).alias("stage"), "total", "invalid", status.alias("status"))


def activity(*stages: DataFrame) -> DataFrame:
    """One event per stage run."""
    out = stages[0]
    for s in stages[1:]:
        out = out.unionByName(s)
    return out.select("document_id", F.concat(F.lit("document_"), "stage").alias("event_type"), "status")
