"""Redaction, error groups, cost, alerts, counters, histograms, and the views of dashboards and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
SENSITIVE = ["password", "hashed_password", "token", "access_token", "refresh_token", "api_key", "secret", "authorization", "ssn", "credit_card"]
CATEGORIES = {"AuthenticationError": "authentication", "AuthorizationError": "authorization", "ValidationFailed": "validation", "DocumentNotFound": "validation", "OCRFailed": "ocr", "StorageError": "storage", "RuleEngineError": "internal"}


def redacted_text(c: str) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"Bearer\s+[\w\-.]+", "Bearer ***REDACTED***"), r"\b\d{3}-\d{2}-\d{4}\b", "***SSN-REDACTED***")


def redacted_map(c: str, longest: int = 2000, keep: int = 200) -> Column:
    """A map (nested keys joined by dots) with sensitive values masked and long ones cut."""
    hidden = lambda k: F.exists(F.array(*map(F.lit, SENSITIVE)), lambda s: F.contains(F.lower(k), s))
    cut = lambda v: F.when(F.length(v) > longest, F.concat(F.substring(v, 1, keep), F.lit("...[truncated, full document content not logged]"))).otherwise(v)
    return F.transform_values(c, lambda k, v: F.when(hidden(k), "***REDACTED***").otherwise(cut(v)))


def redacted_variant(v: Column, depth: int = 4, into_lists: bool = False, longest: int = 2000, keep: int = 200) -> Column:
    """A VARIANT value with sensitive keys masked and long texts cut, in objects within objects down to ``depth``.

    Lists stay as they are unless ``into_lists``. What lies deeper than ``depth`` is masked as a whole, so nothing passes unread.
    """
    kind, mark = F.schema_of_variant(v), F.parse_json(F.lit('"***REDACTED***"'))
    is_object, is_list = F.startswith(kind, F.lit("OBJECT")), F.startswith(kind, F.lit("ARRAY")) & F.lit(into_lists)
    if depth == 0:
        return F.when(is_object | is_list, mark).otherwise(v)
    text = F.try_variant_get(v, "$", "string")
    cut = F.concat(F.substring(text, 1, keep), F.lit("...[truncated, full document content not logged]")).cast("variant")
    hidden = lambda k: F.exists(F.array(*map(F.lit, SENSITIVE)), lambda s: F.contains(F.lower(k), s))
    inner = lambda x: redacted_variant(x, depth - 1, into_lists, longest, keep)
    fields = F.transform_values(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, x: F.when(hidden(k), mark).otherwise(inner(x)))
    out = F.when(is_object, F.to_variant_object(fields))
    if into_lists:
        out = out.when(is_list, F.transform(F.try_variant_get(v, "$", "array<variant>"), inner).cast("variant"))
    return out.when((kind == "STRING") & (F.length(text) > longest), cut).otherwise(v)


def fingerprint(kind: str, message: str) -> Column:
    first = F.substring(F.substring_index(message, "\n", 1), 1, 100)
    return F.substring(F.sha2(F.concat_ws(":", kind, first).cast("binary"), 256), 1, 16)


def category(kind: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in CATEGORIES.items() for x in p)), F.col(kind)), F.lit("internal"))


def error_groups(errors: DataFrame) -> DataFrame:
    """(fingerprint, kind, category, times, last_message, first_user): repeated errors as one row."""
    e = errors.withColumn("message", redacted_text("message")).withColumn("fingerprint", fingerprint("kind", "message"))
    at = F.struct("at", "id")
    g = e.groupBy("fingerprint").agg(F.max("kind").alias("kind"), F.count("*").alias("times"), F.max_by("message", at).alias("last_message"), F.min_by("user_id", at).alias("first_user"))
    return g.withColumn("category", category("kind"))


def top_errors(groups: DataFrame, n: int = 10) -> DataFrame:
    return groups.orderBy(F.desc("times"), "fingerprint").limit(n)


def by_category(groups: DataFrame) -> DataFrame:
    return groups.groupBy("category").agg(F.sum("times").alias("times"))


def cost(tokens_in: str, tokens_out: str, price_in: float, price_out: float) -> Column:
    return F.col(tokens_in) / 1000 * price_in + F.col(tokens_out) / 1000 * price_out


def cost_by_model(usage: DataFrame, as_of: str, hours: int) -> DataFrame:
    recent = usage.where(F.col("at") >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {hours} hours"))
    return recent.groupBy("model").agg(F.round(F.sum("cost"), 6).alias("cost"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.count("*").alias("requests"))


def cost_by_user(usage: DataFrame, n: int = 10) -> DataFrame:
    return usage.where("user_id is not null").groupBy("user_id").agg(F.round(F.sum("cost"), 6).alias("cost")).orderBy(F.desc("cost"), "user_id").limit(n)


def alerts(rules: DataFrame, metrics: DataFrame) -> DataFrame:
    """(name, metric, value, severity) of active rules whose condition (gt, lt, eq) holds, and further columns of the metrics."""
    v, t, c = F.col("value"), F.col("threshold"), F.col("condition")
    met = F.when(c == "gt", v > t).when(c == "lt", v < t).when(c == "eq", v == t).otherwise(False)
    return rules.where("active").join(metrics, "metric").where(met).select("name", "metric", "value", "severity", *(c for c in metrics.columns if c not in ("metric", "value")))


def alert_states(log: DataFrame) -> DataFrame:
    """The last state of each alert that is still firing."""
    return log.groupBy("name").agg(F.max_by("state", "at").alias("state"), F.max("at").alias("at")).where("state = 'firing'")


def counters(events: DataFrame, *labels: str) -> DataFrame:
    return events.groupBy(*labels).agg(F.count("*").alias("n"))


def histogram(events: DataFrame, label: str, value: str, bounds: list[float]) -> DataFrame:
    """(label, le, n): cumulative buckets, the last without a bound; one pass, no row is multiplied."""
    g = events.groupBy(label).agg(F.array(*(F.struct(F.lit(str(b)).alias("le"), F.count_if(F.col(value) <= b).alias("n")) for b in bounds), F.struct(F.lit("+Inf").alias("le"), F.count("*").alias("n"))).alias("buckets"))
    return g.select(label, F.explode("buckets").alias("b")).select(label, "b.*")


def cards(**frames: Column | tuple) -> DataFrame:
    """(card, value): one aggregate of each given (frame, column)."""
    out = None
    for name, (frame, c) in frames.items():
        one = frame.agg(c.cast("double").alias("value")).select(F.lit(name).alias("card"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def activity_feed(events: DataFrame, users: DataFrame, n: int = 20) -> DataFrame:
    return events.join(users, "user_id", "left").orderBy(F.desc("at"), "id").limit(n)


def daily(events: DataFrame, as_of: str, days: int) -> DataFrame:
    """(day, n) of the last days, with 0 for days without an event."""
    end = F.lit(as_of).cast("date")
    all_days = events.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    n = events.groupBy(F.to_date("at").alias("day")).agg(F.count("*").alias("n"))
    return all_days.join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def distribution(docs: DataFrame, kind: str = "document_type") -> DataFrame:
    return docs.where(F.col(kind).isNotNull()).groupBy(kind).agg(F.count("*").alias("n")).orderBy(F.desc("n"), kind)


def bundle(docs: DataFrame, **parts: DataFrame) -> DataFrame:
    """Each document with the number of its rows in every part, and the parts as lists of structs."""
    out = docs
    for name, d in parts.items():
        cols = [c for c in d.columns if c != "document_id"]
        out = out.join(d.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name)), "document_id", "left")
    return out


def boxed_blocks(blocks: DataFrame, page: int | None = None) -> DataFrame:
    out = blocks.where("box is not null")
    out = out if page is None else out.where(F.col("page") == page)
    return out.withColumn("text", F.substring("text", 1, 200))


def resolved_citations(cited: DataFrame, chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """(document_id, chunk_id, page, section_name, block_id, content): a chunk of another document does not resolve."""
    c = chunks.select("document_id", "chunk_id", "section_name", "content", F.get("block_ids", F.lit(0)).alias("block_id"))
    return cited.join(c, ["document_id", "chunk_id"]).join(blocks.select("document_id", "block_id", "page"), ["document_id", "block_id"], "left")


def found_in_blocks(blocks: DataFrame, word: str) -> DataFrame:
    """(document_id, block_id, start, end): the first place of a word in each block, case ignored."""
    at = F.instr(F.lower("text"), word.lower())
    return blocks.where(at > 0).select("document_id", "block_id", (at - 1).alias("start"), (at - 1 + len(word)).alias("end"))


def permissions(user_roles: DataFrame, role_permissions: DataFrame) -> DataFrame:
    return user_roles.join(role_permissions, "role").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("permission")), ",").alias("permissions"))


def visible(docs: DataFrame, grants: DataFrame, admin: str) -> tuple[DataFrame, DataFrame]:
    """(users who see every document, (user_id, document_id) of owners): no user x document product is made."""
    everyone = grants.where(F.array_contains(F.split("permissions", ","), admin)).select("user_id")
    return everyone, docs.select(F.col("owner").alias("user_id"), "document_id")
