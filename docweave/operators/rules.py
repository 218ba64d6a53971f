"""Audit rules, risk scores and review routes over business documents.

A rule is a trigger, a severity and the document types it applies to, all as columns; every applicable rule gives one
finding per document. All rules of a frame are evaluated in one projection and then exploded to long form.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
WEIGHTS = {"low": 5, "medium": 15, "high": 35, "critical": 60}
OTHER_WEIGHT = 10
LEVELS = {"medium": 25, "high": 60, "critical": 85}
ROUTES = {"low": "auto_approve", "medium": "reviewer_queue", "high": "senior_auditor", "critical": "immediate_escalation"}
# The currency codes of ISO 4217.
CURRENCIES = (
    "AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BOV BRL BSD BTN BWP BYN BZD CAD CDF CHE CHF CHW CLF CLP CNY COP COU CRC CUC CUP CVE CZK DJF DKK DOP DZD "
    "EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD HNL HRK HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD "
    "MAD MDL MGA MKD MMK MNT MOP MRU MUR MVR MWK MXN MXV MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD SHP SLE SLL SOS SRD SSP STN SVC SYP SZL "
    "THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD USN UYI UYU UYW UZS VED VES VND VUV WST XAF XAG XAU XBA XBB XBC XBD XCD XDR XOF XPD XPF XPT XSU XTS XUA XXX YER ZAR ZMW ZWL"
).split()

DEFAULTS = {"min_ocr_confidence": 0.6, "tolerance_pct": 0.02, "approval_limit": 10000.0, "high_value_threshold": 50000.0, "split_from": 0.8, "split_days": 30, "required_sections": ["purpose", "scope", "policy"]}


@dataclass(frozen=True)
class Rule:
    key: str
    severity: str
    types: tuple[str, ...]
    trigger: Column
    confidence: Column | None = None
    evidence: Column | None = None


def absent(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def with_history(docs: DataFrame, config: dict, days: int | None = None) -> DataFrame:
    """Adds same_number (documents that share the invoice number) and related (near-limit invoices of the vendor around)."""
    same = docs.where("invoice_number is not null").groupBy("invoice_number").agg(F.count("*").alias("same_number"))
    limit = config["approval_limit"]
    near = (F.col("document_type") == "invoice") & (F.col("invoice_total") >= config["split_from"] * limit) & (F.col("invoice_total") < limit) & F.col("vendor").isNotNull()
    around = counts_around(docs.where(near), "vendor", "invoice_date", days or config["split_days"])
    related = around.select("vendor", "invoice_date", (F.col("around") - 1).alias("beside"))
    out = docs.join(same, "invoice_number", "left").join(related, ["vendor", "invoice_date"], "left")
    return out.withColumn("related", F.when(near, F.col("beside"))).drop("beside")


def counts_around(rows: DataFrame, key: str, day: str, span: int) -> DataFrame:
    """(key, day, around): for each day of a key, the rows of the key at most ``span`` days away; days without a date have none.

    Rows are counted by day first, and days meet by cells of ``span`` days: a day looks into its own cell and the two beside it, so a
    task gets a few cells of days, never all rows of a key.
    """
    daily = rows.where(F.col(day).isNotNull()).groupBy(key, day).agg(F.count("*").alias("n"))
    cell = F.floor(F.unix_date(day) / span)
    one = daily.select(key, day, F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    other = daily.select(key, F.col(day).alias("its_day"), "n", cell.alias("cell"))
    close = F.abs(F.unix_date(day) - F.unix_date("its_day")) <= span
    return one.join(other, [key, "cell"]).where(close).groupBy(key, day).agg(F.sum("n").alias("around"))


def rules(as_of: str, config: dict | None = None) -> list[Rule]:
    """The rules over the columns of a wide document frame (see ``with_history``, ``text_signals``, ``item_signals``)."""
    c = DEFAULTS | (config or {})
    total, today = F.col("invoice_total"), F.lit(as_of).cast("date")
    parts = total.isNotNull() & F.col("subtotal").isNotNull() & F.col("tax_amount").isNotNull()
    off = F.abs(F.col("subtotal") + F.col("tax_amount") - total) > c["tolerance_pct"] * F.greatest(total, F.lit(1.0))
    text = F.lower(F.coalesce("text", F.lit("")))
    missing = F.filter(F.array(*map(F.lit, c["required_sections"])), lambda s: ~F.contains(text, s))
    ocr = F.col("ocr_confidence")
    day = F.col("invoice_date")
    return [
        Rule("missing_invoice_number", "high", ("invoice",), absent("invoice_number")),
        Rule("missing_vendor", "medium", ("invoice", "receipt", "purchase_order"), absent("vendor")),
        Rule("empty_document", "critical", (), F.length(F.trim(F.coalesce("text", F.lit("")))) < 20),
        Rule("low_ocr_confidence", "medium", (), ocr < c["min_ocr_confidence"], F.coalesce(ocr, F.lit(1.0))),
        Rule("missing_signature", "high", ("contract",), ~(F.contains(text, F.lit("signature")) | F.contains(text, F.lit("signed")))),
        Rule("invalid_currency", "medium", (), F.col("currency").isNotNull() & ~F.col("currency").isin(CURRENCIES)),
        Rule("future_transaction_date", "high", (), day > today),
        Rule("missing_company", "low", (), absent("vendor") & absent("customer")),
        Rule("total_equals_subtotal_plus_tax", "high", ("invoice", "receipt"), parts & off, F.when(parts, 1.0).otherwise(0.0)),
        Rule("negative_invoice_amount", "critical", ("invoice", "receipt", "purchase_order"), total < 0),
        Rule("invoice_exceeds_approval_threshold", "medium", ("invoice", "purchase_order"), total > c["approval_limit"]),
        Rule("line_item_math_mismatch", "medium", (), F.coalesce("bad_items", F.lit(0)) > 0),
        Rule("missing_due_date", "low", ("invoice",), F.col("due_date").isNull()),
        Rule("invoice_date_after_due_date", "high", ("invoice",), day > F.col("due_date")),
        Rule("duplicate_invoice", "critical", ("invoice",), F.coalesce("same_number", F.lit(0)) > 1),
        Rule("missing_effective_date", "medium", ("contract",), F.col("effective_date").isNull()),
        Rule("expired_contract", "high", ("contract",), F.col("expiration_date") < today),
        Rule("missing_termination_clause", "low", ("contract",), ~F.contains(text, F.lit("terminat"))),
        Rule("required_section_missing", "medium", ("policy",), F.size(missing) > 0),
        Rule("round_number_payment", "low", (), (total > 0) & (total % 100 == 0)),
        Rule("weekend_transaction", "low", (), F.weekday(day) >= 5),
        Rule("high_value_transaction", "medium", (), total > c["high_value_threshold"]),
        Rule("invoice_splitting", "high", ("invoice",), F.coalesce("related", F.lit(0)) >= 2),
    ]


def bad_items(tolerance: float = 0.02) -> Column:
    """An aggregate: how many line items' quantity times price is off the line's total."""
    off = F.abs(F.col("quantity") * F.col("unit_price") - F.col("line_total")) > tolerance * F.greatest("line_total", F.lit(1.0))
    return F.count_if(off).alias("bad_items")


def item_signals(items: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(document_id, bad_items): see ``bad_items``."""
    return items.groupBy("document_id").agg(bad_items(tolerance))


def _guarded(c: Column) -> Column:
    """The column as text, null where its evaluation raises an error: bytes made by a ``try_`` function, which catches it.

    It must stand within a branch of a conditional: an expression that several rules share is otherwise computed once, outside.
    """
    return F.try_to_binary(c.cast("string"), F.lit("utf-8")).cast("string")


def evaluated(docs: DataFrame, chosen: list[Rule], inactive: tuple[str, ...] = (), more: tuple[str, ...] = ()) -> DataFrame:
    """(document_id, rule_key, triggered, severity, confidence, failed): each applicable active rule of each document, with ``more`` columns of it.

    A trigger that cannot be told (null) is not triggered. A rule whose trigger or confidence raises an error for a document has
    failed for it, with no result; the others stay as they are.
    """
    every = F.length(F.coalesce("document_type", F.lit(""))) >= 0  # always, but not folded away

    def one(r: Rule) -> Column:
        sure = _guarded(F.coalesce(r.confidence, F.lit(0.0))) if r.confidence is not None else F.lit("1.0")
        parts = F.struct(F.lit(r.key).alias("rule_key"), _guarded(F.coalesce(r.trigger, F.lit(False))).alias("triggered"), F.lit(r.severity).alias("severity"), sure.alias("confidence"))
        return F.when(F.col("document_type").isin(list(r.types)) if r.types else every, parts)

    made = F.filter(F.array(*(one(r) for r in chosen if r.key not in inactive)), lambda x: x.isNotNull())
    long = docs.select("document_id", *more, F.explode(made).alias("f")).select("document_id", *more, "f.*")
    failed = F.col("triggered").isNull() | F.col("confidence").isNull()
    return long.select("document_id", "rule_key", F.coalesce(F.col("triggered") == "true", F.lit(False)).alias("triggered"), "severity", F.col("confidence").cast("double").alias("confidence"), failed.alias("failed"), *more)


def findings(docs: DataFrame, chosen: list[Rule], inactive: tuple[str, ...] = ()) -> DataFrame:
    """(document_id, rule_key, triggered, severity, confidence): the results of ``evaluated`` rules that did not fail."""
    return evaluated(docs, chosen, inactive).where("not failed").drop("failed")


def failed_rules(found: DataFrame) -> DataFrame:
    """(rule_key, documents): of ``evaluated`` rules, those that failed, and for how many documents."""
    return found.where("failed").groupBy("rule_key").agg(F.count("*").alias("documents"))


def risk_score(found: DataFrame, *more: Column) -> DataFrame:
    """(document_id, executed, triggered, score, level, route) of findings; of ``evaluated`` rules also ``failed``, which count as not executed.

    ``more``: further aggregates of each document's findings.
    """
    weight = F.lit(OTHER_WEIGHT)
    for severity, w in WEIGHTS.items():
        weight = F.when(F.col("severity") == severity, w).otherwise(weight)
    known = "failed" in found.columns
    fine = ~F.col("failed") if known else F.lit(True)
    score = F.round(F.least(F.lit(100.0), F.sum(F.when(fine & F.col("triggered"), weight * F.col("confidence")).otherwise(0.0))), 6)
    out = found.groupBy("document_id").agg(F.count_if(fine).alias("executed"), F.count_if(fine & F.col("triggered")).alias("triggered"), *([F.count_if("failed").alias("failed")] if known else []), score.alias("score"), *more)
    return out.withColumn("level", level("score")).withColumn("route", route("level"))


def level(score: str, thresholds: dict | None = None) -> Column:
    t, s = LEVELS | (thresholds or {}), F.col(score)
    return F.when(s >= t["critical"], "critical").when(s >= t["high"], "high").when(s >= t["medium"], "medium").otherwise("low")


def route(level_column: str) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in ROUTES.items() for x in pair)), F.col(level_column))


def definitions(chosen: list[Rule], spark) -> DataFrame:
    return spark.createDataFrame([(r.key, r.severity, ",".join(r.types), True, 1) for r in chosen], "rule_key string, severity string, types string, active boolean, version int")


def seed(existing: DataFrame, defaults: DataFrame) -> DataFrame:
    """The existing definitions with the missing defaults put in."""
    return existing.unionByName(defaults.join(existing, "rule_key", "left_anti"))


def changed(defs: DataFrame, log: DataFrame) -> DataFrame:
    """Definitions after a change log (rule_key, at, active, config): latest state, version raised by config changes."""
    last = log.groupBy("rule_key").agg(F.max_by("active", F.when(F.col("active").isNotNull(), F.col("at"))).alias("now"), F.count("config").alias("changes"))
    return defs.join(last, "rule_key", "left").select("rule_key", "severity", "types", F.coalesce("now", "active").alias("active"), (F.col("version") + F.coalesce("changes", F.lit(0))).cast("int").alias("version"))


def change_events(defs: DataFrame, log: DataFrame) -> DataFrame:
    """(rule_key, at, action, version): what an audit of rule changes reads, an event for each entry of the change log.

    ``action``: enabled or disabled where the state is set, else updated; ``version`` is that after the entry. Entries of unknown rules are left out.
    """
    w = Window.partitionBy("rule_key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    action = F.when(F.col("now"), "enabled").when(~F.col("now"), "disabled").otherwise("updated")
    entries = log.select("rule_key", "at", F.col("active").alias("now"), F.count("config").over(w).alias("changes"))
    return entries.join(defs.select("rule_key", "version"), "rule_key").select("rule_key", "at", action.alias("action"), (F.col("version") + F.col("changes")).cast("int").alias("version"))


def active_keys(defs: DataFrame, log: DataFrame) -> DataFrame:
    """(rule_key): the rules that the change log leaves active."""
    return changed(defs, log).where("active").select("rule_key")


def contradictions(answers: DataFrame, facts: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(answer_id, fact_type): facts named in an answer that has numbers, none of them near the fact's value."""
    numbers = F.transform(F.regexp_extract_all("text", F.lit(r"\d[\d,]*\.?\d*"), F.lit(0)), lambda x: F.regexp_replace(x, ",", "").try_cast("double"))
    pairs = answers.withColumn("numbers", numbers).join(facts, "document_id")
    named = F.contains(F.lower("text"), F.replace(F.col("fact_type"), F.lit("_"), F.lit(" ")))
    near = F.exists("numbers", lambda n: F.abs(n - F.col("value")) <= tolerance * F.greatest(F.abs("value"), F.lit(1.0)))
    return pairs.where(named & (F.size("numbers") > 0) & ~near).select("answer_id", "fact_type")
