"""Answer context, citations, answer checks, and the deterministic parts of corpus audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import tokens
from .chunking import packable, starts
from .rules import risk_score

# Fixed values.
REFUSALS = ["i don't have enough information", "cannot find", "no relevant information"]
CITATION = r"\[Doc:\s*([^,\]]+),\s*Page:\s*([^\]]+)\]"
SEVERITIES = ["low", "medium", "high", "critical"]


def within_budget(items: DataFrame, key: str, order: str, budget: int, text: str = "content", newest: bool = False) -> DataFrame:
    """The longest prefix (or, ``newest``, suffix) of each key's items whose tokens fit the budget."""
    w = Window.partitionBy(key).orderBy(F.desc(order) if newest else F.asc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("running", F.sum(tokens(text)).over(w)).where(F.col("running") <= budget)


def prompts(queries: DataFrame, context: DataFrame, turns: DataFrame, last: int = 6) -> DataFrame:
    """(query_id, prompt): sources in rank order, the last messages and the question."""
    src = context.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "document_id", "page", "content"))).alias("src"))
    src = src.select("query_id", F.array_join(F.transform("src", lambda s, i: F.concat(F.lit("[Source "), (i + 1).cast("string"), F.lit(" | Doc: "), s["document_id"].cast("string"), F.lit(" | Page: "), s["page"].cast("string"), F.lit("]\n"), s["content"])), "\n\n").alias("sources"))
    w = Window.partitionBy("query_id").orderBy(F.desc("turn"))
    said = turns.withColumn("back", F.row_number().over(w)).where(F.col("back") <= last).groupBy("query_id")
    said = said.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.concat_ws(": ", t["role"], t["text"])), "\n").alias("said"))
    out = queries.join(src, "query_id", "left").join(said, "query_id", "left")
    prompt = F.concat(F.lit("Conversation so far:\n"), F.coalesce("said", F.lit("(none)")), F.lit("\n\nContext:\n"), F.coalesce("sources", F.lit("(no relevant context found)")), F.lit("\n\nQuestion: "), F.col("query"), F.lit("\n\nAnswer:"))
    return out.select("query_id", prompt.alias("prompt"))


def citations(answers: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """(answer_id, place, document_id, page): distinct citations in the order they first appear."""
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(CITATION), F.lit(1)).alias("d"), F.regexp_extract_all("text", F.lit(CITATION), F.lit(2)).alias("p"))
    c = answers.select("answer_id", F.posexplode(both).alias("at", "c")).select("answer_id", "at", F.trim("c.d").alias("document_id"), F.trim("c.p").alias("page"))
    first = c.groupBy("answer_id", "document_id", "page").agg(F.min("at").alias("at"))
    out = first.withColumn("place", F.row_number().over(Window.partitionBy("answer_id").orderBy("at"))).drop("at")
    if context is None:
        return out
    top = context.groupBy("answer_id", F.col("document_id").cast("string").alias("document_id")).agg(F.min_by("chunk_id", "rank").alias("chunk_id"))
    return out.join(top, ["answer_id", "document_id"], "left")


def answer_status(answers: DataFrame) -> DataFrame:
    """Adds status and confidence from text, n_citations, n_context and mean_score."""
    low = F.lower("text")
    refused = F.trim("text") == ""
    for p in REFUSALS:
        refused = refused | F.contains(low, F.lit(p))
    coverage = F.col("n_citations") / F.greatest(F.size(F.split("text", r"\. ")), F.lit(1))
    sure = F.least(F.lit(1.0), 0.5 * F.col("mean_score") + 0.5 * F.least(coverage * 3, F.lit(1.0)))
    status = F.when(refused, "refused").when((F.col("n_context") == 0) | (F.col("n_citations") == 0), "low_confidence").otherwise("valid")
    conf = F.when(refused, 0.0).when(F.col("n_context") == 0, 0.2).when(F.col("n_citations") == 0, F.least(sure, F.lit(0.35))).otherwise(sure)
    return answers.withColumn("status", status).withColumn("confidence", F.round(conf, 6))


def selected_documents(chunks: DataFrame, budget: int, condensed: DataFrame | None = None) -> DataFrame:
    """(document_id, mode, content, n_tokens): all chunks of a document if they fit the budget, else its condensed text."""
    g = chunks.groupBy("document_id").agg(F.sum(tokens("content")).alias("n_tokens"), F.sort_array(F.collect_list(F.struct("chunk_index", "content"))).alias("parts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"))
    g = g.withColumn("whole", F.array_join(F.transform("parts", lambda c: c["content"]), "\n"))
    fits = F.col("n_tokens") <= budget
    if condensed is None:
        # as many characters of the beginning of every chunk as the budget leaves it
        share = F.greatest(F.lit(1), F.floor(F.lit(4 * budget) / F.size("parts"))).cast("int")
        condensed = g.select("document_id", F.array_join(F.transform("parts", lambda c: F.substring(c["content"], F.lit(1), share)), "\n").alias("condensed"))
    out = g.join(condensed, "document_id", "left")
    return out.select("document_id", F.when(fits, "whole").otherwise("condensed").alias("mode"), F.when(fits, F.col("whole")).otherwise(F.col("condensed")).alias("content"), "n_tokens", "pages")


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, last_turn, messages, title): the title is the beginning of the first question."""
    return turns.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("messages"), F.substring(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))), 1, 60).alias("title"))


def questions_before(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, question): the message before each assistant message."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns.withColumn("question", F.lag("text").over(w)).where("role = 'assistant'").select("conv_id", "turn", "question")


def scope(requested: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents in scope, requested ids that are unknown)."""
    return docs.join(requested, "document_id", "left_semi"), requested.join(docs, "document_id", "left_anti")


def batches(chunks: DataFrame, budget: int) -> DataFrame:
    """(document_id, batch, chunk_indexes): greedy batches of a document's chunks under a token budget."""
    sized = packable(chunks.select("document_id", "chunk_index", tokens("content").alias("t")), ["document_id"], ["chunk_index"], F.col("t"), budget)
    g = sized.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("at", "chunk_index", "sum", "upto"))).alias("parts"))
    g = g.withColumn("begin", starts(F.col("parts"), budget))
    begin = F.col("begin")
    made = F.transform(begin, lambda s, k: F.transform(F.slice("parts", s + 1, F.coalesce(F.get(begin, k + 1), F.size("parts")) - s), lambda x: x["chunk_index"]))
    return g.select("document_id", F.posexplode(made).alias("batch", "chunk_indexes"))


def evidence(docs: DataFrame, found: DataFrame, keys: list[str], scored: Column) -> DataFrame:
    """(document_id, facts, flags, level): what an audit reads about each document; the level is unknown where ``scored`` is not true.

    ``found`` has the ``evaluated`` rules with each document's number of ``facts``; it is read once, and so is all that it is made of.
    The rules of a document that are triggered are gathered as the bits of a number, by their place in ``keys`` (63 at most), so that tasks add up rows without a sort.
    """
    assert len(keys) < 64
    keys = sorted(keys)
    bit = F.coalesce(F.create_map(*(F.lit(x) for i, k in enumerate(keys) for x in (k, 1 << i)))[F.col("rule_key")].cast("long"), F.lit(0).cast("long"))
    hit = F.bit_or(F.when(~F.col("failed") & F.col("triggered"), bit).otherwise(F.lit(0).cast("long")))
    flags = F.concat_ws(",", *(F.when(F.col("hit").bitwiseAND(F.lit(1 << i).cast("long")) != 0, k) for i, k in enumerate(keys)))
    judged = risk_score(found, F.max("facts").alias("facts"), hit.alias("hit"))
    judged = judged.select("document_id", "facts", flags.alias("flags"), F.when((F.col("executed") > 0) & scored, F.col("level")).alias("level"))
    out = docs.select("document_id").join(judged, "document_id", "left")
    return out.select("document_id", F.coalesce("facts", F.lit(0)).alias("facts"), F.coalesce("flags", F.lit("")).alias("flags"), F.coalesce("level", F.lit("unknown")).alias("level"))


def memory_of(c: str) -> Column:
    """A memory record with empty lists where its JSON lacks them."""
    j = F.from_json(c, "key_findings array<string>, risk_flags array<struct<severity:string,text:string>>, open_questions array<string>")
    none = lambda x, k: F.coalesce(x, F.array().cast(k))
    return F.struct(none(j["key_findings"], "array<string>").alias("key_findings"), none(j["risk_flags"], "array<struct<severity:string,text:string>>").alias("risk_flags"), none(j["open_questions"], "array<string>").alias("open_questions"))


def severity_order(c) -> Column:
    s = F.col(c) if isinstance(c, str) else c
    out = F.lit(0)
    for i, name in enumerate(SEVERITIES):
        out = F.when(s == name, i).otherwise(out)
    return out


def capped(items: DataFrame, n: int, keep_all_high: bool = False) -> DataFrame:
    """Flags (run_id, position, severity) capped to the 2n of highest severity, earlier first."""
    w = Window.partitionBy("run_id").orderBy(F.desc(severity_order("severity")), "position")
    if keep_all_high:
        high = F.col("severity").isin("high", "critical")
        return items.where(high).unionByName(items.where(~high | high.isNull()).withColumn("place", F.row_number().over(w)).where(F.col("place") <= 2 * n).drop("place"))
    return items.withColumn("place", F.row_number().over(w)).where(F.col("place") <= 2 * n)


def last_items(items: DataFrame, n: int) -> DataFrame:
    """The last ``n`` of each run's items (run_id, position), in their order."""
    w = Window.partitionBy("run_id").orderBy(F.desc("position"))
    return items.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).drop("place")


def capped_memory(key_findings: DataFrame, risk_flags: DataFrame, open_questions: DataFrame, n: int) -> DataFrame:
    """(run_id, key_findings, risk_flags, open_questions): a run's memory with its last n findings and questions and its 2n gravest flags.

    Each input is (run_id, position, text), flags with a severity. Every list is cut by a rank with a fixed bound, which tasks apply to their own
    rows before the shuffle, so what reaches a run's task is bounded by n and the number of tasks.
    """
    lists = [
        last_items(key_findings, n).select("run_id", F.struct("position", "text").alias("key_findings")),
        capped(risk_flags, n).select("run_id", F.struct("place", "severity", "text").alias("risk_flags")),
        last_items(open_questions, n).select("run_id", F.struct("position", "text").alias("open_questions")),
    ]
    every = lists[0].unionByName(lists[1], allowMissingColumns=True).unionByName(lists[2], allowMissingColumns=True)
    g = every.groupBy("run_id").agg(*(F.sort_array(F.collect_list(c)).alias(c) for c in ("key_findings", "risk_flags", "open_questions")))
    texts = lambda c: F.transform(c, lambda x: x["text"]).alias(c)
    return g.select("run_id", texts("key_findings"), F.transform("risk_flags", lambda x: F.struct(x["severity"].alias("severity"), x["text"].alias("text"))).alias("risk_flags"), texts("open_questions"))


def memory_tokens(c: str) -> Column:
    return F.floor(F.length(F.to_json(F.col(c))) / 4).cast("int")


def memory_trail(found: DataFrame, docs: DataFrame, width: int = 10_000) -> DataFrame:
    """(run_id, document_id, position, findings_so_far, flags_so_far): running totals in document order.

    Totals run within stretches of ``width`` ids, and start from those of the stretches before, so no task gets a whole run.
    """
    per = found.groupBy("document_id").agg(F.count("*").alias("n"), F.count_if("triggered").alias("t"))
    own = docs.join(per, "document_id", "left").select("run_id", "document_id", F.floor(F.col("document_id") / width).alias("part"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("t", F.lit(0)).alias("t"))
    sums = own.groupBy("run_id", "part").agg(F.count("*").alias("docs"), F.sum("n").alias("all_n"), F.sum("t").alias("all_t"))
    before = Window.partitionBy("run_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select("run_id", "part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("docs", "all_n", "all_t")))
    w = Window.partitionBy("run_id", "part").orderBy("document_id")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    within = own.select("run_id", "document_id", "part", F.row_number().over(w).alias("i"), F.sum("n").over(run).alias("n"), F.sum("t").over(run).alias("t"))
    out = within.join(start, ["run_id", "part"])
    return out.select("run_id", "document_id", (F.col("docs") + F.col("i")).cast("int").alias("position"), (F.col("all_n") + F.col("n")).alias("findings_so_far"), (F.col("all_t") + F.col("t")).alias("flags_so_far"))


def flag_counts(found: DataFrame, key: str) -> DataFrame:
    return found.where("triggered").groupBy(key).agg(*(F.count_if(F.coalesce("severity", F.lit("low")) == s).alias(s) for s in SEVERITIES))


def coverage(scoped: DataFrame, failed: DataFrame) -> DataFrame:
    """(run_id, documents, failed, covered, progress)."""
    out = scoped.join(failed.select("document_id", F.lit(True).alias("bad")).distinct(), "document_id", "left").groupBy("run_id").agg(F.count("*").alias("documents"), F.count("bad").alias("failed"))
    return out.withColumn("covered", F.col("documents") - F.col("failed")).withColumn("progress", F.round(F.col("covered") / F.col("documents"), 6))


def failures_as_questions(scoped: DataFrame, failed: DataFrame) -> DataFrame:
    """(run_id, position, text): an open question for each document of a run that could not be read, by document."""
    return scoped.join(failed.select("document_id").distinct(), "document_id", "left_semi").select("run_id", F.col("document_id").alias("position"), F.concat(F.lit("Document "), F.col("document_id").cast("string"), F.lit(" could not be processed")).alias("text"))


def flagged_issues(found: DataFrame, scoped: DataFrame) -> DataFrame:
    """(run_id, severity, document_id, rule_key): every critical or high flag of a run, as rows, for no report may leave one out."""
    return found.where("triggered and severity in ('critical', 'high')").join(scoped.select("document_id", "run_id"), "document_id").select("run_id", "severity", "document_id", "rule_key")


def report_sections(found: DataFrame, scoped: DataFrame, failed: DataFrame) -> DataFrame:
    """(run_id, section, place, line): the report's tables as lines: flag counts, every flagged issue, and the open questions."""
    counts = flag_counts(found.join(scoped.select("document_id", "run_id"), "document_id"), "run_id")
    risk = counts.select("run_id", F.lit("Risk Summary").alias("section"), F.posexplode(F.array(*(F.concat(F.lit(f"| {s} | "), F.col(s).cast("string"), F.lit(" |")) for s in reversed(SEVERITIES)))).alias("place", "line"))
    issues = flagged_issues(found, scoped)
    shown = F.concat(F.lit("| "), F.col("severity"), F.lit(" | "), F.col("rule_key"), F.lit(" | document "), F.col("document_id").cast("string"), F.lit(" |"))
    flagged = issues.select("run_id", F.lit("Flagged Issues Requiring Review").alias("section"), F.col("document_id").alias("place"), shown.alias("line"))
    asked = failures_as_questions(scoped, failed).select("run_id", F.lit("Open Questions").alias("section"), F.col("position").alias("place"), F.concat(F.lit("- "), "text").alias("line"))
    return risk.withColumn("place", F.col("place").cast("long")).unionByName(flagged).unionByName(asked)


def report(found: DataFrame, scoped: DataFrame, most: int = 5) -> DataFrame:
    """(run_id, report): flag counts and the rules that fire most, as Markdown lines."""
    f = found.where("triggered").join(scoped.select("document_id", "run_id"), "document_id")
    counts = flag_counts(f, "run_id")
    per = f.groupBy("run_id", "rule_key").agg(F.count("*").alias("n"))
    top = per.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("n"), "rule_key"))).where(F.col("place") <= most)
    lines = top.groupBy("run_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "rule_key", "n"))), lambda x: F.concat(F.lit("- "), x["rule_key"], F.lit(": "), x["n"].cast("string"))), "\n").alias("lines"))
    head = F.concat(F.lit("## Risk summary\n"), F.concat_ws(", ", *(F.concat(F.lit(f"{s} "), F.col(s).cast("string")) for s in reversed(SEVERITIES))), F.lit("\n## Key findings\n"), F.col("lines"))
    return counts.join(lines, "run_id").select("run_id", head.alias("report"))
