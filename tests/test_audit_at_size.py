"""What the audit's queries shuffle."""

from __future__ import annotations

from docweave.operators import context
from docweave.plans.queries_ops import audit_evidence
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_findings_are_made_once(spark):
    """The documents, their texts and their line items are made once, not for the flags, the level and the facts each."""
    plan = audit_evidence(spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    reads = [line for line in plan if "Relation [" in line and "l_orderkey" in line]
    # 16 reads and 4 explodes where flags, level and facts each make their own
    assert len(reads) <= 5 and len([line for line in plan if "Generate explode" in line]) == 2


def test_evidence_of_documents_without_results(spark):
    """Unknown documents and those whose rules have all failed have no flags and an unknown level; a failed rule is no flag."""
    rows = [(1, 2, "b", True, "high", 1.0, False), (1, 2, "a", True, "critical", 1.0, False), (1, 2, "c", False, "low", None, True), (2, 5, "a", False, "low", None, True), (3, None, "c", False, "low", 0.0, False), (4, 1, "a", True, "low", 1.0, False)]
    found = spark.createDataFrame(rows, "document_id long, facts long, rule_key string, triggered boolean, severity string, confidence double, failed boolean")
    docs = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 9)], "document_id long")
    got = sorted(tuple(r) for r in context.evidence(docs, found, ["c", "b", "a"], F.col("document_id") != 4).collect())
    assert got == [(1, 2, "a,b", "critical"), (2, 5, "", "unknown"), (3, 0, "", "low"), (4, 1, "a", "unknown"), (9, 0, "", "unknown")]
