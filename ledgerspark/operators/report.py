"""Reports over findings: counters, facets, slices, text and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(findings: DataFrame, by: tuple[str, ...] = ("instance_id",)) -> DataFrame:
    """Counters of errors, warnings, passes and findings not evaluated, and whether a filing passed."""
    failed = F.col("status") == "FAIL"
    counted = findings.groupBy(*by).agg(
        F.count_if(failed & (F.col("severity") == "error")).alias("errors"), F.count_if(failed & (F.col("severity") == "warning")).alias("warnings"),
        F.count_if(F.col("status") == "PASS").alias("passes"), F.count_if(F.col("status") == "NOT_EVALUATED").alias("not_evaluated"),
    )
    return counted.withColumn("passed", F.col("errors") == 0)


def facets(findings: DataFrame) -> DataFrame:
    """Tables that findings are about, with their tallies."""
    return findings.where("table_id IS NOT NULL").groupBy("table_id").agg(F.count("*").alias("findings"), F.count_if(F.col("status") == "PASS").alias("passes"), F.count_if((F.col("status") == "FAIL") & (F.col("severity") == "error")).alias("errors"))


def only(findings: DataFrame, kind: str | None = None, table_id: str | None = None) -> DataFrame:
    """Findings of a severity (or PASS, NOT_EVALUATED) and of a table."""
    if kind in ("PASS", "NOT_EVALUATED"):
        findings = findings.where(F.col("status") == kind)
    elif kind is not None:
        findings = findings.where((F.col("status") == "FAIL") & (F.col("severity") == kind))
    return findings if table_id is None else findings.where(F.col("table_id") == table_id)


def as_lines(findings: DataFrame) -> DataFrame:
    """One line of text a finding."""
    return findings.select("instance_id", F.concat_ws(" | ", F.upper("severity"), "status", "rule_id", "concept", "context_id", "message").alias("line"))


def as_json(findings: DataFrame) -> DataFrame:
    """One JSON object a filing: its summary and findings. A filing's findings meet in one row."""
    each = findings.groupBy("instance_id").agg(F.sort_array(F.collect_list(F.struct("rule_id", "severity", "status", "source", "concept", "context_id", "message"))).alias("findings"))
    whole = each.join(summary(findings), "instance_id")
    return whole.select("instance_id", F.to_json(F.struct(F.struct("errors", "warnings", "passes", "not_evaluated", "passed").alias("summary"), "findings")).alias("json"))


def write(findings: DataFrame, path: str, kind: str = "json") -> None:
    if kind == "json":
        as_json(findings).select("json").write.mode("overwrite").text(path)
    elif kind == "text":
        as_lines(findings).select("line").write.mode("overwrite").text(path)
    else:
        findings.write.mode("overwrite").format(kind).save(path)


def suite_lines(rolled: DataFrame) -> DataFrame:
    """One line of text a conformance suite."""
    return rolled.select(F.format_string("%-10s %s: %d passed, %d failed, %d errors, %d skipped", "status", "suite_id", "pass", "fail", "error", "skipped").alias("line"))


def all_findings(*parts: DataFrame) -> DataFrame:
    """The findings of all rule families, in the order given: source_ord tells which."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [p.withColumn("source_ord", F.lit(i)) for i, p in enumerate(parts)])
