"""Findings: the one relation that all rules return."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("instance_id", "rule_id", "severity", "status", "source", "concept", "context_id", "hypercube", "dimension", "constraint_type", "table_id", "message")


def finding(df: DataFrame, rule_id: str | Column, source: str, message: Column, severity: str | Column = "error", status: str | Column = "FAIL", **values: Column) -> DataFrame:
    """df's rows as findings; columns of df of the right names are taken over, others given by name."""
    fixed = {"rule_id": rule_id if isinstance(rule_id, Column) else F.lit(rule_id), "severity": F.lit(severity), "source": F.lit(source), "status": status if isinstance(status, Column) else F.lit(status), "message": message} | values
    return df.select(*(fixed.get(c, F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in COLUMNS))


def union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
