"""Registered filing queries and their SQL twins."""

from __future__ import annotations

from . import documents, expressions, further, reporting, validation

QUERIES: dict = validation.QUERIES | reporting.QUERIES | expressions.QUERIES | documents.QUERIES | further.QUERIES
ORACLE_SQL: dict = validation.ORACLE_SQL | reporting.ORACLE_SQL | expressions.ORACLE_SQL | documents.ORACLE_SQL | further.ORACLE_SQL
