"""Hiding personal data and secrets in text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.enrichment import redact_pii


def add_redacted(logs: DataFrame, column: str = "message") -> DataFrame:
    """Adds ``redacted_<column>`` and leaves the column as it is."""
    return logs.withColumn(f"redacted_{column}", redact_pii(F.col(column)))


def redact_columns(logs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Replaces the columns (``message`` unless given) by redacted text."""
    hidden: dict[str, Column] = {
        c: redact_pii(F.col(c)) for c in (columns or ["message"]) if c in logs.columns
    }
    return logs.withColumns(hidden) if hidden else logs
