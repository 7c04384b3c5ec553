"""Writing log tables: CSV, JSON lines, and parquet by day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.redact import redact_columns


def _exported(logs: DataFrame, redact: bool, columns: list[str]) -> DataFrame:
    return redact_columns(logs, columns) if redact else logs


def write_csv(
    logs: DataFrame,
    path: str,
    redact: bool = False,
    columns: list[str] | None = None,
    mode: str = "errorifexists",
) -> None:
    """CSV with a header. ``redact`` blanks personal data in ``columns``
    (``message`` unless given). Quotes, blanks at the edges and newlines
    survive; an empty text reads back as NULL."""
    _exported(logs, redact, columns or ["message"]).write.mode(mode).csv(
        path,
        header=True,
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def write_json(
    logs: DataFrame,
    path: str,
    redact: bool = False,
    columns: list[str] | None = None,
    mode: str = "errorifexists",
) -> None:
    """One JSON object per line, NULL fields included, times as ISO 8601."""
    _exported(logs, redact, columns or ["message"]).write.mode(mode).json(
        path, ignoreNullFields=False
    )


def read_csv_export(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).csv(
        path,
        header=True,
        escape='"',
        multiLine=True,
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def write_parquet(logs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet partitioned by day, so that a time range reads its days only.

    Rows are brought together by day first, so that a task does not write a
    file for every day; the adaptive planner splits large days.
    """
    by_day = logs.withColumn("day", F.to_date("timestamp")).hint("rebalance", "day")
    by_day.write.mode(mode).partitionBy("day").parquet(path)
