"""Narrowing a log table, and the values one can narrow it to."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_time(
    logs: DataFrame, start: datetime | str | None = None, end: datetime | str | None = None
) -> DataFrame:
    """Both ends belong to the range; rows without a time do not."""
    time = F.col("timestamp")
    if start is not None:
        logs = logs.filter(time >= F.lit(start).cast("timestamp"))
    if end is not None:
        logs = logs.filter(time <= F.lit(end).cast("timestamp"))
    return logs


def filter_values(logs: DataFrame, column: str, values: Iterable[str] | None) -> DataFrame:
    """Rows with one of the values, compared exactly; no values, no filter."""
    values = list(values or [])
    return logs.filter(F.col(column).isin(*values)) if values else logs


def filter_keyword(
    logs: DataFrame, keyword: str | None, literal: bool = False, column: str = "message"
) -> DataFrame:
    """Rows whose text holds the keyword, in any case.

    It is a regular expression unless ``literal``.
    """
    if not keyword:
        return logs
    if literal:
        return logs.filter(F.lower(column).contains(F.lower(F.lit(keyword))))
    return logs.filter(F.col(column).rlike("(?idU)" + keyword))


def apply_filters(
    logs: DataFrame,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    levels: Iterable[str] | None = None,
    modules: Iterable[str] | None = None,
    keyword: str | None = None,
    literal: bool = False,
) -> DataFrame:
    logs = filter_time(logs, start, end)
    logs = filter_values(logs, "level", levels)
    logs = filter_values(logs, "module", modules)
    return filter_keyword(logs, keyword, literal)


def not_null(logs: DataFrame, *columns: str) -> DataFrame:
    return logs.dropna(subset=list(columns))


def distinct_values(logs: DataFrame, column: str) -> DataFrame:
    """The values of a column one can filter by, sorted."""
    return logs.select(column).dropna().distinct().orderBy(column)
