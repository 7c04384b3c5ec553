"""Conditions the reports share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv


def is_error(level: Column | str = "level") -> Column:
    """Never NULL: a missing level is no error."""
    return F.coalesce(F.upper(level) == "ERROR", F.lit(False))


def is_warning(level: Column | str = "level") -> Column:
    return F.coalesce(F.upper(level).isin("WARN", "WARNING"), F.lit(False))


def is_http(message: Column | str = "message") -> Column:
    column = F.col(message) if isinstance(message, str) else message
    return F.coalesce(column.contains(fv.HTTP_MARK), F.lit(False))
