"""Counts by level, status, method, line type, hour and weekday."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import enrichment as en
from ..functions import fixed_values as fv
from ..functions.predicates import is_error, is_http
from ..schema import as_timestamp
from .hourly import hourly_counts


def value_counts(logs: DataFrame, column: str) -> DataFrame:
    """Rows per value, without NULL, the most frequent first."""
    return (
        logs.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc(column))
    )


def level_counts(logs: DataFrame) -> DataFrame:
    return value_counts(logs, "level")


def status_counts(logs: DataFrame) -> DataFrame:
    return value_counts(logs, "status_code").orderBy("status_code")


def method_counts(logs: DataFrame) -> DataFrame:
    return value_counts(logs, "request_type")


def line_type_counts(logs: DataFrame) -> DataFrame:
    return value_counts(logs, "line_type")


def hourly_volume(logs: DataFrame) -> DataFrame:
    return hourly_counts(logs).select("timestamp", "count").orderBy("timestamp")


def level_timeline(logs: DataFrame) -> DataFrame:
    """Rows per hour and level, for the pairs that occur."""
    return (
        logs.select(F.date_trunc("hour", as_timestamp(logs)).alias("hour"), "level")
        .dropna()
        .groupBy("hour", "level")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("hour", "level")
    )


def response_series(logs: DataFrame) -> DataFrame:
    """Time and response time of the rows that have one."""
    return logs.select(as_timestamp(logs).alias("timestamp"), "response_time_ms").filter(
        F.col("response_time_ms").isNotNull()
    )


def http_stats(logs: DataFrame, top: int = fv.TOP_PATHS) -> tuple[DataFrame, DataFrame]:
    """Most requested paths, and rows per status, of the HTTP messages."""
    http = logs.filter(is_http())
    message = F.col("message")
    if "request_path" not in http.columns:
        http = http.withColumn("request_path", en.http_path(message))
    if "status_code" not in http.columns:
        http = http.withColumn("status_code", en.http_status(None, message))
    return value_counts(http, "request_path").limit(top), status_counts(http)


def _heatmap(logs: DataFrame, condition: Column | None, fill: bool) -> DataFrame:
    time = F.col("t")
    rows = logs.withColumn("t", as_timestamp(logs)).filter(time.isNotNull())
    if condition is not None:
        rows = rows.filter(condition)
    counted = rows.groupBy(
        F.weekday(time).alias("day_number"), F.hour(time).alias("hour")
    ).agg(F.count(F.lit(1)).alias("count"))
    if fill:
        # At most 24 hours come out of the aggregation; each is spread over the
        # seven days and its own counts are summed in.
        days = F.transform(
            F.sequence(F.lit(0), F.lit(6)),
            lambda d: F.struct(
                d.alias("day_number"),
                F.when(d == F.col("day_number"), F.col("count")).otherwise(0).alias("count"),
            ),
        )
        counted = (
            counted.select("hour", F.inline(days).alias("day_number", "count"))
            .groupBy("day_number", "hour")
            .agg(F.sum("count").alias("count"))
        )
    names = F.array(*[F.lit(d) for d in fv.WEEKDAYS])
    return counted.select(
        F.get(names, F.col("day_number")).alias("day"), "day_number", "hour", "count"
    ).orderBy("day_number", "hour")


def activity_heatmap(logs: DataFrame, fill: bool = True) -> DataFrame:
    """Rows per weekday (Monday is 0) and hour of day.

    With ``fill`` every weekday has every hour that occurs, with 0 if need be.
    """
    return _heatmap(logs, None, fill)


def error_heatmap(logs: DataFrame, fill: bool = True) -> DataFrame:
    return _heatmap(logs, is_error(), fill)


def worker_summary(logs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Connector workers: error states, configuration files, process slots."""
    states = value_counts(logs, "error_state")
    files = (
        logs.select("config_file").filter(F.col("config_file").isNotNull()).distinct()
        .orderBy("config_file")
    )
    slots = logs.filter(F.col("child_pid").isNotNull()).select(
        "timestamp", "child_pid", "slot"
    )
    return states, files, slots
