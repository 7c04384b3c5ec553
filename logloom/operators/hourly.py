"""Counts per hour, rolling statistics and spikes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.predicates import is_error
from ..schema import as_timestamp, column_or_null

METRIC_COLUMNS = (
    "timestamp", "count", "errors", "error_ratio",
    "count_ma", "count_std", "z_count",
    "errors_ma", "errors_std", "z_errors", "spike",
)


def hourly_counts(logs: DataFrame) -> DataFrame:
    """Rows and errors of every hour from the first to the last one seen.

    One aggregation over the log; the hours between two observed ones are
    filled in from the gap to the next, so the log is not read a second time
    for its range. What follows the aggregation has one row per hour.
    """
    observed = (
        logs.select(as_timestamp(logs).alias("t"), column_or_null(logs, "level").alias("level"))
        .filter(F.col("t").isNotNull())
        .groupBy(F.date_trunc("hour", "t").alias("hour"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.count_if(is_error("level")).alias("errors"),
        )
    )
    by_time = Window.orderBy("hour")
    until = F.coalesce(F.lead("hour").over(by_time) - F.expr("INTERVAL 1 HOUR"), F.col("hour"))
    # In two steps, so that a wrong date thousands of years away makes no huge array.
    steps = observed.withColumn("until", until).withColumn(
        "step", F.explode(F.sequence("hour", "until", F.expr("INTERVAL 1000 HOUR")))
    )
    last = F.least(F.col("step") + F.expr("INTERVAL 999 HOUR"), F.col("until"))
    filled = steps.select(
        F.explode(F.sequence("step", last, F.expr("INTERVAL 1 HOUR"))).alias("timestamp"),
        "hour", "count", "errors",
    )
    seen = F.col("timestamp") == F.col("hour")
    return filled.select(
        "timestamp",
        F.when(seen, F.col("count")).otherwise(0).alias("count"),
        F.when(seen, F.col("errors")).otherwise(0).alias("errors"),
    )


def _rolling(name: str):
    """Mean, deviation and z-score of a count over the last hours.

    All are taken from exact sums: with n hours, sum s and sum of squares q,
    the variance is (n*q - s*s) / n**2. So ``|z| > 3`` is decided in whole
    numbers, and hours that lie exactly on the border never flip by rounding.
    """
    window = Window.orderBy("timestamp").rowsBetween(1 - fv.ROLLING_HOURS, 0)
    # Decimals, since a square of a count, times 24, can pass 2**63.
    x = F.col(name).cast("decimal(18,0)")
    n = F.count(name).over(window).cast("decimal(4,0)")
    s = F.sum(x).over(window).cast("decimal(18,0)")
    q = F.sum((x * x).cast("decimal(30,0)")).over(window).cast("decimal(32,0)")
    enough = n >= fv.ROLLING_MIN_HOURS
    spread = (n * q).cast("decimal(38,0)") - (s * s).cast("decimal(38,0)")
    offset = (n * x - s).cast("decimal(19,0)")
    deviation = F.sqrt(spread.cast("double"))
    columns = {
        f"{name}_ma": F.when(enough, s.cast("double") / n.cast("double")),
        f"{name}_std": F.when(enough, deviation / n.cast("double")),
        f"z_{name}": F.when(enough & (spread > 0), offset.cast("double") / deviation),
    }
    beyond = enough & (
        (offset * offset).cast("decimal(38,0)") > F.lit(fv.SPIKE_Z**2) * spread
    )
    return columns, F.coalesce(beyond, F.lit(False))


def hourly_metrics(logs: DataFrame) -> DataFrame:
    """``METRIC_COLUMNS`` for every hour, in order of time.

    The rolling windows run over one row per hour and not over the log, so a
    single partition for them is small at any volume.
    """
    hours = hourly_counts(logs)
    count_columns, count_spike = _rolling("count")
    error_columns, error_spike = _rolling("errors")
    ratio = F.coalesce(
        F.try_divide(F.col("errors").cast("double"), F.col("count").cast("double")), F.lit(0.0)
    )
    return (
        hours.withColumns(
            {
                "error_ratio": ratio,
                **count_columns,
                **error_columns,
                "spike": count_spike | error_spike | (ratio > fv.SPIKE_ERROR_RATIO),
            }
        )
        .select(*METRIC_COLUMNS)
        .orderBy("timestamp")
    )


def spikes(logs: DataFrame) -> DataFrame:
    """The hours flagged as spikes, newest first."""
    return hourly_metrics(logs).filter("spike").orderBy(F.desc("timestamp"))


def anomaly_summary(logs: DataFrame) -> DataFrame:
    """Number of hours, number of spikes, highest error ratio."""
    return hourly_metrics(logs).agg(
        F.count(F.lit(1)).alias("hours"),
        F.count_if("spike").alias("spike_hours"),
        F.max("error_ratio").alias("max_error_ratio"),
    )
