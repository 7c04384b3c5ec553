"""Reports per module: ranking, line types, error rates, error counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.predicates import is_error, is_warning
from ..schema import as_timestamp, column_or_null

#: Every line type there is, so that no job has to find them first.
LINE_TYPE_COLUMNS = tuple(name for name, _ in fv.LINE_TYPES) + (
    fv.LINE_TYPE_OTHER,
    fv.LINE_TYPE_UNKNOWN,
)


def _type_counts(logs: DataFrame) -> list[Column]:
    """Messages per line type; for rows without a module there are none."""
    counted = F.col("message").isNotNull()
    return [
        F.when(F.col("module").isNotNull(), F.count_if(counted & (F.col("line_type") == name)))
        .alias(name)
        for name in LINE_TYPE_COLUMNS
    ]


def error_rate(errors: Column, total: Column) -> Column:
    """Rounded half to even, as the ratio's exact decimal value stands."""
    return F.bround(F.try_divide(errors.cast("double"), total.cast("double")), 3)


def module_ranking(logs: DataFrame) -> DataFrame:
    """Messages, errors, warnings, error rate and time span of each module.

    With a ``line_type`` column the counts per type are added. It is one
    aggregation, combined before the shuffle; types are counted by condition
    instead of a pivot that is joined back.
    """
    if "module" not in logs.columns:
        logs = logs.withColumn("module", F.lit(None).cast("string")).limit(0)
    logs = logs.withColumns(
        {
            "timestamp": as_timestamp(logs),
            "message": column_or_null(logs, "message"),
            "level": column_or_null(logs, "level"),
        }
    )
    types = _type_counts(logs) if "line_type" in logs.columns else []
    ranked = logs.groupBy("module").agg(
        F.count("message").alias("total"),
        F.count_if(is_error()).alias("errors"),
        F.count_if(is_warning()).alias("warns"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        *types,
    )
    names = [c for c in LINE_TYPE_COLUMNS if c in ranked.columns]
    return ranked.select(
        "module", "total", "errors", "warns", "first_seen", "last_seen",
        error_rate(F.col("errors"), F.col("total")).alias("error_rate"),
        *names,
    ).orderBy(F.desc("errors"), F.desc("error_rate"), F.desc("total"), F.asc("module"))


def module_type_pivot(logs: DataFrame) -> DataFrame:
    """Messages per module (without NULL) and line type."""
    return (
        logs.filter(F.col("module").isNotNull())
        .groupBy("module")
        .agg(*_type_counts(logs))
        .orderBy("module")
    )


def top_error_rates(
    logs: DataFrame,
    min_volume: int = fv.MIN_MODULE_VOLUME,
    top: int = fv.TOP_ERROR_RATE_MODULES,
) -> DataFrame:
    """Modules with enough messages, by error rate."""
    return (
        module_ranking(logs)
        .filter(F.col("total") >= min_volume)
        .orderBy(F.desc("error_rate"), F.asc("module"))
        .limit(top)
    )


def errors_per_module(logs: DataFrame, top: int = fv.TOP_MODULES) -> DataFrame:
    return (
        logs.filter(is_error() & F.col("module").isNotNull())
        .groupBy("module")
        .agg(F.count(F.lit(1)).alias("errors"))
        .orderBy(F.desc("errors"), F.asc("module"))
        .limit(top)
    )
