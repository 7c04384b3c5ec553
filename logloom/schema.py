"""The one table shape every log format is parsed into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields a parser fills from one record's text.
PARSED_FIELDS = T.StructType(
    [T.StructField("timestamp", T.TimestampType())]
    + [
        T.StructField(name, T.StringType())
        for name in (
            "timestamp_raw",
            "level",
            "module",
            "message",
            "severity",
            "ip",
            "user_agent",
            "status_code",
            "request_type",
            "request_path",
            "request_time",
            "worker_type",
            "error_state",
            "child_pid",
            "slot",
            "config_file",
        )
    ]
)

#: Where a record came from; ``record_id`` orders records within a source.
ORIGIN_FIELDS = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("record_id", T.LongType()),
        T.StructField("format", T.StringType()),
    ]
)

LOG_SCHEMA = T.StructType(ORIGIN_FIELDS.fields + PARSED_FIELDS.fields)

ENRICHED_SCHEMA = T.StructType(
    LOG_SCHEMA.fields
    + [
        T.StructField("line_type", T.StringType()),
        T.StructField("response_time_ms", T.DoubleType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("ua_browser", T.StringType()),
        T.StructField("ua_os", T.StringType()),
        T.StructField("ua_device", T.StringType()),
    ]
)

#: ``source`` and ``line_id`` place a line; ``line_id`` is unique and ordered
#: within its source. ``modified`` is optional.
LINE_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("line_id", T.LongType()),
        T.StructField("value", T.StringType()),
    ]
)


def record(**fields: Column) -> Column:
    """A struct of all parsed fields; those not given are NULL.

    Those given have the field's type already.
    """
    unknown = set(fields) - set(PARSED_FIELDS.names)
    if unknown:
        raise ValueError(f"not fields of a record: {sorted(unknown)}")
    nothing = F.lit(None).cast("string")
    fields.setdefault("timestamp", F.lit(None).cast("timestamp"))
    return F.struct(*[fields.get(name, nothing).alias(name) for name in PARSED_FIELDS.names])


def empty_logs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LOG_SCHEMA)


def column_or_null(df: DataFrame, name: str, dtype: str = "string") -> Column:
    """The named column, or a typed NULL where the table has none."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def as_timestamp(df: DataFrame, name: str = "timestamp") -> Column:
    """The named column as TIMESTAMP, whether it is stored with a zone or not."""
    return column_or_null(df, name, "timestamp").cast("timestamp")
