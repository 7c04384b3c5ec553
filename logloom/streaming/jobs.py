"""Log tables and hourly counts on unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.predicates import is_error
from ..operators.enrich import add_enrichments
from ..operators.parse import parse
from ..operators.redact import add_redacted


def stream_logs(
    lines: DataFrame,
    format: str,
    config: dict[str, str] | None = None,
    *,
    year: int | None = None,
    redact: bool = False,
) -> DataFrame:
    """Parse and enrich a stream of lines; each line is a record.

    All of it is row by row, so the stream keeps no state.
    """
    logs = add_enrichments(parse(lines, format, config, year=year))
    return add_redacted(logs) if redact else logs


def stream_hourly(logs: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Rows and errors per hour of a stream; state is one row per open hour.

    Rows of hours that the watermark has passed are dropped. In append mode an
    hour comes out once it is passed, in update mode as it stands. ``to_totals``
    counts late rows as well.
    """
    return (
        logs.filter(F.col("timestamp").isNotNull())
        .withColumn("error", is_error().cast("bigint"))
        .withWatermark("timestamp", watermark)
        .groupBy(F.window("timestamp", "1 hour"))
        .agg(F.count(F.lit(1)).alias("count"), F.sum("error").alias("errors"))
        .select(
            F.col("window.start").cast("timestamp").alias("timestamp"), "count", "errors"
        )
    )


def to_files(
    stream: DataFrame, path: str, checkpoint: str, format: str = "parquet"
) -> DataStreamWriter:
    """Append a stream to files, each row exactly once."""
    return (
        stream.writeStream.format(format)
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )


def to_snapshot(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Keep the result of an aggregation, as ``read_snapshot`` gives it.

    A batch writes the rows it changed to a folder of its own, and again to the
    same one after a failure, so what is there is never replaced by nothing.
    Groups that the watermark has passed leave the state. ``path`` and
    ``checkpoint`` belong together.
    """

    def changed(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    return (
        stream.writeStream.foreachBatch(changed)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
    )


def read_snapshot(spark: SparkSession, path: str, key: str = "timestamp") -> DataFrame:
    """The latest row of every ``key`` that ``to_snapshot`` has written."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (key, "batch_id")]
    latest = F.max_by(F.struct(*values), "batch_id").alias("latest")
    return rows.groupBy(key).agg(latest).select(key, "latest.*")
