"""Counts over a stream that lose no row, however late it comes.

A batch is counted on its own, on the map side first, and added to the version
of the totals before it. Nothing waits for a watermark and nothing is evicted:
what is kept is a row per key, whatever has been read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.predicates import is_error
from . import versions


def hourly_parts(logs: DataFrame) -> DataFrame:
    """Each row of a log stream as a count that can be added up by hour."""
    return logs.filter(F.col("timestamp").isNotNull()).select(
        F.date_trunc("hour", "timestamp").alias("timestamp"),
        F.lit(1).cast("bigint").alias("count"),
        is_error().cast("bigint").alias("errors"),
    )


def to_totals(parts: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("timestamp",)) -> DataStreamWriter:
    """Keeps the sums of all other columns of a stream by ``keys``, nulls among
    them, as ``read_totals`` gives them. ``path`` and ``checkpoint`` belong together."""
    sums = [c for c in parts.columns if c not in keys]
    fields = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c] if c in keys else 'bigint'}" for c in (*keys, *sums))

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = versions.read(spark, path, versions.before(spark, path, number), "totals", schema)
        own = batch.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
        both = earlier.unionByName(own).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
        versions.write(both, path, number, "totals")
        versions.commit(spark, path, number)

    return parts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """The sums over all batches that are done."""
    return spark.read.parquet(versions.place(path, versions.committed(spark, path)[-1], "totals"))
