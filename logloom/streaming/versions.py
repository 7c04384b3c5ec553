"""Numbered versions of a stream's tables on shared storage.

A batch writes its tables below ``v=<batch>`` and a mark last of all. After a
failure the batch runs again from the version before and overwrites what it
left, so every version is whole and counts each row once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Versions that stay, for readers that have just begun.
KEPT = 3


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def committed(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of all whole versions, in order."""
    place, files = _files(spark, f"{folder}/v=*/done/_SUCCESS")
    found = files.globStatus(place) or []
    return sorted(int(f.getPath().getParent().getParent().getName()[2:]) for f in found)


def place(folder: str, number: int, table: str) -> str:
    return f"{folder}/v={number}/{table}"


def write(df: DataFrame, folder: str, number: int, table: str) -> DataFrame:
    """A table of the version, written and read again."""
    path = place(folder, number, table)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, folder: str, number: int | None, table: str, schema: str) -> DataFrame:
    """A table of a version; empty where there is none yet."""
    if number is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(place(folder, number, table))


def commit(spark: SparkSession, folder: str, number: int) -> None:
    """Marks a version as whole and drops those that nothing reads any more."""
    spark.range(1).write.mode("overwrite").parquet(place(folder, number, "done"))
    for old in committed(spark, folder)[:-KEPT]:
        path, files = _files(spark, f"{folder}/v={old}")
        files.delete(path, True)


def before(spark: SparkSession, folder: str, number: int) -> int | None:
    """The version that batch ``number`` starts from."""
    earlier = [n for n in committed(spark, folder) if n < number]
    if number and not earlier:
        raise ValueError(f"{folder} has no version before batch {number}: it belongs to another checkpoint")
    return earlier[-1] if earlier else None
