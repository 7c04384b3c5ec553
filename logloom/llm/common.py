"""What several operators of this folder share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.workspace import work_folder

#: The six characters that separate words; bytes.split() knows the same six.
SPACES = "\x20\x09-\x0d"
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """The table written to shared storage and read again.

    Later jobs start from the files, so that lost executors cost no more than
    the tasks they ran, and a costly step is done once.
    """
    path = work_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(column: str = "text"):
    """A text column where a missing text is an empty one."""
    return F.coalesce(F.col(column), F.lit(""))
