"""A place on shared storage for files a job makes for itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Where that is unset and Spark runs on one machine, as in tests, a
    temporary folder is used; a cluster has to name its shared folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="logloom-")
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
