"""Adding derived columns to a log table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import enrichment as en
from ..plans.workspace import work_folder
from ..schema import column_or_null


def add_enrichments(
    logs: DataFrame, preserve_parsed: bool = False, ip_mode: str = "row"
) -> DataFrame:
    """Line type, HTTP fields, response time, user id, address and user agent.

    Status, method and path found in the message replace parsed ones, unless
    ``preserve_parsed``. A missing address is taken from the message per row;
    with ``ip_mode="dataset"`` only if no row of the table has one. The table is
    then written once, so that asking this doesn't parse the log again.
    """
    if "message" not in logs.columns:
        return logs
    message = F.col("message")
    level = F.col("level") if "level" in logs.columns else None

    def kept(name, found):
        if preserve_parsed and name in logs.columns:
            return F.coalesce(F.col(name), found)
        return found

    columns = {
        "line_type": en.line_type(message),
        "request_type": kept("request_type", en.http_method(message)),
        "request_path": kept("request_path", en.http_path(message)),
        "response_time_ms": en.response_time_ms(message),
        "user_id": en.user_id(message),
    }
    if level is not None:
        columns["status_code"] = kept("status_code", en.http_status(level, message))
    ip = column_or_null(logs, "ip")
    found_ip = en.first_ipv4(message)
    if "ip" not in logs.columns:
        columns["ip"] = found_ip
    elif ip_mode == "dataset":
        spark, schema = logs.sparkSession, logs.schema
        folder = work_folder(spark, "parsed")
        logs.write.parquet(folder)
        logs = spark.read.schema(schema).parquet(folder)
        # Ends at the first address found, and reads that column alone.
        columns["ip"] = found_ip if logs.filter(ip.isNotNull()).isEmpty() else ip
    else:
        columns["ip"] = F.coalesce(ip, found_ip)
    if "user_agent" in logs.columns:
        agent = en.user_agent(F.col("user_agent"))
        columns |= {f"ua_{part}": agent[part] for part in ("browser", "os", "device")}
    return logs.withColumns(columns)
