"""The scalar functions for SQL users, as temporary SQL functions.

Spark puts the body of such a function in place of its call, so these cost
what the Columns cost.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import fixed_values as fv
from . import text as tx


def _raw(pattern: str) -> str:
    return f"r'{pattern}'"


def _case(column: str, table, default: str, first: str = "") -> str:
    whens = " ".join(
        f"WHEN {column} RLIKE {_raw(tx.UNICODE_NO_CASE + pattern)} THEN '{name}'"
        for name, pattern in table
    )
    return f"CASE {first} {whens} ELSE '{default}' END"


def sql_functions() -> dict[str, str]:
    """Name to definition of every function."""
    redacted = "text"
    for pattern, name in (
        (fv.EMAIL, "<email>"), (fv.IPV4, "<ip>"), (fv.UUID, "<uuid>"), (fv.TOKEN, "<token>"),
    ):
        redacted = f"regexp_replace({redacted}, {_raw(tx.UNICODE + pattern)}, '{name}')"
    found = f"regexp_substr(text, {_raw(tx.UNICODE_NO_CASE + fv.RESPONSE_TIME)})"
    number = rf"try_cast(regexp_extract({found}, r'([0-9]*\.?[0-9]+)\s*[A-Za-z]*$', 1) AS DOUBLE)"
    seconds = rf"lower(regexp_extract({found}, r'([A-Za-z]*)$', 1)) IN ('s', 'sec', 'seconds')"
    agent = ", ".join(
        f"'{field}', {_case('text', table, fv.UA_OTHER)}"
        for field, table in (
            ("browser", fv.UA_BROWSERS), ("os", fv.UA_SYSTEMS), ("device", fv.UA_DEVICES),
        )
    )
    kind = _case(
        "text", fv.LINE_TYPES, fv.LINE_TYPE_OTHER,
        f"WHEN text IS NULL THEN '{fv.LINE_TYPE_UNKNOWN}'",
    )
    bodies = {
        "redact_pii": ("STRING", redacted),
        "detect_line_type": ("STRING", kind),
        "parse_response_time": (
            "DOUBLE", f"CASE WHEN {seconds} THEN {number} * 1000.0D ELSE {number} END",
        ),
        "parse_user_agent": (
            "STRUCT<browser: STRING, os: STRING, device: STRING>", f"named_struct({agent})",
        ),
    }
    return {
        name: f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) "
        f"RETURNS {returns} RETURN {body}"
        for name, (returns, body) in bodies.items()
    }


def register_sql_functions(spark: SparkSession) -> list[str]:
    definitions = sql_functions()
    for statement in definitions.values():
        spark.sql(statement)
    return list(definitions)
