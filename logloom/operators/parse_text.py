"""Parsers for lines of text: bracketed, syslog, web access, free text.

Every parser is a Column: given the text of a record it yields an array of
parsed structs, empty where the record does not fit the format.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text as tx
from ..functions import timestamps as ts
from ..schema import record

_BRACKETED = tx.UNICODE + rf"^\[({ts.ISO_SECONDS})\] \[(.*?)\] \[(.*?)\] (?s:(.*))$"
_BRACKETED_ANY_TIME = tx.UNICODE + r"^\[(.*?)\] \[(.*?)\] \[(.*?)\] (?s:(.*))$"
_SYSLOG = tx.UNICODE + fv.SYSLOG_LINE
_ACCESS = tx.UNICODE + fv.ACCESS_LINE


def _message(text: Column, first_line_only: bool) -> Column:
    return F.substring_index(text, "\n", 1) if first_line_only else text


def custom_records(text: Column, options) -> Column:
    """``[time] [level] [module] message``; rows with a bad time are dropped."""
    layout = options.timestamp_format
    found = tx.captures(text, _BRACKETED_ANY_TIME if layout else _BRACKETED, 4)

    def build(p: Column) -> Column:
        time = ts.by_strftime(p[1], layout) if layout else ts.iso_seconds(p[1], checked=True)
        return record(
            timestamp=time,
            timestamp_raw=p[1],
            level=p[2],
            module=p[3],
            message=_message(p[4], options.first_line_only),
        )

    return F.filter(F.transform(found, build), lambda r: r["timestamp"].isNotNull())


def syslog_records(text: Column, options) -> Column:
    """``Mmm d HH:mm:ss host tag: message``; the level is read off the message."""

    def build(p: Column) -> Column:
        message = _message(p[4], options.first_line_only)
        word = tx.first_match(F.lower(message), tx.UNICODE_NO_CASE + fv.SYSLOG_SEVERITY)
        return record(
            timestamp=ts.syslog_time(p[1], options.year, options.modified),
            timestamp_raw=p[1],
            level=tx.lookup(word, fv.SYSLOG_LEVELS, F.lit("INFO")),
            module=p[3],
            message=message,
            ip=p[2],
        )

    return F.transform(tx.captures(text, _SYSLOG, 4), build)


def access_records(text: Column, options) -> Column:
    """Web access lines, Combined or Common; Common has no user agent."""

    def build(p: Column) -> Column:
        return record(
            timestamp=ts.slashed(p[2]),
            timestamp_raw=p[2],
            level=p[6],
            module=p[1],
            message=p[3],
            ip=p[1],
            status_code=p[6],
            user_agent=F.when(p[8] == '"', p[7]),
            request_type=p[4],
            request_path=p[5],
        )

    return F.transform(tx.captures(text, _ACCESS, 8), build)


def generic_records(text: Column, options) -> Column:
    """Any text is a record; time, level and address are looked for in it."""

    def find(line: Column) -> Column:
        return F.struct(
            tx.first_match(line, tx.UNICODE + fv.TIMESTAMP_IN_TEXT).alias("time"),
            tx.first_match(line, tx.UNICODE_NO_CASE + fv.LEVEL_IN_TEXT).alias("level"),
            line.alias("line"),
        )

    def build(found: Column) -> Column:
        return record(
            timestamp=ts.iso_seconds(found["time"]),
            timestamp_raw=found["time"],
            level=F.coalesce(F.upper(found["level"]), F.lit("UNKNOWN")),
            module=F.lit("unknown"),
            message=tx.strip(found["line"]),
            ip=tx.first_match(found["line"], tx.UNICODE + fv.IPV4),
        )

    return F.transform(F.transform(F.array(text), find), build)
