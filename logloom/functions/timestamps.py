"""Turning the time texts of the log formats into timestamps.

Each parser knows which layouts its format allows. Shapes are told apart with
a regular expression before a layout is tried, so that a row is not parsed
(and refused) by every layout in turn.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_SECONDS = r"\d{4}-\d{1,2}-\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}"
_CLOCK = r"\d{1,2}:\d{1,2}:\d{1,2}"
_WEEKDAY = r"(?i)^(Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,?\s+"

_STRFTIME = {
    "Y": "yyyy", "y": "yy", "m": "M", "d": "d", "H": "H", "I": "h", "M": "m",
    "S": "s", "f": "SSSSSS", "b": "MMM", "h": "MMM", "B": "MMMM", "p": "a",
    "z": "Z", "j": "D", "%": "%",
}
_STRFTIME_SHORT = {
    "T": "%H:%M:%S", "D": "%m/%d/%y", "F": "%Y-%m-%d", "R": "%H:%M",
}


def single_spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def iso_seconds(text: Column, checked: bool = False) -> Column:
    """``yyyy-MM-dd HH:mm:ss``, padded or not; anything else is NULL.

    ``checked`` says that the text is known to have this shape.
    """
    time = F.coalesce(text.try_cast("timestamp"), single_spaces(text).try_cast("timestamp"))
    return time if checked else F.when(text.rlike(f"^{ISO_SECONDS}$"), time)


def by_layout(text: Column, layout: str) -> Column:
    return F.try_to_timestamp(text, F.lit(layout))


def month_name_first(text: Column) -> Column:
    """``[Www] Mmm d H:m:s yyyy``."""
    plain = F.initcap(single_spaces(F.regexp_replace(text, _WEEKDAY, "")))
    return F.when(
        text.rlike(rf"(?i)^([a-z]{{3}}\s+)?[a-z]{{3}}\s+\d{{1,2}}\s+{_CLOCK}\s+\d{{4}}$"),
        by_layout(plain, "MMM d H:m:s yyyy"),
    )


def slashed(text: Column) -> Column:
    """``d/Mmm/yyyy:H:m:s``, with or without an offset from UTC."""
    shape = rf"(?i)^\d{{1,2}}/[a-z]{{3}}/\d{{4}}:{_CLOCK}"
    return F.when(
        text.rlike(shape + r"\s+[+-]\d{4}$"), by_layout(text, "d/MMM/yyyy:H:m:s Z")
    ).when(text.rlike(shape + "$"), by_layout(text, "d/MMM/yyyy:H:m:s"))


def without_year(text: Column, year: Column) -> Column:
    """``Mmm d H:m:s`` in the given year."""
    return by_layout(
        F.concat_ws(" ", year.cast("string"), single_spaces(text)), "yyyy MMM d H:m:s"
    )


def syslog_time(text: Column, year: Column | None, modified: Column | None) -> Column:
    """A time without a year.

    With neither year nor file time the current year is taken. With the time
    the file was last written, the year is the last one that does not put the
    record after it.
    """
    if year is not None:
        return without_year(text, year)
    if modified is None:
        return without_year(text, F.year(F.current_date()))
    this_year = without_year(text, F.year(modified))
    return F.when(
        this_year <= modified + F.expr("INTERVAL 1 DAY"), this_year
    ).otherwise(without_year(text, F.year(modified) - 1))


def epoch(text: Column) -> Column:
    """Seconds, milli-, micro- or nanoseconds since 1970, told by magnitude."""
    number = text.try_cast("decimal(38,9)")
    size = F.abs(number)
    micros = (
        F.when(size >= 10**17, number / 1000)
        .when(size >= 10**14, number)
        .when(size >= 10**11, number * 1000)
        .otherwise(number * 1000000)
    )
    return F.timestamp_micros(micros.try_cast("bigint"))


def any_layout(text: Column) -> Column:
    """Time text of unknown origin: ISO 8601, an epoch number, or a common layout.

    A time of day without a date gives NULL, never today's date.
    """
    return (
        F.when(text.rlike(r"^\d{4}-\d{1,2}(-|$)"), text.try_cast("timestamp"))
        .when(text.rlike(r"^[+-]?(\d{5,}(\.\d+)?|\d(\.\d+)?[eE]\+?\d+)$"), epoch(text))
        .when(text.rlike(r"^\d{1,2}/[A-Za-z]{3}/\d{4}:"), slashed(text))
        .when(text.rlike(r"^\d{4}/\d"), by_layout(single_spaces(text), "yyyy/M/d H:m:s"))
        .when(text.rlike(r"^[A-Za-z]{3}.*\d{4}$"), month_name_first(text))
    )


def strftime_layout(fmt: str) -> tuple[str, bool]:
    """A strftime format as a Spark layout, and whether a weekday leads it.

    Spark cannot parse weekday names; one at the front is cut off the text.
    """
    for code, expansion in _STRFTIME_SHORT.items():
        fmt = fmt.replace("%" + code, expansion)
    weekday = fmt[:2] in ("%a", "%A")
    if weekday:
        fmt = fmt[2:].lstrip(" ,")
    parts = []
    for code, literal in re.findall(r"%(.)|([^%]+)", fmt):
        if literal:
            quoted = literal.replace("'", "''")
            parts.append(f"'{quoted}'" if re.search(r"[A-Za-z'\[\]{}#]", literal) else literal)
        elif code in _STRFTIME:
            parts.append(_STRFTIME[code])
        else:
            raise ValueError(f"timestamp_format: %{code} is not supported")
    return "".join(parts), weekday


def by_strftime(text: Column, fmt: str) -> Column:
    layout, weekday = strftime_layout(fmt)
    if weekday:
        text = F.when(text.rlike(_WEEKDAY), F.regexp_replace(text, _WEEKDAY, ""))
    return by_layout(single_spaces(text), layout)
