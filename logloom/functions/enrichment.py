"""Columns read off a log message: kind, HTTP facts, timing, user, agent."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from . import text as tx


def _alternatives(pattern: str) -> list[str]:
    """The top-level alternatives of a pattern."""
    parts, depth = [""], 0
    for token in re.findall(r"\\.|.", pattern):
        depth += (token == "(") - (token == ")")
        if token == "|" and depth == 0:
            parts.append("")
        else:
            parts[-1] += token
    return parts


def _needed_text(pattern: str) -> tuple[str, bool]:
    """The longest plain text every match holds, and whether that is all of it."""
    runs, depth = [""], 0
    tokens = re.findall(r"\\.|.", pattern)
    for token, after in zip(tokens, tokens[1:] + [""]):
        depth += (token in "([") - (token in ")]")
        plain = token.isalnum() or token in " :-_/" or (token[0] == "\\" and not token[1].isalnum())
        if depth == 0 and plain and after not in tuple("?*{+"):
            runs[-1] += token[-1]
        else:
            runs.append("")
    longest = max(runs, key=len)
    return longest, re.sub(r"\\(\W)", r"\1", pattern) == longest


def _contains_any(lowered: Column, pattern: str) -> Column:
    """Whether text, given in lower case, holds a case-insensitive pattern.

    Substring searches cost a fraction of a regular expression. Alternatives
    that are plain text are searched as such; of the others, those whose
    matches must hold some text run only where that text is found.
    """
    tests, regex = [], []
    for part in _alternatives(pattern):
        needed, whole = _needed_text(part)
        if whole:
            tests.append(lowered.contains(needed.lower()))
        elif len(needed) > 1:
            expression = lowered.rlike(tx.UNICODE_NO_CASE + part)
            regex.append(lowered.contains(needed.lower()) & expression)
        else:
            regex.append(lowered.rlike(tx.UNICODE_NO_CASE + part))
    return reduce(lambda a, b: a | b, tests + regex)


def line_type(message: Column) -> Column:
    """The first of the line types the message fits; OTHER if none does."""
    lowered = F.lower(message)
    case = F.when(message.isNull(), F.lit(fv.LINE_TYPE_UNKNOWN))
    for name, pattern in fv.LINE_TYPES:
        case = case.when(_contains_any(lowered, pattern), F.lit(name))
    return case.otherwise(F.lit(fv.LINE_TYPE_OTHER))


def _has_verb(message: Column) -> Column:
    """Whether any request verb occurs; cheaper than the search for a word."""
    verbs = re.search(r"\((.*?)\)", fv.HTTP_METHOD).group(1).split("|")
    return reduce(lambda a, b: a | b, [message.contains(verb) for verb in verbs])


def http_method(message: Column) -> Column:
    return F.when(_has_verb(message), tx.first_match(message, tx.UNICODE + fv.HTTP_METHOD))


def http_path(message: Column) -> Column:
    return F.when(_has_verb(message), tx.first_match(message, tx.UNICODE + fv.HTTP_PATH, 1))


def http_status(level: Column | None, message: Column) -> Column:
    """The level if it is a three-digit number, else the first in the message."""
    in_message = tx.first_match(message, tx.UNICODE + fv.HTTP_STATUS, 1)
    if level is None:
        return in_message
    return F.when(level.rlike(tx.UNICODE + fv.LEVEL_IS_STATUS), F.trim(level)).otherwise(
        in_message
    )


def response_time_ms(message: Column) -> Column:
    """The first named duration in milliseconds; a bare number is taken as such."""
    assigned = message.contains("=") | message.contains(":")
    pattern = tx.UNICODE_NO_CASE + fv.RESPONSE_TIME
    # The match is bound to a lambda, so the message is searched once.
    found = F.array(F.when(assigned, F.regexp_extract(message, pattern, 0)))

    def milliseconds(match: Column) -> Column:
        number = F.regexp_extract(match, r"([0-9]*\.?[0-9]+)\s*[A-Za-z]*$", 1)
        unit = F.lower(F.regexp_extract(match, r"([A-Za-z]*)$", 1))
        factor = F.when(unit.isin("s", "sec", "seconds"), 1000.0).otherwise(1.0)
        return F.when(match != "", number.try_cast("double") * factor)

    return F.get(F.transform(found, milliseconds), F.lit(0))


def user_id(message: Column) -> Column:
    return tx.first_match(message, tx.UNICODE_NO_CASE + fv.USER_ID, 1)


def first_ipv4(message: Column) -> Column:
    return F.when(message.contains("."), tx.first_match(message, tx.UNICODE + fv.IPV4))


def _first_named(text: Column, table) -> Column:
    case = F
    for name, pattern in table:
        case = case.when(text.rlike(tx.UNICODE_NO_CASE + pattern), F.lit(name))
    return case.otherwise(F.lit(fv.UA_OTHER))


def user_agent(agent: Column) -> Column:
    """``browser``, ``os`` and ``device`` as a struct; "Other" where unknown."""
    return F.struct(
        _first_named(agent, fv.UA_BROWSERS).alias("browser"),
        _first_named(agent, fv.UA_SYSTEMS).alias("os"),
        _first_named(agent, fv.UA_DEVICES).alias("device"),
    )


def redact_pii(text: Column) -> Column:
    """E-mail addresses, then IPv4 addresses, UUIDs and tokens, by name.

    A step is skipped where the text lacks what its matches always hold. The
    names put in hold none of it, so the test is on the text as it came.
    """
    steps = (
        (fv.EMAIL, "<email>", ["@"]),
        (fv.IPV4, "<ip>", ["."]),
        (fv.UUID, "<uuid>", ["-"]),
        (fv.TOKEN, "<token>", ["eyJ", "AKIA", "AIza"]),
    )
    redacted = text
    for pattern, name, needed in steps:
        possible = reduce(lambda a, b: a | b, [text.contains(part) for part in needed])
        replaced = F.regexp_replace(redacted, tx.UNICODE + pattern, name)
        redacted = F.when(possible, replaced).otherwise(redacted)
    return redacted
