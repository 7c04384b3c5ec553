"""Text helpers shared by the parsers and the enrichment columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv

#: Unicode classes; only a newline ends a line.
UNICODE = "(?dU)"
#: The same without regard to case.
UNICODE_NO_CASE = "(?idU)"

# Marks a rewritten record; the captures follow it, one per line.
_MARK = "\x01\x02"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(fv.WHITESPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(fv.WHITESPACE))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    """Translate ``key`` by a small constant table."""
    entries = [F.lit(part) for pair in table.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), key), default)


def captures(text: Column, pattern: str, groups: int) -> Column:
    """All capture groups of ``pattern`` in one regular-expression pass.

    ``pattern`` has to consume the whole text, and only its last group may hold
    newlines. The result is an array with one element (the groups, with index
    0 unused) where the text matches and an empty array where it does not, so
    that ``inline``/``explode`` drop the rest without a second match.
    """
    rewritten = F.regexp_replace(
        text, pattern, _MARK + "".join(f"\n${i}" for i in range(1, groups + 1))
    )
    pieces = F.split(rewritten, "\n", groups + 1)
    return F.filter(
        F.array(pieces), lambda p: (F.get(p, F.lit(0)) == _MARK) & (F.size(p) == groups + 1)
    )


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """A group of the first match; NULL where nothing (or only '') matched."""
    if group == 0:
        return F.regexp_substr(text, F.lit(pattern))
    return blank_to_null(F.regexp_extract(text, pattern, group))
