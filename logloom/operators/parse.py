"""The registry of formats, and parsing of whole tables by it."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..schema import LOG_SCHEMA
from .assemble import assemble_records
from .parse_connector import modjk_records, tomcat_records
from .parse_json import (
    cloudwatch_records,
    docker_records,
    gcp_records,
    json_records,
    kubernetes_records,
)
from .parse_text import access_records, custom_records, generic_records, syslog_records
from .parse_xml import windows_event_records


@dataclass(frozen=True)
class ParseOptions:
    """What a parser may need beyond the text of a record."""

    timestamp_format: str | None = None
    year: Column | None = None
    modified: Column | None = None
    first_line_only: bool = False


RecordParser = Callable[[Column, ParseOptions], Column]
TableParser = Callable[..., DataFrame]


@dataclass(frozen=True)
class Format:
    """A log format: either a Column over one record, or a table function."""

    description: str
    records: RecordParser | None = None
    table: TableParser | None = None
    supports_config: bool = False
    config_keys: list[str] = field(default_factory=list)

    def info(self) -> dict[str, Any]:
        return {
            "description": self.description,
            "supports_config": self.supports_config,
            "config_keys": list(self.config_keys),
        }


_TIME = ["timestamp_format"]

FORMATS: dict[str, Format] = {
    "custom": Format(
        "Bracketed lines: [timestamp] [level] [module] message",
        custom_records, supports_config=True, config_keys=_TIME,
    ),
    "json": Format("JSON objects, one per line", json_records),
    "syslog": Format("System log: Mon DD HH:MM:SS host tag[pid]: message", syslog_records),
    "apache": Format("Web access log, Combined or Common", access_records),
    "apache_modjk": Format(
        "Connector log: [timestamp] [severity] message",
        modjk_records, supports_config=True, config_keys=_TIME,
    ),
    "tomcat_connector": Format(
        "Servlet connector log: timestamp.millis [severity] message",
        tomcat_records, supports_config=True, config_keys=_TIME,
    ),
    "docker_json": Format("Container JSON file driver", docker_records),
    "kubernetes_json": Format("Pod JSON with cluster metadata", kubernetes_records),
    "cloudwatch_export": Format("Log group export as JSON", cloudwatch_records),
    "gcp_cloud_logging": Format("Cloud logging export as JSON", gcp_records),
    "windows_event_xml": Format("Windows event XML", windows_event_records),
    "generic": Format("Any text; time, level and address are looked for", generic_records),
}
BUILT_IN_FALLBACK = FORMATS[fv.FALLBACK_FORMAT]


def get_supported_formats() -> list[str]:
    return list(FORMATS)


def get_format_info(name: str) -> dict[str, Any] | None:
    return FORMATS[name].info() if name in FORMATS else None


def get_all_format_info() -> dict[str, dict[str, Any]]:
    return {name: fmt.info() for name, fmt in FORMATS.items()}


def register_parser(
    name: str,
    parser: TableParser,
    description: str = "",
    supports_config: bool = False,
    config_keys: list[str] | None = None,
) -> None:
    """Add a format. ``parser(lines)`` gets and returns a DataFrame.

    With ``supports_config`` it is called as ``parser(lines, config)``. Columns
    of ``LOG_SCHEMA`` it does not return become NULL; others it adds are kept.
    """
    FORMATS[name] = Format(
        description,
        table=parser,
        supports_config=supports_config,
        config_keys=list(config_keys or []),
    )


def unregister_parser(name: str) -> None:
    FORMATS.pop(name, None)


def from_rows(
    func: Callable[[Iterator[str]], pd.DataFrame],
    schema: T.StructType | str,
    starts: Callable[[Column], Column] | None = None,
) -> TableParser:
    """Make a table parser of a Python function over an iterator of lines.

    This is the one way to run Python per line, for parsers that cannot be
    written as Columns. ``schema`` lists what ``func`` returns.

    Without ``starts``, ``func`` sees the lines of one Arrow batch at a time, in
    no promised order, so it must not carry state from line to line. If it
    returns a column ``line``, the place (from 0) of the line a row was made of
    in what it was given, rows keep that line's ``source`` and ``record_id``.

    ``starts(value)`` is true for lines that a parser's state begins anew at. A
    unit runs from such a line (or the first of a source) to the next one;
    ``func`` is called once per unit with all its lines in order, wherever
    chunks, blocks and batches end, and may keep state within it. Rows have
    the ``source`` of their unit and the number of its first line. Units are
    stitched as records are, so a source is never in one task; a unit is.
    Missing lines take no part then.
    """
    returned = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names = returned.names
    # Numbers travel as text: pandas makes doubles of longs beside missing ones.
    origin = [n for n in ("source", "record_id") if n not in names]
    whole = T.StructType([T.StructField(n, T.StringType()) for n in origin] + list(returned.fields))

    def beside(of: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """Rows and where they are from; a column that ``func`` returns is its own."""
        return pd.concat([of[origin], rows.reindex(columns=names)], axis=1)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = func(iter(frame["value"].tolist())).reset_index(drop=True)
            if len(rows):
                # A place that no line has, -1 above all, gives a row without origin.
                at = rows["line"].tolist() if "line" in rows else [-1] * len(rows)
                yield beside(frame.reset_index(drop=True).reindex(at).reset_index(drop=True), rows)

    def units(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for source, number, value in zip(frame["source"], frame["record_id"], frame["value"]):
                rows = func(iter(value.split("\n"))).reset_index(drop=True)
                if len(rows):
                    yield beside(pd.DataFrame({"source": source, "record_id": number}, index=rows.index), rows)

    def table(lines: DataFrame) -> DataFrame:
        lines = lines.select(*_origin(lines), "value")
        if starts is not None:
            numbered = lines.filter(F.col("value").isNotNull()).withColumnRenamed("record_id", "line_id")
            lines = assemble_records(numbered, starts(F.col("value")))
        text = lines.select("source", F.col("record_id").cast("string").alias("record_id"), "value")
        rows = text.mapInPandas(batches if starts is None else units, whole)
        return rows.withColumn("record_id", F.col("record_id").cast("long")) if "record_id" in origin else rows

    return table


def _with_log_columns(df: DataFrame, name: str) -> DataFrame:
    if "format" not in df.columns:
        df = df.withColumn("format", F.lit(name))
    present = [
        F.col(f.name).cast(f.dataType).alias(f.name)
        if f.name in df.columns
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in LOG_SCHEMA.fields
    ]
    extra = [c for c in df.columns if c not in LOG_SCHEMA.names]
    return df.select(*present, *extra)


def _origin(df: DataFrame) -> list[Column]:
    """Source and record number of a table of lines or of assembled records."""
    number = next((c for c in ("record_id", "line_id") if c in df.columns), None)
    return [
        (F.col("source") if "source" in df.columns else F.lit(None).cast("string")).alias(
            "source"
        ),
        (F.col(number) if number else F.lit(None).cast("bigint")).alias("record_id"),
    ]


def parse(
    df: DataFrame,
    format: str | None = None,
    config: dict[str, str] | None = None,
    *,
    year: int | None = None,
    first_line_only: bool = False,
    among: Collection[str] | None = None,
) -> DataFrame:
    """Parse a table with a ``value`` column into ``LOG_SCHEMA``.

    Without ``format`` each row is parsed by its own ``format`` column, in one
    pass over the table; missing and unknown names are parsed as free text.
    ``among`` names all formats in that column where they are known, so that
    the plan holds no parser for others. ``config``
    holds ``timestamp_format`` (strftime) for formats that take it. ``year``
    completes times that have none.
    """
    by_row = format is None
    if by_row and "format" not in df.columns:
        raise ValueError("give a format, or a table with a format column")
    if not by_row and format not in FORMATS:
        format = fv.FALLBACK_FORMAT

    if not by_row and FORMATS[format].table:
        fmt = FORMATS[format]
        args = (df, config) if config and fmt.supports_config else (df,)
        return _with_log_columns(fmt.table(*args), format)

    def options(fmt: Format) -> ParseOptions:
        return ParseOptions(
            timestamp_format=(config or {}).get("timestamp_format")
            if fmt.supports_config
            else None,
            year=F.lit(year) if year is not None else None,
            modified=F.col("modified") if "modified" in df.columns else None,
            first_line_only=first_line_only,
        )

    if not by_row:
        fmt = FORMATS[format]
        rows = fmt.records(F.col("value"), options(fmt))
        return df.select(
            *_origin(df), F.lit(format).alias("format"), F.inline(rows)
        )

    df = df.withColumn("format", F.coalesce("format", F.lit(fv.FALLBACK_FORMAT)))
    there = {n: f for n, f in FORMATS.items() if among is None or n in {*among, fv.FALLBACK_FORMAT}}
    built_in = {n: f for n, f in there.items() if f.records}
    tables = [n for n, f in there.items() if f.table]
    # Where free text has a table parser of its own, its rows and those of unknown names go there.
    fallback = built_in.get(fv.FALLBACK_FORMAT)
    if fallback is None:
        known = F.col("format").isin(*FORMATS)
        df = df.withColumn("format", F.when(known, F.col("format")).otherwise(fv.FALLBACK_FORMAT))
        fallback = BUILT_IN_FALLBACK
    free_text = fallback.records(F.col("value"), options(fallback))
    others = [i for i in built_in.items() if i[0] != fv.FALLBACK_FORMAT]
    chosen = reduce(
        lambda case, item: case.when(
            F.col("format") == item[0], item[1].records(F.col("value"), options(item[1]))
        ),
        others,
        F,
    ).otherwise(free_text) if others else free_text
    rest = df.filter(~F.col("format").isin(tables)) if tables else df
    parsed = rest.select(*_origin(df), "format", F.inline(chosen))
    for name in tables:
        own = parse(df.filter(F.col("format") == name), name, config)
        parsed = parsed.unionByName(own, allowMissingColumns=True)
    return parsed
