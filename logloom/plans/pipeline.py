"""From files of log text to an enriched log table, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.assemble import records_of
from ..functions import fixed_values as fv
from ..operators.detect import found_formats, with_format
from ..operators.enrich import add_enrichments
from ..operators.ordering import max_lines as first_lines
from ..operators.parse import FORMATS, parse
from ..operators.redact import add_redacted
from ..sources.lines import read_lines, read_windows_events


def logs_from_lines(
    lines: DataFrame,
    format: str | None = None,
    *,
    max_lines: int = 0,
    config: dict[str, str] | None = None,
    year: int | None = None,
    order: str = "specific",
    enrich: bool = True,
    redact: bool = False,
    sample_lines: int = fv.DETECTION_LINES,
    first_line_only: bool = False,
    preserve_parsed: bool = False,
    ip_mode: str = "row",
    whole_records: bool = False,
) -> DataFrame:
    """Detect, stitch, parse, enrich and perhaps redact a table of lines.

    Every source gets its own format unless ``format`` names one for all.
    Formats are told from the first ``sample_lines`` lines of a source;
    ``max_lines`` caps what is then parsed. The formats found, at most as many
    as there are, decide which parsers the plan holds. With ``whole_records``
    every line of a named format is a record, and none is stitched.
    """
    options = {"year": year, "first_line_only": first_line_only}
    if format is None:
        formats = found_formats(lines, order, sample_lines)
        among = [r["format"] for r in formats.select("format").distinct().collect()]
        named = first_lines(with_format(lines, formats=formats), max_lines)
        logs = parse(records_of(named), None, config, among=among, **options)
    elif format in FORMATS and FORMATS[format].table is not None:
        logs = parse(first_lines(lines, max_lines), format, config)
    else:
        named = first_lines(lines, max_lines).withColumn("format", F.lit(format))
        logs = parse(named if whole_records else records_of(named), format, config, **options)
    if enrich:
        logs = add_enrichments(logs, preserve_parsed=preserve_parsed, ip_mode=ip_mode)
    return add_redacted(logs) if redact else logs


def load_logs(
    spark: SparkSession,
    path: str | list[str],
    format: str | None = None,
    *,
    encoding: str = "utf-8",
    **options,
) -> DataFrame:
    """A directory, file or glob of log text as a log table.

    ``options`` are those of ``logs_from_lines``. Windows events are read event
    by event, or by lines where ``max_lines`` counts them, with the same rows.
    """
    if format == "windows_event_xml" and not options.get("max_lines"):
        events = read_windows_events(spark, path, encoding)
        return logs_from_lines(events, format, **{**options, "whole_records": True})
    return logs_from_lines(read_lines(spark, path, encoding), format, **options)
