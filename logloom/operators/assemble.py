"""Stitching lines into records: stack traces and other continued entries.

A record starts at a line that looks like a start; all lines up to the next
start belong to it, and lines before the first start form a record too.

Lines are grouped by chunks of at most 2**14 line numbers, so no task holds a
whole file. Within a chunk one window and one aggregation on the same
partitioning build the records. Only the pieces at chunk borders, at most two
per chunk, are shuffled again to be joined to what they continue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text as tx
from .detect import is_structured
from .ordering import SOURCE_KEY, chunk, with_source_key

CHUNK_KEY = (*SOURCE_KEY, "chunk")
#: Lines without a number are counted from here; numbers are above half of it.
_UNNUMBERED = -(1 << 62)


def starts_record(line: Column) -> Column:
    return line.rlike(tx.UNICODE + fv.RECORD_START)


def _pieces(lines: DataFrame, is_start: Column) -> DataFrame:
    """Runs of lines between starts within one chunk; run 0 has no start.

    Only a line's number and text travel. What is the same for all lines of a
    source, its path first of all, comes back from the table of chunks.
    """
    in_chunk = Window.partitionBy(*CHUNK_KEY).orderBy("line_id")
    whole = in_chunk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = lines.select(
        *CHUNK_KEY, "line_id", "value", is_start.cast("int").alias("start")
    ).withColumns({"run": F.sum("start").over(in_chunk), "last_run": F.sum("start").over(whole)})
    # last_run is a key only so that filters on it move below the aggregation.
    return numbered.groupBy(*CHUNK_KEY, "run", "last_run").agg(
        F.min("line_id").alias("first_line"), _in_order("line_id").alias("value")
    )


def _in_order(number: str) -> Column:
    ordered = F.sort_array(F.collect_list(F.struct(number, "value")))
    return F.array_join(F.transform(ordered, lambda x: x["value"]), "\n")


def _chunks(lines: DataFrame, is_start: Column, same: list[str]) -> DataFrame:
    """One row per chunk: its source, and the record running into it.

    ``owner`` is the first line of that record: the last start in an earlier
    chunk, or the first line of the source where there is none. Texts are keys
    of the first aggregation, as only numbers can be aggregated by hash before
    the shuffle.
    """
    chunks = (
        lines.select(*CHUNK_KEY, *same, "line_id", is_start.alias("start"))
        .groupBy(*CHUNK_KEY, *same)
        .agg(
            F.max(F.when(F.col("start"), F.col("line_id"))).alias("last_start"),
            F.min("line_id").alias("first_line"),
        )
        .groupBy(*CHUNK_KEY)
        .agg(
            F.max("last_start").alias("last_start"),
            F.min("first_line").alias("source_start"),
            *[F.first(c).alias(c) for c in same],
        )
    )
    in_source = Window.partitionBy(*SOURCE_KEY).orderBy("chunk")
    before = in_source.rowsBetween(Window.unboundedPreceding, -1)
    return chunks.select(
        *CHUNK_KEY,
        *same,
        F.coalesce(
            F.max("last_start").over(before), F.min("source_start").over(in_source)
        ).alias("owner"),
    )


def assemble_records(lines: DataFrame, start: Column | None = None) -> DataFrame:
    """Lines (``source, line_id, value``) to records (``source, record_id, value``).

    ``record_id`` is the ``line_id`` of the record's first line. A record is
    one row, however many chunks it runs over: its text is one value, and
    Spark fails rather than cut it if it outgrows what a value holds (2 GB).
    ``format`` and ``modified``, which do not vary within a source, are kept if
    present. Lines without a number come before all others of their source, in the
    order they are read, and records that start there have none.
    """
    is_start = starts_record(F.col("value")) if start is None else start
    same = ["source"] + [c for c in ("format", "modified") if c in lines.columns]
    number = F.coalesce("line_id", F.lit(_UNNUMBERED) + F.monotonically_increasing_id())
    lines = with_source_key(lines.withColumn("line_id", number)).withColumn("chunk", chunk("line_id"))
    pieces = _pieces(lines, is_start)
    chunks = _chunks(lines, is_start, same)
    at_border = (F.col("run") == 0) | (F.col("run") == F.col("last_run"))

    # The pieces lie by chunk already, so this join moves only the chunks.
    inner = (
        pieces.filter(~at_border)
        .join(chunks.hint("shuffle_hash"), [*CHUNK_KEY])
        .select(*same, F.col("first_line").alias("record_id"), "value")
    )
    continues = F.col("run") == 0
    border = (
        pieces.filter(at_border)
        .join(chunks.hint("shuffle_hash"), [*CHUNK_KEY])
        .select(
            *SOURCE_KEY,
            *same,
            F.when(continues, F.col("owner")).otherwise(F.col("first_line")).alias("record_id"),
            "first_line",
            "value",
        )
        .groupBy(*SOURCE_KEY, "record_id")
        .agg(*[F.first(c).alias(c) for c in same], _in_order("first_line").alias("value"))
    )
    records = inner.unionByName(border.select(inner.columns))
    return records.withColumn("record_id", F.when(F.col("record_id") >= _UNNUMBERED // 2, F.col("record_id")))


def records_of(lines: DataFrame) -> DataFrame:
    """Lines with a ``format`` column to records, each format its own way.

    Lines of structured formats are records already and skip the shuffle;
    Windows events are stitched at ``<Event``; all others, and rows without a
    format, at a record start.
    """
    lines = lines.withColumn("format", F.coalesce("format", F.lit(fv.FALLBACK_FORMAT)))
    fmt = F.col("format")
    windows = fmt == "windows_event_xml"
    as_is = lines.filter(is_structured() & ~windows).withColumnRenamed("line_id", "record_id")
    stitched = lines.filter(~is_structured() | windows)
    start = F.when(windows, F.col("value").rlike(tx.UNICODE + fv.XML_EVENT_START)).otherwise(
        starts_record(F.col("value"))
    )
    return as_is.unionByName(assemble_records(stitched, start))
