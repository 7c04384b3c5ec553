"""Detection and stitching on a stream of files.

What a source's format is shows in its first lines, and where its last record
ends shows in the lines that follow, so both may have to wait for a later file.
A batch therefore keeps, as a version of three tables, the formats that are
known, all lines of sources whose format isn't, and the open record of each
other source, the one that the next file may continue. The next batch reads them
as lines before its own. All of it is planned by Spark like a bounded table:
lines are stitched in bounded chunks, so a source with most of the lines is cut
up as well, and the state is one record or some fifty lines per source.

A source is a file, or what ``source`` makes of a file's path, such as its
folder where a log is rotated over many files. Files of a source follow each
other by batch, then by the time of their last change, then by path; with
``by_name`` by batch, then by path, for files that were written side by side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import fixed_values as fv
from ..functions import text as tx
from ..operators.assemble import records_of, starts_record
from ..operators.detect import format_order, is_structured, line_priority
from ..operators.enrich import add_enrichments
from ..operators.parse import parse
from ..operators.redact import add_redacted
from ..sources.lines import clean, line_number
from . import versions

#: Bits of a number: a file's rank in its source, and the line within the file.
_FILE_BITS, _NUMBER_BITS = 15, 48
_LINES = "source string, path string, modified timestamp, batch bigint, line_id bigint, value string"
_KNOWN = "source string, format string, modified timestamp"
_FILE = ("source", "path", "batch")


def file_of(path: Column) -> Column:
    """Every file is a source of its own."""
    return path


def folder_of(path: Column) -> Column:
    """The files of a folder are one source."""
    return F.regexp_replace(path, r"/[^/]*$", "")


def stream_blocks(spark: SparkSession, path: str, encoding: str = "utf-8", **options: str) -> DataFrame:
    """Lines of the files arriving in a directory, with the block they stand in."""
    return (
        spark.readStream.options(lineSep="\n", **options)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.col("_metadata.file_modification_time").alias("modified"),
            clean(F.col("value"), encoding).alias("value"),
        )
    )


def _is_xml() -> Column:
    return F.col("format") == "windows_event_xml"


def _heads(lines: DataFrame, files: DataFrame, sample_lines: int, order: str) -> DataFrame:
    """``source``, ``format`` and ``sampled``, by the first lines of sources that have no format yet."""
    first = lines.select(*_FILE, "line_id", "value")
    in_file = Window.partitionBy(*_FILE).orderBy("line_id")
    first = first.withColumn("n", F.row_number().over(in_file)).filter(F.col("n") <= sample_lines)
    first = first.join(files.filter("format IS NULL").select(*_FILE, "rank"), [*_FILE])
    in_source = Window.partitionBy("source").orderBy("rank", "line_id")
    first = first.withColumn("n", F.row_number().over(in_source)).filter(F.col("n") <= sample_lines)
    names = F.array(*[F.lit(n) for n in format_order(order)])
    return (
        first.withColumn("priority", line_priority(F.col("value"), order))
        .groupBy("source")
        .agg(F.min("priority").alias("priority"), F.count(F.lit(1)).alias("sampled"))
        .select("source", F.coalesce(F.get(names, F.col("priority")), F.lit(fv.FALLBACK_FORMAT)).alias("format"), "sampled")
    )


def _files(lines: DataFrame, known: DataFrame, by_name: bool) -> DataFrame:
    """One row per file: its ``rank`` in the source, the source's ``format`` if it
    is known, and the last line that starts a record, by either rule."""
    value = F.col("value")
    per_file = lines.groupBy(*_FILE).agg(
        F.max("modified").alias("modified"),
        F.min("line_id").alias("first"),
        F.max(F.when(starts_record(value), F.col("line_id"))).alias("start"),
        F.max(F.when(value.rlike(tx.UNICODE + fv.XML_EVENT_START), F.col("line_id"))).alias("xml_start"),
    )
    times = [] if by_name else ["modified"]
    order = Window.partitionBy("source").orderBy("batch", *times, "path")
    rank = F.row_number().over(order) - 1
    limit = F.raise_error(F.lit("too many files of one source in a batch: set maxFilesPerTrigger"))
    rank = F.when(rank < (1 << _FILE_BITS), rank.cast("bigint")).otherwise(limit)
    return per_file.withColumn("rank", rank).join(known, "source", "left")


def _with_open(files: DataFrame, closing: Column) -> DataFrame:
    """The files with ``open``, the number at which their source's open record
    starts: none for formats whose lines are records, and where ``closing``."""
    start = F.when(_is_xml(), F.col("xml_start")).otherwise(F.col("start"))
    number = lambda line: F.shiftleft(F.col("rank"), _NUMBER_BITS) + line
    in_source = Window.partitionBy("source")
    last = F.coalesce(F.max(number(start)).over(in_source), F.min(number(F.col("first"))).over(in_source))
    as_is = is_structured() & ~_is_xml()
    newest = F.max("modified").over(in_source)
    return files.withColumn("open", F.when(~as_is & ~closing_at(closing, newest), last))


def closing_at(closing: Column, newest: Column) -> Column:
    """Whether a source whose newest file is of ``newest`` is done; never where ``closing`` is null."""
    return F.coalesce(newest < closing, F.lit(False))


def _numbered(lines: DataFrame, files: DataFrame) -> DataFrame:
    """The lines with their number in the source, its format and its open record."""
    info = files.select(*_FILE, "rank", "format", "open")
    number = F.shiftleft(F.col("rank"), _NUMBER_BITS) + F.col("line_id")
    return lines.join(info, [*_FILE]).withColumn("number", number)


def _parsed(lines: DataFrame, formats: list[str], year: int | None, redact: bool) -> DataFrame:
    """The records of numbered lines as a log table."""
    given = lines.select("source", "format", F.col("number").alias("line_id"), "value")
    logs = add_enrichments(parse(records_of(given), None, among=formats, year=year))
    return add_redacted(logs) if redact else logs


def to_records(
    blocks: DataFrame,
    path: str,
    state: str,
    checkpoint: str,
    *,
    source: Callable[[Column], Column] = file_of,
    by_name: bool = False,
    order: str = "specific",
    sample_lines: int = fv.DETECTION_LINES,
    idle_seconds: int | None = None,
    year: int | None = None,
    redact: bool = False,
) -> DataStreamWriter:
    """Keeps the log table of a stream of ``stream_blocks``, as ``read_records`` gives it.

    The rows are those of ``load_logs`` over all files: formats are told from a
    source's first ``sample_lines`` lines, wherever they end, and a record goes
    on over as many files and batches as it has. Finished records are written
    once, a folder per batch. With ``idle_seconds`` a source that has been quiet
    for so long, against the newest file, is finished and leaves the state.
    ``path``, ``state`` and ``checkpoint`` belong together.
    """

    def advance(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = versions.before(spark, state, number)
        known = versions.read(spark, state, earlier, "known", _KNOWN)
        waiting = versions.read(spark, state, earlier, "lines", _LINES)
        new = batch.select(
            source(F.col("path")).alias("source"), "path", "modified", F.lit(number).cast("bigint").alias("batch"),
            line_number(spark, F.col("block"), _NUMBER_BITS).alias("line_id"), "value",
        )
        lines = waiting.unionByName(new)
        files = versions.write(_files(lines, known.drop("modified"), by_name), state, number, "files")
        limit = F.lit(None).cast("timestamp")
        if idle_seconds is not None and (newest := files.agg(F.max("modified")).first()[0]):
            limit = F.lit(newest) - F.make_dt_interval(secs=F.lit(idle_seconds))
        done = closing_at(limit, F.max("modified").over(Window.partitionBy("source")))
        quiet = files.select("source", done.alias("done")).filter("done").select("source").distinct()
        heads = versions.write(_heads(lines, files, sample_lines, order), state, number, "heads")
        told = heads.join(quiet.withColumn("done", F.lit(True)), "source", "left")
        told = told.filter((F.col("sampled") >= sample_lines) | F.col("done")).select("source", "format")
        seen = files.groupBy(F.col("source").alias("_source")).agg(F.max("modified").alias("_seen"))
        told = known.unionByName(told.withColumn("modified", F.lit(None).cast("timestamp")))
        told = told.join(seen, F.col("source") == F.col("_source"), "left").withColumn("modified", F.greatest("modified", "_seen"))
        told = versions.write(told.drop("_source", "_seen"), state, number, "told")
        files = versions.write(_with_open(files.drop("format").join(told.drop("modified"), "source", "left"), limit), state, number, "open")

        numbered = _numbered(lines, files)
        formats = [r[0] for r in told.select("format").distinct().collect()]
        closed = numbered.filter("format IS NOT NULL AND (open IS NULL OR number < open)")
        _parsed(closed, formats, year, redact).write.mode("overwrite").parquet(f"{path}/batch_id={number}")

        # The open record is one line of the next batch, before all others.
        kept = numbered.filter("format IS NULL").select(lines.columns)
        record = F.sort_array(F.collect_list(F.struct("number", "value")))
        begun = (
            numbered.filter("number >= open")
            .groupBy("source")
            .agg(
                F.min(F.struct("number", "path", "line_id")).alias("at"),
                F.max("modified").alias("modified"),
                F.array_join(F.transform(record, lambda x: x["value"]), "\n").alias("value"),
            )
            .select("source", "at.path", "modified", F.lit(-1).cast("bigint").alias("batch"), "at.line_id", "value")
        )
        versions.write(kept.unionByName(begun), state, number, "lines")
        versions.write(told.filter(~closing_at(limit, F.col("modified"))), state, number, "known")
        versions.commit(spark, state, number)

    return blocks.writeStream.foreachBatch(advance).option("checkpointLocation", checkpoint)


def read_records(
    spark: SparkSession,
    path: str,
    state: str,
    *,
    by_name: bool = False,
    order: str = "specific",
    sample_lines: int = fv.DETECTION_LINES,
    year: int | None = None,
    redact: bool = False,
    finished: bool = False,
) -> DataFrame:
    """The log table of all batches that are done, with the records still open as
    they stand, or the ``finished`` ones only. The options are those of ``to_records``."""
    last = versions.committed(spark, state)[-1]
    closed = spark.read.parquet(path).filter(F.col("batch_id") <= last).drop("batch_id")
    if finished:
        return closed
    known = versions.read(spark, state, last, "known", _KNOWN).drop("modified")
    lines = versions.read(spark, state, last, "lines", _LINES)
    files = _files(lines, known, by_name)
    told = _heads(lines, files, sample_lines, order).select("source", "format")
    known = known.unionByName(told)
    formats = [r[0] for r in known.select("format").distinct().collect()]
    files = files.drop("format").join(known, "source", "left").withColumn("open", F.lit(None).cast("bigint"))
    return closed.unionByName(_parsed(_numbered(lines, files), formats, year, redact).select(closed.columns))
