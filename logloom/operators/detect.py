"""Telling which format each source is written in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text as tx
from ..plans.workspace import work_folder
from .ordering import SOURCE_KEY, with_source_key

#: Cloud and container exports are JSON too, so they are asked for first.
_SPECIFIC_FIRST = (
    "custom",
    "syslog",
    "apache",
    "apache_modjk",
    "tomcat_connector",
    "kubernetes_json",
    "cloudwatch_export",
    "gcp_cloud_logging",
    "docker_json",
    "json",
    "windows_event_xml",
)
_SALTS = 64
#: Detected formats (a path and a name each) are broadcast up to this count.
BROADCAST_SOURCES = 100_000


def format_order(order: str = "specific") -> tuple[str, ...]:
    """Formats by priority: ``specific`` first, or the ``reference`` order in
    which plain JSON stands before the exports that are also JSON."""
    if order not in ("specific", "reference"):
        raise ValueError("order is 'specific' or 'reference'")
    return _SPECIFIC_FIRST if order == "specific" else tuple(fv.FORMAT_PATTERNS)


def line_priority(line: Column, order: str = "specific") -> Column:
    """Position, in the order, of the first format the line fits; NULL if none."""
    names = format_order(order)
    text = tx.strip(line)
    case = F
    for position, name in enumerate(names):
        pattern = tx.UNICODE + "^(?:" + fv.FORMAT_PATTERNS[name] + ")"
        case = case.when(text.rlike(pattern), F.lit(position))
    return case


def detect_formats(
    lines: DataFrame,
    order: str = "specific",
    sample_lines: int = fv.DETECTION_LINES,
) -> DataFrame:
    """One row per source: ``source``, ``format``.

    A source has the first format in the order that any of its first lines
    fits. Only the first lines are matched: a row-number limit that Spark
    applies before the shuffle finds them, in two steps, per source and input
    partition group, then per source, so that a huge source does not meet in
    one task.
    """
    first = with_source_key(lines).select(
        *SOURCE_KEY,
        "source",
        "line_id",
        "value",
        (F.spark_partition_id() % _SALTS).alias("part"),
    )
    for keys in ([*SOURCE_KEY, "part"], SOURCE_KEY):
        window = Window.partitionBy(*keys).orderBy("line_id")
        first = first.withColumn("n", F.row_number().over(window)).filter(
            F.col("n") <= sample_lines
        )
    names = F.array(*[F.lit(n) for n in format_order(order)])
    best = F.get(names, F.min("priority"))
    first = first.withColumn("priority", line_priority(F.col("value"), order))
    return first.groupBy("source").agg(
        F.coalesce(best, F.lit(fv.FALLBACK_FORMAT)).alias("format")
    )


def detect_format(lines: DataFrame, order: str = "specific") -> str:
    """The format of a table that holds a single source. Runs a job."""
    row = detect_formats(lines.withColumn("source", F.lit("")), order).first()
    return row["format"] if row else fv.FALLBACK_FORMAT


def found_formats(
    lines: DataFrame, order: str = "specific", sample_lines: int = fv.DETECTION_LINES
) -> DataFrame:
    """The rows of ``detect_formats``, written to the job's folder and read again.

    Detection runs once, here; nothing stays in memory for the session.
    """
    spark = lines.sparkSession
    folder = work_folder(spark, "formats")
    detected = detect_formats(lines, order, sample_lines)
    detected.write.parquet(folder)
    return spark.read.schema(detected.schema).parquet(folder)


def with_format(
    lines: DataFrame,
    order: str = "specific",
    broadcast_sources: int = BROADCAST_SOURCES,
    sample_lines: int = fv.DETECTION_LINES,
    formats: DataFrame | None = None,
) -> DataFrame:
    """The lines with the detected format of their source.

    ``formats`` are rows of ``found_formats``, which otherwise runs here as a
    job of its own. Its rows, one per source, are counted: only a table of at
    most ``broadcast_sources`` rows is broadcast. Beyond that the join
    shuffles, and the adaptive planner splits partitions of a source with too
    many lines.
    """
    if formats is None:
        formats = found_formats(lines, order, sample_lines)
    few = formats.count() <= broadcast_sources
    return lines.join(F.broadcast(formats) if few else formats, "source", "left").withColumn(
        "format", F.coalesce("format", F.lit(fv.FALLBACK_FORMAT))
    )


def is_structured(name: Column | str = "format") -> Column:
    """Formats whose lines are whole records and are never stitched."""
    return (F.col(name) if isinstance(name, str) else name).isin(*fv.STRUCTURED_FORMATS)
