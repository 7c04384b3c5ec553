"""Reading log text: directories of files, streams of files, tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The low bits of a line id count lines within an input partition; the bits
# above tell the file's blocks apart.
_LINE_BITS = 33


def clean(value: Column, encoding: str) -> Column:
    """Decoded text; bytes that are not UTF-8 are dropped."""
    if encoding.lower().replace("-", "") != "utf8":
        return F.decode(value.cast("binary"), encoding)
    repaired = F.regexp_replace(F.make_valid_utf8(value), "�", "")
    return F.when(F.is_valid_utf8(value), value).otherwise(repaired)


def _bytes(size: str) -> int:
    """A size as Spark's settings write it: 134217728, 128m, 128MB."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)i?b?\s*", size.lower()).groups()
    return int(number) * 1024 ** ("kmgtp".index(unit) + 1 if unit else 0)


def line_number(spark: SparkSession, block_start: Column, bits: int) -> Column:
    """A number of ``bits`` bits that orders the lines of a file, also across its blocks.

    Spark numbers rows within an input partition, and a partition reads each
    block in order, so block start and row number together give the order
    without a shuffle. A block is never smaller than the lesser of the two
    sizes below, so its start divided by that tells it from all others. Where
    fewer bits are asked for than a file's number may have, rows have as many
    as a partition has bytes.
    """
    most = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    least = min(most, _bytes(spark.conf.get("spark.sql.files.openCostInBytes")))
    rows = _LINE_BITS if bits == 63 else most.bit_length()
    block = F.shiftright(block_start, max(least.bit_length() - 1, 0))
    # All the bits that Spark itself has for the rows of a partition.
    in_partition = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _LINE_BITS) - 1))
    fits = (block < (1 << (bits - rows))) & (in_partition < (1 << rows))
    return F.when(fits, F.shiftleft(block, rows) + in_partition).otherwise(
        F.raise_error(F.lit("too many blocks in a file to number its lines"))
    )


def _line_id(spark: SparkSession) -> Column:
    return line_number(spark, F.col("_metadata.file_block_start"), 63)


def read_lines(spark: SparkSession, path: str | list[str], encoding: str = "utf-8") -> DataFrame:
    """Lines of text files: ``source, line_id, value, modified``.

    Only ``\\n`` ends a line. Compressed files are read by their extension.
    """
    return (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("source"),
            _line_id(spark).alias("line_id"),
            clean(F.col("value"), encoding).alias("value"),
            F.col("_metadata.file_modification_time").alias("modified"),
        )
    )


def stream_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """An unbounded table of lines from the files arriving in a directory.

    Rows of a stream cannot be numbered, so there is no ``line_id``.
    """
    return (
        spark.readStream.options(lineSep="\n", **options)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("source"),
            clean(F.col("value"), "utf-8").alias("value"),
            F.col("_metadata.file_modification_time").alias("modified"),
        )
    )


def lines_of_table(df: DataFrame, value: str, line_id: str, source: Column | str = "") -> DataFrame:
    """A table's text column as lines. ``line_id`` must be unique in a source."""
    place = F.lit(source) if isinstance(source, str) else source
    return df.select(
        place.alias("source"),
        F.col(line_id).cast("bigint").alias("line_id"),
        F.col(value).alias("value"),
    )


def read_windows_events(
    spark: SparkSession, path: str | list[str], encoding: str = "utf-8"
) -> DataFrame:
    """Windows event exports, one row per complete ``<Event>`` element.

    The closing tag serves as the separator of rows, so that a file of any
    size is split among tasks and no line breaks are needed, and events need
    not stand below one root element. Spark's own XML source reads a file in
    one task. The rows are those of ``read_lines``. The separator leaves the
    tag's first character, by which the text of an event that the end of a
    file cuts off is told from a finished one; only where the cut falls right
    behind such a character it is not.
    """
    event = F.regexp_extract(clean(F.col("value"), encoding), r"(?s)^.*(<Event[ >].*)$", 1)
    return (
        spark.read.option("lineSep", "/Event>")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("source"),
            _line_id(spark).alias("line_id"),
            event.alias("value"),
            F.col("_metadata.file_modification_time").alias("modified"),
        )
        .filter(F.col("value").endswith("<"))
        .withColumn("value", F.concat("value", F.lit("/Event>")))
    )
