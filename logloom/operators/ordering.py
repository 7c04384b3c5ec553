"""First lines of a source and pages of a table, found by rank at scale.

Ranks come from counts per chunk of numbers: a running total over the chunks
(small) tells which chunks a rank falls into, and only the rows of those are
numbered. No task ever sorts a whole source or table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers are unique within a source, so a chunk holds at most 2**14 rows.
CHUNK_BITS = 14
#: Pages are looked for in larger chunks, of which there are fewer to total.
PAGE_CHUNK_BITS = 20


def chunk(column: str):
    return F.shiftright(F.col(column), CHUNK_BITS)


#: Two independent hashes, 96 bits in all, that stand for a source.
SOURCE_KEY = ("source_hash", "source_check")


def with_source_key(lines: DataFrame) -> DataFrame:
    """Adds ``SOURCE_KEY``, to group and sort by in place of the source.

    Paths of one folder share a long beginning, and sorting lines by them
    spends most of its time on comparing it.
    """
    return lines.withColumns({"source_hash": F.xxhash64("source"), "source_check": F.hash("source")})


def max_lines(lines: DataFrame, n: int) -> DataFrame:
    """The first ``n`` lines of every source, those without one among them; 0
    keeps them all. Lines without a number come before all others."""
    if n <= 0:
        return lines
    # A missing number is in a chunk below all that numbers have.
    number = F.coalesce(chunk("line_id"), F.lit(-(1 << 62)))
    chunked = with_source_key(lines).withColumn("_chunk", number)
    by_source = Window.partitionBy(*SOURCE_KEY).orderBy("_chunk")
    starts = (
        chunked.groupBy(*SOURCE_KEY, "_chunk")
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_before", F.sum("_size").over(by_source) - F.col("_size"))
        .filter(F.col("_before") < n)
        .drop("_size")
    )
    within = Window.partitionBy(*SOURCE_KEY, "_chunk").orderBy("line_id", "value")
    return (
        chunked.join(starts, [*SOURCE_KEY, "_chunk"])
        .withColumn("_rank", F.col("_before") + F.row_number().over(within))
        .filter(F.col("_rank") <= n)
        .select(*lines.columns)
    )


#: Columns a reader looks at first; the others follow.
PREFERRED_COLUMNS = (
    "timestamp", "level", "module", "ip", "status_code", "request_type",
    "request_path", "response_time_ms", "user_id", "ua_browser", "ua_os", "ua_device",
)


#: Pages of more rows find their bounds by joins without a broadcast.
BROADCAST_PAGE = 100_000


def page_rows(
    logs: DataFrame, page: int = 1, size: int = 200, message_column: str = "message"
) -> DataFrame:
    """Page ``page`` (from 1) of the log in the order of its records.

    The bounds are at most ``size`` rows; they are broadcast up to
    ``BROADCAST_PAGE`` of them.
    """

    def bounds(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if size <= BROADCAST_PAGE else df

    start, end = (page - 1) * size, page * size
    chunked = logs.withColumn("_chunk", F.shiftright("record_id", PAGE_CHUNK_BITS))
    # The source as a result: a constant one stays a column to join by.
    sizes = chunked.groupBy("source", "_chunk").agg(
        F.max("source").alias("_of"), F.count(F.lit(1)).alias("_size")
    )
    # One row per source, so one task totals them all; then a source's chunks.
    earlier = (
        sizes.groupBy("_of")
        .agg(F.sum("_size").alias("_all"))
        .withColumn("_earlier", F.sum("_all").over(Window.orderBy("_of")) - F.col("_all"))
        .filter((F.col("_earlier") < end) & (F.col("_earlier") + F.col("_all") > start))
        .select(F.col("_of").alias("_source"), "_earlier")
    )
    in_order = Window.partitionBy("_of").orderBy("_chunk")
    running = F.col("_earlier") + F.sum("_size").over(in_order) - F.col("_size")
    wanted = (
        # A page has rows of at most ``size`` sources and chunks.
        sizes.join(bounds(earlier), F.col("_of").eqNullSafe(F.col("_source")))
        .withColumn("_before", running)
        .filter((F.col("_before") < end) & (F.col("_before") + F.col("_size") > start))
        .select("_source", F.col("_chunk").alias("_wanted"), "_before")
    )
    within = Window.partitionBy("source", "_chunk").orderBy("record_id")
    ranked = (
        chunked.join(
            bounds(wanted),
            F.col("source").eqNullSafe(F.col("_source"))
            & F.col("_chunk").eqNullSafe(F.col("_wanted")),
        )
        .withColumn("_rank", F.col("_before") + F.row_number().over(within) - 1)
        .filter((F.col("_rank") >= start) & (F.col("_rank") < end))
    )
    preferred = [c for c in (*PREFERRED_COLUMNS, message_column) if c in logs.columns]
    others = [c for c in logs.columns if c not in preferred]
    return ranked.orderBy("_rank").select(*preferred, *others)
