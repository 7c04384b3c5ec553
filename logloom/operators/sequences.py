"""Event sequences that come before errors.

For every error, the last 50 rows strictly before it and within the look-back
time are its history; every run of 2 to ``seq_len`` neighbouring events in the
history is counted once per error.

Joining errors with their histories would emit up to 50 rows per error, and a
busy minute would meet in one task. Here nothing is joined or emitted per
error. Rows get a global position, so that they can be cut into slices of
equal size whatever their times, and each run of events asks how many errors
see it, which is the difference of two running totals of errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.predicates import is_error
from ..plans.workspace import work_folder
from ..schema import as_timestamp, column_or_null

#: Rows per slice. A slice is one sort group, so this bounds a task's memory.
SLICE_ROWS = 200_000
_SALTS = 32


def event_token(logs: DataFrame) -> Column:
    """``line_type:module``, with NA for what is missing."""
    return F.concat_ws(
        ":",
        F.coalesce(column_or_null(logs, "line_type"), F.lit("NA")),
        F.coalesce(column_or_null(logs, "module"), F.lit("NA")),
    )


def _latest_per_instant(rows: DataFrame, lookback_rows: int) -> DataFrame:
    """The last ``lookback_rows`` of every instant; earlier ones are in no history.

    Coarse clocks put many rows on one instant. The row-number limit applies
    before the shuffle, and an instant is spread over several tasks, which may
    each keep as many. More rows of an instant do no harm, the limit only bounds
    what follows.
    """
    latest = Window.partitionBy("t", "salt").orderBy(
        F.desc("source"), F.desc("record_id")
    )
    return (
        rows.withColumn("salt", F.spark_partition_id() % _SALTS)
        .withColumn("n", F.row_number().over(latest))
        .filter(F.col("n") <= lookback_rows)
        .drop("n", "salt")
    )


def _positioned(logs: DataFrame, lookback_rows: int, carried: Column | None = None) -> DataFrame:
    """Rows and instants with errors, each with its position in time order, and
    what is ``carried`` of a row.

    ``pos`` of a row is the number of rows before it; of an instant, the
    number of rows strictly earlier. Rows are numbered within ticks of 2**20
    microseconds, about a second, and shifted by the rows of all earlier ticks,
    which are totalled by spans of 2**16 ticks first.
    """
    time = as_timestamp(logs)
    rows = logs.filter(time.isNotNull()).select(
        # Never NULL, and known to be: filters for NULL that joins would add to
        # some uses of `kept`, but not to others, keep its shuffle from reuse.
        F.coalesce(F.unix_micros(time), F.lit(0)).alias("t"),
        # Rows of one instant are ordered by source and number; a hash of the
        # source orders as well as its path and is shorter.
        F.xxhash64(column_or_null(logs, "source")).alias("source"),
        column_or_null(logs, "record_id", "bigint").alias("record_id"),
        event_token(logs).alias("token"),
        is_error(column_or_null(logs, "level")).alias("error"),
        *([] if carried is None else [carried.alias("row")]),
    )
    tick = F.shiftright(F.col("t"), 20)
    kept = _latest_per_instant(rows.drop("error"), lookback_rows)
    if carried is not None:
        # Which rows are kept beyond the limit hangs on the partitions. Here the
        # uses of `kept` share no shuffle, so it is written once for all of them.
        folder = work_folder(logs.sparkSession, "latest-rows")
        kept.write.parquet(folder)
        kept = logs.sparkSession.read.schema(kept.schema).parquet(folder)
    errors = (
        rows.filter("error")
        .groupBy("t")
        .agg(F.count(F.lit(1)).alias("errors"))
        .select("t", F.lit(0).alias("is_row"), "errors")
    )
    both = (
        kept.select("t", F.lit(1).alias("is_row"), "source", "record_id", "token", *([] if carried is None else ["row"]))
        .unionByName(errors, allowMissingColumns=True)
        .withColumn("tick", tick)
    )
    # Errors of an instant stand before its rows, which they do not see.
    in_tick = Window.partitionBy("tick").orderBy("t", "is_row", "source", "record_id")
    numbered = both.withColumn("in_tick", F.sum("is_row").over(in_tick) - F.col("is_row"))

    # No token is empty; it is read so that the shuffle of `kept` is reused.
    ticks = (
        kept.groupBy(tick.alias("tick"))
        .agg(F.count_if(F.col("token") != "").alias("size"))
        .withColumn("span", F.shiftright(F.col("tick"), 16))
    )
    by_span = Window.orderBy("span")
    spans = (
        ticks.groupBy("span")
        .agg(F.sum("size").alias("span_size"))
        .select("span", (F.sum("span_size").over(by_span) - F.col("span_size")).alias("earlier"))
    )
    in_span = Window.partitionBy("span").orderBy("tick")
    starts = ticks.join(spans, "span").select(
        "tick", (F.col("earlier") + F.sum("size").over(in_span) - F.col("size")).alias("start")
    )
    return numbered.join(starts, "tick").select(
        "t", "is_row", "token", "errors", (F.col("start") + F.col("in_tick")).alias("pos"),
        *([] if carried is None else ["row"]),
    )


def _sliced(positioned: DataFrame, slice_rows: int, lookback_rows: int) -> DataFrame:
    """Cut by position; a slice also gets the rows to look back at before it."""
    own = F.floor(F.col("pos") / slice_rows)
    reaches_on = (F.col("is_row") == 1) & (
        F.col("pos") % slice_rows >= slice_rows - lookback_rows
    )
    return positioned.withColumn(
        "slice", F.explode(F.when(reaches_on, F.array(own, own + 1)).otherwise(F.array(own)))
    )


def mine_sequences(
    logs: DataFrame,
    window_minutes: int = 5,
    seq_len: int = 3,
    top_k: int = 15,
    slice_rows: int = SLICE_ROWS,
    lookback_rows: int = fv.LOOKBACK_ROWS,
) -> DataFrame:
    """The most frequent event sequences before errors: ``sequence``, ``count``.

    An error sees the last ``lookback_rows`` rows before it of the window.
    """
    if slice_rows < lookback_rows:
        raise ValueError(f"slice_rows is at least lookback_rows, {lookback_rows}")
    lengths = range(2, min(seq_len, lookback_rows) + 1)
    by_pos = Window.partitionBy("slice").orderBy("pos")
    by_time = Window.partitionBy("slice").orderBy("t")
    start = Window.unboundedPreceding

    def errors_up_to(position: int) -> Column:
        """Errors that have at most this many rows past the current one before them."""
        return F.coalesce(F.sum("errors").over(by_pos.rangeBetween(start, position)), F.lit(0))

    in_time = F.coalesce(
        F.sum("errors").over(by_time.rangeBetween(start, window_minutes * 60_000_000)), F.lit(0)
    )
    columns = {"until": F.least(errors_up_to(lookback_rows), in_time)}
    for k in range(1, max(lengths, default=0)):
        columns[f"token_{k}"] = F.max("token").over(by_pos.rangeBetween(k, k))
        columns[f"after_{k}"] = errors_up_to(k)
    windowed = _sliced(_positioned(logs, lookback_rows), slice_rows, lookback_rows).withColumns(columns)

    # Errors that see the run are those up to `until` less those before its end.
    runs = [
        F.struct(
            F.array("token", *[f"token_{k}" for k in range(1, length)]).alias("sequence"),
            F.when(F.col(f"token_{length - 1}").isNotNull(), F.col("until") - F.col(f"after_{length - 1}"))
            .otherwise(0)
            .alias("seen_by"),
        )
        for length in lengths
    ]
    if not runs:
        return logs.sparkSession.createDataFrame([], "sequence array<string>, count bigint")
    return (
        windowed.filter("is_row = 1")
        .select(F.inline(F.array(*runs)))
        .filter("seen_by > 0")
        .groupBy("sequence")
        .agg(F.sum("seen_by").alias("count"))
        .orderBy(F.desc("count"), F.asc("sequence"))
        .limit(top_k)
    )


#: What is known of a row in a history, apart from its time.
HISTORY_COLUMNS = ("source", "record_id", "level", "module", "line_type", "message")


def error_history(
    logs: DataFrame, window_minutes: int = 5, lookback_rows: int = fv.LOOKBACK_ROWS
) -> DataFrame:
    """The rows before each error: at most the last ``lookback_rows`` that are
    strictly earlier, by at most the window.

    ``error_source``, ``error_id``, ``error_time`` and ``place`` (1 for the latest)
    with ``timestamp`` and ``HISTORY_COLUMNS`` of the row. Rows of one time follow
    each other by their number, as in ``mine_sequences``.

    Rows and instants with errors meet by position, in cells of as many positions as
    an error looks back, so each cell has as many rows and instants at most
    however busy a minute is, and an instant's history is found once for all its
    errors. Only these are then joined to it by time, where the adaptive planner can
    split an instant with very many errors.
    """
    time = as_timestamp(logs)
    carried = F.struct(*[column_or_null(logs, c, "bigint" if c == "record_id" else "string").alias(c) for c in HISTORY_COLUMNS])
    positioned = _positioned(logs, lookback_rows, carried)
    rows = positioned.filter("is_row = 1").select(
        F.col("t").alias("row_t"), F.col("pos").alias("row_pos"), "row", F.floor(F.col("pos") / lookback_rows).alias("cell")
    )
    first, last = ((F.col("pos") - back) / lookback_rows for back in (lookback_rows, 1))
    cells = F.explode(F.array_distinct(F.array(F.floor(first), F.floor(last))))
    instants = positioned.filter("is_row = 0").select("t", "pos", cells.alias("cell"))
    place = F.col("pos") - F.col("row_pos")
    history = (
        instants.join(rows, "cell")
        .filter(place.between(1, lookback_rows) & (F.col("row_t") >= F.col("t") - window_minutes * 60_000_000))
        .select("t", place.alias("place"), F.timestamp_micros("row_t").alias("timestamp"), "row.*")
    )
    errors = logs.filter(time.isNotNull() & is_error(column_or_null(logs, "level"))).select(
        F.unix_micros(time).alias("t"),
        column_or_null(logs, "source").alias("error_source"),
        column_or_null(logs, "record_id", "bigint").alias("error_id"),
        time.alias("error_time"),
    )
    return errors.join(history, "t").drop("t")


def sequence_text(sequence: Column | str = "sequence") -> Column:
    return F.array_join(sequence, " → ")
