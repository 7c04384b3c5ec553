"""The queries to check: each runs an operator over a whole given table.

Times are returned without a zone, in UTC, so that they compare as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sql import register_sql_functions
from ..operators import distributions as dist
from ..operators import hourly, modules
from ..operators.assemble import assemble_records
from ..operators.clusters import cluster_errors, cluster_sizes, fit_clusters, label_errors
from ..operators.detect import detect_formats
from ..operators.enrich import add_enrichments
from ..operators.filters import (
    apply_filters,
    distinct_values,
    filter_keyword,
    filter_time,
    filter_values,
)
from ..operators.ordering import max_lines, page_rows
from ..operators.parse import parse, register_parser, unregister_parser
from ..operators.phrases import top_error_phrases, top_phrases
from ..operators.redact import add_redacted, redact_columns
from ..operators.sequences import error_history, mine_sequences, sequence_text
from ..sources.lines import lines_of_table, read_lines, read_windows_events, stream_lines
from ..sources.sinks import read_csv_export, write_csv, write_json
from ..streaming.jobs import read_snapshot, stream_hourly, stream_logs, to_files, to_snapshot
from ..streaming.records import read_records, stream_blocks, to_records
from ..streaming.totals import hourly_parts, read_totals, to_totals
from .event_logs import LINES_PER_EVENT, STACK_FRAME, base_events, document_lines, line_text, mixed_lines, rendered
from .pipeline import logs_from_lines
from .workspace import work_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Events happen in this year; formats without one are told so.
YEAR = 2024


def query(func: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        df = func(spark, sf_dir)
        times = {
            f.name: F.col(f.name).cast("timestamp_ntz")
            for f in df.schema.fields
            if f.dataType.typeName() == "timestamp"
        }
        return df.withColumns(times) if times else df

    QUERIES[func.__name__] = run
    return run


def parsed(spark: SparkSession, sf_dir: str, format: str = "custom") -> DataFrame:
    return parse(rendered(spark, sf_dir, format), format, year=YEAR)


def enriched(spark: SparkSession, sf_dir: str, format: str = "custom") -> DataFrame:
    return add_enrichments(parsed(spark, sf_dir, format))


def _event() -> Column:
    return F.col("record_id").alias("event_id")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- parsing -----------------------------------------------------------------


def _parse_query(name: str, format: str, *columns: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return parsed(spark, sf_dir, format).select(_event(), "timestamp", *columns)

    run.__name__ = name
    query(run)


_BASIC = ("level", "module", "message")
_parse_query("parse_custom", "custom", *_BASIC)
_parse_query("parse_syslog", "syslog", *_BASIC, "ip")
_parse_query(
    "parse_apache", "apache", *_BASIC, "ip", "status_code", "user_agent", "request_type", "request_path"
)
_parse_query("parse_json", "json", *_BASIC, "ip", "user_agent", "status_code", "request_time")
_parse_query("parse_docker", "docker_json", *_BASIC)
_parse_query("parse_k8s", "kubernetes_json", *_BASIC)
_parse_query("parse_cloudwatch", "cloudwatch_export", *_BASIC)
_parse_query("parse_gcp", "gcp_cloud_logging", *_BASIC, "user_agent")
_parse_query("parse_winxml", "windows_event_xml", *_BASIC)
_parse_query("parse_modjk", "apache_modjk", *_BASIC, "severity")
_parse_query(
    "parse_modjk_worker", "apache_modjk", "worker_type", "error_state", "child_pid", "slot", "config_file"
)
_parse_query("parse_tomcat", "tomcat_connector", *_BASIC, "severity")
_parse_query("parse_generic", "generic", *_BASIC, "ip")


@query
def parse_with_layout(spark, sf_dir):
    """Connector lines in a layout of the caller's own."""
    lines = rendered(spark, sf_dir, "custom").withColumn(
        "value", F.regexp_replace("value", r"^\[(\d+)-(\d+)-(\d+) ([^\]]*)\] (\[\w+\]) ", r"[$3.$2.$1 $4] $5 ")
    )
    config = {"timestamp_format": "%d.%m.%Y %H:%M:%S"}
    return parse(lines, "apache_modjk", config).select(_event(), "timestamp", "level", "message")


@query
def winxml_files(spark, sf_dir):
    """Event XML written out as files and read back event by event."""
    folder = work_folder(spark, "winxml")
    rendered(spark, sf_dir, "windows_event_xml").select("value").write.text(folder)
    logs = parse(read_windows_events(spark, folder), "windows_event_xml")
    return logs.select("timestamp", "level", "module", "message")


@query
def detect_format(spark, sf_dir):
    return detect_formats(mixed_lines(spark, sf_dir))


@query
def assemble(spark, sf_dir):
    return assemble_records(document_lines(spark, sf_dir)).select("source", "record_id", "value")


@query
def mixed_formats(spark, sf_dir):
    """Detection, stitching and parsing of twelve sources in one go."""
    logs = logs_from_lines(mixed_lines(spark, sf_dir), year=YEAR, enrich=False)
    event = F.floor(F.col("record_id") / LINES_PER_EVENT).cast("bigint")
    return logs.select(event.alias("event_id"), "format", "timestamp", "level", "module", "message")


@query
def registered_format(spark, sf_dir):
    """A format of the caller's own, parsed by Columns: ``id|level|message``."""
    base = base_events(spark, sf_dir).select(
        F.lit("own.log").alias("source"),
        F.col("event_id").alias("line_id"),
        F.concat_ws("|", F.col("event_id").cast("string"), "level", "message").alias("value"),
    )

    def table(lines: DataFrame) -> DataFrame:
        part = F.split("value", r"\|", 3)
        return lines.select(
            "source", F.col("line_id").alias("record_id"), part[1].alias("level"), part[2].alias("message"),
            part[0].cast("bigint").alias("number"),
        )

    name = "own_pipes"
    register_parser(name, table)
    try:
        logs = parse(base.withColumn("format", F.lit(name)), among=[name])
    finally:
        unregister_parser(name)
    return logs.select(_event(), "format", "level", "message", "number")


# --- enrichment --------------------------------------------------------------


@query
def line_type(spark, sf_dir):
    return enriched(spark, sf_dir).select(_event(), "line_type")


@query
def http_fields(spark, sf_dir):
    return enriched(spark, sf_dir).select(_event(), "request_type", "request_path")


@query
def status_code(spark, sf_dir):
    return enriched(spark, sf_dir).select(_event(), "status_code")


@query
def status_code_access(spark, sf_dir):
    """The level of an access line is its status."""
    return enriched(spark, sf_dir, "apache").select(_event(), "status_code", "request_path")


@query
def response_time(spark, sf_dir):
    return enriched(spark, sf_dir).select(_event(), "response_time_ms")


@query
def user_id(spark, sf_dir):
    return enriched(spark, sf_dir).select(_event(), "user_id")


@query
def user_agent(spark, sf_dir):
    return enriched(spark, sf_dir, "apache").select(_event(), "ua_browser", "ua_os", "ua_device")


@query
def ip_fallback(spark, sf_dir):
    return enriched(spark, sf_dir).select(_event(), "ip")


@query
def ip_fallback_dataset(spark, sf_dir):
    """Some rows have an address, so none is taken from a message."""
    some = parsed(spark, sf_dir).withColumn(
        "ip", F.when(F.col("record_id") % 2 == 0, F.lit("10.9.8.7"))
    )
    return add_enrichments(some, ip_mode="dataset").select(_event(), "ip")


@query
def redact_documents(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", F.col("text").alias("message"))
    return add_redacted(docs).select("doc_id", "redacted_message")


@query
def sql_functions(spark, sf_dir):
    """The SQL forms of the scalar functions, called from SQL."""
    register_sql_functions(spark)
    parsed(spark, sf_dir).createOrReplaceTempView("logloom_parsed")
    return spark.sql(
        "SELECT record_id AS event_id, detect_line_type(message) AS line_type, "
        "parse_response_time(message) AS response_time_ms, redact_pii(message) AS redacted, "
        "parse_user_agent(message).browser AS browser FROM logloom_parsed"
    )


# --- filters -----------------------------------------------------------------


@query
def filter_time_range(spark, sf_dir):
    return filter_time(
        parsed(spark, sf_dir), "2024-01-05 00:00:00", "2024-01-12 12:00:00"
    ).select(_event(), "timestamp")


@query
def filter_level_module(spark, sf_dir):
    logs = filter_values(parsed(spark, sf_dir), "level", ["ERROR", "WARNING"])
    return filter_values(logs, "module", ["svc1", "svc3"]).select(_event(), "level", "module")


@query
def filter_keyword_regex(spark, sf_dir):
    return filter_keyword(parsed(spark, sf_dir), "TIMED? out|POOL").select(_event(), "message")


@query
def filter_keyword_documents(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return filter_keyword(docs, "The", literal=True, column="text").select("doc_id", "n_chars")


@query
def filters_combined(spark, sf_dir):
    return apply_filters(
        parsed(spark, sf_dir),
        start="2024-01-03 00:00:00",
        end="2024-01-20 00:00:00",
        levels=["ERROR"],
        modules=["svc0", "svc2"],
        keyword="latency",
    ).select(_event(), "timestamp", "level", "module")


@query
def distinct_modules(spark, sf_dir):
    return distinct_values(parsed(spark, sf_dir), "module")


# --- reports -----------------------------------------------------------------


@query
def module_ranking(spark, sf_dir):
    return modules.module_ranking(enriched(spark, sf_dir))


@query
def module_type_pivot(spark, sf_dir):
    return modules.module_type_pivot(enriched(spark, sf_dir))


@query
def module_error_rate_top(spark, sf_dir):
    """Addresses as modules, since there are many of them."""
    logs = parsed(spark, sf_dir, "json").withColumn("module", F.substring_index("ip", ".", 3))
    return modules.top_error_rates(logs).select("module", "total", "errors", "error_rate")


@query
def module_errors_top(spark, sf_dir):
    logs = parsed(spark, sf_dir, "json").withColumn("module", F.substring_index("ip", ".", 3))
    return modules.errors_per_module(logs)


@query
def hourly_metrics(spark, sf_dir):
    return _rounded(hourly.hourly_metrics(parsed(spark, sf_dir)))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {f.name: F.round(f.name, 6) for f in df.schema.fields if f.dataType.typeName() == "double"}
    )


@query
def spikes(spark, sf_dir):
    """Errors and sign-ups alone, so that hours differ more."""
    logs = filter_values(parsed(spark, sf_dir), "level", ["ERROR", "WARNING"])
    return _rounded(hourly.spikes(logs))


@query
def anomaly_summary(spark, sf_dir):
    return _rounded(hourly.anomaly_summary(parsed(spark, sf_dir)))


@query
def http_top_paths(spark, sf_dir):
    return dist.http_stats(enriched(spark, sf_dir))[0]


@query
def http_status(spark, sf_dir):
    return dist.http_stats(enriched(spark, sf_dir))[1]


@query
def http_top_pages(spark, sf_dir):
    """Requests for all pages, with the path read off the request text."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = F.regexp_replace("url", r"^[a-z]+://[^/]+", "")
    logs = pages.select(F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1 200 1")).alias("message"))
    return dist.http_stats(logs)[0]


@query
def level_counts(spark, sf_dir):
    return dist.level_counts(parsed(spark, sf_dir))


@query
def status_counts(spark, sf_dir):
    return dist.status_counts(enriched(spark, sf_dir))


@query
def method_counts(spark, sf_dir):
    return dist.method_counts(enriched(spark, sf_dir))


@query
def line_type_counts(spark, sf_dir):
    return dist.line_type_counts(enriched(spark, sf_dir))


@query
def hourly_volume(spark, sf_dir):
    return dist.hourly_volume(parsed(spark, sf_dir))


@query
def level_timeline(spark, sf_dir):
    return dist.level_timeline(parsed(spark, sf_dir))


@query
def response_series(spark, sf_dir):
    return dist.response_series(enriched(spark, sf_dir))


@query
def heatmap(spark, sf_dir):
    return dist.activity_heatmap(parsed(spark, sf_dir))


@query
def heatmap_errors(spark, sf_dir):
    return dist.error_heatmap(parsed(spark, sf_dir))


@query
def worker_summary(spark, sf_dir):
    """The three reports on connector workers, as one table."""
    states, files, slots = dist.worker_summary(parsed(spark, sf_dir, "apache_modjk"))
    return (
        states.select(F.lit("state").alias("kind"), F.col("error_state").alias("name"), "count")
        .unionByName(
            files.select(F.lit("file").alias("kind"), F.col("config_file").alias("name"), F.lit(1).cast("bigint").alias("count"))
        )
        .unionByName(
            slots.select(
                F.lit("slot").alias("kind"),
                F.concat_ws(">", "child_pid", "slot").alias("name"),
                F.lit(1).cast("bigint").alias("count"),
            )
        )
    )


# --- text and sequences ------------------------------------------------------


@query
def error_phrases(spark, sf_dir):
    return top_error_phrases(parsed(spark, sf_dir), top=50)


@query
def document_phrases(spark, sf_dir):
    return top_phrases(_documents(spark, sf_dir), "text", top=100)


def _document_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select(
        F.lit("ERROR").alias("level"), F.coalesce("text", F.lit("")).alias("message")
    )


@query
def error_clusters(spark, sf_dir):
    return cluster_errors(_document_errors(spark, sf_dir))


@query
def error_cluster_sizes(spark, sf_dir):
    return cluster_sizes(cluster_errors(_document_errors(spark, sf_dir), messages=False))


@query
def error_cluster_round(spark, sf_dir):
    """A round of K-means over all documents from five of them, then the nearest cluster of each."""
    docs = _document_errors(spark, sf_dir)
    least = docs.select("message", F.md5("message").alias("digest")).distinct().orderBy("digest").limit(5)
    model = fit_clusters(docs, rounds=1, initial=[row["message"] for row in least.collect()])
    return label_errors(docs, model)


@query
def error_cluster_texts(spark, sf_dir):
    """Errors without their figures: ten texts that share no word, so each is a cluster."""
    errors = parsed(spark, sf_dir).withColumn("message", F.substring_index("message", " latency=", 1))
    clusters = cluster_errors(errors, n_clusters=10)
    sizes = clusters.groupBy("cluster").agg(F.min("message").alias("text"), F.count(F.lit(1)).alias("errors"))
    return sizes.select("text", "errors")


@query
def sequences(spark, sf_dir):
    """Look-back long enough that the limit of 50 rows takes effect."""
    mined = mine_sequences(enriched(spark, sf_dir), window_minutes=360, seq_len=3, top_k=100)
    return mined.select(sequence_text().alias("sequence"), "count")


@query
def sequences_short(spark, sf_dir):
    """Look-back that ends before 50 rows are reached."""
    mined = mine_sequences(enriched(spark, sf_dir), window_minutes=60, seq_len=4, top_k=100)
    return mined.select(sequence_text().alias("sequence"), "count")


@query
def error_history_rows(spark, sf_dir):
    """The rows that each error looks back at, up to 50 of six hours."""
    history = error_history(enriched(spark, sf_dir), window_minutes=360)
    return history.select(
        F.col("error_id"), "error_time", "place", F.col("record_id").alias("event_id"), "timestamp", "level", "line_type"
    )


# --- order, export, streams --------------------------------------------------


@query
def page_of_rows(spark, sf_dir):
    return page_rows(parsed(spark, sf_dir), page=3, size=200).select(_event(), "timestamp", "message")


@query
def first_lines(spark, sf_dir):
    """The first 300 lines of each of three sources."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = F.concat(F.lit("src"), (F.col("event_id") % 3).cast("string"))
    lines = lines_of_table(events, "props", "event_id", source)
    return max_lines(lines, 300).select("source", F.col("line_id").alias("event_id"), "value")


def _text_files(spark: SparkSession, sf_dir: str, purpose: str) -> str:
    folder = work_folder(spark, purpose)
    rendered(spark, sf_dir, "custom").select("value").write.text(folder)
    return folder


@query
def export_roundtrip(spark, sf_dir):
    """Text files in, log table out as CSV and JSON, and both read back."""
    folder = _text_files(spark, sf_dir, "export")
    logs = parse(read_lines(spark, folder), "custom").select("timestamp", "level", "module", "message")
    write_csv(logs, f"{folder}-csv", redact=True)
    write_json(logs, f"{folder}-json", redact=True)
    csv = read_csv_export(spark, f"{folder}-csv", logs.schema)
    json = spark.read.schema(logs.schema).json(f"{folder}-json")
    return csv.withColumn("kind", F.lit("csv")).unionByName(json.withColumn("kind", F.lit("json")))


@query
def redacted_export(spark, sf_dir):
    return redact_columns(parsed(spark, sf_dir), ["message"]).select(_event(), "message")


@query
def stream_parse(spark, sf_dir):
    """The parse path on a stream of files, into files."""
    folder = _text_files(spark, sf_dir, "stream-parse")
    logs = stream_logs(stream_lines(spark, folder), "custom", redact=True)
    columns = ["timestamp", "level", "module", "line_type", "redacted_message"]
    job = to_files(logs.select(*columns), f"{folder}-out", f"{folder}-state").trigger(
        availableNow=True
    )
    job.start().awaitTermination()
    return spark.read.parquet(f"{folder}-out").select(*columns)


@query
def stream_hourly_counts(spark, sf_dir):
    folder = _text_files(spark, sf_dir, "stream-hourly")
    logs = stream_logs(stream_lines(spark, folder), "custom")
    job = to_snapshot(stream_hourly(logs), f"{folder}-out", f"{folder}-state").trigger(
        availableNow=True
    )
    job.start().awaitTermination()
    return read_snapshot(spark, f"{folder}-out")


def _in_slices(lines: DataFrame, folder: str, ends: list[float], **write: str) -> Iterator[int]:
    """Lines (``number``, ``value`` and those to partition by) as files, the next
    slice each time; ``ends`` are the shares of the numbers at which they end.

    The text is made once and each slice is written by many tasks, whose files
    follow each other by name, so that no task holds more than a part of a slice.
    """
    lines = _saved_lines(lines, f"{folder}-made")
    low, high = lines.agg(F.min("number"), F.max("number")).first()
    place = (F.col("number") - F.lit(low)) / F.lit((high or 0) - (low or 0) + 1)
    for i, (start, end) in enumerate(zip([0.0, *ends], [*ends, 1.0])):
        own = lines.filter((place >= start) & (place < end)).repartitionByRange(*write.values(), "number")
        own = own.sortWithinPartitions(*write.values(), "number").drop("number")
        own.write.partitionBy(*write.values()).text(f"{folder}/slice={i}")
        yield i


def _saved_lines(lines: DataFrame, path: str) -> DataFrame:
    lines.write.parquet(path)
    return lines.sparkSession.read.schema(lines.schema).parquet(path)


def _log_of(path: Column) -> Column:
    """The source of a file of any slice: all there is, or what it is partitioned by."""
    return F.regexp_replace(path, r"/slice=[0-9]+((?:/[^/=]+=[^/]*)?)/[^/]*$", "$1")


def _stream_slices(lines: DataFrame, folder: str, ends: list[float], year: int | None = None, **write: str) -> DataFrame:
    """The log table of a stream that meets one slice a batch and is started again for each."""
    spark = lines.sparkSession
    out, state = f"{folder}-out", f"{folder}-state"
    for _ in _in_slices(lines, folder, ends, **write):
        blocks = stream_blocks(spark, folder)
        job = to_records(blocks, out, state, f"{folder}-checkpoint", source=_log_of, by_name=True, year=year)
        job.trigger(availableNow=True).start().awaitTermination()
    return read_records(spark, out, state, by_name=True, year=year)


@query
def stream_records(spark, sf_dir):
    """Records of two lines on a stream of files that mostly end within a record."""
    folder = work_folder(spark, "stream-records")
    record = F.concat(line_text("custom"), F.lit(STACK_FRAME))
    lines = base_events(spark, sf_dir).select("event_id", F.posexplode(F.split(record, "\n")).alias("i", "value"))
    numbered = lines.select((2 * F.col("event_id") + F.col("i")).alias("number"), "value")
    return _stream_slices(numbered, folder, [0.1, 0.5]).select("timestamp", "level", "module", "message")


@query
def stream_mixed_formats(spark, sf_dir):
    """Twelve sources on a stream, each in a format of its own that shows after some files."""
    folder = work_folder(spark, "stream-mixed")
    lines = mixed_lines(spark, sf_dir).select("source", F.col("line_id").alias("number"), "value")
    logs = _stream_slices(lines, folder, [0.1, 0.5], YEAR, by="source")
    return logs.select("format", "timestamp", "level", "module", "message")


@query
def stream_hourly_late(spark, sf_dir):
    """Hourly counts where every batch brings rows of all hours again."""
    folder = work_folder(spark, "stream-late")
    dealt = rendered(spark, sf_dir, "custom").select("value", (F.col("line_id") % 4).alias("part"))
    for part in range(4):
        dealt.filter(F.col("part") == part).select("value").coalesce(1).write.mode("append").text(folder)
    logs = stream_logs(stream_lines(spark, folder, maxFilesPerTrigger="1"), "custom")
    to_totals(hourly_parts(logs), f"{folder}-out", f"{folder}-state").trigger(availableNow=True).start().awaitTermination()
    return read_totals(spark, f"{folder}-out")
