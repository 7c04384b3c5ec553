"""Log text made from the ``events`` table, in every supported format.

Checks need log files, and the given tables hold none. So events are written
out as log lines here, all of them, and the parsers read them back. The base
columns are SQL that both Spark and the checking database understand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Error texts, one of each line type in turn.
ERROR_TEXTS = (
    ("Traceback (most recent call last) in worker", "EXCEPTION"),
    ("SQLSTATE 42S02 table not found", "DB_ERROR"),
    ("request timed out after 30 units", "TIMEOUT"),
    ("login failed for account", "AUTH"),
    ("connection reset by peer", "NETWORK"),
    ("out of memory in pool", "RESOURCE"),
    ("missing key in settings", "CONFIG"),
    ("server stopping on signal", "STARTUP_SHUTDOWN"),
    ("Allocation Failure in old space", "GC"),
    ("unexpected state in handler", "OTHER"),
)
USER_AGENTS = (
    ("Mozilla/5.0 (Windows NT 10.0; Win64) Chrome/120.0", "Chrome", "Windows", "Desktop"),
    ("Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Firefox/121.0", "Firefox", "Linux", "Desktop"),
    ("Mozilla/5.0 (iPhone; CPU OS 17) Version/17.0 Mobile Safari/604", "Safari", "iOS", "Mobile"),
    ("curl/8.1", "Other", "Other", "Other"),
)


def _choose(index: str, values) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {index} {whens} END"


_ERROR_TEXT = _choose("event_id % 10", [t for t, _ in ERROR_TEXTS])
_STATUS = _choose("event_id % 4", ["200", "304", "404", "503"])
_METHOD = _choose("event_id % 3", ["GET", "POST", "PUT"])
_PATH = "'/items/' || CAST(user_id % 40 AS STRING)"
_IP = "'10.0.' || CAST(user_id % 256 AS STRING) || '.' || CAST(event_id % 256 AS STRING)"

BASE_COLUMNS = {
    "event_id": "event_id",
    "user_id": "user_id",
    "ts": "CAST(date_trunc('second', ts) AS TIMESTAMP)",
    "level": "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' "
    "WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END",
    "module": "'svc' || CAST(user_id % 5 AS STRING)",
    "ip": _IP,
    "status": _STATUS,
    "method": _METHOD,
    "path": _PATH,
    "agent": _choose("event_id % 4", [a[0] for a in USER_AGENTS]),
    "line_type": "CASE event_type WHEN 'view' THEN 'HTTP_ACCESS' WHEN 'signup' THEN 'CONFIG' "
    f"WHEN 'error' THEN {_choose('event_id % 10', [k for _, k in ERROR_TEXTS])} ELSE 'OTHER' END",
    "message": "CASE event_type "
    f"WHEN 'view' THEN {_METHOD} || ' ' || {_PATH} || ' HTTP/1.1 ' || {_STATUS} || ' 512' "
    f"WHEN 'error' THEN {_ERROR_TEXT} || ' latency=' || CAST(event_id % 900 AS STRING) || 'ms "
    "user_id=u' || CAST(user_id AS STRING) "
    f"WHEN 'signup' THEN 'config reload from ' || {_IP} "
    "WHEN 'click' THEN 'item shown, duration: ' || CAST(event_id % 9 AS STRING) || '.5s' "
    "ELSE 'order placed by user-id: ' || CAST(user_id AS STRING) END",
}

#: The same columns for the checking database, as a common table expression.
BASE_CTE = (
    "base AS (SELECT "
    + ", ".join(f"{sql} AS {name}" for name, sql in BASE_COLUMNS.items())
    + " FROM events)"
)


def base_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn(
        "ts", F.col("ts").cast("timestamp")
    )
    # Text takes many times the room of an event. A table too small to be read
    # in as many parts as there are cores is spread out before it grows.
    if events.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        events = events.repartition("event_id")
    return events.selectExpr(*[f"{sql} AS {name}" for name, sql in BASE_COLUMNS.items()])


def _time(layout: str) -> Column:
    return F.date_format("ts", layout)


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))


_C = F.col


def modjk_message() -> Column:
    """Connector messages: worker states, child processes, settings files."""
    number = _C("event_id").cast("string")
    return (
        F.when(_C("event_id") % 3 == 0, _text("mod_jk child workerEnv in error state ", (_C("event_id") % 7).cast("string")))
        .when(_C("event_id") % 3 == 1, _text("jk2_init() Found child ", number, " in scoreboard slot ", (_C("event_id") % 13).cast("string")))
        .otherwise(_text("workerEnv.init() ok /etc/httpd/conf/workers", (_C("user_id") % 4).cast("string"), ".properties"))
    )


def modjk_severity() -> Column:
    return F.when(_C("level") == "ERROR", "error").when(_C("level") == "WARNING", "warn").when(
        _C("level") == "DEBUG", "debug"
    ).otherwise("notice")


def line_text(format: str) -> Column:
    """One log record of the given format, over the base columns."""
    iso = _time("yyyy-MM-dd'T'HH:mm:ss'Z'")
    plain = _time("yyyy-MM-dd HH:mm:ss")
    texts = {
        "custom": lambda: _text("[", plain, "] [", _C("level"), "] [", _C("module"), "] ", _C("message")),
        "syslog": lambda: _text(
            _time("MMM dd HH:mm:ss"), " host", (_C("user_id") % 7).cast("string"), " ", _C("module"),
            "[", _C("user_id").cast("string"), "]: ", F.lower("level"), " ", _C("message"),
        ),
        "apache": lambda: _text(
            _C("ip"), " - - [", _time("dd/MMM/yyyy:HH:mm:ss"), " +0000] \"", _C("method"), " ", _C("path"),
            " HTTP/1.1\" ", _C("status"), " 512 \"-\" \"", _C("agent"), "\"",
        ),
        "apache_modjk": lambda: _text(
            "[", _time("EEE MMM dd HH:mm:ss yyyy"), "] [", modjk_severity(), "] ", modjk_message()
        ),
        "tomcat_connector": lambda: _text(
            plain, ".", F.lpad((_C("event_id") % 1000).cast("string"), 3, "0"), " [", modjk_severity(), "] ", _C("message")
        ),
        "json": lambda: _json(
            time=iso, severity=_C("level"), msg=_C("message"), logger=_C("module"), client_ip=_C("ip"),
            userAgent=_C("agent"), status=_C("status").cast("int"), latency=_C("event_id") % 900,
        ),
        "docker_json": lambda: _json(
            log=_text(_C("message"), "\n"), stream=F.lit("stdout"), time=iso, level=_C("level"), container_name=_C("module")
        ),
        "kubernetes_json": lambda: _json(
            log=_C("message"), time=iso, level=_C("level"),
            kubernetes=F.struct(
                F.lit("shop").alias("namespace_name"), _C("module").alias("pod_name"), F.lit("").alias("container_name")
            ),
        ),
        "cloudwatch_export": lambda: _json(
            logGroup=_C("module"), logStream=F.lit("s"), message=_C("message"), timestamp=F.unix_millis("ts"), level=_C("level")
        ),
        "gcp_cloud_logging": lambda: _json(
            textPayload=_C("message"), timestamp=iso, severity=_C("level"),
            logName=_text("projects/p/logs/", _C("module")),
            httpRequest=F.struct(_C("agent").alias("userAgent")),
        ),
        "windows_event_xml": lambda: _text(
            "<Event xmlns=\"http://schemas.microsoft.com/win/2004/08/events/event\">\n  <System>\n    <Provider Name=\"",
            _C("module"), "\"/>\n    <TimeCreated SystemTime=\"", iso, "\"/>\n    <Level>",
            (_C("event_id") % 5 + 1).cast("string"), "</Level>\n  </System>\n  <EventData>\n    <Data>", _C("message"),
            "</Data>\n  </EventData>\n</Event>",
        ),
        "generic": lambda: _text("  ", plain, " ", F.lower("level"), " from ", _C("ip"), " ", _C("message"), "  "),
    }
    return texts[format]()


def rendered(spark: SparkSession, sf_dir: str, format: str) -> DataFrame:
    """All events as records of one source; the number is the event id."""
    return base_events(spark, sf_dir).select(
        F.lit("events.log").alias("source"),
        F.col("event_id").alias("line_id"),
        line_text(format).alias("value"),
    )


#: Lines of a mixed source are numbered event by event, at most 16 for each.
LINES_PER_EVENT = 16
MIXED_FORMATS = (
    "custom", "syslog", "apache", "apache_modjk", "tomcat_connector", "json", "docker_json",
    "kubernetes_json", "cloudwatch_export", "gcp_cloud_logging", "windows_event_xml", "generic",
)
STACK_FRAME = "\n\tat worker.run(worker.py:7)"


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as lines of twelve sources, each in a format of its own.

    Errors of the bracketed format carry a stack frame on a second line.
    """
    number = F.col("event_id") % len(MIXED_FORMATS)
    record = F
    for i, name in enumerate(MIXED_FORMATS):
        # A blank at the front would make a line continue the one before it.
        text = F.trim(line_text(name))
        if name == "custom":
            text = F.when(_C("level") == "ERROR", _text(text, STACK_FRAME)).otherwise(text)
        record = record.when(number == i, text)
    return (
        base_events(spark, sf_dir)
        .select(_text("src", number.cast("string")).alias("source"), "event_id", record.alias("r"))
        .select("source", "event_id", F.posexplode(F.split("r", "\n")).alias("i", "value"))
        .select(
            "source", (F.col("event_id") * LINES_PER_EVENT + F.col("i")).alias("line_id"), "value"
        )
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all documents, every third with a time put before it."""
    return (
        spark.read.parquet(f"{sf_dir}/documents.parquet")
        .select(
            F.col("doc_id").cast("string").alias("source"),
            F.posexplode(F.split("text", "\n")).alias("i", "line"),
        )
        .select(
            "source",
            F.col("i").cast("bigint").alias("line_id"),
            F.when(F.col("i") % 3 == 0, F.concat(F.lit("[2024-01-01 00:00:00] "), "line"))
            .otherwise(F.col("line"))
            .alias("value"),
        )
    )
