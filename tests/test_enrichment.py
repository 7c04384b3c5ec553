import pytest
from pyspark.sql import functions as F

import logloom as L
from logloom.functions import enrichment as en
from logloom.functions.predicates import is_error, is_http, is_warning

LINE_TYPES = {
    "PUT /a HTTP/2": "HTTP_ACCESS",
    "caused BY: x": "EXCEPTION",
    "called at Foo.bar": "EXCEPTION",
    "ora-00942": "DB_ERROR",
    "deadlock found": "DB_ERROR",
    "time out reached": "TIMEOUT",
    "Login Failed for k9": "AUTH",
    "Connection Closed": "NETWORK",
    "disk\tfull": "RESOURCE",
    "CPU limit hit": "RESOURCE",
    "environment: env var X": "CONFIG",
    "Server  starting": "OTHER",
    "the Service stopped": "STARTUP_SHUTDOWN",
    "gc (minor)": "GC",
    "nothing special": "OTHER",
    None: "UNKNOWN",
}


@pytest.fixture
def value(spark):
    """The value of a column over a one-row table with the text."""

    def get(text, column):
        df = spark.createDataFrame([(text,)], "text string")
        return df.select(column(F.col("text")).alias("v")).first()["v"]

    return get


def test_line_types(spark):
    df = spark.createDataFrame([(k, v) for k, v in LINE_TYPES.items()], "text string, want string")
    assert df.filter(en.line_type(F.col("text")) != F.col("want")).collect() == []


@pytest.mark.parametrize(
    "text,want",
    [
        ("latency=250ms", 250.0), ("response_time=1.5s", 1500.0), ("duration=2sec", 2000.0),
        ("TIME: 300", 300.0), ("request-time : .5 seconds", 500.0), ("uptime=5", 5.0),
        ("took 5ms", None), ("time out after=1", None), (None, None), ("", None),
    ],
)
def test_response_time(value, text, want):
    assert value(text, en.response_time_ms) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("write k9@mail.example now", "write <email> now"),
        ("from 192.0.2.1 to 256.0.0.1", "from <ip> to 256.0.0.1"),
        ("id 123e4567-e89b-12d3-a456-426614174000", "id <uuid>"),
        ("k AKIA" + "A" * 16 + " j eyJa.eyJb.c", "k <token> j <token>"),
        ("é10.0.0.1 and 10.0.0.1é", "é10.0.0.1 and 10.0.0.1é"),
        ("clean", "clean"), (None, None), ("", ""),
    ],
)
def test_redaction(value, spark, text, want):
    assert value(text, en.redact_pii) == want
    L.register_sql_functions(spark)
    assert value(text, lambda c: F.expr("redact_pii(text)")) == want


def test_sql_functions_agree_with_columns(spark):
    assert set(L.register_sql_functions(spark)) == {
        "redact_pii", "detect_line_type", "parse_response_time", "parse_user_agent"
    }
    texts = [k for k in LINE_TYPES] + ["latency=2s", "Mozilla Chrome/9 Windows NT"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    pairs = [
        ("detect_line_type", en.line_type), ("parse_response_time", en.response_time_ms),
        ("parse_user_agent", en.user_agent),
    ]
    for name, column in pairs:
        assert df.filter(~F.expr(f"{name}(text)").eqNullSafe(column(F.col("text")))).count() == 0


@pytest.mark.parametrize(
    "agent,want",
    [
        ("Mozilla/5.0 (Windows NT 10.0) Chrome/9.1", ("Chrome", "Windows", "Desktop")),
        ("Mozilla/5.0 (X11; Linux x86_64) Firefox/9", ("Firefox", "Linux", "Desktop")),
        ("Mozilla (Linux; Android 9) Chrome/1 Mobile", ("Chrome", "Linux", "Mobile")),
        ("x Edg/9", ("Edge", "Other", "Other")), ("Trident/7", ("IE", "Other", "Other")),
        ("", ("Other",) * 3), (None, ("Other",) * 3),
    ],
)
def test_user_agents(value, agent, want):
    assert tuple(value(agent, en.user_agent)) == want


def test_add_enrichments(spark):
    df = spark.createDataFrame(
        [
            (0, "ERROR", "GET /h HTTP/1.1 200 latency=50ms user_id=abc from 10.0.0.9", None, None),
            (1, "404", "query ran", "10.0.0.1", "curl"),
            (2, None, "x 5000 503", None, None),
        ],
        "record_id bigint, level string, message string, ip string, user_agent string",
    )
    got = L.add_enrichments(df).orderBy("record_id").collect()
    first = got[0]
    assert (first["line_type"], first["request_type"], first["request_path"]) == ("HTTP_ACCESS", "GET", "/h")
    assert (first["status_code"], first["response_time_ms"], first["user_id"]) == ("200", 50.0, "abc")
    assert [r["ip"] for r in got] == ["10.0.0.9", "10.0.0.1", None]
    assert [r["status_code"] for r in got] == ["200", "404", "503"]
    whole = L.add_enrichments(df, ip_mode="dataset").orderBy("record_id").collect()
    assert [r["ip"] for r in whole] == [None, "10.0.0.1", None]
    once = L.add_enrichments(df, ip_mode="dataset")._jdf.queryExecution().executedPlan().toString()
    assert once.count("FileScan") == 1 and "/parsed-" in once and "Subquery" not in once
    none = L.add_enrichments(df.withColumn("ip", F.lit(None).cast("string")), ip_mode="dataset")
    assert none.orderBy("record_id").first()["ip"] == "10.0.0.9"
    assert "ip" in L.add_enrichments(df.drop("ip")).columns


def test_preserve_parsed(spark):
    df = spark.createDataFrame([("5", "no status", "418", "BREW")], "level string, message string, status_code string, request_type string")
    assert L.add_enrichments(df).first()["status_code"] is None
    kept = L.add_enrichments(df, preserve_parsed=True).first()
    assert (kept["status_code"], kept["request_type"]) == ("418", "BREW")


def test_predicates(spark):
    df = spark.createDataFrame([("error",), ("Warn",), ("WARNING",), ("CRITICAL",), (None,)], "level string")
    assert df.filter(is_error()).count() == 1
    assert df.filter(is_warning()).count() == 2
    assert df.filter(~is_error()).count() == 4
    assert df.filter(is_http("level")).count() == 0
