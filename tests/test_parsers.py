import random
from collections import Counter
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

import logloom as L
from logloom.operators.parse import BUILT_IN_FALLBACK, FORMATS, parse, register_parser, unregister_parser

CUSTOM = [
    "[2025-03-02 07:15:09] [ERROR] [billing] invoice 77 rejected, latency=2.5s user_id=k9",
    "[2025-03-02 07:15:10] [info] [api] ready",
    "[2025-3-2 7:5:1] [WARN] [a b] unpadded time",
    "[2025-03-02 07:15:11] [DEBUG] [x] ",
    "[2025-13-02 07:15:11] [DEBUG] [x] no such month",
    "no brackets at all",
]


def rows(df):
    return df.orderBy("record_id").collect()


def test_custom(lines):
    got = rows(L.parse(lines(CUSTOM), "custom"))
    assert [r["level"] for r in got] == ["ERROR", "info", "WARN", "DEBUG"]
    assert [r["module"] for r in got] == ["billing", "api", "a b", "x"]
    assert got[2]["timestamp"] == datetime(2025, 3, 2, 7, 5, 1)
    assert got[3]["message"] == ""
    assert got[0]["format"] == "custom" and got[0]["source"] == "s"


def test_custom_keeps_or_cuts_stitched_lines(lines):
    text = "[2025-03-02 07:15:09] [ERROR] [m] failed\n  at f()\n  at g()"
    assert rows(L.parse(lines([text]), "custom"))[0]["message"] == "failed\n  at f()\n  at g()"
    cut = L.parse(lines([text]), "custom", first_line_only=True)
    assert rows(cut)[0]["message"] == "failed"


def test_custom_with_own_layout(lines):
    config = {"timestamp_format": "%d/%b/%Y:%H:%M:%S"}
    got = rows(L.parse(lines(["[02/Mar/2025:07:15:09] [INFO] [m] x"]), "custom", config))
    assert got[0]["timestamp"] == datetime(2025, 3, 2, 7, 15, 9)


def test_syslog(lines):
    texts = [
        "Mar  2 07:15:10 edge-3 haproxy[88]: an Error opening file",
        "Mar  2 07:15:11 edge-3 app: all is well",
        "Mar 12 07:15:12 edge-3 db: WARN: too many",
        "Mar  2 07:15:13 edge-3 kernel: notice debug",
        "something else",
    ]
    got = rows(L.parse(lines(texts), "syslog", year=2025))
    assert [r["level"] for r in got] == ["ERROR", "INFO", "WARNING", "INFO"]
    assert [r["module"] for r in got] == ["haproxy[88]", "app", "db", "kernel"]
    assert {r["ip"] for r in got} == {"edge-3"}
    assert got[2]["timestamp"] == datetime(2025, 3, 12, 7, 15, 12)


def test_syslog_year_from_file_time(spark):
    df = spark.createDataFrame(
        [("s", 0, "Dec 31 23:00:00 h t: m", datetime(2025, 1, 2)),
         ("s", 1, "Jan  1 01:00:00 h t: m", datetime(2025, 1, 2))],
        "source string, line_id bigint, value string, modified timestamp",
    )
    assert [r["timestamp"].year for r in rows(L.parse(df, "syslog"))] == [2024, 2025]


def test_apache_combined_common_and_bad(lines):
    texts = [
        '203.0.113.7 - - [02/Mar/2025:07:15:11 +0100] "GET /cart?id=5 HTTP/1.1" 503 41 "-" "Mozilla/5.0 (X11)"',
        '203.0.113.8 - bob [02/Mar/2025:07:15:12 +0000] "POST /in HTTP/1.0" 200 - "http://r" ""',
        '203.0.113.9 - - [02/Mar/2025:07:15:13 +0000] "PUT /x HTTP/1.1" 204 0',
        "not an access line",
    ]
    got = rows(L.parse(lines(texts), "apache"))
    assert [r["status_code"] for r in got] == ["503", "200", "204"]
    assert [r["user_agent"] for r in got] == ["Mozilla/5.0 (X11)", "", None]
    assert got[0]["timestamp"] == datetime(2025, 3, 2, 6, 15, 11)
    assert (got[0]["request_type"], got[0]["request_path"]) == ("GET", "/cart?id=5")
    assert got[0]["message"] == "GET /cart?id=5 HTTP/1.1"
    assert got[0]["module"] == got[0]["ip"] == "203.0.113.7" and got[0]["level"] == "503"


def test_generic_takes_every_line(lines):
    texts = [
        "  2025-03-02 07:15:00 info padded  ", "07:15:00 DEBUG no date", "plain", "",
        "warning at 10.0.0.300 from 10.0.0.30",
    ]
    got = rows(L.parse(lines(texts), "generic"))
    assert [r["level"] for r in got] == ["INFO", "DEBUG", "UNKNOWN", "UNKNOWN", "WARNING"]
    assert got[0]["message"] == "2025-03-02 07:15:00 info padded"
    assert got[1]["timestamp"] is None and got[1]["timestamp_raw"] == "07:15:00"
    assert got[4]["ip"] == "10.0.0.30"
    assert {r["module"] for r in got} == {"unknown"}


def test_json_aliases_and_empty_values(lines):
    texts = [
        '{"time":"2025-03-02T07:15:12Z","severity":"WARN","msg":"long","logger":"jobs","status":500}',
        '{"level":0,"logLevel":"0","message":"","log":"fallback","timestamp":1740899712.25}',
        "not json", '{"broken": }', "[1, 2]", "{}", '{"a":1} rest', '{"ip":null,"client_ip":"1.2.3.4"}',
    ]
    got = rows(L.parse(lines(texts), "json"))
    assert len(got) == 3
    assert (got[0]["level"], got[0]["message"], got[0]["module"]) == ("WARN", "long", "jobs")
    assert got[0]["timestamp"] == datetime(2025, 3, 2, 7, 15, 12) and got[0]["status_code"] == "500"
    assert (got[1]["level"], got[1]["message"]) == ("0", "fallback")
    assert got[1]["timestamp"] == datetime(2025, 3, 2, 7, 15, 12, 250000)
    assert got[2]["ip"] == "1.2.3.4" and got[2]["level"] == "UNKNOWN" and got[2]["message"] == ""


def test_container_and_cloud_json(lines):
    docker = rows(L.parse(lines(['{"log":"a \\n","time":"2025-03-02T07:15:12.5Z"}', '{"log":null,"level":null}']), "docker_json"))
    assert (docker[0]["message"], docker[0]["level"], docker[0]["module"]) == ("a", "INFO", "docker")
    assert docker[1]["level"] is None and docker[1]["message"] == ""
    k8s = rows(L.parse(lines([
        '{"log":"x","kubernetes":{"namespace_name":"n","pod_name":"","container_name":"c"}}',
        '{"log":"x","kubernetes":null}',
    ]), "kubernetes_json"))
    assert [r["module"] for r in k8s] == ["n/c", "kubernetes"]
    cloud = rows(L.parse(lines(['{"logStream":"s","@message":"m","timestamp":1740899712000}']), "cloudwatch_export"))
    assert (cloud[0]["module"], cloud[0]["message"]) == ("s", "m")
    assert cloud[0]["timestamp"] == datetime(2025, 3, 2, 7, 15, 12)
    gcp = rows(L.parse(lines([
        '{"jsonPayload":{"a":[1,{"b":"é"}]},"logName":"p/l/web","httpRequest":{"userAgent":"U"}}',
        '{"jsonPayload":"{text}","protoPayload":{"x":1},"severity":"ERROR"}',
    ]), "gcp_cloud_logging"))
    assert [r["message"] for r in gcp] == ['{"a":[1,{"b":"é"}]}', '{"x":1}']
    assert (gcp[0]["module"], gcp[0]["user_agent"], gcp[0]["level"]) == ("web", "U", "INFO")


EVENT = (
    '<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event">\n<System>\n'
    '<Provider Name="Own-Provider"/>\n<TimeCreated SystemTime="2025-03-02T07:15:00.000Z"/>\n'
    "<Level>4</Level>\n</System>\n<EventData>\n<Data>first\nline</Data>\n</EventData>\n</Event>"
)


def test_windows_events_line_by_line(lines):
    text = "<Events>\n" + EVENT + "\n" + EVENT.replace("Own-", "Other-").replace("<Level>4</Level>", "") + "\n</Events>"
    got = rows(L.logs_from_lines(lines(text.split("\n")), "windows_event_xml", enrich=False))
    assert [r["module"] for r in got] == ["Own-Provider", "Other-Provider"]
    assert [r["level"] for r in got] == ["4", "INFO"]
    assert got[0]["message"] == "first line"
    assert got[0]["timestamp"] == datetime(2025, 3, 2, 7, 15)


@pytest.mark.parametrize("joint", ["\n", ""])
def test_windows_event_files(spark, tmp_path, joint):
    flat = EVENT.replace("\n", " ") if not joint else EVENT
    (tmp_path / "a.xml").write_text("<Events>" + joint.join(flat for _ in range(40)) + "</Events>")
    logs = L.load_logs(spark, str(tmp_path), "windows_event_xml")
    assert logs.count() == 40
    assert logs.select("record_id").distinct().count() == 40
    assert logs.filter("module = 'Own-Provider' AND message = 'first line'").count() == 40


@pytest.mark.parametrize("kept", [0.2, 0.5, 0.97])
def test_event_cut_off_by_the_end_of_its_file(spark, tmp_path, kept):
    """By name, by detection and by lines: only what is finished, also across blocks."""
    text = "<Events>\n" + "\n".join(EVENT.replace("first", f"e{i} first") for i in range(40)) + "\n"
    (tmp_path / "a.xml").write_text(text + EVENT[: int(len(EVENT) * kept)])
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        spark.conf.set("spark.sql.files.openCostInBytes", "500")
        named = L.load_logs(spark, str(tmp_path), "windows_event_xml", enrich=False)
        others = [
            L.load_logs(spark, str(tmp_path), enrich=False),
            L.load_logs(spark, str(tmp_path), "windows_event_xml", enrich=False, max_lines=10**6),
        ]
        wanted = {f"e{i} first line" for i in range(40)}
        for logs in (named, *others):
            messages = [r["message"] for r in logs.collect()]
            assert len(messages) == 40 and set(messages) == wanted
    finally:
        for key, size in old.items():
            spark.conf.set(key, size)


def test_modjk_workers_fallback_and_layouts(lines):
    texts = [
        "[Sun Mar 02 07:15:14 2025] [notice] workerEnv.init() ok /etc/conf/w2.properties",
        "[Sun Mar 02 07:15:18 2025] [error] mod_jk child workerEnv in error state 6",
        "[Sun Mar 02 07:15:37 2025] [notice] jk2_init() Found child 6736 in scoreboard slot 10",
        "[Mar 02 07:15:38 2025] [custom] short",
        "[2025-03-02 07:15:39] [WARN] iso",
        "[02/Mar/2025:07:15:40] [crit] slashes",
        "prefix [Sun Mar 02 07:15:41 2025] no severity",
        "[nonsense] [error] dropped", "", "nothing",
    ]
    got = rows(L.parse(lines(texts), "apache_modjk"))
    assert [r["level"] for r in got] == ["INFO", "ERROR", "INFO", "CUSTOM", "WARNING", "CRITICAL", "INFO"]
    assert [r["timestamp"].second for r in got] == [14, 18, 37, 38, 39, 40, 41]
    assert got[0]["config_file"] == "/etc/conf/w2.properties" and got[0]["worker_type"] == "environment"
    assert got[1]["error_state"] == "6"
    assert (got[2]["worker_type"], got[2]["child_pid"], got[2]["slot"]) == ("child_process", "6736", "10")
    assert got[6]["message"] == texts[6] and got[6]["severity"] == "notice"


def test_tomcat(lines):
    texts = ["2025-03-02 07:15:00.123 [warn] slow", "2025-03-02 07:15:00,123 [odd one] x", "2025-03-02 07:15:00 [warn] no millis"]
    got = rows(L.parse(lines(texts), "tomcat_connector"))
    assert [(r["level"], r["severity"]) for r in got] == [("WARNING", "warn"), ("ODD ONE", "odd one")]
    assert got[0]["timestamp"] == datetime(2025, 3, 2, 7, 15)


def test_every_format_has_the_same_columns_and_takes_no_rows(spark, lines):
    for name in L.get_supported_formats():
        df = L.parse(lines([]), name)
        assert df.schema.names == L.LOG_SCHEMA.names
        assert [f.dataType for f in df.schema] == [f.dataType for f in L.LOG_SCHEMA]
        assert df.count() == 0


def test_unknown_format_is_free_text(lines):
    assert rows(L.parse(lines(["2025-03-02 07:15:00 INFO x"]), "none_such"))[0]["level"] == "INFO"


@pytest.fixture
def joined_lines():
    def joined_lines(texts):
        """A parser with state: it joins what follows a line that ends in a backslash."""
        rows, held, total = [], "", 0
        for at, text in enumerate(texts):
            held += text.removesuffix("\\")
            if not text.endswith("\\"):
                total += len(held)
                rows.append({"message": held, "total": total, "line": at})
                held = ""
        return pd.DataFrame(rows + ([{"message": held, "total": total + len(held), "line": -1}] if held else []))

    return joined_lines


@pytest.mark.parametrize("batch", [1, 7, 10000])
@pytest.mark.parametrize("spread", [1, 5])
def test_row_parsers_with_state(spark, joined_lines, batch, spread):
    """The same rows at any batch size and order, also where a unit runs over chunks of numbers."""
    rng = random.Random(5)
    rows, want = [], []
    for source in ("a", "b", None):
        unit, first = [], None
        for i in range(120):
            text = rng.choice(["# new", "x\\", "yy\\", "z", "", "tail"])
            number = (1 << 60) + 400 * i
            if text.startswith("#") or first is None:
                want += [(source, first, r["message"], r["total"]) for r in joined_lines(unit).to_dict("records")]
                unit, first = [], number
            unit.append(text)
            rows.append((source, number, text))
        want += [(source, first, r["message"], r["total"]) for r in joined_lines(unit).to_dict("records")]
    rng.shuffle(rows)
    rows.append(("a", 1, None))
    table = spark.createDataFrame(rows, "source string, line_id long, value string").repartition(spread)
    own = L.from_rows(joined_lines, "message string, total long", starts=lambda value: value.startswith("#"))
    L.register_parser("joined", own)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = L.parse(table, "joined").select("source", "record_id", "message", "total").collect()
        assert Counter(map(tuple, got)) == Counter(want)
        assert L.parse(table.limit(0), "joined").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        L.unregister_parser("joined")


def test_row_parsers_keep_the_origin(spark):
    """Rows keep source and number of the line they name, to the last bit."""
    def numbered(texts):
        rows = [{"message": t.upper(), "line": i} for i, t in enumerate(texts) if t and t != "skip"]
        return pd.DataFrame(rows + [{"message": "sum", "line": -1}])

    rows = [("s", (1 << 62) + 1, "a"), ("s", 7, "skip"), (None, None, "b"), ("t", (1 << 62) + 3, "c"), ("t", 9, None)]
    table = spark.createDataFrame(rows, "source string, line_id long, value string").coalesce(1)
    got = L.from_rows(numbered, "message string")(table).filter("message <> 'sum'").collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [("s", (1 << 62) + 1, "A"), (None, None, "B"), ("t", (1 << 62) + 3, "C")], key=str
    )
    mine = L.from_rows(lambda texts: pd.DataFrame({"source": [t or "" for t in texts]}), "source string")(table)
    assert mine.columns == ["record_id", "source"] and mine.filter("record_id is null").count() == 5


def test_registered_parsers(lines, spark):
    from pyspark.sql import functions as F

    def by_column(df, config=None):
        tag = (config or {}).get("tag", "none")
        return df.select("source", F.col("value").alias("message"), F.lit(tag).alias("level"))

    def by_python(texts):
        return pd.DataFrame([{"message": t.upper(), "extra": len(t)} for t in texts])

    L.register_parser("own", by_column, "mine", supports_config=True, config_keys=["tag"])
    L.register_parser("own_rows", L.from_rows(by_python, "message string, extra long"))
    try:
        assert L.get_format_info("own") == {"description": "mine", "supports_config": True, "config_keys": ["tag"]}
        assert L.parse(lines(["hello"]), "own", {"tag": "t"}).first()["level"] == "t"
        got = L.parse(lines(["hello", "you"]), "own_rows")
        assert sorted((r["message"], r["extra"]) for r in got.collect()) == [("HELLO", 5), ("YOU", 3)]
        mixed = spark.createDataFrame(
            [("s", 0, CUSTOM[0], "custom"), ("s", 1, "hello", "own_rows"), ("s", 2, "what", "zzz")],
            "source string, line_id bigint, value string, format string",
        )
        found = {r["format"]: r["message"] for r in L.parse(mixed).collect()}
        assert found["own_rows"] == "HELLO" and found["zzz"] == "what" and "invoice" in found["custom"]
    finally:
        L.unregister_parser("own")
        L.unregister_parser("own_rows")
    assert "own" not in L.get_all_format_info()


def test_missing_formats_and_own_fallback(spark):
    """Rows without a format are free text, whatever parsers are registered."""
    rows = spark.createDataFrame([(None, "one"), ("custom", "[2025-01-01 00:00:00] [INFO] [m] two"), ("odd", "three")], "format string, value string")
    assert parse(rows).count() == 3
    table = lambda lines: lines.select(F.concat(F.lit("own "), "value").alias("message"))
    register_parser("mine", table)
    register_parser("generic", table)
    try:
        assert sorted(r.message for r in parse(rows).collect()) == ["own one", "own three", "two"]
    finally:
        unregister_parser("mine")
        FORMATS["generic"] = BUILT_IN_FALLBACK
