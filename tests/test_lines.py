"""Reading, stitching, detection, caps and pages, against plain Python."""

import gzip
import random
import re

import pytest
from pyspark.sql import functions as F

import logloom as L
from logloom.operators.ordering import CHUNK_BITS

CHUNK = 1 << CHUNK_BITS


def stitched(numbered):
    """What assembly should give for (line_id, text) pairs in order."""
    records = []
    for number, text in numbered:
        if not records or re.match(r"^\[?\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d|^\{", text):
            records.append((number, [text]))
        else:
            records[-1][1].append(text)
    return {(number, "\n".join(texts)) for number, texts in records}


def found(df):
    return {(r["record_id"], r["value"]) for r in df.collect()}


def test_stack_trace(lines):
    texts = ["2025-03-02 07:15:00 ERROR x", "    at a", "Caused by: b", "2025-03-02 07:16:00 INFO y"]
    got = L.assemble_records(lines(texts))
    assert found(got) == {(0, "\n".join(texts[:3])), (3, texts[3])}
    assert L.assemble_records(lines([])).count() == 0
    assert found(L.assemble_records(lines(["no start"]))) == {(0, "no start")}


@pytest.mark.parametrize("share", [0.0, 0.02, 0.5, 1.0])
def test_records_across_chunks(spark, share):
    """Numbers jump between chunks; records run over their borders."""
    rng = random.Random(7)
    numbers, at = [], 0
    for _ in range(300):
        at += rng.choice([1, 1, 1, 5, CHUNK // 3, CHUNK * 2])
        numbers.append(at)
    pairs = [(n, ("[2025-03-02 07:15:00] go " if rng.random() < share else "more ") + str(n)) for n in numbers]
    rows = [("a", n, t) for n, t in pairs] + [("b", n, t) for n, t in pairs[:50]]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "source string, line_id bigint, value string").repartition(7)
    got = L.assemble_records(df)
    assert found(got.filter("source = 'a'")) == stitched(pairs)
    assert found(got.filter("source = 'b'")) == stitched(pairs[:50])


STARTS = {
    "custom": "[2025-03-02 07:15:00] [ERROR] [api] failed",
    "syslog": "Mar  2 07:15:00 h t[1]: failed",
    "apache_modjk": "[Sun Mar 02 07:15:00 2025] [error] failed",
    "generic": "2025-03-02 07:15:00 ERROR failed",
}


@pytest.mark.parametrize("format", STARTS)
def test_records_over_hundreds_of_chunks(spark, format):
    """Parsing gives one row per record with all its text, at any length."""
    rng = random.Random(format)
    rows, wanted, at = [], {}, 0
    for size in (1, 700, 2, 300, 1):
        first = at
        texts = [STARTS[format]] + [f"    frame {first} {i}" for i in range(1, size)]
        for text in texts:
            rows.append(("a", at, text, format))
            at += rng.choice([1, CHUNK, CHUNK * 3])
        wanted[first] = texts[1:]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "source string, line_id bigint, value string, format string").repartition(5)
    got = {r["record_id"]: r["message"] for r in L.parse(L.records_of(df), year=2025).collect()}
    assert set(got) == set(wanted)
    for first, tail in wanted.items():
        message = got[first].split("\n")
        assert message[0].endswith("failed")
        assert [t.strip() for t in message[1:]] == [t.strip() for t in tail]


def test_files_split_into_blocks(spark, tmp_path):
    """Line order, numbering and assembly hold when files are cut into blocks."""
    rng = random.Random(3)
    wanted = {}
    for name in ("a.log", "b.log", "c.log"):
        texts = [
            ("[2025-03-02 07:15:00] [INFO] [m] " if rng.random() < 0.4 else "  at ") + f"{name}{i} " + "é" * rng.randrange(60)
            for i in range(900)
        ]
        (tmp_path / name).write_text("\n".join(texts) + "\n")
        wanted[name] = texts
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1000")
        lines = L.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 10
        rows = lines.collect()
        records = L.assemble_records(lines).collect()
    finally:
        for key, size in old.items():
            spark.conf.set(key, size)
    for name, texts in wanted.items():
        mine = sorted((r["line_id"], r["value"]) for r in rows if r["source"].endswith(name))
        assert [t for _, t in mine] == texts
        assert len({n for n, _ in mine}) == len(texts)
        got = {(r["record_id"], r["value"]) for r in records if r["source"].endswith(name)}
        assert got == stitched(mine)


def test_decoding(spark, tmp_path):
    (tmp_path / "x.log").write_bytes(b"good \xc3\xa9\r\nbad \xff\xfe end\nkept \xef\xbf\xbd\n")
    got = [r["value"] for r in L.read_lines(spark, str(tmp_path)).orderBy("line_id").collect()]
    assert got == ["good é\r", "bad  end", "kept �"]
    latin = L.read_lines(spark, str(tmp_path), encoding="ISO-8859-1").orderBy("line_id").collect()
    assert latin[1]["value"] == "bad ÿþ end"
    with gzip.open(tmp_path / "y.log.gz", "wt") as f:
        f.write("one\ntwo\n")
    assert L.read_lines(spark, str(tmp_path / "y.log.gz")).count() == 2


DETECTED = {
    "[2025-03-02 07:15:00] [INFO] [api] m": "custom",
    "Mar  2 07:15:00 h nginx: m": "syslog",
    '127.0.0.1 - - [02/Mar/2025:07:15:00 +0000] "GET / HTTP/1.1" 200 1': "apache",
    "[Sun Mar 02 07:15:00 2025] [notice] m": "apache_modjk",
    "2025-03-02 07:15:00.123 [warn] m": "tomcat_connector",
    '{"level": "INFO"}': "json",
    '{"log":"x","time":"t"}': "docker_json",
    '{"log":"x","time":"t","kubernetes":{"a":1}}': "kubernetes_json",
    '{"logGroup":"g","logStream":"s","message":"m"}': "cloudwatch_export",
    '{"textPayload":"x"}': "gcp_cloud_logging",
    '  <Event xmlns="x">': "windows_event_xml",
    "a mystery": "generic",
}


def test_detection(spark, lines):
    rows = [(text, 0, text) for text in DETECTED]
    df = spark.createDataFrame(rows, "source string, line_id bigint, value string")
    got = {r["source"]: r["format"] for r in L.detect_formats(df).collect()}
    assert got == DETECTED
    plain = {r["source"]: r["format"] for r in L.detect_formats(df, order="reference").collect()}
    assert plain['{"log":"x","time":"t"}'] == "json"
    assert L.detect_format(lines(["?", "[2025-03-02 07:15:00] [INFO] [api] m"])) == "custom"
    assert L.detect_format(lines([])) == "generic"


def test_detection_sees_the_first_lines_only(spark):
    """Format order beats line order, and line 52 does not count."""
    syslog, custom = "Mar  2 07:15:00 h t: m", "[2025-03-02 07:15:00] [INFO] [api] m"
    def source(name, texts):
        return [(name, i, t) for i, t in enumerate(texts)]
    rows = (
        source("late", ["x"] * 50 + [custom]) + source("too late", ["x"] * 51 + [custom])
        + source("both", [syslog, custom])
    )
    df = spark.createDataFrame(rows, "source string, line_id bigint, value string").repartition(5)
    got = {r["source"]: r["format"] for r in L.detect_formats(df).collect()}
    assert got == {"late": "custom", "too late": "generic", "both": "custom"}


def test_unknown_source_formats_without_broadcast(spark, lines):
    df = L.with_format(lines(["Mar  2 07:15:00 h t: m"]), broadcast_sources=0)
    assert df.first()["format"] == "syslog"


@pytest.mark.parametrize("n", [1, 40, 100, 10**6])
def test_max_lines(spark, n):
    rng = random.Random(n)
    numbers = {s: sorted(rng.sample(range(CHUNK * 4), 90)) for s in "ab"}
    rows = [(s, i, "t") for s in numbers for i in numbers[s]]
    df = spark.createDataFrame(rows, "source string, line_id bigint, value string").repartition(6)
    got = L.max_lines(df, n)
    assert {(r["source"], r["line_id"]) for r in got.collect()} == {(s, i) for s in numbers for i in numbers[s][:n]}
    assert L.max_lines(df, 0) is df


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_pages(spark, monkeypatch, broadcast):
    monkeypatch.setattr("logloom.operators.ordering.BROADCAST_PAGE", broadcast)
    rng = random.Random(1)
    keys = sorted((s, i) for s in "abc" for i in rng.sample(range(CHUNK * 80), 70))
    rows = [(s, i, f"{s}{i}") for s, i in keys]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "source string, record_id bigint, message string").repartition(6)
    for page in (1, 2, 3, 5):
        got = [(r["source"], r["record_id"]) for r in L.page_rows(df, page, 50).collect()]
        assert got == keys[(page - 1) * 50 : page * 50]
    assert L.page_rows(df.withColumn("level", F.lit("x"))).columns == ["level", "message", "source", "record_id"]


def test_pipeline_over_a_mixed_folder(spark, tmp_path):
    (tmp_path / "a.log").write_text("[2025-03-02 07:15:00] [ERROR] [m] failed\n  at f()\n[2025-03-02 07:15:01] [INFO] [m] ok me@x.org\n")
    (tmp_path / "b.json").write_text('{"level":"INFO","msg":"one"}\n{"level":"INFO","msg":"two"}\n')
    logs = L.load_logs(spark, str(tmp_path), redact=True)
    got = {r["message"]: r for r in logs.collect()}
    assert set(got) == {"failed\n  at f()", "ok me@x.org", "one", "two"}
    assert got["ok me@x.org"]["redacted_message"] == "ok <email>"
    assert got["one"]["format"] == "json" and got["one"]["source"].endswith("b.json")
    assert L.load_logs(spark, str(tmp_path), max_lines=1).count() == 2
    assert L.load_logs(spark, str(tmp_path / "a.log"), "generic", enrich=False).count() == 2


def test_lines_without_source_or_number(spark):
    """They are capped and stitched like all others, and none is lost."""
    rows = [(None, i, f"n{i}") for i in range(4)] + [("s", None, "x"), ("s", 0, "y"), ("s", 1, "z"), (None, None, "m")]
    df = spark.createDataFrame(rows, "source string, line_id bigint, value string")
    got = sorted((r["source"] or "", r["value"]) for r in L.max_lines(df, 2).collect())
    assert got == [("", "m"), ("", "n0"), ("s", "x"), ("s", "y")]
    assert L.max_lines(df, 5).count() == 8
    start = "2025-03-02 07:00:00 "
    rows = [("s", None, start + "a"), ("s", 0, "\tb"), ("s", 1, start + "c"), (None, 7, start + "d"), (None, 8, "\te")]
    df = spark.createDataFrame(rows, "source string, line_id bigint, value string").coalesce(1)
    records = {(r["source"], r["record_id"], r["value"]) for r in L.assemble_records(df).collect()}
    assert records == {("s", None, start + "a\n\tb"), ("s", 1, start + "c"), (None, 7, start + "d\n\te")}
