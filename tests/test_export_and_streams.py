import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import logloom as L
from logloom.plans.catalog import _in_slices
from logloom.sources.sinks import read_csv_export
from logloom.streaming import versions
from logloom.streaming.jobs import read_snapshot, to_files, to_snapshot
from logloom.streaming.records import folder_of, read_records, stream_blocks, to_records
from logloom.streaming.totals import hourly_parts, read_totals, to_totals

ODD = ['say "hi", ok', "  edges  ", "two\nlines", "back\\slash", "ünï", "a,b;c", None, "mail k9@mail.example"]


def odd_logs(spark):
    rows = [(datetime(2025, 3, 2 + i % 2, 7), "INFO", text) for i, text in enumerate(ODD)]
    return spark.createDataFrame(rows, "timestamp timestamp, level string, message string")


def test_csv_and_json_round_trip(spark, tmp_path):
    logs = odd_logs(spark)
    L.write_csv(logs, str(tmp_path / "csv"))
    L.write_json(logs, str(tmp_path / "json"))
    want = sorted(map(tuple, logs.collect()), key=repr)
    csv = read_csv_export(spark, str(tmp_path / "csv"), logs.schema)
    assert sorted(map(tuple, csv.collect()), key=repr) == want
    json = spark.read.schema(logs.schema).json(str(tmp_path / "json"))
    assert sorted(map(tuple, json.collect()), key=repr) == want
    raw = spark.read.text(str(tmp_path / "json"))
    assert raw.filter(F.col("value").contains('"message":null')).count() == 1
    assert raw.filter(F.col("value").contains("2025-03-02T07:00:00")).count() == 4


def test_redacted_export(spark, tmp_path):
    L.write_json(odd_logs(spark), str(tmp_path / "json"), redact=True)
    raw = spark.read.text(str(tmp_path / "json"))
    assert raw.filter(F.col("value").contains("mail <email>")).count() == 1
    shown = L.add_redacted(odd_logs(spark))
    assert shown.filter("message LIKE '%k9@%' AND redacted_message LIKE '%<email>'").count() == 1
    both = L.redact_columns(odd_logs(spark).withColumn("ip", F.lit("192.0.2.1")), ["message", "ip"])
    assert both.first()["ip"] == "<ip>"


def test_parquet_by_day_reads_one_day(spark, tmp_path):
    L.write_parquet(odd_logs(spark), str(tmp_path / "p"))
    day = spark.read.parquet(str(tmp_path / "p")).filter("day = DATE '2025-03-03'")
    assert day.count() == 4 and len(day.inputFiles()) >= 1
    assert "PartitionFilters: [isnotnull(day" in day._jdf.queryExecution().executedPlan().toString()


def test_stream_of_files(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def put(name, *minutes):
        texts = [f"[2025-03-02 {m // 60:02d}:{m % 60:02d}:00] [ERROR] [m] from k9@mail.example latency={m}ms" for m in minutes]
        (source / name).write_text("\n".join(texts + ["not a record"]) + "\n")

    def run():
        logs = L.stream_logs(L.stream_lines(spark, str(source)), "custom", redact=True)
        job = to_files(logs, out, str(tmp_path / "state")).trigger(availableNow=True)
        job.start().awaitTermination()
        hourly = L.stream_hourly(L.stream_logs(L.stream_lines(spark, str(source)), "custom"))
        job = to_snapshot(hourly, str(tmp_path / "hours"), str(tmp_path / "hour-state"))
        job.trigger(availableNow=True).start().awaitTermination()

    put("a.log", 60, 61, 130)
    run()
    assert spark.read.parquet(out).count() == 3
    put("b.log", 62, 200)
    run()
    logs = spark.read.parquet(out)
    assert logs.count() == 5
    assert logs.filter("redacted_message LIKE 'from <email>%' AND line_type = 'OTHER'").count() == 5
    assert sorted(r["response_time_ms"] for r in logs.collect()) == [60.0, 61.0, 62.0, 130.0, 200.0]
    hours = read_snapshot(spark, str(tmp_path / "hours")).orderBy("timestamp").collect()
    assert [(r["timestamp"].hour, r["count"], r["errors"]) for r in hours] == [(1, 3, 3), (2, 1, 1), (3, 1, 1)]


def test_records_over_several_files(spark, tmp_path):
    """Formats and records that only later files settle, a quiet source, and a batch run again."""
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    options = {"sample_lines": 3, "year": 2025}
    seconds = 1_700_000_000

    def put(name, text):
        nonlocal seconds
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
        seconds += 100
        os.utime(folder / name, (seconds, seconds))

    def run(number, idle=None):
        blocks = stream_blocks(spark, str(folder / "*"))
        job = to_records(blocks, out, state, str(tmp_path / f"checkpoint{number}"), source=folder_of, idle_seconds=idle, **options)
        job.trigger(availableNow=True).start().awaitTermination()
        rows = {f: read_records(spark, out, state, finished=f, **options).collect() for f in (False, True)}
        return [sorted((r["source"].rsplit("/", 1)[1], r["format"], r["message"]) for r in rows[f]) for f in (False, True)]

    line = "[2025-03-02 07:00:00] [ERROR] [m] "
    put("a/1", f"{line}one\n\tframe 1\n")
    put("j/1", '{"level": "INFO", "message": "x"}\n')
    every, finished = run(0)
    assert every == [("a", "custom", "one\n\tframe 1"), ("j", "json", "x")] and finished == []
    put("a/2", f"\tframe 2\n\tframe 3\n{line}two\n")
    every, finished = run(0)
    one = "one\n\tframe 1\n\tframe 2\n\tframe 3"
    assert every == [("a", "custom", one), ("a", "custom", "two"), ("j", "json", "x")]
    assert finished == [("a", "custom", one)]
    put("a/3", "\tlast\n")
    put("j/2", '{"level": "INFO", "message": "y"}\n{"level": "INFO", "message": "z"}\n')
    every, finished = run(0)
    assert every == [("a", "custom", one), ("a", "custom", "two\n\tlast"), *(("j", "json", m) for m in "xyz")]
    assert finished == [every[0], *every[2:]]
    # Batch 2 again, as after a failure, over another file set: versions start from batch 1.
    assert versions.committed(spark, state) == [0, 1, 2] and versions.before(spark, state, 2) == 1
    put("k/1", "free text\n")
    every, finished = run(0, idle=50)
    assert every == [("a", "custom", one), ("a", "custom", "two\n\tlast"), *(("j", "json", m) for m in "xyz"), ("k", "generic", "free text")]
    assert len(finished) == 5 and versions.committed(spark, state) == [1, 2, 3]
    assert spark.read.parquet(f"{state}/v=3/lines").count() == 1 and spark.read.parquet(f"{state}/v=3/known").count() == 0
    with pytest.raises(ValueError, match="another checkpoint"):
        versions.before(spark, str(tmp_path / "other"), 4)


def test_totals_lose_no_row(spark, tmp_path):
    """Rows ten hours late are added; state is a row per hour; a batch run again counts once."""
    out, source = str(tmp_path / "out"), tmp_path / "in"
    source.mkdir()
    for name, hours in (("a", (20, 21)), ("b", (10, 21)), ("c", (10, 20, 5))):
        texts = [f"[2025-03-02 {h:02d}:00:01] [{level}] [m] x" for h in hours for level in ("ERROR", "INFO")]
        (source / name).write_text("\n".join(texts) + "\n")
        logs = L.stream_logs(L.stream_lines(spark, str(source)), "custom")
        job = to_totals(hourly_parts(logs), out, str(tmp_path / "checkpoint"))
        job.trigger(availableNow=True).start().awaitTermination()
    got = read_totals(spark, out).orderBy("timestamp").collect()
    want = [(5, 2, 1), (10, 4, 2), (20, 4, 2), (21, 4, 2)]
    assert [(r["timestamp"].hour, r["count"], r["errors"]) for r in got] == want
    (tmp_path / "checkpoint/commits/2").unlink()  # the batch was done, its end was not noted
    (tmp_path / "checkpoint/commits/.2.crc").unlink(missing_ok=True)
    job = to_totals(hourly_parts(logs), out, str(tmp_path / "checkpoint"))
    job.trigger(availableNow=True).start().awaitTermination()
    got = read_totals(spark, out).orderBy("timestamp").collect()
    assert [(r["timestamp"].hour, r["count"], r["errors"]) for r in got] == want


def test_files_in_order_of_their_names(spark, tmp_path):
    """Files written side by side follow each other by name, whichever was done first."""
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    texts = ["[2025-03-02 07:00:00] [ERROR] [m] one\n\tframe 1\n", "\tframe 2\n", "\tframe 3\n[2025-03-02 07:00:01] [INFO] [m] two\n"]
    for i, text in enumerate(texts):
        (folder / f"part-{i}").write_text(text)
        os.utime(folder / f"part-{i}", (1_700_000_000 - 100 * i,) * 2)
    job = to_records(stream_blocks(spark, str(folder)), out, state, str(tmp_path / "checkpoint"), source=folder_of, by_name=True)
    job.trigger(availableNow=True).start().awaitTermination()
    got = read_records(spark, out, state, by_name=True).collect()
    assert sorted(r["message"] for r in got) == ["one\n\tframe 1\n\tframe 2\n\tframe 3", "two"]


def test_slices_are_written_by_many_tasks(spark, tmp_path):
    """No slice of the streams' files is one task's, and files by name are in the order of the numbers."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines = spark.range(1000).selectExpr("id AS number", "cast(id AS string) AS value")
        assert list(_in_slices(lines, str(tmp_path / "in"), [0.1, 0.5])) == [0, 1, 2]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for i, (start, end) in enumerate([(0, 100), (100, 500), (500, 1000)]):
        files = sorted((tmp_path / f"in/slice={i}").glob("part-*"))
        assert len(files) > 4
        assert [int(x) for f in files for x in f.read_text().split()] == list(range(start, end))
