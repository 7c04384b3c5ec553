"""Sequence mining against a direct count over every error's history."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

import logloom as L

SCHEMA = "timestamp timestamp, source string, record_id bigint, level string, line_type string, module string"
START = datetime(2025, 3, 2, 7)


def direct(rows, minutes, seq_len, lookback=50):
    # All of one source, so that number alone orders rows of one instant.
    rows = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[2]))
    counts = Counter()
    for error in rows:
        if (error[3] or "").upper() != "ERROR":
            continue
        since = error[0] - timedelta(minutes=minutes)
        tokens = [f"{r[4] or 'NA'}:{r[5] or 'NA'}" for r in rows if since <= r[0] < error[0]][-lookback:]
        for n in range(2, seq_len + 1):
            counts.update(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))
    return dict(counts)


def mined(df, **options):
    return {tuple(r["sequence"]): r["count"] for r in L.mine_sequences(df, top_k=10**6, **options).collect()}


@pytest.mark.parametrize("seed,step,share", [(1, 30, 0.2), (2, 3, 0.3), (3, 0.4, 0.1), (4, 600, 0.5)])
def test_against_direct_count(spark, seed, step, share):
    """Few and many rows in a window, many rows on one instant, small slices."""
    rng = random.Random(seed)
    rows, at = [], 0.0
    for i in range(700):
        at += rng.choice([0, 0, step, step * 3])
        rows.append((
            START + timedelta(seconds=int(at)), "s", i, "error" if rng.random() < share else "INFO",
            rng.choice(["HTTP_ACCESS", "TIMEOUT", None]), rng.choice(["api", "db", None]),
        ))
    rows.append((None, "s", 999, "ERROR", "GC", "db"))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for slice_rows in (50, 64, 200_000):
        assert mined(df, window_minutes=5, seq_len=4, slice_rows=slice_rows) == direct(rows, 5, 4)


@pytest.mark.parametrize("lookback", [1, 7])
def test_other_look_backs(spark, lookback):
    rng = random.Random(lookback)
    rows = [
        (START + timedelta(seconds=i // 3), "s", i, rng.choice(["ERROR", "INFO", "INFO"]), rng.choice("ab"), "m")
        for i in range(300)
    ]
    got = mined(spark.createDataFrame(rows, SCHEMA).repartition(3), lookback_rows=lookback, slice_rows=16)
    assert got == direct(rows, 5, 3, lookback)


def test_one_instant_holds_most_rows(spark):
    """An instant far larger than the limit leaves only its last 50 rows in a history."""
    rows = [(START, "s", i, "INFO", "OTHER", f"m{i % 7}") for i in range(3000)]
    rows += [(START + timedelta(seconds=9), "s", 5000 + i, "ERROR", "GC", "x") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(16)
    assert mined(df, slice_rows=60) == direct(rows, 5, 3)


def test_shape_and_edges(spark):
    rows = [
        (START + timedelta(minutes=i), "s", i, "ERROR" if i % 5 == 4 else "INFO",
         "TIMEOUT" if i % 5 == 4 else "HTTP_ACCESS", "api" if i % 2 == 0 else "db")
        for i in range(30)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    top = L.mine_sequences(df)
    assert top.columns == ["sequence", "count"] and top.count() <= 15
    text = top.select(L.sequence_text().alias("t")).first()["t"]
    assert " → " in text
    assert L.mine_sequences(df.filter("false")).count() == 0
    assert L.mine_sequences(df.filter("level = 'INFO'")).count() == 0
    assert L.mine_sequences(df.drop("timestamp")).count() == 0
    assert L.mine_sequences(df, seq_len=1).count() == 0


def test_error_history_at_a_busy_instant(spark):
    """Against plain Python: random times, many rows and errors of one instant, small limits."""
    rng = random.Random(21)
    rows = []
    for i in range(400):
        minute = 7 if i < 120 else rng.randint(0, 30)
        rows.append(("s", i, datetime(2025, 3, 2, 7, minute), rng.choice(["ERROR", "INFO", "INFO"]), "m", f"text {i}"))
    rows.append(("s", 400, None, "ERROR", "m", "no time"))
    schema = "source string, record_id long, timestamp timestamp, level string, module string, message string"
    df = spark.createDataFrame(rows, schema).repartition(3)
    for window, limit in ((5, 7), (3, 50), (60, 50)):
        want = set()
        for _, e, at, level, _, _ in rows:
            if level == "ERROR" and at:
                before = [r for r in rows if r[2] and timedelta(0) < at - r[2] <= timedelta(minutes=window)]
                latest = sorted(before, key=lambda r: (r[2], r[1]), reverse=True)[:limit]
                want |= {(e, place, r[1], r[5]) for place, r in enumerate(latest, 1)}
        got = L.error_history(df, window, limit).select("error_id", "place", "record_id", "message").collect()
        assert len(got) == len(want) and set(map(tuple, got)) == want
    assert L.error_history(df.limit(0)).count() == 0
