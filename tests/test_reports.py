import math
import random
import re
import tracemalloc
from collections import Counter
from datetime import datetime, timedelta
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import logloom as L
from logloom.operators import clusters
from logloom.operators.hourly import METRIC_COLUMNS

START = datetime(2025, 3, 2, 7)


def hours(spark, counts):
    """A log with the given (rows, errors) per hour; hours of (0, 0) are absent."""
    rows = [
        (START + timedelta(hours=h, minutes=i % 60), "ERROR" if i < errors else "INFO")
        for h, (total, errors) in enumerate(counts)
        for i in range(total)
    ]
    return spark.createDataFrame(rows, "timestamp timestamp, level string")


def rolling(values, position):
    """Mean, variance and squared z of the last 24 values, exactly."""
    window = values[max(0, position - 23) : position + 1]
    if len(window) < 6:
        return None, None, None
    mean = Fraction(sum(window), len(window))
    variance = sum((v - mean) ** 2 for v in window) / len(window)
    return mean, variance, (values[position] - mean) ** 2 / variance if variance else None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hourly_metrics_against_exact_arithmetic(spark, seed):
    rng = random.Random(seed)
    counts = []
    for h in range(60):
        total = rng.choice([0, 3, 4, 5, 40 if h > 30 else 4])
        counts.append((total, rng.randrange(total + 1) if rng.random() < 0.3 else 0))
    counts[0] = counts[-1] = (3, 1)
    got = L.hourly_metrics(hours(spark, counts)).collect()
    assert [r["timestamp"] for r in got] == [START + timedelta(hours=h) for h in range(60)]
    totals, errors = [c for c, _ in counts], [e for _, e in counts]
    for h, row in enumerate(got):
        assert (row["count"], row["errors"]) == counts[h]
        ratio = errors[h] / totals[h] if totals[h] else 0.0
        assert row["error_ratio"] == ratio
        spike = ratio > 0.5
        for name, values in (("count", totals), ("errors", errors)):
            mean, variance, squared = rolling(values, h)
            if mean is None:
                assert row[f"{name}_ma"] is None and row[f"{name}_std"] is None
            else:
                assert math.isclose(row[f"{name}_ma"], mean)
                assert math.isclose(row[f"{name}_std"], math.sqrt(variance), abs_tol=1e-12)
            if squared is None:
                assert row[f"z_{name}"] is None
            else:
                assert math.isclose(abs(row[f"z_{name}"]), math.sqrt(squared), abs_tol=1e-9)
                spike |= squared > 9
        assert row["spike"] == spike


def test_z_of_exactly_three_is_no_spike(spark):
    for low, high in ((7, 8), (1, 2), (3, 30)):
        got = L.hourly_metrics(hours(spark, [(low, 0)] * 9 + [(high, 0)])).collect()
        assert not got[-1]["spike"]
    assert L.hourly_metrics(hours(spark, [(7, 0)] * 10 + [(8, 0)])).collect()[-1]["spike"]


def test_huge_counts_do_not_overflow(spark):
    from logloom.operators.hourly import _rolling

    rows = [(START + timedelta(hours=h), 10**12 + (10**13 if h == 20 else 0)) for h in range(21)]
    df = spark.createDataFrame(rows, "timestamp timestamp, count bigint")
    columns, spike = _rolling("count")
    last = df.withColumns({**columns, "s": spike}).orderBy(F.desc("timestamp")).first()
    assert last["s"] and math.isclose(last["z_count"], math.sqrt(20))


def test_hourly_edges(spark):
    none = L.hourly_metrics(hours(spark, []))
    assert none.columns == list(METRIC_COLUMNS) and none.count() == 0
    assert L.hourly_metrics(hours(spark, [(1, 1)]).drop("timestamp")).count() == 0
    df = hours(spark, [(3, 1), (0, 0), (0, 0), (2, 2)])
    assert [(r["count"]) for r in L.hourly_volume(df).collect()] == [3, 0, 0, 2]
    assert [r["timestamp"] for r in L.spikes(df).collect()] == [START + timedelta(hours=3)]
    assert tuple(L.anomaly_summary(df).first()) == (4, 1, 1.0)


def test_module_ranking(spark, sample_logs):
    got = L.module_ranking(sample_logs).collect()
    assert [(r["module"], r["total"], r["errors"], r["warns"], r["error_rate"]) for r in got] == [
        ("db", 3, 2, 0, 0.667), ("api", 3, 1, 1, 0.333), ("cache", 1, 0, 0, 0.0)
    ]
    assert got[0]["first_seen"] == START + timedelta(minutes=10)
    typed = L.module_ranking(L.add_enrichments(sample_logs))
    assert typed.filter("module = 'db'").first()["OTHER"] == 3
    assert typed.filter("module = 'db'").first()["GC"] == 0
    assert L.module_ranking(sample_logs.drop("module")).count() == 0
    assert L.module_ranking(sample_logs.limit(0)).count() == 0


def test_module_ranking_of_null_modules_and_messages(spark):
    df = spark.createDataFrame(
        [(None, "ERROR", "m", "OTHER"), ("a", "ERROR", None, "UNKNOWN"), ("a", "error", "m", "GC")],
        "module string, level string, message string, line_type string",
    )
    got = {r["module"]: r for r in L.module_ranking(df).collect()}
    assert (got["a"]["total"], got["a"]["errors"], got["a"]["error_rate"]) == (1, 2, 2.0)
    assert (got["a"]["UNKNOWN"], got["a"]["GC"]) == (0, 1)
    assert got[None]["total"] == 1 and got[None]["OTHER"] is None
    assert [r["module"] for r in L.module_type_pivot(df).collect()] == ["a"]


def test_rate_is_rounded_half_to_even(spark):
    df = spark.createDataFrame([("m", "ERROR" if i < 1 else "INFO", "x") for i in range(16)], "module string, level string, message string")
    assert L.module_ranking(df).first()["error_rate"] == 0.062


def test_top_modules(spark):
    rows = [(f"m{m:02d}", "ERROR" if i < m else "INFO", "x") for m in range(25) for i in range(25)]
    df = spark.createDataFrame(rows, "module string, level string, message string")
    assert [r["module"] for r in L.errors_per_module(df).collect()] == [f"m{m:02d}" for m in range(24, 4, -1)]
    assert [r["module"] for r in L.top_error_rates(df).collect()] == [f"m{m:02d}" for m in range(24, 9, -1)]
    assert L.top_error_rates(df, min_volume=26).count() == 0


def test_http_stats(spark):
    df = spark.createDataFrame(
        [("GET /a HTTP/1.1 200 1",), ("GET /a HTTP/1.1 404 1",), ("POST /b HTTP/1.1 200 1",), ("GET /c none",), (None,)],
        "message string",
    )
    paths, status = L.http_stats(df)
    assert [tuple(r) for r in paths.collect()] == [("/a", 2), ("/b", 1)]
    assert [tuple(r) for r in status.collect()] == [("200", 2), ("404", 1)]
    given, _ = L.http_stats(df.withColumn("request_path", F.lit("/given")))
    assert [tuple(r) for r in given.collect()] == [("/given", 3)]


def test_heatmaps(spark, sample_logs):
    got = L.activity_heatmap(sample_logs).collect()
    assert len(got) == 14 and sum(r["count"] for r in got) == 7
    assert [r["day"] for r in got[::2]] == ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
    assert {r["hour"]: r["count"] for r in got if r["day"] == "Sunday"} == {7: 6, 8: 1}
    assert [tuple(r)[2:] for r in L.activity_heatmap(sample_logs, fill=False).collect()] == [(7, 6), (8, 1)]
    errors = L.error_heatmap(sample_logs).collect()
    assert len(errors) == 7 and sum(r["count"] for r in errors) == 3


def test_counts_and_filters(spark, sample_logs):
    assert {r["level"]: r["count"] for r in L.level_counts(sample_logs).collect()} == Counter(ERROR=3, INFO=2, WARNING=1, DEBUG=1)
    assert [r["level"] for r in L.distinct_values(sample_logs, "level").collect()] == ["DEBUG", "ERROR", "INFO", "WARNING"]
    timeline = L.level_timeline(sample_logs).collect()
    # Only the DEBUG row, the last one, falls into the second hour.
    assert [(r["hour"].hour, r["level"], r["count"]) for r in timeline] == [
        (7, "ERROR", 3), (7, "INFO", 2), (7, "WARNING", 1), (8, "DEBUG", 1)
    ]
    assert L.filter_time(sample_logs, START + timedelta(minutes=10), "2025-03-02 07:30:00").count() == 3
    assert L.filter_values(sample_logs, "level", []).count() == 7
    assert L.filter_values(sample_logs, "level", ["error"]).count() == 0
    assert L.filter_keyword(sample_logs, "ERR.R IN DB").count() == 2
    assert L.filter_keyword(sample_logs, "#", literal=True).count() == 7
    assert L.filter_keyword(sample_logs, ".", literal=True).count() == 0
    assert L.filter_keyword(sample_logs, None).count() == 7
    assert L.apply_filters(sample_logs, levels=["ERROR"], modules=["db"], keyword="#1").count() == 1


def test_phrases(spark):
    rows = [("ERROR", "the connection was refused to db")] * 10 + [("error", "Auth token expired")] * 5 + [("INFO", "no no"), ("ERROR", None), ("ERROR", "")]
    df = spark.createDataFrame(rows, "level string, message string")
    got = {r["ngram"]: r["count"] for r in L.top_error_phrases(df, top=50).collect()}
    assert got == {
        "connection refused": 10, "refused db": 10, "connection refused db": 10,
        "auth token": 5, "token expired": 5, "auth token expired": 5,
    }
    assert [r["count"] for r in L.top_error_phrases(df, top=4).collect()] == [10, 10, 10, 5]
    assert L.top_error_phrases(df.limit(0)).count() == 0
    bridged = L.top_phrases(df, stopped=["refused"], top=50)
    assert bridged.filter("ngram = 'was to'").count() == 1


@pytest.mark.parametrize("probed, top", [(1, 1), (1, 7), (4, 40), (1024, 40), (2, 10**6), (3, 0)])
def test_phrases_are_exact_beyond_the_probe(spark, probed, top):
    """However few buckets are probed, and with ties at the border, as counted by hand."""
    rng = random.Random(3)
    words = [f"w{i:02d}" for i in range(40)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(300)] + ["", None, "w01", "w01 w01 w01"]
    counts = Counter()
    for text in texts:
        own = (text or "").split()
        counts.update(" ".join(own[i : i + n]) for n in (2, 3) for i in range(len(own) - n + 1))
    want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:top]
    table = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = L.top_phrases(table, "text", top=top, stopped=[], probed=probed).collect()
    assert [tuple(r) for r in got] == want


ERRORS = [
    "Connection refused to db host", "Database timeout after 30s", "Failed to connect to postgres",
    "Auth token expired for user", "Invalid credentials provided",
]


def errors_log(spark, n):
    return spark.createDataFrame([("ERROR", ERRORS[i % 5]) for i in range(n)] + [("INFO", "x")], "level string, message string")


def test_clusters_label_every_error_alike(spark):
    got = L.cluster_errors(errors_log(spark, 30), n_clusters=5).collect()
    assert len(got) == 30
    labels = {r["message"]: r["cluster"] for r in got}
    assert all(labels[r["message"]] == r["cluster"] for r in got)
    assert sorted(labels.values()) == [0, 1, 2, 3, 4]
    assert sum(r["messages"] for r in L.cluster_sizes(L.cluster_errors(errors_log(spark, 30), 2)).collect()) == 30


def test_clusters_separate_what_shares_no_word(spark):
    rows = [("ERROR", m) for m in ["disk full sda", "disk full sdb", "login denied bob", "login denied eve"] * 3]
    got = {r["message"]: r["cluster"] for r in L.cluster_errors(spark.createDataFrame(rows, "level string, message string"), 2).collect()}
    assert got["disk full sda"] == got["disk full sdb"] != got["login denied bob"] == got["login denied eve"]


def test_clusters_edges(spark):
    assert L.cluster_errors(errors_log(spark, 1)).count() == 0
    assert L.cluster_errors(errors_log(spark, 0)).count() == 0
    stop_only = spark.createDataFrame([("ERROR", "the and of")] * 3, "level string, message string")
    assert L.cluster_errors(stop_only).count() == 0
    one = L.cluster_errors(errors_log(spark, 6), n_clusters=1).collect()
    assert {r["cluster"] for r in one} == {0} and len(one) == 6
    few = L.cluster_errors(errors_log(spark, 2), n_clusters=5)
    assert few.count() == 2


def _by_hand(rows, model, centroids, rounds):
    """K-means of whole numbers, message by message: labels, distances and cost."""

    def vector(message):
        tf = [float(re.findall(r"\w\w+", message).count(w)) * i for w, i in zip(model.words, model.idf.tolist())]
        norm = math.sqrt(sum(x * x for x in tf)) or 1.0
        return [math.floor((1 << 15) * x / norm) for x in tf]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids))

    vectors = [vector(m) for m in rows]
    for _ in range(rounds):
        members = [[x for x in vectors if nearest(x)[1] == j] for j in range(len(centroids))]
        centroids = [[sum(c) // len(own) for c in zip(*own)] if own else old for own, old in zip(members, centroids)]
    return [nearest(x)[::-1] for x in vectors], sum(nearest(x)[0] for x in vectors)


def _cluster_logs(spark, parts):
    draw = random.Random(5)
    words = [f"word{i}" for i in range(12)]
    rows = [" ".join(draw.choices(words[4 * (i % 3):4 * (i % 3) + 6], k=draw.randint(0, 7))) for i in range(160)]
    rows += [rows[7]] * 90
    logs = spark.createDataFrame([("ERROR", r) for r in rows], "level string, message string")
    return rows, logs.repartition(parts, F.xxhash64("message") % 7)


@pytest.mark.parametrize("rounds", [1, 3])
def test_clusters_round_by_round(spark, rounds):
    """Weights of repeated texts, texts without words and an idle centroid included."""
    rows, logs = _cluster_logs(spark, 3)
    initial = [rows[7], rows[8], rows[9], rows[7]]
    none = L.fit_clusters(logs, 4, initial=initial, rounds=0)
    model = L.fit_clusters(logs, 4, initial=initial, rounds=rounds)
    want, cost = _by_hand(rows, model, none.centroids.tolist(), rounds)
    got = {r["message"]: (r["cluster"], r["distance"]) for r in L.label_errors(logs, model).collect()}
    assert [got[m] for m in rows] == want and model.cost == cost


def test_clusters_are_the_same_however_rows_are_dealt(spark):
    models = [L.fit_clusters(_cluster_logs(spark, parts)[1], 3, restarts=4) for parts in (1, 5)]
    assert models[0].centroids.tolist() == models[1].centroids.tolist() and models[0].cost == models[1].cost
    # The best of the starts, and one that rests: a further round gains nothing to speak of.
    rows, logs = _cluster_logs(spark, 2)
    assert models[0].cost <= min(L.fit_clusters(logs, 3, seed=42 + i, restarts=1).cost for i in range(4))
    assert _by_hand(rows, models[0], models[0].centroids.tolist(), 1)[1] >= 0.99 * models[0].cost


def test_cluster_sums_of_heavy_messages_are_exact(spark):
    """Weights beyond what a product of doubles could hold."""
    heavy = (1 << 36) + 12345
    points = spark.createDataFrame(
        [(1, heavy, [0], [32767]), (2, 3, [0, 1], [5, 7]), (3, heavy, [1], [32768])],
        "key long, weight long, places array<int>, `values` array<int>")
    sums, weights, cost = clusters._pass(points, np.array([[[32767, 0], [0, 0]]]))
    assert sums.tolist() == [[[32767 * heavy, 0], [15, 21 + 32768 * heavy]]]
    assert weights.tolist() == [[heavy, heavy + 3]] and cost == [3 * 74 + heavy * 32768**2]


def test_cluster_vectors_of_long_messages_are_made_in_pieces():
    """Words of a batch of long messages are looked up in pieces that end anywhere, also within a message."""
    names, idf = ["a", "b", "c"], np.array([3, 5, 7])
    draw = np.random.default_rng(2)
    lengths = np.array([0, 700_000, 3, 0, 1_200_000, 0, 1, 600_000, 0])
    drawn = draw.integers(0, 4, lengths.sum())
    tokens = pa.ListArray.from_arrays(np.concatenate([[0], lengths.cumsum()]).astype(np.int32), pa.array([*names, "other"]).take(drawn))
    tracemalloc.start()
    try:
        (start, got), = clusters._slices(tokens, pa.array(names), idf)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    want = np.array([[(own == i).sum() for i in range(3)] for own in np.split(drawn, lengths.cumsum()[:-1])]) * idf.astype(float)
    norm = np.sqrt((want * want).sum(axis=1, keepdims=True))
    assert start == 0 and got.tolist() == np.floor((1 << 15) * want / np.where(norm > 0, norm, 1)).tolist()
    assert peak < 20e6  # eight bytes for each of the words are 20 MB


@pytest.mark.parametrize("errors, clusters", [(30, 5), (6, 1), (1, 5)])
def test_cluster_labels_without_messages(spark, errors, clusters):
    """The same labels, and messages don't go through Python for them."""
    whole, bare = (L.cluster_errors(errors_log(spark, errors), clusters, messages=m) for m in (True, False))
    assert bare.columns == ["cluster"] and bare.schema["cluster"].dataType == whole.schema["cluster"].dataType
    assert L.cluster_sizes(bare).collect() == L.cluster_sizes(whole).collect()
    plan = bare._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan or "message" not in plan.split("MapInArrow")[1].split("\n")[0]


def test_worker_summary(spark, lines):
    texts = [
        "[Sun Mar 02 07:15:18 2025] [error] workerEnv in error state 6",
        "[Sun Mar 02 07:15:19 2025] [error] workerEnv in error state 6",
        "[Sun Mar 02 07:15:20 2025] [notice] Found child 12 in scoreboard slot 3",
        "[Sun Mar 02 07:15:21 2025] [notice] workerEnv.init() ok /etc/w.properties",
    ]
    states, files, slots = L.worker_summary(L.parse(lines(texts), "apache_modjk"))
    assert [tuple(r) for r in states.collect()] == [("6", 2)]
    assert [r["config_file"] for r in files.collect()] == ["/etc/w.properties"]
    assert [(r["child_pid"], r["slot"]) for r in slots.collect()] == [("12", "3")]


def test_hours_with_one_wrong_date(spark):
    """A gap of decades is filled hour by hour, in small arrays."""
    rows = [(datetime(1990, 1, 1, 5, 30), "INFO"), (datetime(2025, 3, 2, 7, 0), "ERROR")]
    got = L.hourly_counts(spark.createDataFrame(rows, "timestamp timestamp, level string"))
    hours = int((datetime(2025, 3, 2, 7) - datetime(1990, 1, 1, 5)).total_seconds() // 3600) + 1
    assert got.count() == got.select("timestamp").distinct().count() == hours
    assert sorted((r["timestamp"].year, r["count"], r["errors"]) for r in got.filter("count > 0").collect()) == [
        (1990, 1, 0), (2025, 1, 1)]


def test_words_beyond_the_vocabulary_take_no_part(spark):
    rows = [("ERROR", "alpha beta")] * 3 + [("ERROR", "gamma delta")] * 2
    logs = spark.createDataFrame(rows, "level string, message string")
    got = {r["message"]: r["cluster"] for r in L.cluster_errors(logs, 2, max_features=4).collect()}
    assert got["alpha beta"] != got["gamma delta"]
    assert L.cluster_errors(logs, 2, max_features=2).count() == 5
