"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (all).

``q_*`` run over log text rendered from the events, in one pass with the
query. ``log_*`` run over a file of at least 100 MB of such lines, written
once before: the published figure for comparison is 38 s for a log of 100 MB.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
HEADLINES = (
    "parse_custom", "parse_syslog", "parse_apache", "parse_json", "parse_winxml", "parse_modjk",
    "parse_generic", "detect_format", "assemble", "mixed_formats", "line_type", "redact_documents",
    "module_ranking", "hourly_metrics", "http_top_paths", "heatmap", "error_phrases",
    "document_phrases", "sequences", "error_clusters", "page_of_rows", "first_lines",
)
LOG_BYTES = 100_000_000


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("logloom-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def write_log(spark: SparkSession, folder: str) -> int:
    """At least 100 MB of bracketed lines, all events several times over."""
    from logloom.plans.event_logs import rendered

    text = rendered(spark, SF_DIR, "custom").select("value")
    once = text.agg(F.sum(F.octet_length("value") + 1)).first()[0]
    copies = -(-LOG_BYTES // once)
    text.select(F.explode(F.array_repeat("value", copies)).alias("value")).write.text(folder)
    return once * copies


def main() -> None:
    import logloom as L
    from logloom.plans.catalog import QUERIES

    spark = session()
    run(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count())
    results = {}
    for name in HEADLINES:
        results[f"q_{name}"] = timed(lambda: run(QUERIES[name](spark, SF_DIR)))
        print(f"{name} {results[f'q_{name}']}", file=sys.stderr, flush=True)

    folder = os.path.join(tempfile.mkdtemp(prefix="logloom-bench-"), "log")
    size = write_log(spark, folder)

    def logs(**options) -> DataFrame:
        return L.load_logs(spark, folder, **options)

    jobs = {
        "log_detect": lambda: L.detect_formats(L.read_lines(spark, folder)),
        "log_parse": lambda: L.parse(L.read_lines(spark, folder), "custom"),
        "log_stitch_parse": lambda: logs(format="custom", enrich=False),
        "log_detect_stitch_parse_enrich_redact": lambda: logs(redact=True),
        "log_hourly_metrics": lambda: L.hourly_metrics(logs(format="custom", enrich=False)),
        "log_module_ranking": lambda: L.module_ranking(logs(format="custom")),
        "log_sequences": lambda: L.mine_sequences(logs(format="custom")),
        "log_error_phrases": lambda: L.top_error_phrases(logs(format="custom", enrich=False)),
    }
    for name, job in jobs.items():
        results[name] = timed(lambda: run(job()))
        print(f"{name} {results[name]}", file=sys.stderr, flush=True)

    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(results.values()), 3),
                "unit": "sec",
                "queries": results,
                "sf": SF_DIR.rstrip("/").split("sf")[-1],
                "cpus": int(CPUS),
                "log_mb": round(size / 1e6, 1),
                "log_full_path_mb_per_sec": round(
                    size / 1e6 / results["log_detect_stitch_parse_enrich_redact"], 2
                ),
                "published_log_100mb_sec": 38,
            }
        )
    )


if __name__ == "__main__":
    main()
