"""What the checking database should find, from the tables as given.

None of this reads log text: the expected values come from the columns the
text was made of.
"""

from __future__ import annotations

from ..functions import fixed_values as fv
from ..operators.clusters import IDF_UNIT, LENGTH
from .event_logs import BASE_CTE, LINES_PER_EVENT, MIXED_FORMATS, USER_AGENTS

_WITH = f"WITH {BASE_CTE} "


def _base(columns: str, rest: str = "") -> str:
    return f"{_WITH} SELECT {columns} FROM base {rest}"


def _agent(position: int) -> str:
    whens = " ".join(f"WHEN {i} THEN '{a[position]}'" for i, a in enumerate(USER_AGENTS))
    return f"CASE event_id % 4 {whens} END"


_SEVERITY = (
    "CASE level WHEN 'ERROR' THEN 'error' WHEN 'WARNING' THEN 'warn' "
    "WHEN 'DEBUG' THEN 'debug' ELSE 'notice' END"
)
_CONNECTOR_MESSAGE = (
    "CASE event_id % 3 "
    "WHEN 0 THEN 'mod_jk child workerEnv in error state ' || (event_id % 7) "
    "WHEN 1 THEN 'jk2_init() Found child ' || event_id || ' in scoreboard slot ' || (event_id % 13) "
    "ELSE 'workerEnv.init() ok /etc/httpd/conf/workers' || (user_id % 4) || '.properties' END"
)
_CONNECTOR_WORKER = {
    "worker_type": "CASE event_id % 3 WHEN 1 THEN 'child_process' ELSE 'environment' END",
    "error_state": "CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 7 AS VARCHAR) END",
    "child_pid": "CASE WHEN event_id % 3 = 1 THEN CAST(event_id AS VARCHAR) END",
    "slot": "CASE WHEN event_id % 3 = 1 THEN CAST(event_id % 13 AS VARCHAR) END",
    "config_file": "CASE WHEN event_id % 3 = 2 THEN '/etc/httpd/conf/workers' || (user_id % 4) || '.properties' END",
}
_GENERIC_MESSAGE = (
    "strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || lower(level) || ' from ' || ip || ' ' || message"
)
# The status stands in requests, and in orders of users with three-digit ids.
_STATUS = (
    "CASE WHEN line_type = 'HTTP_ACCESS' THEN status "
    "WHEN message LIKE 'order placed%' AND user_id >= 100 THEN CAST(user_id AS VARCHAR) END"
)
_METHOD = "CASE WHEN line_type = 'HTTP_ACCESS' THEN method END"
_PATH = "CASE WHEN line_type = 'HTTP_ACCESS' THEN path END"
_RESPONSE = (
    "CASE WHEN level = 'ERROR' THEN CAST(event_id % 900 AS DOUBLE) "
    "WHEN message LIKE 'item shown%' THEN (event_id % 9) * 1000.0::DOUBLE + 500 END"
)
_NET = "'10.0.' || (user_id % 256)"
_TIME = "ts AS timestamp"
_PLAIN = f"event_id, {_TIME}, level, module, message"

_HOURS = f"""
{_WITH},
logs AS (SELECT * FROM base {{where}}),
seen AS (
  SELECT date_trunc('hour', ts) AS h, count(*) AS c, count(*) FILTER (level = 'ERROR') AS e
  FROM logs GROUP BY 1),
spine AS (SELECT unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h FROM seen),
dense AS (
  SELECT h, CAST(coalesce(c, 0) AS BIGINT) AS c, CAST(coalesce(e, 0) AS BIGINT) AS e
  FROM spine LEFT JOIN seen USING (h)),
sums AS (
  SELECT *, count(*) OVER w AS n,
    CAST(sum(c) OVER w AS BIGINT) AS cs, CAST(sum(c * c) OVER w AS BIGINT) AS cq,
    CAST(sum(e) OVER w AS BIGINT) AS es, CAST(sum(e * e) OVER w AS BIGINT) AS eq
  FROM dense WINDOW w AS (ORDER BY h ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
metrics AS (
  SELECT h AS timestamp, c AS count, e AS errors,
    round(CASE WHEN c = 0 THEN 0.0 ELSE e::DOUBLE / c END, 6) AS error_ratio,
    round(CASE WHEN n >= 6 THEN cs::DOUBLE / n END, 6) AS count_ma,
    round(CASE WHEN n >= 6 THEN sqrt((n * cq - cs * cs)::DOUBLE) / n END, 6) AS count_std,
    round(CASE WHEN n >= 6 AND n * cq > cs * cs
      THEN (n * c - cs)::DOUBLE / sqrt((n * cq - cs * cs)::DOUBLE) END, 6) AS z_count,
    round(CASE WHEN n >= 6 THEN es::DOUBLE / n END, 6) AS errors_ma,
    round(CASE WHEN n >= 6 THEN sqrt((n * eq - es * es)::DOUBLE) / n END, 6) AS errors_std,
    round(CASE WHEN n >= 6 AND n * eq > es * es
      THEN (n * e - es)::DOUBLE / sqrt((n * eq - es * es)::DOUBLE) END, 6) AS z_errors,
    (n >= 6 AND (n * c - cs) * (n * c - cs) > 9 * (n * cq - cs * cs))
      OR (n >= 6 AND (n * e - es) * (n * e - es) > 9 * (n * eq - es * es))
      OR (c > 0 AND 2 * e > c) AS spike
  FROM sums)
"""


def _hours(select: str, where: str = "") -> str:
    return _HOURS.replace("{where}", where) + select


def _ranked(select: str, module: str = "module") -> str:
    return (
        f"{_WITH}, r AS (SELECT {module} AS module, count(*) AS total, "
        "count(*) FILTER (level = 'ERROR') AS errors, count(*) FILTER (level = 'WARNING') AS warns, "
        f"min(ts) AS first_seen, max(ts) AS last_seen, {_TYPES} FROM base GROUP BY 1) "
        f"SELECT {select}"
    )


_TYPE_NAMES = [n for n, _ in fv.LINE_TYPES] + [fv.LINE_TYPE_OTHER, fv.LINE_TYPE_UNKNOWN]
_TYPES = ", ".join(f"count(*) FILTER (line_type = '{n}') AS \"{n}\"" for n in _TYPE_NAMES)
_RATE = "round_even(errors::DOUBLE / total, 3) AS error_rate"


def _heatmap(where: str = "") -> str:
    return f"""
{_WITH}, seen AS (
  SELECT isodow(ts) - 1 AS day_number, hour(ts) AS hour, count(*) AS n FROM base {where} GROUP BY 1, 2),
grid AS (
  SELECT d.day_number, h.hour
  FROM (SELECT unnest(range(7)) AS day_number) d, (SELECT DISTINCT hour FROM seen) h)
SELECT CAST(day_number AS INTEGER) AS day_number, CAST(hour AS INTEGER) AS hour,
  ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][day_number + 1] AS day,
  CAST(coalesce(n, 0) AS BIGINT) AS count
FROM grid LEFT JOIN seen USING (day_number, hour)"""


def _sequences(minutes: int, seq_len: int, top: int) -> str:
    runs = " UNION ALL ".join(
        f"SELECT list_slice(toks, i, i + {n - 1}) AS s FROM "
        f"(SELECT toks, unnest(range(1, len(toks) - {n - 2})) AS i FROM hist WHERE len(toks) >= {n})"
        for n in range(2, seq_len + 1)
    )
    return f"""
{_WITH}, pairs AS (
  SELECT e.event_id AS err, p.ts, p.event_id, p.line_type || ':' || p.module AS tok,
    row_number() OVER (PARTITION BY e.event_id ORDER BY p.ts DESC, p.event_id DESC) AS rn
  FROM base e JOIN base p
    ON p.ts < e.ts AND p.ts >= e.ts - INTERVAL {minutes} MINUTE
  WHERE e.level = 'ERROR'),
hist AS (
  SELECT err, list(tok ORDER BY ts, event_id) AS toks FROM pairs WHERE rn <= 50 GROUP BY err),
runs AS ({runs}),
counted AS (SELECT s, count(*) AS count FROM runs GROUP BY s)
SELECT array_to_string(s, ' → ') AS sequence, count
FROM counted ORDER BY count DESC, s LIMIT {top}"""


def _words(word: str) -> str:
    stopped = ", ".join(
        "'" + w.replace("'", "''") + "'"
        for w in fv.ENGLISH_STOP_WORDS
    )
    return f"list_filter(regexp_extract_all(lower(text), '{word}'), lambda w: w NOT IN ({stopped}))"


def _phrases(source: str, word: str, top: int) -> str:
    return f"""
WITH {source},
words AS (SELECT {_words(word)} AS ws FROM texts),
grams AS (
  SELECT unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS ngram FROM words
  UNION ALL
  SELECT unnest(list_transform(range(1, len(ws) - 1),
    lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS ngram FROM words)
SELECT ngram, count(*) AS count FROM grams GROUP BY ngram ORDER BY count DESC, ngram LIMIT {top}"""


def _cluster_round(word: str, k: int) -> str:
    """Whole vectors of TF-IDF, a round from ``k`` messages, and the nearest centroids after it."""

    def nearest(centres: str) -> str:
        return f"""
  SELECT text, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
    SELECT s.text, c.cluster, s.square + c.square - 2 * coalesce(p.product, 0) AS d
    FROM squares s CROSS JOIN (
      SELECT n.cluster, coalesce(sum(x * x), 0) AS square
      FROM numbers n LEFT JOIN {centres} USING (cluster) GROUP BY n.cluster) c
    LEFT JOIN (
      SELECT v.text, c.cluster, sum(v.x * c.x) AS product
      FROM vectors v JOIN {centres} c USING (word) GROUP BY ALL) p
    ON p.text = s.text AND p.cluster = c.cluster) GROUP BY text"""

    return f"""
WITH texts AS (SELECT coalesce(text, '') AS text FROM documents),
messages AS (SELECT text, count(*) AS weight FROM texts GROUP BY text),
terms AS (
  SELECT text, weight, word, count(*) AS tf
  FROM (SELECT text, weight, unnest({_words(word)}) AS word FROM messages) GROUP BY ALL),
vocabulary AS (
  SELECT word, floor({IDF_UNIT} * (ln((1 + (SELECT count(*) FROM texts)) / (1 + sum(weight))) + 1)) AS idf
  FROM terms GROUP BY word ORDER BY sum(tf * weight) DESC, word LIMIT {fv.CLUSTER_VOCABULARY}),
raw AS (SELECT text, word, tf * idf AS v FROM terms JOIN vocabulary USING (word)),
vectors AS (
  SELECT text, word, CAST(floor({LENGTH} * v / sqrt(sum(v * v) OVER (PARTITION BY text))) AS BIGINT) AS x FROM raw),
squares AS (
  SELECT text, weight, coalesce(sum(x * x), 0) AS square FROM messages LEFT JOIN vectors USING (text) GROUP BY ALL),
numbers AS (
  SELECT text, row_number() OVER (ORDER BY md5(text)) - 1 AS cluster FROM messages ORDER BY cluster LIMIT {k}),
first AS (SELECT cluster, word, x FROM numbers JOIN vectors USING (text)),
before AS ({nearest("first")}),
counted AS (SELECT cluster, sum(weight) AS n FROM before JOIN messages USING (text) GROUP BY cluster),
moved AS (
  SELECT cluster, word, sum(m.weight * v.x) // any_value(n) AS x
  FROM before JOIN messages m USING (text) JOIN vectors v USING (text) JOIN counted USING (cluster) GROUP BY ALL
  UNION ALL SELECT cluster, word, x FROM first WHERE cluster NOT IN (SELECT cluster FROM counted)),
after AS ({nearest("moved")})
SELECT text AS message, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance
FROM texts JOIN after USING (text)"""


def _mixed() -> str:
    kind = "event_id % 12"
    names = ", ".join(f"'{n}'" for n in MIXED_FORMATS)
    levels = (
        f"CASE {kind} WHEN 2 THEN status WHEN 3 THEN level "
        f"WHEN 4 THEN level WHEN 10 THEN CAST(event_id % 5 + 1 AS VARCHAR) ELSE level END"
    )
    modules = (
        f"CASE {kind} WHEN 1 THEN module || '[' || user_id || ']' WHEN 2 THEN ip WHEN 3 THEN 'mod_jk' "
        f"WHEN 4 THEN 'tomcat_connector' WHEN 7 THEN 'shop/' || module WHEN 11 THEN 'unknown' ELSE module END"
    )
    messages = (
        f"CASE {kind} WHEN 0 THEN message || CASE WHEN level = 'ERROR' "
        "THEN chr(10) || chr(9) || 'at worker.run(worker.py:7)' ELSE '' END "
        "WHEN 1 THEN lower(level) || ' ' || message "
        "WHEN 2 THEN method || ' ' || path || ' HTTP/1.1' "
        f"WHEN 3 THEN {_CONNECTOR_MESSAGE} WHEN 11 THEN {_GENERIC_MESSAGE} ELSE message END"
    )
    return _base(
        f"event_id, [{names}][{kind} + 1] AS format, {_TIME}, {levels} AS level, "
        f"{modules} AS module, {messages} AS message"
    )


_REDACTED = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, "
    f"'{fv.EMAIL}', '<email>', 'g'), '{fv.IPV4}', '<ip>', 'g'), "
    f"'{fv.UUID}', '<uuid>', 'g'), '{fv.TOKEN}', '<token>', 'g')"
)
_REDACTED_MESSAGE = "replace(message, ip, '<ip>')"

_SPECIAL_START = r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}|\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}|\d+\.\d+\.\d+\.\d+ - - \[|<Event|\{)"
_ASSEMBLED = f"""
WITH lines AS (
  SELECT doc_id, i - 1 AS i, list_extract(ls, i) AS line
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
marked AS (
  SELECT *, CASE WHEN i % 3 = 0 THEN '[2024-01-01 00:00:00] ' || line ELSE line END AS value,
    CASE WHEN i % 3 = 0 OR regexp_matches(line, '{_SPECIAL_START}') THEN 1 ELSE 0 END AS starts
  FROM lines),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) AS rec FROM marked)
SELECT CAST(doc_id AS VARCHAR) AS source, CAST(min(i) AS BIGINT) AS record_id,
  string_agg(value, chr(10) ORDER BY i) AS value
FROM numbered GROUP BY doc_id, rec"""

_DETECTED = (
    "SELECT DISTINCT 'src' || (event_id % 12) AS source, "
    f"[{', '.join(repr(n) for n in MIXED_FORMATS)}][event_id % 12 + 1] AS format FROM events"
)

ORACLES: dict[str, str] = {
    "parse_custom": _base(_PLAIN),
    "parse_syslog": _base(
        f"event_id, {_TIME}, level, module || '[' || user_id || ']' AS module, "
        "lower(level) || ' ' || message AS message, 'host' || (user_id % 7) AS ip"
    ),
    "parse_apache": _base(
        f"event_id, {_TIME}, status AS level, ip AS module, method || ' ' || path || ' HTTP/1.1' AS message, "
        "ip, status AS status_code, agent AS user_agent, method AS request_type, path AS request_path"
    ),
    "parse_json": _base(
        f"{_PLAIN}, ip, agent AS user_agent, status AS status_code, "
        "CASE WHEN event_id % 900 > 0 THEN CAST(event_id % 900 AS VARCHAR) END AS request_time"
    ),
    "parse_docker": _base(_PLAIN),
    "parse_k8s": _base(f"event_id, {_TIME}, level, 'shop/' || module AS module, message"),
    "parse_cloudwatch": _base(_PLAIN),
    "parse_gcp": _base(f"{_PLAIN}, agent AS user_agent"),
    "parse_winxml": _base(
        f"event_id, {_TIME}, CAST(event_id % 5 + 1 AS VARCHAR) AS level, module, message"
    ),
    "winxml_files": _base(
        f"{_TIME}, CAST(event_id % 5 + 1 AS VARCHAR) AS level, module, message"
    ),
    "parse_modjk": _base(
        f"event_id, {_TIME}, level, 'mod_jk' AS module, {_CONNECTOR_MESSAGE} AS message, "
        f"{_SEVERITY} AS severity"
    ),
    "parse_modjk_worker": _base(
        f"event_id, {_TIME}, " + ", ".join(f"{sql} AS {n}" for n, sql in _CONNECTOR_WORKER.items())
    ),
    "parse_tomcat": _base(
        f"event_id, {_TIME}, level, 'tomcat_connector' AS module, message, {_SEVERITY} AS severity"
    ),
    "parse_generic": _base(
        f"event_id, {_TIME}, level, 'unknown' AS module, {_GENERIC_MESSAGE} AS message, ip"
    ),
    "parse_with_layout": _base(f"event_id, {_TIME}, level, '[' || module || '] ' || message AS message"),
    "detect_format": _DETECTED,
    "assemble": _ASSEMBLED,
    "mixed_formats": _mixed(),
    "registered_format": _base("event_id, 'own_pipes' AS format, level, message, event_id AS number"),
    "line_type": _base("event_id, line_type"),
    "http_fields": _base(f"event_id, {_METHOD} AS request_type, {_PATH} AS request_path"),
    "status_code": _base(f"event_id, {_STATUS} AS status_code"),
    "status_code_access": _base("event_id, status AS status_code, path AS request_path"),
    "response_time": _base(f"event_id, {_RESPONSE} AS response_time_ms"),
    "user_id": _base(
        "event_id, CASE WHEN level = 'ERROR' THEN 'u' || user_id "
        "WHEN message LIKE 'order placed%' THEN CAST(user_id AS VARCHAR) END AS user_id"
    ),
    "user_agent": _base(
        f"event_id, {_agent(1)} AS ua_browser, {_agent(2)} AS ua_os, {_agent(3)} AS ua_device"
    ),
    "ip_fallback": _base("event_id, CASE WHEN level = 'WARNING' THEN ip END AS ip"),
    "ip_fallback_dataset": _base(
        "event_id, CASE WHEN event_id % 2 = 0 THEN '10.9.8.7' END AS ip"
    ),
    "redact_documents": f"SELECT doc_id, {_REDACTED} AS redacted_message FROM documents",
    "sql_functions": _base(
        f"event_id, line_type, {_RESPONSE} AS response_time_ms, {_REDACTED_MESSAGE} AS redacted, "
        "'Other' AS browser"
    ),
    "filter_time_range": _base(
        f"event_id, {_TIME}",
        "WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'",
    ),
    "filter_level_module": _base(
        "event_id, level, module",
        "WHERE level IN ('ERROR', 'WARNING') AND module IN ('svc1', 'svc3')",
    ),
    "filter_keyword_regex": _base(
        "event_id, message", "WHERE message LIKE '%timed out%' OR message LIKE '%pool%'"
    ),
    "filter_keyword_documents": "SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'the')",
    "filters_combined": _base(
        f"event_id, {_TIME}, level, module",
        "WHERE ts BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' "
        "AND level = 'ERROR' AND module IN ('svc0', 'svc2')",
    ),
    "distinct_modules": _base("DISTINCT module"),
    "module_ranking": _ranked(
        f"module, total, errors, warns, first_seen, last_seen, {_RATE}, "
        + ", ".join(f'"{n}"' for n in _TYPE_NAMES)
        + " FROM r"
    ),
    "module_type_pivot": _base(f"module, {_TYPES}", "GROUP BY module"),
    "module_error_rate_top": _ranked(
        f"module, total, errors, {_RATE} FROM r WHERE total >= {fv.MIN_MODULE_VOLUME} "
        f"ORDER BY error_rate DESC, module LIMIT {fv.TOP_ERROR_RATE_MODULES}",
        _NET,
    ),
    "module_errors_top": _base(
        f"{_NET} AS module, count(*) AS errors",
        f"WHERE level = 'ERROR' GROUP BY 1 ORDER BY errors DESC, module LIMIT {fv.TOP_MODULES}",
    ),
    "hourly_metrics": _hours("SELECT * FROM metrics"),
    "spikes": _hours("SELECT * FROM metrics WHERE spike", "WHERE level IN ('ERROR', 'WARNING')"),
    "anomaly_summary": _hours(
        "SELECT count(*) AS hours, count(*) FILTER (spike) AS spike_hours, "
        "max(error_ratio) AS max_error_ratio FROM metrics"
    ),
    "http_top_paths": _base(
        "path AS request_path, count(*) AS count",
        "WHERE line_type = 'HTTP_ACCESS' GROUP BY 1 ORDER BY count DESC, request_path LIMIT 20",
    ),
    "http_status": _base(
        "status AS status_code, count(*) AS count", "WHERE line_type = 'HTTP_ACCESS' GROUP BY 1"
    ),
    "http_top_pages": (
        "SELECT regexp_replace(url, '^[a-z]+://[^/]+', '') AS request_path, count(*) AS count "
        "FROM pages GROUP BY 1 ORDER BY count DESC, request_path LIMIT 20"
    ),
    "level_counts": _base("level, count(*) AS count", "GROUP BY level"),
    "status_counts": (
        f"{_WITH}, s AS (SELECT {_STATUS} AS status_code FROM base) SELECT status_code, "
        "count(*) AS count FROM s WHERE status_code IS NOT NULL GROUP BY 1"
    ),
    "method_counts": _base(
        "method AS request_type, count(*) AS count", "WHERE line_type = 'HTTP_ACCESS' GROUP BY 1"
    ),
    "line_type_counts": _base("line_type, count(*) AS count", "GROUP BY 1"),
    "hourly_volume": _hours("SELECT timestamp, count FROM metrics"),
    "level_timeline": _base(
        "date_trunc('hour', ts) AS hour, level, count(*) AS count", "GROUP BY 1, 2"
    ),
    "response_series": (
        f"{_WITH}, s AS (SELECT ts AS timestamp, {_RESPONSE} AS response_time_ms FROM base) "
        "SELECT * FROM s WHERE response_time_ms IS NOT NULL"
    ),
    "heatmap": _heatmap(),
    "heatmap_errors": _heatmap("WHERE level = 'ERROR'"),
    "worker_summary": (
        f"{_WITH} SELECT 'state' AS kind, CAST(event_id % 7 AS VARCHAR) AS name, count(*) AS count "
        "FROM base WHERE event_id % 3 = 0 GROUP BY 2 "
        f"UNION ALL SELECT DISTINCT 'file', {_CONNECTOR_WORKER['config_file']}, 1 "
        "FROM base WHERE event_id % 3 = 2 "
        "UNION ALL SELECT 'slot', event_id || '>' || (event_id % 13), 1 FROM base WHERE event_id % 3 = 1"
    ),
    "error_phrases": _phrases(
        f"{BASE_CTE}, texts AS (SELECT message AS text FROM base WHERE level = 'ERROR')", r"\w{2,}", 50
    ),
    "document_phrases": _phrases(
        "texts AS (SELECT text FROM documents)", r"[\p{L}\p{M}\p{Nd}\p{Pc}]{2,}", 100
    ),
    "error_cluster_round": _cluster_round(r"[\p{L}\p{M}\p{Nd}\p{Pc}]{2,}", 5),
    "error_cluster_texts": _base(
        "string_split(message, ' latency=')[1] AS text, count(*) AS errors", "WHERE level = 'ERROR' GROUP BY 1"
    ),
    "sequences": _sequences(360, 3, 100),
    "sequences_short": _sequences(60, 4, 100),
    "error_history_rows": (
        f"{_WITH} SELECT e.event_id AS error_id, CAST(e.ts AS TIMESTAMP) AS error_time, "
        "row_number() OVER (PARTITION BY e.event_id ORDER BY r.ts DESC, r.event_id DESC) AS place, "
        "r.event_id, CAST(r.ts AS TIMESTAMP) AS timestamp, r.level, r.line_type "
        "FROM base e JOIN base r ON r.ts < e.ts AND r.ts >= e.ts - INTERVAL 360 MINUTE "
        "WHERE e.level = 'ERROR' QUALIFY place <= 50"
    ),
    "page_of_rows": _base(
        f"event_id, {_TIME}, message", "ORDER BY event_id LIMIT 200 OFFSET 400"
    ),
    "first_lines": (
        "SELECT 'src' || (event_id % 3) AS source, event_id, props AS value FROM events "
        "QUALIFY row_number() OVER (PARTITION BY event_id % 3 ORDER BY event_id) <= 300"
    ),
    "export_roundtrip": (
        f"{_WITH} SELECT {_TIME}, level, module, {_REDACTED_MESSAGE} AS message, kind "
        "FROM base, (SELECT unnest(['csv', 'json']) AS kind)"
    ),
    "redacted_export": _base(f"event_id, {_REDACTED_MESSAGE} AS message"),
    "stream_parse": _base(
        f"{_TIME}, level, module, line_type, {_REDACTED_MESSAGE} AS redacted_message"
    ),
    "stream_hourly_counts": _base(
        "date_trunc('hour', ts) AS timestamp, count(*) AS count, "
        "CAST(count(*) FILTER (level = 'ERROR') AS BIGINT) AS errors",
        "GROUP BY 1",
    ),
    "stream_records": _base(
        f"{_TIME}, level, module, message || chr(10) || chr(9) || 'at worker.run(worker.py:7)' AS message"
    ),
    "stream_mixed_formats": f"SELECT format, timestamp, level, module, message FROM ({_mixed()}) AS m",
    "stream_hourly_late": _base(
        "date_trunc('hour', ts) AS timestamp, count(*) AS count, "
        "CAST(count(*) FILTER (level = 'ERROR') AS BIGINT) AS errors",
        "GROUP BY 1",
    ),
}
